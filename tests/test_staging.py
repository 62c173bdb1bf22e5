import datetime as dt
from decimal import Decimal

from basketry.operators import staging
from tests.helpers import at

LOG = "log_item_id string, item_key string, time_log_created_utc string, payload string"
BUY = (
    "time_order_received_utc string, purchase_key string, customer_key string, delivery_distance_line_meters string, "
    "service_fee string, courier_base_fee string, total_basket_value string, item_basket_description string"
)


def test_item_log_payload(spark):
    payload = (
        '{"price_attributes":[{"product_base_price":"2.49","vat_rate_in_percent":7},{"product_base_price":9}],'
        '"name":[{"lang":"de","value":"Riegel"},{"lang":"en","value":"Bar"}],"brand_name":"B",'
        '"item_category":"Chocolate","number_of_units":"3","weight_in_grams":120,'
        '"time_item_created_in_source_utc":"2019-09-05 08:33:06.213"}'
    )
    german = '{"name":[{"lang":"de","value":"Riegel"}],"item_category_en":"Snacks","item_category":"Knabbern"}'
    raw = spark.createDataFrame(
        [("1", "i", "2023-01-01 00:00:00 Z", payload), ("2", "i", "bad", german), ("3", "i", None, "{oops")], LOG
    )
    a, b, c = staging.stage_item_logs(raw).orderBy("log_item_id").collect()
    assert (a.item_name_en, a.item_name_de, a.item_name_preferred) == ("Bar", "Riegel", "Bar")
    assert (a.product_base_price_gross_eur, a.vat_rate_pct) == (Decimal("2.4900"), Decimal("7.0000"))
    assert (a.number_of_units, a.weight_in_grams, a.item_category) == (3, 120, "Chocolate")
    assert a.time_item_created_in_source_utc == at("2019-09-05 08:33:06.213")
    assert (b.item_name_preferred, b.item_category, b.time_log_created_utc) == ("Riegel", "Snacks", None)
    assert c.product_base_price_gross_eur is None and c.item_name_preferred is None


def test_purchase_dates_and_bad_values(spark):
    raw = spark.createDataFrame(
        [
            ("2023-07-01 22:30:00 Z", "p1", "c", "1200", "1.5", "2", "10.25", "[]"),
            ("nonsense", "p2", "c", "far", "1", "2", "n/a", None),
        ],
        BUY,
    )
    a, b = staging.stage_purchase_logs(raw).orderBy("purchase_key").collect()
    assert (a.order_date_utc, a.order_date_berlin) == (dt.date(2023, 7, 1), dt.date(2023, 7, 2))
    assert a.delivery_distance_line_meters == 1200 and a.total_basket_value_eur == Decimal("10.2500")
    assert b.time_order_received_utc is None and b.total_basket_value_eur is None


def test_basket_sums_repeats_and_drops_bad_entries(spark):
    baskets = [
        ("p1", '[{"item_key":"a","item_count":2},{"item_key":"a","item_count":"1"},{"item_key":"b","item_count":0}]'),
        ("p1", '[{"item_key":"a","item_count":4}]'),
        ("p2", "[]"),
        ("p3", "{not json"),
        ("p4", '[{"item_count":1},{"item_key":"c","item_count":-1},{"item_key":"d","item_count":5}]'),
    ]
    df = spark.createDataFrame(baskets, "purchase_key string, item_basket_description_raw string")
    got = sorted(tuple(r) for r in staging.explode_basket(df).collect())
    assert got == [("p1", "a", 7), ("p4", "d", 5)]


def test_promo_types(spark):
    raw = spark.createDataFrame(
        [("2023-05-08", "2023-05-14", "i", "discount", "10"), ("x", "2023-05-14", "i", "discount", "ten")],
        "promo_start_date string, promo_end_date string, item_key string, promo_type string, discount_in_percentage string",
    )
    got = {(r.promo_start_date, r.discount_pct) for r in staging.stage_promos(raw).collect()}
    assert got == {(dt.date(2023, 5, 8), 10), (None, None)}
