from basketry.sources.raw import (
    dev_date_window,
    read_item_logs,
    read_promos,
    read_purchase_logs,
    write_replace,
)
from basketry.sources.sinks import (
    export_category_kpis,
    export_category_scorecard,
    export_customer_promo,
    export_order_items,
    export_orders,
    export_pair_affinity,
    ordered_csv,
    read_ordered,
    write_layout,
    write_table_layout,
)

__all__ = [
    "dev_date_window",
    "export_category_kpis",
    "export_category_scorecard",
    "export_customer_promo",
    "export_order_items",
    "export_orders",
    "export_pair_affinity",
    "ordered_csv",
    "read_item_logs",
    "read_ordered",
    "read_promos",
    "read_purchase_logs",
    "write_layout",
    "write_replace",
    "write_table_layout",
]
