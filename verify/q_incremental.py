"""Reports kept up to date by incremental runs, against the statements of the full reports."""

from __future__ import annotations

from verify.q_core import _after_two_runs
from verify.registry import ORACLE, add

for name, table, full in (
    ("wm5_incremental_monthly", "rpt_category_monthly", "rpt1_category_monthly"),
    ("wm5_incremental_promo_behavior", "rpt_customer_promo", "rpt9_customer_promo"),
):
    add(name, lambda w, s, d, table=table: _after_two_runs(w, s, d).table(table).select(*w[table].columns))
    ORACLE[name] = ORACLE[full]
