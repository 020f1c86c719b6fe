"""Metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prf(pred_hits: Column, pred_total: Column, gold_hits: Column, gold_total: Column) -> list[Column]:
    """precision, recall and f1; 0 where nothing is there to divide by."""
    p = pred_hits / F.greatest(pred_total, F.lit(1))
    r = gold_hits / F.greatest(gold_total, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-6))).alias("f1")]


def prf_sql(pred_hits: str, pred_total: str, gold_hits: str, gold_total: str) -> str:
    """The same in SQL, rounded to 6."""
    p, r = f"({pred_hits}::DOUBLE / greatest({pred_total}, 1))", f"({gold_hits}::DOUBLE / greatest({gold_total}, 1))"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(2 * {p} * {r} / greatest({p} + {r}, 1e-6), 6) AS f1"
