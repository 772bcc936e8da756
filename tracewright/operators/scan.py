"""Running extremes, sums and counts along keys of any size.

A window sorts all rows of a key in one task. Here keys of more than ``piece`` rows are
told apart by a count, and their rows dealt to segments by ranges of (key, order), so a
segment holds about ``piece`` rows whatever the key. Each segment is folded by key; the
folds of the segments before are carried into it, which takes one row for each key and
segment; and a window runs within segments only. Keys of fewer rows take the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut, discard

#: Rows of a key that one task may sort.
PIECE = 1_000_000

BUCKETS = 1 << 14

_FOLD = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
Folds = Mapping[str, tuple[str, Column]]


def _joined(kind: str, a: Column, b: Column) -> Column:
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(a, b)  # nulls do not count
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def hot_keys(rows: DataFrame, key: list[str], piece: int = PIECE) -> tuple[DataFrame, int] | None:
    """The keys of more than ``piece`` rows, and how many rows they have; None if there are none.

    Keys are counted one by one only if some bucket of keys has so many rows: counts of
    ``BUCKETS`` buckets are added up in the tasks, counts of many small keys would be shuffled.
    """
    buckets = rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("_bucket")).agg(F.count("*").alias("_rows"))
    if (buckets.agg(F.max("_rows")).first()[0] or 0) <= piece:
        return None
    found = cut(rows.groupBy(*key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > piece), "hot")
    total = found.agg(F.sum("_rows")).first()[0]
    if total is None:
        discard(found)
        return None
    return found.select(*key), total  # at most total / piece keys


def _window(key: list[str], order: list[str], inclusive: bool):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def segmented(rows: DataFrame, key: list[str], order: list[str], total: int, piece: int) -> DataFrame:
    """``rows`` written once with ``_seg``, the range of (key, order) that a row lies in; equal ones share a segment."""
    parts = max(2, -(-total // piece))
    return cut(rows.repartitionByRange(parts, *key, *order).withColumn("_seg", F.spark_partition_id()), "segments")


def scan(rows: DataFrame, key: list[str], order: list[str], folds: Folds, inclusive: bool = True, piece: int = PIECE) -> DataFrame:
    """``rows`` with a column for each of ``folds``: (max, min, sum or count, of a column) over the key's rows up to this one.

    Not ``inclusive``: before this one, null where there is none. (key, order) must be
    unique; rows of a null key are never dealt to segments.
    """
    plain = lambda df: df.select("*", *(_FOLD[kind](c).over(_window(key, order, inclusive)).alias(name) for name, (kind, c) in folds.items()))
    hot = hot_keys(rows, key, piece)
    if hot is None:
        return plain(rows)
    keys, total = hot
    dealt = segmented(rows.join(keys, key, "left_semi"), key, order, total, piece)
    carried = {name: f"_carry_{name}" for name in folds}
    sums = dealt.groupBy(*key, "_seg").agg(*(_FOLD[kind](c).alias(carried[name]) for name, (kind, c) in folds.items()))
    ahead = _window(key, ["_seg"], False)
    of_sums = {"count": F.sum}
    carries = sums.select(*key, "_seg", *(of_sums.get(kind, _FOLD[kind])(carried[name]).over(ahead).alias(carried[name]) for name, (kind, _) in folds.items()))
    inside = _window([*key, "_seg"], order, inclusive)
    local = dealt.select("*", *(_FOLD[kind](c).over(inside).alias(name) for name, (kind, c) in folds.items())).join(carries, [*key, "_seg"])
    whole = local.select(*rows.columns, *(_joined(kind, F.col(carried[name]), F.col(name)).alias(name) for name, (kind, _) in folds.items()))
    return plain(rows.join(keys, key, "left_anti")).unionByName(whole)
