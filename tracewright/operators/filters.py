"""Filters of logs and of variants."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import INPUT, OUTPUT, EventLog
from .components import ship_package

Keep = Callable[[Column, Column], Column]


def above(share: float) -> Keep:
    """Keep what is more than ``share`` of its total; the comparison is strict."""
    return lambda total, count: count > total * F.lit(share)


def drop_object_types(log: EventLog, types: Iterable[str]) -> EventLog:
    """Without objects of some types, and what refers to them; events left without objects go."""
    types = list(types)
    if not types:
        return log
    gone = F.col("otype").isin(types)
    objects, relations = log.objects.where(~gone), log.relations.where(~gone)
    ids = objects.select("oid")
    o2o = log.o2o.join(ids, "oid", "left_semi").join(ids.withColumnRenamed("oid", "oid_2"), "oid_2", "left_semi").select("oid", "oid_2", "qualifier")
    events = log.events.join(relations.select("eid"), "eid", "left_semi")
    return log.replaced(objects=objects, relations=relations, events=events, object_changes=log.object_changes.join(ids, "oid", "left_semi"), o2o=o2o)


def drop_activities(log: EventLog, activities: Iterable[str]) -> EventLog:
    gone = F.col("activity").isin(list(activities))
    return log.replaced(events=log.events.where(~gone), relations=log.relations.where(~gone))


def filter_variants(variants: DataFrame, keep: Keep) -> DataFrame:
    """Variants frequent enough among their activity's events; emptied activities disappear."""
    total = F.sum("n_events").over(Window.partitionBy("activity"))
    return variants.withColumn("_total", total).where(keep(F.col("_total"), F.col("n_events"))).drop("_total")


def filter_associations(assoc: DataFrame, keep: Keep) -> DataFrame:
    """Neighbouring activities frequent enough within their (variant, role, type).

    Only input and output rows are filtered. A group that would lose all its neighbours
    makes the query fail when it runs.
    """
    group = Window.partitionBy("variant_id", "role", "otype")
    rows = assoc.withColumn("_total", F.sum("n").over(group))
    fits = ~F.col("role").isin(INPUT, OUTPUT) | F.coalesce(keep(F.col("_total"), F.col("n")), F.lit(False))
    rows = rows.withColumn("_keep", fits).withColumn("_any", F.max("_keep").over(group))
    emptied = F.concat(F.lit("the filter leaves no activity for "), F.concat_ws(" / ", "variant_id", "role", "otype"))
    checked = F.when(F.col("_any"), F.col("_keep")).otherwise(F.raise_error(emptied).cast("boolean"))
    return rows.where(checked).drop("_total", "_keep", "_any")


def _covering(group: pd.DataFrame) -> pd.DataFrame:
    """(activity, idx, rep): what absorbs each of an activity's variants with the same types.

    The same outcome as :func:`absorb` has, without a list of pairs: a variant is compared only
    with those of no lower sum, as no other can cover it.
    """
    group = group.sort_values("idx", kind="stable")
    many, idx = np.array(group["_many"].tolist(), dtype=np.int64).reshape(len(group), -1), group["idx"].to_numpy()
    size = many.sum(axis=1)
    order = np.argsort(size, kind="stable")
    first = np.searchsorted(size[order], size)  # where sums as large begin

    def above(k: int) -> np.ndarray:
        other = order[first[k] :]
        other = other[(many[other] >= many[k]).all(axis=1)]
        return other[(size[other] > size[k]) | (idx[other] > idx[k])]

    alive = np.array([not len(above(k)) for k in range(len(idx))])
    parent = np.arange(len(idx))
    for k in np.flatnonzero(~alive):
        over = above(k)
        parent[k] = over[(idx[over] > idx[k]) | alive[over]].min()  # rows are in order of idx
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return pd.DataFrame({"activity": group["activity"].to_numpy(), "idx": idx, "rep": idx[parent]})


def keep_general(variants: DataFrame) -> DataFrame:
    """Variants of an activity that no other one covers; what is absorbed adds its count.

    One variant covers another with the same types in each role and no lower
    multiplicity anywhere; unknown roles do not count.
    """
    known = F.filter("signature", lambda s: s["role"] != "unknown")
    rows = variants.withColumn("_types", F.transform(known, lambda s: F.concat_ws(":", s["role"], s["otype"]))).withColumn("_many", F.transform(known, lambda s: s["multiplicity"]))
    place = F.row_number().over(Window.partitionBy("activity").orderBy("first_seq", "first_eid", "variant_id"))
    rows = rows.withColumn("idx", place)
    ship_package(variants.sparkSession)
    target = rows.groupBy("activity", "_types").applyInPandas(_covering, "activity string, idx int, rep int")
    onto = rows.join(target, ["activity", "idx"]).groupBy("activity", F.col("rep").alias("idx")).agg(F.sum("n_events").alias("_sum"))
    return rows.join(onto, ["activity", "idx"]).withColumn("n_events", F.col("_sum")).drop("_types", "_many", "idx", "_sum")
