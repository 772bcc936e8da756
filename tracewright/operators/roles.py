"""The role of every object in every event.

An object is used before an event if its first relation is earlier, and after it if its
last one is later. An event's class is the first of these that holds for all its objects
(hinted types aside): 0 before and after, 1 before, 2 after, 3 neither, 4 not after,
5 not before, else 6.

Two shuffles carry the work: by object (first and last time, previous and next activity)
and by event (class). An object's first and last times are taken where its rows lie anyway,
so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FINAL, INITIAL, INNER, INPUT, OUTPUT, UNKNOWN
from .scan import hot_keys, segmented

Hints = Mapping[str, str]


def _hinted(hints: Hints, *, inner: bool) -> Column:
    types = [t for t, role in hints.items() if (role == INNER) == inner]
    return F.col("otype").isin(types) if types else F.lit(False)


def _neighbours(relations: DataFrame, piece: int | None) -> DataFrame:
    """Relations with the activities before and after in their objects' lives, and the lives' first and last times.

    With ``piece``, objects of more rows are walked in segments: what stands first and last
    in a segment is handed to its neighbours.
    """
    life = Window.partitionBy("oid").orderBy("ts", "seq", "eid")
    whole = life.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of the same sort
    beside = lambda df: df.select("*", F.lag("activity").over(life).alias("previous"), F.lead("activity").over(life).alias("next"), F.min("ts").over(whole).alias("first_ts"), F.max("ts").over(whole).alias("last_ts"))
    hot = None if piece is None else hot_keys(relations, ["oid"], piece)
    if hot is None:
        return beside(relations)
    keys, total = hot
    dealt = segmented(relations.join(keys, "oid", "left_semi"), ["oid"], ["ts", "seq", "eid"], total, piece)
    order = F.struct("ts", "seq", "eid")
    ends = dealt.groupBy("oid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    edges = dealt.groupBy("oid", "_seg").agg(F.min_by("activity", order).alias("_first"), F.max_by("activity", order).alias("_last"))
    along = Window.partitionBy("oid").orderBy("_seg")
    edges = edges.select("oid", "_seg", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    inside = Window.partitionBy("oid", "_seg").orderBy("ts", "seq", "eid")
    nth, left = F.row_number().over(inside), F.row_number().over(Window.partitionBy("oid", "_seg").orderBy(F.desc("ts"), F.desc("seq"), F.desc("eid")))
    rows = dealt.withColumn("_nth", nth).withColumn("_left", left).withColumn("previous", F.lag("activity").over(inside)).withColumn("next", F.lead("activity").over(inside)).join(edges, ["oid", "_seg"]).join(ends, "oid")
    rows = rows.withColumn("previous", F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("previous"))).withColumn("next", F.when(F.col("_left") == 1, F.col("_after")).otherwise(F.col("next")))
    return beside(relations.join(keys, "oid", "left_anti")).unionByName(rows.select(*relations.columns, "previous", "next", "first_ts", "last_ts"))


def object_use(relations: DataFrame, hints: Hints | None = None, piece: int | None = None, only: str | None = None) -> DataFrame:
    """Relations with before, after, previous, next, event_class, and whether hinted; an object's repeats in an event only if hinted."""
    hints = hints or {}
    relations = relations.where("oid is not null")
    if only is not None:
        types = [r["otype"] for r in relations.where(F.col("activity") == only).select("otype").distinct().collect()]  # as many as the model has
        relations = relations.where(F.col("otype").isin([t for t in types if t is not None]) | (F.col("otype").isNull() if None in types else F.lit(False)))
    rows = _neighbours(relations, piece)
    rows = rows if only is None else rows.where(F.col("activity") == only)
    rows = rows.withColumn("hinted", _hinted(hints, inner=False))
    order = Window.partitionBy("eid").orderBy("oid", "seq", "qualifier")
    event = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of the same sort, so events are walked once
    again = F.coalesce(F.lag("oid").over(order) == F.col("oid"), F.lit(False)).alias("_again")
    head = F.min_by(F.struct("activity", "ts", "seq"), F.struct("seq", "oid", "qualifier")).over(event).alias("_head")
    of = lambda f, c: f(F.when(~F.col("hinted"), F.col(c))).over(event)
    spans = of(F.min, "first_ts").alias("_f0"), of(F.max, "first_ts").alias("_f1"), of(F.min, "last_ts").alias("_l0"), of(F.max, "last_ts").alias("_l1")
    rows = rows.select("*", again, head, *spans)
    rows = rows.withColumn("activity", F.col("_head.activity")).withColumn("ts", F.col("_head.ts")).withColumn("event_seq", F.col("_head.seq"))
    rows = rows.withColumn("before", F.col("first_ts") < F.col("ts")).withColumn("after", F.col("ts") < F.col("last_ts"))
    rows = rows.withColumn("event_class", _class().cast("int"))
    return rows.where("not _again or hinted").drop("_head", "_again", "_f0", "_f1", "_l0", "_l1")


def _class() -> Column:
    """An event's class by the extremes of its free objects' first and last times; without a time, nothing speaks against 0."""
    ts = F.col("ts")
    before, after, not_before, not_after = F.col("_f1") < ts, ts < F.col("_l0"), F.col("_f0") >= ts, F.col("_l1") <= ts
    return F.when(F.col("_f1").isNull() | ts.isNull() | before & after, 0).when(before, 1).when(after, 2).when(not_before & not_after, 3).when(not_after, 4).when(not_before, 5).otherwise(6)


def event_classes(relations: DataFrame, hints: Hints | None = None) -> DataFrame:
    """(eid, activity, ts, event_class) of every event.

    The extremes of its objects' first and last times decide an event's class, so two
    grouped aggregates do, and no object's rows are sorted.
    """
    ends = relations.groupBy("oid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    free = ~_hinted(hints or {}, inner=False)
    of = lambda f, c: f(F.when(free, F.col(c)))
    head = F.min_by(F.struct("activity", "ts"), F.struct("seq", "oid")).alias("_head")
    spans = of(F.min, "first_ts").alias("_f0"), of(F.max, "first_ts").alias("_f1"), of(F.min, "last_ts").alias("_l0"), of(F.max, "last_ts").alias("_l1")
    rows = relations.join(ends, "oid").groupBy("eid").agg(head, *spans).select("eid", "_head.activity", "_head.ts", "_f0", "_f1", "_l0", "_l1")
    return rows.select("eid", "activity", "ts", _class().cast("int").alias("event_class"))


def class_histogram(relations: DataFrame, hints: Hints | None = None) -> DataFrame:
    """Events by activity and class."""
    return event_classes(relations, hints).groupBy("activity", "event_class").agg(F.count("*").alias("n"))


def class_table(relations: DataFrame, hints: Hints | None = None) -> DataFrame:
    """One row an activity, a column c0 to c6 for each class."""
    wide = event_classes(relations, hints).groupBy("activity").pivot("event_class", list(range(7))).count()
    return wide.select("activity", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"c{k}") for k in range(7)))


def roles(relations: DataFrame, hints: Hints | None = None, piece: int | None = None, only: str | None = None) -> DataFrame:
    """(eid, activity, ts_sec, event_seq, event_class, role, otype, oid, adj_activity), one row an entry.

    ``piece``: rows of an object that one task may sort; None: any number, which spares a count.
    ``only``: the roles of one activity's events; lives are those of the objects of its types, and
    other events are not shuffled. An event's rows must name one activity then, an object's one type.
    """
    hints = hints or {}
    use = object_use(relations, hints, piece, only)
    b, a, k, free = F.col("before"), F.col("after"), F.col("event_class"), ~F.col("hinted")
    inner = _hinted(hints, inner=True)
    entries = [
        (INPUT, free & b),
        (OUTPUT, free & a),
        (INITIAL, free & ~inner & ~b & ((k == 2) | ~a & k.isin(3, 5))),
        (FINAL, free & ~inner & ~a & ((k == 1) | ~b & k.isin(3, 4))),
        (UNKNOWN, free & ~a & ~b & (k == 6)),
    ]
    entries += [(role, F.col("otype") == otype) for otype, role in hints.items() if role != INNER]
    use = use.withColumn("role", F.explode(F.array(*(F.when(when, F.lit(role)) for role, when in entries)))).where("role is not null")
    near = F.when(F.col("hinted"), None).when(F.col("role") == INPUT, F.col("previous")).when(F.col("role") == OUTPUT, F.col("next"))
    return use.select("eid", "activity", F.unix_seconds("ts").alias("ts_sec"), "event_seq", "event_class", "role", "otype", "oid", near.alias("adj_activity"))


def labels_json(role_rows: DataFrame) -> DataFrame:
    """(eid, label): each event's roles as one JSON document."""
    entry = F.struct("otype", "oid", "adj_activity")
    lists = [F.array_sort(F.collect_list(F.when(F.col("role") == r, entry))).alias(r) for r in (INPUT, OUTPUT, INITIAL, FINAL, UNKNOWN)]
    events = role_rows.groupBy("eid").agg(F.first("activity").alias("activity"), F.first("ts_sec").alias("timestamp"), F.first("event_class").alias("type"), *lists)
    return events.select("eid", F.to_json(F.struct("type", "activity", "timestamp", INPUT, OUTPUT, INITIAL, FINAL, UNKNOWN)).alias("label"))
