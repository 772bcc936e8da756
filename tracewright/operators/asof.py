"""Attribute values as of a time.

Probes and changes are merged into one ordered run for each object, and a running
extreme over (source order, value) answers every probe, so no probe is paired with each
change of its object. First and last mean source order (``seq``), not time. Objects and
activities of more than ``piece`` rows are not sorted in one task: their rows are grouped
by time first, and the times scanned in segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MASS
from .scan import PIECE, hot_keys, scan

#: Which changes count, by time against the probe's.
BEFORE, BEFORE_AND_CURRENT, NEXT = "before", "before_and_current", "next"


def base_value(probes: DataFrame, objects: DataFrame, attribute: str) -> DataFrame:
    """The base value, whatever the time."""
    return probes.join(objects.select("oid", F.col("attrs")[attribute].alias("value")), "oid", "left")


def value_as_of(probes: DataFrame, changes: DataFrame, objects: DataFrame, attribute: str, mode: str, piece: int = PIECE) -> DataFrame:
    """probes (oid, ts, ...) with ``value``.

    before: the last change strictly before ts, else the base value; before_and_current:
    the last one up to ts, else the base value; next: the first one strictly after ts,
    else the last change of all, else the base value.
    """
    if mode not in (BEFORE, BEFORE_AND_CURRENT, NEXT):
        raise ValueError(f"unknown mode {mode!r}")
    columns = [c for c in probes.columns if c not in ("oid", "ts")]
    at = F.unix_micros("ts").alias("_at")
    probe = probes.select("oid", "ts", at, F.struct(*columns, F.lit(0)).alias("_probe"))
    change = changes.where(F.col("field") == attribute).select("oid", at, F.struct("seq", "value").alias("_change"))
    hot = hot_keys(probe.select("oid").unionAll(change.select("oid")), ["oid"], piece)
    if hot is None:
        answered = _in_lives(probe, change, mode)
    else:
        few, many = ((probe.join(hot[0], "oid", how), change.join(hot[0], "oid", how)) for how in ("left_anti", "left_semi"))
        answered = _in_lives(*few, mode).unionByName(_in_segments(*many, mode, piece))
    based = base_value(answered, objects, attribute)
    return based.select("oid", "ts", *(F.col(f"_probe.{c}").alias(c) for c in columns), F.coalesce("_found.value", "value").alias("value"))


def _in_lives(probe: DataFrame, change: DataFrame, mode: str) -> DataFrame:
    """(oid, ts, _probe, _found) by a window over each object's probes and changes."""
    both = probe.withColumn("_change", F.lit(None).cast(change.schema["_change"].dataType)).unionByName(change, allowMissingColumns=True)
    life = Window.partitionBy("oid").orderBy("_at")
    if mode == NEXT:
        last = F.max("_change").over(Window.partitionBy("oid"))
        found = F.coalesce(F.min("_change").over(life.rangeBetween(1, Window.unboundedFollowing)), last)
    else:
        found = F.max("_change").over(life.rangeBetween(Window.unboundedPreceding, -1 if mode == BEFORE else 0))
    return both.withColumn("_found", found).where(F.col("_probe").isNotNull()).select("oid", "ts", "_probe", "_found")


def _in_segments(probe: DataFrame, change: DataFrame, mode: str, piece: int) -> DataFrame:
    """The same for objects of any number of rows: what holds at a time is found once for all probes of it."""
    fold = "min" if mode == NEXT else "max"
    none = F.lit(None).cast(change.schema["_change"].dataType).alias("_change")
    times = change.select("oid", "_at", "_change").unionAll(probe.select("oid", "_at", none)).groupBy("oid", "_at").agg((F.min if mode == NEXT else F.max)("_change").alias("_change"))
    times = times.withColumn("_order", -F.col("_at") if mode == NEXT else F.col("_at"))
    found = scan(times, ["oid"], ["_order"], {"_found": (fold, F.col("_change"))}, mode == BEFORE_AND_CURRENT, piece).select("oid", "_at", "_found")
    answered = probe.join(found, ["oid", "_at"])
    if mode == NEXT:
        last = change.groupBy("oid").agg(F.max("_change").alias("_last"))
        answered = answered.join(last, "oid", "left").withColumn("_found", F.coalesce("_found", "_last"))
    return answered.select("oid", "ts", "_probe", "_found")


def previous_event(events: DataFrame, piece: int = PIECE) -> DataFrame:
    """(eid, previous_eid): the last event, in source order, of the same activity strictly before it.

    A log has few activities, so events are first grouped by (activity, time), which a
    third of all rows may share, and only times are put in order.
    """
    rows = events.select("eid", "activity", F.unix_micros("ts").alias("_at"), F.struct("seq", "eid").alias("_event"))
    times = rows.groupBy("activity", "_at").agg(F.max("_event").alias("_event"))
    found = scan(times, ["activity"], ["_at"], {"_before": ("max", F.col("_event"))}, False, piece)
    keyed = rows.select("eid", "activity", "_at").join(found.select("activity", "_at", "_before"), ["activity", "_at"], "left")
    return keyed.select("eid", F.col("_before.eid").alias("previous_eid"))


def effective_time(ts: Column, seconds: Column) -> Column:
    """A time some (fractional) seconds later."""
    return F.timestamp_micros(F.unix_micros(ts) + (seconds.cast("double") * 1_000_000).cast("long"))


def running_balance(base: DataFrame, uses: DataFrame, loss: str = "0.02", piece: int = PIECE) -> DataFrame:
    """Mass left of each object after each use: base less (1 + loss) times the masses used so far.

    base: oid, mass; uses: oid, seq, mass, with one use for each (oid, seq). The query fails
    where a balance is negative.
    """
    used = scan(uses, ["oid"], ["seq"], {"_used": ("sum", _lost(loss))}, True, piece)
    return _left(used.join(base.select("oid", F.col("mass").alias("_base")), "oid")).select("oid", "seq", "mass", "balance")


def balanced(uses: DataFrame, loss: str = "0.02", piece: int = PIECE) -> DataFrame:
    """As :func:`running_balance`, for uses that carry their object's mass as ``_base``: all their columns, and ``balance``."""
    return _left(scan(uses, ["oid"], ["seq"], {"_used": ("sum", _lost(loss))}, True, piece)).drop("_used")


def _lost(loss: str) -> Column:
    return F.col("mass") * (F.lit(1) + F.lit(loss).cast("decimal(10,6)"))


def _left(used: DataFrame) -> DataFrame:
    left = used.withColumn("balance", (F.col("_base") - F.col("_used")).cast(MASS))
    fine = F.when(F.col("balance") < 0, F.raise_error(F.concat(F.lit("negative mass of "), F.col("oid"))).cast("boolean")).otherwise(F.lit(True))
    return left.where(fine)
