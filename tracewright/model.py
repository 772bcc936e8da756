"""The event log as five DataFrames, and the names of roles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "eid string, activity string, ts timestamp, attrs map<string,string>, seq long"
OBJECTS = "oid string, otype string, attrs map<string,string>"
RELATIONS = "eid string, activity string, ts timestamp, oid string, otype string, qualifier string, seq long"
CHANGES = "oid string, otype string, ts timestamp, field string, value string, seq long"
O2O = "oid string, oid_2 string, qualifier string"

INPUT, OUTPUT, INITIAL, FINAL, UNKNOWN = "input", "output", "initial", "final", "unknown"
ROLES = (INPUT, OUTPUT, INITIAL, FINAL, UNKNOWN)
INNER = "inner"

MASS = "decimal(38,18)"


@dataclass(frozen=True)
class EventLog:
    """``seq`` is the order of rows in the source; it breaks ties of time."""

    events: DataFrame
    objects: DataFrame
    relations: DataFrame
    object_changes: DataFrame
    o2o: DataFrame

    @staticmethod
    def of(spark: SparkSession, relations: DataFrame, events: DataFrame | None = None, objects: DataFrame | None = None, object_changes: DataFrame | None = None, o2o: DataFrame | None = None) -> EventLog:
        """A log from its relations; what is not given is derived from them or empty."""
        no_attrs = F.lit(None).cast("map<string,string>").alias("attrs")
        if events is None:
            first = F.min_by(F.struct("activity", "ts"), "seq")
            events = relations.groupBy("eid").agg(first.alias("_e"), F.min("seq").alias("seq")).select("eid", "_e.activity", "_e.ts", no_attrs, "seq")
        if objects is None:
            objects = relations.groupBy("oid").agg(F.min_by("otype", "seq").alias("otype")).select("oid", "otype", no_attrs)
        if object_changes is None:
            object_changes = spark.createDataFrame([], CHANGES)
        return EventLog(events, objects, relations, object_changes, o2o if o2o is not None else spark.createDataFrame([], O2O))

    def replaced(self, **frames: DataFrame) -> EventLog:
        return replace(self, **frames)

    def masses(self, attribute: str = "mass") -> DataFrame:
        """oid, otype, the base value of a numeric attribute, and the digits after its point as written (mass_scale)."""
        text = F.col("attrs")[attribute]
        return self.objects.select("oid", "otype", text.cast(MASS).alias("mass"), F.length(F.regexp_extract(text, r"\.(\d+)$", 1)).alias("mass_scale"))

    def summary(self) -> DataFrame:
        """(kind, name, n): totals of events, objects and relations, and counts by activity and type."""
        total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
        by = lambda df, kind, col: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
        parts = [total(self.events, "events"), total(self.objects, "objects"), total(self.relations, "relations"), by(self.events, "activity", "activity"), by(self.objects, "otype", "otype")]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def object_types(self) -> DataFrame:
        return self.objects.select("otype").distinct()
