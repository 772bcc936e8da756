"""Logs written in Python, for tests and small examples."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from ..model import CHANGES, EVENTS, O2O, OBJECTS, RELATIONS, EventLog


class LogBuilder:
    """Collects events a minute apart over declared objects.

    types: object id to type, or to (type, attributes).
    """

    def __init__(self, types: dict, start: datetime = datetime(1970, 1, 1)) -> None:
        self.objects = {o: (t, {}) if isinstance(t, str) else t for o, t in types.items()}
        self.start, self.events, self.relations, self.changes, self.links = start, [], [], [], []

    def event(self, eid: str, activity: str, *oids: str, minute: float | None = None, qualifier: str = "a", **attrs: str) -> LogBuilder:
        ts = self.start + timedelta(minutes=len(self.events) if minute is None else minute)
        self.events.append((eid, activity, ts, attrs, len(self.events)))
        for oid in oids:
            self.relations.append((eid, activity, ts, oid, self.objects[oid][0], qualifier, len(self.relations)))
        return self

    def change(self, oid: str, field: str, value: str, minute: float) -> LogBuilder:
        self.changes.append((oid, self.objects[oid][0], self.start + timedelta(minutes=minute), field, value, len(self.changes)))
        return self

    def link(self, oid: str, other: str, qualifier: str = "a") -> LogBuilder:
        self.links.append((oid, other, qualifier))
        return self

    def build(self, spark: SparkSession) -> EventLog:
        objects = [(o, t, a) for o, (t, a) in self.objects.items()]
        return EventLog(spark.createDataFrame(self.events, EVENTS), spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(self.relations, RELATIONS), spark.createDataFrame(self.changes, CHANGES), spark.createDataFrame(self.links, O2O))
