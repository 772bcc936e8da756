"""Components of related objects and their cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewright.model import OBJECTS, RELATIONS, EventLog
from tracewright.operators import conformance, scan


def _log(spark, rows, objects):
    relations = spark.createDataFrame([(e, "a", None, o, "t", "q", k) for k, (e, o) in enumerate(rows)], RELATIONS)
    return EventLog.of(spark, relations, objects=spark.createDataFrame([(o, "t", None) for o in objects], OBJECTS))


def _expected(rows, objects):
    root = {o: o for o in objects}
    for _ in objects:
        for e in {e for e, _ in rows}:
            mine = [o for x, o in rows if x == e and o in root]
            for o in mine:
                root[o] = min(root[p] for p in mine)
    return root


def test_related_objects_of_shared_repeated_nameless_and_unused(spark):
    rng = random.Random(5)
    objects = [f"o{k:02d}" for k in range(40)]
    rows = [(rng.choice([*(f"e{k}" for k in range(24)), None]), rng.choice([*objects[:30], "stranger"])) for _ in range(40)]
    rows += [(f"lone{k}", o) for k, o in enumerate(objects[30:36])] + [("lone0", "o31"), ("lone0", "o31")]
    got = conformance.related_objects(_log(spark, rows, objects)).collect()
    assert sorted(map(tuple, got)) == sorted(_expected(rows, objects).items())


def test_events_that_share_no_object_are_not_linked_by_rounds(spark, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("no rounds are needed")

    monkeypatch.setattr(conformance, "connected_components", refused)
    got = conformance.related_objects(_log(spark, [("e", "b"), ("e", "a"), ("f", "c")], ["a", "b", "c", "d"])).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_cases_of_large_components_and_small_ones(spark):
    related = [(f"{c}{k:03d}", f"{c}000") for c, n in (("a", 130), ("b", 7), ("c", 50)) for k in range(n)]
    want = {o: "-".join(p for p, d in related if d == c and (int(p[1:]) // 50) == int(o[1:]) // 50) for o, c in related}
    frame = spark.createDataFrame(related, "oid string, component string")
    for piece in (1000, 60, 20):
        assert {r["oid"]: r["case_id"] for r in conformance.cases(frame, 50, piece).collect()} == want


def test_small_keys_are_not_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(scan, "cut", lambda *a: (_ for _ in ()).throw(AssertionError("a table of counts was written")))
    assert scan.hot_keys(spark.range(5000).select(F.col("id").alias("k")), ["k"], 100) is None
