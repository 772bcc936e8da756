"""Running folds over keys of any size: one key holds half of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import asof, conformance, scan
from tracewright.operators import roles as role_ops


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if i % 2 else f"k{rng.randrange(40)}", i, rng.choice([None, *range(50)])) for i in range(3000)] + [(None, i, 1) for i in range(30)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o long, v long").repartition(4).cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("inclusive", [True, False])
def test_folds_equal_windows(rows, inclusive):
    over = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    v = F.col("v")
    want = rows.select("*", F.max(v).over(over).alias("a"), F.min(F.struct("v", "o")).over(over).alias("b"), F.sum(v).over(over).alias("c"), F.count(v).over(over).alias("d"))
    folds = {"a": ("max", v), "b": ("min", F.struct("v", "o")), "c": ("sum", v), "d": ("count", v)}
    for piece in (100, 10_000):
        got = scan.scan(rows, ["k"], ["o"], folds, inclusive, piece)
        if piece == 100 and not inclusive:  # a count of nothing is null where no segment comes before
            got, want = got.withColumn("d", F.coalesce("d", F.lit(0))), want
        assert same(got, want)


def test_no_segment_holds_a_whole_key(rows):
    keys, total = scan.hot_keys(rows, ["k"], 100)
    assert [r["k"] for r in keys.collect()] == ["hot"] and total == 1500
    dealt = scan.segmented(rows.where("k = 'hot'"), ["k"], ["o"], total, 100)
    sizes = [r["n"] for r in dealt.groupBy("_seg").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 10 and max(sizes) <= 300
    assert scan.hot_keys(rows, ["k"], 10_000) is None


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    ts = lambda: rng.randrange(400)
    relations = [(f"e{i}", rng.choice(["A", "A", "A", "B", "C"]), ts(), "o0" if i % 2 else f"o{rng.randrange(30)}", "t", "q", i) for i in range(1200)]
    frame = spark.createDataFrame(relations, "eid string, activity string, at long, oid string, otype string, qualifier string, seq long")
    return frame.select("eid", "activity", F.timestamp_seconds("at").alias("ts"), "oid", "otype", "qualifier", "seq").cache()


def test_previous_events_as_by_one_window(log):
    over = Window.partitionBy("activity").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    want = log.select("eid", F.max(F.struct("seq", "eid")).over(over)["eid"].alias("previous_eid"))
    assert same(asof.previous_event(log, piece=40), want) and same(asof.previous_event(log), want)


@pytest.mark.parametrize("mode", [asof.BEFORE, asof.BEFORE_AND_CURRENT, asof.NEXT])
def test_values_as_of_do_not_depend_on_segments(spark, log, mode):
    changes = log.where("seq % 3 = 0").select("oid", "ts", F.lit("m").alias("field"), F.col("seq").cast("string").alias("value"), "seq")
    objects = log.select("oid").distinct().withColumn("attrs", F.create_map(F.lit("m"), F.concat(F.lit("base "), "oid")))
    probes = log.where("seq % 3 > 0").select("oid", "ts", "eid")
    got = [asof.value_as_of(probes, changes, objects, "m", mode, piece) for piece in (50, 10_000)]
    assert same(*got)
    held = {(c["oid"], c["ts"], c["seq"]): c["value"] for c in changes.collect()}
    for r in random.Random(1).sample(got[0].collect(), 60):
        own = [(t, s, v) for (o, t, s), v in held.items() if o == r["oid"]]
        fits = [(s, v) for t, s, v in own if (t < r["ts"] if mode == asof.BEFORE else t <= r["ts"] if mode == asof.BEFORE_AND_CURRENT else t > r["ts"])]
        pick = min(fits) if mode == asof.NEXT and fits else max(fits) if fits else max((s, v) for _, s, v in own) if mode == asof.NEXT and own else (0, f"base {r['oid']}")
        assert r["value"] == pick[1]


def test_roles_do_not_depend_on_segments(log):
    assert same(role_ops.roles(log, piece=50), role_ops.roles(log))
    assert same(role_ops.roles(log, {"t": "inner"}, piece=50), role_ops.roles(log, {"t": "inner"}))


def test_balances_and_cases_do_not_depend_on_segments(spark, log):
    uses = log.select("oid", "seq", F.lit(1).cast("decimal(18,2)").alias("mass"))
    base = log.select("oid").distinct().withColumn("mass", F.lit(10_000).cast("decimal(18,2)"))
    assert same(asof.running_balance(base, uses, piece=50), asof.running_balance(base, uses))
    related = spark.createDataFrame([(f"x{i:04}", "big" if i % 2 else f"c{i % 20}") for i in range(900)], "oid string, component string")
    assert same(conformance.cases(related, piece=60), conformance.cases(related))
    assert conformance.cases(related, piece=60).groupBy("case_id").count().agg(F.max("count")).first()[0] == conformance.CHUNK
