"""Drawings, colours, and places that contain each other."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tracewright.functions.scalar import contrast, shown, shown_text
from tracewright.plans import net as nets
from tracewright.plans import render


def test_numbers_are_shown_without_empty_digits(spark):
    rng = random.Random(3)
    numbers = [Decimal(rng.randrange(-10**6, 10**6)).scaleb(-rng.randrange(9)) for _ in range(60)] + [Decimal("0"), Decimal("100"), Decimal("0.50"), Decimal("1E-9")]
    rows = spark.createDataFrame([(n,) for n in numbers], "n decimal(38,18)").select("n", shown_text(F.col("n")).alias("t"), shown_text(F.floor("n").cast("long")).alias("i")).collect()
    assert all(r["t"] == shown(r["n"]) for r in rows) and {r["t"] for r in rows} >= {"0", "100", "0.5"} and all("." not in r["i"] for r in rows)


def test_colours_are_dealt_by_first_appearance():
    got = render.colours(["zebra", "Truck", "ape", "zebra", *(f"t{i}" for i in range(12))])
    assert got["zebra"] == render.PALETTE[0] and got["ape"] == render.PALETTE[1] and got["Truck"] == "#ff0000"
    assert got["t7"] == render.PALETTE[9] and got["t8"] not in render.PALETTE and len(set(got.values())) >= 14


def test_ink_follows_the_rule():
    rng = random.Random(1)
    for _ in range(500):
        r, g, b = (rng.randrange(256) for _ in range(3))
        one = lambda c: (c / 255) ** 2.4 if c / 255 > 0.03928 else c / 255 / 12.92
        lit = 0.2126 * one(r) + 0.7152 * one(g) + 0.0722 * one(b) + 0.05
        assert contrast(r, g, b) == ("#000000" if lit * lit > 1.05 * 0.05 else "#ffffff")


def frame(spark, rows):
    return spark.createDataFrame([(i, "t", False, False, bool(k), ins, outs) for i, (k, ins, outs) in enumerate(rows)], "idx int, otype string, is_initial boolean, is_final boolean, is_unknown boolean, ins array<string>, outs array<string>")


def test_containments_equal_all_pairs(spark):
    rng = random.Random(2)
    some = lambda: sorted(rng.sample("abcde", rng.randrange(4)))
    rows = [(rng.randrange(2), some(), some()) for _ in range(120)] + [(0, [], []), (0, [], []), (1, ["a"], ["b"])]
    got = sorted(map(tuple, nets.containments(frame(spark, rows)).collect()))
    want = []
    for p, (k, i, o) in enumerate(rows):
        for q, (kq, iq, oq) in enumerate(rows):
            if p != q and k == kq and set(i) <= set(iq) and set(o) <= set(oq):
                want.append((p, q, set(i) == set(iq) and set(o) == set(oq)))
    assert got == sorted(want) and len(want) > 200


def test_only_places_that_share_a_rare_neighbour_are_compared(spark):
    rows = [(0, [f"a{i}", "common"], [f"b{i}"]) for i in range(2000)] + [(0, [f"a{i}"], []) for i in range(0, 2000, 2)]
    found = nets.containments(frame(spark, rows))
    joins = [m for m in found._jdf.queryExecution().toString().split("\n") if "CartesianProduct" in m or "BroadcastNestedLoop" in m]
    assert found.count() == 1000 and not joins
    one = frame(spark, rows).select("idx", F.explode("ins").alias("at"))
    often = one.groupBy("at").count()
    rarest = one.join(often, "at").groupBy("idx").agg(F.min_by("at", F.struct("count", "at")).alias("at"))
    assert rarest.join(one.withColumnRenamed("idx", "q"), "at").count() < 3 * len(rows)  # candidates, of 9 million pairs


def test_a_drawing_says_what_dot_does(spark):
    places = spark.createDataFrame([(1, "A", [], ["x"], True, False, False, 1), (2, "B", ["x"], ["x"], False, False, True, 1), (3, "A", ["x"], [], False, True, False, 1)], "place int, otype string, ins array<string>, outs array<string>, is_initial boolean, is_final boolean, is_unknown boolean, n long")
    transitions = spark.createDataFrame([("x#1", "x", 4), ("silent#1#2", None, 0)], "transition string, activity string, n long")
    arcs = spark.createDataFrame([("x#1", 1, "in", 2), ("x#1", 3, "out", 1), ("silent#1#2", 2, "in", 1)], "transition string, place int, direction string, multiplicity int")
    net = nets.FlowNet(places, transitions, arcs)
    rows = {(r["kind"], r["place"], r["transition"]): r for r in render.drawing(net).collect()}
    assert rows["place", 1, None]["shape"] == "octagon" and rows["place", 3, None]["shape"] == "doubleoctagon" and rows["place", 2, None]["shape"] == "circle"
    assert rows["arc", 1, "x#1"]["width"] == 4.0 and rows["arc", 2, "silent#1#2"]["style"] == "dashed" and rows["place", 2, None]["colour"] == render.PALETTE[1]
    assert {r["label"] for r in render.drawing(net, weighted=True).where("kind = 'arc'").collect()} == {"2", None}
    text = render.dot(net, notes={"x#1": ["<3>"]})
    assert "penwidth=4.0" in text and "style=dashed, dir=both" in text and "x<BR/>&lt;3&gt;" in text and "τ" in text
    assert render.drawing(nets.FlowNet(places.limit(0), transitions.limit(0), arcs.limit(0))).count() == 0
