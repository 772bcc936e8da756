"""Small sample logs against results traced from their definition."""

import shutil

import pytest

from tracewright.api import MinerParameters, ObjectFlowMiner, discover
from tracewright.operators import massbalance, waste
from tracewright.operators.roles import class_histogram, roles
from tracewright.operators.variants import object_instances, second_finals, variant_events
from tracewright.plans import net as nets
from tracewright.sources.builder import LogBuilder
from tracewright.sources.ocel import read_log, write_log

FORMING = {"a": "Fiber", "b": "Resin", "c": "Mold", "d": "Waste", "e": "Product"}
FREIGHT = {"h": "Handling Unit", "c": "Container"}
ONE_TYPE = {"o": "o"}


def forming(fibers="a{k}", degas="Degas"):
    """Injected, degassed, trimmed and packed moulds, ten of them; the first is trimmed twice."""
    steps = []
    for k in range(10, 20):
        steps += [("Inject", f"{fibers.format(k=k) if k == 10 else f'a{k}'} b{k} c{k}"), (degas, f"c{k}"), ("Trim", f"c{k} d{k}_1")]
        steps += [("Trim", f"c{k} d{k}_2")] if k == 10 else []
        steps += [("Pack", f"c{k} e{k}")]
    return steps


def letters(*traces):
    return [(x, f"o{k}") for k, trace in enumerate(traces, 1) for x in trace]


TWICE = [("Inject", "a1 b1 c1"), ("Degas", "c1"), ("Trim", "c1 d1_1"), ("Pack", "c1 e1"), ("Inject", "a2 b2 c2"), ("Trim", "c2 d2_1"), ("Trim", "c2 d2_2"), ("Trim", "c2 d2_3"), ("Pack", "c2 e1 e2")]
MANY = " ".join(f"a{{k}}_{j}" for j in range(1, 6)) + " " + " ".join(f"b{{k}}_{j}" for j in range(1, 4)) + " c{k}"
WIDE = [(a, MANY.format(k=o[1]) if a == "Inject" else o.replace("e1 e2", "e2")) for a, o in TWICE]
SLOW = [("Inject", "a2 b2 c2"), ("Trim", "c2 d2_1"), ("Trim", "c2 d2_2"), ("Trim", "c2 d2_3"), ("Pack", "c2 e2")]
GOODS = [
    ("Collect", "hu1"), ("Order Containers", "c1 c2"), ("Pick Up", "c1"), ("Load", "hu1 c1"), ("Collect", "hu2"), ("Load", "hu2 c1"), ("Drive", "c1"),
    ("Collect", "hu3"), ("Collect", "hu4"), ("Load", "hu3 c2"), ("Drive", "c2"), ("Ship", "c1 c2"),
]
USUAL = {"a": 10, "b": 12, "c": 22, "d": 2, "e": 31}
SECOND = {"b2": 15, "c2": 25, "d2_1": 3, "d2_2": 5}
# name: types, steps, masses by first letter, masses of single objects
LOGS = {
    "running_example": (FORMING, TWICE, USUAL, {**SECOND, "e1": 20, "e2": 35}),
    "motivation_example": (FORMING, TWICE, USUAL, {**SECOND, "a1": 11, "a2": 13, "b2": 14, "e1": 20, "e2": 35}),
    "variable_arcs_example": (FORMING, WIDE, USUAL, {**SECOND, "b2_1": 15, "b2_2": 15, "b2_3": 15}),
    "filtering_edges": ({**FORMING, "c": "Substance"}, SLOW + forming(degas="Stir"), USUAL, {**SECOND, "a17": 300}),
    "filtering_transitions": (FORMING, forming(fibers="a{k}_1 a{k}_2"), USUAL, {"a17": 300}),
    "complex_demonstration_with_error": (FREIGHT, GOODS, {}, {}),
    "simple_parallel": (ONE_TYPE, letters("ABCD", "ACBD"), {}, {}),
    "simple_length_3_other_loop": (ONE_TYPE, letters("ABCDBCDBE"), {}, {}),
    "simple_non_free_choice": (ONE_TYPE, letters("ABCD", "ACBD", "AED"), {}, {}),
    "discussion_example_same_hierarchy": ({"a": "A"}, [("Generate", "a1"), ("Use", "a1"), ("Use", "a1"), ("Consume", "a1")], {}, {}),
}
# name, events by class, roles, variants, raw places, loops, places, silent, arcs, size
TABLE = [
    ("running_example", (1, 0, 0, 0, 1, 2, 5), (8, 8, 4, 1, 4), 5, 13, 1, 7, 1, 15, 28),
    ("variable_arcs_example", (1, 0, 0, 0, 2, 2, 4), (7, 7, 16, 2, 4), 4, 10, 1, 6, 1, 12, 23),
    ("filtering_edges", (10, 0, 0, 0, 11, 11, 14), (35, 35, 22, 11, 14), 4, 10, 1, 6, 1, 12, 23),
    ("filtering_transitions", (10, 0, 0, 0, 10, 10, 11), (31, 31, 21, 10, 11), 5, 13, 1, 6, 0, 13, 24),
    ("complex_demonstration_with_error", (3, 4, 4, 1, 0, 0, 0), (11, 11, 6, 6, 0), 7, 16, 1, 9, 1, 18, 35),
    ("simple_parallel", (4, 2, 2, 0, 0, 0, 0), (6, 6, 2, 2, 0), 4, 8, 0, 8, 6, 20, 38),
    ("simple_length_3_other_loop", (7, 1, 1, 0, 0, 0, 0), (8, 8, 1, 1, 0), 5, 10, 0, 5, 0, 10, 20),
    ("simple_non_free_choice", (5, 3, 3, 0, 0, 0, 0), (8, 8, 3, 3, 0), 5, 10, 0, 8, 6, 22, 41),
    ("discussion_example_same_hierarchy", (2, 1, 1, 0, 0, 0, 0), (3, 3, 1, 1, 0), 3, 6, 1, 3, 0, 6, 12),
]
MFA = {"running_example", "variable_arcs_example", "filtering_edges", "filtering_transitions"}


def sample(spark, name):
    types, steps, masses, single = LOGS[name]
    objects = dict.fromkeys(o for _, named in steps for o in named.split())
    mass = {o: str(single.get(o, masses.get(o[0]))) for o in objects}
    builder = LogBuilder({o: (types[o[0]], {"mass": mass[o]} if masses else {}) for o in objects})
    for k, (activity, named) in enumerate(steps):
        builder.event(f"e{k:02d}", activity, *named.split(), mass={0: "3", 4: "5"}.get(k, "0"))
    return builder.build(spark)


@pytest.mark.parametrize("row", TABLE, ids=lambda r: r[0])
def test_sample_log(spark, row):
    name, classes, role_counts, n_variants, raw, loops, places, silent, arcs, size = row
    log = sample(spark, name)
    got = {r["event_class"]: r["total"] for r in class_histogram(log.relations).groupBy("event_class").sum("n").toDF("event_class", "total").collect()}
    assert tuple(got.get(k, 0) for k in range(7)) == classes
    by_role = {r["role"]: r["count"] for r in roles(log.relations).groupBy("role").count().collect()}
    assert tuple(by_role.get(k, 0) for k in ("input", "output", "initial", "final", "unknown")) == role_counts
    found = discover(log, MinerParameters(calculate_masses=name in MFA))
    assert found.variants.count() == n_variants
    first = nets.raw_places(found.variants, found.associations)
    assert (first.count(), nets.self_loops(first).count()) == (raw, loops)
    assert found.net.places.count() == places
    assert found.net.transitions.where("activity is null").count() == silent
    assert found.net.arcs.count() == arcs
    assert nets.statistics(found.net).first()["total_size"] == size


@pytest.mark.parametrize(("name", "alpha", "beta", "sizes"), [("filtering_edges", 0.0, 0.1, (4, 6, 0, 10, 20)), ("filtering_transitions", 0.1, 0.0, (4, 6, 0, 10, 20)), ("filtering_transitions", 0.1, 0.1, (4, 7, 0, 10, 21))])
def test_filters(spark, name, alpha, beta, sizes):
    found = discover(sample(spark, name), MinerParameters(calculate_masses=True, filter_configurations=alpha, filter_arcs=beta))
    net = found.net
    got = (found.variants.count(), net.places.count(), net.transitions.where("activity is null").count(), net.arcs.count(), nets.statistics(net).first()["total_size"])
    assert got == sizes


@pytest.mark.parametrize(("name", "before", "after"), [("running_example", (47, 35), (47, 47)), ("motivation_example", (50, 35), (50, 47)), ("variable_arcs_example", (181, 62), (181, 74))])
def test_mass_balance(spark, name, before, after):
    log = sample(spark, name)
    found = roles(log.relations)
    assert tuple(massbalance.mass_totals(found, log.masses()).first()) == before
    balance = massbalance.resolve(found, log.masses())
    assert (balance.input_mass, balance.output_mass, balance.verdict) == (*after, {"Waste": "final"})


def test_waste_of_the_running_example(spark):
    log = sample(spark, "running_example")
    balance = massbalance.resolve(roles(log.relations), log.masses())
    events = variant_events(balance.roles)
    one = lambda df: sorted(tuple(map(float, r)) for r in df.drop("variant_id", "role").collect())
    assert one(waste.explicit_waste(events, log.events, "Inject", "mass")) == [(8, 4)]
    assert [one(waste.implicit_count(balance.roles, events, a)) for a in ("Inject", "Degas", "Trim", "Pack")] == [[(2,)], [(0,)], [(-4,)], [(0,), (1,)]]
    assert one(waste.implicit_mass(balance.roles, log.masses(), events, "Trim")) == [(-12, -3)]
    assert one(waste.implicit_mass(balance.roles, log.masses(), events, "Pack")) == [(2, 2), (10, 10)]
    assert one(waste.type_mass(balance.roles, log.masses(), events, "Resin")) == [(27, 13.5, 14)]
    assert tuple(waste.system_count(balance.roles).first()) == (4, 5)
    with pytest.raises(KeyError):
        waste.implicit_count(balance.roles, events, "Nothing")


def test_rounding_follows_the_digits_that_the_source_writes(spark):
    builder = LogBuilder({"a": ("In", {"mass": "13.50"}), "b": ("In", {"mass": "13.51"}), "c": ("In", {"mass": "0.00000049"}), "x": "Out"})
    log = builder.event("1", "Make", "a", "b", "x").event("2", "Use", "x").event("3", "Take", "c", "x").event("4", "End", "x").build(spark)
    found = roles(log.relations, {"In": "initial"})
    got = {r["total"]: r for r in waste.type_mass(found, log.masses(), variant_events(found), "In").collect()}
    assert sorted((float(k), float(r["rounded"])) for k, r in got.items()) == [(4.9e-07, 4.9e-07), (27.01, 13.51)]


def test_second_final_output_is_an_error(spark):
    log = sample(spark, "running_example")
    found = roles(log.relations, {"Product": "final"})
    assert [tuple(r) for r in second_finals(found).collect()] == [("e1", "Product", 2)]
    with pytest.raises(Exception, match="second final output"):
        object_instances(found, variant_events(found)).collect()


@pytest.mark.parametrize("suffix", ["xml", "sqlite", "ocel"])
def test_files_round_trip(spark, tmp_path, suffix):
    log = sample(spark, "running_example")
    path = str(tmp_path / f"log.{suffix}")
    write_log(log, path)
    again = read_log(spark, path)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(log.relations, "eid", "activity", "ts", "oid", "otype", "qualifier") == rows(again.relations, "eid", "activity", "ts", "oid", "otype", "qualifier")
    assert rows(log.objects, "oid", "otype", "attrs") == rows(again.objects, "oid", "otype", "attrs")
    assert rows(log.events, "eid", "activity", "ts", "attrs") == rows(again.events, "eid", "activity", "ts", "attrs")
    shutil.rmtree(tmp_path)


def test_dot_of_all_modes(spark):
    log = sample(spark, "running_example")
    p = MinerParameters(calculate_masses=True, annotate_objects_mass=["Resin"], annotate_implicit_mass=["Trim"], annotate_explicit=["Inject"])
    text = ObjectFlowMiner().annotated_variable_arcs(log, p).dot_str
    assert "Resin mass: avg 14 / total 27" in text and "Implicit mass: avg -3 / total -12" in text and "Explicit mass: avg 4 / total 8" in text
    assert text.count("τ") == 1 and "doubleoctagon" in text
    assert "digraph" in ObjectFlowMiner().weighted_arcs(log).dot_str
