"""Objects that are initial and final in one event, which the larger tables hold."""

import pytest

from tracewright.operators import roles as role_ops
from tracewright.operators import variants, waste
from tracewright.sources.builder import LogBuilder


@pytest.fixture(scope="module")
def lone(spark):
    """One event that is the whole life of an order and two items."""
    types = {"o": ("order", {"mass": "7.00"}), "i": ("item", {"mass": "2.00"}), "j": ("item", {"mass": "3.00"})}
    log = LogBuilder(types).event("S", "Ship", "o", "i", "j").build(spark)
    found = role_ops.roles(log.relations)
    return log, found, variants.variant_events(found)


def test_type_count_has_a_row_for_each_side(lone):
    _, found, events = lone
    rows = waste.type_count(found, events, "item", check=False).collect()
    assert sorted((r["role"], r["total"]) for r in rows) == [("final", 2), ("initial", 2)]
    with pytest.raises(Exception, match="both roles occur in"):
        waste.type_count(found, events, "item").collect()


def test_type_mass_has_a_row_for_each_side(lone):
    log, found, events = lone
    rows = waste.type_mass(found, log.masses(), events, "item", check=False).collect()
    assert sorted((r["role"], float(r["total"]), float(r["average"])) for r in rows) == [("final", 5.0, 2.5), ("initial", 5.0, 2.5)]


def test_annotations_have_a_line_for_each_side(lone):
    from tracewright.api import MinerParameters, annotations, discover

    log, wanted = lone[0], MinerParameters(annotate_objects_count=["item"])
    rows = annotations(log, discover(log, wanted), wanted, check=False).collect()
    assert [r["line"] for r in rows] == ["item: 2", "item: 2"] and len({r["place"] for r in rows}) == 2
