"""What the roles cost: a shuffle by object and one by event, and nothing joined."""

from tracewright.operators import roles as role_ops
from tracewright.operators import variants
from tracewright.sources.builder import LogBuilder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_take_two_shuffles(spark):
    log = LogBuilder({"o": "order", "i": "item"}).event("P", "Place", "o").event("S", "Ship", "o", "i").build(spark)
    found = variants.variant_events(role_ops.roles(log.relations))
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text
    assert found.count() == 2
