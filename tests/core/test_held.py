"""Tables that are written between steps, so that the shuffle files behind them can go."""

from tracewright.operators.components import held
from tracewright.operators.conformance import related_objects
from tracewright.sources.starschema import order_log


def test_a_held_table_has_its_rows_and_no_lineage(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id").repartition(3, "k")
    out = held(rows, "rows")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
    assert all(name.endswith(".zstd.parquet") for name in out.inputFiles())
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_start_from_a_held_table(spark):
    found = related_objects(order_log(spark, "/root/testdata/sf0.001"), "order")
    assert any(name.endswith(".zstd.parquet") for name in found.inputFiles())
