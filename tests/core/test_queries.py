"""Registered queries against their SQL at the smallest scale."""

import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tracewright import more_queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["class_histogram", "class_table_users", "roles_hinted", "roles_inner", "variants_weighted", "variant_assoc", "object_instances", "variants_alpha", "assoc_beta", "mfa_verdict", "implicit_mass", "type_mass", "asof_before", "asof_next", "prev_same_activity", "running_balance", "net_self_loops", "related_objects"]
MORE = ["prep_output_less_waste", "prep_split_waste_objects", "prep_split_waste_links", "prep_renamed", "implicit_mass_as_of", "flag_net_silent", "flag_fitness", "conformance_report", "labels_content", "file_xml", "file_sqlite", "net_drawing", "annotated_net", "roles_first_row", "prep_outputs_chained", "base_masses", "fitness"]
ROWS_ONLY = ["keep_general", "net_arcs", "net_stats", "case_ids", "group_markings"]


def plain(rows, columns):
    def value(x):
        return round(float(x), 6) if isinstance(x, float | Decimal) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", SAMPLE + MORE)
def test_query_equals_sql(spark, db, name):
    got, want = core.QUERIES[name](spark, FOLDER), db.sql(core.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert core.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_names_agree(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["transition", "place", "direction", "multiplicity"]


def test_the_engine_does_not_need_the_llm_folder():
    root = Path(__file__).resolve().parent.parent.parent
    code = "import sys; import tracewright.more_queries, tracewright.api; sys.exit(any(m.startswith('tracewright.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
