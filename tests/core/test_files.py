"""Logs as single files: parts of tasks, commits, failures, and filters that reach SQLite."""

import gzip
import os
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, IsNull, Not, StringContains, StringStartsWith

from tracewright.model import EventLog
from tracewright.sources import ocel
from tracewright.sources.files import Part, TablesWriter, TextWriter, local_path
from tracewright.sources.ocel import read_log, write_log

ODD = 'a <b> & "c" \'d\' é 中'


@pytest.fixture(scope="module")
def log(spark):
    at = datetime(2024, 2, 3, 4, 5, 6, 120)
    relations = spark.createDataFrame([(f"e{i}", ODD if i % 2 else "Act", at, f"o{i % 7}", ODD if i % 7 == 3 else "thing", "x" if i % 3 else None, i) for i in range(40)], "eid string, activity string, ts timestamp, oid string, otype string, qualifier string, seq long")
    events = spark.createDataFrame([(f"e{i}", ODD if i % 2 else "Act", at, {"k": ODD, "n": str(i)} if i % 3 else None, i) for i in range(41)], "eid string, activity string, ts timestamp, attrs map<string,string>, seq long")
    objects = spark.createDataFrame([(f"o{i}", ODD if i == 3 else "thing", {"m": f"{i}.50"} if i else {}) for i in range(8)], "oid string, otype string, attrs map<string,string>")
    changes = spark.createDataFrame([("o1", "thing", at, "m", ODD, 1), ("o1", "thing", datetime(2025, 1, 1), "z", "2", 2)], "oid string, otype string, ts timestamp, field string, value string, seq long")
    o2o = spark.createDataFrame([("o1", "o2", ODD), ("o1", "o3", "q")], "oid string, oid_2 string, qualifier string")
    return EventLog.of(spark, relations.repartition(5), events.repartition(5), objects, changes, o2o)


def content(log):
    text = lambda df, *columns: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    pairs = F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))).cast("string")
    return {
        "events": text(log.events, "eid", "activity", "ts", pairs), "objects": text(log.objects, "oid", "otype", pairs), "changes": text(log.object_changes, "oid", "ts", "field", "value"),
        "relations": text(log.relations, "eid", "activity", "oid", "otype", F.coalesce("qualifier", F.lit(""))), "links": text(log.o2o, "oid", "oid_2", "qualifier"),
    }


@pytest.mark.parametrize("suffix", ["xml", "sqlite", "ocel"])
def test_a_log_comes_back_whole_and_in_order(spark, log, tmp_path, suffix):
    path = str(tmp_path / f"log.{suffix}")
    write_log(log, path)
    got = read_log(spark, path)
    want = content(log)
    assert content(got) == want
    assert [r["eid"] for r in got.events.orderBy("seq").collect()] == [f"e{i}" for i in range(41)]
    write_log(log.replaced(relations=log.relations.where("seq < 5")), path)  # a second time, over the first
    assert read_log(spark, path).relations.count() == 5
    assert os.listdir(tmp_path) == [f"log.{suffix}"]  # no parts are left


@pytest.mark.parametrize("suffix", ["xml", "db"])
def test_a_failed_task_leaves_no_file_and_keeps_the_old_one(spark, log, tmp_path, suffix):
    path = str(tmp_path / f"log.{suffix}")
    broken = log.replaced(events=log.events.withColumn("activity", F.when(F.col("seq") == 33, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("activity"))))
    with pytest.raises(Exception, match="broken"):
        write_log(broken, path)
    assert os.listdir(tmp_path) == []
    write_log(log, path)
    before = (tmp_path / f"log.{suffix}").read_bytes()
    with pytest.raises(Exception, match="broken"):
        write_log(broken, path)
    assert os.listdir(tmp_path) == [f"log.{suffix}"] and (tmp_path / f"log.{suffix}").read_bytes() == before


def test_an_empty_log_is_a_file(spark, log, tmp_path):
    none = EventLog(*(getattr(log, k).limit(0) for k in ("events", "objects", "relations", "object_changes", "o2o")))
    write_log(none, str(tmp_path / "none.xml"))
    assert (tmp_path / "none.xml").read_text().count("<events>") == 1
    write_log(none, str(tmp_path / "none.db"))
    with sqlite3.connect(tmp_path / "none.db") as db:
        assert db.execute("SELECT count(*) FROM event").fetchone() == (0,)


@pytest.mark.parametrize("path", ["hdfs://x/y.xml", "s3a://b/k.db", "hdfs:/y.xml"])
def test_paths_that_are_not_mounted_are_errors(path):
    with pytest.raises(ValueError, match="mounted"):
        local_path(path)


def test_filters_reach_the_file(spark, log, tmp_path):
    path = str(tmp_path / "log.db")
    write_log(log, path)
    reader = ocel.FilteringReader({"path": path, "table": "event", "columns": "ocel_id,ocel_type"}, step=4)
    odd = StringContains(("ocel_id",), "1")
    taken = [EqualTo(("ocel_type",), "Act"), Not(In(("ocel_id",), ("e0", "e2"))), IsNotNull(("ocel_id",)), Not(IsNull(("row",))), StringStartsWith(("ocel_id",), "e1")]
    assert list(reader.pushFilters([*taken, odd])) == [odd]
    assert 'CAST("ocel_type" AS TEXT) = ?' in reader.sql("*") and "rowid" in reader.sql("*")
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert [r[1] for r in rows] == ["e10", "e12", "e14", "e16", "e18"] and len(reader.partitions()) <= 3
    plain = read_log(spark, path).relations.where("otype = 'thing' AND eid IN ('e4', 'e5', 'e6')")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        filtered = read_log(spark, path).relations.where("otype = 'thing' AND eid IN ('e4', 'e5', 'e6')")
        same = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
        assert same(filtered) == same(plain) and filtered.count() > 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("kind", ["text", "tables"])
def test_parts_go_as_they_are_copied(tmp_path, monkeypatch, kind):
    writer = TextWriter(str(tmp_path / "whole")) if kind == "text" else TablesWriter(str(tmp_path / "whole"), {"t": ["c"]})
    rows = [("<a/>",), ("é",)] if kind == "text" else [("t", ["<a/>"]), ("t", ["é"])]
    made = iter(range(3))
    monkeypatch.setattr(writer, "_part", lambda: (os.makedirs(writer.folder, exist_ok=True), Part(n := next(made), os.path.join(writer.folder, f"part{n}")))[1])
    parts = [writer.write(iter(rows)) for _ in range(3)]
    left = []
    monkeypatch.setattr(writer, "_finish", lambda path, finish=writer._finish: (left.extend(os.listdir(writer.folder)), finish(path)))
    writer.commit(parts)
    assert left == ["whole"]  # the parts, as large as the file, before
    if kind == "text":
        assert (tmp_path / "whole").read_text(encoding="utf-8") == "<a/>\né\n" * 3
    else:
        with sqlite3.connect(tmp_path / "whole") as db:
            assert [r[0] for r in db.execute("SELECT c FROM t ORDER BY rowid")] == ["<a/>", "é"] * 3


@pytest.mark.parametrize("suffix", ["xml.gz", "ocel.gz"])
def test_a_compressed_log_comes_back_whole_and_stays_small(spark, log, tmp_path, suffix):
    path, plain = str(tmp_path / f"log.{suffix}"), str(tmp_path / "plain.xml")
    write_log(log, path)
    write_log(log, plain)
    got = read_log(spark, path)
    assert content(got) == content(log)
    assert [r["eid"] for r in got.events.orderBy("seq").collect()] == [f"e{i}" for i in range(41)]
    assert gzip.decompress((tmp_path / f"log.{suffix}").read_bytes()) == (tmp_path / "plain.xml").read_bytes()
    assert os.path.getsize(path) * 3 < os.path.getsize(plain)
    with pytest.raises(ValueError, match="no writer"):
        write_log(log, str(tmp_path / "log.db.gz"))
