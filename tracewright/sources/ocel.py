"""OCEL 2.0 files: XML and SQLite, read into and written from event logs."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith

from ..model import EventLog
from ..operators.components import ship_package
from .files import TablesFile, TextFile, local_path

_TIMED = "array<struct<_VALUE:string,_name:string,_time:string>>"
_OBJECT = f"_id string, _type string, attributes struct<attribute:{_TIMED}>, objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"
_EVENT = "_id string, _type string, _time string, attributes struct<attribute:array<struct<_VALUE:string,_name:string>>>, objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"


def _suffix(path: str) -> str:
    return path.removesuffix(".gz").rsplit(".", 1)[-1].lower()


def read_log(spark: SparkSession, path: str) -> EventLog:
    """Read by suffix: .xml, .xmlocel; .sqlite, .db; .ocel is either, by its first line. XML may end in .gz too."""
    suffix = _suffix(path)
    if suffix == "ocel":
        first = spark.read.text(path).first()
        suffix = "sqlite" if first is not None and first[0].startswith("SQLite format 3") else "xml"
    if suffix in ("xml", "xmlocel"):
        return read_xml(spark, path)
    if suffix in ("sqlite", "db") and not path.endswith(".gz"):
        return read_sqlite(spark, path)
    raise ValueError(f"no reader for {path!r}")


def write_log(log: EventLog, path: str) -> None:
    """Write by suffix, as :func:`read_log` reads; .ocel is written as XML."""
    suffix = _suffix(path)
    if suffix in ("xml", "xmlocel", "ocel"):
        write_xml(log, path)
    elif suffix in ("sqlite", "db") and not path.endswith(".gz"):
        write_sqlite(log, path)
    else:
        raise ValueError(f"no writer for {path!r}")


def _numbered(df: DataFrame) -> DataFrame:
    """File order: ids rise within a partition, and partitions follow the file."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _log(spark: SparkSession, events: DataFrame, objects: DataFrame, relations: DataFrame, changes: DataFrame, o2o: DataFrame) -> EventLog:
    """Relations (eid, oid, qualifier, seq) get the activity and time of their event and the type of their object."""
    relations = relations.join(events.select("eid", "activity", "ts"), "eid").join(objects.select("oid", "otype"), "oid")
    relations = relations.select("eid", "activity", "ts", "oid", "otype", "qualifier", "seq")
    return EventLog(events, objects, relations, changes, o2o)


def read_xml(spark: SparkSession, path: str) -> EventLog:
    read = lambda tag, schema: _numbered(spark.read.format("xml").option("rowTag", tag).schema(schema).load(path))
    raw_objects, raw_events = read("object", _OBJECT), read("event", _EVENT)
    attr = F.coalesce("attributes.attribute", F.array().cast(_TIMED))
    stamped = F.transform(attr, lambda a: F.struct(a["_name"].alias("name"), a["_VALUE"].alias("value"), F.coalesce(F.to_timestamp(a["_time"]), F.timestamp_seconds(F.lit(0))).alias("ts")))
    objects = raw_objects.select(F.col("_id").alias("oid"), F.col("_type").alias("otype"), stamped.alias("a"), "seq", "objects")
    is_base = lambda a: a["ts"] == F.timestamp_seconds(F.lit(0))
    base = F.map_from_entries(F.transform(F.filter("a", is_base), lambda a: F.struct(a["name"], a["value"])))
    changes = objects.select("oid", "otype", F.explode(F.filter("a", lambda a: ~is_base(a)))).select("oid", "otype", "col.ts", F.col("col.name").alias("field"), "col.value")
    changes = _numbered(changes)
    o2o = objects.select("oid", F.explode("objects.relationship").alias("r")).select("oid", F.col("r._object-id").alias("oid_2"), F.col("r._qualifier").alias("qualifier"))
    values = F.map_from_entries(F.transform(F.coalesce("attributes.attribute", F.array().cast("array<struct<_VALUE:string,_name:string>>")), lambda a: F.struct(a["_name"], a["_VALUE"])))
    events = raw_events.select(F.col("_id").alias("eid"), F.col("_type").alias("activity"), F.to_timestamp("_time").alias("ts"), values.alias("attrs"), "seq")
    relations = raw_events.select(F.col("_id").alias("eid"), F.explode("objects.relationship").alias("r")).select("eid", F.col("r._object-id").alias("oid"), F.col("r._qualifier").alias("qualifier"))
    relations = _numbered(relations)
    return _log(spark, events, objects.select("oid", "otype", base.alias("attrs")), relations, changes, o2o)


def _stamp(ts: Column) -> Column:
    """Seconds, and microseconds where there are any."""
    part = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(F.pmod(part, F.lit(1_000_000)).cast("string"), 6, "0"))))


def _text(value: Column) -> Column:
    """Escaped for an element or a quoted attribute."""
    out = F.coalesce(value, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _attributes(entries: Column, time: Column | None = None) -> Column:
    """attribute elements of an array of (key, value) structs, or of (key, value, time)."""
    at = lambda e: F.concat(F.lit('" time="'), e["time"] if time is None else time) if time is not None or timed else F.lit("")
    timed = time is None
    one = lambda e: F.concat(F.lit('<attribute name="'), _text(e["key"]), at(e), F.lit('">'), _text(e["value"]), F.lit("</attribute>"))
    return F.array_join(F.transform(entries, one), "")


def _sorted_entries(attrs: str) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(attrs, F.create_map().cast("map<string,string>"))))


def _links(links: Column, oid: str) -> Column:
    one = lambda x: F.concat(F.lit('<relationship object-id="'), _text(x[oid]), F.lit('" qualifier="'), _text(x["qualifier"]), F.lit('"/>'))
    return F.array_join(F.transform(F.coalesce(links, F.array()), one), "")


def write_xml(log: EventLog, path: str) -> None:
    """One file with the four sections, its lines made and ordered by Spark."""
    spark = log.events.sparkSession
    ship_package(spark)
    spark.dataSource.register(TextFile)
    line = lambda df, section, place, text, seq=F.lit(0), key=F.lit(""): df.select(F.lit(section).alias("section"), F.lit(place).alias("place"), seq.cast("long").alias("at"), key.alias("key"), text.alias("text"))
    sections = ("object-types", "event-types", "objects", "events")
    frame = [(k, place, f"  <{'/' if place else ''}{name}>") for k, name in enumerate(sections) for place in (0, 2)]
    frame = [(-1, 0, "<?xml version='1.0' encoding='UTF-8'?>\n<log>"), *frame, (len(sections), 0, "</log>")]
    parts = [spark.createDataFrame([(s, p, 0, "", t) for s, p, t in frame], "section int, place int, at long, key string, text string")]
    for k, (tag, df, col) in enumerate((("object-type", log.objects, "otype"), ("event-type", log.events, "activity"))):
        named = df.select(col, F.explode_outer(F.map_keys("attrs")).alias("name")).groupBy(col).agg(F.array_sort(F.collect_set("name")).alias("names"))
        inner = F.array_join(F.transform("names", lambda n: F.concat(F.lit('<attribute name="'), _text(n), F.lit('" type="string"/>'))), "")
        parts.append(line(named, k, 1, F.concat(F.lit(f'    <{tag} name="'), _text(F.col(col)), F.lit('"><attributes>'), inner, F.lit(f"</attributes></{tag}>")), key=F.col(col)))
    changed = log.object_changes.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("field").alias("key"), F.concat(_stamp(F.col("ts")), F.lit("Z")).alias("time"), "value"))).alias("changes"))
    linked = log.o2o.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("oid_2", "qualifier"))).alias("links"))
    rows = log.objects.join(changed, "oid", "left").join(linked, "oid", "left")
    values = F.concat(_attributes(_sorted_entries("attrs"), F.lit("1970-01-01T00:00:00Z")), F.coalesce(_attributes(F.col("changes")), F.lit("")))
    links = F.when(F.col("links").isNull(), "").otherwise(F.concat(F.lit("<objects>"), _links(F.col("links"), "oid_2"), F.lit("</objects>")))
    parts.append(line(rows, 2, 1, F.concat(F.lit('    <object id="'), _text(F.col("oid")), F.lit('" type="'), _text(F.col("otype")), F.lit('"><attributes>'), values, F.lit("</attributes>"), links, F.lit("</object>")), key=F.col("oid")))
    related = log.relations.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("seq", "oid", "qualifier"))).alias("related"))
    values = F.array_join(F.transform(_sorted_entries("attrs"), lambda e: F.concat(F.lit('<attribute name="'), _text(e["key"]), F.lit('">'), _text(e["value"]), F.lit("</attribute>"))), "")
    event = F.concat(F.lit('    <event id="'), _text(F.col("eid")), F.lit('" type="'), _text(F.col("activity")), F.lit('" time="'), _stamp(F.col("ts")), F.lit('"><attributes>'), values, F.lit("</attributes><objects>"), _links(F.col("related"), "oid"), F.lit("</objects></event>"))
    parts.append(line(log.events.join(related, "eid", "left"), 3, 1, event, F.coalesce("seq", F.lit(0)), F.col("eid")))
    order = ("section", "place", "at", "key")
    lines = reduce(DataFrame.unionAll, parts).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("text").write.format("one_text_file").option("path", path).mode("overwrite").save()


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__(None)
        self.low, self.high = low, high


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    """Reads some columns of one table in ranges of rowids; every reader opens the file itself."""

    def __init__(self, options: dict, step: int = 200_000) -> None:
        self.path, self.table, self.columns = options["path"], options["table"], options["columns"].split(",")
        self.step = step
        self.where: list[str] = []
        self.values: list = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def sql(self, columns: str, *more: str) -> str:
        tests = [*more, *self.where]
        return f'SELECT {columns} FROM "{self.table}"' + (f" WHERE {' AND '.join(tests)}" if tests else "")

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(self.sql("min(rowid), max(rowid)"), self.values).fetchone()
        return [_Range(a, min(a + self.step, high + 1)) for a in range(low, high + 1, self.step)] if low is not None else [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(["rowid", *(f'CAST("{c}" AS TEXT)' for c in self.columns)])
        with self._open() as db:
            yield from db.execute(self.sql(columns, "rowid >= ?", "rowid < ?") + " ORDER BY rowid", (partition.low, partition.high, *self.values))


class FilteringReader(SqliteReader):
    """Filters go into the SQL: values are compared as the text that is read, ``row`` as a number, which also narrows the ranges.

    Spark refuses such a reader unless ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Those that SQLite answers as Spark would are taken; the others are Spark's."""
        for one in filters:
            if not self._take(one):
                yield one

    def _take(self, one: Filter) -> bool:
        inner, yes = (one.child, False) if isinstance(one, Not) else (one, True)
        column = getattr(inner, "attribute", ("",))
        if len(column) != 1 or column[0] not in ("row", *self.columns):
            return False
        name = "rowid" if column[0] == "row" else f'CAST("{column[0]}" AS TEXT)'
        if isinstance(inner, (IsNull, IsNotNull)):
            test, values = f"{name} IS {'NOT ' * isinstance(inner, IsNotNull)}NULL", []
        elif type(inner) in _SIGNS:
            test, values = f"{name} {_SIGNS[type(inner)]} ?", [inner.value]
        elif isinstance(inner, In) and inner.value and None not in inner.value:
            test, values = f"{name} IN ({', '.join('?' * len(inner.value))})", list(inner.value)
        elif isinstance(inner, StringStartsWith):
            test, values = f"substr({name}, 1, ?) = ?", [len(inner.value), inner.value]
        else:
            return False
        self.where.append(test if yes else f"NOT ({test})")
        self.values += values
        return True


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocel_sqlite_table"

    def schema(self) -> str:
        return "row long, " + ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> SqliteReader:
        kind = FilteringReader if self.options.get("filters") == "true" else SqliteReader
        return kind(dict(self.options))


def read_sqlite(spark: SparkSession, path: str) -> EventLog:
    """The relational form: event, object, event_object, object_object, and a table for each type's attributes."""
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    path = local_path(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = {t: [r[1] for r in db.execute(f'PRAGMA table_info("{t}")')] for (t,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        maps = {kind: db.execute(f"SELECT ocel_type, ocel_type_map FROM {kind}_map_type").fetchall() for kind in ("event", "object")}

    filters = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()

    def load(table: str) -> DataFrame:
        return spark.read.format("ocel_sqlite_table").options(path=path, table=table, columns=",".join(columns[table]), filters=filters).load()

    def typed(kind: str, fixed: tuple[str, ...]) -> DataFrame:
        parts = []
        for name, mapped in maps[kind]:
            table = f"{kind}_{mapped}"
            own = [c for c in columns[table] if c not in fixed]
            pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in own)) if own else F.array().cast("array<struct<key:string,value:string>>")
            changed = F.col("ocel_changed_field") if "ocel_changed_field" in columns[table] else F.lit(None).cast("string")
            parts.append(load(table).select("row", "ocel_id", F.lit(name).alias("type"), F.to_timestamp("ocel_time").alias("ts"), changed.alias("changed"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("attrs")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    event_rows, object_rows = typed("event", ("ocel_id", "ocel_time")), typed("object", ("ocel_id", "ocel_time", "ocel_changed_field"))
    order = load("event").select(F.col("ocel_id").alias("eid"), F.col("row").alias("seq"))
    events = event_rows.join(order, event_rows["ocel_id"] == order["eid"]).select("eid", F.col("type").alias("activity"), "ts", "attrs", "seq")
    base = object_rows.where("changed is null").groupBy("ocel_id").agg(F.min_by("attrs", "row").alias("attrs"))
    objects = load("object").join(base, "ocel_id", "left").select(F.col("ocel_id").alias("oid"), F.col("ocel_type").alias("otype"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
    changes = object_rows.where("changed is not null").select(F.col("ocel_id").alias("oid"), F.col("type").alias("otype"), "ts", F.col("changed").alias("field"), F.col("attrs")[F.col("changed")].alias("value"), F.col("row").alias("seq"))
    relations = load("event_object").select(F.col("ocel_event_id").alias("eid"), F.col("ocel_object_id").alias("oid"), F.col("ocel_qualifier").alias("qualifier"), F.col("row").alias("seq"))
    o2o = load("object_object").select(F.col("ocel_source_id").alias("oid"), F.col("ocel_target_id").alias("oid_2"), F.col("ocel_qualifier").alias("qualifier"))
    return _log(spark, events, objects, relations, changes, o2o)


def _plain(name: str) -> str:
    return "".join(c for c in name.title() if c.isalnum())


def write_sqlite(log: EventLog, path: str) -> None:
    """The relational form in one file, its rows put into tables and order by Spark."""
    spark = log.events.sparkSession
    ship_package(spark)
    spark.dataSource.register(TablesFile)
    start, none = F.lit("1970-01-01T00:00:00"), F.lit(None).cast("string")
    tables: dict[str, list[str]] = {"event_object": ["ocel_event_id", "ocel_object_id", "ocel_qualifier"], "object_object": ["ocel_source_id", "ocel_target_id", "ocel_qualifier"]}
    row = lambda df, table, values, seq=F.lit(0), key=F.lit(""): df.select(F.lit(table).alias("table"), F.coalesce(seq, F.lit(0)).cast("long").alias("at"), key.alias("key"), F.array(*values).alias("values"))
    parts = [row(log.relations, "event_object", ["eid", "oid", "qualifier"], F.col("seq"), F.col("eid")), row(log.o2o, "object_object", ["oid", "oid_2", "qualifier"], key=F.concat_ws("\0", "oid", "oid_2"))]
    for kind, df, col in (("event", log.events, "activity"), ("object", log.objects, "otype")):
        named = df.select(F.col(col).alias("t"), F.explode_outer(F.map_keys("attrs")).alias("name"))
        if kind == "object":
            named = named.unionAll(log.object_changes.select(F.col("otype").alias("t"), F.col("field").alias("name")))
        types = {r["t"]: r["names"] for r in named.groupBy("t").agg(F.array_sort(F.collect_set("name")).alias("names")).collect()}  # one row a type
        tables |= {kind: ["ocel_id", "ocel_type"], f"{kind}_map_type": ["ocel_type", "ocel_type_map"]}
        name, seq = ("eid", F.col("seq")) if kind == "event" else ("oid", F.lit(0))
        parts.append(row(df, kind, [name, col], seq, F.col(name)))
        if types:
            parts.append(row(spark.createDataFrame([(t, _plain(t)) for t in sorted(types)], "t string, p string"), f"{kind}_map_type", ["t", "p"], key=F.col("t")))
        for t, names in types.items():
            table = f"{kind}_{_plain(t)}"
            changed = [none] if kind == "object" else []
            tables[table] = ["ocel_id", "ocel_time", *(["ocel_changed_field"] if changed else []), *names]
            stamp = _stamp(F.col("ts")) if kind == "event" else start
            parts.append(row(df.where(F.col(col) == t), table, [F.col(name), stamp, *changed, *(F.col("attrs")[n] for n in names)], seq, F.col(name)))
            if changed:
                own = log.object_changes.where(F.col("otype") == t)
                parts.append(row(own, table, [F.col("oid"), _stamp(F.col("ts")), F.col("field"), *(F.when(F.col("field") == n, F.col("value")) for n in names)], F.coalesce("seq", F.lit(0)) + 1, F.col("oid")))
    order = ("table", "at", "key")
    rows = reduce(DataFrame.unionAll, parts).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("table", "values").write.format("one_sqlite_file").option("path", path).option("tables", json.dumps(tables)).mode("overwrite").save()


def write_labels_json(labels: DataFrame, path: str) -> None:
    """(eid, label) rows as a folder of JSON lines."""
    labels.write.mode("overwrite").json(path)
