"""Event logs over star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EventLog



def _seq():
    return F.lit(0).cast("long").alias("seq")


def _qualifier():
    return F.lit("a").alias("qualifier")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """One event a row of ``events``, with the user as its only object; values are changes of the user."""
    rows = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    eid, user = F.col("event_id").cast("string"), F.concat(F.lit("u"), F.col("user_id"))
    relations = rows.select(eid.alias("eid"), F.col("event_type").alias("activity"), "ts", user.alias("oid"), F.lit("user").alias("otype"), _qualifier(), F.col("event_id").alias("seq"))
    events = rows.select(eid.alias("eid"), F.col("event_type").alias("activity"), "ts", F.create_map(F.lit("value"), F.col("value").cast("string")).alias("attrs"), F.col("event_id").alias("seq"))
    objects = rows.select(user.alias("oid")).distinct().select("oid", F.lit("user").alias("otype"), F.create_map(F.lit("value"), F.lit("0")).alias("attrs"))
    changes = rows.where("event_type = 'purchase'").select(user.alias("oid"), F.lit("user").alias("otype"), "ts", F.lit("value").alias("field"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return EventLog.of(spark, relations, events, objects, changes)


def order_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """``Place`` of an order (order, customer) and ``Ship`` of an order's lines with one return flag (order, items).

    An item's mass is its largest quantity, an order's its total price, a customer's 1.
    An event's attribute ``mass`` is 2 for Place and 3 for Ship.
    """
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    order_of = lambda key: F.concat(F.lit("o"), F.col(key))
    place = F.concat(F.lit("P"), F.col("o_orderkey")).alias("eid"), F.lit("Place").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("ts")
    placed = orders.select(*place, F.explode(F.array(F.struct(order_of("o_orderkey").alias("oid"), F.lit("order").alias("otype")), F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("oid"), F.lit("customer").alias("otype")))).alias("_o"))
    item = F.concat(F.lit("i"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    # a window beside plain columns: sets of items would be built ahead of the shuffle and again after it
    flagged = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey")
    first_day = F.min("l_shipdate").over(flagged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("timestamp").alias("ts")
    line = F.struct("l_linenumber", "l_partkey")
    rows = lines.select("l_orderkey", "l_returnflag", first_day, item.alias("item"), F.row_number().over(flagged).alias("nth"), F.coalesce(F.lag(line).over(flagged) == line, F.lit(False)).alias("again"))
    objects = F.array(F.when(F.col("nth") == 1, F.struct(order_of("l_orderkey").alias("oid"), F.lit("order").alias("otype"))), F.when(~F.col("again"), F.struct(F.col("item").alias("oid"), F.lit("item").alias("otype"))))
    shipped = rows.select(F.concat(F.lit("S"), F.col("l_orderkey"), F.col("l_returnflag")).alias("eid"), F.lit("Ship").alias("activity"), "ts", F.explode(objects).alias("_o")).where("_o is not null")
    ship = lines.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_shipdate").cast("timestamp").alias("ts"))
    relations = placed.unionAll(shipped).select("eid", "activity", "ts", "_o.oid", "_o.otype", _qualifier(), _seq())

    mass = lambda c: F.create_map(F.lit("mass"), c.cast("decimal(18,2)").cast("string")).alias("attrs")
    o = orders.groupBy(order_of("o_orderkey").alias("oid")).agg(F.max("o_totalprice").alias("m")).select("oid", F.lit("order").alias("otype"), mass(F.col("m")))
    c = orders.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("oid")).distinct().select("oid", F.lit("customer").alias("otype"), mass(F.lit(1)))
    i = lines.groupBy(item.alias("oid")).agg(F.max("l_quantity").alias("m")).select("oid", F.lit("item").alias("otype"), mass(F.col("m")))
    weight = F.create_map(F.lit("mass"), F.when(F.col("activity") == "Place", "2").otherwise("3")).alias("attrs")
    events = orders.select(*place).unionAll(ship.select(F.concat(F.lit("S"), F.col("l_orderkey"), F.col("l_returnflag")), F.lit("Ship"), "ts")).select("eid", "activity", "ts", weight, _seq())
    return EventLog.of(spark, relations, events, o.unionAll(c).unionAll(i))


def flag_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """The orders of ``order_log`` alone, with an activity for each return flag."""
    rows = order_log(spark, sf_dir).relations.where("otype = 'order'")
    flagged = F.when(F.col("activity") == "Ship", F.concat(F.lit("Ship "), F.right("eid", F.lit(1)))).otherwise(F.col("activity"))
    return EventLog.of(spark, rows.withColumn("activity", flagged))


def workshop_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A workshop: each order is a coil, from which every line splits a sheet; its sheets are assembled to a part.

    A coil weighs twice its lines' quantities, a sheet its line's, a part nothing yet. Events
    have a duration in seconds, assemblies a cut waste. Sheets have two changes of
    mass, parts one.
    """
    lines = _read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lines.select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("n"), F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_shipdate").cast("timestamp").alias("day"))
    whole = lines.groupBy("k").agg(F.sum("q").alias("q"), (F.max("day") + F.expr("interval 1 day")).alias("ts"), F.collect_list("n").alias("ns"))
    text = lambda c: c.cast("decimal(28,2)").cast("string")
    attrs = lambda **named: F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))).alias("attrs")
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c).alias("oid")
    sheet, otype = F.concat_ws("-", "k", "n"), lambda t: F.lit(t).alias("otype")
    objects = lines.select(named("sheet", sheet), otype("SteelSheet"), attrs(mass=text(F.col("q"))))
    objects = objects.unionAll(whole.select(named("coil", F.col("k")), otype("SteelCoil"), attrs(mass=text(F.col("q") * 2))))
    objects = objects.unionAll(whole.select(named("part", F.col("k")), otype("FormedPart"), attrs(mass=F.lit("0.00"))))

    splits = lines.select("k", "n", F.concat(F.lit("C"), sheet).alias("eid"), F.lit("Split").alias("activity"), F.timestamp_micros(F.unix_micros("day") + F.col("n") * 60_000_000).alias("ts"), attrs(duration=text(F.col("q") / 4)), (F.col("k") * 1000 + F.col("n")).alias("seq"))
    joins = whole.select("k", "ns", F.concat(F.lit("A"), "k").alias("eid"), F.lit("Assemble").alias("activity"), "ts", attrs(duration=F.lit("1.50"), cut=F.concat(F.col("k") % 7, F.lit(".50"))), (F.col("k") * 1000 + 999).alias("seq"))
    head, part = ["eid", "activity", "ts"], lambda at: (F.col("seq") * 1000 + at).alias("seq")
    side = lambda q: F.lit(q).alias("qualifier")
    relations = splits.select(*head, named("coil", F.col("k")), otype("SteelCoil"), side("input"), part(F.lit(0)))
    relations = relations.unionAll(splits.select(*head, named("sheet", sheet), otype("SteelSheet"), side("output"), part(F.lit(1))))
    relations = relations.unionAll(joins.select(*head, "k", "seq", F.explode("ns").alias("n")).select(*head, named("sheet", sheet), otype("SteelSheet"), side("input"), part(F.col("n"))))
    relations = relations.unionAll(joins.select(*head, named("part", F.col("k")), otype("FormedPart"), side("output"), part(F.lit(0))))

    twice = lines.select("k", "n", "q", "day", F.explode(F.array(F.lit(1), F.lit(2))).alias("c"))
    field, later = F.lit("mass").alias("field"), lambda ts, hours: F.timestamp_micros(F.unix_micros(ts) + hours * 3_600_000_000).alias("ts")
    changes = twice.select(named("sheet", sheet), otype("SteelSheet"), later("day", F.col("c")), field, text(F.col("q") + F.col("c")).alias("value"), (F.col("k") * 1000 + F.col("n") * 10 + F.col("c")).alias("seq"))
    changes = changes.unionAll(whole.select(named("part", F.col("k")), otype("FormedPart"), "ts", field, text(F.col("q") / 2).alias("value"), (F.col("k") * 1000).alias("seq")))
    made = ["eid", "activity", "ts", "attrs", "seq"]
    return EventLog.of(spark, relations, splits.select(*made).unionAll(joins.select(*made)), objects, changes)


def nation_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """A small log for files: regions found their nations, which are then renamed; a region links to each nation."""
    nations, regions = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    both = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.concat(F.lit("n"), "n_nationkey").alias("nation"), F.concat(F.lit("r"), "r_regionkey").alias("region"), "n_name", "r_name", F.col("n_nationkey").cast("long").alias("seq"))
    eid, activity, ts = F.concat(F.lit("F"), "nation").alias("eid"), F.lit("Found").alias("activity"), F.timestamp_seconds(F.col("seq") * 3600 + 1).alias("ts")
    pair = F.explode(F.array(F.struct(F.col("region").alias("oid"), F.lit("region").alias("otype"), F.col("seq") * 2), F.struct(F.col("nation").alias("oid"), F.lit("nation").alias("otype"), F.col("seq") * 2 + 1))).alias("_o")
    relations = both.select(eid, activity, ts, pair).select("eid", "activity", "ts", "_o.oid", "_o.otype", _qualifier(), F.col("_o.col3").alias("seq"))
    events = both.select(eid, activity, ts, F.create_map(F.lit("by"), F.col("r_name")).alias("attrs"), "seq")
    objects = both.select(F.col("nation").alias("oid"), F.lit("nation").alias("otype"), F.create_map(F.lit("name"), F.col("n_name")).alias("attrs"))
    objects = objects.unionAll(regions.select(F.concat(F.lit("r"), "r_regionkey").alias("oid"), F.lit("region").alias("otype"), F.create_map(F.lit("name"), F.col("r_name")).alias("attrs")))
    changes = both.select(F.col("nation").alias("oid"), F.lit("nation").alias("otype"), F.timestamp_seconds(F.col("seq") * 3600 + 1801).alias("ts"), F.lit("name").alias("field"), F.lower("n_name").alias("value"), "seq")
    o2o = both.select(F.col("region").alias("oid"), F.col("nation").alias("oid_2"), F.lit("holds").alias("qualifier"))
    return EventLog.of(spark, relations, events, objects, changes, o2o)
