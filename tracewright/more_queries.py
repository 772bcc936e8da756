"""Queries over the workshop, flag and nation logs, each with DuckDB SQL for comparison.

The workshop log exercises log preparation and masses as of a time, the flag log
silent transitions and alignments, the nation log files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import MinerParameters, annotations, discover
from .functions.scalar import hex_to_rgb, rgb_to_hex, seconds_to_timestamp
from .model import FINAL, ROLES, EventLog
from .operators import asof, conformance, filters, preprocess, variants, waste
from .operators import roles as role_ops
from .operators.components import cut, discard, forget, held, scratch_folder
from .plans import net as nets
from .queries import _INSTANCES, _MASS, _NET, _REL, _SIGNED, ORACLES, QUERIES, _register, _roles_sql, _variants_sql
from .sources.files import local_path
from .sources.ocel import read_log, write_log
from .sources.starschema import flag_log, nation_log, order_log, user_log, workshop_log

__all__ = ["ORACLES", "QUERIES"]  # those of both modules

# --- log preparation ---------------------------------------------------------------------

_LINES = """ln AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n, CAST(l_quantity AS DECIMAL(18, 2)) AS q, l_shipdate AS day FROM lineitem
), whole AS (SELECT k, sum(q) AS q, max(day) + INTERVAL 1 DAY AS ts FROM ln GROUP BY k)"""
_COIL = "SELECT 'object' AS kind, 'coil:' || k AS name, 'SteelCoil' AS otype, 2 * q AS v FROM whole"
_SHEET = "SELECT 'object' AS kind, 'sheet:' || k || '-' || n AS name, 'SteelSheet' AS otype, {v} AS v FROM ln"
_PART = "SELECT 'object' AS kind, 'part:' || k AS name, 'FormedPart' AS otype, {v} AS v FROM whole"
_SHEET_CHANGE = "SELECT 'change' AS kind, 'sheet:' || k || '-' || n AS name, 'SteelSheet' AS otype, q + c AS v FROM ln, (VALUES (1), (2)) t(c)"
_PART_CHANGE = "SELECT 'change' AS kind, 'part:' || k AS name, 'FormedPart' AS otype, q / 2 AS v FROM whole"


def _effects_sql(*parts: str) -> str:
    """Objects and changes of a log; those that are not given are as the workshop log has them."""
    found = " UNION ALL ".join(f"({p})" for p in parts)
    return f"WITH {_LINES} SELECT kind, name, otype, round(CAST(v AS DOUBLE), 4) AS v FROM ({found})"


def _effects(log: EventLog) -> DataFrame:
    """Every object's base mass and every change of mass."""
    number = F.round(F.col("v").cast("decimal(38,18)").cast("double"), 4).alias("v")
    objects = log.objects.select(F.lit("object").alias("kind"), F.col("oid").alias("name"), "otype", F.col("attrs")["mass"].alias("v"))
    changes = log.object_changes.select(F.lit("change").alias("kind"), F.col("oid").alias("name"), "otype", F.col("value").alias("v"))
    return objects.unionAll(changes).select("kind", "name", "otype", number)


@_register("prep_mass_from_change", _effects_sql(_COIL, _SHEET.format(v="q"), _PART.format(v="q / 2"), _SHEET_CHANGE))
def prep_mass_from_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(preprocess.mass_from_change(workshop_log(spark, sf_dir), "FormedPart"))


@_register("prep_output_less_waste", _effects_sql(_COIL, _SHEET.format(v="q"), _PART.format(v="(SELECT q FROM ln ORDER BY k, n LIMIT 1) - k % 7 - 0.5"), _SHEET_CHANGE, _PART_CHANGE))
def prep_output_less_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(preprocess.output_less_waste(workshop_log(spark, sf_dir), "Assemble", "SteelSheet", "FormedPart", "cut"))


@_register("prep_split_off_waste", _effects_sql(_COIL, _SHEET.format(v="q * 0.76"), _PART.format(v="0"), _SHEET_CHANGE + " WHERE c = 2", _PART_CHANGE))
def prep_split_off_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(preprocess.split_off_waste(workshop_log(spark, sf_dir), "SteelSheet", "0.12"))


@_register("prep_output_from_inputs", _effects_sql(_COIL, _SHEET.format(v="q"), _PART.format(v="q + 0.1"), _SHEET_CHANGE, _PART_CHANGE))
def prep_output_from_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(preprocess.output_from_inputs(workshop_log(spark, sf_dir), "Assemble", "0.1"))


@_register("prep_outputs_chained", _effects_sql(_COIL, "SELECT 'object' AS kind, 'sheet:' || k || '-' || n AS name, 'SteelSheet' AS otype, 2 * whole.q AS v FROM ln JOIN whole USING (k)", _PART.format(v="2 * q * (SELECT count(*) FROM ln WHERE ln.k = whole.k) + 0.1"), _SHEET_CHANGE, _PART_CHANGE))
def prep_outputs_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets weigh what their coil does, and then parts what their sheets now do."""
    sheets = preprocess.output_from_inputs(workshop_log(spark, sf_dir), "Split")
    sheets = sheets.replaced(objects=held(sheets.objects, "objects"))  # the next step reads them twice
    return _effects(preprocess.output_from_inputs(sheets, "Assemble", "0.1"))


_SPLIT_WASTE = "SELECT 'object' AS kind, 'SplitWaste:' || k || '-' || n AS name, 'SplitWaste' AS otype, q * 0.02 AS v FROM ln"
_COIL_CHANGE = "SELECT 'change' AS kind, 'coil:' || k AS name, 'SteelCoil' AS otype, 2 * sum(q) OVER (PARTITION BY k) - 1.02 * sum(q) OVER (PARTITION BY k ORDER BY n) AS v FROM ln"


def _waste_split(spark: SparkSession, sf_dir: str) -> EventLog:
    return preprocess.split_waste_objects(workshop_log(spark, sf_dir), "Split", "SteelCoil", "SteelSheet", "SplitWaste")


@_register("prep_split_waste_objects", _effects_sql(_COIL, _SHEET.format(v="q"), _PART.format(v="0"), _SPLIT_WASTE, _SHEET_CHANGE, _PART_CHANGE, _COIL_CHANGE))
def prep_split_waste_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(_waste_split(spark, sf_dir))


@_register("prep_split_waste_links", f"""WITH {_LINES} SELECT 'output' AS kind, 'C' || k || '-' || n AS source, 'SplitWaste:' || k || '-' || n AS target FROM ln
UNION ALL SELECT 'waste', 'coil:' || k, 'SplitWaste:' || k || '-' || n FROM ln""")  # fmt: skip
def prep_split_waste_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _waste_split(spark, sf_dir)
    made = log.relations.where("otype = 'SplitWaste'").select(F.col("qualifier").alias("kind"), F.col("eid").alias("source"), F.col("oid").alias("target"))
    return made.unionAll(log.o2o.select("qualifier", "oid", "oid_2"))


@_register("prep_cut_waste_objects", _effects_sql(_COIL, _SHEET.format(v="q"), _PART.format(v="0"), "SELECT 'object' AS kind, 'CutWaste:A' || k AS name, 'CutWaste' AS otype, k % 7 + 0.5 AS v FROM whole", _SHEET_CHANGE, _PART_CHANGE))
def prep_cut_waste_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(preprocess.cut_waste_objects(workshop_log(spark, sf_dir), "Assemble", "cut", "CutWaste"))


@_register("prep_renamed", f"""WITH {_LINES} SELECT 'event' AS kind, 'Cut' AS name, NULL AS field, count(*) AS n FROM ln
UNION ALL SELECT 'event', 'Assemble', 'waste', count(*) FROM whole
UNION ALL SELECT 'object', t, 'weight', n FROM (SELECT 'Coil' AS t, count(*) AS n FROM whole UNION ALL SELECT 'Piece', count(*) FROM whole UNION ALL SELECT 'SteelSheet', count(*) FROM ln)
UNION ALL SELECT 'change', t, 'weight', n FROM (SELECT 'Piece' AS t, count(*) AS n FROM whole UNION ALL SELECT 'SteelSheet', 2 * count(*) FROM ln)
UNION ALL SELECT 'relation', t, a, n FROM (SELECT 'Coil' AS t, 'Cut' AS a, count(*) AS n FROM ln UNION ALL SELECT 'SteelSheet', 'Cut', count(*) FROM ln
  UNION ALL SELECT 'SteelSheet', 'Assemble', count(*) FROM ln UNION ALL SELECT 'Piece', 'Assemble', count(*) FROM whole)""")  # fmt: skip
def prep_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of types, activities and attributes after renaming and dropping, with their rows."""
    log = preprocess.rename_types(workshop_log(spark, sf_dir), {"SteelCoil": "Coil", "FormedPart": "Piece"}, {"Split": "Cut"})
    log = preprocess.rename_attributes(log, events={"cut": "waste"}, objects={"mass": "weight"}, drop=["duration"])
    counted = lambda df, kind, name, field: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), field.alias("field")).groupBy("kind", "name", "field").agg(F.count("*").alias("n"))
    keys = F.explode_outer(F.map_keys("attrs"))
    parts = [counted(log.events, "event", "activity", keys), counted(log.objects, "object", "otype", keys), counted(log.object_changes, "change", "otype", F.col("field")), counted(log.relations, "relation", "otype", F.col("activity"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# --- masses as of a time -------------------------------------------------------------------

_WORKSHOP_REL = _LINES + """, splits AS (SELECT k, n, q, 'C' || k || '-' || n AS eid, day + to_minutes(n) AS ts, k * 1000 + n AS seq FROM ln
), ends AS (SELECT eid, 'Split' AS activity, ts, seq, ts + to_microseconds(CAST(trunc(CAST(CAST(q / 4 AS DECIMAL(28, 2)) AS DOUBLE) * 1000000) AS BIGINT)) AS done FROM splits
  UNION ALL SELECT 'A' || k, 'Assemble', ts, k * 1000 + 999, ts + to_microseconds(1500000) FROM whole
), rel AS (
  SELECT eid, 'Split' AS activity, ts, 'coil:' || k AS oid, 'SteelCoil' AS otype FROM splits
  UNION ALL SELECT eid, 'Split', ts, 'sheet:' || k || '-' || n, 'SteelSheet' FROM splits
  UNION ALL SELECT eid, 'Split', ts, 'SplitWaste:' || k || '-' || n, 'SplitWaste' FROM splits
  UNION ALL SELECT 'A' || ln.k, 'Assemble', whole.ts, 'sheet:' || ln.k || '-' || n, 'SteelSheet' FROM ln JOIN whole USING (k)
  UNION ALL SELECT 'A' || k, 'Assemble', ts, 'part:' || k, 'FormedPart' FROM whole
)"""
_WASTE_HINTS = {"SplitWaste": FINAL}


@_register("effective_times", f"WITH {_WORKSHOP_REL} SELECT eid, epoch_us(done) AS done_us FROM ends")
def effective_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workshop_log(spark, sf_dir).events
    return events.select("eid", F.unix_micros(asof.effective_time(F.col("ts"), F.col("attrs")["duration"])).alias("done_us"))


@_register("implicit_mass_as_of", f"""WITH {_roles_sql(_WORKSHOP_REL, _WASTE_HINTS)}, {_variants_sql()}, base AS ({_COIL} UNION ALL {_SHEET.format(v='q')} UNION ALL {_SPLIT_WASTE}
), chg AS (SELECT 'coil:' || k AS oid, day + to_minutes(n) AS ts, k * 1000 + n AS seq, 2 * sum(q) OVER (PARTITION BY k) - 1.02 * sum(q) OVER (PARTITION BY k ORDER BY n) AS v FROM ln
  UNION ALL SELECT 'sheet:' || k || '-' || n, day + to_hours(c), k * 1000 + n * 10 + c, q + c FROM ln, (VALUES (1), (2)) t(c)
), prev AS (SELECT eid, max(struct_pack(s := seq, d := done)) OVER (PARTITION BY activity ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING).d AS previous_end FROM ends
), probes AS (
  SELECT variant_id, eid, role, r.oid, CASE WHEN role = 'input' THEN previous_end WHEN role IN ('output', 'final') AND otype = 'SteelCoil' THEN done END AS at
  FROM roles r JOIN vev USING (eid) JOIN prev USING (eid) JOIN ends USING (eid) WHERE r.activity = 'Split'
), valued AS (SELECT p.variant_id, p.eid, p.role, coalesce(max_by(c.v, c.seq) FILTER (c.ts <= p.at), max(b.v)) AS v FROM probes p JOIN base b ON b.name = p.oid LEFT JOIN chg c ON c.oid = p.oid GROUP BY p.variant_id, p.eid, p.role, p.oid
), each AS (SELECT variant_id, eid, sum({_SIGNED} * v) AS d FROM valued GROUP BY ALL)
SELECT variant_id, round(CAST(sum(d) AS DOUBLE), 4) AS total, round(CAST(sum(d) AS DOUBLE) / count(*), 4) AS average FROM each GROUP BY variant_id""")  # fmt: skip
def implicit_mass_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _waste_split(spark, sf_dir)
    found = role_ops.roles(log.relations, _WASTE_HINTS, only="Split").select("eid", "activity", "event_seq", "role", "otype", "oid")
    found = held(found, "roles")  # of the one activity that is asked for
    events = held(variants.variant_events(found).select("eid", "activity", "variant_id"), "variant-events")
    got = waste.implicit_mass_as_of(log, found, events, "Split")
    return got.select("variant_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("total", "average")))


@_register("explicit_waste_cut", f"""WITH {_roles_sql(_WORKSHOP_REL, _WASTE_HINTS)}, {_variants_sql()}, cuts AS (SELECT 'A' || k AS eid, k % 7 + 0.5 AS v FROM whole)
SELECT variant_id, CAST(sum(v) AS DOUBLE) AS total, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS average FROM vev JOIN cuts USING (eid) GROUP BY variant_id""")  # fmt: skip
def explicit_waste_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _waste_split(spark, sf_dir)
    events = variants.variant_events(role_ops.roles(log.relations, _WASTE_HINTS, only="Assemble"))
    events = held(events.select("eid", "activity", "variant_id"), "variant-events")
    got = waste.explicit_waste(events, log.events, "Assemble", "cut")
    return got.select("variant_id", F.col("total").cast("double").alias("total"), F.round(F.col("average").cast("double"), 4).alias("average"))


# --- silent transitions and conformance ------------------------------------------------------

_FLAG_REL = """rel AS (
  SELECT 'P' || o_orderkey AS eid, 'Place' AS activity, CAST(o_orderdate AS TIMESTAMP) AS ts, 'o' || o_orderkey AS oid, 'order' AS otype FROM orders
  UNION ALL SELECT 'S' || l_orderkey || l_returnflag, 'Ship ' || l_returnflag, CAST(min(l_shipdate) AS TIMESTAMP), 'o' || l_orderkey, 'order' FROM lineitem GROUP BY l_orderkey, l_returnflag
)"""


def _of_flags(sql: str) -> str:
    return sql.replace(_REL, _FLAG_REL)


_SHARE = 0.2


def _flag_parts(spark: SparkSession, sf_dir: str, share: float = 0.0) -> tuple[EventLog, nets.FlowNet, DataFrame]:
    """The flag log, the net of its variants above a share, and the variants of each object's ends."""
    log = flag_log(spark, sf_dir)
    log = log.replaced(relations=cut(log.relations, "relations"))
    log = log.replaced(objects=cut(log.objects, "objects"))
    found = cut(variants.named(variants.labelled(role_ops.roles(log.relations))), "roles")
    counts = cut(variants.counted(found), "counts")
    kinds = cut(filters.filter_variants(variants.counted_variants(counts), filters.above(share)), "variants")
    near = variants.counted_associations(counts)
    near = cut(near.join(kinds.select("variant_id"), "variant_id", "left_semi"), "associations")
    return log, nets.build(kinds, near), cut(variants.object_instances(found, found, check=False), "instances")


@_register("flag_net_arcs", _of_flags(ORACLES["net_arcs"]))
def flag_net_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arcs of a net with silent transitions, once its links are checked."""
    net = _flag_parts(spark, sf_dir)[1]
    nets.check(net)
    return net.arcs


@_register("flag_net_silent", _of_flags(ORACLES["net_silent"]))
def flag_net_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _flag_parts(spark, sf_dir)[1]
    return net.arcs.join(net.transitions.where("activity is null").select("transition"), "transition")


_COMMON = _NET.replace("FROM vev GROUP BY ALL", f"FROM vev GROUP BY variant_id, activity QUALIFY n_events > sum(n_events) OVER (PARTITION BY activity) * CAST({_SHARE} AS DOUBLE)")

# every transition of a flag net moves one token, so a case walks a graph; bounds of cost are above what any case needs
_ALIGNED = """{net}, {inst}, edges AS (
  SELECT DISTINCT i.place AS f, o.place AS t, CASE WHEN i.transition LIKE 'silent#%' THEN NULL ELSE split_part(i.transition, '#', 1) END AS label
  FROM arcs i JOIN arcs o USING (transition) WHERE i.direction = 'in' AND o.direction = 'out'
), moves AS (
  SELECT f, t, label, 0 AS step, CAST(label IS NOT NULL AS INTEGER) AS cost FROM edges UNION SELECT f, t, label, 1, 0 FROM edges WHERE label IS NOT NULL
  UNION SELECT idx, idx, NULL, 1, 1 FROM kept
), traces AS (SELECT oid, list(activity ORDER BY ts, eid) AS trace FROM rel GROUP BY oid
), marked AS (
  SELECT trace, a.place AS s, b.place AS e, count(*) AS n FROM traces LEFT JOIN inst USING (oid)
  LEFT JOIN arcs a ON a.transition = initial_variant_id AND a.direction = 'in' LEFT JOIN arcs b ON b.transition = final_variant_id AND b.direction = 'out' GROUP BY ALL
), walk AS (
  SELECT DISTINCT s, s AS p, 0 AS c FROM marked UNION SELECT s, t, c + cost FROM walk JOIN moves ON f = p AND step = 0 WHERE c + cost <= 12
), worst AS (SELECT s, p AS e, min(c) AS w FROM walk GROUP BY ALL
), search AS (
  SELECT trace, s, e, 0 AS pos, s AS p, 0 AS c FROM marked
  UNION SELECT trace, s, e, pos + step, t, c + cost FROM search JOIN moves ON f = p WHERE c + cost <= 12 AND (step = 0 OR (pos < len(trace) AND (label IS NULL OR label = trace[pos + 1])))
), best AS (SELECT trace, s, e, min(c) AS c FROM search WHERE pos = len(trace) AND p = e GROUP BY ALL
), fits AS (
  SELECT n, CASE WHEN w IS NULL THEN 0.0 WHEN w + len(trace) = 0 THEN 1.0 ELSE 1 - CAST(c AS DOUBLE) / (w + len(trace)) END AS fitness
  FROM marked LEFT JOIN worst USING (s, e) LEFT JOIN best USING (trace, s, e)
)"""


def _aligned(net: str) -> str:
    return _of_flags(_ALIGNED.format(net=net, inst=_INSTANCES))



@_register("flag_fitness", f"WITH RECURSIVE {_aligned(_COMMON)} SELECT round(fitness, 6) AS fitness, CAST(sum(n) AS BIGINT) AS cases FROM fits GROUP BY 1")
def flag_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each fitness to the net of the common variants."""
    log, net, instances = _flag_parts(spark, sf_dir, _SHARE)
    each = conformance.fitness(log, net, instances, "order")
    return each.groupBy(F.round("fitness", 6).alias("fitness")).agg(F.count("*").alias("cases"))


@_register("conformance_report", f"SELECT s.*, f.fitness FROM ({_of_flags(ORACLES['net_stats'])}) s, (WITH RECURSIVE {_aligned(_NET)} SELECT round(sum(n * fitness) / sum(n), 6) AS fitness FROM fits) f")
def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.report(*_flag_parts(spark, sf_dir)).withColumn("fitness", F.round("fitness", 6))


@_register("flag_cases", _of_flags(f"WITH {_REL} SELECT oid AS case_id, activity, epoch_us(ts) AS ts_us, eid FROM rel"))
def flag_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log flattened to one type whose objects share no event: every object is a case."""
    log = flag_log(spark, sf_dir)
    rows = conformance.flattened(log, "order", conformance.cases(conformance.related_objects(log, "order")))
    return rows.select("case_id", "activity", F.unix_micros("ts").alias("ts_us"), "eid")


# --- labels, files and scalars ----------------------------------------------------------------

_LABEL = "struct<type:int,activity:string,timestamp:bigint," + ",".join(f"{r}:array<struct<otype:string,oid:string,adj_activity:string>>" for r in ROLES) + ">"


@_register("labels_content", ORACLES["roles_long"])
def labels_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles as the JSON labels state them."""
    labels = role_ops.labels_json(role_ops.roles(order_log(spark, sf_dir).relations)).select("eid", F.from_json("label", _LABEL).alias("l"))
    entry = lambda r: lambda x: F.struct(F.lit(r).alias("role"), x["otype"].alias("otype"), x["oid"].alias("oid"), x["adj_activity"].alias("adj_activity"))
    listed = F.concat(*(F.transform(f"l.{r}", entry(r)) for r in ROLES))
    rows = labels.select("eid", F.col("l.activity").alias("activity"), F.col("l.timestamp").alias("ts_sec"), F.col("l.type").alias("event_class"), F.explode(listed).alias("x"))
    return rows.select("eid", "activity", "ts_sec", "event_class", "x.role", "x.otype", "x.oid", "x.adj_activity")


_FILES = f"""WITH b AS (SELECT 'n' || n_nationkey AS nation, 'r' || r_regionkey AS region, n_name, r_name, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey), {_REL}, {_MASS}
SELECT 'event' AS kind, 'Fn' || seq AS a, 'Found' AS b, r_name AS c, seq * 3600 + 1 AS sec FROM b
UNION ALL SELECT 'object', nation, 'nation', n_name, NULL FROM b UNION ALL SELECT 'object', 'r' || r_regionkey, 'region', r_name, NULL FROM region
UNION ALL SELECT 'relation', 'Fn' || seq, region, 'region', seq * 3600 + 1 FROM b UNION ALL SELECT 'relation', 'Fn' || seq, nation, 'nation', seq * 3600 + 1 FROM b
UNION ALL SELECT 'change', nation, 'name', lower(n_name), seq * 3600 + 1801 FROM b UNION ALL SELECT 'link', region, nation, 'holds', NULL FROM b
UNION ALL SELECT DISTINCT 'event', eid, activity, CASE activity WHEN 'Place' THEN '2' ELSE '3' END, CAST(epoch(ts) AS BIGINT) FROM rel
UNION ALL SELECT 'object', oid, otype, CAST(mass AS VARCHAR), NULL FROM mass JOIN (SELECT DISTINCT oid, otype FROM rel) USING (oid)
UNION ALL SELECT 'relation', eid, oid, otype, CAST(epoch(ts) AS BIGINT) FROM rel"""


def _round_trip(suffix: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The order and nation logs together, written to a file and read back; these formats are single files on a mounted folder.

        XML is written compressed, as its text is some ten times as large.
        """
        folder = local_path(scratch_folder(spark))
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/logs-{uuid.uuid4().hex}.{suffix}" + ".gz" * (suffix != "sqlite")
        first, second = order_log(spark, sf_dir), nation_log(spark, sf_dir)
        both = {k: held(getattr(first, k).unionByName(getattr(second, k)), k) for k in ("events", "objects", "relations", "object_changes", "o2o")}
        write_log(first.replaced(**both), path)
        for frame in both.values():
            discard(frame)
        del first, second, both
        forget(spark)  # the file holds all of it
        log = read_log(spark, path)
        rows = lambda df, kind, a, b, c, ts: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c"), (F.unix_seconds(ts) if ts else F.lit(None).cast("long")).alias("sec"))
        value = lambda *names: F.coalesce(*(F.col("attrs")[n] for n in names))
        parts = [rows(log.events, "event", "eid", "activity", value("by", "mass"), "ts"), rows(log.objects, "object", "oid", "otype", value("name", "mass"), None), rows(log.relations, "relation", "eid", "oid", F.col("otype"), "ts"), rows(log.object_changes, "change", "oid", "field", F.col("value"), "ts"), rows(log.o2o, "link", "oid", "oid_2", F.col("qualifier"), None)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    return query


for _suffix in ("xml", "sqlite", "ocel"):
    _register(f"file_{_suffix}", _FILES)(_round_trip(_suffix))


@_register("base_values", "SELECT CAST(event_id AS VARCHAR) AS eid, CAST(0 AS DOUBLE) AS value FROM events")
def base_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = user_log(spark, sf_dir)
    return asof.base_value(log.relations.select("eid", "oid"), log.objects, "value").select("eid", F.col("value").cast("double").alias("value"))


_ANNOTATED = MinerParameters(annotate_objects_count=["item"], annotate_explicit=["Place"], annotate_implicit_count=["Ship"])


@_register("annotated_net", f"""WITH RECURSIVE {_NET}, counts AS (SELECT variant_id, role, count(*) AS total FROM vev JOIN roles USING (eid) WHERE otype = 'item' AND role IN ('initial', 'final') GROUP BY ALL)
SELECT a.place, CAST(NULL AS VARCHAR) AS transition, variant_id, 'item: ' || total AS line FROM counts JOIN arcs a ON a.transition = variant_id JOIN kept ON idx = a.place AND otype = 'item' AND (role = 'initial' AND is_initial OR role = 'final' AND is_final)
UNION ALL SELECT NULL, variant_id, variant_id, 'Explicit mass: avg 2 / total ' || 2 * count(*) FROM vev WHERE activity = 'Place' GROUP BY variant_id
UNION ALL SELECT NULL, variant_id, variant_id, 'Implicit count: ' || CAST(sum({_SIGNED}) AS BIGINT) FROM vev JOIN roles USING (eid) WHERE vev.activity = 'Ship' GROUP BY variant_id""")  # fmt: skip
def annotated_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the miner prints at places and transitions."""
    log = order_log(spark, sf_dir)
    log = log.replaced(relations=cut(log.relations, "relations"))
    return annotations(log, discover(log, _ANNOTATED), _ANNOTATED, check=False).select("place", "transition", "variant_id", "line")


_MIXED_REL = """rel AS (SELECT 'L' || l_orderkey AS eid, 'Ship ' || l_returnflag AS activity, CAST(l_shipdate AS TIMESTAMP) AS ts, 'p' || l_partkey AS oid, 'part' AS otype,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq FROM lineitem), head AS (SELECT eid, activity AS ha, ts AS hts FROM rel WHERE seq = 1)"""


def _first_rows(sql: str) -> str:
    """Roles of a log whose events' rows disagree: lives follow the rows, events their first one."""
    a, b = sql.index("used0 AS ("), sql.index("), cls AS (")
    used = """used0 AS (
  SELECT eid, ha AS activity, hts AS ts, oid, otype, min(ts) OVER (PARTITION BY oid) < hts AS b, hts < max(ts) OVER (PARTITION BY oid) AS a, row_number() OVER (PARTITION BY eid, oid ORDER BY seq) AS nth,
    lag(activity) OVER (PARTITION BY oid ORDER BY ts, seq, eid) AS prev, lead(activity) OVER (PARTITION BY oid ORDER BY ts, seq, eid) AS nxt FROM rel JOIN head USING (eid)
"""
    return (sql[:a] + used + sql[b:]).replace("FROM used0 JOIN cls USING (eid)", "FROM used0 JOIN cls USING (eid) WHERE nth = 1")


@_register("roles_first_row", f"WITH {_first_rows(_roles_sql(_MIXED_REL))} SELECT eid, activity, CAST(epoch(ts) AS BIGINT) AS ts_sec, role, oid, adj AS adj_activity FROM roles")
def roles_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles where the rows of an event name different activities and times: the first row counts."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.row_number().over(order).cast("long"))
    relations = lines.select(F.concat(F.lit("L"), "l_orderkey").alias("eid"), F.concat(F.lit("Ship "), "l_returnflag").alias("activity"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.concat(F.lit("p"), "l_partkey").alias("oid"), F.lit("part").alias("otype"), F.lit("a").alias("qualifier"), "seq")
    return role_ops.roles(relations).select("eid", "activity", "ts_sec", "role", "oid", "adj_activity")


@_register("base_masses", f"WITH {_REL}, {_MASS} SELECT eid, oid, CAST(mass AS DOUBLE) AS value FROM rel JOIN mass USING (oid)")
def base_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's own base mass at each of its events."""
    log = order_log(spark, sf_dir)
    return asof.base_value(log.relations.select("eid", "oid"), log.objects, "mass").select("eid", "oid", F.col("value").cast("double").alias("value"))


@_register("scalars", """SELECT event_id, epoch_us(make_timestamp(CAST(event_id * 1000000 AS BIGINT))) AS us, printf('#%02x%02x%02x', event_id % 256, event_id * 7 % 256, event_id * 31 % 256) AS colour,
  CAST(event_id % 256 AS INTEGER) AS r, CAST(event_id * 7 % 256 AS INTEGER) AS g, CAST(event_id * 31 % 256 AS INTEGER) AS b FROM events""")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as a time; a colour to text and back."""
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_micros(seconds_to_timestamp(e)).alias("us"), rgb_to_hex(e % 256, e * 7 % 256, e * 31 % 256).alias("colour"))
    return rows.withColumn("_c", hex_to_rgb(F.col("colour"))).select("event_id", "us", "colour", "_c.*")
