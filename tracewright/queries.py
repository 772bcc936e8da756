"""The engine's queries over the driver's tables, each with DuckDB SQL for comparison.

Two logs are derived from the star-schema tables: ``order_log`` (orders and shipments)
and ``user_log`` (one event a row of ``events``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import FINAL, INITIAL, INNER
from .operators import asof, conformance, filters, massbalance, variants, waste
from .operators import roles as role_ops
from .operators.components import cut
from .plans import net as nets
from .plans import render
from .sources.starschema import order_log, user_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- shared SQL --------------------------------------------------------------------

_REL = """rel AS (
  SELECT 'P' || o_orderkey AS eid, 'Place' AS activity, CAST(o_orderdate AS TIMESTAMP) AS ts, 'o' || o_orderkey AS oid, 'order' AS otype FROM orders
  UNION ALL SELECT 'P' || o_orderkey, 'Place', CAST(o_orderdate AS TIMESTAMP), 'c' || o_custkey, 'customer' FROM orders
  UNION ALL SELECT 'S' || l_orderkey || l_returnflag, 'Ship', CAST(min(l_shipdate) AS TIMESTAMP), 'o' || l_orderkey, 'order' FROM lineitem GROUP BY l_orderkey, l_returnflag
  UNION ALL SELECT DISTINCT 'S' || l_orderkey || l_returnflag, 'Ship', CAST(min(l_shipdate) OVER (PARTITION BY l_orderkey, l_returnflag) AS TIMESTAMP), 'i' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'item' FROM lineitem
)"""
_MASS = """mass AS (
  SELECT 'o' || o_orderkey AS oid, CAST(max(o_totalprice) AS DECIMAL(18, 2)) AS mass FROM orders GROUP BY 1
  UNION ALL SELECT DISTINCT 'c' || o_custkey, CAST(1 AS DECIMAL(18, 2)) FROM orders
  UNION ALL SELECT 'i' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, CAST(max(l_quantity) AS DECIMAL(18, 2)) FROM lineitem GROUP BY 1
)"""


def _roles_sql(rel: str = _REL, hinted: dict[str, str] | None = None) -> str:
    hinted = hinted or {}
    fixed = {t: r for t, r in hinted.items() if r != INNER}
    inner = [t for t, r in hinted.items() if r == INNER]
    free = f"otype NOT IN ({', '.join(repr(t) for t in fixed)})" if fixed else "true"
    ends = f"AND otype NOT IN ({', '.join(repr(t) for t in inner)})" if inner else ""
    extra = "".join(f"\n  UNION ALL SELECT eid, activity, ts, cls, '{r}', otype, oid, NULL FROM used WHERE otype = '{t}'" for t, r in fixed.items())
    return f"""{rel}, used0 AS (
  SELECT *, min(ts) OVER (PARTITION BY oid) < ts AS b, ts < max(ts) OVER (PARTITION BY oid) AS a,
    lag(activity) OVER (PARTITION BY oid ORDER BY ts, eid) AS prev, lead(activity) OVER (PARTITION BY oid ORDER BY ts, eid) AS nxt FROM rel
), cls AS (
  SELECT eid, CASE WHEN coalesce(bool_and(b AND a) FILTER ({free}), true) THEN 0 WHEN bool_and(b) FILTER ({free}) THEN 1
    WHEN bool_and(a) FILTER ({free}) THEN 2 WHEN bool_and(NOT b AND NOT a) FILTER ({free}) THEN 3
    WHEN bool_and(NOT a) FILTER ({free}) THEN 4 WHEN bool_and(NOT b) FILTER ({free}) THEN 5 ELSE 6 END AS cls FROM used0 GROUP BY eid
), used AS (SELECT * FROM used0 JOIN cls USING (eid)
), roles AS (
  SELECT eid, activity, ts, cls, 'input' AS role, otype, oid, prev AS adj FROM used WHERE b AND {free}
  UNION ALL SELECT eid, activity, ts, cls, 'output', otype, oid, nxt FROM used WHERE a AND {free}
  UNION ALL SELECT eid, activity, ts, cls, 'initial', otype, oid, NULL FROM used WHERE NOT b AND (cls = 2 OR (NOT a AND cls IN (3, 5))) AND {free} {ends}
  UNION ALL SELECT eid, activity, ts, cls, 'final', otype, oid, NULL FROM used WHERE NOT a AND (cls = 1 OR (NOT b AND cls IN (3, 4))) AND {free} {ends}
  UNION ALL SELECT eid, activity, ts, cls, 'unknown', otype, oid, NULL FROM used WHERE NOT a AND NOT b AND cls = 6 AND {free}{extra}
)"""


def _variants_sql(weighted: bool = False, roles: str = "roles") -> str:
    many = "count(*)" if weighted else "least(count(*), 2)"
    return f"""parts AS (
  SELECT eid, activity, role, otype, {many} AS m FROM {roles} GROUP BY ALL
), vev AS (
  SELECT eid, activity, activity || '#' || string_agg(role || ':' || otype || ':' || m, '|' ORDER BY role, otype, m) AS variant_id FROM parts GROUP BY eid, activity
), vs AS (SELECT variant_id, activity, count(*) AS n_events, min(eid) AS first_eid FROM vev GROUP BY ALL
), assoc AS (
  SELECT v.variant_id, v.activity, r.role, r.otype, p.m, r.adj, count(*) AS n
  FROM {roles} r JOIN vev v USING (eid) JOIN parts p ON p.eid = r.eid AND p.role = r.role AND p.otype = r.otype GROUP BY ALL
)"""


_R = _roles_sql()
_V = f"{_R}, {_variants_sql()}"


def _order_roles(spark: SparkSession, sf_dir: str, hints: dict[str, str] | None = None) -> DataFrame:
    return role_ops.roles(order_log(spark, sf_dir).relations, hints)


# --- logs, classes and roles ---------------------------------------------------------


@_register("log_summary", f"""WITH {_REL}, ev AS (SELECT DISTINCT eid, activity FROM rel), ob AS (SELECT DISTINCT oid, otype FROM rel)
SELECT 'events' AS kind, '' AS name, count(*) AS n FROM ev UNION ALL SELECT 'objects', '', count(*) FROM ob UNION ALL SELECT 'relations', '', count(*) FROM rel
UNION ALL SELECT 'activity', activity, count(*) FROM ev GROUP BY activity UNION ALL SELECT 'otype', otype, count(*) FROM ob GROUP BY otype""")  # fmt: skip
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log(spark, sf_dir).summary()


@_register("relations_b", f"WITH {_REL} SELECT eid, activity, epoch_us(ts) AS ts_us, oid, otype FROM rel")
def relations_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log(spark, sf_dir).relations.select("eid", "activity", F.unix_micros("ts").alias("ts_us"), "oid", "otype")


@_register("object_types", f"WITH {_REL} SELECT DISTINCT otype FROM rel")
def object_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log(spark, sf_dir).object_types()


@_register("event_class", f"WITH {_R} SELECT DISTINCT eid, activity, CAST(cls AS INTEGER) AS event_class FROM used")
def event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_ops.event_classes(order_log(spark, sf_dir).relations).select("eid", "activity", "event_class")


@_register("class_histogram", f"WITH {_R} SELECT activity, CAST(cls AS INTEGER) AS event_class, count(DISTINCT eid) AS n FROM used GROUP BY ALL")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_ops.class_histogram(order_log(spark, sf_dir).relations)


_USER_REL = "rel AS (SELECT CAST(event_id AS VARCHAR) AS eid, event_type AS activity, ts, 'u' || user_id AS oid, 'user' AS otype FROM events)"


@_register("class_table_users", f"WITH {_roles_sql(_USER_REL)} SELECT activity, {', '.join(f'count(DISTINCT eid) FILTER (cls = {k}) AS c{k}' for k in range(7))} FROM used GROUP BY activity")
def class_table_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_ops.class_table(user_log(spark, sf_dir).relations)


_ROLE_COLUMNS = ("eid", "activity", "ts_sec", "event_class", "role", "otype", "oid", "adj_activity")
_ROLE_SELECT = "SELECT eid, activity, CAST(epoch(ts) AS BIGINT) AS ts_sec, CAST(cls AS INTEGER) AS event_class, role, otype, oid, adj AS adj_activity FROM roles"


@_register("roles_long", f"WITH {_R} {_ROLE_SELECT}")
def roles_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_roles(spark, sf_dir).select(*_ROLE_COLUMNS)


@_register("adjacent_activity", f"WITH {_R} SELECT activity, otype, role, adj AS adj_activity, count(*) AS n FROM roles GROUP BY ALL")
def adjacent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_roles(spark, sf_dir).groupBy("activity", "otype", "role", "adj_activity").agg(F.count("*").alias("n"))


_HINTS = {"item": FINAL, "customer": INITIAL}


@_register("roles_hinted", f"WITH {_roles_sql(hinted=_HINTS)} {_ROLE_SELECT}")
def roles_hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_roles(spark, sf_dir, _HINTS).select(*_ROLE_COLUMNS)


@_register("roles_inner", f"WITH {_roles_sql(hinted={'order': INNER})} SELECT activity, otype, role, count(*) AS n FROM roles GROUP BY ALL")
def roles_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_roles(spark, sf_dir, {"order": INNER}).groupBy("activity", "otype", "role").agg(F.count("*").alias("n"))


@_register("labels_size", f"WITH {_R} SELECT activity, count(DISTINCT eid) AS n FROM roles GROUP BY activity")
def labels_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a JSON label, by the activity the label states."""
    labels = role_ops.labels_json(_order_roles(spark, sf_dir))
    return labels.groupBy(F.get_json_object("label", "$.activity").alias("activity")).agg(F.count("*").alias("n"))


# --- variants and filters --------------------------------------------------------------


def _cut_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_order_roles(spark, sf_dir), "roles")


def _labelled(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """Roles with the variant of their event: roles come by event, so nothing is shuffled or joined for it."""
    return variants.named(variants.labelled(_order_roles(spark, sf_dir), weighted))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by variant, role, type and neighbour, a small table that one pass over the roles makes."""
    return cut(variants.counted(variants.labelled(_order_roles(spark, sf_dir))), "counts")


def _variant_events(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """The variant of each event alone: roles come by event, so their variants need no further shuffle."""
    return variants.variant_events(_order_roles(spark, sf_dir), weighted)


@_register("variants_capped", f"WITH {_V} SELECT variant_id, activity, n_events, first_eid FROM vs")
def variants_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_variant_events(spark, sf_dir)).select("variant_id", "activity", "n_events", "first_eid")


@_register("variants_weighted", f"WITH {_R}, {_variants_sql(True)} SELECT variant_id, activity, n_events, first_eid FROM vs")
def variants_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_variant_events(spark, sf_dir, True)).select("variant_id", "activity", "n_events", "first_eid")


@_register("variant_assoc", f"WITH {_V} SELECT variant_id, activity, role, otype, CAST(m AS INTEGER) AS multiplicity, adj AS adj_activity, n FROM assoc")
def variant_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.counted_associations(variants.counted(variants.labelled(_order_roles(spark, sf_dir))))


@_register("variant_type_counts", f"WITH {_V} SELECT variant_id, role, otype, CAST(sum(n) AS BIGINT) AS n FROM assoc GROUP BY ALL")
def variant_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.counted(variants.labelled(_order_roles(spark, sf_dir)))
    return counts.groupBy("variant_id", "role", "otype").agg(F.sum("n").alias("n"))


_INSTANCES = """inst AS (
  SELECT r.oid, min(r.otype) AS otype, max(CASE WHEN role = 'initial' THEN struct_pack(e := r.eid, v := variant_id) END).v AS initial_variant_id,
    max(CASE WHEN role = 'final' THEN struct_pack(e := r.eid, v := variant_id) END).v AS final_variant_id
  FROM roles r JOIN vev USING (eid) WHERE role IN ('initial', 'final') GROUP BY r.oid)"""


@_register("object_instances", f"WITH {_V}, {_INSTANCES} SELECT * FROM inst")
def object_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an object's several last events, which day-long ticks allow, the last by event id counts."""
    found = _labelled(spark, sf_dir)
    return variants.object_instances(found, found, check=False)


@_register("second_finals", f"WITH {_R} SELECT oid, min(otype) AS otype, count(*) AS finals FROM roles WHERE role = 'final' GROUP BY oid HAVING count(*) > 1")
def second_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.second_finals(_order_roles(spark, sf_dir))


_FILTERED_REL = _REL.replace("rel AS (", "rel0 AS (") + ", rel AS (SELECT * FROM rel0 WHERE otype <> 'customer')"


@_register("filter_types", f"WITH {_roles_sql(_FILTERED_REL)} SELECT activity, otype, role, count(*) AS n FROM roles GROUP BY ALL")
def filter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = filters.drop_object_types(order_log(spark, sf_dir), ["customer"])
    return role_ops.roles(log.relations).groupBy("activity", "otype", "role").agg(F.count("*").alias("n"))


@_register("filter_activities", f"WITH {_REL} SELECT activity, otype, count(*) AS n FROM rel WHERE activity <> 'Ship' GROUP BY ALL")
def filter_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_activities(order_log(spark, sf_dir), ["Ship"]).relations.groupBy("activity", "otype").agg(F.count("*").alias("n"))


_ALPHA, _BETA = 0.05, 0.3


@_register("variants_alpha", f"WITH {_V} SELECT variant_id, n_events FROM vs QUALIFY n_events > sum(n_events) OVER (PARTITION BY activity) * CAST({_ALPHA} AS DOUBLE)")
def variants_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = variants.variants(_variant_events(spark, sf_dir))
    return filters.filter_variants(kinds, filters.above(_ALPHA)).select("variant_id", "n_events")


@_register("assoc_beta", f"WITH {_V} SELECT variant_id, role, otype, adj AS adj_activity, n FROM assoc QUALIFY role NOT IN ('input', 'output') OR n > sum(n) OVER (PARTITION BY variant_id, role, otype) * CAST({_BETA} AS DOUBLE)")
def assoc_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = variants.counted_associations(_counts(spark, sf_dir))
    return filters.filter_associations(near, filters.above(_BETA)).select("variant_id", "role", "otype", "adj_activity", "n")


_GENERAL = f"""{_R}, {_variants_sql(True)}, sig AS (
  SELECT vs.variant_id, vs.activity, n_events, first_eid, coalesce(list(role || ':' || otype ORDER BY role, otype) FILTER (role <> 'unknown'), []) AS types, coalesce(list(m ORDER BY role, otype) FILTER (role <> 'unknown'), []) AS many
  FROM vs JOIN parts ON parts.eid = vs.first_eid GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (ORDER BY activity, first_eid, variant_id) AS idx FROM sig
), below AS (
  SELECT p.idx AS p, q.idx AS q, p.many = q.many AS equal FROM placed p JOIN placed q ON p.activity = q.activity AND p.types = q.types AND p.idx <> q.idx
  WHERE len(list_filter(list_zip(p.many, q.many), lambda z: z[1] > z[2])) = 0
), over AS (SELECT p, q FROM below WHERE NOT equal OR q > p
), parent AS (SELECT p, min(q) AS q FROM over WHERE q > p OR q NOT IN (SELECT p FROM over) GROUP BY p
), chase AS (SELECT idx, idx AS rep FROM placed UNION SELECT idx, parent.q FROM chase JOIN parent ON parent.p = rep
), reps AS (SELECT idx, rep FROM chase WHERE rep NOT IN (SELECT p FROM parent))"""


@_register("keep_general", f"WITH RECURSIVE {_GENERAL}, sums AS (SELECT rep, sum(n_events) AS n FROM reps JOIN placed USING (idx) GROUP BY rep) SELECT variant_id, activity, CAST(n AS BIGINT) AS n_events FROM placed JOIN sums ON rep = idx")
def keep_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = cut(variants.variants(_variant_events(spark, sf_dir, True)), "variants")
    return filters.keep_general(kinds).select("variant_id", "activity", "n_events")


# --- mass balance and waste ----------------------------------------------------------------

_TOTALS = "coalesce(sum(mass) FILTER (role = 'initial'), 0) AS i, coalesce(sum(mass) FILTER (role = 'final'), 0) AS f"


@_register("mass_totals", f"WITH {_R}, {_MASS} SELECT CAST(i AS DOUBLE) AS initial_mass, CAST(f AS DOUBLE) AS final_mass FROM (SELECT {_TOTALS} FROM roles JOIN mass USING (oid))")
def mass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    return massbalance.mass_totals(role_ops.roles(log.relations), log.masses()).select(*(F.col(c).cast("double").alias(c) for c in ("initial_mass", "final_mass")))


@_register("unknown_mass", f"WITH {_R}, {_MASS} SELECT otype, CAST(sum(mass) AS DOUBLE) AS mass FROM roles JOIN mass USING (oid) WHERE role = 'unknown' GROUP BY otype")
def unknown_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    return massbalance.unknown_mass(role_ops.roles(log.relations), log.masses()).select("otype", F.col("mass").cast("double").alias("mass"))


_VERDICT = f"""tot AS (SELECT {_TOTALS} FROM roles JOIN mass USING (oid)
), unk AS (SELECT otype, mass, row_number() OVER (ORDER BY first) - 1 AS k, count(*) OVER () AS n FROM (
  SELECT otype, sum(mass) AS mass, min(struct_pack(e := eid, o := oid)) AS first FROM roles JOIN mass USING (oid) WHERE role = 'unknown' GROUP BY otype)
), tried AS (
  SELECT m, abs(max(i) - max(f) + coalesce(sum(CASE WHEN (m >> (n - 1 - k)) & 1 = 1 THEN -mass ELSE mass END), 0)) AS d
  FROM range(CAST(pow(2, (SELECT count(*) FROM unk)) AS BIGINT)) t(m) CROSS JOIN tot LEFT JOIN unk ON true GROUP BY m
), best AS (SELECT m FROM tried ORDER BY d, m LIMIT 1
), verdict AS (SELECT otype, CASE WHEN (m >> (n - 1 - k)) & 1 = 1 THEN 'final' ELSE 'initial' END AS side FROM unk CROSS JOIN best)"""


@_register("mfa_verdict", f"WITH {_R}, {_MASS}, {_VERDICT} SELECT otype, side FROM verdict")
def mfa_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    balance = massbalance.resolve(_cut_roles(spark, sf_dir), log.masses())
    return spark.createDataFrame(sorted(balance.verdict.items()), "otype string, side string")


_RESOLVED = f"""{_R}, {_MASS}, {_VERDICT}, resolved AS (
  SELECT r.* REPLACE (CASE WHEN role = 'unknown' THEN side ELSE role END AS role) FROM roles r LEFT JOIN verdict USING (otype))"""


@_register("roles_resolved", f"WITH {_RESOLVED} SELECT activity, otype, role, count(*) AS n FROM resolved GROUP BY ALL")
def roles_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    balance = massbalance.resolve(_cut_roles(spark, sf_dir), log.masses())
    return balance.roles.groupBy("activity", "otype", "role").agg(F.count("*").alias("n"))


@_register("system_count", f"WITH {_R} SELECT count(*) FILTER (role = 'initial') AS initial_count, count(*) FILTER (role = 'final') AS final_count FROM roles")
def system_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waste.system_count(_order_roles(spark, sf_dir))


@_register("system_mass", f"WITH {_R}, {_MASS} SELECT CAST(i AS DOUBLE) AS initial_mass, CAST(f AS DOUBLE) AS final_mass FROM (SELECT {_TOTALS} FROM roles JOIN mass USING (oid) WHERE otype IN ('item', 'order'))")
def system_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    return waste.system_mass(role_ops.roles(log.relations), log.masses(), ["item", "order"]).select(*(F.col(c).cast("double").alias(c) for c in ("initial_mass", "final_mass")))


@_register("explicit_waste", f"WITH {_V} SELECT variant_id, CAST(3 * count(*) AS DOUBLE) AS total, CAST(3 AS DOUBLE) AS average FROM vev WHERE activity = 'Ship' GROUP BY variant_id")
def explicit_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    events = cut(_variant_events(spark, sf_dir).where("activity = 'Ship'").select("eid", "activity", "variant_id"), "variant-events")
    return waste.explicit_waste(events, log.events, "Ship", "mass").select("variant_id", F.col("total").cast("double").alias("total"), F.col("average").cast("double").alias("average"))


_SIGNED = "CASE WHEN role IN ('input', 'initial') THEN 1 WHEN role IN ('output', 'final') THEN -1 ELSE 0 END"


@_register("implicit_count", f"WITH {_V} SELECT variant_id, CAST(sum({_SIGNED}) AS BIGINT) AS total FROM vev JOIN roles USING (eid) WHERE vev.activity = 'Ship' GROUP BY variant_id")
def implicit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_labelled(spark, sf_dir).where("activity = 'Ship'").select("eid", "activity", "role", "variant_id"), "roles")
    return waste.implicit_count(found, found, "Ship")


@_register("implicit_mass", f"""WITH {_V}, {_MASS}, each AS (SELECT variant_id, eid, sum({_SIGNED} * mass) AS d FROM vev JOIN roles USING (eid) JOIN mass USING (oid) WHERE vev.activity = 'Ship' GROUP BY ALL)
SELECT variant_id, CAST(sum(d) AS DOUBLE) AS total, round(CAST(sum(d) AS DOUBLE) / count(*), 4) AS average FROM each GROUP BY variant_id""")  # fmt: skip
def implicit_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    found = cut(_labelled(spark, sf_dir).where("activity = 'Ship'").select("eid", "activity", "role", "oid", "variant_id"), "roles")
    got = waste.implicit_mass(found, log.masses(), found, "Ship")
    return got.select("variant_id", F.col("total").cast("double").alias("total"), F.round(F.col("average").cast("double"), 4).alias("average"))


@_register("type_count", f"WITH {_V} SELECT variant_id, role, count(*) AS total FROM vev JOIN roles USING (eid) WHERE otype = 'item' AND role IN ('initial', 'final') GROUP BY ALL")
def type_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shipment that is all of its objects' lives makes its items initial and final at once."""
    found = _labelled(spark, sf_dir)
    return waste.type_count(found, found, "item", check=False)


@_register("type_mass", f"WITH {_V}, {_MASS} SELECT variant_id, role, CAST(sum(mass) AS DOUBLE) AS total, round(CAST(sum(mass) AS DOUBLE) / count(*), 4) AS average, round(CAST(sum(mass) AS DOUBLE) / count(*), 2) AS rounded FROM vev JOIN roles USING (eid) JOIN mass USING (oid) WHERE otype = 'item' AND role IN ('initial', 'final') GROUP BY ALL")
def type_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    found = _labelled(spark, sf_dir)
    got = waste.type_mass(found, log.masses(), found, "item", check=False)
    return got.select("variant_id", "role", F.col("total").cast("double").alias("total"), F.round(F.col("average").cast("double"), 4).alias("average"), F.col("rounded").cast("double").alias("rounded"))


# --- attributes as of a time ------------------------------------------------------------------


def _as_of(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = user_log(spark, sf_dir)
        probes = log.relations.where("activity <> 'purchase'").select("oid", "ts", "eid")
        return asof.value_as_of(probes, log.object_changes, log.objects, "value", mode).select("eid", "oid", F.col("value").cast("double").alias("value"))

    return query


def _as_of_sql(when: str, pick: str, other: str = "0") -> str:
    return f"""WITH c AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'purchase')
SELECT CAST(p.event_id AS VARCHAR) AS eid, 'u' || p.user_id AS oid,
  coalesce({pick}(c.value, c.event_id) FILTER (c.ts {when} p.ts), {other}) AS value
FROM events p LEFT JOIN c ON c.user_id = p.user_id WHERE p.event_type <> 'purchase' GROUP BY p.event_id, p.user_id"""


_register("asof_before", _as_of_sql("<", "max_by"))(_as_of(asof.BEFORE))
_register("asof_before_current", _as_of_sql("<=", "max_by"))(_as_of(asof.BEFORE_AND_CURRENT))
_register("asof_next", _as_of_sql(">", "min_by", "max_by(c.value, c.event_id), 0"))(_as_of(asof.NEXT))


@_register("prev_same_activity", """SELECT CAST(a.event_id AS VARCHAR) AS eid, CAST(max(b.event_id) OVER (PARTITION BY a.event_type ORDER BY a.ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS VARCHAR) AS previous_eid
FROM events a JOIN events b USING (event_id)""")  # fmt: skip
def prev_same_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.previous_event(user_log(spark, sf_dir).events)


@_register("running_balance", """WITH u AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18, 2)) AS m FROM lineitem
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, m) AS seq FROM u)
SELECT 'o' || k AS oid, seq, CAST(1000000 - sum(m * 1.02) OVER (PARTITION BY k ORDER BY seq) AS DOUBLE) AS balance FROM r""")  # fmt: skip
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mass = F.col("l_quantity").cast("decimal(18,2)")
    uses = lines.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("oid"), "l_linenumber", "l_partkey", "l_suppkey", mass.alias("mass"))
    uses = uses.withColumn("seq", F.row_number().over(Window.partitionBy("oid").orderBy("l_linenumber", "l_partkey", "l_suppkey", "mass")).cast("long"))
    base = uses.select("oid").distinct().withColumn("mass", F.lit(1_000_000).cast("decimal(18,2)"))
    return asof.running_balance(base, uses).select("oid", "seq", F.col("balance").cast("double").alias("balance"))


# --- nets --------------------------------------------------------------------------------------

_ALIVE = f"""{_V}, ranked AS (
  SELECT *, min(first_eid) OVER (PARTITION BY activity) AS act_order FROM vs
), raw AS (
  SELECT variant_id, a.activity, role, otype, m, n, act_order, first_eid,
    CASE WHEN role = 'input' THEN near WHEN role = 'initial' THEN '' ELSE a.activity END AS ins,
    CASE WHEN role = 'output' THEN near WHEN role = 'final' THEN '' ELSE a.activity END AS outs
  FROM (SELECT variant_id, activity, role, otype, m, sum(n) AS n, coalesce(string_agg(DISTINCT adj, ',' ORDER BY adj) FILTER (adj IN (SELECT activity FROM vs)), '') AS near FROM assoc GROUP BY ALL) a JOIN ranked USING (variant_id)
), places AS (
  SELECT *, row_number() OVER (ORDER BY act_order, first_eid, list_position(['input', 'output', 'initial', 'final', 'unknown'], role), otype) AS idx FROM raw)"""


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = _counts(spark, sf_dir)
    return variants.counted_variants(counts), variants.counted_associations(counts)


def _joined_names(*columns: str) -> list:
    return [F.array_join(c, ",").alias(c) for c in columns]


@_register("net_places_raw", f"WITH {_ALIVE} SELECT CAST(idx AS INTEGER) AS idx, variant_id, role, otype, ins, outs, CAST(n AS BIGINT) AS n FROM places")
def net_places_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nets.raw_places(*_pieces(spark, sf_dir)).select("idx", "variant_id", "role", "otype", *_joined_names("ins", "outs"), "n")


@_register("net_self_loops", f"""WITH {_ALIVE} SELECT p.variant_id, p.otype, CAST(p.idx AS INTEGER) AS p, CAST(q.idx AS INTEGER) AS q FROM places p JOIN places q USING (variant_id, otype)
WHERE p.role = 'input' AND q.role = 'output' AND list_contains(string_split(p.ins, ','), p.activity) AND list_contains(string_split(q.outs, ','), q.activity)""")  # fmt: skip
def net_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nets.self_loops(nets.raw_places(*_pieces(spark, sf_dir)))


_NET = _ALIVE + """, loops AS (
  SELECT p.variant_id, p.idx AS p, q.idx AS q, row_number() OVER (ORDER BY p.idx) + (SELECT max(idx) FROM places) AS idx, p.otype, p.ins, q.outs, p.n, p.m AS m_in, q.m AS m_out, p.activity
  FROM places p JOIN places q USING (variant_id, otype) WHERE p.role = 'input' AND q.role = 'output'
    AND list_contains(string_split(p.ins, ','), p.activity) AND list_contains(string_split(q.outs, ','), q.activity)
), gone AS (SELECT p AS idx FROM loops UNION ALL SELECT q FROM loops
), listed AS (
  SELECT idx, otype, ins, outs, role = 'initial' AS is_initial, role = 'final' AS is_final, role = 'unknown' AS is_unknown, n FROM places WHERE idx NOT IN (SELECT idx FROM gone)
  UNION ALL SELECT idx, otype, ins, outs, false, false, false, n FROM loops
), sides AS (
  SELECT *, otype || is_initial || is_final || is_unknown AS kind, CASE WHEN ins = '' THEN [] ELSE string_split(ins, ',') END AS li, CASE WHEN outs = '' THEN [] ELSE string_split(outs, ',') END AS lo FROM listed
), below AS (
  SELECT p.idx AS p, q.idx AS q, list_has_all(p.li, q.li) AND list_has_all(p.lo, q.lo) AS equal
  FROM sides p JOIN sides q ON p.kind = q.kind AND p.idx <> q.idx WHERE list_has_all(q.li, p.li) AND list_has_all(q.lo, p.lo)
), over AS (SELECT p, q FROM below WHERE NOT equal OR q > p
), parent AS (SELECT p, min(q) AS q FROM over WHERE q > p OR q NOT IN (SELECT p FROM over) GROUP BY p
), chase AS (
  SELECT idx, idx AS rep FROM sides UNION SELECT idx, parent.q FROM chase JOIN parent ON parent.p = rep
), reps AS (SELECT idx, rep FROM chase WHERE rep NOT IN (SELECT p FROM parent)
), arcs0 AS (
  SELECT idx, variant_id AS transition, activity, CASE WHEN role IN ('output', 'final') THEN 'out' ELSE 'in' END AS direction, m FROM places WHERE idx NOT IN (SELECT idx FROM gone)
  UNION ALL SELECT idx, variant_id, activity, 'in', m_in FROM loops UNION ALL SELECT idx, variant_id, activity, 'out', m_out FROM loops
), arcs1 AS (SELECT DISTINCT rep AS idx, transition, activity, direction, m FROM arcs0 JOIN reps USING (idx)
), kept AS (SELECT s.* FROM sides s JOIN reps r ON s.idx = r.idx AND r.rep = s.idx
), takes AS (SELECT DISTINCT idx, activity FROM arcs1 WHERE direction = 'in'
), missing AS (
  SELECT * FROM (SELECT idx AS p, otype, unnest(lo) AS activity FROM kept) x WHERE NOT EXISTS (SELECT 1 FROM takes t WHERE t.idx = x.p AND t.activity = x.activity)
), silent AS (
  SELECT DISTINCT p, t.idx AS q FROM missing m JOIN takes t USING (activity) JOIN kept k ON k.idx = t.idx AND k.otype = m.otype AND NOT k.is_initial AND k.idx <> m.p
), arcs AS (
  SELECT transition, CAST(idx AS INTEGER) AS place, direction, CAST(m AS INTEGER) AS multiplicity FROM arcs1
  UNION ALL SELECT 'silent#' || p || '#' || q, CAST(p AS INTEGER), 'in', 1 FROM silent UNION ALL SELECT 'silent#' || p || '#' || q, CAST(q AS INTEGER), 'out', 1 FROM silent
)"""


def _net(spark: SparkSession, sf_dir: str) -> nets.FlowNet:
    return nets.build(*_pieces(spark, sf_dir))


@_register("net_places", f"WITH RECURSIVE {_NET} SELECT CAST(idx AS INTEGER) AS place, otype, ins, outs, is_initial, is_final, is_unknown, CAST(n AS BIGINT) AS n FROM kept")
def net_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir).places.select("place", "otype", *_joined_names("ins", "outs"), "is_initial", "is_final", "is_unknown", "n")


@_register("net_arcs", f"WITH RECURSIVE {_NET} SELECT * FROM arcs")
def net_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir).arcs


@_register("net_silent", f"WITH RECURSIVE {_NET} SELECT * FROM arcs WHERE transition LIKE 'silent#%'")
def net_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of the silent transitions."""
    net = _net(spark, sf_dir)
    return net.arcs.join(net.transitions.where("activity is null").select("transition"), "transition")


@_register("net_stats", f"""WITH RECURSIVE {_NET}, c AS (SELECT (SELECT count(*) FROM kept) AS np, (SELECT count(*) FROM vs) AS nv, (SELECT count(*) FROM silent) AS ns, (SELECT count(*) FROM arcs) AS na
), d AS (SELECT max(k) AS maximum_degree FROM (SELECT count(*) AS k FROM arcs GROUP BY transition, direction)
), a AS (SELECT activity AS most_duplicated, count(*) AS duplicates FROM vs GROUP BY activity ORDER BY 2 DESC, 1 LIMIT 1)
SELECT np + nv + ns AS total_nodes, np + nv + ns + na AS total_size, maximum_degree, ns / (nv + ns) AS silent_ratio, most_duplicated, duplicates,
  1 / (1 + greatest(2 * na / (np + nv + ns) - 2, 0)) AS simplicity FROM c, d, a""")
def net_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _net(spark, sf_dir)
    return nets.statistics(net).join(nets.simplicity(net))  # rows of one each


# --- conformance ---------------------------------------------------------------------------------

_COMPONENTS = """SELECT oid, min(oid) OVER (PARTITION BY eid_group) AS component FROM (
  SELECT 'o' || o_orderkey AS oid, 'c' || o_custkey AS eid_group FROM orders UNION SELECT 'c' || o_custkey, 'c' || o_custkey FROM orders)"""


@_register("related_objects", _COMPONENTS)
def related_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers that placements link: every customer with their orders."""
    log = filters.drop_object_types(filters.drop_activities(order_log(spark, sf_dir), ["Ship"]), ["item"])
    return conformance.related_objects(log)


_CASES = """it AS (SELECT DISTINCT l_orderkey || l_returnflag AS eid, 'i' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS oid FROM lineitem
), e AS (SELECT DISTINCT a.oid AS x, b.oid AS y FROM it a JOIN it b USING (eid)
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x AS oid, min(y) AS component FROM r GROUP BY x
), s AS (SELECT *, (row_number() OVER (PARTITION BY component ORDER BY oid) - 1) // 50 AS chunk FROM c)
, cases AS (SELECT oid, string_agg(oid, '-') OVER (PARTITION BY component, chunk ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS case_id FROM s)"""


@_register("case_ids", f"WITH RECURSIVE {_CASES} SELECT * FROM cases")
def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.cases(conformance.related_objects(order_log(spark, sf_dir), "item"))


@_register("case_log", f"WITH RECURSIVE {_REL}, {_CASES} SELECT case_id, activity, epoch_us(ts) AS ts_us, eid FROM rel LEFT JOIN cases USING (oid) WHERE otype = 'item'")
def case_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' relations, relabelled by case."""
    log = order_log(spark, sf_dir)
    rows = conformance.flattened(log, "item", conformance.cases(conformance.related_objects(log, "item")))
    return rows.select("case_id", "activity", F.unix_micros("ts").alias("ts_us"), "eid")


@_register("group_markings", f"""WITH RECURSIVE {_NET}, {_INSTANCES}, {_CASES}, tok AS (
  SELECT i.oid, k.idx AS place, 'initial' AS side FROM inst i JOIN arcs1 a ON a.transition = i.initial_variant_id JOIN kept k ON k.idx = a.idx AND k.is_initial AND k.otype = 'item' WHERE i.otype = 'item'
  UNION ALL SELECT i.oid, k.idx, 'final' FROM inst i JOIN arcs1 a ON a.transition = i.final_variant_id JOIN kept k ON k.idx = a.idx AND k.is_final AND k.otype = 'item' WHERE i.otype = 'item')
SELECT case_id, CAST(place AS INTEGER) AS place, side, count(*) AS n FROM tok JOIN cases USING (oid) GROUP BY ALL""")
def group_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    found = cut(_labelled(spark, sf_dir), "roles")
    counts = cut(variants.counted(found), "counts")
    net = nets.build(variants.counted_variants(counts), variants.counted_associations(counts))
    case_of = conformance.cases(conformance.related_objects(log, "item"))
    return conformance.markings(net, variants.object_instances(found, found, check=False), case_of, "item")


# every case of every type, aligned by a walk over positions and markings (lists of tokens by place); the bounds of cost are above what any case needs
_FIT = f"""{_NET.replace(_V, f"{_RESOLVED}, {_variants_sql(roles='resolved')}")}, {_INSTANCES.replace("roles", "resolved")}, {_CASES}, case_of AS (
  SELECT oid, case_id, 'item' AS otype FROM cases UNION ALL SELECT DISTINCT oid, oid, otype FROM rel WHERE otype <> 'item'
), traces AS (SELECT otype, case_id, list(activity ORDER BY ts, eid) AS trace FROM rel JOIN case_of USING (oid, otype) GROUP BY ALL
), spots AS (SELECT otype, list(idx ORDER BY idx) AS ps FROM kept GROUP BY otype
), ends AS (
  SELECT otype, case_id, a.place, 'initial' AS side FROM inst JOIN case_of USING (oid, otype) JOIN arcs a ON a.transition = initial_variant_id JOIN kept USING (otype) WHERE kept.idx = a.place AND is_initial
  UNION ALL SELECT otype, case_id, a.place, 'final' FROM inst JOIN case_of USING (oid, otype) JOIN arcs a ON a.transition = final_variant_id JOIN kept USING (otype) WHERE kept.idx = a.place AND is_final
), marked AS (
  SELECT t.otype, trace, list_transform(ps, lambda p: len(list_filter(coalesce(b, []), lambda x: x = p))) AS s, list_transform(ps, lambda p: len(list_filter(coalesce(e, []), lambda x: x = p))) AS g
  FROM traces t JOIN spots USING (otype) LEFT JOIN (SELECT otype, case_id, list(place) FILTER (side = 'initial') AS b, list(place) FILTER (side = 'final') AS e FROM ends GROUP BY ALL) USING (otype, case_id)
), class AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM (SELECT otype, trace, s, g, count(*) AS n FROM marked GROUP BY ALL)
), shape AS MATERIALIZED (
  SELECT DISTINCT otype, label, list_transform(ps, lambda p: len(list_filter(i, lambda x: x = p))) AS need, list_transform(ps, lambda p: len(list_filter(o, lambda x: x = p))) AS made
  FROM (SELECT otype, transition, CASE WHEN transition NOT LIKE 'silent#%' THEN split_part(transition, '#', 1) END AS label, coalesce(list(place) FILTER (direction = 'in'), []) AS i, coalesce(list(place) FILTER (direction = 'out'), []) AS o
    FROM (SELECT DISTINCT transition, place, direction FROM arcs) JOIN kept ON idx = place GROUP BY ALL) JOIN spots USING (otype)
), walk AS (
  SELECT DISTINCT otype, s, s AS m, 0 AS c FROM class
  UNION SELECT w.otype, s, list_transform(list_zip(m, need, made), lambda x: x[1] - x[2] + x[3]), c + CAST(label IS NOT NULL AS INTEGER)
  FROM walk w JOIN shape h ON h.otype = w.otype AND list_min(list_transform(list_zip(m, need), lambda x: x[1] - x[2])) >= 0 WHERE c + CAST(label IS NOT NULL AS INTEGER) <= 10
), worst AS (SELECT otype, s, m AS g, min(c) AS w FROM walk GROUP BY ALL
), search AS (
  SELECT k, 0 AS pos, s AS m, 0 AS c FROM class
  UNION SELECT k, pos + step, CASE WHEN lone THEN m ELSE list_transform(list_zip(m, need, made), lambda x: x[1] - x[2] + x[3]) END, c + cost FROM (
    SELECT z.k, pos, m, c, false AS lone, need, made, step, CASE WHEN step = 0 AND label IS NOT NULL THEN 1 ELSE 0 END AS cost
    FROM search z JOIN class x ON x.k = z.k JOIN shape h ON h.otype = x.otype AND list_min(list_transform(list_zip(m, need), lambda y: y[1] - y[2])) >= 0, (VALUES (0), (1)) t(step)
    WHERE (step = 0 OR (pos < len(trace) AND label = trace[pos + 1])) AND list_sum(m) <= list_sum(g) + 2 * (len(trace) - pos + 4 - c)
    UNION ALL SELECT z.k, pos, m, c, true, NULL, NULL, 1, 1 FROM search z JOIN class x ON x.k = z.k WHERE pos < len(trace)) WHERE c + cost <= 3
), least AS (SELECT k, min(c) AS c FROM search JOIN class x USING (k) WHERE pos = len(trace) AND m = g GROUP BY k
), fits AS (
  SELECT otype, n, CASE WHEN w IS NULL THEN 0.0 WHEN w + len(trace) = 0 THEN 1.0 ELSE 1 - CAST(c AS DOUBLE) / (w + len(trace)) END AS fitness
  FROM class LEFT JOIN worst USING (otype, s, g) LEFT JOIN least USING (k)
)"""


def _fitness_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness of every case of every type of the order log.

    Orders' dates are days, so a customer may have several last placements, each a final
    output; the last of them by event id is the one that marks the case.
    """
    log = order_log(spark, sf_dir)
    log = log.replaced(relations=cut(log.relations, "relations"), objects=cut(log.objects, "objects"))
    roles = massbalance.resolve(cut(role_ops.roles(log.relations), "roles"), log.masses()).roles
    roles = cut(variants.named(variants.labelled(roles)), "labelled")
    counts = cut(variants.counted(roles), "counts")
    instances = cut(variants.object_instances(roles, roles, check=False), "instances")
    return conformance.fitness_of_types(log, nets.build(variants.counted_variants(counts), variants.counted_associations(counts)), instances)


@_register("fitness", f"WITH RECURSIVE {_FIT} SELECT otype, round(fitness, 6) AS fitness, CAST(sum(n) AS BIGINT) AS cases FROM fits GROUP BY ALL")
def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each fitness, for every object type of the order log."""
    each = _fitness_of_types(spark, sf_dir)
    return each.groupBy("otype", F.round("fitness", 6).alias("fitness")).agg(F.count("*").alias("cases"))


@_register("fitness_mean", f"WITH RECURSIVE {_FIT} SELECT round(avg(f), 6) AS fitness FROM (SELECT sum(n * fitness) / sum(n) AS f FROM fits GROUP BY otype)")
def fitness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the types' mean fitness, over three types."""
    return conformance.mean_fitness(_fitness_of_types(spark, sf_dir)).select(F.round("fitness", 6).alias("fitness"))


_INK = " + ".join(f"{w} * CASE WHEN {v} > 0.03928 THEN pow({v}, 2.4) ELSE {v} / 12.92 END" for w, v in ((0.2126, "r / 255"), (0.7152, "g / 255"), (0.0722, "b / 255")))


@_register("net_drawing", f"""WITH RECURSIVE {_NET}, types AS (SELECT otype, row_number() OVER (ORDER BY min(idx)) AS k FROM places GROUP BY otype
), dealt AS (SELECT otype, CASE k WHEN 1 THEN '#ffa500' WHEN 2 THEN '#7b68ee' WHEN 3 THEN '#eec900' END AS colour FROM types
), looks AS (SELECT otype, colour, CASE WHEN ({_INK} + 0.05) / 0.05 > 1.05 / ({_INK} + 0.05) THEN '#000000' ELSE '#ffffff' END AS ink
  FROM (SELECT *, CAST('0x' || colour[2:3] AS INTEGER) AS r, CAST('0x' || colour[4:5] AS INTEGER) AS g, CAST('0x' || colour[6:7] AS INTEGER) AS b FROM dealt))
SELECT 'place' AS kind, CAST(idx AS INTEGER) AS place, NULL AS transition, NULL AS direction, otype AS label, CASE WHEN is_final THEN 'doubleoctagon' WHEN is_initial THEN 'octagon' ELSE 'circle' END AS shape, colour, ink, NULL AS style, CAST(NULL AS DOUBLE) AS width,
  replace(ins, ',', ', ') || ' → ' || replace(outs, ',', ', ') AS help FROM kept JOIN looks USING (otype)
UNION ALL SELECT 'transition', NULL, variant_id, NULL, activity, 'box', NULL, NULL, NULL, NULL, n_events || ' events' FROM vs
UNION ALL SELECT DISTINCT 'transition', NULL, transition, NULL, 'τ', 'box', '#000000', '#ffffff', NULL, NULL, NULL FROM arcs WHERE transition LIKE 'silent#%'
UNION ALL SELECT 'arc', place, transition, direction, NULL, NULL, colour, NULL, CASE WHEN is_unknown THEN 'dashed' END, CASE WHEN multiplicity > 1 THEN 4.0 END, NULL FROM arcs JOIN kept ON idx = place JOIN looks USING (otype)""")  # fmt: skip
def net_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and arcs of the net with shape, colour, ink and style."""
    return render.drawing(_net(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all arcs of the net discovered from the order log."""
    return net_arcs(spark, sf_dir)
