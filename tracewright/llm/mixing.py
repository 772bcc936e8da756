"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Documents are the leaves' contents of a tree root - domain - language - source. A
token budget flows down: children share their parent's budget by integer weights, no
child gets more than its subtree can supply (tokens times ``epochs``), and what a child
cannot use goes to its siblings by their weights. A parent is short only when all its
children are exhausted, and its shortage is then shared among its own siblings.

For a parent's children in ascending order of capacity / weight, child i is exhausted
iff capacity_i * (weights of i and later) <= (budget less capacities before i) * weight_i;
the exhausted ones come first, so running sums give the shares in closed form. Shares
of the others are rounded cumulatively, so that children's budgets sum to the parent's.

A leaf takes whole passes (epochs) over its documents, then the token-prefix of one more
pass in an order seeded by (seed, epoch, doc_id). Positions in that order come from
sums over hash buckets of the order key, so a leaf with a third of all rows is not
sorted in one task.

Defined results: a null text has no tokens; documents without tokens are never taken;
null languages and sources are the leaf ``unknown``; children of weight 0 get nothing;
repeated rows are each a document; a row without doc_id is ordered by its text; an empty
table gives no rows; other columns are ignored, but for those named in ``keep``. Weights are integers of at
most 10**9 each and 10**12 in sum, and tokens times epochs number below 9 * 10**18.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "language", "source")
WIDE = "decimal(38,0)"  # of products of tokens and weights, which pass a long's range


@dataclass(frozen=True)
class MixSettings:
    numerator: int = 3  # the budget is numerator / denominator of all tokens
    denominator: int = 5
    epochs: int = 2
    seed: int = 17
    bucket_digits: int = 3  # hex digits of the order key: 16**digits buckets a leaf


def share(children: DataFrame, parent: list[str], name: str, budget: Column, capacity: str, weight: str) -> DataFrame:
    """Add ``given``: each child's part of its parent's budget."""
    live = F.when(F.col(weight) > 0, F.col(capacity)).otherwise(F.lit(0))
    rows = children.withColumn("_cap", live.cast(WIDE)).withColumn("_w", F.greatest(F.col(weight), F.lit(0)).cast(WIDE))
    within = Window.partitionBy(*parent)
    order = within.orderBy(F.col("_cap").cast("double") / F.when(F.col("_w") > 0, F.col("_w").cast("double")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_total", F.least(budget, F.sum("_cap").over(within)))
    rows = rows.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    rows = rows.withColumn("_later", F.sum("_w").over(within) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    full = (F.col("_cap") * F.col("_later")).cast(WIDE) <= (F.col("_left") * F.col("_w")).cast(WIDE)
    rows = rows.withColumn("_full", full | (F.col("_w") == 0))
    rows = rows.withColumn("_rest", F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(within), F.lit(0)))
    rows = rows.withColumn("_open", F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_w")).cast(WIDE))
    rows = rows.withColumn("_sum", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_all", F.greatest(F.sum("_open").over(within), F.lit(1)).cast(WIDE))
    part = F.expr("_rest * _sum div _all - _rest * (_sum - _open) div _all")
    rows = rows.withColumn("given", F.when(F.col("_full"), F.col("_cap").cast("long")).otherwise(part))
    return rows.drop("_cap", "_w", "_total", "_left", "_later", "_full", "_rest", "_open", "_sum", "_all")


def budgets(leaves: DataFrame, budget: int, settings: MixSettings) -> DataFrame:
    """``given`` tokens of each leaf; leaves: the levels, tokens, and a weight for each level."""
    leaves = leaves.withColumn("cap", F.col("tokens") * settings.epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"{level}_weight").alias("weight"))
        if given is None:
            nodes = nodes.withColumn("parent_budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(given.withColumnRenamed("given", "parent_budget"), parent)
        given = share(nodes, parent, level, F.col("parent_budget"), "cap", "weight").select(*path, "given")
    return leaves.join(given, list(LEVELS))


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents taken: id, the levels, n_tokens, whole (passes) and prefix_tokens (of the last pass).

    ``domain`` and ``weights`` (by level) are expressions over the columns domain, language and source;
    columns named in ``keep`` come last.
    """
    unknown = F.lit("unknown")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), unknown).alias("language"), F.coalesce(F.col(source_col).cast("string"), unknown).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"), F.when(F.col(id_col).isNull(), F.md5(text_col)).alias("_name"), *keep)
    slim = written(slim.where("n_tokens > 0").withColumn("domain", domain), "words")  # words are counted once
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    for level in LEVELS:
        leaves = leaves.withColumn(f"{level}_weight", weights[level].cast("long"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, total * settings.numerator // settings.denominator, settings)
    plan = plan.select(*LEVELS, F.expr("given div tokens").alias("whole"), F.expr("given % tokens").alias("rest")).where("whole > 0 or rest > 0")

    key = F.md5(F.concat_ws(":", F.lit(settings.seed), F.col("whole") + 1, F.coalesce(F.col("doc_id").cast("string"), "_name")))
    placed = slim.join(plan, list(LEVELS)).withColumn("_key", key)
    placed = placed.withColumn("_bucket", F.substring("_key", 1, settings.bucket_digits))
    spots = [*LEVELS, "_bucket"]
    sums = placed.groupBy(*spots).agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*spots, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*spots).orderBy("_key", "doc_id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    taken = placed.join(sums, spots).withColumn("_start", start)
    prefix = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("_start")))
    out = taken.withColumn("prefix_tokens", prefix.cast("long")).where("whole > 0 or prefix_tokens > 0")
    return out.select("doc_id", *LEVELS, "n_tokens", F.col("whole").cast("long").alias("whole"), "prefix_tokens", *keep)
