"""Exact top-k inner products by best-first search of paged M-trees.

Vectors are scaled to integers. With M the largest norm, x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0) satisfy |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product
is the nearest neighbour in a metric space, where an M-tree applies.

Rows are dealt evenly to shards of bounded size, and each shard is bulk-loaded into
pages. An inner page holds routing objects with covering radii and their distances to
the page's own routing object; a leaf page holds vectors with theirs. A search keeps a
queue of pages by least possible distance. An entry is skipped without computing its
distance d(q, e) when |d(q, parent) - d(e, parent)| - radius already exceeds the k-th
best distance. Distances only prune, with a margin for rounding; scores are exact
integers, and ties go to the smaller id.

Queries form blocks of bounded size; each block meets each shard once. Blocks hold as many
rows as shards do, so that pages (copied for each block) and queries (for each shard) cost
alike; there are more only where shards and blocks would be fewer than cores. A first round
searches one shard for each query, and its k-th score bounds the search of the others.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors of different lengths are not comparable, so a query sees those of its own
length; vectors without components have score 0 with each other. A row with the query's
id counts as the query's own. Repeated candidate rows each take a place; a repeated
query id is answered once, for the least of its vectors. Components must satisfy
|256 x| < 2**63, and inner products beyond 2**63 are not supported.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written


@dataclass(frozen=True)
class TreeSettings:
    k: int = 5
    scale: int = 256
    page: int = 512
    fanout: int = 24
    shard_rows: int = 40_000
    block_rows: int = 40_000
    spread_rows: int = 500  # no block is made smaller than this for the sake of idle cores


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, settings: TreeSettings) -> DataFrame:
    """vec_id, v (array of longs), dim; only vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    scaled = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return scaled.where(whole).select("vec_id", F.transform("x", lambda c: F.floor(c * settings.scale).cast("long")).alias("v"), F.size("x").alias("dim"))


class Tree:
    """Pages of one shard. Page p: rows[p] (vectors or routing objects), children (or None)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, settings: TreeSettings) -> None:
        self.ids, self.vectors, self.settings, self.top = ids, vectors, settings, top
        self.lift = np.sqrt(np.maximum(top - (vectors.astype(np.float64) ** 2).sum(axis=1), 0.0))
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[int] | None]] = []
        self.rng = np.random.default_rng(len(ids))
        self.float = vectors.astype(np.float64)
        self.root = self._load(np.arange(len(ids)), None)

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        gap = self.float[rows] - self.float[pivot]
        return np.sqrt((gap * gap).sum(axis=1) + (self.lift[rows] - self.lift[pivot]) ** 2)

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        """Bulk loading: rows go to the nearest of some of them, until they fit a page."""
        if len(rows) <= self.settings.page:
            far = self._distance(rows, parent) if parent is not None else np.zeros(len(rows))
            self.pages.append((rows, far, None, None))
            return len(self.pages) - 1
        count = min(self.settings.fanout, -(-len(rows) // self.settings.page))
        pivots = self.rng.choice(rows, count, replace=False)
        near = np.stack([self._distance(rows, p) for p in pivots]).argmin(axis=0)
        if np.bincount(near, minlength=count).max() == len(rows):  # equal vectors part anyhow
            near = np.arange(len(rows)) % count
        used = np.unique(near)
        children, radii = [], []
        for c in used:
            own = rows[near == c]
            children.append(self._load(own, int(pivots[c])))
            radii.append(self._distance(own, int(pivots[c])).max())
        chosen = pivots[used]
        far = self._distance(chosen, parent) if parent is not None else np.zeros(len(chosen))
        self.pages.append((chosen, far, np.array(radii), children))
        return len(self.pages) - 1

    def dump(self) -> Iterator[tuple]:
        """One record a page: number, row places, ids, vectors, parent distances, radii, children."""
        for number, (rows, far, radii, children) in enumerate(self.pages):
            yield (number, self.ids[rows].tobytes(), self.vectors[rows].astype("<i8").tobytes(), far.tobytes(), None if radii is None else radii.tobytes(), None if children is None else np.array(children, "<i4").tobytes())


class PagedSearch:
    """Best-first search over stored pages."""

    def __init__(self, pages: pd.DataFrame, dim: int, top: float, k: int) -> None:
        self.top, self.k, self.pages = top, k, {}
        biggest = 0
        for number, ids, vectors, far, radii, children in zip(*(pages[c] for c in ("page", "ids", "vectors", "far", "radii", "children")), strict=True):
            v = np.frombuffer(vectors, "<i8").reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)
            biggest = max(biggest, int(np.abs(v).max()) if v.size else 0)
            self.pages[number] = [np.frombuffer(ids, np.int64), v, np.frombuffer(far, np.float64), None if radii is None else np.frombuffer(radii, np.float64), None if children is None else np.frombuffer(children, "<i4").tolist()]
        self.root = max(self.pages)
        self.biggest = biggest
        for page in self.pages.values():
            page.append(page[1].astype(np.float64))
            page.append((page[5] ** 2).sum(axis=1))

    def find(self, own: int, q: np.ndarray, bound: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, of rows that score at least ``bound``."""
        qf = q.astype(np.float64)
        norm = float(qf @ qf)
        slack = 1e-7 * (1.0 + math.sqrt(norm) + math.sqrt(self.top))
        exact_as_float = float(np.abs(qf).max(initial=0.0)) * self.biggest * max(1, len(q)) < 2**52
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst kept is on top
        reach = math.sqrt(max(norm + self.top - 2 * bound, 0.0)) + slack if bound is not None else math.inf
        queue: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)]
        while queue:
            least, number, from_parent = heapq.heappop(queue)
            if least > reach:
                break
            ids, vectors, far, radii, children, floats, norms = self.pages[number]
            live = np.arange(len(ids))
            if from_parent >= 0:
                near = np.abs(from_parent - far)
                live = np.flatnonzero(near - (radii if radii is not None else 0.0) <= reach)
                if not len(live):
                    continue
            some = floats if len(live) == len(ids) else floats[live]
            products = some @ qf
            if children is not None:
                # |q' - e'|^2 with q' = (q, 0): the lifted part of e' adds top - |e|^2
                distance = np.sqrt(np.maximum(norm + self.top - 2 * products, 0.0))
                low = distance - radii[live] - slack
                for i, d, x in zip(live.tolist(), distance.tolist(), low.tolist(), strict=True):
                    if x <= reach:
                        heapq.heappush(queue, (max(x, 0.0), children[i], d))
                continue
            scores = np.rint(products).astype(np.int64) if exact_as_float else vectors[live] @ q
            if len(best) == self.k:
                chosen = np.flatnonzero(scores >= best[0][0])
            elif bound is not None:
                chosen = np.flatnonzero(scores >= bound)
            else:
                chosen = np.arange(len(scores))
            for score, name in zip(scores[chosen].tolist(), ids[live[chosen]].tolist(), strict=True):
                if name == own:
                    continue
                entry = (score, -name)
                if len(best) < self.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == self.k:
                reach = min(reach, math.sqrt(max(norm + self.top - 2 * best[0][0], 0.0)) + slack)
        return sorted(((s, -n) for s, n in best), key=lambda e: (-e[0], e[1]))


_PAGES = "dim int, shard int, page int, ids binary, vectors binary, far binary, radii binary, children binary"


def build(vectors: DataFrame, shards: int, top: float, settings: TreeSettings) -> DataFrame:
    """Pages of all trees, one tree for each vector length and shard."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        data = np.array(group["v"].tolist(), dtype=np.int64).reshape(len(group), int(key[0]))
        rows = list(Tree(group["vec_id"].to_numpy(), data, top, settings).dump())
        out = pd.DataFrame(rows, columns=["page", "ids", "vectors", "far", "radii", "children"])
        out.insert(0, "shard", int(key[1]))
        out.insert(0, "dim", int(key[0]))
        return out

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(run, _PAGES)


def _search(pages: DataFrame, queries: DataFrame, top: float, settings: TreeSettings) -> DataFrame:
    """Best rows of each (query, shard); queries: query_id, v, dim, shard, block, bound."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = PagedSearch(left, int(key[0]), top, settings.k)
            for name, v, bound in zip(right["query_id"], right["v"], right["bound"], strict=True):
                limit = None if pd.isna(bound) else int(bound)
                out += [(name, n, s) for s, n in tree.find(int(name), np.array(v, dtype=np.int64), limit)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ("dim", "shard", "block")
    queries = written(queries.select("query_id", "v", "bound", *keys), "queries")
    blocks = queries.groupBy("dim", "shard").agg(F.collect_set("block").alias("blocks"))
    dealt = pages.join(blocks, ["dim", "shard"]).withColumn("block", F.explode("blocks")).drop("blocks")
    return dealt.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    ``is_query`` is a condition on vec_id. Shards and blocks follow from the row counts.
    """
    spark = ship(vectors.sparkSession)
    whole = written(integer_vectors(vectors, id_col, vec_col, settings), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows, top, asked = whole.agg(F.count("*"), F.max(norm), F.count(F.when(is_query, 1))).first()
    if not rows or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(top) * (1 + 1e-12)
    shards = -(-rows // settings.shard_rows)
    pages = written(build(whole, shards, top, settings), "pages")
    spread = min(-(-spark.sparkContext.defaultParallelism // shards), -(-asked // settings.spread_rows))
    blocks = max(-(-asked // settings.block_rows), spread)
    queries = whole.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    home = queries.withColumn("shard", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int"))
    if shards == 1:
        found = _search(pages, home.withColumn("bound", F.lit(None).cast("long")), top, settings)
    else:
        first = written(_search(pages, home.withColumn("bound", F.lit(None).cast("long")), top, settings), "first")
        bound = first.groupBy("query_id").agg(F.when(F.count("*") >= settings.k, F.min("score")).alias("bound"))
        rest = home.withColumnRenamed("shard", "_home").join(bound, "query_id", "left")
        rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> _home")
        found = first.unionAll(_search(pages, rest.drop("_home"), top, settings))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
