"""Benchmark decontamination: a block-max WAND search of BM25-indexed test items.

Test items form the inverted index; every passage (overlapping word window) of every
training document is a query. An item's term weights are its BM25 weights divided by
their sum, so a passage that holds all of an item's words scores 1. All items that
score ``least_score`` or more are retrieved:

* items stand in order of length and form ``groups`` of neighbours; a passage whose terms'
  largest weights within a group do not add up to the threshold for any group is left at
  once (the block-max test over whole lists, done for whole batches in numpy);
* the others are searched document-at-a-time: the pivot is the first item at which the
  lists' largest weights could reach the threshold, and the weights of the pivot's
  blocks decide whether it is scored or whole blocks are skipped.

A retrieved item is verified by the share of the 5-word shingles of its question, and
of its answer, that occur in the passage: the text up to the first question mark is the
question and the rest the answer; without a question mark all of it is the question.

Items are indexed by length class (up to ``stride`` words, up to twice that, and so on), and
a class's passages are two of its strides long, one apart; so whether a document holds an
item does not depend on the lengths of other items.

The index is broadcast in blocks of at most ``block_terms`` postings, one pass over the
documents for each block, so its size is bounded whatever the number of items.

Defined results: null or empty texts and items without words match nothing; equal items
are each reported; a repeated document row is reported again; parts of an item with
fewer than five words count as one shingle; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_batches, ship
from .vectext import rolled_shingles, word_hashes


@dataclass(frozen=True)
class DecontamSettings:
    k1: float = 1.2
    b: float = 0.75
    least_score: float = 0.5
    least_overlap: float = 0.75
    width: int = 5
    block: int = 16  # postings a block
    groups: int = 64
    block_terms: int = 2_000_000
    stride: int = 64


class BlockMaxIndex:
    """Postings by term: items ascending, normalised weights, largest weight of each block."""

    def __init__(self, items: list[np.ndarray], idf: dict[int, float], mean: float, settings: DecontamSettings) -> None:
        self.settings = settings
        rows: dict[int, list[tuple[int, float]]] = {}
        for i, words in enumerate(items):
            terms, tf = np.unique(words, return_counts=True)
            norm = settings.k1 * (1 - settings.b + settings.b * len(words) / mean)
            weight = np.array([idf[int(t)] for t in terms]) * tf * (settings.k1 + 1) / (tf + norm)
            for t, w in zip(terms.tolist(), (weight / weight.sum()).tolist(), strict=True):
                rows.setdefault(t, []).append((i, w))
        self.terms = np.array(sorted(rows), dtype=np.uint64)
        self.lists = [([i for i, _ in rows[t]], [w for _, w in rows[t]]) for t in self.terms.tolist()]
        self.most = np.array([max(w) for _, w in self.lists])
        self.items = len(items)
        count = max(1, min(settings.groups, len(items) // 3))
        self.group_most = np.zeros((len(self.lists), count), dtype=np.float32)
        for t, (i, w) in enumerate(self.lists):
            np.maximum.at(self.group_most[t], np.array(i) * count // len(items), w)
        size = settings.block
        self.blocks = [([i[min(k + size, len(i)) - 1] for k in range(0, len(i), size)], [max(w[k : k + size]) for k in range(0, len(i), size)]) for i, w in self.lists]

    def span(self, group: int) -> tuple[int, int]:
        """First item of a group, and of the next one."""
        count = self.group_most.shape[1]
        return -(-group * self.items // count), -(-(group + 1) * self.items // count)

    def search(self, terms: list[int], least: float, low: int = 0, high: float = math.inf) -> list[tuple[int, float]]:
        """All (item, score) from ``low`` to below ``high`` that score ``least`` or more; terms are term numbers."""
        least -= 1e-9
        size, found = self.settings.block, []
        cursors = []  # item, position, term
        for t in terms:
            items = self.lists[t][0]
            at = bisect_left(items, low) if low else 0
            if at < len(items) and items[at] < high:
                cursors.append([items[at], at, t])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for c in cursors[: pivot + 1]:
                lasts, most = self.blocks[c[2]]
                k = c[1] // size
                while k < len(lasts) and lasts[k] < item:
                    k += 1
                if k < len(lasts):
                    bound += most[k]
                    until = min(until, lasts[k] + 1)
            if bound >= least:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._advance(c, item)
                    if c[0] == item:
                        score += self.lists[c[2]][1][c[1]]
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                target = max(item + 1, until)
            for c in cursors[: pivot + 1]:
                self._advance(c, target)
            cursors = [c for c in cursors if c[0] < high]
        return found

    def _advance(self, cursor: list, target) -> None:
        items, at = self.lists[cursor[2]][0], cursor[1]
        lasts, k = self.blocks[cursor[2]][0], at // self.settings.block
        while k < len(lasts) and lasts[k] < target:
            k += 1
        at = max(at, k * self.settings.block)
        while at < len(items) and items[at] < target:
            at += 1
        cursor[0], cursor[1] = (items[at], at) if at < len(items) else (math.inf, at)


@dataclass(frozen=True)
class _Block:
    """The items of one length class."""

    index: BlockMaxIndex
    item_ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    stride: int


def _shingled(texts: list[str], width: int) -> list[np.ndarray]:
    words, bounds = word_hashes(texts, letters=True)
    return [np.unique(rolled_shingles(words[a:b], width)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _blocks(benchmark: DataFrame, settings: DecontamSettings) -> Iterator[list[_Block]]:
    """Index blocks of bounded size, each by length class; term statistics are those of all items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in row_batches(frames):
            words, bounds = word_hashes(frame["text"], letters=True)
            own = np.repeat(np.arange(len(frame)), np.diff(bounds))
            pairs = np.unique(np.column_stack([own.astype(np.uint64), words]), axis=0)[:, 1] if len(words) else np.empty(0, np.uint64)
            terms, n = np.unique(pairs, return_counts=True)
            yield pd.DataFrame({"term": terms.view(np.int64), "n": n, "words": 0, "items": 0})
            sizes = np.diff(bounds)
            yield pd.DataFrame({"term": [0], "n": [0], "words": [int(sizes.sum())], "items": [int((sizes > 0).sum())]})

    items = benchmark.select("item_id", "text").where("text is not null and text <> ''")
    counted = items.mapInPandas(run, "term long, n long, words long, items long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "words", "items")))
    words, count = counted.agg(F.sum("words"), F.sum("items")).first()
    if not count:
        return
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-words // settings.block_terms)))
    for k in range(-(-words // settings.block_terms)):
        part = items.where(share == k)
        rows = sorted(part.collect(), key=lambda r: (str(r["item_id"]), r["text"]))  # about block_terms words
        texts = [r["text"] for r in rows]
        hashes, bounds = word_hashes(texts, letters=True)
        some = sorted((i for i in range(len(rows)) if bounds[i + 1] > bounds[i]), key=lambda i: bounds[i + 1] - bounds[i])
        if not some:
            continue
        own = part.sparkSession.createDataFrame([(x,) for x in np.unique(hashes).view(np.int64).tolist()], "term long")
        idf = {r["term"] & (2**64 - 1): math.log(1 + (count - r["n"] + 0.5) / (r["n"] + 0.5)) for r in counted.join(own, "term").select("term", "n").collect()}
        classes: dict[int, list[int]] = {}
        for i in some:
            length = int(bounds[i + 1] - bounds[i])
            classes.setdefault(settings.stride << (-(-length // settings.stride) - 1).bit_length(), []).append(i)
        made = []
        for stride, own_items in sorted(classes.items()):
            lists = [hashes[bounds[i] : bounds[i + 1]] for i in own_items]
            cut = [texts[i].find("?") + 1 or len(texts[i]) for i in own_items]
            questions = _shingled([texts[i][:c] for i, c in zip(own_items, cut, strict=True)], settings.width)
            answers = _shingled([texts[i][c:] for i, c in zip(own_items, cut, strict=True)], settings.width)
            made.append(_Block(BlockMaxIndex(lists, idf, words / count, settings), [rows[i]["item_id"] for i in own_items], questions, answers, stride))
        yield made


def _overlap(part: np.ndarray, passage: np.ndarray) -> float | None:
    return float(np.isin(part, passage).mean()) if len(part) else None


def _promising(index: BlockMaxIndex, term: np.ndarray, starts: np.ndarray, least: float, step: int = 4096) -> np.ndarray:
    """(passage, group) for which the group's largest weights add up to ``least``; a passage's terms are starts[p]:starts[p + 1]."""
    total = np.concatenate(([0.0], np.cumsum(index.most[term])))
    some = np.flatnonzero(total[starts[1:]] - total[starts[:-1]] >= least)
    found = []
    for k in range(0, len(some), step):
        part = some[k : k + step]
        sizes = starts[part + 1] - starts[part]
        rows = np.repeat(starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        sums = np.add.reduceat(index.group_most[term[rows]], np.cumsum(sizes) - sizes, axis=0)
        at, group = np.nonzero(sums >= least)
        found.append(np.column_stack([part[at], group]))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _matches(blocks: list[_Block], texts: list, settings: DecontamSettings) -> Iterator[tuple]:
    """(row, item id, score, question overlap, answer overlap): of the passages that hold enough of both, the best of each."""
    words, bounds = word_hashes(texts, letters=True)
    for block in blocks:
        yield from _block_matches(block, words, bounds, settings)


def _block_matches(block: _Block, words: np.ndarray, bounds: np.ndarray, settings: DecontamSettings) -> Iterator[tuple]:
    index, stride = block.index, block.stride
    place = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    hits = np.flatnonzero(index.terms[place] == words)
    row = np.searchsorted(bounds, hits, side="right") - 1
    counts = np.diff(bounds)
    first = np.concatenate(([0], np.cumsum(counts // stride + 1)))  # a row's passages: two strides long, one apart
    own = first[row] + (hits - bounds[row]) // stride
    term = place[hits].astype(np.int64)
    before = own > first[row]
    keys = np.unique(np.concatenate([own, own[before] - 1]) * len(index.terms) + np.concatenate([term, term[before]]))
    passage, term = keys // len(index.terms), keys % len(index.terms)
    best: dict[tuple[int, int], tuple] = {}
    starts = np.searchsorted(passage, np.arange(first[-1] + 1))
    for p, group in _promising(index, term, starts, settings.least_score - 1e-5).tolist():
        found = index.search(term[starts[p] : starts[p + 1]].tolist(), settings.least_score, *index.span(group))
        if not found:
            continue
        r = int(np.searchsorted(first, p, side="right")) - 1
        a = bounds[r] + (p - first[r]) * stride
        shingles = rolled_shingles(words[a : min(a + 2 * stride, bounds[r + 1])], settings.width)
        for item, score in found:
            short = [x for x in (block.questions[item], block.answers[item]) if len(x) == 1]
            within = shingles if not short else np.concatenate([shingles, *(rolled_shingles(words[a : min(a + 2 * stride, bounds[r + 1])], w, fixed=True) for w in range(1, settings.width))])
            question, answer = _overlap(block.questions[item], within), _overlap(block.answers[item], within)
            if min(x for x in (question, answer, 1.0) if x is not None) < settings.least_overlap:
                continue
            seen = best.get((r, item))
            if seen is None or (question, answer or 0.0, score) > (seen[1], seen[2] or 0.0, seen[0]):
                best[r, item] = (score, question, answer)
    for (r, item), found in sorted(best.items()):
        yield r, block.item_ids[item], *found


def _holds(shared, settings: DecontamSettings):
    @F.pandas_udf("boolean")
    def holds(series_in: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in series_in:
            flags = [np.zeros(0, dtype=bool)]
            for frame in row_batches([series.to_frame("text")]):
                flags.append(np.zeros(len(frame), dtype=bool))
                for r, *_ in _matches(shared.value, frame["text"].tolist(), settings):
                    flags[-1][r] = True
            yield pd.Series(np.concatenate(flags))

    return holds("text")


def clean(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    spark = ship(docs.sparkSession)
    for block in _blocks(benchmark, settings):
        docs = docs.where(~_holds(spark.sparkContext.broadcast(block), settings))
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of verified matches.

    A match is kept if in one passage the question's overlap, and the answer's where there
    is one, reach ``least_overlap``.
    """
    spark = ship(docs.sparkSession)
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out: DataFrame | None = None
    for block in _blocks(benchmark, settings):
        shared = spark.sparkContext.broadcast(block)  # at most about block_terms postings

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in row_batches(frames):
                rows = []
                for r, item, score, question, answer in _matches(shared.value, frame["text"].tolist(), settings):
                    rows.append((frame["doc_id"].iloc[r], item, score, question, answer))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)
