"""Source divergence audit: how far each source's words lie from its language and from other sources.

Texts are read as the concatenated UTF-8 buffer of an Arrow batch. A lookup table tells
term bytes from others and lowers A-Z, so term boundaries are where the table's values
change or a text ends. Slices are grouped by their xxhash, and every slice is compared
with its group's first byte by byte; slices of one hash and other bytes are grouped by
the bytes. Counts are added up within a task (up to ``AuditSettings.held`` entries, then
passed on), then by (language, term), which also yields each term's documents and total.

Kept terms of a language fall into hash buckets of about ``bucket`` counts, or as many as
a block has pairs of sources, and sources into blocks of ``sources``; a task has one bucket
for two blocks, whatever the language's size, and returns no more pairs than it has read. There the counts form CSR matrices (sources by terms). A source without
a term has one smallest probability for all such terms, so a pair's divergence is a sum
over stored entries (``np.add.reduceat`` by row) and a multiple of a constant; all of it
in integers. Partial sums of buckets are added up by Spark.

Defined results: null texts, languages and sources are ''. Every occurring (language,
source) group is reported, even without terms; if its language keeps no term its pair
values are 0. A language with one source has no pairs. Repeated rows are each a document;
ids play no part; an empty table gives no rows; other columns are ignored. A text longer
than ``piece`` bytes is counted in pieces cut between terms, so a task holds about 40
bytes for each byte of a piece and the distinct terms of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ship, written

UNIT = 1_000_000_000


@dataclass(frozen=True)
class AuditSettings:
    least_documents: int = 10
    shown: int = 10  # terms reported of a group
    piece: int = 1_000_000
    held: int = 400_000
    bucket: int = 10_000
    sources: int = 512


_TERM = np.zeros(256, dtype=bool)
_TERM[0x80:] = True
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# --- byte-level tokenizer ---------------------------------------------------------


def boundaries(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of ``data``; a term ends where a text begins."""
    inside = _TERM[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[begins] = True
    first[-1] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return starts, np.flatnonzero(inside & (~after | first[1:])) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's group, and a slice of each group; slices of one group have the same bytes."""
    raw = memoryview(data)
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, chosen, group = np.unique(hashes, return_index=True, return_inverse=True)
    twin = chosen[group]
    length = ends - starts
    odd = length != length[twin]
    ok = np.flatnonzero(~odd & (twin != np.arange(len(twin))))
    if len(ok):  # byte by byte
        n = length[ok]
        heads = np.concatenate(([0], np.cumsum(n)[:-1]))
        step = np.arange(n.sum()) - np.repeat(heads, n)
        differs = data[np.repeat(starts[ok], n) + step] != data[np.repeat(starts[twin[ok]], n) + step]
        odd[ok] = np.add.reduceat(differs, heads) > 0
    if odd.any():  # other bytes under the same hash
        extra: dict[bytes, int] = {}
        chosen = chosen.tolist()
        for i in np.flatnonzero(odd).tolist():
            term = bytes(raw[starts[i] : ends[i]])
            if term not in extra:
                extra[term] = len(chosen)
                chosen.append(i)
            group[i] = extra[term]
        chosen = np.array(chosen)
    return group, chosen


def pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``data`` cut between terms into pieces of ``size`` bytes, or of one longer term."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and _TERM[data[end - 1]] and _TERM[data[end]]:
            step = np.flatnonzero(~_TERM[data[end : end + size]])
            end = end + int(step[0]) if len(step) else min(end + size, len(data))
        yield data[at:end]
        at = end


class Counter:
    """Counts of (group, term) of one task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def _add(self, keys: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        distinct, at = np.unique(keys, return_inverse=True)
        self.keys.append(distinct)
        for total, values in ((self.counts, counts), (self.docs, docs)):
            summed = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(summed, at, values)
            total.append(summed)
        self.size += len(distinct)

    def texts(self, data: np.ndarray, begins: np.ndarray, groups: np.ndarray) -> None:
        """Texts ``data[begins[i]:begins[i + 1]]`` of ``groups[i]``."""
        data = _LOWER[data]
        starts, ends = boundaries(data, begins[:-1][begins[:-1] < len(data)])
        if not len(starts):
            return
        group, chosen = grouped(data, starts, ends)
        raw = memoryview(data)
        number = np.array([self.terms.setdefault(bytes(raw[starts[i] : ends[i]]), len(self.terms)) for i in chosen])
        doc = np.searchsorted(begins, starts, side="right") - 1
        pair, counts = np.unique(doc * len(chosen) + group, return_counts=True)
        self._add((groups[pair // len(chosen)] << 40) + number[pair % len(chosen)], counts, np.ones(len(pair), dtype=np.int64))

    def long_text(self, data: np.ndarray, group: int, size: int) -> None:
        found = Counter()
        for piece in pieces(data, size):
            found.texts(piece, np.array([0, len(piece)]), np.array([0]))
            if found.size > 1 << 20:
                found.merge()
        found.merge()
        if found.size:
            names = list(found.terms)
            number = np.array([self.terms.setdefault(names[k], len(self.terms)) for k in found.keys[0]])
            self._add((group << 40) + number, found.counts[0], np.ones(found.size, dtype=np.int64))

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, counts, docs = (np.concatenate(x) for x in (self.keys, self.counts, self.docs))
            self.keys, self.counts, self.docs, self.size = [], [], [], 0
            self._add(keys, counts, docs)

    def batch(self) -> pa.RecordBatch:
        """All counts and, with a null term, the groups met; then start anew."""
        self.merge()
        keys = self.keys[0] if self.keys else np.empty(0, np.int64)
        terms, groups = list(self.terms), list(self.groups)
        vocabulary = pa.array(terms, pa.binary()).cast(pa.string())
        zero = np.zeros(len(groups), dtype=np.int64)
        at = np.concatenate((keys >> 40, np.arange(len(groups))))
        number = pa.array(np.concatenate((keys & ((1 << 40) - 1), zero)), mask=np.arange(len(at)) >= len(keys))
        columns = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(at)) for k in (0, 1)]
        columns.append(vocabulary.take(number) if len(terms) else pa.nulls(len(at), pa.string()))
        columns += [pa.array(np.concatenate((*x, zero))) for x in (self.counts, self.docs)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame, settings: AuditSettings, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task; a null term marks a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            groups = np.array([counter.group(a, b) for a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], dtype=np.int64)
            low, n = 0, len(text)
            while low < n:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + settings.piece, side="right")) - 1)
                part = data[offsets[low] : offsets[high]]
                if high == low + 1 and len(part) > settings.piece:
                    counter.long_text(_LOWER[part], int(groups[low]), settings.piece)
                else:
                    counter.texts(part, offsets[low : high + 1] - offsets[low], groups[low:high])
                low = high
                if counter.size > 4 * settings.held:
                    counter.merge()
            if counter.size > settings.held or len(counter.terms) > settings.held:
                counter.merge()
                if counter.size > settings.held or len(counter.terms) > settings.held:
                    yield counter.batch()
        if counter.groups:
            yield counter.batch()
        give_back()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    return docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, docs long")


# --- probabilities and divergences ---------------------------------------------------


def probability(count: np.ndarray, size: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (size + 2 * kept)), by long division, so that nothing overflows."""
    whole = np.asarray(size, dtype=np.int64) + 2 * kept
    rest, found = np.asarray(count, dtype=np.int64) + 2, np.int64(0)
    found, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // whole, rest % whole
    return found + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


@dataclass(frozen=True)
class Csr:
    """Sources by terms: probabilities of the terms that occur, and each row's probability of any other."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, data: np.ndarray, rest: np.ndarray) -> Csr:
        order = np.lexsort((column, row))
        return cls(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(rest))))), column[order], data[order], rest)

    def row(self, k: int) -> slice:
        return slice(self.indptr[k], self.indptr[k + 1])


def row_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    total = np.zeros(len(indptr) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(indptr))
    if len(some):
        total[some] = np.add.reduceat(values, indptr[some])
    return total


def divergences(a: Csr, k: int, b: Csr, terms: int, cells: int = 1 << 20) -> np.ndarray:
    """Of row ``k`` of ``a`` from each row of ``b``, over ``terms`` columns."""
    own, z = a.row(k), a.rest[k]
    dense = np.full(terms, z, dtype=np.int64)
    dense[a.indices[own]] = a.data[own]
    there = dense[b.indices]
    other = np.repeat(b.rest, np.diff(b.indptr))
    total = row_sums(gap(there, b.data) - gap(there, other), b.indptr)
    mine = a.data[own]
    step = max(1, cells // max(1, len(mine)))
    for at in range(0, len(b.rest), step):
        total[at : at + step] += gap(mine[None, :], b.rest[at : at + step, None]).sum(axis=1)
    return total + (terms - len(mine)) * gap(z, b.rest)


FOUND = "lang string, source string, part string, item string, value long"


def _bucket(settings: AuditSettings):
    def run(key, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        groups = groups.sort_values("place", kind="stable").reset_index(drop=True)
        names, kept = groups["source"].to_numpy(), int(groups["kept"].iloc[0])
        out = []
        counts = counts.reset_index(drop=True)
        column, words = pd.factorize(counts["term"], sort=True)
        row = groups.set_index("place").index.get_indexer(counts["place"])
        if kept:
            size = groups["size"].to_numpy()
            data = probability(counts["n"].to_numpy(), size[row], kept) if len(row) else np.empty(0, np.int64)
            whole = Csr.of(row, column, data, probability(np.zeros(len(groups)), size, kept))
            block = groups["block"].to_numpy()

            def cut(number: int) -> tuple[Csr, np.ndarray]:
                at = np.flatnonzero(block == number)
                a, b = whole.indptr[at[0]], whole.indptr[at[-1] + 1]
                return Csr(whole.indptr[at[0] : at[-1] + 2] - a, whole.indices[a:b], whole.data[a:b], whole.rest[at]), names[at]

            (left, left_names), (right, right_names) = cut(low), cut(high)
            for k, name in enumerate(left_names):
                value = divergences(left, k, right, len(words))
                rest = slice(k + 1, None) if low == high else slice(None)
                out.append((name, "pair", right_names[rest], value[rest]))
                out += [] if not len(value[rest]) else [(right_names[rest], "pair", name, value[rest])]
        else:  # a language without kept terms
            for k, name in enumerate(names):
                rest = [j for j in range(len(names)) if j != k and (groups["block"][k] == low and groups["block"][j] == high or groups["block"][k] == high and groups["block"][j] == low)]
                out.append((name, "pair", names[rest], np.zeros(len(rest), dtype=np.int64)))
        if low == high and len(row):
            q = probability(counts["total"].to_numpy(), int(groups["lang_size"].iloc[0]), kept)
            more = counts.assign(value=gap(data, q), row=row)[data > q].sort_values(["row", "value", "term"], ascending=[True, False, True], key=lambda c: c.str.encode("utf-8") if c.name == "term" else c)
            more = more[more.groupby("row").cumcount() < settings.shown]
            out.append((names[more["row"]], "term", more["term"].to_numpy(), more["value"].to_numpy()))
        frames = [pd.DataFrame({"source": a, "part": part, "item": b, "value": v}, index=range(len(v))) for a, part, b, v in out if len(v)]
        found = pd.concat(frames) if frames else pd.DataFrame({c: [] for c in ("source", "part", "item", "value")})
        found.insert(0, "lang", lang)
        return found.astype({"lang": object, "source": object, "part": object, "item": object, "value": "int64"})

    return run


def audit(docs: DataFrame, settings: AuditSettings = AuditSettings(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text."""
    ship(docs.sparkSession)
    partial = count_terms(docs, settings, text_col, lang_col, source_col)
    # no term holds a space, so a group's mark has a slot of its own
    partial = partial.withColumn("slot", F.coalesce("term", F.concat(F.lit(" "), "source"))).repartition("lang", "slot")
    counts = partial.groupBy("lang", "slot", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "slot")
    counts = counts.withColumn("all_docs", F.sum("docs").over(same)).withColumn("total", F.sum("n").over(same))
    counts = counts.withColumn("first", F.row_number().over(same.orderBy("source")) == 1)
    kept = F.col("term").isNotNull() & (F.col("all_docs") >= settings.least_documents)
    counts = written(counts.where(F.col("term").isNull() | kept).select("lang", "source", "term", "n", "total", "first"), "terms")

    lead = F.col("first") & F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("term").alias("entries"), F.count(F.when(lead, 1)).alias("leads"), F.sum(F.when(lead, F.col("total")).otherwise(0)).alias("led"))
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "size", F.sum("leads").over(of_lang).alias("kept"), F.sum("led").over(of_lang).alias("lang_size"), F.sum("entries").over(of_lang).alias("entries"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(of_lang).alias("sources"))
    groups = groups.withColumn("block", F.floor(F.col("place") / settings.sources).cast("int")).withColumn("blocks", F.ceil(F.col("sources") / settings.sources).cast("int"))
    side = F.least(F.col("sources"), F.lit(settings.sources))
    groups = written(groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("entries") / F.greatest(F.lit(settings.bucket), side * side))).cast("int")), "groups")

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ends = (F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    places = groups.select(*(F.col(c).alias(c) for c in ("lang", "source", "place", "block", "blocks", "buckets")))  # ids of its own
    rows = counts.where("term is not null").join(places, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    rows = rows.select("lang", "bucket", "place", "block", "term", "n", "total", other).select("lang", "bucket", *ends, "place", "term", "n", "total")
    sides = groups.select("*", other).select("*", *ends, F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).select("lang", "bucket", "low", "high", "place", "block", "source", "size", "kept", "lang_size")
    key = ("lang", "bucket", "low", "high")
    found = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(_bucket(settings), FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= settings.shown))
