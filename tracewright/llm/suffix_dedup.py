"""Removal of repeated byte strings by a depth-limited most-significant-digit radix sort.

Every suffix counts only through its first ``length`` bytes (its window). Sorting
windows by digits and splitting equal ones off leaves groups of equal windows, which
are exactly the repeated strings; groups of one are dropped as soon as they arise.

The digits, most significant first, are

1. the window's least ``gram``-byte string (its anchor), by its hash, with that string's
   offset. Equal windows have equal anchors, and neighbouring windows share one, so
   about one anchor in 80 bytes stands for all windows. Anchors seen once are dropped
   with all their windows;
2. for what is left, in groups that hold different surroundings of one anchor, the
   window's bytes, eight to a digit: windows of one group are ordered by a digit, split
   where it differs, and those left alone are dropped, up to the last digit.

Between the two, surroundings (all bytes under an anchor's windows) that repeat as a
whole are settled by their hash: all of their windows repeat, one set of them stands for
the rest in the second pass, and none needs to be looked at by itself.

What already repeats within a batch is settled there and sent on once, so copies do not
pile up on one task. Surroundings travel as bytes, which is less than a digit for each of
their windows. Anchors that a table of counts of fixed size shows to be frequent are dealt
by their surroundings, and then their windows one by one.

Defined results: a null text is an empty one; texts under ``length`` bytes lose nothing;
repeated rows are copies of each other; matches never cross rows; other columns are
ignored; a null doc_id is kept as it is. A text is held by one task at a time, with some
40 bytes for each of its own; it may have up to 2**31 bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, discard, forget, in_bloom, row_batches, ship, written
from .vectext import mix, powers

_VALUES = mix(np.arange(501, 757, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass(frozen=True)
class DedupSettings:
    length: int = 200
    gram: int = 40
    table_bits: int = 18
    hot: int = 200_000
    part_rows: int = 2_000_000


class Rolling:
    """Hashes of any byte ranges of one text, from a running polynomial sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES) -> None:
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` neighbours."""
    out, have = keys, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, settings: DedupSettings, segment: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """Anchor hash, surroundings hash, first and last window, and the anchor's offset in the first, of each anchor of a text."""
    length, gram = settings.length, settings.gram
    windows = len(data) - length + 1
    if windows < 1:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int32, np.int32, np.int32))
    rolling, parts = Rolling(data), []
    place = np.uint64((1 << 24) - 1)
    for begin in range(0, windows, segment):
        count = min(segment, windows - begin)
        starts = np.arange(begin, begin + count + length - gram)
        grams = rolling.of(starts, starts + gram)
        keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(keys, length - gram + 1) & place).astype(np.int64)  # the leftmost least, the same for equal windows
        low = np.flatnonzero(np.diff(at, prepend=-1))
        high = np.append(low[1:], len(at)) - 1
        lead = (at[low] - low).astype(np.uint64)
        around = rolling.of(begin + low, begin + high + length)
        parts.append((mix(grams[at[low]]), mix(around ^ mix(lead + np.uint64(1)) ^ mix((high - low).astype(np.uint64) << np.uint64(20))), begin + low, begin + high, lead))
    first, around, *places = (np.concatenate(x) for x in zip(*parts, strict=True))
    return first, around, *(x.astype(np.int32) for x in places)


def _bytes_of(text) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", dtype=np.uint8)


_PACKED = "part int, first binary, second binary, many binary, names binary, runs binary, low binary, high binary, settled boolean"


def _runs(names: np.ndarray) -> tuple[bytes, bytes]:
    """Names as runs: each name once, with the number of its entries in a row."""
    cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
    return names[cuts].tobytes(), np.diff(np.append(cuts, len(names))).astype("<i4").tobytes()


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=False))


def _pack(first, second, names, low, high, parts: int, deal: np.ndarray) -> pd.DataFrame:
    """Rows by destination. Of equal (first, second) in the batch one goes on, marked; the rest are settled."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    many = np.zeros(len(order), dtype=bool)
    many[order[heads]] = np.diff(np.append(heads, len(order))) > 1
    kept = np.zeros(len(order), dtype=bool)
    kept[order[heads]] = True
    rows = []

    def add(chosen: np.ndarray, part: np.ndarray, settled: bool) -> None:
        by = np.argsort(part, kind="stable")  # in the order of the texts, so that names form runs
        for x, y in _groups(part[by]):
            c = chosen[by[x:y]]
            hashes = (b"", b"", b"") if settled else (first[c].tobytes(), second[c].tobytes(), many[c].tobytes())
            rows.append((int(part[by[x]]), *hashes, *_runs(names[c]), low[c].tobytes(), high[c].tobytes(), settled))

    chosen = np.flatnonzero(kept)
    add(chosen, (deal[chosen] % np.uint64(parts)).astype(np.int64), False)
    rest = np.flatnonzero(~kept)
    add(rest, (mix(names[rest].view(np.uint64)) % np.uint64(parts)).astype(np.int64), True)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PACKED.split(", ")])


def _joined(group: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), dtype=kind)


def _owners(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, low and high of every entry."""
    names = np.repeat(_joined(group, "names", np.int64), _joined(group, "runs", "<i4"))
    return names, _joined(group, "low", np.int32), _joined(group, "high", np.int32)


_RANGES = "bucket int, names binary, runs binary, low binary, high binary, state binary"
REPEATED, OPEN, SPOKESMAN = 1, 2, 3  # all windows repeat; to be looked at; repeats, and stands for its kind in pass 3


def _by_bucket(names, low, high, state, buckets: int) -> pd.DataFrame:
    """A row for each bucket of names."""
    bucket = (mix(names.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((low, names, bucket))
    rows = []
    for a, b in _groups(bucket[order]):
        c = order[a:b]
        rows.append((int(bucket[c[0]]), *_runs(names[c]), low[c].tobytes(), high[c].tobytes(), state[c].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "names", "runs", "low", "high", "state"])


def _frequent(first: np.ndarray, table, settings: DedupSettings) -> np.ndarray:
    return table.value[(first >> np.uint64(64 - settings.table_bits)).astype(np.int64)] >= settings.hot


def _settle_anchors(packed: DataFrame, table, buckets: int, settings: DedupSettings) -> DataFrame:
    """By bucket the ranges of windows that repeat or are still open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        done, group = group[group["settled"]], group[~group["settled"]]
        names, low, high = _owners(done)
        out = [(names, low, high, np.full(len(names), REPEATED, np.uint8))]
        first, second, many = _joined(group, "first", np.uint64), _joined(group, "second", np.uint64), _joined(group, "many", bool)
        names, low, high = _owners(group)
        if len(first):
            order = np.lexsort((second, first))
            new_first = np.concatenate(([True], first[order][1:] != first[order][:-1]))
            new_both = new_first | np.concatenate(([True], second[order][1:] != second[order][:-1]))
            outer, inner = np.cumsum(new_first) - 1, np.cumsum(new_both) - 1
            repeats = np.bincount(inner, 1 + many[order].astype(np.int64))[inner] > 1
            state = np.where(repeats, REPEATED, 0).astype(np.uint8)
            mixed = (np.bincount(outer, new_both)[outer] > 1) | _frequent(first[order], table, settings)
            state[mixed & ~repeats] = OPEN
            state[mixed & repeats & new_both] = SPOKESMAN
            some = state > 0
            chosen = order[some]
            out.append((names[chosen], low[chosen], high[chosen], state[some]))
        return _by_bucket(*(np.concatenate(x) for x in zip(*out, strict=True)), buckets)

    return packed.groupBy("part").applyInPandas(run, _RANGES)


def _gathered(ranges: DataFrame, states: tuple[int, ...]) -> DataFrame:
    """(name, low, high, windows): each text's ranges with one of ``states``, those that touch joined."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, low, high = _owners(group)
        keep = np.isin(_joined(group, "state", np.uint8), states)
        names, low, high = names[keep], low[keep], high[keep]
        order = np.lexsort((low, names))
        names, low, high = names[order], low[order], high[order]
        if not len(names):
            return pd.DataFrame(columns=["name", "low", "high", "windows"])
        fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (low[1:] > high[:-1] + 1)))
        start = np.flatnonzero(fresh)
        names, low, high = names[start], low[start], np.maximum.reduceat(high, start)
        cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        rows = [(names[a], low[a:b].tobytes(), high[a:b].tobytes(), int((high[a:b].astype(np.int64) - low[a:b] + 1).sum())) for a, b in zip(cuts, np.append(cuts[1:], len(names)), strict=True)]
        return pd.DataFrame(rows, columns=["name", "low", "high", "windows"])

    return ranges.groupBy("bucket").applyInPandas(run, "name long, low binary, high binary, windows long")


def _anchor_table(docs: DataFrame, settings: DedupSettings) -> DataFrame:
    """A row of packed anchors for each text, and rows (bucket, n) that count them."""
    columns = ["name", "first", "second", "low", "high", "bucket", "n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << settings.table_bits, dtype=np.int64)
        for frame in row_batches(frames):
            rows = []
            for name, text in zip(frame["name"], frame["text"], strict=True):
                first, second, low, high, _ = anchors(_bytes_of(text), settings)
                if len(first):
                    np.add.at(counts, (first >> np.uint64(64 - settings.table_bits)).astype(np.int64), 1)
                    rows.append((name, first.tobytes(), second.tobytes(), low.tobytes(), high.tobytes(), -1, len(first)))
            yield pd.DataFrame(rows, columns=columns)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"name": 0, "first": None, "second": None, "low": None, "high": None, "bucket": some, "n": counts[some]})

    return docs.select("name", "text").mapInPandas(run, "name long, first binary, second binary, low binary, high binary, bucket int, n long")


def _deal_anchors(rows: DataFrame, parts: int, table, settings: DedupSettings) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 2000):
                frame = whole.iloc[start : start + 2000]
                first, second = _joined(frame, "first", np.uint64), _joined(frame, "second", np.uint64)
                low, high = _joined(frame, "low", np.int32), _joined(frame, "high", np.int32)
                names = np.repeat(frame["name"].to_numpy(), frame["n"].to_numpy())
                deal = np.where(_frequent(first, table, settings), first ^ mix(second), first)
                yield _pack(first, second, names, low, high, parts, mix(deal))

    return rows.mapInPandas(run, _PACKED)


def equal_windows(data: np.ndarray, starts: np.ndarray, first: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that equal another, ordered by (first, lead) and their bytes, and the number of each one's group.

    Digits are eight bytes, most significant first. A pass orders only groups in which the
    digit differs; groups of one are dropped before the next.
    """
    words = np.ndarray(len(data), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    at = np.lexsort((lead, first))
    group = _numbered(first[at], lead[at])
    for depth in range(0, length + 8, 8):
        sizes = np.bincount(group)
        some = sizes[group] > 1
        at, group = at[some], group[some]
        if depth >= length or not len(at):
            break
        digit = words[starts[at] + depth].astype(np.uint64) >> np.uint64(8 * max(0, depth + 8 - length))
        differs = (group[1:] == group[:-1]) & (digit[1:] != digit[:-1])
        split = np.zeros(group[-1] + 1, dtype=bool)
        split[group[1:][differs]] = True
        some = np.flatnonzero(split[group])
        order = some[np.lexsort((digit[some], group[some]))]
        at[some], digit[some] = at[order], digit[order]
        group = _numbered(group, digit)
    return at, group


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _each(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window in ranges: the number of its range, and its place there."""
    sizes = high.astype(np.int64) - low + 1
    return np.repeat(np.arange(len(low)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_WINDOWS = "part int, first binary, lead binary, many binary, names binary, runs binary, low binary, high binary, data binary, settled boolean"


def _deal_windows(docs: DataFrame, parts: int, table, settings: DedupSettings) -> DataFrame:
    """The bytes of each text's open ranges, by anchor; of frequent anchors each window, by a hash of its bytes."""
    length = settings.length

    def ranges(frame: pd.DataFrame) -> Iterator[tuple]:
        """first, lead, name, low, high, place in the batch's bytes, destination."""
        before = 0
        for name, text, *packed in zip(frame["name"], frame["text"], frame["low"], frame["high"], strict=True):
            lows, highs = (np.frombuffer(x, np.int32) for x in packed)
            data = _bytes_of(text)
            first, _, low, high, lead = anchors(data[: int(highs[-1]) + length], settings)
            home = np.searchsorted(lows, low, side="right") - 1
            some = (home >= 0) & (high <= highs[home])
            first, low, high, lead = first[some], low[some], high[some], lead[some]
            hot = _frequent(first, table, settings)
            yield first[~hot], lead[~hot], np.full((~hot).sum(), name), low[~hot], high[~hot], before + low[~hot].astype(np.int64), mix(first[~hot]), hot[~hot]
            if hot.any():
                own, j = _each(low[hot], high[hot])
                at = low[hot][own] + j
                alone = at.astype(np.int32)
                yield first[hot][own], (lead[hot][own] - j).astype(np.int32), np.full(len(at), name), alone, alone, before + at, Rolling(data).of(at, at + length), np.ones(len(at), dtype=bool)
            before += len(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in row_batches(frames, 1_000_000):
            if not len(frame):
                continue
            data = np.concatenate([_bytes_of(text) for text in frame["text"]])
            first, lead, names, low, high, place, deal, hot = (np.concatenate(x) for x in zip(*ranges(frame), strict=True))
            part = (deal % np.uint64(parts)).astype(np.int64)
            many, settled = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
            some = np.flatnonzero(hot)
            if len(some):  # of a frequent anchor's windows that are equal within the batch one goes on, marked
                at, group = equal_windows(data, place[some], first[some], lead[some], length)
                head = np.concatenate(([True], group[1:] != group[:-1]))[: len(at)]
                many[some[at[head]]] = True
                settled[some[at[~head]]] = True
            rows = []
            for done in (False, True):
                chosen = np.flatnonzero(settled == done)
                by = chosen[np.argsort(part[chosen], kind="stable")]
                for x, y in _groups(part[by]):
                    c = by[x:y]
                    own, j = _each(low[c], high[c] + (length - 1))
                    told = (b"", b"", b"", b"") if done else (first[c].tobytes(), lead[c].tobytes(), many[c].tobytes(), data[place[c][own] + j].tobytes())
                    rows.append((int(part[c[0]]), *told[:3], *_runs(names[c]), low[c].tobytes(), high[c].tobytes(), told[3], done))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WINDOWS.split(", ")])

    return docs.mapInPandas(run, _WINDOWS)


def _settle_windows(packed: DataFrame, buckets: int, settings: DedupSettings) -> DataFrame:
    """By bucket the ranges of windows whose bytes repeat."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        done, group = group[group["settled"]], group[~group["settled"]]
        names, low, high = _owners(done)
        out = [(names, low, high)]
        names, low, high = _owners(group)
        if len(names):
            sizes = high.astype(np.int64) - low + settings.length
            own, j = _each(low, high)
            first, lead = _joined(group, "first", np.uint64), _joined(group, "lead", np.int32)
            repeats = _joined(group, "many", bool)[own]
            at, _ = equal_windows(_joined(group, "data", np.uint8), (np.cumsum(sizes) - sizes)[own] + j, first[own], lead[own] - j, settings.length)
            repeats[at] = True
            some = np.flatnonzero(repeats)
            fresh = np.ones(len(some), dtype=bool)
            fresh[1:] = (np.diff(some) > 1) | (own[some[1:]] != own[some[:-1]])
            a, b = some[fresh], some[np.append(fresh[1:], True)] if len(some) else some
            out.append((names[own[a]], (low[own[a]] + j[a]).astype(np.int32), (low[own[a]] + j[b]).astype(np.int32)))
        names, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
        return _by_bucket(names, low, high, np.full(len(names), REPEATED, np.uint8), buckets)

    return packed.groupBy("part").applyInPandas(run, _RANGES)


def covered(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs [start, end) under the windows of all ranges."""
    order = np.argsort(low, kind="stable")
    start, end = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64) + length)
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    return start[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]


def _cut_out(docs: DataFrame, settings: DedupSettings) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, *packed in zip(frame["text"], frame["low"], frame["high"], strict=True):
                data = _bytes_of(text)
                keep, spans = np.ones(len(data), dtype=bool), 0
                if packed[0] is not None:
                    low, high = (np.frombuffer(x, np.int32) for x in packed)
                    starts, ends = covered(low, high, settings.length)
                    spans = len(starts)
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        keep[a:b] = False
                left = data[keep]
                rows.append((len(data), len(data) - len(left), spans, hashlib.sha256(left.tobytes()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "low", "high").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _named(docs: DataFrame, name: Column | None = None) -> DataFrame:
    """doc_id, text, name: a 64-bit hash of both; rows of one name that differ by a second such hash get another."""
    name = F.xxhash64("doc_id", "text") if name is None else name
    twice = docs.select("doc_id", "text", name.alias("name"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check"))
    clashes = twice.groupBy("name").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("name")
    clashing = [r["name"] for r in clashes.collect()]  # n * n / 2**65 names of n rows, some three of 10**10
    if not clashing:
        return twice.drop("check")
    return twice.withColumn("name", F.when(F.col("name").isin(clashing), F.xxhash64("name", "check")).otherwise(F.col("name"))).drop("check")


def deduplicate(docs: DataFrame, settings: DedupSettings = DedupSettings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = ship(docs.sparkSession)
    docs = _named(docs)
    packed = written(_anchor_table(docs.where(F.octet_length("text") >= settings.length), settings), "anchors")
    counted = packed.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**table_bits rows at most
    counts = np.zeros(1 << settings.table_bits, dtype=np.int64)
    counts[counted["bucket"]] = counted["n"]
    table = spark.sparkContext.broadcast(counts)
    least = spark.sparkContext.defaultParallelism
    parts = max(least, math.ceil(int(counts.sum()) / settings.part_rows))
    buckets = max(least, math.ceil(int(counts.sum()) * 4 / settings.part_rows))
    live = written(_settle_anchors(_deal_anchors(packed.where("bucket < 0"), parts, table, settings), table, buckets, settings), "live")
    forget(spark)
    discard(packed)

    todo = written(_gathered(live, (OPEN, SPOKESMAN)), "open")
    windows = todo.agg(F.sum("windows")).first()[0] or 0
    parts = max(least, math.ceil(windows / settings.part_rows))
    texts = in_bloom(docs, "name", bloom(todo, "name"), "_todo").where("_todo").select("name", "text")
    singles = written(_settle_windows(_deal_windows(texts.join(todo, "name"), parts, table, settings), buckets, settings), "windows")
    forget(spark)

    hits = written(_gathered(live.unionAll(singles), (REPEATED, SPOKESMAN)), "hits")
    marked = in_bloom(docs, "name", bloom(hits, "name"), "_hit")
    untouched = marked.where("not _hit").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
    return untouched.unionAll(_cut_out(marked.where("_hit").join(hits, "name", "left"), settings))
