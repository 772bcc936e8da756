"""Token ids in files of shuffled bit or byte planes.

A shard file holds the ids of consecutive documents. Ids are cut into blocks of fixed
size; a block is transposed into planes (bit k, or byte k, of every id in turn), each
plane is compressed by itself with zstandard, and planes above the block's largest id
are left out. The footer holds the chunk index (offset, ids and plane sizes of every
block) and the document index (ids and token counts), so any block can be read alone.

    magic "TWBP" | blocks ... | chunk index | document index | footer

A shard is written under a name of its task attempt, and only shards that a finished
task reported are read, so a lost executor leaves at most an unread file behind.

Defined results: a null text is an empty one (it has the end id alone); documents with
equal ids keep one order, by text; a null id sorts first; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, row_batches, ship

MAGIC = b"TWBP"
_FOOTER = struct.Struct("<QIQIIB3x4s")  # chunk index at, chunks, documents at, documents, block, plane bits, magic
_CHUNK = struct.Struct("<QIH")  # offset, ids, planes; then a u32 for each plane


@dataclass(frozen=True)
class PlaneFormat:
    block: int = 1 << 16
    plane_bits: int = 8  # 8: byte planes; 1: bit planes
    level: int = 3


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """Planes of a block, lowest first, without those that are zero for every id."""
    used = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [raw[:, k].tobytes() for k in range((used + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(used)]


def from_planes(planes: list[bytes], count: int, plane_bits: int) -> np.ndarray:
    ids = np.zeros(count, dtype="<u4")
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if plane_bits == 1:
            part = np.unpackbits(part, count=count)
        ids |= part.astype("<u4") << np.uint32(k * plane_bits)
    return ids


class ShardWriter:
    def __init__(self, sink, fmt: PlaneFormat) -> None:
        self.sink, self.fmt, self.at = sink, fmt, 0
        self.pack = zstandard.ZstdCompressor(level=fmt.level)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.chunks: list[bytes] = []
        self.names: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, names: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.names.extend(names)
        self.counts.extend(counts.tolist())
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.fmt.block:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.fmt.block * self.fmt.block
            for i in range(0, whole, self.fmt.block):
                self._block(joined[i : i + self.fmt.block])
            self.waiting, self.held = [joined[whole:].copy()], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in to_planes(ids, self.fmt.plane_bits)]
        self.chunks.append(_CHUNK.pack(self.at, len(ids), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        for plane in planes:
            self._put(plane)

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        if len(rest):
            self._block(rest)
        chunks_at = self.at
        self._put(b"".join(self.chunks))
        documents_at = self.at
        known = np.array([x is not None for x in self.names], dtype=np.uint8)
        names = np.array([x or 0 for x in self.names], dtype="<i8")
        index = known.tobytes() + names.tobytes() + np.array(self.counts, dtype="<u8").tobytes()
        self._put(self.pack.compress(index))
        self._put(_FOOTER.pack(chunks_at, len(self.chunks), documents_at, len(self.names), self.fmt.block, self.fmt.plane_bits, MAGIC))


class ShardReader:
    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - _FOOTER.size)
        chunks_at, n_chunks, documents_at, n_docs, self.block, self.plane_bits, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(chunks_at)
        index = source.read(size - _FOOTER.size - chunks_at)
        self.unpack = zstandard.ZstdDecompressor()
        self.chunks, at = [], 0
        for _ in range(n_chunks):
            offset, count, planes = _CHUNK.unpack_from(index, at)
            at += _CHUNK.size
            self.chunks.append((offset, count, struct.unpack_from(f"<{planes}I", index, at)))
            at += 4 * planes
        docs = self.unpack.decompress(index[documents_at - chunks_at :], max_output_size=17 * n_docs + 1) if n_docs else b""
        known = np.frombuffer(docs, np.uint8, n_docs)
        names = np.frombuffer(docs, "<i8", n_docs, n_docs)
        self.names = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.counts = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)

    def ids(self, chunk: int) -> np.ndarray:
        offset, count, sizes = self.chunks[chunk]
        self.source.seek(offset)
        data, planes, at = self.source.read(sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unpack.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, count, self.plane_bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, holding one block and one document at a time."""
        chunk, have = 0, np.empty(0, "<u4")
        for name, count in zip(self.names, self.counts.tolist(), strict=True):
            parts, missing = [have[:count]], count - len(have)
            have = have[count:]
            while missing > 0:
                have = self.ids(chunk)
                chunk += 1
                parts.append(have[:missing])
                missing, have = missing - len(have), have[missing:]
            yield name, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _letters_only(word: str) -> bool:
    """Letters now, and still letters once normalised and lowered."""
    return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and word.lower().isalpha())


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that does not print as a letter from U+0100 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {b: 0x100 + k for k, b in enumerate(hidden)}


_ENCODERS: dict = {}


def encoder_of(path: str, end_id: int | None) -> "WordEncoder":
    """This worker process's encoder; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, end_id)
    _ENCODERS[path].end_id = end_id
    return _ENCODERS[path]


class WordEncoder:
    """Encodes texts through a cache of space-delimited pieces.

    The tokenizer's own rules never join characters across a plain space or newline,
    so a text's ids are the concatenated ids of the pieces between them. It lowers
    letters and parts a run of letters from a full stop or comma, so a piece made of
    letters and one such sign gets the ids of the lowered letters, then the sign's.
    """

    def __init__(self, path: str, end_id: int | None, most: int = 700_000, most_chars: int = 12_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.most, self.most_chars = most, most_chars
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = _byte_letters()
        self.signs = dict(zip(".,", self._plain([".", ","]), strict=True))
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype="<u4")
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.sizes = np.empty(1 << 14, dtype=np.int64)
        self.used = self.chars = 0

    def _stem(self, word: str) -> list[int] | None:
        """Ids by the model alone, for what the rules before it leave as one run of letters."""
        plain = word if word.isascii() else self.normalizer.normalize_str(word)
        if not plain.isalpha():
            return None
        if not word.isascii():
            plain = plain.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(plain)]

    def _plain(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; only stems that are not known yet go to the tokenizer."""
        stems, tails = [], []
        for w in words:
            stem, tail = (w[:-1], w[-1]) if w[-1:] in (".", ",") and _letters_only(w[:-1]) else (w, "")
            stems.append(stem.lower() if stem.isalpha() and stem.isascii() else stem)
            tails.append(tail)
        known: dict[str, list[int]] = dict.fromkeys(stems, [])
        new = []
        for stem in known:
            code = self.codes.get(stem)
            if code is None:
                new.append(stem)
            else:
                known[stem] = self.flat[self.starts[code] : self.starts[code] + self.sizes[code]].tolist()
        known.update((stem, self._stem(stem)) for stem in new)
        other = [stem for stem in new if known[stem] is None]
        known.update(zip(other, self._plain(other), strict=True))
        return [known[s] + self.signs[t] if t else known[s] for s, t in zip(stems, tails, strict=True)]

    def _learn(self, words: list[str]) -> None:
        known = len(self.codes)
        codes = self.codes
        fresh = list({w: None for w in words if w not in codes})
        for a in range(0, len(fresh), 5000):
            part = fresh[a : a + 5000]
            got = self._pieces(part)
            sizes = np.array([len(x) for x in got], dtype=np.int64)
            need = self.used + int(sizes.sum())
            while need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while known + len(part) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
                self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
            self.flat[self.used : need] = [i for x in got for i in x]
            self.starts[known : known + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[known : known + len(part)] = sizes
            self.codes.update(zip(part, range(known, known + len(part)), strict=True))
            known += len(part)
            self.used = need
            self.chars += sum(map(len, part))

    def _codes_of(self, words: list[str]) -> np.ndarray:
        """Every word's code; each word is looked up once, and only unknown ones are learned and looked up again."""
        code = np.fromiter(map(self.codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            unknown = [words[k] for k in missing.tolist()]
            self._learn(unknown)
            code[missing] = np.fromiter(map(self.codes.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        return code

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text, end id included."""
        if len(self.codes) > self.most or self.chars > self.most_chars:
            self._clear()
        split = [t.replace("\n", " ").split(" ") if isinstance(t, str) and t else [] for t in texts]
        words = list(chain.from_iterable(split))
        code = self._codes_of(words)
        sizes = self.sizes[code] if len(code) else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.starts[code] - ends[:-1], sizes) + np.arange(ends[-1]) if len(code) else np.empty(0, np.int64)
        ids = self.flat[places]
        bounds = ends[np.concatenate(([0], np.cumsum([len(p) for p in split]))).astype(np.int64)]
        counts = np.diff(bounds)
        if self.end_id is not None:
            ids = np.insert(ids, bounds[1:], self.end_id).astype("<u4")
            counts = counts + 1
        return ids, counts


def _files(uri: str):
    """The file system of a folder and its path there; local paths and any URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_planes(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, fmt: PlaneFormat = PlaneFormat()) -> list[dict]:
    """Encode whole texts and write shards in ascending doc_id order; the shards' manifest.

    The manifest has one small record for each written partition.
    """
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _files(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        shard = task.partitionId()
        path = f"{top}/shard-{shard:06d}-{task.taskAttemptId()}.twbp"
        writer = sink = None
        encoder = encoder_of(tokenizer, end_id)
        for frame in row_batches(frames):
            ids, counts = encoder.encode(frame["text"].tolist())
            if writer is None:
                sink = store.open_output_stream(path)
                writer = ShardWriter(sink, fmt)
            writer.add([None if pd.isna(x) else int(x) for x in frame["doc_id"]], counts, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pd.DataFrame({"shard": [shard], "path": [path], "bytes": [writer.at], "ids": [writer.total]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInPandas(run, "shard int, path string, bytes long, ids long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["shard"])


def read_planes(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""
    ship(spark)
    base, shards = 0, []
    for m in manifest:
        shards.append((m["path"], m["bytes"], base))
        base += m["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(shards)  # a path and two numbers a shard

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _files(folder)
        for frame in frames:
            for shard in frame["id"]:
                path, size, start = shared.value[shard]
                rows = []
                with store.open_input_file(path) as source:
                    for name, ids in ShardReader(source, size).documents():
                        rows.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return spark.range(0, len(shards), 1, len(shards)).mapInPandas(run, schema)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 2, fmt: PlaneFormat = PlaneFormat()) -> DataFrame:
    """Write ``docs`` as plane files in the shared folder, then read those files."""
    spark = docs.sparkSession
    folder = new_path(spark, "planes")
    return read_planes(spark, folder, write_planes(docs, tokenizer, end_id, folder, fmt))
