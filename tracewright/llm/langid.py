"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased characters, weighted by relative
term frequency times inverse document frequency; document frequencies are counted
over every training document. Weights are learned with follow-the-regularised-leader
under elastic-net penalties, on a bounded sample of labelled rows
(``LangSettings.per_language`` rows of each language; every language that occurs is
learned), and a temperature fitted on a held-back fifth of each language's rows calibrates
the scores.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text when no labelled row can be learned from. Each input row gives one output
row. Of labelled rows with equal doc_id and language the least text is learned from, once;
rows without doc_id are predicted, not learned from. Input columns named lang_pred or
score are replaced; other columns stay. A task holds some 500,000 characters at a time, or
one text, and about 30 bytes for each of its characters, if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, ship
from .ftrl import Ftrl, FtrlSettings, batches, softmax, stacked, sums

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangSettings:
    bits: int = 16
    longest: int = 3
    per_language: int = 400
    scale: float = 100.0
    ftrl: FtrlSettings = FtrlSettings(alpha=0.05, l1=0.02, l2=1e-3, epochs=8)


@dataclass(frozen=True)
class LangModel:
    labels: list[str]
    table: np.ndarray  # idf-weighted weights, feature by label
    bias: np.ndarray
    temperature: float
    settings: LangSettings


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def ngrams(texts, settings: LangSettings) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram of every text (``longest`` to a character), and text bounds.

    A newline is put before and after each text; the n-grams that reach over the end of
    a text take its closing newline and padding in place of the next text's characters.
    """
    pad = "\n" * settings.longest
    joined = "\n" + "".join((t.lower() if isinstance(t, str) else "") + pad for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = [len(t.lower()) + len(pad) if isinstance(t, str) else len(pad) for t in texts]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    shift = np.uint64(64 - settings.bits)
    total = np.zeros(int(bounds[-1]), dtype=np.uint64)
    out = np.empty((len(total), settings.longest), dtype=np.uint32)
    for n in range(settings.longest):
        tail = points[n + 1 : n + 1 + len(total)]
        total[: len(tail)] += (tail + np.uint64(n + 1)) * _ODD[n]
        out[:, n] = ((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    return out, bounds


def _counted(texts, settings: LangSettings):
    features, bounds = ngrams(texts, settings)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield features[a : b - settings.longest].reshape(-1)


def document_frequencies(docs: DataFrame, settings: LangSettings) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, and the number of rows; over every row."""
    size = 1 << settings.bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(size, dtype=np.int64), 0
        for frame in row_batches(frames, 500_000):
            for features in _counted(frame["text"], settings):
                seen = np.zeros(size, dtype=bool)
                seen[features] = True
                total += seen
                rows += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"feature": np.append(some, size), "n": np.append(total[some], rows)})

    counted = docs.select("text").mapInPandas(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most 2**bits + 1 rows
    total = np.zeros(size + 1, dtype=np.int64)
    total[found["feature"]] = found["n"]
    return total[:size], int(total[size])


def labelled_sample(docs: DataFrame, settings: LangSettings) -> DataFrame:
    """At most ``per_language`` rows of each language, by a hash of the id."""
    slim = docs.where("doc_id is not null").select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("_at")).distinct()
    order = Window.partitionBy("lang").orderBy("_at", "doc_id")
    picked = slim.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= settings.per_language)
    rows = docs.join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"])  # per_language ids a language
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, settings: LangSettings = LangSettings()) -> LangModel | None:
    """Learn from the rows of ``docs`` that have a text and a ``lang``."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    frequency, rows = document_frequencies(docs, settings)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in row_batches(frames):
            out = []
            for doc_id, lang, features in zip(frame["doc_id"], frame["lang"], _counted(frame["text"], settings), strict=True):
                distinct, counts = np.unique(features, return_counts=True)
                if len(features):
                    out.append((str(doc_id), lang, distinct.astype("<u4").tobytes(), (counts / len(features)).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "features", "weights"])

    picked = labelled_sample(docs, settings).mapInPandas(run, "doc_id string, lang string, features binary, weights binary")
    sample = picked.toPandas().sort_values(["doc_id", "lang"], kind="stable")
    labels = sorted(set(sample["lang"]))
    if not labels:
        return None
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    size, bias = 1 << settings.bits, 1 << settings.bits
    data = []
    for features, weights in zip(sample["features"], sample["weights"], strict=True):
        f = np.frombuffer(features, "<u4").astype(np.int64)
        data.append((f, np.frombuffer(weights, "<f4") * idf[f] * settings.scale))
    target = np.array([labels.index(x) for x in sample["lang"]])
    order = np.random.default_rng(settings.ftrl.seed).permutation(len(data))
    place = pd.Series(target[order]).groupby(target[order]).cumcount().to_numpy()
    calibrates = place < (np.bincount(target) // 5)[target[order]]  # a fifth of each language, none of fewer than five rows
    held, used = order[calibrates], order[~calibrates]
    model = Ftrl(size, len(labels), settings.ftrl)
    for chosen in batches(len(used), settings.ftrl):
        rows_in = used[chosen]
        distinct, owner, local, values = stacked([data[i] for i in rows_in], bias)
        scores = softmax(sums(owner, values[:, None] * model.weights(distinct)[local], len(rows_in)))
        scores[np.arange(len(rows_in)), target[rows_in]] -= 1
        model.update(distinct, sums(local, values[:, None] * scores[owner], len(distinct)) / len(rows_in))
    weights = model.weights()
    raw = np.array([v @ weights[f] + weights[bias] for f, v in (data[i] for i in held)]).reshape(len(held), len(labels))
    table = (weights[:size] * (idf * settings.scale)[:, None]).astype(np.float32)
    return LangModel(labels, table, weights[bias], _temperature(raw, target[held]), settings)


def _temperature(raw: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(target):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(raw / np.exp(log_t))[np.arange(len(target)), target]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def classify(model: LangModel, texts) -> tuple[list[str], np.ndarray]:
    features, bounds = ngrams(texts, model.settings)
    logits = np.zeros((len(bounds) - 1, len(model.labels)))
    ends = bounds[1:] - model.settings.longest
    counts = ends - bounds[:-1]
    some = counts > 0
    cuts = np.column_stack([bounds[:-1][some], ends[some]]).reshape(-1)
    if len(cuts):
        for n in range(model.settings.longest):
            logits[some] += np.add.reduceat(model.table[features[:, n]], cuts, axis=0, dtype=np.float64)[::2]
        logits[some] /= counts[some, None] * model.settings.longest
    scores = softmax((logits + model.bias) / model.temperature)
    best = scores.argmax(axis=1)
    named = [model.labels[k] if isinstance(t, str) and _LETTER.search(t) else UNKNOWN for t, k in zip(texts, best, strict=True)]
    value = scores[np.arange(len(best)), best]
    value[[x == UNKNOWN for x in named]] = 0.0
    return named, value


def predict(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """``docs`` with lang_pred and score appended; all columns of the input stay."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats for each language

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches_in: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches_in:
            names: list[str] = []
            scores: list[float] = []
            for frame in row_batches([series.to_frame("text")], 500_000):
                if shared.value is None:
                    names += [UNKNOWN] * len(frame)
                    scores += [0.0] * len(frame)
                else:
                    got, value = classify(shared.value, frame["text"].tolist())
                    names += got
                    scores += value.tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "_said")]
    said = docs.select(*kept, scored("text").alias("_said"))
    return said.select("*", F.col("_said.lang_pred").alias("lang_pred"), F.col("_said.score").alias("score")).drop("_said")


def identify(docs: DataFrame, held_out: Column, settings: LangSettings = LangSettings()) -> DataFrame:
    """Learn from rows that are not held out, then predict every row."""
    ship(docs.sparkSession)
    marked = docs.withColumn("held_out", held_out)
    return predict(marked, train(marked.where(~F.col("held_out")), settings))
