"""Toxicity: a counterfactual-regularised logistic classifier on hashed words.

A training text's identity terms (words that name a group) are swapped for their
counterparts, and the squared change of the score's logit that the swap causes is
penalised beside the log loss. A term that merely co-occurs with toxic labels thus
gains little weight of its own, which lowers false positives on neutral mentions.
Weights are learned with follow-the-regularised-leader (elastic net) on a bounded
sample of labelled rows (``ToxSettings.max_rows`` of each label). Each word of a text counts
once, wherever it stands; scoring reads whole texts, about 1 MB at a time, or one text and
some 40 bytes for each of its characters if it is longer.

Defined results: a null text is an empty one; empty texts get the score that the bias
alone gives; without labels of both kinds every score is 0. Each input row gives one
output row. A label row whose doc_id is null or absent from the documents is ignored;
a doc_id labelled more than once is toxic if any of its labels says so; of documents with
one doc_id the least text is learned from. Input columns named score or predicted are
replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, ship
from .ftrl import Ftrl, FtrlSettings, batches, stacked, sums
from .vectext import word_hashes

# Pairs of words that name groups; each word stands for the other one.
IDENTITY_PAIRS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"),
    ("black", "white"), ("gay", "straight"), ("lesbian", "heterosexual"), ("immigrant", "citizen"),
    ("immigrants", "citizens"), ("foreign", "native"), ("african", "european"), ("asian", "american"),
    ("disabled", "abled"), ("old", "young"), ("poor", "rich"),
)


@dataclass(frozen=True)
class ToxSettings:
    bits: int = 18
    max_rows: int = 3000
    swap_penalty: float = 1.0
    pairs: tuple[tuple[str, str], ...] = IDENTITY_PAIRS
    ftrl: FtrlSettings = FtrlSettings(alpha=0.5, l1=30.0, l2=1e-3, epochs=8, batch=16)


@dataclass(frozen=True)
class ToxModel:
    weights: np.ndarray
    bias: float
    bits: int


def _swaps(settings: ToxSettings) -> tuple[np.ndarray, np.ndarray]:
    both = [*settings.pairs, *((b, a) for a, b in settings.pairs)]
    source, _ = word_hashes([a for a, _ in both], letters=True)
    target, _ = word_hashes([b for _, b in both], letters=True)
    order = np.argsort(source)
    return source[order], target[order]


def _distinct(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(hashes >> np.uint64(64 - bits)).astype("<u4")


def _sample(docs: DataFrame, labels: DataFrame, settings: ToxSettings) -> DataFrame:
    """Labelled rows, at most ``max_rows`` of each label, chosen by a hash of the id.

    Each label's count bounds the hashes first, to about one and a half times the rows
    wanted, so no label is sorted whole.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.withColumn("_at", F.xxhash64(F.col("doc_id").cast("string")))
    share = F.least(F.lit(1.0), (1.5 * settings.max_rows + 100) / F.count("*"))
    wide = marked.groupBy("toxic").agg((share * 2**32).alias("_most"))  # a row for each label
    few = marked.join(F.broadcast(wide), "toxic").where(F.pmod("_at", F.lit(2**32)) <= F.col("_most"))
    order = Window.partitionBy("toxic").orderBy(F.pmod("_at", F.lit(2**32)), "_at", "doc_id")
    chosen = few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= settings.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, settings: ToxSettings = ToxSettings()) -> ToxModel | None:
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, target = _swaps(settings)
        for frame in row_batches(frames):
            words, bounds = word_hashes(frame["text"], letters=True)
            place = np.minimum(np.searchsorted(source, words), max(0, len(source) - 1))
            swapped = np.where(source[place] == words, target[place], words) if len(source) else words
            out = []
            for i, (doc_id, toxic) in enumerate(zip(frame["doc_id"], frame["toxic"], strict=True)):
                own, other = (_distinct(x[bounds[i] : bounds[i + 1]], settings.bits) for x in (words, swapped))
                out.append((str(doc_id), int(toxic), own.tobytes(), other.tobytes() if not np.array_equal(own, other) else None))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "own", "other"])

    rows = _sample(docs, labels, settings).mapInPandas(run, "doc_id string, toxic int, own binary, other binary")
    sample = rows.toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    sample = sample.drop_duplicates(["own", "other", "toxic"])  # copies would count a text many times
    return fit(sample, settings) if sample["toxic"].nunique() == 2 else None


def fit(sample: pd.DataFrame, settings: ToxSettings) -> ToxModel:
    """Log loss plus ``swap_penalty`` times the squared change of the logit under the swap."""
    bias = 1 << settings.bits
    unit = lambda raw: (f := np.frombuffer(raw, "<u4").astype(np.int64), np.ones(len(f)))
    own = [unit(x) for x in sample["own"]]
    other = [unit(x) if isinstance(x, bytes | bytearray) else None for x in sample["other"]]
    target = sample["toxic"].to_numpy()
    share = target.mean()
    model = Ftrl(bias, 1, settings.ftrl)
    for chosen in batches(len(own), settings.ftrl):
        twins = [i for i in chosen if other[i] is not None]
        rows = [own[i] for i in chosen] + [own[i] for i in twins] + [other[i] for i in twins]
        features, owner, local, values = stacked(rows, bias)
        logits = sums(owner, values[:, None] * model.weights(features)[local], len(rows))[:, 0]
        n, m = len(chosen), len(twins)
        pull = np.zeros(len(rows))
        weight = np.where(target[chosen] == 1, 0.5 / share, 0.5 / (1 - share))
        pull[:n] = weight * (1 / (1 + np.exp(-logits[:n])) - target[chosen])
        change = 2 * settings.swap_penalty * (logits[n : n + m] - logits[n + m :])
        pull[n : n + m], pull[n + m :] = change, -change
        model.update(features, sums(local, (values * pull[owner])[:, None], len(features)))
    weights = model.weights()[:, 0]
    return ToxModel(weights[:bias].astype(np.float32), float(weights[bias]), settings.bits)


def _score(model: ToxModel | None, texts) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    words, bounds = word_hashes(texts, letters=True)
    features = (words >> np.uint64(64 - model.bits)).astype(np.int64)
    live = np.flatnonzero(model.weights[features])  # the penalties leave few weights
    owner = np.searchsorted(bounds, live, side="right") - 1
    once = np.unique((owner << model.bits) | features[live])
    logits = np.bincount(once >> model.bits, model.weights[once & ((1 << model.bits) - 1)], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def score(docs: DataFrame, model: ToxModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on) appended."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats

    @F.pandas_udf("double")
    def scored(series_in: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in series_in:
            parts = [_score(shared.value, f["text"].tolist()) for f in row_batches([series.to_frame("text")], 1_000_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(text_col).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, held_out: Column, settings: ToxSettings = ToxSettings()) -> DataFrame:
    """Learn from labels of rows that are not held out, then score every row."""
    model = train(docs, labels.where(~held_out), settings)
    return score(docs.withColumn("held_out", held_out), model)
