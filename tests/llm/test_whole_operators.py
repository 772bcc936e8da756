"""Whole operators that SQL cannot express, against plain versions of them on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontam, langid, toxicity
from tracewright.llm.common import crc_fold
from tracewright.llm.ftrl import FtrlSettings, batches
from tracewright.llm.vectext import word_hashes

SMALL = FtrlSettings(alpha=0.3, l1=0.05, l2=1e-3, epochs=3, batch=7)


class PlainFtrl:
    """Per-coordinate FTRL with dictionaries; feature -1 is the bias."""

    def __init__(self, s):
        self.s, self.z, self.n = s, Counter(), Counter()

    def w(self, f):
        z, l1 = self.z[f], 0.0 if f[0] == -1 else self.s.l1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((self.s.beta + math.sqrt(self.n[f])) / self.s.alpha + self.s.l2)

    def update(self, gradient):
        old = {f: self.w(f) for f in gradient}
        for f, g in gradient.items():
            self.z[f] += g - (math.sqrt(self.n[f] + g * g) - math.sqrt(self.n[f])) / self.s.alpha * old[f]
            self.n[f] += g * g


def test_toxicity_equals_a_plain_refit(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["women", "men", "he"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + (" vile" if i % 3 == 0 else "")) for i in range(90)]
    settings = replace(toxicity.ToxSettings(), bits=9, swap_penalty=0.7, ftrl=SMALL)
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), crc_fold("doc_id", 5) == 0, settings).collect()

    feature = lambda w: int(word_hashes([w], letters=True)[0][0] >> np.uint64(64 - 9))
    swap = {a: b for x, y in toxicity.IDENTITY_PAIRS for a, b in ((x, y), (y, x))}
    data, seen = [], set()
    for i in sorted((i for i in range(90) if zlib.crc32(str(i).encode()) % 5), key=str):
        own = frozenset(map(feature, rows[i][1].split()))
        other = frozenset(feature(swap.get(w, w)) for w in rows[i][1].split())
        if (own, other, labels[i][1]) not in seen:
            seen.add((own, other, labels[i][1]))
            data.append((own, other, labels[i][1]))
    share = sum(y for *_, y in data) / len(data)
    model = PlainFtrl(SMALL)
    logit = lambda fs: model.w((-1,)) + sum(model.w((f,)) for f in fs)
    for chosen in batches(len(data), SMALL):
        gradient = Counter()
        for own, other, y in (data[k] for k in chosen):
            pulls = [(own, (0.5 / share if y else 0.5 / (1 - share)) * (1 / (1 + math.exp(-logit(own))) - y))]
            if own != other:
                change = 2 * settings.swap_penalty * (logit(own) - logit(other))
                pulls += [(own, change), (other, -change)]
            for fs, pull in pulls:
                gradient.update({(f,): pull for f in (*fs, -1)})
        model.update(gradient)
    assert len(got) == 90
    for r in got:
        want = 1 / (1 + math.exp(-logit(set(map(feature, rows[r["doc_id"]][1].split())))))
        assert abs(r["score"] - want) < 1e-5 and r["predicted"] == (r["score"] >= 0.5)


def test_language_identification_equals_a_plain_refit(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice({"x": "abcde ", "y": "cdefg ", "z": "éfgha "}[k]) for _ in range(rng.randint(5, 60))), k) for i in range(100) for k in [rng.choice("xyz")]]
    s = replace(langid.LangSettings(), bits=8, ftrl=SMALL)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), crc_fold("doc_id", 3) == 1, s).collect()

    grams = lambda t: langid.ngrams([t], s)[0][: len(t)].reshape(-1).tolist()
    used = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: (str(r[0]), r[2]))
    df = Counter(f for r in used for f in set(grams(r[1])))
    idf = {f: math.log((1 + len(used)) / (1 + df[f])) + 1 for f in range(256)}
    tf = lambda t: {f: np.float32(c / len(grams(t))) * idf[f] * s.scale for f, c in Counter(grams(t)).items()}
    labels, data = sorted({r[2] for r in rows}), [(tf(r[1]), r[2]) for r in used]
    order = np.random.default_rng(SMALL.seed).permutation(len(data))
    place, count = Counter(), Counter(x[1] for x in data)
    held, kept = [], []
    for k in order:  # a fifth of each language calibrates
        place[data[k][1]] += 1
        (held if place[data[k][1]] <= count[data[k][1]] // 5 else kept).append(k)
    model = PlainFtrl(SMALL)
    raw = lambda x: np.array([model.w((-1, c)) + sum(v * model.w((f, c)) for f, v in x.items()) for c in range(3)])
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for chosen in batches(len(kept), SMALL):
        gradient = Counter()
        for x, y in (data[kept[k]] for k in chosen):
            p = soft(raw(x)) - [c == y for c in labels]
            gradient.update({(f, c): v * p[c] / len(chosen) for f, v in (*x.items(), (-1, 1.0)) for c in range(3)})
        model.update(gradient)
    losses = {t: -sum(math.log(soft(raw(data[k][0]) / t)[labels.index(data[k][1])]) for k in held) for t in np.exp(np.linspace(np.log(0.05), np.log(20), 400))}
    t = min(losses, key=losses.get)
    for r in got:
        p = soft(raw(tf(rows[r["doc_id"]][1])) / t)
        assert r["lang_pred"] == labels[int(p.argmax())] and abs(r["score"] - p.max()) < 0.02


def words_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_leaks(docs, items, s):
    """Every item scored against every passage of every document."""
    bags = {k: words_of(t) for k, t in items if words_of(t)}
    df = Counter(w for b in bags.values() for w in set(b))
    mean = sum(map(len, bags.values())) / len(bags)
    weights = {}
    for k, bag in bags.items():
        norm = s.k1 * (1 - s.b + s.b * len(bag) / mean)
        w = {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * c * (s.k1 + 1) / (c + norm) for t, c in Counter(bag).items()}
        weights[k] = {t: x / sum(w.values()) for t, x in w.items()}
    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    def overlap(part, passage):
        n = min(len(part), s.width)
        return None if not n else len(grams(part, n) & grams(passage, n)) / len(grams(part, n))

    found = set()
    for d, text in docs:
        own = words_of(text)
        for k, item in items:
            if k not in bags:
                continue
            stride = s.stride
            while stride < len(bags[k]):
                stride *= 2
            at = item.find("?") + 1 or len(item)
            for a in range(0, len(own), stride):
                passage = own[a : a + 2 * stride]
                shares = [overlap(words_of(p), passage) for p in (item[:at], item[at:])]
                if sum(weights[k].get(t, 0) for t in set(passage)) >= s.least_score and all(x is None or x >= s.least_overlap for x in shares):
                    found.add((d, k))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_scoring_every_item_in_every_passage(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(150)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n)) + rng.choice(["", "? " + " ".join(some(n // 2 + 1))])) for k, n in enumerate([4, 7, 12, 20, 33, 50, 64, 65, 90, 140, 300, 3])]
    docs = []
    for d in range(60):
        text = some(rng.choice([0, 30, 200, 700]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            cut = rng.choice([0, 0, len(part) // 2])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[:cut] + some(rng.choice([0, 40])) + part[cut:] if cut else part
        docs.append((d, " ".join(text)))
    s, table = decontam.DecontamSettings(), spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items, s)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table, bench).collect()} == want and len(want) > 20
    assert {r["doc_id"] for r in decontam.clean(table, bench).collect()} == set(range(60)) - {d for d, _ in want}


def test_a_match_does_not_depend_on_other_items(spark):
    far = " ".join(f"q{i}" for i in range(8)) + "? " + " ".join(f"a{i}" for i in range(8))
    question, answer = far.split("? ")
    docs = spark.createDataFrame([(1, question + " " + " ".join(f"x{i}" for i in range(600)) + " " + answer), (2, far), (None, far), (4, None)], "doc_id long, text string").withColumn("item_id", F.lit("k"))
    for extra in ([], [(9, " ".join(f"z{i}" for i in range(1500)))]):
        bench = spark.createDataFrame([(7, far), (None, None), *extra], "item_id long, text string")
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()), key=str)
        assert got == [(2, 7), (None, 7)]
        assert sorted(str(r["doc_id"]) for r in decontam.clean(docs, bench).collect()) == ["1", "4"]


def test_long_texts_and_empty_tables_of_the_classifiers(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 150_000, "la"), (2, "dolor sit", "la"), (3, "x" * 300_000, "xx"), (4, None, None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.detect(docs, marks, F.lit(False)).count() == langid.identify(docs, F.lit(False)).count() == 4
    assert toxicity.detect(docs.limit(0), marks, F.lit(False)).count() == 0
    assert decontam.leaks(docs, docs.select(F.col("doc_id").alias("item_id"), "text").where("item_id = 2")).count() == 1
