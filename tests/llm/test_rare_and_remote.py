"""Rare languages, large corpora, any rule expression, and workers that do not find the package by themselves."""

import random
import re
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brute import repeated_bytes
from tracewright.llm import langid, mixing, secrets, suffix_dedup

ROOT = Path(__file__).resolve().parent.parent.parent

_RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
{what}
spark.stop()
"""


def elsewhere(tmp_path, what):
    """Run ``what`` in another working directory, where no worker finds the package unless it is shipped."""
    script = tmp_path / "run.py"
    script.write_text(_RUN.format(root=str(ROOT), what=what))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_training_alone_ships_the_package(tmp_path):
    said = elsewhere(tmp_path, """
from tracewright.llm import langid
docs = spark.createDataFrame([(i, "abc def" if i % 2 else "xyz uvw", "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string").repartition(2)
print(langid.train(docs).labels)
""")
    assert "['x', 'y']" in said


def test_pipeline_runs_outside_of_the_repository(tmp_path):
    said = elsewhere(tmp_path, """
import os
os.makedirs("in")
for name in ("documents", "benchmark"):
    spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"in/{name}.parquet")
import corpus_pipeline
print("rows", corpus_pipeline.run(spark, os.path.abspath("in")).count())
""")
    assert int(re.search(r"rows (\d+)", said)[1]) > 50


def test_a_language_of_one_row_is_learned(spark):
    letters = {"en": "abcdefgh", "el": "αβγδεζηθ", "ru": "абвгдежз", "he": "אבגדהוזח", "ka": "აბგდევზთ", "th": "กขคฆงจฉช", "ko": "가나다라마바사아"}
    rng = random.Random(3)
    words = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(n))
    rows = [(i, words("en", 30), "en") for i in range(80)] + [(100 + k, words(lang, 60), lang) for k, lang in enumerate(letters) if lang != "en"]
    for seed in (1, 2, 3):
        settings = replace(langid.LangSettings(), ftrl=replace(langid.LangSettings().ftrl, seed=seed))
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), settings)
        named, _ = langid.classify(model, [words(lang, 40) for lang in letters])
        assert named == list(letters)


def exact_share(budget, children):
    """Water filling in integers: the weights' ratios decide, then shares are rounded cumulatively."""
    total = min(budget, sum(c for c, w in children.values() if w))
    order = sorted((k for k, (_, w) in children.items() if w), key=lambda k: (children[k][0] / children[k][1], k))
    given, left, later = dict.fromkeys(children, 0), total, sum(children[k][1] for k in order)
    while order and children[order[0]][0] * later <= left * children[order[0]][1]:
        cap, weight = children[order[0]]
        given[order.pop(0)] = cap
        left, later = left - cap, later - weight
    done = 0
    for k in order:
        given[k] = left * (done + children[k][1]) // later - left * done // later
        done += children[k][1]
    return given


@pytest.mark.parametrize(("count", "tokens", "weight"), [(400, 10**13, 5000), (3, 4 * 10**14, 10_000), (50, 10**17, 10**9)])
def test_shares_of_a_large_corpus_do_not_overflow(spark, count, tokens, weight):
    rng = random.Random(count)
    children = {f"c{k:03}": (rng.randint(1, tokens), rng.randint(1, weight)) for k in range(count)}
    budget = sum(c for c, _ in children.values()) * 3 // 5
    df = spark.createDataFrame([("p", k, c, w) for k, (c, w) in children.items()], "parent string, name string, cap long, weight long")
    got = {r["name"]: r["given"] for r in mixing.share(df, ["parent"], "name", F.lit(budget).cast("long"), "cap", "weight").collect()}
    assert got == exact_share(budget, children) and sum(got.values()) == budget


def longest_matches(pattern, text):
    """Leftmost, longest, non-overlapping matches of one or more characters, by trying every span."""
    found, at, rule = [], 0, re.compile(pattern, re.A)
    while at < len(text):
        ends = [e for e in range(len(text), at, -1) if "\n" not in text[at:e] and rule.fullmatch(text, at, e)]
        if ends:
            found.append((at, ends[0]))
            at = ends[0]
        else:
            at += 1
    return found


def scanned(pattern, text):
    rules = (secrets.Rule("r", pattern, 1),)
    spans = secrets._reports(secrets.Scanner(rules, *secrets.compile_rules(rules)), [text])[0][2]
    return [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s]


@pytest.mark.parametrize("pattern", [r"AKIA[A-Z0-9]{4}", r"\d+", r"[^a]+", r"(?:ab|c){2,3}", r"a.c", r"[\w-]{2,}x", r"\W\d?", r"[^\d\s]{1,2}é?".replace("é", "z"), r"x{,2}y", r"\.\*", r"[]a-]+", r"[^]a]b", r"(a|ab)(c|bcd)", r"a{2}|b+c*", r"[\D]b", r"\x41{1,}", "{a}", r"\S+@\S+"])
def test_rules_mean_what_regexes_mean(pattern):
    rng = random.Random(pattern)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "c", "ab", "bcd", "x", "y", "z", "A", "AKIA", "AB12", "7", "-", "]", ".", "*", " ", "\t", "é", "中", "\U0001f600", "{a}", "@", "\n"]) for _ in range(rng.randint(0, 12)))
        assert scanned(pattern, text) == longest_matches(pattern, text), text


def test_random_rules_mean_what_regexes_mean():
    rng = random.Random(9)

    def rule(depth=0):
        kind = rng.random()
        if depth > 2 or kind < 0.4:
            return rng.choice(["a", "b", "c", "[ab]", "[^a]", ".", r"\d", r"\w", "[b-c7]"])
        if kind < 0.6:
            return rule(depth + 1) + rule(depth + 1)
        if kind < 0.75:
            return f"(?:{rule(depth + 1)}|{rule(depth + 1)})"
        return f"(?:{rule(depth + 1)})" + rng.choice(["?", "*", "+", "{2}", "{1,2}", "{0,2}", "{2,}"])

    for _ in range(120):
        pattern = rule()
        text = "".join(rng.choice("aabbc7é ") for _ in range(rng.randint(1, 9)))
        assert scanned(pattern, text) == longest_matches(pattern, text), (pattern, text)


@pytest.mark.parametrize("pattern", [r"\bab", "^a", "a$", "a+?", "a*+", "a{2}{3}", "(?=a)", "(?P<x>a)", r"(a)\1", "é", "(a", "[a", "a)", "*a", "a{3,2}", "a{0}", "a{2000}", "[z-a]", r"[\d-z]", r"\q", "a\nb", "\\"])
def test_rules_that_are_not_supported_are_errors(pattern):
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("r", pattern, 1),))


def test_removal_with_null_ids_clashing_columns_and_a_long_text(spark, monkeypatch):
    rng = random.Random(4)
    part = "".join(rng.choices("abcdefgh ", k=900))
    long = "".join(rng.choices("abcdefghijklmnop ", k=3_000_000))
    rows = [(None, part), (None, part + "x"), (None, None), (1, "é" + part[:300]), (1, long[5000:9000]), (2, long + part[:250] + long[:400])]
    extra = [(*r, *["q"] * 4) for r in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, name string, low string, n_bytes string, check string").repartition(3)
    want = repeated_bytes([(i, t) for i, t in rows])
    assert sorted((tuple(r) for r in suffix_dedup.deduplicate(docs).collect()), key=repr) == want


def test_rows_of_one_name_are_told_apart(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    names = suffix_dedup._named(docs, F.lit(5).cast("long"))
    assert names.select("name").distinct().count() == 50 and names.columns == ["doc_id", "text", "name"]
    same = suffix_dedup._named(docs.unionAll(docs), F.lit(5).cast("long"))
    assert same.select("name").distinct().count() == 50
