import random
from dataclasses import replace

import numpy as np
import pytest

from brute import jaccard_components, repeated_bytes
from tracewright.llm import ngram_join, suffix_dedup
from tracewright.llm.ngram_join import JoinSettings
from tracewright.llm.suffix_dedup import DedupSettings


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120, 400]))] for _ in range(n // 6)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        doc = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 6, 15])):
            if doc:
                doc[rng.randrange(len(doc))] = rng.choice(words)
        if rng.random() < 0.4:
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = passage
        rows.append((i, rng.choice(["  ", "\n", " "]).join(w.upper() if rng.random() < 0.2 else w for w in doc)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "é ñ 中 " * 90), (n + 6, "a " * 30000)]
    return rows


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


TIGHT = {"count_least": 1, "small": 2, "block_shingles": 300}


@pytest.mark.parametrize("tight", [{}, {"hot": 20, **TIGHT, "star_rounds": 0}, {**TIGHT, "star_rounds": 2}])
def test_components_match_brute_force(spark, rows, tight):
    got = ngram_join.join(frame(spark, rows), replace(JoinSettings(), part_rows=500, **tight)).collect()
    assert sorted(map(tuple, got)) == jaccard_components(rows)


def test_join_of_nulls_repeats_and_clashing_columns(spark):
    data = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (3, "a b c d e f", "z"), (5, "q r s t u v", ""), (5, "a b c d e f", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, bits string").withColumnRenamed("bits", "component_id")
    got = sorted(map(tuple, ngram_join.join(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (5, 2, 1), (5, 2, 1)], key=repr)


def test_blocks_unite_what_links_and_nothing_else():
    rng = random.Random(8)
    base = rng.sample(range(10**6), 60)
    sets = [sorted(set(base[k % 3 :]) - set(rng.sample(base, rng.randrange(12))) | {10**7 + 100 * k + j for j in range(rng.randrange(14))}) for k in range(90)]
    arrays = [np.array(x, dtype=np.uint64) for x in sets]
    everyone = np.ones(len(sets), dtype=bool)
    links = ngram_join.settle_block(np.arange(len(sets)), arrays, np.arange(len(sets)), everyone, everyone, 75)
    similar = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))
    assert all(similar(a, b) for a, b in links)

    def groups(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    assert groups(links) == groups((a, b) for a in range(90) for b in range(a) if similar(a, b))
    assert len(links) == 90 - len(set(groups(links)))


def test_join_of_an_empty_table(spark):
    assert ngram_join.join(frame(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [200_000, 5])
def test_removed_bytes_match_brute_force(spark, rows, hot):
    rows = [(i, t[:4000] if t else t) for i, t in rows]
    rows += [(900, "z" * 700), (901, "ab" * 300), (902, "z" * 199), (903, rows[3][1]), (903, rows[3][1])]
    got = suffix_dedup.deduplicate(frame(spark, rows), replace(DedupSettings(), hot=hot, part_rows=3000)).collect()
    assert sorted(map(tuple, got), key=repr) == repeated_bytes(rows)


def test_removal_from_an_empty_table(spark):
    assert suffix_dedup.deduplicate(frame(spark, [])).collect() == []


def test_anchors_do_not_depend_on_segments():
    data = np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    whole = suffix_dedup.anchors(data, DedupSettings())
    parts = suffix_dedup.anchors(data, DedupSettings(), segment=777)
    assert set(whole[0].tolist()) == set(parts[0].tolist())
    cover = lambda x: sorted(s for a, b in zip(x[2], x[3], strict=True) for s in range(a, b + 1))
    assert cover(whole) == cover(parts) == list(range(4801))


@pytest.mark.parametrize("length", [3, 8, 21, 40])
def test_windows_are_ordered_by_their_bytes(length):
    rng = random.Random(length)
    base = bytes(rng.choices(b"ab", k=60))
    text = b"".join(base[: rng.randrange(60)] + bytes(rng.choices(b"abc\xff\x00", k=rng.randrange(9))) for _ in range(60))
    starts = np.array([rng.randrange(len(text) - length + 1) for _ in range(700)])
    first, lead = (np.array(rng.choices(range(3), k=700)) for _ in range(2))
    at, group = suffix_dedup.equal_windows(np.frombuffer(text, np.uint8), starts, first.astype(np.uint64), lead, length)
    keys = [(first[i], lead[i], text[starts[i] : starts[i] + length]) for i in range(700)]
    assert sorted(at.tolist()) == [i for i in range(700) if keys.count(keys[i]) > 1]
    assert [keys[i] for i in at] == sorted(keys[i] for i in at)
    assert [keys[a] != keys[b] for a, b in zip(at[1:], at, strict=False)] == (group[1:] != group[:-1]).tolist()


def test_a_pair_is_listed_by_runs_of_shared_shingles_not_by_tasks(spark):
    rng = random.Random(5)
    text = [f"v{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join([*text, f"end{i}"])) for i in range(6)]  # 15 pairs, each with some 225 shared shingles in its prefixes
    known = np.empty(0, np.uint64), np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast(known)
    tiles = ngram_join._tiles(ngram_join._postings(frame(spark, rows), shared, 64, JoinSettings()), shared, JoinSettings()).toPandas()
    assert len(tiles[["a", "b"]].drop_duplicates()) == 15
    assert len(tiles) <= 15 * 4  # 15 for each of 64 tasks before


def test_a_shingle_after_a_dealt_one_is_no_part_of_a_run():
    p = np.array([5, 6, 7], dtype=np.uint64)
    known = np.array([6], dtype=np.uint64), np.array([10])
    ahead = ngram_join._ahead(p, known, replace(JoinSettings(), hot=10))
    assert ahead[0] == 0 and ahead[1] != 0 and ahead[2] == 0
