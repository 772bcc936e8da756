"""Source divergence, centroid clustering and page text against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import divergence, hamerly, pagetext

CLASH = "slot string, term string, n long, total long, place int, bucket int, value long, rank int"


def documents(spark, rows):
    """(text, lang, source) rows with ids and columns that clash with the operator's own."""
    return spark.createDataFrame([(i, *r, *[None] * 8) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


def plain_audit(rows, least=10, shown=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in own.items()}
        q = share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own:
            found = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            for rank, (value, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, s, "pair", o, value, rank))
            more = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for rank, (value, t) in enumerate(sorted(more, key=lambda x: (-x[0], x[1].encode()))[:shown], 1):
                out.append((lang, s, "term", t, value, rank))
    return sorted(out)


def audited(spark, rows, **settings):
    return sorted(tuple(r) for r in divergence.audit(documents(spark, rows), divergence.AuditSettings(**settings)).collect())


def test_audit_equals_plain_version(spark):
    rng = random.Random(3)
    words = ["the", "The", "é", "née", "中文", "x1y", "a-b", "zz", "ÀB", "\U0001f600", "it's", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choice(words[: 8 + 3 * (i % 7)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, "fr"]), rng.choice(["s1", "s2", "é", "", None, "s3"])) for i in range(400)]
    rows += [(None, "en", "null text"), ("", "xx", "a"), ("no kept term", "xx", "b"), (None, None, None), ("word " * 3, "yy", "only")]
    want = plain_audit(rows)
    assert audited(spark, rows) == want
    assert audited(spark, rows, bucket=7, sources=2) == want  # many buckets, pairs of blocks
    assert audited(spark, rows, held=5, piece=64) == want  # counts passed on early, texts in pieces
    assert audited(spark, []) == []


def test_audit_of_a_very_long_text(spark):
    text = "alpha beta " * 120_000 + "x" * 300_000
    rows = [(text, "en", "long")] + [("alpha gamma", "en", "short")] * 12
    assert audited(spark, rows) == plain_audit(rows)


def test_equal_hashes_are_told_apart_by_bytes():
    data = np.frombuffer(b"one two one three two six", np.uint8)
    starts, ends = divergence.boundaries(data, np.array([0]))
    group, chosen = divergence.grouped(data, starts, ends, digest=lambda x: 7)
    named = [bytes(data[starts[chosen[g]] : ends[chosen[g]]]) for g in group]
    assert named == [b"one", b"two", b"one", b"three", b"two", b"six"]


def test_terms_end_where_texts_do():
    starts, ends = divergence.boundaries(np.frombuffer(b"abcd", np.uint8), np.array([0, 2]))
    assert list(zip(starts, ends, strict=True)) == [(0, 2), (2, 4)]


def test_probabilities_do_not_overflow():
    count, size, kept = 3 * 10**14, 7 * 10**14, 12345
    assert divergence.probability(np.array([count]), size, kept)[0] == 1 + 10**9 * (count + 2) // (size + 2 * kept)


# --- clusters


def plain_clusters(rows, k=8, dim=64, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) < 2**17 for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    points = np.array([v for _, v in kept], dtype=object)
    for step in range(rounds + 1):
        all_of = [[sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres] for p in points]
        own = [min(range(len(centres)), key=lambda c: (d[c], c)) for d in all_of]
        if step < rounds:
            for c in range(len(centres)):
                mine = [p for p, o in zip(points, own, strict=True) if o == c]
                if mine:
                    centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    best = [d[o] for d, o in zip(all_of, own, strict=True)]
    inertia = Counter()
    for o, d in zip(own, best, strict=True):
        inertia[o] += d
    return sorted(((i, o, d, inertia[o], sum(best), names[o]) for (i, _), o, d in zip(kept, own, best, strict=True)), key=repr)


def clustered(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], "vec_id long, embedding array<float>, block long, own string").repartition(3)
    return sorted((tuple(r) for r in hamerly.report(hamerly.cluster(df, hamerly.ClusterSettings(**settings)), spark).collect()), key=repr)


def test_clusters_equal_plain_version(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[4][1])]  # ties, repeated ids, no id
    rows += [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] + [0.0] * 63), (904, [float("inf")] * 64), (905, [2.0**17] * 64), (906, [])]
    assert clustered(spark, rows, block=16) == plain_clusters(rows)
    few = [(i, [float(i % 2)] * 64) for i in range(3)]
    assert clustered(spark, few) == plain_clusters(few)
    same = [(i, [0.5] * 64) for i in range(20)]
    assert clustered(spark, same) == plain_clusters(same)
    assert clustered(spark, [(1, None)]) == [] == clustered(spark, [])


def test_bounds_spare_scans_and_rounds_do_not_shuffle(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 5, (8, 64))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.2, 64)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hamerly.cluster(df, hamerly.ClusterSettings(block=32), trace=True)
    assert found.scanned[0] == 400 and sum(found.scanned[1:]) < 400
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hamerly.cluster(df, hamerly.ClusterSettings(block=32))
        plan = found.rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan  # both sides lie in the same buckets
        assert found.rows.count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# --- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("plain < text &nbsp; & more &amp", "plain < text & more &"),
        ("<article><h1>T &eacute;</h1><p>a<b>b</b>\n\n c<br>d<p>e</article>", "T é ab c d e"),
        ("<head><title>no</title><style>p{}</style></head><body><nav>menu</nav><main>yes</main><footer>f</footer>", "yes"),
        ("<script>var t='<p>x</p>';</script><p>yes<script>open", "yes"),
        ("<article>one<!-- <p>no</p> -->two</article><!-- unclosed <p>no", "onetwo"),
        ("<article>a<aside>no</aside><div class='share-box'>no</div><form>no</form><div class=ad>no</div>b</article>", "a b"),
        ("<article>a<section id='comments'><article class='comment'>no</article></section></article>", "a"),
        ("<div class='page with-sidebar'><article>yes</article></div>", "yes"),
        ("<form id=all><article>yes</article></form>", "yes"),
        ("<article><header><h1>Title</h1></header>text<footer>no</footer></article>", "Title text"),
        ("<p>open<div class='cookie-notice'>no</div><p class=advert>no<p>text", "open text"),
        ("<div role=navigation>no</div><div role=main>yes</div><p>tail", "yes"),
        ("<div hidden>no</div><div style='display: none'>no</div><p aria-hidden=true>no</p>yes", "yes"),
        ("<article><p title=\"a>b\">x</p><p title='>'>y</p><p title=\"open>z</article>", "x y z"),
        ("<article>&lt;b&gt; &#65;&#x42; &copy 1 &notanentity;</article>", "<b> AB © 1 ¬anentity;"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<ARTICLE>A<P>b</P></ARTICLE><NAV>no</NAV>", "A b"),
        ("<article><pre>x\n   y\tz</pre><![CDATA[q<r]]></article>", "x y z q<r"),
        ("<article>a<button>no</button><select><option>no</select><textarea>no</textarea>b</article>", "a b"),
        ("<article>a</div></span></p>b</article></article>", "a b"),
    ],
)
def test_main_text_of_a_page(spark, page, text):
    kept = pagetext.Page.of(page).kept
    assert " ".join(t for _, t, _ in kept) == text


def plain_pages(rows, depth=8):
    """Windows of every host by a dictionary, then tokens one by one."""
    pages = [(pagetext.host_of(url), pagetext.Page.of(h)) for _, url, h in rows]
    seen = defaultdict(set)
    for host, page in pages:
        for run in page.runs:
            t = run.split(" ")
            for i in range(len(t) - depth + 1):
                seen[host, tuple(t[i : i + depth])].add(page.name)
    out = []
    for (i, url, _), (host, page) in zip(rows, pages, strict=True):
        flags = []
        for run in page.runs:
            t = run.split(" ")
            gone = [False] * len(t)
            for k in range(len(t) - depth + 1):
                if len(seen[host, tuple(t[k : k + depth])]) > 1:
                    gone[k : k + depth] = [True] * depth
            flags += list(zip(t, gone, strict=True))
        words = []
        for zone, text, at in page.kept:
            own = text.split(" ")
            if zone == pagetext.CONTENT:
                words += own
            else:
                assert [t for t, _ in flags[at : at + len(own)]] == own
                words += [t for t, g in flags[at : at + len(own)] if not g]
        out.append((i, url, " ".join(words), len(" ".join(words))))
    return sorted(out, key=repr)


def test_repeats_of_a_host_leave_open_text(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    menu = "<div>" + " ".join(f"m{i}" for i in range(12)) + "</div>"
    legal = "<p>" + " ".join(f"l{i}" for i in range(9)) + "</p>"
    rows = []
    for i in range(120):
        story = "".join(f"<p>{' '.join(rng.choices(words, k=rng.randint(3, 40)))}</p>" for _ in range(rng.randint(1, 4)))
        host = f"http://h{i % 3 if i % 2 else 0}.example/{i}"
        body = [menu + story + legal, f"<article>{story}<div class=info>{menu}</div></article>{legal}", story][i % 3]
        rows.append((i, host, body))
    rows += [(0, rows[0][1], rows[0][2]), (300, rows[0][1] + "?copy", rows[0][2]), (None, None, menu), (301, None, None), (302, "http://alone/", menu + legal)]
    rows.append((303, "http://h0.example/long", menu + "<p>" + "long text " * 200_000 + "</p>" + legal))
    extra = [(*r, *["x"] * 4) for r in rows]
    df = spark.createDataFrame(extra, "page_id long, url string, html string, text string, host string, key string, runs string").repartition(4)
    got = sorted((tuple(r) for r in pagetext.extract(df).collect()), key=repr)
    want = plain_pages(rows)
    assert got == want
    by_id = {g[0]: g[2] for g in got}
    assert "m3" not in by_id[0] and "l3" not in by_id[0] and "m3" not in by_id[1] and by_id[302].startswith("m0")
    assert got[0][1:] is not None and by_id[303].startswith("long") and by_id[303].endswith("text")
    assert pagetext.extract(df.limit(0)).collect() == []


def test_suffixes_are_in_order():
    rng = random.Random(2)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(20)]
    hosts = np.array([i % 3 for i in range(20)])
    place, new, owner = pagetext.repeated([s for s in streams], hosts, 5)
    flat = [t for s in streams for t in s]
    suffix = [(hosts[owner[p]], flat[p : p + 5]) for p in place]
    assert suffix == sorted(suffix) and [a != b for a, b in zip(suffix[1:], suffix, strict=False)] == new[1:].tolist()
    assert len(place) == sum(max(0, len(s) - 4) for s in streams)
