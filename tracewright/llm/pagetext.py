"""Main text of web pages: markup zones, and a suffix array of each host's other text.

A scan of the markup gives blocks of text, each in a zone. Text inside ``article`` or
``main`` (or what is marked as one) is content. Menus, headers, footers, asides, forms,
buttons, hidden parts and elements whose class, id or role names an advert, a notice,
comments and the like are dropped. Text in neither is open, and so are parts of an article
that only might be boilerplate (``WEAK``): there a host's other pages decide. An article
keeps its own header, which holds its title. A page with an article has no open text
outside of it.

The token streams of all text that is not content are concatenated per host, and their
suffixes sorted to ``depth`` tokens by prefix doubling, a slice of pages at a time. Equal
neighbours make one row, with the least and greatest page they occur in; Spark merges the
slices' rows by (host, tokens), so a host is never gathered in a task. Where these two
pages differ, the run is boilerplate: its tokens are taken out of open text, and longer
repeats go as overlapping runs; what is unique is kept. Pages whose two longest blocks are
the same are taken as copies of one page, so copies do not make each other boilerplate.

Repeats are not taken out of marked articles: copies and quoted passages are repeated too,
on one host, and belong to the text. (README has figures.)

Defined results: a null or empty page has an empty text; character references are decoded
(also without a semicolon where HTML allows it), every run of white space, no-break spaces
included, is one space; markup that never ends counts as HTML's own rules say for comments,
scripts and styles, else as text. Null urls are one host, ''. Every input row gives one row,
repeated rows and equal page_ids too; an empty table gives no rows; other columns are
ignored. A page is held whole in a task, with about ten times its length of working memory.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, row_batches, ship, written


@dataclass(frozen=True)
class PageSettings:
    depth: int = 8  # tokens of a run that counts as repeated


CONTENT, OPEN, WEAK, SOFT, DROPPED = range(5)

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
_WORD = re.compile(r"[a-z]+")

_RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside button select datalist dialog menu object audio video canvas svg math map".split())
_CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())

# Words of class, id or role. Parts so named are dropped; comments for good, others unless an article begins inside.
_COMMENTS = frozenset("comment comments commentlist disqus discussion respond reply replies".split())
_STRONG = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation navigational menu menubar breadcrumb breadcrumbs masthead footer contentinfo complementary sidebar sidebars aside cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login signin share sharing social related recommended recommendations recirculation pagination pager search searchform skip copyright disclaimer toolbar widget widgets".split())
_WEAK = frozenset("header info note notes meta byline author tags tools teaser more extra box hint tip outro intro bottom top".split())
_MARKED = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body main-content".split())


@lru_cache(maxsize=4096)
def hinted(attrs: str) -> int | None:
    """The zone that an element's attributes ask for; None: none."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), "".join(values).lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return DROPPED
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = set(_WORD.findall(named))
    if words & _COMMENTS:
        return DROPPED
    if found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody" or set(named.replace("_", "-").split()) & _MARKED:
        return CONTENT
    if words & _STRONG:
        return SOFT
    return WEAK if words & _WEAK else None


def zone_of(name: str, attrs: str, zone: int) -> int:
    """The zone inside an element that begins in ``zone``."""
    if zone == DROPPED or name in _DROPPED or name == "header" and zone not in (CONTENT, WEAK):
        return DROPPED
    asked = hinted(attrs) if attrs and name not in ("html", "body") else None
    if name in ("article", "main"):
        return DROPPED if asked == DROPPED else CONTENT
    if asked in (CONTENT, DROPPED):
        return asked
    if zone == SOFT or name == "form" or asked == SOFT:
        return SOFT
    return WEAK if asked == WEAK and name not in ("h1", "h2") else zone


class _Scan:
    """Blocks of a page, in order: (zone, text)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.zone = OPEN
        self.stack: list[tuple[str, int]] = []  # elements that are open, with the zone around them
        self.open: dict[str, int] = {}

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((self.zone, text))
            self.parts = []

    def start(self, name: str, attrs: str) -> None:
        inline = name in _INLINE
        if name == "br":
            self.parts.append(" ")
            return
        if not inline:
            self.flush()
            if self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == name and name in _CLOSED_BY_SAME):
                self._pop()
        if name in _VOID or attrs.endswith("/") and name in ("svg", "math"):
            return
        if name == "body" and self.open.get("head"):
            self.end("head")
        zone = zone_of(name, attrs, self.zone)
        if zone != self.zone or not inline and name not in _CLOSED_BY_SAME:
            if zone != self.zone:
                self.flush()
            self.stack.append((name, self.zone))
            self.open[name] = self.open.get(name, 0) + 1
            self.zone = zone

    def _pop(self) -> str:
        name, around = self.stack.pop()
        self.open[name] -= 1
        if around != self.zone:
            self.flush()
        self.zone = around
        return name

    def end(self, name: str) -> None:
        if name not in _INLINE:
            self.flush()
        if self.open.get(name):
            while self._pop() != name:
                pass


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Zone and text of every block of a page, in order."""
    scan, at = _Scan(), 0
    page = page or ""
    while found := _TAG.search(page, at):
        scan.text(page[at : found.start()])
        at = found.end()
        if found["cdata"]:
            scan.text(entities.escape(found["cdata"]))
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        if found["close"] or found["close2"]:
            scan.end(name)
            continue
        scan.start(name, (found["attrs"] or found["attrs2"] or "").strip())
        if name in _RAW:
            if ending := re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at):
                at = ending.start()
            else:
                at = len(page)
            scan.flush()
    scan.text(page[at:])
    scan.flush()
    return scan.blocks


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


@dataclass(frozen=True)
class Page:
    kept: list[tuple[int, str, int]]  # content, and open text if there is no article; where it begins in the runs
    runs: list[str]  # texts between pieces of content, in which repeats are sought
    name: str  # of the two longest blocks

    @classmethod
    def of(cls, page: str | None) -> Page:
        found = blocks(page)
        marked = any(z == CONTENT for z, _ in found)
        kept: list[tuple[int, str, int]] = []
        runs: list[list[str]] = [[]]
        at = 0
        for zone, text in found:
            if zone in (CONTENT, WEAK) or zone == OPEN and not marked:
                kept.append((zone, text, at))
            if zone == CONTENT:
                runs.append([])
            else:
                runs[-1].append(text)
                at += text.count(" ") + 1
        longest = sorted((t for z, t in found if z < SOFT), key=lambda t: (-len(t), t))[:2]
        return cls(kept, [" ".join(r) for r in runs if r], xxhash.xxh3_128_hexdigest("\0".join(longest)))


def repeated(streams: list[list[str]], hosts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A suffix array to ``depth`` tokens of concatenated streams.

    Places of the suffixes that have ``depth`` tokens, in order of their tokens within their
    streams' hosts; which of them begin a new group of equal ones; and each place's stream.
    """
    length = np.array([len(s) for s in streams], dtype=np.int64)
    owner = np.repeat(np.arange(len(streams)), length)
    _, rank = np.unique(np.array([t for s in streams for t in s], dtype=object), return_inverse=True)
    rank = rank.astype(np.int64) + 1
    left = np.repeat(np.cumsum(length), length) - np.arange(len(owner))  # tokens to the stream's end
    done = 1
    while done < depth:
        step = min(done, depth - done)
        next_ = np.zeros_like(rank)
        next_[: len(rank) - step] = rank[step:]
        next_[left <= step] = 0
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + next_, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        done += step
    place = np.flatnonzero(left >= depth)
    place = place[np.lexsort((rank[place], hosts[owner[place]]))]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(rank[place]) != 0) | (np.diff(hosts[owner[place]]) != 0)
    return place, new, owner


def parse(pages: DataFrame, settings: PageSettings) -> DataFrame:
    """page_id, url, host, name, runs and either the text or, if repeats matter, key and kept blocks."""
    schema = "page_id string, url string, host string, name string, runs array<string>, text string, key string, kept array<struct<zone:int,text:string,at:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in row_batches(frames, 500_000, "html"):
            out = []
            for page_id, url, raw in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                page = Page.of(raw)
                host = host_of(url)
                if all(z == CONTENT for z, *_ in page.kept):
                    out.append((page_id, url, host, page.name, page.runs, " ".join(t for _, t, _ in page.kept), None, None))
                else:
                    key = xxhash.xxh3_128_hexdigest("\0".join((host, *page.runs)))
                    out.append((page_id, url, host, page.name, page.runs, None, key, [{"zone": z, "text": t, "at": at} for z, t, at in page.kept]))
            yield pd.DataFrame(out, columns=["page_id", "url", "host", "name", "runs", "text", "key", "kept"])

    return pages.mapInPandas(run, schema)


def boilerplate(parsed: DataFrame, settings: PageSettings) -> DataFrame:
    """(host, window) of the runs of ``depth`` tokens that occur in two pages of a host."""
    depth = settings.depth

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hosts, names, streams = [], [], []
            for host, name, runs in zip(frame["host"], frame["name"], frame["runs"], strict=True):
                for text in runs:
                    tokens = text.split(" ")
                    if len(tokens) >= depth:
                        hosts.append(host)
                        names.append(name)
                        streams.append(tokens)
            out = []
            if streams:
                number = pd.factorize(np.array(hosts, dtype=object))[0]
                place, new, owner = repeated(streams, number, depth)
                begins = np.cumsum([0, *(len(s) for s in streams)])
                cuts = np.flatnonzero(new).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
                    stream = owner[place[a]]
                    at = place[a] - begins[stream]
                    pages_in = [names[owner[p]] for p in place[a:b]]
                    out.append((hosts[stream], " ".join(streams[stream][at : at + depth]), min(pages_in), max(pages_in)))
            yield pd.DataFrame(out, columns=["host", "window", "low", "high"])
        give_back()

    rows = parsed.where(F.size("runs") > 0).select("host", "name", "runs").mapInPandas(slices, "host string, window string, low string, high string")
    merged = rows.groupBy("host", "window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.where("low <> high").select("host", "window")


def covered(asking: DataFrame, found: DataFrame, settings: PageSettings) -> DataFrame:
    """key, spots: run and position of every repeated window of the pages that ask, one row for pages with equal runs."""
    depth = settings.depth
    words = asking.select("key", "host", "runs").dropDuplicates(["key"]).select("key", "host", F.posexplode("runs").alias("run", "text"))
    words = words.select("key", "host", "run", F.split("text", " ").alias("t")).where(F.size("t") >= depth)
    windows = F.transform(F.sequence(F.lit(1), F.size("t") - depth + 1), lambda i: F.array_join(F.slice("t", i, depth), " "))
    spots = words.select("key", "host", "run", F.posexplode(windows).alias("at", "window"))
    return spots.join(found, ["host", "window"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("run", "at")).alias("spots"))


def cleaned(kept: list[dict], runs: list[str], spots: list[dict], depth: int) -> str:
    """Content as it is, and of the other blocks the tokens that no repeated window covers."""
    begins = np.cumsum([0, *(r.count(" ") + 1 for r in runs)])
    gone = np.zeros(begins[-1], dtype=bool)
    for spot in spots:
        at = begins[spot["run"]] + spot["at"]
        gone[at : at + depth] = True
    out = []
    for block in kept:
        if block["zone"] == CONTENT:
            out.append(block["text"])
        else:
            own = block["text"].split(" ")
            out += [t for t, g in zip(own, gone[block["at"] : block["at"] + len(own)], strict=True) if not g]
    return " ".join(out)


def extract(pages: DataFrame, settings: PageSettings = PageSettings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = written(parse(rows, settings), "pages")
    asking = parsed.where("key is not null")
    found = boilerplate(parsed, settings)
    hits = covered(asking, found, settings)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [cleaned(kept, list(runs), [] if spots is None else spots, settings.depth) for kept, runs, spots in zip(frame["kept"], frame["runs"], frame["spots"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts})

    mixed = asking.join(hits, "key", "left").select("page_id", "url", "kept", "runs", "spots").mapInPandas(finish, "page_id string, url string, text string")
    whole = parsed.where("key is null").select("page_id", "url", "text").unionAll(mixed)
    return whole.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
