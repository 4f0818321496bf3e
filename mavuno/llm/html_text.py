"""Main text of web pages: runs of tokens repeated across pages go, what they leave is read by the page's structure."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, joined
from .near_join import _groups

PAGES, BYTES = 256, 8 << 20  # pages and bytes of html of a host whose streams are held together; larger hosts are dealt over groups, whose counts are added
RUN = 6  # tokens of a long substring, markup included
DISTINCT = 3  # distinct pages that must share it
COVERED = 0.6  # share of a block's words that repeated runs cover, from which the block is boilerplate
MAIN = 2  # place of what an article or main element holds; 1 is a division named like one, 0 elsewhere, -1 in a side part, -2 no text

# Elements of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title button select textarea iframe svg canvas object".split())
_PART = frozenset("nav header footer aside form dialog menu".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDED_BY = {"li": ("li", "ul", "ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr", "table"), "th": ("td th", "tr", "table")}
_NOT_IN_P = _BLOCK - frozenset("body caption html tbody td tfoot th thead tr".split())
_SIDE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|header|footer|sidebar|aside|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|form|search|share|sharing|social|related|recommended|comments?|respond|reply|replies|disqus|widget|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story)(?:$|[\s_-])", re.I)
_NAMED_FREELY = frozenset("html body main h1 h2 h3 h4 h5 h6".split())  # a heading called post-header is a heading
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"))


class _Frame:
    """An open block element: its inline elements that are open, and how many of each name."""

    __slots__ = ("count", "inline", "place", "tag")

    def __init__(self, tag: str, place: int) -> None:
        self.tag, self.place, self.inline, self.count = tag, place, [], {}


class _Reader(HTMLParser):
    """Blocks (place, text, places of its words in the stream) and the stream (token, place) of markup and words.

    End tags that HTML lets out are implied; an end tag closes what it names within the same block only; each element is
    opened and closed once, so the work is linear in the page.
    """

    def __init__(self, host: str) -> None:
        super().__init__(convert_charrefs=True)
        self.host = host
        self.frames, self.opened = [_Frame("", 0)], Counter()
        self.pieces: list[tuple[int, str]] = []
        self.words: list[int] = []
        self.blocks: list[tuple[int, str, list[int]]] = []
        self.stream: list[tuple[str, int]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # <![...]> is a comment in HTML, whatever it holds

    def place(self) -> int:
        frame = self.frames[-1]
        return frame.inline[-1][1] if frame.inline else frame.place

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def end_block(self) -> None:
        if not self.pieces:
            return
        said = [(p, t) for p, t in self.pieces if not t.isspace()]
        if said:
            place = max(p for p, _ in said)
            if text := " ".join("".join(t for p, t in self.pieces if place < 0 or p >= 0).split()):
                self.blocks.append((place, text, self.words))
        self.pieces, self.words = [], []

    def _close(self, at: int) -> None:
        for frame in self.frames[at:]:
            self.opened[frame.tag] -= 1
        del self.frames[at:]

    def _imply(self, tag: str) -> None:
        if tag in _NOT_IN_P and self.frames[-1].tag == "p":
            self._close(len(self.frames) - 1)
        if tag in _ENDED_BY:
            same, *stop = _ENDED_BY[tag]
            if any(self.opened[t] for t in same.split()):
                for i in range(len(self.frames) - 1, 0, -1):
                    if self.frames[i].tag in same.split():
                        self._close(i)
                        break
                    if self.frames[i].tag in stop:
                        break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCK or tag in _PART or tag in _SILENT
        if block:
            self.end_block()
            self._imply(tag)
        elif tag == "br":
            self.pieces.append((self.place(), " "))
        place = self.place()
        known = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")} if attrs else {}
        if place < MAIN and place != -2:
            self.stream.append((f"<{tag}.{'.'.join(known.get('class', '').split())}>", place))
        if tag in _VOID:
            return
        if place >= 0:
            label = f"{known.get('class', '')} {known.get('id', '')}" if known else ""
            if tag in _SILENT or "hidden" in known or known.get("aria-hidden") == "true":
                place = -2
            elif tag in _PART or known.get("role") in _ROLES or label and tag not in _NAMED_FREELY and _SIDE.search(label):
                place = -1
            elif tag in _MAIN or known.get("role") == "main":
                place = MAIN
            elif label and tag in ("div", "section") and _BODY.search(label):
                place = max(place, 1)
        elif tag in _SILENT:
            place = -2
        if block:
            self.frames.append(_Frame(tag, place))
            self.opened[tag] += 1
        else:
            frame = self.frames[-1]
            frame.inline.append((tag, place))
            frame.count[tag] = frame.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, <div/> opens an element
        if tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        frame = self.frames[-1]
        if tag in _BLOCK or tag in _PART or tag in _SILENT:
            self.end_block()
            if self.opened[tag]:
                at = len(self.frames) - 1
                while self.frames[at].tag != tag:
                    at -= 1
                self._close(at)
        elif frame.count.get(tag):
            while True:
                name, _ = frame.inline.pop()
                frame.count[name] -= 1
                if name == tag:
                    break
        place = self.place()
        if place < MAIN and place != -2:
            self.stream.append((f"</{tag}>", place))

    def handle_data(self, data: str) -> None:
        place = self.place()
        if place == -2:
            return
        self.pieces.append((place, data))
        if place < MAIN:
            for word in data.split():
                self.words.append(len(self.stream))
                self.stream.append(("@host" if self.host and word.lower() == self.host else word, place))


@dataclass(frozen=True)
class Page:
    """blocks: (in the main element, may be text, text, places of its words in the stream). The stream has the tokens, words and
    markup, of what stands outside the main element, whose own content no run may remove."""

    blocks: list[tuple[bool, bool, str, np.ndarray]]
    stream: list[str]
    named: bool


def read(html: str | None, host: str = "") -> Page:
    """A page with character references decoded and white space inside a block as single spaces. What the parser cannot read
    ends the page there; nothing fails. The page's own host name is one token on all hosts."""
    reader = _Reader(host)
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    reader.end_block()
    level = max((p for p, *_ in reader.blocks), default=0)
    level = level if level > 0 else MAIN + 1
    outside = np.array([p < level for _, p in reader.stream], bool)
    at = np.cumsum(outside) - 1
    blocks = [(place >= level, place >= 0, text, at[np.array(words, int)] if place < level else np.zeros(0, int)) for place, text, words in reader.blocks]
    return Page(blocks, [t for (t, _), o in zip(reader.stream, outside, strict=True) if o], level <= MAIN)


def _ranks(pages: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank, number of pages, owner) of each place of the concatenated streams, and the streams' sizes, end marks included.

    The streams are concatenated with an end mark of its own after each. A suffix array by prefix doubling orders all
    suffixes by their first `run` tokens; neighbours of equal rank share a run.
    """
    sizes = np.array([len(p) + 1 for p in pages])
    owner = np.repeat(np.arange(len(pages)), sizes)
    words: dict[str, int] = {}
    rank = np.empty(len(owner), np.int64)
    at = 0
    for k, p in enumerate(pages):
        rank[at : at + len(p)] = [words.setdefault(t, len(words)) for t in p]
        rank[at + len(p)] = -1 - k
        at += len(p) + 1
    rank -= rank.min()
    length = 1
    while length < run:
        step = min(length, run - length)  # ranks by `length` tokens from i and from i + step give ranks by length + step
        other = np.full(len(rank), -1, np.int64)
        other[:-step] = rank[step:]
        order = np.lexsort((other, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(other[order]) != 0)
        fresh = np.empty(len(rank), np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(new)])
        rank, length = fresh, length + step
    order = np.lexsort((owner, rank))  # the suffix array, suffixes of equal rank by page
    first = np.concatenate([[True], (np.diff(rank[order]) != 0) | (np.diff(owner[order]) != 0)])
    return rank, np.bincount(rank[order][first], minlength=rank.max() + 1)[rank], owner, sizes


def _inside(starts: np.ndarray, run: int) -> np.ndarray:
    """Which places lie in a run that starts at one of the true places."""
    covered = np.zeros(len(starts) + run, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + run, -1)
    return np.cumsum(covered)[: len(starts)] > 0


def repeated(pages: list[list[str]], run: int = RUN, distinct: int = DISTINCT) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of `run` or more tokens that `distinct` pages share."""
    _, shared_by, _, sizes = _ranks(pages, run)
    return [x[:-1] for x in np.split(_inside(shared_by >= distinct, run), np.cumsum(sizes)[:-1])]


@lru_cache(1 << 16)
def _token(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _markup(token: str) -> bool:
    return token[:1] == "<" and token[-1:] == ">"


def run_hashes(stream: list[str], run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the run that starts at each place of a stream, the same on every page, group and machine. It is odd for
    runs that hold markup and even for runs of words alone."""
    n = max(0, len(stream) - run + 1)
    tokens = np.array([_token(t) for t in stream], np.uint64)
    marks = np.concatenate([[0], np.cumsum([_markup(t) for t in stream])]) if stream else np.zeros(1, int)
    weights = np.random.default_rng(5).integers(1 << 63, size=run, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(run):
        out += weights[j] * tokens[j : j + n]
    out = (out & ~np.uint64(1)) | (marks[run : run + n] > marks[:n]).astype(np.uint64)
    return out.view(np.int64)


def run_counts(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of pages) of each distinct run of a group of pages, by the suffix array."""
    rank, pages, owner, sizes = _ranks(streams, run)
    ends = np.cumsum(sizes)
    whole = np.flatnonzero(np.arange(len(rank)) + run < ends[owner])
    hashes = np.concatenate([run_hashes(s, run) for s in streams])
    _, first = np.unique(rank[whole], return_index=True)
    return hashes[first], pages[whole][first]


def scoped(hashes: np.ndarray, host: str) -> np.ndarray:
    """What runs are added up by: runs that hold markup over all hosts, runs of words alone over their host."""
    return np.where(hashes & 1, hashes, hashes ^ (np.uint64(_token(host)) & ~np.uint64(1)).astype(np.int64))


def decide(page: Page, shared: np.ndarray, host: str = "", structure: bool = True) -> tuple[list[str], dict[str, int]]:
    """The texts that stay, and how many blocks each reason decided.

    `shared` are the sorted keys (`scoped`) of the repeated runs. 1. Blocks whose words they cover go; what a main element holds is
    guarded, as copied articles are content. 2. Of the blocks that are left, side parts go, and so does what stands
    beside a main element; with `structure` False they stay, so that the runs alone decide. A page without a main element whose
    every block is repeated is a copy, and keeps them.
    """
    hashes = scoped(run_hashes(page.stream), host)
    starts = np.zeros(len(page.stream), bool)
    if len(shared):
        starts[: len(hashes)] = shared[np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)] == hashes
    inside = _inside(starts, RUN)
    covered = [not main and len(at) > 0 and inside[at].mean() >= COVERED for main, _, _, at in page.blocks]
    plain = [ok for _, ok, _, _ in page.blocks]
    if not page.named and all(c for c, ok in zip(covered, plain, strict=True) if ok):
        covered = [c and not ok for c, ok in zip(covered, plain, strict=True)]
    kept, why = [], Counter()
    for (main, ok, text, _), gone in zip(page.blocks, covered, strict=True):
        stays = main or (not gone and (not structure or ok and not page.named))
        why["kept" if stays else "runs" if gone else "structure"] += 1
        if stays:
            kept.append(text)
    return kept, why


def main_texts(htmls: list[str | None], host: str = "") -> list[str]:
    """Main texts of pages of one host that are all there are; `extract` does the same for tables."""
    pages = [read(h, host) for h in htmls]
    seen = Counter(h for p in pages for h in set(scoped(run_hashes(p.stream), host).tolist()))
    shared = np.array(sorted(h for h, n in seen.items() if n >= DISTINCT), np.int64)
    return [" ".join(decide(p, shared, host)[0]) for p in pages]


def dealt_pages(df: DataFrame, html: str, url: str, key: str) -> DataFrame:
    """key, url, html, _host and _group: a group has about PAGES pages and BYTES bytes of one host, chosen by a hash."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    size = F.coalesce(F.octet_length(F.col(html)), F.lit(0))
    groups = F.greatest(F.ceil(F.count(F.lit(1)) / PAGES), F.ceil(F.sum("_size") / BYTES)).cast("int")
    large = df.select(host.alias("_host"), size.alias("_size")).groupBy("_host").agg(groups.alias("_groups"), F.count(F.lit(1)).alias("_n")).filter("_groups > 1")
    lean = df.select(F.col(key), F.col(url), F.col(html).alias("html"), host.alias("_host"))
    dealt = joined(lean, large, ["_host"], "_n", how="left")
    return dealt.withColumn("_group", F.xxhash64("_host", F.pmod(F.xxhash64(url, key), F.coalesce("_groups", F.lit(1))))).drop("_groups", "_n")


def shared_runs(streams: DataFrame) -> DataFrame:
    """(_group, _runs): of each group of pages (_host, _group, stream) the keys of those of its runs that DISTINCT pages share.

    A suffix array for each group finds its runs and on how many of its pages each stands; Spark adds the groups up, runs
    of words alone over their host, runs that hold markup over all hosts, as the same networks and page makers put the
    same parts around texts everywhere. Runs that very many groups have are joined back by broadcast.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(batches, ["_group"]):
            for group, pages in frame.groupby("_group", sort=False):
                runs, n = run_counts([s.split(" ") for s in pages["stream"]])
                yield pd.DataFrame({"_group": group, "run": scoped(runs, pages["_host"].iloc[0]), "pages": n.astype(np.int32)})

    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = streams.repartition(parts, "_group").sortWithinPartitions("_group").mapInPandas(count, "_group long, run long, pages int")
    totals = runs.groupBy("run").agg(F.sum("pages").alias("_all"), F.count(F.lit(1)).alias("_n")).filter(F.col("_all") >= DISTINCT)
    back = joined(runs.select("_group", "run"), totals.select("run", "_n"), ["run"], "_n", spread=F.col("_group"))
    return back.groupBy("_group").agg(F.collect_list("run").alias("_runs"))


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, url, text) for every page: the main text of its whole html, empty if it has none or html is null.

    Each page's stream of words and markup takes part in its host's suffix arrays (`shared_runs`); `decide` says what stays.
    Pages are dealt by host; a host of more than PAGES pages or BYTES bytes is dealt over groups, so that no task holds
    a whole large host, and the result does not depend on the groups. Pages without a url count as a host; equal rows
    count as pages of their own. Malformed and very deep html is read in linear time. Other columns are left out.
    """
    arrow_batches(df.sparkSession)
    dealt = dealt_pages(df, html, url, key)

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[["_host", "_group"]].assign(stream=[" ".join(read(h, host).stream) for h, host in zip(batch["html"], batch["_host"], strict=True)])
            yield rows[rows["stream"] != ""]

    def work(pages: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        runs = np.sort(np.asarray(known["_runs"].iloc[0], np.int64)) if len(known) else np.zeros(0, np.int64)
        texts = [" ".join(decide(read(h, host), runs, host)[0]) for h, host in zip(pages["html"], pages["_host"], strict=True)]
        return pd.DataFrame({key: pages[key], url: pages[url], "text": texts})

    streams = cut(dealt.mapInPandas(outside, "_host string, _group long, stream string"))
    return dealt.groupBy("_group").cogroup(shared_runs(streams).groupBy("_group")).applyInPandas(work, df.select(key, url, F.lit("").alias("text")).schema)
