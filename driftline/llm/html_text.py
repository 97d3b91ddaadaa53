"""Main text of pages: markup roles and a host-wide search for repeated token runs.

A tolerant, linear parser cuts a page into visible blocks and gives each a role: `main` inside article or main elements, `noise` inside
menus, headers, footers, asides, notices, adverts, forms, comments and the like, and `open` elsewhere. A page's text is its main
blocks, or its open ones if it holds none. What markup can't tell is left to the method: open blocks, generic containers (div,
section) in main and elements in main whose name only hints at noise (`related-work`) are free; paragraphs, headings, list items,
quotes, cells and the like in main are guarded and stay.

Method: the token streams of a host's pages hold all visible blocks, noise as well. The suffixes that share their first `RUN` tokens
are one interval of the host's suffix array, and an interval that reaches over distinct pages is a repeated substring. Spark groups
the suffixes by host and those tokens (64-bit digest of each) instead of sorting one array in one task. Of the free blocks, the tokens
that repeated substrings cover go and unique runs stay; where all of a page's text repeats, it is a copy of another page and stays.

Only suffixes whose first tokens touch a free block can take text away, so these are written first. A bitmap of their digests (fixed
size, `BITS`) lets the other suffixes of the corpus pass only if they can meet one; false hits fall away in the grouping, so it is exact.

Defined cases: null or empty html, or a page without text, gives an empty text; a null url is a host of its own (empty); rows of one
page_id are one page to the search, each with its own blocks, and each gets its row; a null page_id takes no part in the search. Tags
and quotes that never close end at the next `>`, or are text if there is none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach, cut
from .near_duplicates import ROLL, WordHashes, mixed
from .urls import host_path

RUN = 8
#: Bits of the map of digests that free blocks have: 16 MB.
BITS = 1 << 27
MAP_ROW = 1 << 15  # bits of one row of Spark's bitmap functions

# Elements by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
NOISE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
HIDDEN_TAGS = frozenset("script style noscript template svg iframe object head title button select option textarea input canvas audio video math".split())
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu header footer sidebar aside rail "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs "
    "comment comments disqus respond reply replies related recommended teaser widget pagination pager masthead toolbar skip".split()
)
#: Words that add no sense of their own to a noise name, as in comment-list.
PLAIN_NAMES = frozenset("area bar block box btn button buttons container form item items link links list panel post posts slot thread unit wrap wrapper".split())
AD_NAMES = frozenset("ad ads advert advertisement sponsored".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that stay where their role is `main`.
GUARDED = HEADINGS | frozenset("p li blockquote pre dd dt tr caption figcaption summary address".split())

SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[^a-z0-9]+")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
BARE_VALUE = re.compile(r"[^\s>]*")
COMMENT_END = re.compile(r"--!?>")

MAIN, NOISE, LEAD, DOUBT, HIDDEN = 1, 2, 4, 8, 16
Element = tuple[str, int, int]


def tag_end(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """Attributes of the tag whose name ends at `at`, whether it closes itself, and where it ends; linear in what it reads."""
    attrs: dict[str, str] = {}
    n = len(html)
    while at < n:
        if html[at] == ">":
            return attrs, html[at - 1] == "/", at + 1
        m = ATTRIBUTE.match(html, at)
        name, at = m[1], max(m.end(), at)
        if m[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"') and last[quote] > at:
                stop = html.index(quote, at + 1)
                value, at = html[at + 1 : stop], stop + 1
            else:
                v = BARE_VALUE.match(html, at)
                value, at = v[0], v.end()
        else:
            value = ""
        if name:
            attrs.setdefault(name.lower(), value)
        elif m.end() == m.start() and at < n and html[at] != ">":
            at += 1
    return attrs, False, n


class Page:
    """Collects (role, text, guarded) of the visible blocks of a page; each character and element is touched a bounded number of times."""

    def __init__(self):
        self.stack: list[Element] = [("", 0, 0)]  # tag, flags of it and its parents, index of the nearest block element
        self.where: dict[str, list[int]] = defaultdict(list)
        self.text: list[str] = []
        self.found: list[tuple[int, str, bool]] = []

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if text:
                block, flags, _ = self.stack[self.stack[-1][2]]  # inline elements only hide
                noise = flags & NOISE or flags & LEAD and block not in HEADINGS
                role = NOISE if noise else flags & MAIN
                self.found.append((role, text, bool(role == MAIN and not flags & DOUBT and block in GUARDED)))

    def pop_to(self, k: int) -> None:
        if k <= self.stack[-1][2]:
            self.flush()  # a visible block ends
        for tag, _, _ in reversed(self.stack[k:]):
            self.where[tag].pop()
        del self.stack[k:]

    def own_flags(self, tag: str, attrs: dict[str, str], flags: int) -> int:
        """What an element adds to the flags of its parent."""
        if tag in HIDDEN_TAGS:
            return HIDDEN
        if tag in ("html", "body"):
            return 0
        out = MAIN if tag in ("article", "main") else 0
        if attrs:
            style = unescape(attrs.get("style", "")).replace(" ", "").lower()
            role = attrs.get("role", "").lower()
            if role in NOISE_ROLES or "hidden" in attrs or "display:none" in style or attrs.get("aria-hidden", "").lower() == "true":
                return NOISE
            for name in unescape(f"{attrs.get('class', '')} {attrs.get('id', '')}").lower().split():
                parts = {p for p in NAME_PARTS.split(name) if p}
                if NOISE_NAMES.isdisjoint(parts):
                    continue
                if not flags & MAIN:
                    return NOISE
                if tag == "p" or tag in HEADINGS:
                    if parts <= AD_NAMES:
                        return NOISE
                elif parts <= NOISE_NAMES | PLAIN_NAMES:
                    return NOISE
                else:
                    out |= DOUBT
        if tag == "header" and flags & MAIN:
            return out | LEAD  # an article's own header: its heading stays
        return NOISE if tag in NOISE_TAGS else out

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        while tag in BLOCK_TAGS and self.stack[-1][0] in ("option", "select", "head"):
            self.pop_to(len(self.stack) - 1)  # a block can't stand in these: they were left open
        flags = self.stack[-1][1]
        block = tag in BLOCK_TAGS
        if flags & HIDDEN:
            if tag not in VOID_TAGS and not closed:
                self.push(tag, flags, False)
            return
        if tag in VOID_TAGS:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img"):
                self.text.append(" ")
            return
        if block:
            self.flush()
            near = self.stack[-1][2]
            over = self.stack[near][0]
            if over == "p" or over == tag and tag in ("li", "tr") or over in ("dd", "dt") and tag in ("dd", "dt"):
                self.pop_to(near)
                flags = self.stack[-1][1]
        elif tag in ("td", "th"):
            self.text.append(" ")
        own = self.own_flags(tag, attrs, flags)
        if closed and own & HIDDEN:
            return
        if not block:
            own = HIDDEN if own & (HIDDEN | NOISE) else 0
        if block or own:
            self.push(tag, flags | own, block)

    def push(self, tag: str, flags: int, block: bool) -> None:
        k = len(self.stack)
        self.where[tag].append(k)
        self.stack.append((tag, flags, k if block else self.stack[-1][2]))

    def end(self, tag: str) -> None:
        block, places = tag in BLOCK_TAGS, self.where[tag]
        if tag in ("td", "th"):
            self.text.append(" ")
        if places and (block or tag in HIDDEN_TAGS or places[-1] > self.stack[-1][2]):
            self.pop_to(places[-1])
        elif block and not self.stack[-1][1] & HIDDEN:
            self.flush()

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        endless: set[str] = set()
        last = {"'": html.rfind("'"), '"': html.rfind('"'), ">": html.rfind(">")}
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt > last[">"]:
                lt = n
            if lt > at and not self.stack[-1][1] & HIDDEN:
                self.text.append(unescape(html[at:lt]))
            at = lt
            if at >= n:
                break
            m = TAG.match(html, at)
            if m:
                tag = m[1].lower()
                attrs, closed, at = tag_end(html, m.end(), last)
                if html[m.start() + 1] == "/":
                    self.end(tag)
                    continue
                if tag in RAW_TAGS and not closed:
                    stop = None if tag in endless else re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    if stop:
                        at = stop.start()
                    elif tag in ("title", "textarea"):
                        endless.add(tag)  # never closed: what follows is the page
                        continue
                    else:
                        at = n
                self.start(tag, attrs, closed)
            elif html.startswith("<!--", at):
                stop = COMMENT_END.search(html, at + 2)
                at = stop.end() if stop else n
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                at = html.index(">", at) + 1
            else:
                if not self.stack[-1][1] & HIDDEN:
                    self.text.append("<")
                at += 1
        self.flush()


def blocks_of(html: str | None) -> list[tuple[bool, str, bool]]:
    """The visible blocks of a page: is it part of the text by its role, text, is it free (the search may take from it)."""
    page = Page()
    page.feed(html or "")
    wanted = MAIN if any(role == MAIN for role, _, _ in page.found) else 0
    return [(role == wanted, text, role == wanted and not guarded) for role, text, guarded in page.found]


def text_of(html: str | None, repeated: np.ndarray | None) -> str:
    """The text of a page without the tokens of free blocks that lie in a run of `RUN` tokens from a place in `repeated`."""
    blocks = blocks_of(html)
    whole = "\n".join(text for kept, text, _ in blocks if kept)
    if repeated is None or not len(repeated):
        return whole
    sizes = [text.count(" ") + 1 for _, text, _ in blocks]
    steps = np.zeros(sum(sizes) + RUN + 1, np.int64)
    np.add.at(steps, repeated, 1)
    np.add.at(steps, repeated + RUN, -1)
    covered = np.cumsum(steps) > 0
    out, at = [], 0
    for (kept, text, free), size in zip(blocks, sizes):
        if kept and free and covered[at : at + size].any():
            text = " ".join(w for w, c in zip(text.split(" "), covered[at : at + size]) if not c)
        if kept and text:
            out.append(text)
        at += size
    return "\n".join(out) or whole


def leads(html: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of the first `RUN` tokens of each suffix of a page's stream, and whether they touch a free block."""
    blocks = blocks_of(html)
    sizes = [text.count(" ") + 1 for _, text, _ in blocks]
    n = sum(sizes)
    if n < RUN:
        return np.empty(0, np.int64), np.empty(0, bool)
    h = np.fromiter((hashes[w.encode("utf-8", "replace")] for _, text, _ in blocks for w in text.split(" ")), np.uint64, n)
    x = np.full(n - RUN + 1, RUN, np.uint64)
    for k in range(RUN):
        x += h[k : n - RUN + 1 + k] * ROLL[k]
    free = np.concatenate(([0], np.cumsum(np.repeat([f for _, _, f in blocks], sizes))))
    return mixed(x).view(np.int64), free[RUN:] > free[:-RUN]


def named(pages: DataFrame) -> DataFrame:
    host, _ = host_path(F.col("url"))
    return pages.where("page_id IS NOT NULL AND html <> ''").select(
        "page_id", F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"), F.xxhash64("html").alias("key"), "html"
    )


def free_suffixes(pages: DataFrame) -> DataFrame:
    """host, lead, page_id, key, at: suffixes whose first tokens touch a free block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            for host, page, key, html in zip(b["host"], b["page_id"], b["key"], b["html"]):
                if any(free for _, _, free in blocks_of(html)):
                    lead, free = leads(html, hashes)
                    at = np.flatnonzero(free)
                    yield pd.DataFrame({"host": host, "lead": lead[at], "page_id": page, "key": key, "at": at.astype(np.int32)})

    return named(pages).mapInPandas(run, "host long, lead long, page_id long, key long, at int")


def digest_map(free: DataFrame) -> np.ndarray | None:
    """A bitmap of the digests of free suffixes; None if there are none. At most `BITS` bits come to the driver, however many rows there are."""
    bit = F.pmod("lead", F.lit(BITS)) + 1
    rows = free.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    if not rows:
        return None
    out = np.zeros((BITS // MAP_ROW, MAP_ROW // 8), np.uint8)
    for r in rows:
        out[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def other_suffixes(pages: DataFrame, bits: np.ndarray) -> DataFrame:
    """host, lead, page_id: suffixes that touch no free block and may equal one that does."""
    shared = pages.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bits = WordHashes(), shared.value
        for b in batches:
            for host, page, html in zip(b["host"], b["page_id"], b["html"]):
                lead, free = leads(html, hashes)
                lead = np.unique(lead[~free])
                place = lead % BITS
                lead = lead[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
                if len(lead):
                    yield pd.DataFrame({"host": host, "lead": lead, "page_id": page})

    return named(pages).mapInPandas(run, "host long, lead long, page_id long")


def repeated_places(pages: DataFrame) -> DataFrame | None:
    """page_id, key, ats: the places of a page's stream where a substring of the host that other pages have starts; None if no block is free."""
    free = cut(free_suffixes(pages))
    bits = digest_map(free)
    if bits is None:
        return None
    seen = free.select("host", "lead", "page_id").union(other_suffixes(pages, bits))
    repeated = seen.groupBy("host", "lead").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).where("lo < hi").select("host", "lead")
    return attach(free, repeated, ["host", "lead"], "inner").groupBy("page_id", "key").agg(F.collect_set("at").alias("ats"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    places = repeated_places(pages)
    if places is None:
        rest = pages.withColumn("ats", F.lit(None).cast("array<int>"))
    else:
        keyed = pages.withColumn("key", F.xxhash64("html"))
        rest = keyed.join(places, ["page_id", "key"], "left").select("page_id", "url", "html", "ats")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [text_of(h, a) for h, a in zip(b["html"], b["ats"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rest.mapInPandas(run, "page_id long, url string, text string, n_chars long")
