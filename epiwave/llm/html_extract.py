"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its tags by their path (tag names with class and id) and its blocks of text by path and wording.
Over the pages of a host each token has an occurrence vector: how often it stands in each page. Tokens with the same
vector form an equivalence class; classes of tokens that most pages of the host have are the host's template, nested by
their paths. What is no template is a slot. The main text is what stands in the slots of the main container: the articles
where they hold most of the slot text of the page or its main, else main where the page has one, else the deepest nested container that holds most of the host's slot text; slots below
menus, notices, forms and the like, which tags and whole class names tell, are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwave import session
from epiwave.llm.url_filter import host_of

#: Elements whose content is no text, up to their end or that of the page; elements that are left out where
#: they are closed.
RAW = frozenset("script style noscript template iframe textarea".split())
LEFT_OUT = frozenset("svg select object audio video canvas button".split())
NAME = re.compile("[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of an ordinary tag, and what may matter in any: its end or a quote.
REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
MATTERS = re.compile("[>\"']")
#: Steps of a path; block tags that are open beyond them add none.
DEEPEST = 256
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Tags that part blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that a new one of the group ends.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: A new tag of a block ends an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "body", "html", "head", "title", "caption"}
#: Where text is no main text: by tag, and by whole names of class, id and role. A name of several words, all of them
#: here, counts as well.
ASIDE_TAGS = frozenset("head title nav header footer aside form menu button dialog select option label".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios cookie cookies consent disqus footer header "
    "login menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget "
    "ad-slot ad-container back-to-top comment-list comments-area comments-section cookie-bar left-sidebar right-sidebar main-nav nav-bar nav-links nav-menu page-footer "
    "post-tags related-articles related-posts share-bar share-buttons share-links site-footer site-header site-nav skip-link social-links social-media top-bar "
    "top-nav widget-area".split()
)
#: Elements that the names above say nothing about.
NAMED_FREELY = frozenset(["html", "body", "article", "main"])


@dataclass(frozen=True)
class Deduction:
    """share: of a host's pages that have a template token, two pages at least. mass: share of the host's slot text that the
    main container holds."""

    share: float = 0.8
    mass: float = 0.6


def step_of(tag: str, attributes: str) -> str:
    """A step of a path: the tag with the names of its class, id and role, without digits."""
    names = (n for m in ATTRIBUTE.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()) if attributes else ()
    return ".".join([tag, *sorted({w for n in names if (w := re.sub(r"[^a-z]+", "-", n).strip("-"))})])


def aside_name(name: str) -> bool:
    return name in ASIDE_WORDS or "-" in name and all(w in ASIDE_WORDS for w in name.split("-"))


def asides(path: str, known: dict) -> tuple[bool, tuple[str, ...]]:
    """Whether a path leads through a tag that never holds main text; the containers on it that their names put aside."""
    found = known.get(path)
    if found is None:
        if len(known) > 100_000:
            known.clear()
        steps = [s.split(".") for s in path.split("/")]
        named = [k for k, (tag, *names) in enumerate(steps, 1) if tag not in NAMED_FREELY and any(map(aside_name, names))]
        found = known[path] = any(s[0] in ASIDE_TAGS for s in steps), tuple("/".join(path.split("/")[:k]) for k in named)
    return found


def within(path: str, tag: str) -> bool:
    """Whether an element of the tag is on the path."""
    return any(s.split(".")[0] == tag for s in path.split("/"))


@lru_cache(maxsize=None)
def end_of(name: str) -> re.Pattern:
    """The end tag of a raw or left-out element."""
    return re.compile(rf"</{name}\s*>", re.I)


class Tags:
    """The tags of a page, read forward once: (start, end, kind, name, attributes).

    kind: "open", "close", "gap" for an element that is left out with its content, "other" for comments, declarations and
    tags with a quote that is left open, which end at the next >. A < that no > follows is text. Whatever was looked for in
    vain isn't looked for again, so the time grows with the page's length, whatever is broken in it.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.dead: set[int] = set()
        self.endless: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin here ends, -1 if a quote or the page's end is met first."""
        near = REST.match(self.page, at, at + 2000)
        if near:
            return near.end()
        met = []
        while (m := MATTERS.search(self.page, at)) and m.start() not in self.dead:
            if m[0] == ">":
                return m.end()
            met.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.dead.update(met)  # a quote that leads nowhere leads nowhere from any tag that gets to it
        return -1

    def content_end(self, name: str, at: int) -> int:
        """Where the element's end tag ends, -1 without one."""
        if name in self.endless:
            return -1
        m = end_of(name).search(self.page, at)
        if m is None:
            self.endless.add(name)
            return -1
        return m.end()

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        page, at = self.page, 0
        while 0 <= (i := page.find("<", at)):
            at = i + 1
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = len(page) if end < 0 else end + 3
                yield i, at, "other", "", ""
                continue
            if i > self.last:  # nothing ends any more, but a comment may begin
                if (i := page.find("<!--", i)) >= 0:
                    yield i, len(page), "other", "", ""
                return
            if page[at : at + 1] in ("!", "?"):
                at = page.find(">", i) + 1
                yield i, at, "other", "", ""
                continue
            close = page.startswith("/", at)
            m = NAME.match(page, at + close)
            if m is None:
                continue
            name, end = m[0].lower(), self.tag_end(m.end())
            if end < 0:
                at = page.find(">", i) + 1
                yield i, at, "other", "", ""
                continue
            at, attributes = end, page[m.end() : end - 1]
            if not close and (name in RAW or name in LEFT_OUT and not attributes.endswith("/")):
                inner = self.content_end(name, end)
                if inner >= 0 or name in RAW:
                    at = inner if inner >= 0 else len(page)
                    yield i, at, "gap", name, ""
                    continue
            yield i, at, "close" if close else "open", name, attributes


def blocks(page: str | None) -> Iterator[tuple[str, str]]:
    """(path, text) of each block in page order, and (path, "") where a block tag opens.

    White space inside a block is one space, character references are decoded. Broken markup is read as far as it goes:
    unknown ends are skipped, open tags end with what holds them. Paths have at most ``DEEPEST`` steps.
    """
    page = page or ""
    stack: list[str] = []
    steps: list[str] = []
    standing: Counter = Counter()
    path, held, at = "", [], 0

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return text

    def pop() -> str:
        nonlocal path
        tag = stack.pop()
        standing[tag] -= 1
        if len(stack) < len(steps):
            steps.pop()
            path = path.rpartition("/")[0]
        return tag

    for start, end, kind, tag, attributes in Tags(page):
        held.append(page[at:start])
        at = end
        if kind not in ("open", "close") or tag not in BLOCK:
            if kind == "gap" or tag == "br":
                held.append(" ")
            continue
        if text := flush():
            yield path, text
        if kind == "close":
            if standing[tag]:
                while pop() != tag:
                    pass
            continue
        closes = CLOSES.get(tag, ("p",) if tag in ENDS_P else ())
        while stack and stack[-1] in closes:
            pop()
        if tag not in VOID:
            if len(stack) < DEEPEST:
                steps.append(step_of(tag, attributes))
                path = f"{path}/{steps[-1]}" if stack else steps[-1]
            stack.append(tag)
            standing[tag] += 1
            yield path, ""
    held.append(page[at:])
    if text := flush():
        yield path, text


def outside(found: list[tuple[str, str]], known: dict) -> set[str]:
    """The paths of a page's blocks whose text is no main text.

    A container that its name puts aside is left out, unless it holds the main part of the page's text: more than half
    of it, with less than a tenth in an article or main elsewhere.
    """
    chars = Counter()
    for p, t in found:
        if t:
            chars[p] += len(t)
    total, own, held, inner = 0, 0, Counter(), Counter()
    for p, n in chars.items():
        never, named = asides(p, known)
        if never:
            continue
        main = n if within(p, "article") or within(p, "main") else 0
        total, own = total + n, own + main
        for c in named:
            held[c] += n
            inner[c] += main
    aside = {c: 2 * n <= total or 10 * (own - inner[c]) >= total for c, n in held.items()}
    return {p for p, _ in found if asides(p, known)[0] or any(aside.get(c, True) for c in asides(p, known)[1])}


def occurrences(pages: DataFrame) -> DataFrame:
    """host, path, wording (hash; 0: the tag itself), n (in the page), chars (of slot text), page (hash of its blocks):
    tokens of each page, and a row of the empty path with wording -1 for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows = []
            for host, page in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                count, chars = Counter(), Counter()
                found = list(blocks(page))
                out = outside(found, known)
                key = xxhash.xxh3_64_intdigest("\0".join(x for b in found for x in b).encode()) >> 1
                if (host, key) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((host, key))
                for path, text in found:
                    token = (path, xxhash.xxh3_64_intdigest(text.encode()) >> 1 if text else 0)
                    count[token] += 1
                    if text and path not in out:
                        chars[token] += len(text)
                rows += [(host, p, w, n, chars[p, w], key) for (p, w), n in count.items()]
                rows.append((host, "", -1, 1, 0, key))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "wording", "n", "chars", "page"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, wording long, n long, chars long, page long")


def deduce(pages: DataFrame, how: Deduction = Deduction()) -> DataFrame:
    """host, template (array of path, wording, class), main (path or null) from (host, html).

    Pages of a host with the same blocks count once. A class is named by its occurrence vector's fingerprint; a class of
    one token is valid only for wording. Hosts with two distinct pages or more have a template. Its tokens stand in ``share``
    of the pages, so a host has at most (tokens of a mean page) / share of them.
    """
    once = occurrences(pages).groupBy("host", "path", "wording", "page").agg(F.first("n").alias("n"), F.first("chars").alias("chars"))
    counted = session.cut_lineage(
        once.groupBy("host", "path", "wording").agg(
            F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("page", "n")).alias("vector")
        )
    )
    hosts = counted.filter("wording = -1").select("host", F.col("pages").alias("of"))
    tokens = counted.filter("wording <> -1")
    often = tokens.filter(F.col("pages") >= 2).join(hosts, "host").filter(F.col("pages") >= F.col("of") * how.share)
    often = session.cut_lineage(often.select("host", "path", "wording", "pages", "vector"))
    classes = often.groupBy("host", "pages", "vector").agg(F.count("*").alias("size"))
    valid = often.join(classes, ["host", "pages", "vector"]).filter("size > 1 OR wording <> 0")
    template = valid.groupBy("host").agg(F.collect_list(F.struct("path", "wording", F.col("vector").alias("class"))).alias("template"))
    # Slot text by container: each path gives its text to all paths above it, so a container's mass is one sum.
    slots = tokens.filter("chars > 0").join(often.select("host", "path", "wording"), ["host", "path", "wording"], "left_anti")
    by_path = slots.groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    steps = F.split("path", "/")
    above = by_path.select("host", "chars", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path"))
    mass = above.groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    whole = by_path.groupBy("host").agg(F.sum("chars").alias("all"))
    containers = valid.filter("wording = 0").select("host", "path").distinct()
    held = mass.join(whole, "host").join(containers, ["host", "path"], "left_semi").filter(F.col("chars") >= F.col("all") * how.mass)
    held = held.filter(~F.col("path").rlike(r"(^|/)(p|h[1-6]|li|td|th|tr|dd|dt)[^/]*$"))
    main = held.groupBy("host").agg(F.max(F.struct(F.size(F.split("path", "/")).alias("deep"), F.col("chars"), F.col("path"))).alias("m")).select("host", F.col("m.path").alias("main"))
    return hosts.join(template, "host", "left").join(main, "host", "left").select("host", "template", "main")


def main_blocks(page: str | None, template: frozenset, main: str | None, known: dict) -> list[str]:
    """Texts of the slots of a page's main container, in page order."""
    found = [(p, t) for p, t in blocks(page) if t]
    out = outside(found, known)
    found = [(p, t) for p, t in found if p not in out]
    # What stands in an article or main is the page's own text, even where other pages of the host say the same.
    slots = [(p, t) for p, t in found if within(p, "article") or within(p, "main") or (p, xxhash.xxh3_64_intdigest(t.encode()) >> 1) not in template]
    # Pages that are near copies of each other share their text: what would take most of a page is no template of it.
    if 2 * sum(len(t) for _, t in slots) >= sum(len(t) for _, t in found):
        found = slots
    places = [(within(p, "article"), within(p, "main"), len(t)) for p, t in found]
    articles, mains = (sum(n for *at, n in places if at[k]) for k in range(2))
    both = sum(n for a, m, n in places if a and m)
    if 2 * articles > sum(n for *_, n in places) or 2 * both > mains:
        return [t for (_, t), (a, _, _) in zip(found, places, strict=True) if a]
    if mains:
        return [t for (_, t), (_, m, _) in zip(found, places, strict=True) if m]
    if main:
        inner = [t for p, t in found if p == main or p.startswith(main + "/")]
        if inner:
            return inner
    return [t for _, t in found]


def extract(pages: DataFrame, how: Deduction = Deduction(), id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """id, url, text, blocks (array of the texts that ``text`` joins), n_chars for each page.

    A null page is empty and has the text "". Pages without a host (null or no ://) share the host "". The pages of a
    host with one distinct page have no template, and no wording is taken out of an article or main, nor most of the text
    of a page. A page is read in time that grows with its length, however broken its markup is. Repeated rows give a row each, but count once for the template; other columns aren't read.
    """
    mine = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html"))
    mine = mine.withColumn("__raw", F.col("__url")).withColumn("__url", F.coalesce("__url", F.lit("")))
    mine = mine.withColumn("host", host_of(F.col("__url")))
    found = deduce(mine, how)
    found = session.cut_lineage(found)
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        last, template = None, frozenset()
        for batch in batches:
            texts = []
            for page, host, tokens, main in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if host != last:
                    last, template = host, frozenset((t["path"], t["wording"]) for t in tokens or ())
                texts.append(main_blocks(page, template, main, known))
            joined = ["\n\n".join(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(map(len, joined), pa.int64())],
                names=[id_col, url_col, "text", "blocks", "n_chars"],
            )

    loaded = mine.join(found, "host", "left").select(F.col("__id").alias(id_col), F.col("__raw").alias(url_col), "html", "host", "template", "main")
    return loaded.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, blocks array<string>, n_chars long")
