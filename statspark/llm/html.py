"""Main text of web pages by wrapper induction.

Every page becomes a block tree (inline markup is transparent, runs of like siblings become one repeated slot). The
trees of a host's pages are aligned by simple tree matching into one template per host. Over all pages of the host each
template node is then counted: a text that stands at the same node on most of the host's different pages is
template; nodes whose text varies are content. Elements and roles for navigation, headers, footers, asides, forms and
dialogs are never content. Class names and ids of such parts count unless the node holds the page's article or nearly
all of its varying text. Varying text outside the article or main element is content if its part of the page has a
sentence's length; shorter ones are dates, counters and the like.

A host may hold any share of all pages: trees are first made distinct in every task, merged in salted groups and only then
per host, and the counts are combined before they shuffle.
"""

from __future__ import annotations

import html as _html
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, store

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Nesting beyond this many blocks is flat: deeper blocks stand beside each other. No text is lost.
DEPTH = 120
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed by HTML: elements without an end tag, elements whose content is raw text, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote fieldset figure details".split())
#: Never content, whatever the host's pages say.
BOILER = frozenset("nav header footer aside form menu dialog fieldset button label".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent discussion disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets copyright "
    "legal disclaimer recommended recommendations teaser".split()
)
#: Pieces that leave a compound name's meaning as it is: site-footer is a footer, has-sidebar and post-header are no boilerplate.
_NEUTRAL = frozenset(
    "area bar block bottom box container global group inner item items left link links list main outer panel primary right secondary "
    "section site the top wrap wrapper".split()
)
#: Parts of an article that are not its text: post-comments, unlike post-header, is boilerplate.
_OF_ARTICLE = frozenset("article blog entry news page post posts story user users".split())
_ATTACHED = _BOILER_WORDS - frozenset("header banner masthead notice notices legal disclaimer copyright teaser promo promoted".split())
#: What an article element itself can be named when it is a reader's comment or an advert.
_NO_ARTICLE = frozenset("ad advert comment comments related reply sponsored promo teaser".split())
#: A name can't mark what holds this share of the page's varying text; words from which a part outside the article is content.
BULK, LEAST_WORDS = 0.9, 8
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_MAIN_ROLES = frozenset({"main", "article"})
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """A block element; ``parts`` holds its text and child blocks in page order."""

    tag: str
    label: str
    boiler: bool = False
    main: bool = False
    named: bool = False
    parts: list = field(default_factory=list)


def _names_boiler(name: str) -> bool:
    """Whether a class name or id as a whole names boilerplate."""
    words = {w.lower() for w in _SPLIT.split(name)} - {""}
    rest = words - _BOILER_WORDS - _NEUTRAL
    return bool(words & _BOILER_WORDS) and (not rest or (rest <= _OF_ARTICLE and not words & (_BOILER_WORDS - _ATTACHED)))


@lru_cache(maxsize=50_000)
def _traits(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label, boilerplate mark, main mark and mark by name of a start tag."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = found.get("class", "").split()
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in _MAIN_ROLES
    hidden = "hidden" in _ATTRIBUTE.sub("", attributes).lower().split() or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    boiler = tag in BOILER or role in _BOILER_ROLES or hidden
    marks = [x for x in [*names, *found.get("id", "").split()] if _names_boiler(x)]
    if tag in ("article", "main"):
        marks = [x for x in marks if x.lower() in _NO_ARTICLE]
    return ".".join([tag, *sorted(names)]), boiler, main, bool(marks)


class _Scanner:
    """Tags of a page from left to right, in time linear in its length, however broken they are.

    A tag ends at the first ``>`` outside quoted values. A quote without an end is a character like others; where a tag's
    end would lie beyond the page because of quotes, quotes count no more from there on. ``<`` without any ``>`` after it is text.
    """

    def __init__(self, text: str) -> None:
        self.text, self.last, self.tag = text, text.rfind(">"), _TAG

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, name or None, attributes) of the next markup from ``at``."""
        text = self.text
        while True:
            start = text.find("<", at)
            if start < 0 or start > self.last:
                return None
            m = self.tag.match(text, start)
            if m:
                return start, m.end(), m[1] == "/", m[2], m[3]
            if text.startswith("<!--", start):
                close = text.find("-->", start + 4)
                return start, (close + 3 if close >= 0 else len(text)), False, None, ""
            if text[start + 1] in "!?":
                return start, text.index(">", start) + 1, False, None, ""
            at = start + 1
            if self.tag is _TAG and _PLAIN_TAG.match(text, start):  # its quotes reach beyond the last end of a tag
                self.tag, at = _PLAIN_TAG, start


def parse(page: str | None) -> tuple[Node, str]:
    """The block tree of a page, and its title; anything is accepted, as browsers do. Blocks nest at most ``DEPTH`` deep."""
    text = page or ""
    root = Node("#", "#")
    stack, title, at, end = [root], "", 0, len(text)
    inner = 0  # open inline elements that are boilerplate
    skips: list[str] = []
    scanner = _Scanner(text)
    for start, stop_at, is_end, tag, attributes in iter(lambda: scanner.next(at), None):
        if start > at and not inner:
            stack[-1].parts.append(text[at:start])
        at = stop_at
        if tag is None:
            continue
        tag = tag.lower()
        if not is_end and tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                stop = close.start() if close else end
                if tag == "title" and not title:
                    title = text[at:stop]
                after = text.find(">", stop) + 1
                at = after or end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append(" ")
            continue
        if tag not in BLOCK:
            # inline markup is transparent, unless it is marked as boilerplate
            if is_end:
                if skips and skips[-1] == tag:
                    skips.pop()
                    inner = len(skips)
            elif skips or (tag != "a" and (_traits(tag, attributes)[1] or _traits(tag, attributes)[3])):
                if not attributes.endswith("/") and (not skips or tag == skips[-1]):
                    skips.append(tag)
                    inner = len(skips)
            continue
        skips, inner = [], 0
        if is_end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in SCOPES and stack[k].tag in SCOPES:
                    break
            continue
        closing = CLOSES.get(tag, frozenset()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closing:
                del stack[k:]
                if tag not in CLOSES:
                    break
            elif stack[k].tag in SCOPES and not (tag in CLOSES and stack[k].tag in CLOSES[tag]):
                break
        node = Node(tag, *_traits(tag, attributes))
        if tag == "header" and node.boiler and any(n.tag == "article" for n in stack):  # the head of an article, not of the site
            node.boiler = _traits("div", attributes)[1]
        if len(stack) > DEPTH:  # beside the block that it would stand in, and marked like that one
            above = stack.pop()
            node.boiler, node.named, node.main = node.boiler or above.boiler, node.named or above.named, node.main or above.main
        stack[-1].parts.append(node)
        stack.append(node)
    if at < end and not inner:
        stack[-1].parts.append(text[at:])
    return root, _html.unescape(title)


def clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", _html.unescape("".join(parts))).strip()


# --- templates: nested lists [label, child, child, …]; like neighbours are one child


def skeleton(node: Node) -> list:
    """The tree of labels, with runs of like siblings merged into one."""
    out: list = [node.label]
    for part in node.parts:
        if isinstance(part, Node):
            child = skeleton(part)
            if len(out) > 1 and out[-1][0] == child[0]:
                out[-1] = merge(out[-1], child)
            else:
                out.append(child)
    return out


def _match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two trees: size of the largest match that keeps order, and the matched children."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a) - 1, len(b) - 1
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            gain[i][j] = w = _match(a[i], b[j])[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    pairs, i, j = [], m, n
    while i and j:
        if gain[i][j] and best[i][j] == best[i - 1][j - 1] + gain[i][j]:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs[::-1]


def merge(a: list, b: list) -> list:
    """A template that both trees fit: matched children are merged, the others stand where they stood."""
    if a == b:
        return a
    pairs = _match(a, b)[1]
    out, i, j = [a[0]], 1, 1
    for p, q in [*pairs, (len(a), len(b))]:
        out += [*a[i:p], *b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def align(template: list, tree: list, at: str = "") -> dict[tuple[int, ...], str]:
    """Template place (a path of child numbers) of each node of a skeleton, by its own path."""
    found: dict[tuple[int, ...], str] = {}

    def go(t, s, t_path, s_path):
        found[s_path] = t_path
        for p, q in _match(t, s)[1]:
            go(t[p], s[q], f"{t_path}.{p}", (*s_path, q))

    go(template, tree, at, ())
    return found


@lru_cache(maxsize=4096)
def _aligned(template: str, tree: str) -> dict[tuple[int, ...], str]:
    return align(json.loads(template), json.loads(tree))


@dataclass
class Block:
    """A run of text: skeleton path, nodes from the root down to its own, hard boilerplate mark."""

    path: tuple[int, ...]
    nodes: tuple[Node, ...]
    boiler: bool
    text: str


def _blocks(root: Node) -> list[Block]:
    """The runs of text in page order."""
    out = []

    def go(node, path, above, boiler):
        nodes, boiler = (*above, node), boiler or node.boiler
        run: list[str] = []

        def flush():
            if run and (text := clean(run)):
                out.append(Block(path, nodes, boiler, text))
            run.clear()

        last, k = None, 0
        for part in node.parts:
            if isinstance(part, Node):
                flush()
                if part.label != last:
                    last, k = part.label, k + 1
                go(part, (*path, k), nodes, boiler)
            else:
                run.append(part)
        flush()

    go(root, (), (), False)
    return out


def _in_main(block: Block) -> bool:
    """Inside an article or main element that is not named an advert or a comment."""
    return any(n.main and not n.named for n in block.nodes)


def _sizes(blocks: list[Block]) -> dict[int, int]:
    """Characters of the blocks under each node."""
    out: dict[int, int] = {}
    for b in blocks:
        for n in b.nodes:
            out[id(n)] = out.get(id(n), 0) + len(b.text)
    return out


def content_blocks(varying: list[Block]) -> list[Block]:
    """The content among a page's varying blocks: names and the article bound it only as far as the text allows."""
    # a name is no mark on what holds nearly all text of the article, or of the page if it has none
    pool = [b for b in varying if _in_main(b)] or varying
    sizes, total = _sizes(pool), sum(len(b.text) for b in pool)
    marked = lambda n: n.named and sizes.get(id(n), 0) < BULK * total
    content = [b for b in varying if not any(map(marked, b.nodes))]
    inside = [b for b in content if _in_main(b)]
    if not inside:
        return content
    # parts beside the article: the topmost node that holds none of its text
    held = {id(n) for b in inside for n in b.nodes}
    part = lambda b: next((id(n) for n in b.nodes if id(n) not in held), id(b))
    words: dict[int, int] = {}
    for b in content:
        words[part(b)] = words.get(part(b), 0) + len(b.text.split())
    return [b for b in content if _in_main(b) or words[part(b)] >= LEAST_WORDS]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _skeletons(pages: DataFrame, salts: int) -> DataFrame:
    """Distinct block trees of each host, made distinct in every batch first."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str], None] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                seen[host, json.dumps(skeleton(parse(page)[0]), separators=(",", ":"))] = None
            yield pa.RecordBatch.from_pydict({"host": [h for h, _ in seen], "tree": [t for _, t in seen]}, pa.schema([("host", pa.string()), ("tree", pa.string())]))

    trees = pages.select("host", "html").mapInArrow(run, "host string, tree string").distinct()
    return trees.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(salts)).cast("int"))


def _merged(trees: DataFrame, by: list[str]) -> DataFrame:
    def fold(key, pdf):
        out = None
        for t in sorted(pdf["tree"], key=lambda x: (len(x), x)):
            tree = json.loads(t)
            out = tree if out is None else merge(out, tree)
        pdf = pdf.iloc[:1][["host"]].copy()
        pdf["tree"] = json.dumps(out, separators=(",", ":"))
        return pdf

    return trees.groupBy(*by).applyInPandas(fold, "host string, tree string")


def templates(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, tree): one template per host, merged over all its pages."""
    return store(_merged(_merged(_skeletons(pages, salts), ["host", "salt"]), ["host"]), "templates")


def constants(pages: DataFrame, wrappers: DataFrame, min_share: float) -> DataFrame:
    """(host, fixed): the texts that are template, as a list of place and text hash.

    A text counts once per different page (title and all text that may be content), so copies of a page don't make its text
    look like a template. It is template if at least ``min_share`` of the host's other pages have it too, and one at least.
    """

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str, int, int], None] = {}
            for host, page, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree"))):
                root, title = parse(page)
                places = _aligned(tree, json.dumps(skeleton(root), separators=(",", ":")))
                blocks = [b for b in _blocks(root) if not b.boiler]
                mark = _hash("\n".join([clean([title]), *(b.text for b in blocks)]))
                for b in blocks:
                    seen[host, places.get(b.path, "?"), _hash(b.text), mark] = None
                seen[host, "-", 0, mark] = None  # the page itself, for the number of pages
            cols = list(zip(*seen)) if seen else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["host", "place", "h", "mark"])

    rows = pages.select("host", "html").join(wrappers, "host").mapInArrow(run, "host string, place string, h long, mark long")
    counts = store(rows.distinct().groupBy("host", "place", "h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "places")
    totals = counts.where("place = '-'").select("host", F.col("n").alias("pages"))
    often = counts.where("place <> '-'").join(totals, "host").where(F.col("n") - 1 >= F.lit(min_share) * (F.col("pages") - 1))
    return often.groupBy("host").agg(F.array_sort(F.collect_list(F.concat_ws("|", "place", "h"))).alias("fixed"))


def main_blocks(page: str | None, template: str | None = None, fixed: frozenset = frozenset()) -> list[str]:
    """The content blocks of one page, given its host's template and template texts."""
    root, _ = parse(page)
    blocks = _blocks(root)
    places: dict = {}
    if template and fixed:
        places = _aligned(template, json.dumps(skeleton(root), separators=(",", ":")))
    varying = [b for b in blocks if not b.boiler and f"{places.get(b.path, '?')}|{_hash(b.text)}" not in fixed]
    return [b.text for b in content_blocks(varying)]


def extract_main(pages: DataFrame, page: str = "html", url: str = "url", *, min_share: float = 0.6, salts: int = 64) -> DataFrame:
    """``pages`` with ``text``: the content blocks in page order, joined by newlines (a column of this name is replaced).

    Character references are decoded and white space inside a block is one space. Null and empty pages, and pages
    without content, have an empty text. Pages without a host share the empty host. Repeated rows get equal
    texts; an empty table stays empty.
    """
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c != "text"]
    base = pages.withColumns({"__host": host_of(F.col(url)), "__page": F.col(page)})
    slim = base.select(F.col("__host").alias("host"), F.col("__page").alias("html"))
    wrappers = templates(slim, salts)
    fixed = constants(slim, wrappers, min_share)
    wrappers = store(wrappers.join(fixed, "host", "left").select(F.col("host").alias("__h"), F.col("tree").alias("__tree"), F.coalesce("fixed", F.array()).alias("__fixed")), "wrappers")

    @F.pandas_udf("string")
    def content(hosts: pd.Series, htmls: pd.Series, trees: pd.Series, lists: pd.Series) -> pd.Series:
        memo: dict[tuple, frozenset] = {}
        out = []
        for host, h, t, x in zip(hosts, htmls, trees, lists):
            key = (host, t)
            if key not in memo:
                memo[key] = frozenset(x)
            out.append("\n".join(main_blocks(h, t, memo[key])))
        return pd.Series(out, dtype=object)

    joined = base.join(wrappers, base["__host"] == wrappers["__h"], "left")
    found = joined.withColumn("text", content("__host", "__page", "__tree", F.coalesce("__fixed", F.array().cast("array<string>"))))
    return found.select(*[c for c in keep], "text")
