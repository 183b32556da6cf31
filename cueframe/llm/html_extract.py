"""HTML main text by a site style tree.

The DOMs of a host's pages are merged from the root down.  An element of the tree stands below one presentation of its parent, a presentation being the order of
an element's children that hold text; so pages that are laid out otherwise have branches of their own.  Texts are leaves.  Importance, from 0 to 1, is composed
from below:

* a leaf's is the normalised entropy of its contents: 0 if all pages say the same, 1 if each says something else;
* an element's is ``(1 - GAMMA**l) * own + GAMMA**l * below``, where ``own`` is the normalised entropy of its ``l`` presentations over the pages and ``below`` its
  children's importance in proportion to their text.

One page's worth of doubt is added (``1 / pages``), so that little evidence removes nothing.  A branch goes from each page if its importance is under ``LEAST`` and nothing
in it has ``SURE``.  Roles are priors: tags that cannot hold main text (menus, footers, forms and the like) have prior 0; a class or id that names such a part removes
its branch unless the tree says that the branch is important and holds most of its pages' text.

A block belongs to the branches that hold all of it, so a link or emphasis within a paragraph does not decide on the paragraph; what is taken out of the middle of a
block leaves one blank.

Defined cases: a null or empty html has an empty text; a null or odd url has the host ''; if only the tree would remove all of a page's text (nothing tells content from
frame) the priors alone decide; equal pages of one host get equal texts; an empty table gives an empty table; other columns are
ignored.  A page that ends within a tag, comment or raw text (script, style, title and the like) loses that piece; a self-closed element of raw text
that no closing tag follows is empty.  What stands in svg, template, noscript and formula annotations is no text; formulas, objects and canvases hold text.  What lies deeper than
``DEPTH`` elements counts as its ancestor's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import materialize, release

LEAST, SURE, MOST, GAMMA, DEPTH = 0.2, 0.6, 0.5, 0.9, 16
#: Marked elements of all hosts that are broadcast (8 bytes each); more are joined by shuffle, each host's pages in SALTS parts.
BROADCAST_PATHS, SALTS = 200_000, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

# Element classes of HTML.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in "script style textarea title iframe noembed noframes xmp".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend"
    " li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption button".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ITEM = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ITEM = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ITEM.items()}
# Roles without main text, by tag, and by the words of class, id and role; some words say so only of elements that hold others.
_NO_TAGS = frozenset("nav footer aside form button select dialog menu head header".split())
_NO_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login register sidebar widget widgets related recommended share sharing breadcrumb breadcrumbs pagination pager"
    " nav navbar navigation toolbar topbar footer copyright disclaimer comment comments reply replies respond disqus contentinfo masthead".split()
)
_NO_HOLDERS = frozenset("menu search complementary header dialog form social".split())
#: Words that make a class name a state of something else, as in has-sidebar.
_STATE = frozenset("has no with without is not hide show".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dt dd td".split())
_MAIN = frozenset(("article", "main"))
#: Elements whose text is never said, so that it does not part the text around them.
_SILENT = frozenset("svg template noscript title annotation annotation-xml".split())
#: Elements whose inside does not close what is open outside.
_SCOPE = frozenset("svg math template noscript object".split())
_FOREIGN = frozenset(("svg", "math"))
_HTML_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)


@dataclass(slots=True)
class Node:
    """``drop``: prior 0; ``weak``: its names say that it is no main text."""

    tag: str
    key: str
    drop: bool
    weak: bool
    main: bool
    silent: bool
    foreign: bool


def _role(tag: str, attrs: dict[str, str], main: bool) -> bool:
    """Whether the prior of the element's role is 0.  A header within the article holds its title."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in _SILENT or (tag in _NO_TAGS and not (tag == "header" and main)):
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def _named(tag: str, attrs: dict[str, str], main: bool) -> bool:
    """Whether class, id or role name a part that is no main text."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name in " ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))).lower().split():
        words = _WORD.findall(name)
        if not words or words[0] in _STATE:
            continue
        if not _NO_WORDS.isdisjoint(words) or (len(words) == 1 and tag not in _TEXT_TAGS and words[0] in _NO_HOLDERS and not (main and words[0] == "header")):
            return True
    return False


class Page:
    """A parsed page: ``nodes``, and ``blocks`` of (indexes of the nodes that hold all of it, text) in page order."""

    __slots__ = ("blocks", "nodes")

    def __init__(self, source: str | None) -> None:
        self.nodes: list[Node] = []
        self.blocks: list[tuple[tuple[int, ...], str]] = []
        source = source or ""
        stack: list[int] = []
        nodes = self.nodes
        pieces: list[tuple[tuple[int, ...], str]] = []
        unclosed: set[str] = set()
        at = 0

        def flush() -> None:
            seen = [p for p in pieces if not _aside(p[0])]
            if any(html.unescape(t).strip() for _, t in seen):
                # What is taken out of a block's middle parts what stands around it.
                parts = "".join(t if not _aside(held) else " " for held, t in pieces)
            else:
                seen, parts = pieces, "".join(t for _, t in pieces)
            owner = None
            for held, text in seen:
                if html.unescape(text).strip():
                    owner = held if owner is None else _common(owner, held)
            if text := " ".join(html.unescape(parts).split()):
                self.blocks.append((owner or (), text))
            pieces.clear()

        def said(text: str) -> None:
            if stack and nodes[stack[-1]].silent:
                return
            pieces.append((tuple(stack), text))

        def _aside(held: tuple[int, ...]) -> bool:
            """Whether an inline element around the text is no main text."""
            for i in reversed(held):
                if nodes[i].tag in _BLOCK:
                    return False
                if nodes[i].drop or nodes[i].weak:
                    return True
            return False

        while m := _TOKEN.search(source, at):
            if (first := m.start()) > at:
                said(source[at:first])
            at = m.end()
            if (tag := m["tag"]) is None:
                continue
            tag = tag.lower()
            if m["end"]:
                closes = next((k for k in range(len(stack) - 1, -1, -1) if nodes[stack[k]].tag == tag), len(stack))
                inner = stack[min(closes, len(stack) - 1)] if stack else None
                if tag in _BLOCK and (inner is None or not nodes[inner].silent):
                    flush()
                del stack[closes:]
                continue
            empty = m["attr"].endswith("/")
            if tag in _LEAVES_FOREIGN:
                while stack and nodes[stack[-1]].foreign:
                    del stack[-1]
            if tag in _RAW and not ((empty or tag == "title") and stack and nodes[stack[-1]].foreign):
                if tag not in unclosed and (close := _RAW[tag].search(source, at)):
                    at = close.end()
                else:
                    unclosed.add(tag)
                    at = at if empty else len(source)
                continue
            if tag == "br":
                said(" ")
                continue
            if tag in _BLOCK:
                if not (stack and nodes[stack[-1]].silent):
                    flush()
                if tag in _CLOSES_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if (open_tag := nodes[stack[k]].tag) == "p":
                            del stack[k:]
                            break
                        if open_tag in _SCOPE:
                            break
                elif tag in _ITEM:
                    peers, stop = _ITEM[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if (open_tag := nodes[stack[k]].tag) in peers:
                            del stack[k:]
                            break
                        if open_tag in stop or open_tag in _SCOPE:
                            break
            if tag in _VOID:
                continue
            attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m["attr"])} if m["attr"] else {}
            parent = nodes[stack[-1]] if stack else None
            main = tag in _MAIN or bool(parent and parent.main)
            silent = tag in _SILENT or bool(parent and parent.silent)
            foreign = tag in _FOREIGN or bool(parent and parent.foreign and tag not in _HTML_IN_FOREIGN)
            key = tag + "".join(f".{c}" for c in sorted(attrs["class"].split())) if "class" in attrs else tag
            if (ident := attrs.get("id", "")) and not any(c.isdigit() for c in ident):
                key += f"#{ident}"
            nodes.append(Node(tag, key, bool(parent and parent.drop) or _role(tag, attrs, main), _named(tag, attrs, main), main, silent, foreign))
            if empty and (foreign or tag not in _BLOCK):
                continue
            stack.append(len(nodes) - 1)
        if at < len(source):
            said(source[at:])
        flush()

    def text(self, low: frozenset[int] = frozenset(), kept: frozenset[int] = frozenset()) -> str:
        """The blocks of no branch in ``low``, and of none that its names speak against unless it is in ``kept``."""
        live, chains = self.live(), [[] for _ in self.blocks]
        if low or any(self.nodes[i].weak for k in live for i in self.blocks[k][0]):
            chains = branches(self)[1]
        out = [k for k in live if not any(weak and key not in kept for key, weak in chains[k])]
        rest = [k for k in out if not any(key in low for key, _ in chains[k])] if low else out
        return "\n".join(self.blocks[k][1] for k in rest or out)

    def live(self) -> list[int]:
        """The numbers of the blocks whose roles have prior 1."""
        return [k for k, (owner, _) in enumerate(self.blocks) if not any(self.nodes[i].drop for i in owner)]


@dataclass(slots=True)
class Branch:
    """One element of the style tree on one page; ``texts``: the hashed contents of a leaf."""

    key: int
    parent: int
    depth: int
    style: int
    weak: bool
    chars: int
    texts: set[int] | None = None


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def branches(page: Page) -> tuple[list[Branch], list[list[tuple[int, bool]]]]:
    """The page's branches, and for each block the keys of those that hold it, with whether their names speak against them."""
    out: list[Branch] = []
    chains: list[list[tuple[int, bool]]] = [[] for _ in page.blocks]

    def walk(found: list[int], at: int, key: int, parent: int, weak: bool) -> None:
        names: list[str] = []
        kids: dict[str, list[int]] = {}
        weaks: dict[str, bool] = {}
        for b in found:
            owner = page.blocks[b][0]
            node = page.nodes[owner[at]] if at < min(len(owner), DEPTH) else None
            name = node.key if node else "#text"
            if not names or names[-1] != name:
                names.append(name)
            kids.setdefault(name, []).append(b)
            weaks[name] = bool(node and node.weak)
            chains[b].append((key, weak))
        style = _hash(key, *names)
        out.append(Branch(key, parent, at, style, weak, sum(len(page.blocks[b][1]) for b in found)))
        for name, inner in kids.items():
            child = _hash(style, name)
            if name == "#text":
                out.append(Branch(child, key, at + 1, 0, False, sum(len(page.blocks[b][1]) for b in inner), {_hash(page.blocks[b][1]) for b in inner}))
                for b in inner:
                    chains[b].append((child, False))
            else:
                walk(inner, at + 1, child, key, weaks[name])

    if live := page.live():
        walk(live, 0, 0, -1, False)
    return out, chains


def _common(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """The nodes that a and b begin with."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return a[:k]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


TREE_COLUMNS = "host string, key long, parent long, depth int, weak boolean, style long, content long, chars long, page_chars long"


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TREE_COLUMNS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part, rows = batch.slice(first, 256), []
            for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = branches(Page(source))[0]
                host, total = host_of(url), found[0].chars if found else 0
                for b in found:
                    rows.append((host, b.key, b.parent, b.depth, b.weak, b.style, None, b.chars, total))
                    rows += [(host, b.key, b.parent, b.depth, b.weak, b.style, c, 0, 0) for c in b.texts or ()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names)
    release()


def _entropy(total: Column, weighted: Column, pages: Column) -> Column:
    """Normalised entropy, 0 to 1, of counts with this total and this sum of ``n * log(n)``; 1 for a single page."""
    value = F.when(pages > 1, (F.log(total) - weighted / total) / F.log(pages)).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, key, pages, weak, share, importance, best`` of all branches; ``best`` is the greatest importance in the branch, ``share`` its part of its pages' text."""
    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_tree_batches, TREE_COLUMNS)
    ids = ["host", "key", "parent", "depth", "weak"]
    # Counted per value first, so that no branch's rows meet in one task.
    counts = rows.groupBy(*ids, "style", "content").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("page_chars").alias("page_chars"))
    counts = materialize(counts, "tree")
    n = F.col("n")
    styles = counts.where("content IS NULL").groupBy(*ids).agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("l"), F.sum(n * F.log(n)).alias("s"), F.sum("chars").alias("chars"), F.sum("page_chars").alias("page_chars")
    )
    texts = counts.where("content IS NOT NULL").groupBy("host", "key").agg(F.sum("n").alias("said"), F.sum(n * F.log(n)).alias("c"))
    # A leaf's contents: how far from being on all pages they are.
    leaf = 1 - F.when((F.col("pages") > 1) & (F.col("said") > 0), F.col("c") / (F.col("said") * F.log("pages"))).otherwise(0.0)
    nodes = styles.join(texts, ["host", "key"], "left").withColumn("own", _entropy(F.col("pages"), F.col("s"), F.col("pages")))
    nodes = materialize(nodes.withColumn("leaf", F.when(F.col("said").isNotNull(), leaf)), "tree-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    shown = ["host", "key", "parent", "pages", "weak", "chars", "page_chars", "importance", "best"]
    doubt = 1 / F.col("pages")
    done, below = None, None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("below", F.lit(None).cast("double")).withColumn("top", F.lit(None).cast("double"))
        else:
            weight = F.col("chars") + 1
            under = below.groupBy("host", F.col("parent").alias("key")).agg((F.sum(weight * F.col("raw")) / F.sum(weight)).alias("below"), F.max("best").alias("top"))
            level = level.join(under, ["host", "key"], "left")
        share = F.pow(F.lit(GAMMA), F.col("l"))
        raw = F.coalesce("leaf", (1 - share) * F.col("own") + share * F.coalesce("below", F.lit(1.0)))
        level = level.withColumn("raw", raw).withColumn("importance", doubt + (1 - doubt) * F.col("raw")).withColumn("best", F.greatest("importance", "top"))
        below = materialize(level.select(*shown, "raw"), "tree-level")
        done = below.select(*shown) if done is None else done.unionByName(below.select(*shown))
    return done.select("host", "key", "pages", "weak", (F.col("chars") / F.greatest("page_chars", F.lit(1))).alias("share"), "importance", "best")


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, kept = ([frozenset(x or ()) for x in batch.column(c).to_pylist()] for c in (3, 4))
        texts = [Page(s).text(x, y) for s, x, y in zip(batch.column(2).to_pylist(), low, kept, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    release()


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    tree = style_tree(pages)
    kept = F.col("weak") & (F.col("importance") >= SURE) & (F.col("share") >= MOST)
    low = (F.col("importance") < LEAST) & (F.col("best") < SURE)
    marks = materialize(tree.where(kept | low).select("host", "key", low.alias("low")), "marked")
    pick = lambda test: F.filter(F.collect_list(F.when(test, F.col("key"))), lambda x: x.isNotNull())
    by_host = marks.groupBy("host").agg(pick(F.col("low")).alias("low"), pick(~F.col("low")).alias("kept"))
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")), F.lit("")))
    rows = pages.withColumn("host", host)
    if marks.count() <= BROADCAST_PATHS:
        rows = rows.join(F.broadcast(by_host), "host", "left")
    else:
        by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(by_host, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "low", "kept").mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
