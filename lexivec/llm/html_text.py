"""Main text of web pages from flat text blocks.

A page becomes its flat list of text blocks.  Each block is described by its
word count and link density, those of the blocks before and after it, and
what kind of element holds it; a decision tree, trained by Spark ML on the
small labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.common import batch, in_slices

# HTML's element kinds.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # up to their own end tag all is text
SKIPPED = frozenset("head script style noscript template textarea iframe noembed noframes xmp svg math canvas object audio video select option button datalist map".split())
CHROME = frozenset("nav footer aside form menu dialog search".split())
CHROME_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside
    menu menubar nav navbar navigation navmenu breadcrumb breadcrumbs footer foot colophon masthead topbar toolbar cookie cookies consent gdpr notice notices
    notification popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social widget widgets
    pagination pager copyright alert skip""".split())
HEADER_NAMES = frozenset("header head".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("article aside body div footer form header main nav ol section table ul dl menu dialog".split())

_MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_NAMES = re.compile(r"[^a-z0-9]+")


@dataclass
class Element:
    tag: str
    main: bool  # in an article or main element
    chrome: bool  # in what surrounds an article
    hidden: bool  # its text isn't read


@dataclass
class Block:
    main: bool
    chrome: bool
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)


def _enter(tag: str, attrs: str, top: Element) -> Element:
    given = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(attrs)}
    names = set(_NAMES.split(f"{given.get('class', '')} {given.get('id', '')}"))
    main, chrome = top.main, top.chrome
    comment = bool(names & COMMENT_NAMES)
    if tag in ("article", "main") and not comment and not chrome:
        main = True
    if tag not in ("html", "body", "main", "article") or comment:
        chrome |= tag in CHROME or comment or given.get("role") in CHROME_ROLES or bool(names & CHROME_NAMES)
        chrome |= not main and (tag == "header" or bool(names & HEADER_NAMES))
    hidden = top.hidden or tag in SKIPPED or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    return Element(tag, main, chrome, hidden)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in its order: a block element's tags end a block,
    and so does entering or leaving what surrounds the article."""
    out: list[Block] = []
    stack = [Element("", False, False, False)]
    links = 0  # open <a> elements
    fresh = True

    def add(text: str) -> None:
        nonlocal fresh
        if stack[-1].hidden or not text:
            return
        if fresh or not out:
            out.append(Block(stack[-1].main, stack[-1].chrome))
            fresh = False
        out[-1].text.append(text)
        if links:
            out[-1].linked.append(text)

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        add(html.unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        fresh |= tag in BLOCKS
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            # An end tag doesn't reach out of the nearest holder unless it is that holder's or an outer one's own.
            if depth and (tag in HOLDERS or not any(e.tag in HOLDERS for e in stack[depth + 1 :])):
                del stack[depth:]
                links = sum(e.tag == "a" for e in stack)
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        closes = CLOSED_BY.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes:
                del stack[k:]
                break
            if stack[k].tag in HOLDERS:
                break
        if tag == "body":
            stack = [e for e in stack if e.tag != "head"]
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        links = sum(e.tag == "a" for e in stack)
        e = _enter(tag, attrs, stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        fresh |= e.chrome != stack[-1].chrome or e.main != stack[-1].main
        stack.append(e)
        links += tag == "a"
    return out


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "main", "outside"]


def described(found: list[Block]) -> list[tuple[str, list[float]]]:
    """``(text, features)`` of each block with text; white space in it is one
    space.  ``main``: of the page's unlinked words, the share in articles, for
    a block in one.  ``outside``: the share on the other side of an article's
    bounds; half of it for a block before the articles' words.  So small
    articles (cards of other stories) say little about the rest."""
    own = []
    for b in found:
        if text := " ".join("".join(b.text).split()):
            words = len(text.split())
            own.append((text, words, min(1.0, sum(len(t.split()) for t in b.linked) / words), b))
    plain = [0.0 if b.chrome else n * (1 - d) for _, n, d, b in own]
    held = [p if b.main else 0.0 for p, (*_, b) in zip(plain, own)]
    article = any(b.main and not b.chrome for *_, b in own)
    share = sum(held) / sum(plain) if sum(plain) else 1.0
    outside, to_come = [], sum(held)
    for (*_, b), h in zip(own, held):
        to_come -= h
        outside.append((1 - share if b.main else share * (1 - to_come / sum(held) / 2) if sum(held) else 1.0) if article else 0.0)
    sizes = [(0, 0.0), *((n, d) for _, n, d, _ in own), (0, 0.0)]
    return [(text, [n, d, *sizes[k], *sizes[k + 2], float(b.chrome), share if b.main and article else float(b.main), outside[k]]) for k, (text, n, d, b) in enumerate(own)]


#: ``main`` and ``outside`` of a kind of holder.
HOLDS = {"article": (1.0, 0.0), "half": (0.8, 0.2), "card": (0.15, 0.85), "outside": (0.0, 0.9), "before": (0.0, 0.45), "beside": (0.0, 0.15), "above": (0.0, 0.08)}

#: The labelled table: kind of holder; words and link density of a block, of the one before, of the one after; 1: main text.
LABELLED = [
    ("article", (9, 0.0), (0, 0.0), (60, 0.0), 1), ("article", (60, 0.0), (9, 0.0), (80, 0.05), 1), ("article", (80, 0.05), (60, 0.0), (1, 0.0), 1),
    ("article", (1, 0.0), (80, 0.0), (1, 0.0), 1), ("article", (2, 0.0), (1, 0.0), (120, 0.02), 1), ("article", (14, 0.6), (90, 0.1), (70, 0.0), 1),
    ("article", (5, 1.0), (40, 0.0), (6, 1.0), 1), ("article", (200, 0.0), (5, 0.0), (0, 0.0), 1), ("article", (3, 0.0), (6, 1.0), (50, 0.0), 1),
    ("article", (40, 0.1), (8, 0.0), (8, 0.0), 1), ("article", (7, 0.0), (0, 0.0), (0, 0.0), 1), ("article", (25, 0.0), (30, 0.0), (9, 0.5), 1),
    ("article chrome", (6, 1.0), (90, 0.0), (5, 1.0), 0), ("article chrome", (40, 0.0), (120, 0.0), (30, 0.0), 0), ("article chrome", (12, 0.2), (30, 0.0), (0, 0.0), 0),
    ("article chrome", (3, 0.0), (60, 0.0), (60, 0.0), 0), ("article chrome", (90, 0.0), (2, 0.0), (80, 0.0), 0), ("article chrome", (1, 1.0), (1, 1.0), (9, 0.0), 0),
    ("chrome", (1, 1.0), (0, 0.0), (1, 1.0), 0), ("chrome", (2, 1.0), (1, 1.0), (2, 1.0), 0), ("chrome", (8, 0.0), (2, 1.0), (9, 0.0), 0),
    ("chrome", (12, 0.1), (70, 0.0), (0, 0.0), 0), ("chrome", (45, 0.0), (60, 0.0), (50, 0.0), 0), ("chrome", (120, 0.0), (3, 0.0), (90, 0.0), 0),
    ("chrome", (30, 0.0), (200, 0.0), (4, 0.5), 0), ("chrome", (5, 0.0), (0, 0.0), (60, 0.0), 0), ("chrome", (70, 0.0), (0, 0.0), (0, 0.0), 0),
    ("outside", (4, 1.0), (0, 0.0), (9, 0.0), 0), ("outside", (30, 0.0), (60, 0.0), (12, 0.0), 0), ("outside", (6, 0.0), (80, 0.0), (2, 1.0), 0),
    ("outside", (90, 0.0), (8, 0.0), (8, 0.0), 0), ("outside", (2, 0.0), (2, 1.0), (10, 0.0), 0), ("outside", (15, 0.5), (5, 1.0), (90, 0.0), 0),
    ("outside chrome", (2, 1.0), (0, 0.0), (2, 1.0), 0), ("outside chrome", (40, 0.0), (90, 0.0), (10, 0.0), 0), ("outside chrome", (9, 0.0), (120, 0.0), (0, 0.0), 0),
    ("plain", (60, 0.0), (8, 0.0), (70, 0.0), 1), ("plain", (90, 0.1), (60, 0.0), (40, 0.0), 1), ("plain", (30, 0.05), (90, 0.0), (3, 1.0), 1),
    ("plain", (8, 0.0), (0, 0.0), (70, 0.0), 1), ("plain", (120, 0.0), (0, 0.0), (0, 0.0), 1), ("plain", (4, 0.0), (50, 0.0), (60, 0.0), 1),
    ("plain", (18, 0.0), (60, 0.0), (25, 0.0), 1), ("plain", (1, 0.0), (70, 0.0), (50, 0.0), 1), ("plain", (45, 0.2), (30, 0.0), (2, 0.0), 1),
    ("plain", (1, 1.0), (0, 0.0), (1, 1.0), 0), ("plain", (2, 1.0), (1, 1.0), (2, 1.0), 0), ("plain", (3, 1.0), (2, 1.0), (8, 0.0), 0),
    ("plain", (12, 0.8), (3, 1.0), (4, 1.0), 0), ("plain", (6, 0.9), (90, 0.0), (5, 1.0), 0), ("plain", (25, 0.7), (5, 1.0), (0, 0.0), 0),
    ("plain", (4, 1.0), (60, 0.0), (5, 1.0), 0), ("plain", (40, 0.8), (60, 0.0), (60, 0.0), 0),
    ("before", (30, 0.0), (9, 0.0), (80, 0.0), 1), ("before", (25, 0.0), (8, 0.0), (9, 0.0), 1), ("before", (60, 0.05), (0, 0.0), (12, 0.0), 1),
    ("before", (18, 0.0), (3, 1.0), (60, 0.0), 1), ("before", (40, 0.0), (25, 0.0), (8, 0.0), 1), ("before", (9, 0.0), (2, 1.0), (28, 0.0), 1),
    ("before", (3, 0.0), (2, 1.0), (9, 0.0), 0), ("before", (6, 1.0), (0, 0.0), (30, 0.0), 0), ("before", (2, 1.0), (2, 1.0), (25, 0.0), 0),
    ("half", (60, 0.0), (9, 0.0), (80, 0.05), 1), ("half", (3, 0.0), (50, 0.0), (50, 0.0), 1), ("half", (14, 0.6), (90, 0.1), (70, 0.0), 1),
    ("above", (60, 0.0), (8, 0.0), (70, 0.0), 1), ("above", (90, 0.1), (60, 0.0), (40, 0.0), 1), ("above", (8, 0.0), (0, 0.0), (70, 0.0), 1),
    ("above", (45, 0.0), (60, 0.0), (5, 1.0), 1), ("above", (4, 0.0), (50, 0.0), (60, 0.0), 1), ("above", (3, 1.0), (60, 0.0), (5, 1.0), 0),
    ("beside", (60, 0.0), (8, 0.0), (70, 0.0), 1), ("beside", (120, 0.0), (14, 0.0), (0, 0.0), 1), ("beside", (30, 0.05), (90, 0.0), (3, 1.0), 1),
    ("beside", (8, 0.0), (15, 0.0), (70, 0.0), 1), ("beside", (4, 0.0), (50, 0.0), (60, 0.0), 1), ("beside", (2, 1.0), (14, 0.0), (2, 1.0), 0),
    ("card", (5, 1.0), (70, 0.0), (14, 0.0), 0), ("card", (14, 0.0), (5, 1.0), (6, 1.0), 0), ("card", (20, 0.0), (6, 1.0), (0, 0.0), 0),
    ("card", (18, 0.0), (7, 1.0), (7, 1.0), 0), ("card", (7, 0.0), (60, 0.0), (15, 0.0), 0), ("card", (15, 0.0), (7, 0.0), (6, 0.0), 0),
    ("card", (25, 0.0), (6, 0.0), (7, 0.0), 0), ("card", (6, 0.0), (15, 0.0), (16, 0.0), 0), ("card", (80, 0.0), (9, 0.0), (90, 0.0), 1), ("card", (90, 0.0), (80, 0.0), (0, 0.0), 1),
    ("card", (60, 0.0), (7, 0.0), (40, 0.0), 1), ("outside", (90, 0.0), (60, 0.0), (12, 0.0), 0), ("outside", (60, 0.0), (80, 0.0), (0, 0.0), 0), ("outside", (45, 0.0), (20, 0.0), (50, 0.0), 0),
    ("article", (12, 0.0), (6, 1.0), (5, 0.0), 1), ("article", (20, 0.0), (5, 1.0), (0, 0.0), 1), ("article", (3, 0.0), (6, 1.0), (4, 0.0), 1), ("half", (30, 0.0), (5, 1.0), (6, 1.0), 1),
    ("plain", (25, 0.0), (4, 1.0), (6, 0.0), 1), ("plain", (9, 0.0), (2, 1.0), (7, 0.0), 1), ("above", (9, 0.0), (1, 1.0), (8, 0.0), 1),
]


def trained_tree(spark: SparkSession) -> list:
    """The tree as nested lists: ``[feature, threshold, low, high]`` or 0/1."""
    rows = []
    for kind, (n, d), before, after, label in LABELLED:
        features = [n, d, *before, *after, "chrome" in kind, *HOLDS.get(kind.split()[0], (0.0, 0.0))]
        rows.append((float(label), Vectors.dense([float(x) for x in features])))
    model = DecisionTreeClassifier(maxDepth=5, maxBins=64, minInstancesPerNode=1, seed=1).fit(spark.createDataFrame(rows, ["label", "features"]))
    lines = model.toDebugString.splitlines()[1:]

    def read(at: int) -> tuple[object, int]:
        if m := re.match(r"\s*Predict: (\S+)", lines[at]):
            return int(float(m[1])), at + 1
        feature, threshold = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)  # after the line "Else"
        return [int(feature), float(threshold), low, high], at

    return [read(0)[0]]


def chosen(tree: list, features: list[float]) -> bool:
    node = tree[0]
    while isinstance(node, list):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(page: str, tree: list) -> str:
    return "\n\n".join(text for text, features in described(blocks(page)) if chosen(tree, features))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``: the main
    text, blocks joined by an empty line.  Null html: empty text."""
    tree = trained_tree(pages.sparkSession)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 500):
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                text = main_text(page, tree)
                rows.append((page_id, url, text, len(text)))
            yield batch(out, rows)

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
