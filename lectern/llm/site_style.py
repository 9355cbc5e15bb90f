"""HTML extraction by site style trees: pages of a host are merged, and branches that say the same everywhere go.

A node of the tree is a path of elements with their classes and ids. Over the different pages of a host, a node's
styles (its sequences of child elements) and contents (its texts) have an entropy; a node whose few contents and
styles recur on nearly all pages is of low importance. Besides, elements that are boilerplate by their name, role or
class are left out, and where a page has an article, only that is read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .url_filter import host_of

#: Least pages of a host that a node is judged by, importance below which it is low, weight of contents for each style.
PAGES, LOW, DAMP = 4, 0.25, 0.9
BROADCAST_ROWS = 100_000

#: Kinds of elements.
BLOCKS = frozenset("html body article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption main header footer nav aside form fieldset address details summary hr noscript dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
BOILERPLATE = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg canvas dialog menu object audio video map title".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert form dialog menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond share sharing social related recommended widget toolbar pagination pager login skip copyright".split()
)
#: Words that may stand beside a mark in a class or id that names boilerplate; beside other words it names something else.
PLACES = frozenset(
    "area author bar block body bottom box button buttons card center column container content entry fixed form group head header heading holder icon icons inline inner item items label large left link links list "
    "main message meta mini mobile outer page panel post posts region right row section side site slot small sticky text thread title top unit wide wrap wrapper".split()
)
#: Of a page, but inside an article they belong to it.
HEADS = frozenset("header banner masthead topbar".split())
ENDS_P = BLOCKS - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "key", "noise", "article", "marked", "children")

    def __init__(self, tag: str, key: int, noise: bool, article: int, marked: bool):
        self.tag, self.key, self.noise, self.article, self.marked, self.children = tag, key, noise, article, marked, []


def _open(tag: str, text: str, above: Node | None) -> Node:
    found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(text)} if text.strip(" /\n\t") else {}
    each = sorted(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    names = " ".join(each)
    role = found.get("role", "").lower()
    article = above.article if above else 0
    inside = article > 0
    noise = bool(above and above.noise) or tag in BOILERPLATE or role in ROLES or _marked(each, MARKS) or "hidden" in found or found.get("aria-hidden") == "true"
    noise = noise or (not inside and (tag == "header" or _marked(each, HEADS)))
    if not noise and (tag in ("article", "main") or role in ("main", "article")):
        if tag == "article" and above and any_article(above):
            noise = True  # an article in an article is a comment on it
        article = max(article, 2 if tag == "article" else 1)
    # a node's key is the hash of its path, from that of the node above
    return Node(tag, _hash(f"{above.key if above else 0}/{tag}.{names}"), noise, article, bool(names))


def _marked(names: list[str], marks: frozenset) -> bool:
    """Whether one of the names has a mark and, besides, only places and numbers."""
    for name in names:
        parts = PARTS.findall(name)
        if any(x in marks for x in parts) and all(x in marks or x in PLACES or x.isdigit() for x in parts):
            return True
    return False


def any_article(node: Node) -> bool:
    return node.article == 2


def blocks(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(node, text) of each block of a page in order, and all its blocks' nodes. Malformed markup is read as it comes.

    Elements inside a line neither part a block nor go by their class, as they are part of its sentence.
    """
    root = Node("", 0, False, 0, False)
    stack, nodes = [root], [root]
    depth: Counter[str] = Counter()
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    holder = root

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append((holder, text))
            held.clear()

    def close(k: int) -> None:
        nonlocal holder
        if not all(map(mute, stack[k:])):
            flush()
        depth.subtract(s.tag for s in stack[k:])
        del stack[k:]
        holder = stack[-1]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not mute(stack[-1]):
            held.append(entities.unescape(piece))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if depth[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BOILERPLATE and tag not in BLOCKS:
            if not m[3].endswith("/"):
                stack.append(_open(tag, m[3], stack[-1]))
                depth[tag] += 1
        elif tag in BLOCKS:
            if tag in ENDS_P and depth["p"]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"))
            if any(depth[t] for t in SAME.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in STOPS.get(tag, ()):
                        break
                    if stack[i].tag in SAME[tag]:
                        close(i)
                        break
            flush()
            node = _open(tag, m[3], stack[-1])
            stack[-1].children.append(tag)
            stack.append(node)
            depth[tag] += 1
            nodes.append(node)
            holder = node
    flush()
    return out, nodes


def mute(node: Node) -> bool:
    """Inside a line, like a button: its text goes without parting the block around it."""
    return node.noise and node.tag not in BLOCKS


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (host, page, node, kind, feature): kind 0 is presence, 1 a style, 2 a content."""
    for batch in batches:
        hosts, pages, rows = [], [], []
        for host, page in zip(batch["host"], batch["html"]):
            found, nodes = blocks(page)
            mine = {(b.key, 2, _hash(t)) for b, t in found if not b.noise}
            for k in {b.key: b for b, _ in found if not b.noise}.values():
                mine.add((k.key, 0, 0))
                mine.add((k.key, 1, _hash(" ".join(c for i, c in enumerate(k.children) if not i or c != k.children[i - 1]))))
            rows += mine
            hosts += [host] * len(mine)
            pages += [_hash(page)] * len(mine)
        table = np.array(rows, np.int64).reshape(-1, 3)
        yield pd.DataFrame({"host": hosts, "page": np.array(pages, np.int64), "node": table[:, 0], "kind": table[:, 1].astype("int32"), "feature": table[:, 2]})


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance of the tree of ``pages(host, html)``. Equal pages of a host count once."""
    rows = pages.mapInPandas(_tree, "host string, page long, node long, kind int, feature long").distinct()
    counts = rows.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("c"))
    nodes = counts.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("styles"),
        # the sums of c log c and of log c give both entropies once the number of pages is known
        F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c")).otherwise(0.0)).alias("style_logs"),
        F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("contents"),
        F.sum(F.when(F.col("kind") == 2, F.log("c")).otherwise(0.0)).alias("content_logs"),
    )
    m = F.log("pages")
    style = F.when(F.col("pages") > 1, 1 - F.col("style_logs") / (F.col("pages") * m)).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("content_logs") / (F.col("contents") * m)).otherwise(1.0)
    share = F.pow(F.lit(DAMP), F.col("styles"))
    return nodes.select("host", "node", "pages", ((1 - share) * style + share * F.coalesce(content, F.lit(1.0))).alias("importance"))


def page_text(page: str, low: frozenset) -> str:
    """Main text of a page; ``low`` are hashes of its host's nodes of low importance."""
    found, _ = blocks(page)
    kept = [(b, t) for b, t in found if not b.noise]
    if any(b.article == 2 for b, _ in kept):
        kept = [(b, t) for b, t in kept if b.article == 2]
    elif any(b.article for b, _ in kept):
        kept = [(b, t) for b, t in kept if b.article]
    if low:
        # plain paragraphs of an article are its text however often the site repeats them
        rest = [(b, t) for b, t in kept if (b.article and not b.marked) or b.key not in low]
        kept = rest or kept
    return "\n".join(t for _, t in kept)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [page_text(p, frozenset() if low is None else frozenset(low.tolist())) for p, low in zip(batch["html"], batch["low"])]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars (code points).

    Null html is empty; a page without main text has text ''. Null urls and urls without a host share one tree. White
    space inside a block is one space, a line break is white space; blocks are joined by one line end each. Repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("host", host_of(F.coalesce("url", F.lit(""))))
    low = importance(rows.select("host", "html")).where((F.col("pages") >= PAGES) & (F.col("importance") < LOW))
    low = keep(low.groupBy("host").agg(F.collect_list("node").alias("low")), "low")  # as many as a host has kinds of boilerplate
    few = F.broadcast(low) if low.count() <= BROADCAST_ROWS else low
    return rows.join(few, "host", "left").select("page_id", "url", "html", "low").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
