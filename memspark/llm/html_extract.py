"""Main text of web pages by consensus of each host's pages.

Each page's containers are scored by the article text in them. The pages of a host vote with these scores on generalised
tag-class paths, such as html/body/div.content/article, and each page's text is taken from the containers on its host's
winning path, or, if it has none, from its own best container. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, drawings and reader comments are left out wherever they stand. What is known by its name only is
kept if it is an article or main element, has a name that speaks for an article as well, or holds most of a page without
any; a page that would have no text is read without regard to names. A host's path counts for a page only if its text there
isn't FAR_BELOW that of the page's own best container. An inline element known by its name stays where it is part of a
sentence; adverts and hidden ones go in any case.

Edge cases: null, empty and tagless pages (a tagless page is one block of text); broken, unclosed and cut-off markup;
pages of any length; a null or odd url has no host, and its page decides alone; equal votes go to the first path by name;
repeated rows are extracted each; other columns are carried on and those named text or n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import map_rows, stored

#: Hosts whose winning paths are sent to every task; beyond that they are joined.
BROADCAST_HOSTS = 50_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: A path's score must reach this share of the best container's score.
FAR_BELOW = 0.05
#: Paths longer than this go on from their hash.
LONG_PATH = 1000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg select audio video canvas annotation annotation-xml".split())
LEFT_OUT = frozenset("aside button dialog fieldset footer form head label menu nav option search".split())
#: A block-level start tag ends an open paragraph; these end an open element of their own kind as well.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of classes, ids and roles, split into words, that mark what is no article text.
NOISE = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "teaser toolbar tooltip widget complementary contentinfo".split()
)
#: Of these, such whose text is never the article's, however long, unless the page has no other.
READERS = frozenset("comment comments commentlist consent cookie cookies disqus gdpr replies reply respond".split())
#: Of all of them, such as no part of a sentence has.
ADVERTS = frozenset("ad ads adsense advert adverts advertisement advertising promo promotion sponsor sponsored share sharing social".split())
#: Words before a name that say what an element is beside or without.
ABOUT = re.compile(r"(?:has|have|no|not|with|without|hide|show)[-_]")
GOOD = frozenset("article main content story post entry body text".split())


class Node:
    """An element that bears on where text belongs."""

    __slots__ = ("tag", "parent", "path", "noise", "named", "order", "favour", "inside", "favoured", "spoken")

    def __init__(self, tag: str, parent: Node | None, label: str, noise: bool, order: int, favour: bool, named: frozenset = frozenset()):
        self.tag, self.parent, self.noise, self.order, self.favour, self.named = tag, parent, noise, order, favour, named
        above = parent.path if parent else ""
        if len(above) > LONG_PATH:
            above = "#" + hashlib.blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.path = f"{above}/{label}" if parent else label
        # Of this element or any around it: whether it is an article or main, speaks for an article, or has a name against it.
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.favoured = favour or (parent is not None and parent.favoured)
        self.spoken = bool(named) or (parent is not None and parent.spoken)


def _label(tag: str, attributes: str, inside: bool, within: bool = False) -> tuple[str, bool, bool, frozenset]:
    """Generalised name of an element, whether it is noise, whether its name speaks for an article, and the words in it that speak against.

    inside and within: whether it stands in an article or main element, or in one whose name speaks for an article.
    """
    if not attributes:
        return tag, tag in LEFT_OUT or (tag == "header" and not inside), tag in ("article", "main"), frozenset()
    classes, good, bad, hidden = "", False, set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = set(_NAME.findall(_CAMEL.sub(" ", token).lower()))
                against = set() if ABOUT.match(token.lower()) else words & NOISE
                if inside or (within and words != {"header"}):
                    against.discard("header")
                bad |= against
                good = good or bool(words & GOOD and not words & NOISE)
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in value.lower().split()} - {""}))
    if tag in ("html", "body", "main", "article") or (good and not bad & READERS):
        bad = set()
    noise = tag in LEFT_OUT or hidden or (tag == "header" and not inside)
    return f"{tag}.{classes}" if classes else tag, noise, tag in ("article", "main") or (good and not bad), frozenset(bad)


def _within(nodes: list[Node], wanted: Callable[[Node], bool]) -> set[Node]:
    """The wanted elements and all inside of them; nodes are in page order."""
    out: set[Node] = set()
    for node in nodes:
        if node.parent in out or wanted(node):
            out.add(node)
    return out


def _believed(found: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks outside elements whose names speak against them.

    A name isn't believed of an element that holds most of the page's unlinked text while no article stands outside such
    elements; it is believed of readers' comments.
    """
    if not any(node.spoken for node, _, _ in found):
        return found
    held: dict[Node, int] = {}
    article = 0
    for node, text, linked in found:
        held[node] = held.get(node, 0) + len(text) - linked
        if node.favoured and not node.spoken:
            article += len(text) - linked
    for node in reversed(nodes):
        if node.parent is not None:
            held[node.parent] = held.get(node.parent, 0) + held.get(node, 0)
    total = held[nodes[0]]
    out = _within(nodes, lambda x: bool(x.named) and (article > 0 or held.get(x, 0) * 2 <= total or bool(x.named & READERS)))
    return [block for block in found if block[0] not in out]


def _sentence(before: str, own: str, after: str) -> bool:
    """Whether a part of a block reads on from what stands before it or into what follows, and is not two thirds of it."""
    before, after = before.strip(), after.strip()
    if 2 * (len(before) + len(after)) < len(own.strip()):
        return False
    return bool(before and before[-1] not in ".!?\u2026:|") or bool(after and (after[0].islower() or after[0] in ",.;:)"))


def blocks(page: str, by_name: bool = True) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks of text outside noise, as innermost element, text and characters in links; and all containers, in page order.

    Without by_name, names of classes, ids and roles don't count against an element.
    """
    root = Node("html", None, "html", False, 0, False)
    stack, nodes, out = [root], [root], []
    parts: list[str] = []
    links: list[int] = []
    # Inline elements that may go: those still open as tag, depth of their own kind, blocks around them, first part and
    # whether they go in any case; and the closed ones of this block as first part, end and that.
    inline: list[list] = []
    spans: list[tuple[int, int, bool]] = []
    opened: Counter = Counter()
    link, at, n = 0, 0, len(page)

    def add(text: str, linked: int) -> None:
        parts.append(text)
        links.append(linked)

    def flush() -> None:
        if parts:
            for first, end, surely in [*spans, *((x[3], len(parts), x[4]) for x in inline)]:
                if surely or not _sentence("".join(parts[:first]), "".join(parts[first:end]), "".join(parts[end:])):
                    parts[first:end] = [""] * (end - first)
                    links[first:end] = [0] * (end - first)
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not stack[-1].noise:
                out.append((stack[-1], text, min(sum(links), len(text))))
            parts.clear()
            links.clear()
        spans.clear()
        for x in inline:
            x[3] = 0

    def end_at(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]
        while inline and inline[-1][2] > len(stack):
            inline.pop()

    while at < n:
        found = _TAG.search(page, at)
        end = found.start() if found else n
        if end > at:
            add(page[at:end], end - at if link else 0)
        if found is None:
            break
        at = found.end()
        closing, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            closing, tag, attributes = found.group(4), found.group(5), found.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                link = max(0, link - 1)
            if tag in BLOCK_TAGS:
                flush()
                if opened[tag] > 0:
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    end_at(i)
                continue
            for i in range(len(inline) - 1, -1, -1):
                if inline[i][0] == tag:
                    inline[i][1] -= 1
                    if not inline[i][1]:
                        spans.append((inline[i][3], len(parts), inline[i][4]))
                        del inline[i:]
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag == "br":
            add(" ", 0)
            continue
        if tag == "a":
            link = 1
        if tag in VOID and tag not in BLOCK_TAGS:
            continue
        if tag not in BLOCK_TAGS:
            for x in reversed(inline):
                if x[0] == tag:
                    x[1] += 1
                    break
            else:
                if (attributes or tag in LEFT_OUT) and not attributes.endswith("/"):
                    _, noise, _, named = _label(tag, attributes, False)
                    if noise or (named and by_name):
                        surely = (noise and tag != "label") or bool(named & (ADVERTS | READERS))
                        inline.append([tag, 1, len(stack), len(parts), surely])
            continue
        flush()
        link = link if tag != "p" else 0
        ends = SIBLINGS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ("p", *ends)) else ():
            kind = stack[i].tag
            if kind == "p" or kind in ends:
                end_at(i)
                break
            if kind in ("table", "ul", "ol", "dl", "td", "th") or (not ends and kind != "p" and kind in CONTAINERS):
                break
        if tag == "html" or (tag == "body" and opened["body"] > 0) or tag == "hr":
            continue
        if tag == "body":  # whatever head was left open ends here
            end_at(1)
        label, noise, favoured, named = _label(tag, attributes, stack[-1].inside, stack[-1].favoured)
        node = Node(tag, stack[-1], label, noise or stack[-1].noise, len(nodes), favoured, named)
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return _believed(out, nodes) if by_name else out, nodes


def scores(found: list[tuple[Node, str, int]], nodes: list[Node]) -> dict[Node, float]:
    """Article text of each container: a block counts in full for the nearest one and less for each one further out."""
    weights: dict[Node, float] = {}
    for node, text, linked in found:
        weights[node] = weights.get(node, 0.0) + float(len(text) - linked) * (1.0 if linked * 2 < len(text) else 0.1)
    out: dict[Node, float] = {}
    for node in reversed(nodes):
        weight = weights.get(node)
        if weight is None:
            continue
        if node.tag in CONTAINERS or node.parent is None:
            out[node] = weight * (1.5 if node.favour else 1.0)
            weight *= 0.7
        if node.parent is not None:
            weights[node.parent] = weights.get(node.parent, 0.0) + weight
    return out


def page_votes(page: str | None) -> list[tuple[str, int]]:
    """The paths that a page votes for, with votes of up to 1000 in all for the best and less for near ones."""
    by_path: dict[str, float] = {}
    for node, score in scores(*blocks(page or "")).items():
        by_path[node.path] = by_path.get(node.path, 0.0) + score
    best = max(by_path.values(), default=0.0)
    return [(path, int(1000 * score / best)) for path, score in by_path.items() if best and score >= best / 2]


def page_text(page: str | None, path: str | None) -> str:
    """The text of the containers on a path, or of the best container if the page has no text there or far less."""
    found, nodes = blocks(page or "")
    if not found:
        (found, nodes), path = blocks(page or "", by_name=False), None
    if not found:
        return ""
    ranked = scores(found, nodes)
    best = max(ranked, key=lambda x: (ranked[x], -x.order))
    there = sum(score for node, score in ranked.items() if node.path == path)
    far = there <= 0 or there < FAR_BELOW * ranked[best]
    chosen = _within(nodes, (lambda x: x is best) if far else (lambda x: x.path == path))
    return "\n\n".join(text for node, text, _ in found if node in chosen)


def host_paths(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The winning path of each host (host, path). Votes are summed for each host and path before they are compared."""

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(host, *x) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in page_votes(page)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "votes"])

    pages = df.select(_host(url).alias("host"), F.col(html).alias("html")).where(F.col("host") != "")
    votes = map_rows(pages, vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns but the html, with text and n_chars."""
    paths = stored(host_paths(df, url, html))
    few = paths.count() <= BROADCAST_HOSTS
    held = paths.withColumnsRenamed({"host": "host_of_path", "path": "host_path"})
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    source = df.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(kept)), _host(url).alias("host_of_page"), F.col(html).alias("page_html"))
    joined = source.join(F.broadcast(held) if few else held, F.col("host_of_page") == F.col("host_of_path"), "left").drop("host_of_page", "host_of_path")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(kept)
        texts = [page_text(page, path) for page, path in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return map_rows(joined, read, f"{fields}text string, n_chars long")
