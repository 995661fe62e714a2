"""Main text of web pages by wrappers inferred from all pages of a host.

A wrapper is a union-free regular expression over the tokens of a host's pages:
block tags, optional and repeated groups, and text slots.  It is inferred by
aligning token streams iteratively.  A page is aligned with the wrapper that
the pages before it have made, and every mismatch is resolved:

* a tag that only one side has becomes an optional group,
* a tag that comes back after others makes a repeated group of what lies between,
* text that differs becomes a slot; text that never differs stays template.

The state of an alignment is a sum: per node of the wrapper its pages and
parents, which tag follows which, hashes and lengths of its texts.  So pages may
be aligned in any order and wrappers of tasks are aligned by aggregation; a host
with a third of all pages costs each task one wrapper.  The expression itself
is read off the state (``expression``): tags that follow each other in a circle
are a repeated group, a tag that some parent lacks is optional.

Extraction walks a page along its host's wrapper.  Menus, headers, footers,
sidebars, notices, adverts, forms, comments of readers, scripts and styles go by
their tags, roles and class words.  The text lies in ``article`` or ``main``
elements; where a page has none, below the deepest node of the wrapper
that holds over half of the host's slot text, without links.  Text that stays
the same on all pages of a host is template and goes, if the host has
``VARIANTS`` different pages and more, and the text is no heading or paragraph.

Defined cases: null html is empty text; a null url is host ``""``; pages that are
cut off, tags that stay open or close nothing are read as far as they go;
repeated rows give repeated result rows; an empty table gives an empty result.
Only ``page_id``, ``url`` and ``html`` are read, other columns may have any
name.  A page is held whole, with memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, table, written

VARIANTS = 8
#: Tags whose content is no text of a page, up to their end tags.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Tags that stand inside a line of text and take no part in the structure.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Tags that hold text, and the start tags that close them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
KEPT_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table div article section main aside nav header footer form blockquote pre figure hr address details fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: An end tag does not reach out of these.
SCOPES = frozenset("article section main aside nav header footer div table td th li ul ol body form".split())
APART = frozenset("nav footer aside form button dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert comment comments commentlist disqus"
    " replies respond share sharing social related recommended recommendations newsletter subscribe popup modal overlay widget widgets toolbar"
    " pagination pager".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
GAP = re.compile(r"[\s ]+")

STATE = pa.schema(
    [("host", pa.string()), ("node", pa.int64()), ("mark", pa.string()), ("parent", pa.int64()), ("label", pa.string())]
    + [(c, pa.int64()) for c in ("pages", "parents", "occurrences", "chars", "linked", "low", "high")]
)
STATE_SQL = "host string, node long, mark string, parent long, label string, pages long, parents long, occurrences long, chars long, linked long, low long, high long"
MOST_NODES = 1 << 17


def hashed(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & (2**64 - 1)) - 2**63


def apart_by(attributes: str) -> bool:
    """Does a class, id or role say that an element is no main text?"""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        if name.lower() == "role":
            if value.strip().lower() in APART_ROLES:
                return True
        elif any(w.lower() in APART_WORDS for w in WORD.findall(value)):
            return True
    return False


class Element:
    """A block element of a page; ``node`` is its place in the wrapper."""

    __slots__ = ("tag", "label", "apart", "holds_main", "parent", "node", "seen", "last", "out", "main", "header")

    def __init__(self, tag: str, apart: bool, parent: Element | None):
        self.tag, self.apart, self.parent, self.holds_main = tag, apart, parent, False
        self.label, self.seen, self.last = "-" + tag if apart else tag, set(), ""
        if parent is not None and parent.label == self.label and tag in ("div", "section"):
            self.node = parent.node  # a box in a box is the box
        else:
            self.node = hashed(self.label, parent.node if parent else 0)


def read(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Block elements in page order, and blocks of text: their element, text, and characters inside links."""
    root = here = Element("", False, None)
    elements, blocks, parts, at = [root], [], [], 0
    opened: dict[str, int] = {}
    linked = in_link = 0

    def flush():
        nonlocal linked, in_link
        text = GAP.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append((here, text, min(linked, len(text))))
        parts.clear()
        linked = in_link = 0

    def leave(element):
        opened[element.tag] -= 1
        return element.parent

    while at < len(html):
        begun = html.find("<", at)
        found = TOKEN.match(html, begun) if begun >= 0 else None
        end = len(html) if begun < 0 else begun if found else begun + 1
        if end > at:
            text = unescape(html[at:end])
            parts.append(text)
            linked += in_link * len(text)
        if not found:
            at = end
            continue
        at = found.end()
        if found[2] is None:
            continue
        closes, tag, attributes = found[1], found[2].lower(), found[3]
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = int(not closes)
        elif tag in INLINE:
            continue
        elif tag in RAW and not closes and not attributes.endswith("/"):
            last = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = last.end() if last else len(html)
        elif tag in VOID or tag in RAW:
            if tag == "hr":
                flush()
        elif closes:
            flush()
            up = here if opened.get(tag) else root
            while up.tag != tag and up is not root:
                up = root if up.tag in SCOPES and tag in LEAVES else up.parent
            if up is not root:
                while here is not up:
                    here = leave(here)
                here = leave(here)
        else:
            flush()
            while tag in CLOSED_BY.get(here.tag, ()):
                here = leave(here)
            apart = tag in APART or bool(attributes) and tag not in ("html", "head", "body") and apart_by(attributes)
            here = Element(tag, apart, here)
            opened[tag] = opened.get(tag, 0) + 1
            elements.append(here)
    flush()
    return elements, blocks


def settle(elements: list[Element]) -> bool:
    """Mark each element: apart from the main text, inside it, inside its header.  Has the page a named main text?

    Main texts are the articles, or else the ``main`` elements, that lie in
    nothing that is apart.  Only where all lie in such elements, those that go by
    their class words do not count as apart.
    """
    chosen: set[int] = set()
    for unlocked in (False, True):
        for tag in ("article", "main"):
            for e in elements if unlocked else ():
                up = e if e.tag == tag and not e.apart else None
                while up is not None and not up.holds_main:
                    up.holds_main = up.tag not in APART
                    up = up.parent
            for e in elements:
                e.out = (e.parent is not None and e.parent.out) or (e.apart and not e.holds_main)
            chosen = {id(e) for e in elements if e.tag == tag and not e.out}
            if chosen:
                break
        if chosen:
            break
    for e in elements:
        up = e.parent
        e.main = id(e) in chosen or (up is not None and up.main)
        e.header = e.tag == "header" or (up is not None and up.header)
    return bool(chosen)


class Wrapper:
    """What the aligned pages of a host have in common, as sums per node."""

    def __init__(self):
        self.nodes: dict[int, list] = {}
        self.marks: set[tuple[int, str]] = set()

    def align(self, html: str) -> None:
        """Align one more page: new tags, tags that come back and differing texts become marks, counts and bounds of hashes."""
        elements, blocks = read(html)
        nodes, new = self.nodes, set()
        for e in elements:
            up = e.parent
            state = nodes.setdefault(e.node, [up.node if up else 0, e.label, 0, 0, 0, 0, 0, None, None])
            state[2] += e.node not in new
            new.add(e.node)
            if up is None or up.node != e.node:
                state[4] += 1
            if up is not None and up.node != e.node:
                state[3] += e.label not in up.seen
                up.seen.add(e.label)
                self.marks.add((up.node, f"{up.last} {e.label}"))
                up.last = e.label
        for e, text, linked in blocks:
            state, h = nodes[e.node], hashed(text)
            state[5] += len(text)
            state[6] += linked
            state[7] = h if state[7] is None else min(state[7], h)
            state[8] = h if state[8] is None else max(state[8], h)
        # one of 64 cells: how many are marked tells a few different pages from many equal ones
        self.marks.add((elements[0].node, f"#{hashed(' '.join(text for _, text, _ in blocks)) % 64}"))

    def rows(self, host: str) -> list[tuple]:
        nodes = [(host, node, None, *state) for node, state in self.nodes.items()]
        return nodes + [(host, node, mark, *[None] * 9) for node, mark in self.marks]


def aligned(pages: DataFrame) -> DataFrame:
    """The state of every host's wrapper, from all its pages: each task aligns its own, sums align the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}

        def rows():
            for host, wrapper in wrappers.items():
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*wrapper.rows(host)), STATE)], schema=STATE)
            wrappers.clear()

        for batch in batches:
            for host, html in zip(batch.column("host"), batch.column("html")):
                wrappers.setdefault(host.as_py(), Wrapper()).align(html.as_py() or "")
            if sum(len(w.nodes) + len(w.marks) for w in wrappers.values()) > MOST_NODES:
                yield from rows()
        yield from rows()

    total = [F.sum(c).alias(c) for c in ("pages", "parents", "occurrences", "chars", "linked")]
    return pages.select("host", "html").mapInArrow(run, STATE_SQL).groupBy("host", "node", "mark").agg(
        F.max("parent").alias("parent"), F.max("label").alias("label"), *total, F.min("low").alias("low"), F.max("high").alias("high")
    )


def apart_nodes(nodes: dict) -> set[int]:
    """Nodes that are apart from the main text or below one that is."""
    known: dict[int, bool] = {0: False}
    for node in nodes:
        path = []
        while node not in known:
            path.append(node)
            if nodes[node]["label"].startswith("-"):
                known[node] = True
            else:
                node = nodes[node]["parent"]
        for n in path:
            known[n] = known[node]
    return {n for n, apart in known.items() if apart}


def region_of(nodes: dict, root: int, slots: set[int]) -> int:
    """The deepest node, no single line or cell, that holds over half of the slots' text."""
    weight = dict.fromkeys(nodes, 0)
    for node in slots:
        up, chars = node, nodes[node]["chars"]
        while up in weight:
            weight[up] += chars
            up = nodes[up]["parent"]
    best, children = root, {}
    for node, state in nodes.items():
        if state["label"] not in LEAVES:
            children.setdefault(state["parent"], []).append(node)
    while True:
        heavy = [n for n in children.get(best, ()) if 2 * weight[n] > weight[root]]
        if not heavy:
            return best
        best = heavy[0]


def expression(nodes: dict, marks: set, root: int) -> str:
    """The wrapper as text: ``(..)?`` optional, ``(..)+`` repeated, ``#`` a text slot, ``=`` text that never differs."""
    children: dict[int, dict[str, int]] = {}
    for node, state in nodes.items():
        children.setdefault(state["parent"], {})[state["label"]] = node
    follow: dict[int, dict[str, set]] = {}
    for node, mark in marks:
        if not mark.startswith("#"):
            a, b = mark.split(" ")
            follow.setdefault(node, {}).setdefault(a, set()).add(b)

    def reach(links, start):
        seen, todo = set(), [start]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    done: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        below = children.get(node, {}) if node else {}
        if not ready:
            stack.append((node, True))
            stack += [(n, False) for n in below.values()]
            continue
        links, state = follow.get(node, {}), nodes[node]
        ahead = {a: reach(links, a) for a in below}
        out, left = "", sorted(below, key=lambda a: (-len(ahead[a]), a))
        while left:
            group = [b for b in left if b == left[0] or (b in ahead[left[0]] and left[0] in ahead[b])]
            left = [b for b in left if b not in group]
            texts = []
            for label in group:
                one = done[below[label]]
                lacks = len(group) > 1 or nodes[below[label]]["parents"] < state["occurrences"]
                again = len(group) == 1 and label in links.get(label, ())
                texts.append(f"({one}){'*' if lacks and again else '+' if again else '?'}" if lacks or again else one)
            out += f"({''.join(texts)})+" if len(group) > 1 else texts[0]
        text = "" if not state["chars"] else "=" if state["low"] == state["high"] else "#"
        name = state["label"].lstrip("-")
        done[node] = f"<{name}>{text}{out}</{name}>" if node != root else text + out
    return done[root]


def inferred(states: DataFrame) -> DataFrame:
    """``host, region, template, linked, expression`` of each wrapper; a group is a wrapper's nodes, not a host's pages."""

    def decide(frame):
        import pandas as pd

        host = frame["host"].iloc[0]
        nodes = {int(r["node"]): r for r in frame[frame["mark"].isna()].to_dict("records")}
        for state in nodes.values():
            for c in ("parent", "pages", "parents", "occurrences", "chars", "linked"):
                state[c] = int(state[c])
        marks = {(int(n), m) for n, m in zip(frame["node"], frame["mark"]) if isinstance(m, str)}
        root = next(n for n, s in nodes.items() if s["label"] == "")
        known = sum(m.startswith("#") for _, m in marks) >= VARIANTS
        texts = {n for n, s in nodes.items() if s["chars"]}
        template = {n for n in texts if known and nodes[n]["low"] == nodes[n]["high"]}
        linked = {n for n in texts if 2 * nodes[n]["linked"] > nodes[n]["chars"]}
        region = region_of(nodes, root, texts - template - linked - apart_nodes(nodes))
        template = {n for n in template if nodes[n]["label"] not in KEPT_LEAVES}
        return pd.DataFrame({"host": [host], "region": [region], "template": [sorted(template)], "linked": [sorted(linked)], "expression": [expression(nodes, marks, root)]})

    whole = states.withColumns({c: F.col(c).cast("string") for c in ("parent", "low", "high")})  # no rounding of nullable longs
    return whole.groupBy("host").applyInPandas(decide, "host string, region long, template array<long>, linked array<long>, expression string")


def main_text(html: str, region: int | None, template: set[int], linked: set[int]) -> str:
    """The blocks of a page that are main text by its host's wrapper, in page order."""
    elements, blocks = read(html)
    named = settle(elements)
    kept = []
    if not named:
        reached = {id(e) for e in elements if e.node == region}
        for e in elements:
            if e.parent is not None and id(e.parent) in reached:
                reached.add(id(e))
    for e, text, _ in blocks:
        if e.out or e.node in template:
            continue
        if named:
            keep = e.main and (not e.header or e.tag in HEADINGS)
        else:
            keep = (not reached or id(e) in reached) and not e.header and e.node not in linked
        if keep:
            kept.append(text)
    return " ".join(kept)


def hosted(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, html``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return spread(pages).select("page_id", "url", host.alias("host"), "html")


def wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of each host, as written rows."""
    return written(inferred(aligned(hosted(pages))), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for html, region, template, linked in batches:
            texts = []
            for one, at, fixed, links in zip(html, region, template, linked):
                texts.append(main_text(one.as_py() or "", at.as_py(), set(fixed.as_py() or ()), set(links.as_py() or ())))
            yield pa.array(texts, pa.string())

    # a wrapper is small: Spark broadcasts few of them, and splits a host's pages where there are many
    known = wrappers(pages).drop("expression")
    joined = hosted(pages).join(known, "host", "left")
    text = F.arrow_udf(run, "string").asNondeterministic()("html", "region", "template", "linked")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: Right for pages that have one article with inline tags ``b`` only and four kinds of references, as the given table has;
#: other pages are tested against pages that are built from their text.
SQL = """
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', chr(1), 'g') AS t FROM cut),
decoded AS (
  SELECT page_id, url, replace(replace(regexp_replace(t, '&amp;?', chr(2), 'g'), '&quot;', '"'), chr(2), '&') AS t FROM plain),
joined AS (SELECT page_id, url, trim(regexp_replace(t, '[\\s\x01]+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""

QUERIES = {"op11_html_extraction": op11_html_extraction}
ORACLES = {"op11_html_extraction": SQL}
