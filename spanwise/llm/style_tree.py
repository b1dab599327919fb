"""Main-text extraction by site style trees.

The pages of a host are merged into one tree of style nodes, an element's path of block tags with classes. A node's content
importance is one minus the mean entropy of its sentences (weighed by length) over the host's pages: a sentence that stands on many pages
says nothing about a page, one that stands on one page is its content. A node's presentation importance is the entropy of
its children's arrangement: templates are always alike, articles are not. Hosts with few pages lean on the tree of all
hosts. Text blocks on nodes of low importance are removed from each page; the rest, in page order, is the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored

#: Importance from which a node is kept, weight of the presentation, pages for which the tree of all hosts counts, at most as host pages.
KEEP, PRESENTATION, PRIOR, TRUSTED = 0.7, 0.1, 50, 200
#: Features that a task counts before it passes them on.
COUNTED = 300_000
#: Hashes of repeated pages that are broadcast at most; beyond, pages are shuffled once to meet them.
REPEATED = 500_000

# Fixed values of HTML: elements inside a line, elements whose content is no text, and elements without an end.
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
NO_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option title head button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Fixed words for parts of a page that are never its article: as elements, and as words of a class, an id or a role.
ROLE_TAGS = frozenset("nav footer aside form dialog menu".split())
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav "
    "navbar navigation newsletter notice pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe widget".split())

#: Elements that no name excludes.
FRAMES = frozenset("html body main article".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS, _WORD, _SENTENCE = re.compile(r"\d+"), re.compile(r"[a-z]+"), re.compile(r"(?<=[.!?])\s+")


def blocks_of(page: str):
    """Text blocks in page order as ``(path, text, excluded)``, and the arrangement of children of every block element.

    Unclosed elements end as HTML ends them; inline elements join their text to the block around them; a line break is a
    space. ``excluded`` is set inside elements whose name, class, id or role marks them as no part of an article. A class,
    id or role does not mark a frame of the page, nor, where that would leave no text of a main or article element, an
    element around more than half of the text.
    """
    blocks, children, stack, held, marked = [], [], [("", False, [], ())], [], 0

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((stack[-1][0], text, stack[-1][1], stack[-1][3], "main" in names or "article" in names))

    def pop(to: int):
        while len(stack) > to:
            path, _, inside, _ = stack.pop()
            children.append((path, inside))
            names.pop()

    def say(text: str):
        if text.strip():
            leave_head()
        held.append(text)

    def leave_head():
        if "head" in names:
            held.clear()
            pop(names.index("head"))

    names, at, end = [""], 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            say(html.unescape(page[at:]))
            break
        if found.start() > at:
            say(html.unescape(page[at:found.start()]))
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            if name in INLINE:
                continue
            if name in names:
                flush()
                pop(len(names) - 1 - names[::-1].index(name))
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name not in VOID or name in ("hr", "img"):
            leave_head()
        if name in INLINE or name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        if name in _ENDS_P and names[-1] == "p":
            pop(len(names) - 1)
        if name in CLOSES:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in CLOSES[name]:
                    pop(i)
                    break
                if names[i] in ("ul", "ol", "dl", "table", "select"):
                    break
        given = [a or b or c for _, a, b, c in _NAMES.findall(found.group(3))] if found.group(3) else []
        style = _DIGITS.sub("0", f"{name}.{'.'.join(given)}".lower()) if given else name
        parent, out, inside, marks = stack[-1]
        inside.append(style)
        out = out or name in ROLE_TAGS or name in NO_TEXT or (name == "header" and "article" not in names)
        if name not in FRAMES and any(w in ROLE_WORDS for g in given for w in _WORD.findall(g.lower())):
            marked += 1
            marks = (*marks, marked)
        names.append(name)
        stack.append((f"{parent}/{style}", out, [], marks))
    flush()
    pop(1)
    sizes = Counter()
    framed = any(inside and not out and not marks for _, _, out, marks, inside in blocks)
    for _, text, out, marks, _ in blocks:
        if not out:
            sizes.update(dict.fromkeys((0, *marks), len(text)))
    return [(path, text, out or any(framed or 2 * sizes[m] <= sizes[0] for m in marks)) for path, text, out, marks, _ in blocks], children


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def style_trees(pages: DataFrame, host: str, page: str) -> DataFrame:
    """``(host, node, importance)`` of every style node, by its hashed path, of every host. Copies of a page count as one page."""

    def count(batches):
        seen = Counter()

        def give():
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()),
                pa.array([k[3] for k in keys], pa.int64()), pa.array([k[4] for k in keys], pa.int32()),
                pa.array(list(seen.values()), pa.float64())], ["host", "node", "kind", "feature", "size", "n"])
            seen.clear()

        for batch in batches:
            for own, text, share in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                blocks, children = blocks_of(text.as_py() or "")
                paths = {p for p, _, _ in blocks}
                number = {p: _number(p) for p in paths}
                for p in paths:  # pages that have the node
                    seen[own, number[p], 0, 0, 1] += share
                for p, t, _ in blocks:
                    for sentence in _SENTENCE.split(t):
                        seen[own, number[p], 1, _number(sentence), len(sentence)] += share
                above = {p: p.rpartition("/")[0] for p in paths}
                inside = {p: " ".join(c) for p, c in children}
                for p in paths:  # the parent's children
                    seen[own, number[p], 2, _number(inside.get(above[p], "")), 1] += share
                if len(seen) > COUNTED:
                    yield from give()
        yield from give()

    # copies of a page are found on hashes alone and share one page's weight; only the hashes of repeated pages are joined back
    hashed = pages.select(F.col(host).alias("host"), F.xxhash64(page).alias("same"), F.col(page).alias("page"))
    again = stored(hashed.groupBy("host", "same").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumnRenamed("host", "at"), "style-copies")
    shared = hashed.join(broadcast_checked(again, REPEATED), (F.col("host") == F.col("at")) & (hashed.same == again.same), "left")
    counted = stored(shared.select("host", "page", (1.0 / F.coalesce("copies", F.lit(1))).alias("share")).mapInArrow(
        count, "host string, node long, kind int, feature long, size int, n double").groupBy(
        "host", "node", "kind", "feature", "size").agg(F.sum("n").alias("n")), "style-counts")

    def measures(rows: DataFrame, *by: str) -> DataFrame:
        """Pages of a node and the entropies of its sentences (each over pages) and of its parent's children."""
        n = F.greatest(F.col("n"), F.lit(1.0))  # shares of one page may sum to a little less
        part = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
        sums = rows.groupBy(*by).agg(part(0, n).alias("m"), part(1, n * F.col("size")).alias("t"), part(1, n * F.col("size") * F.ln(n)).alias("s"),
                                     part(2, n).alias("u"), part(2, n * F.ln(n)).alias("w"))
        base = F.ln(F.greatest(F.col("m"), F.lit(2.0)))
        content = 1 - F.least(F.lit(1.0), F.col("s") / F.col("t") / base)
        shown = F.least(F.lit(1.0), (F.ln("u") - F.col("w") / F.col("u")) / base)
        return sums.select(*by, "m", ((1 - PRESENTATION) * content + PRESENTATION * shown).alias("importance"))

    own = measures(counted, "host", "node")
    everywhere = measures(counted.groupBy("node", "kind", "feature", "size").agg(F.sum("n").alias("n")), "node").select(
        F.col("node").alias("of"), F.col("importance").alias("general"), F.col("m").alias("pages"))
    trust, prior = F.least("m", F.lit(float(TRUSTED))), F.least(F.col("pages"), F.lit(float(PRIOR)))
    return own.join(everywhere, own.node == everywhere.of).select(
        "host", "node", ((F.col("importance") * trust + F.col("general") * prior) / (trust + prior)).alias("importance"))


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", keep: float = KEEP) -> DataFrame:
    """``(key, url, text, n_chars)`` per row of ``pages``: the article's text, empty if there is none.

    Character references are decoded, white space becomes one space, blocks are joined by one space. A null page is empty;
    pages without a url form one host; repeated rows are returned repeatedly; an empty table gives no rows. Only the three
    columns named are read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    name = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_page"), name.alias("_host"))
    trees = style_trees(rows, "_host", "_page").groupBy("host").agg(  # the style nodes of one site
        F.collect_list("node").alias("nodes"), F.collect_list("importance").alias("importance"))
    met = rows.join(broadcast_checked(stored(trees, "style-trees")), F.col("_host") == F.col("host"), "left")  # a host may have no text at all

    def run(batches):
        for batch in batches:
            texts, last, tree = [], None, {}
            for own, nodes, values, value in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(2)):
                if own != last:
                    tree, last = dict(zip(nodes.as_py() or (), values.as_py() or ())), own
                blocks, _ = blocks_of(value.as_py() or "")
                texts.append(" ".join(t for p, t, out in blocks if not out and tree[_number(p)] >= keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(np.array([len(t) for t in texts], np.int64))], [key, url, "text", "n_chars"])

    return met.select("_key", "_url", "_page", "_host", "nodes", "importance").mapInArrow(
        run, f"{key} {kinds[0]}, {url} {kinds[1]}, text string, n_chars long")
