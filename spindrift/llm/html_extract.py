"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes (the path of block elements with their classes). A node shows, on each
page, a sequence of child elements (its presentation) and texts (its contents). Where the sequences differ from page to page their
entropy is high, and so it is with the texts. A branch whose presentation, at its best node, is far below that of its best sibling is
a menu, footer or advert beside the article; one whose contents repeat, while a sibling's differ, is a notice. Both are cut, with
what the element or class says to be navigation, adverts, forms and the like, which the tree cannot always tell.
"""

from __future__ import annotations

import collections
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .flatbytes import pieces

#: A branch goes below this share of its best sibling's presentation; and below this share of its contents' entropy.
FORM, WORDS = 0.5, 0.2
#: The pool of all hosts weighs as much in a node's entropy as so many showings of its own; entropy 1 weighs so many in the pool.
PRIOR, UNSEEN = 16, 2
#: Bytes of cuts that are sent to the tasks.
LOOKUP = 64 << 20

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
_VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
_CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
_NOISE = frozenset("head nav footer aside form button dialog menu fieldset object".split())
_NAMES = (
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|popup|modal|side-?bar|nav\w*|menus?|breadcrumbs?"
    r"|footer|share|sharing|social|related|recommend\w*|comments?|repl(?:y|ies)|disqus|newsletter|subscribe|sign-?up|login|widgets?"
    r"|pagination|pager|toolbar|skip|navigation|contentinfo|complementary|search)"
)
_NOISE_NAME = re.compile(rf"(?:^|[\s_-]){_NAMES}(?:$|[\s_-])", re.I)
#: Inside an article the class must be such a name or a box of it: related-posts goes, related-work and market-share are the article's.
_BOXES = r"(?:[\s_-](?:list|items?|box|block|bar|area|section|container|wrap(?:per)?|inner|body|threads?|posts?|articles?|links?|buttons?|form|\d+))*"
_NOISE_INSIDE = re.compile(rf"(?:^|\s){_NAMES}{_BOXES}(?:$|\s)", re.I)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:main|article|post-?(?:body|content)|entry-?content|article-?body)(?:$|[\s_-])", re.I)

#: What parsing adds to a page's page_id and url.
_PARSED = (
    "host string, key string, at array<int>, texts array<string>, paths array<string>, noise array<boolean>, "
    "nodes array<struct<path: string, main: int, kind: string, value: bigint, n: bigint>>"
)


def blocks(page: str) -> tuple[list[tuple[str, bool, str]], list[tuple[str, int, str]]]:
    """The page's blocks in order as (path, noise, text), and its elements as (path, main, child elements).

    ``main`` is 2 below an article or main element, 1 at the outermost one, else 0.

    Inline elements belong to their block; br is white space. Unclosed elements end where their parent does, and p, li, cells and
    the like also where the next begins.
    """
    found: list[tuple[str, bool, str]] = []
    styles: list[tuple[str, int, str]] = []
    stack: list[list] = [["", False, 0, [], ""]]  # path, noise, main, children, tag
    text: list[str] = []

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                found.append((stack[-1][0], stack[-1][1], said))

    def close() -> None:
        path, _, main, children, _ = stack.pop()
        styles.append((path, main, " ".join(children)))

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, ending = name.lower(), bool(m[2] or m[5])
        if name in _INLINE:
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        if name in _VOID:
            continue
        if ending:
            if any(x[4] == name for x in stack):
                while stack[-1][4] != name:
                    close()
                close()
            continue
        if stack[-1][4] == "p" or name in _CLOSES_ITSELF and stack[-1][4] == name or name in ("td", "th") and stack[-1][4] in ("td", "th"):
            close()
        names = " ".join(a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer((m[4] or m[7]) or ""))
        label = f"{name}.{'.'.join(names.lower().split()[:2])}" if names else name
        path, noise, main, children, _ = stack[-1]
        children.append(label)
        called = name in ("article", "main") or bool(names and _MAIN_NAME.search(names))
        inside = 2 if main else int(called)
        whole = name in ("html", "body", "main") or name == "article" and bool(_MAIN_NAME.search(names))
        noise = noise or name in _NOISE or bool(names and (_NOISE_INSIDE if main else _NOISE_NAME).search(names) and not whole)
        noise = noise or not main and (name == "header" or bool(names and _HEADER_NAME.search(names) and name not in ("html", "body")))
        stack.append([f"{path}/{label}", noise, inside, [], name])
    if at < len(page):
        text.append(page[at:])
    flush()
    while stack:
        close()
    return found, styles


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, key, at, texts, paths, noise, nodes) of each page, parsed once: text i of the page stands at ``paths[at[i]]``.

    ``paths`` are the page's different paths with text, in order; ``noise`` marks the texts that a name cuts. ``nodes`` are the counts of
    what the page shows: structs of path, main, kind (P presentation, C contents), value (a hash) and n. ``key`` is equal for equal rows.
    """
    given = {f.name: f.dataType.simpleString() for f in pages.schema if f.name in ("page_id", "url")}
    names = ["page_id", "url", "host", "key", "at", "texts", "paths", "noise", "nodes"]
    node = pa.struct([("path", pa.string()), ("main", pa.int32()), ("kind", pa.string()), ("value", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            rows: list[tuple] = []
            for page in batch.column("html").to_pylist():
                found, styles = blocks(page or "")
                shown = collections.Counter((path, main, "P", hash_text(children)) for path, main, children in styles)
                shown.update((path, 0, "C", hash_text(said)) for path, _, said in found)
                places = {path: i for i, path in enumerate(dict.fromkeys(b[0] for b in found))}
                nodes = [dict(path=p, main=m, kind=k, value=v, n=n) for (p, m, k, v), n in shown.items()]
                rows.append(([places[b[0]] for b in found], [b[2] for b in found], list(places), [b[1] for b in found], nodes))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(node))
            columns = [batch.column(c) for c in ("page_id", "url", "host", "key")]
            columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    page = F.col("html").cast("string")
    same = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (F.col("page_id").cast("string"), F.col("url").cast("string"), page)]
    rows = pages.select("page_id", "url", host.alias("host"), F.md5(F.concat_ws("\x1f", *same)).alias("key"), page.alias("html"))
    return rows.mapInArrow(run, f"page_id {given['page_id']}, url {given['url']}, {_PARSED}")


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, form, own, words, holds, inside) of each style node of the ``parsed`` pages.

    The entropy of a node's m showings is -sum p log_m p over the different values it shows. That of its path on all hosts weighs as
    ``PRIOR`` showings, and within it entropy 1 as ``UNSEEN``, so few showings tell little. ``own`` is the entropy of the node's
    sequences of children, ``form`` the largest ``own`` at or below it, ``words`` the mean entropy of the texts at and below it (null
    if none). ``holds`` says that an article or main element is at or below the node, ``inside`` that the node is below one.
    Counts are summed up before they are shuffled, so a host with very many pages costs few rows.
    """
    shown = pages.select("host", F.explode("nodes").alias("s")).select("host", "s.*")
    shown = materialize(shown.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"), F.max("main").alias("main")), "style-trees")
    nodes = shown.groupBy("host", "path", "kind").agg(*_entropy(), F.max("main").alias("main"))
    pool = shown.groupBy("path", "kind", "value").agg(F.sum("n").alias("n")).groupBy("path", "kind").agg(*_entropy())
    pool = pool.select("path", "kind", (((F.col("m") - 1) * F.col("h") + UNSEEN) / (F.col("m") - 1 + UNSEEN)).alias("pool"))
    shrunk = ((F.col("m") - 1) * F.col("h") + PRIOR * F.col("pool")) / (F.col("m") - 1 + PRIOR)
    nodes = nodes.join(pool, ["path", "kind"]).withColumn("h", shrunk)
    form, words = F.when(F.col("kind") == "P", F.col("h")), F.when(F.col("kind") == "C", F.col("h") * F.col("m"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    here = F.col("node") == F.col("path")
    trees = nodes.withColumn("node", F.explode(above)).groupBy("host", F.col("node").alias("path")).agg(
        F.max(form).alias("form"),
        F.coalesce(F.max(F.when(here, form)), F.lit(0.0)).alias("own"),
        (F.sum(words) / F.sum(F.when(F.col("kind") == "C", F.col("m")))).alias("words"),
        (F.max("main") > 0).alias("holds"),
        F.coalesce(F.max(F.when(here, F.col("main"))) == 2, F.lit(False)).alias("inside"),
    )
    return trees.withColumn("form", F.coalesce("form", F.lit(0.0)))


def low_branches(trees: DataFrame) -> DataFrame:
    """(host, path, why) of the branches that the tree cuts; why is form or words.

    Form: the branch shows less than ``FORM`` of its best sibling's. A parent whose own sequences reach that share holds running
    text itself, so its parts (headings, notes) aren't judged by form; nor is what lies in an article or holds one. Words: the texts
    have less than ``WORDS`` of the entropy of its best sibling's; an article itself is no such notice, what is in it can be.
    """
    named = trees.where("path <> ''").withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    best = named.groupBy("host", "parent").agg(F.max("form").alias("best_form"), F.max("words").alias("best_words"))
    best = best.join(trees.select("host", F.col("path").alias("parent"), F.col("own").alias("above")), ["host", "parent"])
    judged = named.join(best, ["host", "parent"])
    form = (F.col("above") < FORM * F.col("best_form")) & (F.col("form") < FORM * F.col("best_form")) & ~F.col("holds") & ~F.col("inside")
    words = (F.col("words") < WORDS * F.col("best_words")) & (F.col("inside") | ~F.col("holds"))
    return judged.select("host", "path", F.when(words, "words").when(form, "form").alias("why")).where("why is not null")


def _entropy() -> tuple[Column, Column]:
    """Entropy h and showings m of a node from the counts n of what it shows; 1 for a single showing."""
    spread = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return F.when(F.sum("n") > 1, spread / F.log(F.sum("n"))).otherwise(1.0).alias("h"), F.sum("n").alias("m")


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def with_cuts(pages: DataFrame, low: DataFrame) -> DataFrame:
    """The ``parsed`` pages with ``cut``: the indexes of their paths that lie at or below a low branch of their host, null if none do.

    Pages of a host with equal paths are looked up once. Up to ``LOOKUP`` bytes the cuts are sent to the pages' tasks, so that no text
    is shuffled; beyond that only keys and indexes meet by host, and texts by the page's key, so no large host meets in one task.
    """
    pages = pages.withColumn("layout", F.xxhash64(F.array_join("paths", "\n")))
    layouts = pages.select("host", "layout", "paths").distinct().select("host", "layout", F.posexplode("paths").alias("at", "path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    layouts = layouts.where("path <> ''").select("host", "layout", "at", F.explode(above).alias("path"))
    cuts = layouts.join(low, ["host", "path"]).groupBy("host", "layout").agg(F.collect_set("at").alias("cut"))
    cuts = materialize(cuts, "pages-cuts")
    size = cuts.agg(F.sum(64 + F.length("host") + 4 * F.size("cut"))).first()[0] or 0
    if size <= LOOKUP:
        return pages.join(F.broadcast(cuts), ["host", "layout"], "left")
    keys = pages.select("key", "host", "layout").distinct().join(cuts, ["host", "layout"]).select("key", "cut")
    return pages.join(keys, "key", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; further columns are not read).

    A null or empty page has the empty text. The host is the url's authority; pages without a url are one host. The blocks outside
    the style tree's low branches and outside named noise are the text; a page of which all the other blocks are in low branches
    keeps them. Repeated rows stay repeated.
    """
    pages = materialize(parsed(pages), "pages-parsed")  # each of the branches below would parse all pages again
    pages = with_cuts(pages, low_branches(style_trees(pages)).select("host", "path"))
    blocks_ = F.filter(F.arrays_zip("at", "texts", "noise"), lambda b: ~b["noise"])
    kept = F.when(F.col("cut").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("cut", b["at"])))
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    rows = pages.select("page_id", "url", "cut", blocks_.alias("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
