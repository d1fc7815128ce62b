"""Sections to chunks. A document's sections stay in its row, so chunking needs no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count

_CHUNKS = "array<struct<start:int,n:int,tokens:int>>"


def _pack(limit: int, overshoot: bool):
    @F.pandas_udf(_CHUNKS)
    def pack(sizes: pd.Series, alone: pd.Series) -> pd.Series:
        rows = []
        for row, flags in zip(sizes, alone, strict=True):
            chunks: list[list[int]] = []
            closed = False
            for i, n in enumerate(row if row is not None else ()):
                single = bool(len(flags)) and bool(flags[i])
                full = chunks and (chunks[-1][2] > limit if overshoot else chunks[-1][2] + n > limit)
                if not chunks or full or single or closed:
                    chunks.append([i, 1, int(n)])
                else:
                    chunks[-1][1] += 1
                    chunks[-1][2] += int(n)
                closed = single
            rows.append([{"start": a, "n": b, "tokens": c} for a, b, c in chunks])
        return pd.Series(rows)

    return pack


def _content(sections: str | Column, chunk: Column) -> Column:
    return F.array_join(F.slice(sections, chunk["start"] + 1, chunk["n"]), "")


def merge_sections(docs: DataFrame, sections: str, limit: int = 128, overshoot: bool = False, alone: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per chunk: the columns of ``docs`` but ``sections``, with chunk_no, tokens and content.

    Sections are joined without a separator. A new chunk begins if the last one and the section together exceed ``limit`` tokens;
    with ``overshoot``, if the last one alone does. A section for which ``alone`` holds is a chunk of its own.
    """
    sized = docs.withColumn("_sizes", F.transform(sections, lambda s: token_count(s).cast("int")))
    flags = F.transform(sections, lambda s: F.coalesce(alone(s), F.lit(False))) if alone else F.array().cast("array<boolean>")
    packed = sized.withColumn("_chunks", _pack(limit, overshoot)("_sizes", flags))
    keep = [c for c in docs.columns if c != sections]
    out = packed.select(*keep, sections, F.posexplode("_chunks").alias("chunk_no", "_c"))
    return out.select(*keep, "chunk_no", F.col("_c.tokens").alias("tokens"), _content(sections, F.col("_c")).alias("content"))


def chunk_by_method(docs: DataFrame, method: str, text: str, limit: int = 128) -> DataFrame:
    """One row per chunk: the columns of ``docs`` but ``text``, with chunk_no and content, by the method that each row names.

    "one" keeps a text whole, "lines" takes its non-blank lines, any other name packs its lines to ``limit`` tokens. One pass.
    """
    whole, by_line = F.col(method).eqNullSafe("one"), F.col(method).eqNullSafe("lines")
    lines = docs.withColumn("_lines", delimited(F.col(text), "\n"))
    sizes = F.when(~whole & ~by_line, F.transform("_lines", lambda s: token_count(s).cast("int")))
    packed = lines.withColumn("_chunks", _pack(limit, False)(sizes, F.array().cast("array<boolean>")))
    pieces = F.when(whole, F.array(text)).when(by_line, F.col("_lines")).otherwise(F.transform("_chunks", lambda c: _content("_lines", c)))
    return packed.select(*[c for c in docs.columns if c != text], F.posexplode(pieces).alias("chunk_no", "content"))


# Headings of tables of contents and the like, without spaces; they are told in lower case only.
CONTENTS = ("contents", "目录", "目次", "致谢", "acknowledge")


def drop_contents(lines: list[str], english: bool = False, reach: int = 128) -> list[str]:
    """The lines without tables of contents: a heading, and what follows until the first entry's beginning returns within ``reach`` lines.

    An entry begins with its first three characters, in English with its first two words. If none returns, heading and entry go.
    """
    begin = lambda s: " ".join(s.split()[:2]) if english else s.strip()[:3]
    kept, i = [], 0
    while i < len(lines):
        if re.sub(r"[ \u3000]+", "", lines[i].split("@@")[0].strip()) not in CONTENTS:
            kept.append(lines[i])
            i += 1
            continue
        entries = [j for j in range(i + 1, len(lines)) if begin(lines[j])]
        if not entries:
            break
        entry, i = begin(lines[entries[0]]), entries[0] + 1
        i = next((j for j in range(i, min(i + reach, len(lines))) if lines[j].strip().startswith(entry)), i)
    return kept


def without_contents(lines: Column, english: bool = False) -> Column:
    """``drop_contents`` of an array of lines; null stays null."""

    @F.pandas_udf("array<string>")
    def drop(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else drop_contents([x or "" for x in r], english) for r in rows], dtype=object)

    return drop(lines)


def delimited(text: Column, delimiters: str = "\n!?;") -> Column:
    """The non-blank pieces of a text between delimiters; a delimiter in back quotes may have several characters."""
    whole = re.findall(r"`([^`]+)`", delimiters)
    single = re.sub(r"`[^`]+`", "", delimiters)
    pattern = "|".join(re.escape(d) for d in [*sorted(whole, key=len, reverse=True), *single])
    return F.filter(F.split(text, pattern), lambda s: F.trim(s) != "")


def table_blocks(rows: DataFrame, keys: list[str], order: str, text: str, batch: int = 10, separator: str = "; ") -> DataFrame:
    """(keys..., block, content): rows of a table joined ``batch`` at a time by their place ``order`` (from 0)."""
    blocks = rows.groupBy(*keys, F.floor(F.col(order) / batch).cast("int").alias("block"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    return blocks.agg(F.array_join(lines, separator).alias("content"))


#: Families of heading marks, each from the coarsest level to the finest, and what looks like a mark and is none.
BULLETS = (
    (
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ),
    (
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ),
    (
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ),
    (r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"Chapter (I+V?|VI*|XI|IX|X)", r"Section [0-9]+", r"Article [0-9]+"),
)
NO_BULLETS = (r"0", r"[0-9]+ +[0-9~个只-]", r"[0-9]+\.{2,}")


def begins_with(patterns: tuple[str, ...]) -> str:
    """A pattern for any of the patterns at the start, for either engine."""
    return f"^(?:{'|'.join(patterns)})"


def bullet_family(sections: Column) -> Column:
    """The family of heading marks that most sections bear, from 0, the first of the largest; -1 if none does."""
    votes = [F.size(F.filter(sections, lambda s: s.rlike(begins_with(f)) & ~s.rlike(begins_with(NO_BULLETS)))) for f in BULLETS]  # noqa: B023
    best = F.greatest(*votes)
    pick = F.when(best <= 0, -1)
    for i, v in enumerate(votes):
        pick = pick.when(v == best, i)
    return F.coalesce(pick, F.lit(-1)).cast("int")


def bullet_level(section: Column, family: Column) -> Column:
    """The level of a section's heading mark in its document's family, from 0; two more than the finest if it bears none."""
    mark, level = F.trim(section), None
    for f, patterns in enumerate(BULLETS):
        for i, pattern in enumerate(patterns):
            hit = (family == f) & mark.rlike(begins_with((pattern,))) & ~section.rlike(begins_with(NO_BULLETS))
            level = F.when(hit, i) if level is None else level.when(hit, i)
    sizes = F.get(F.array(*(F.lit(len(f)) for f in BULLETS)), F.greatest(family, F.lit(0)))
    return level.otherwise(sizes + 1).cast("int")


def column_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, votes): the type that most non-empty values of each column look like; ties go to the first of the list."""
    kinds = (
        ("int", r"^[+-]?[0-9]{1,18}$"),
        ("float", r"^[+-]?[0-9]*\.[0-9]+$"),
        ("bool", r"(?i)^(true|false|yes|no)$"),
        ("datetime", r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"),
    )
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x"))
    long = long.select("x.column", F.trim("x.v").alias("v")).where("v <> ''")
    kind = None
    for name, pattern in kinds:
        kind = F.when(F.col("v").rlike(pattern), name) if kind is None else kind.when(F.col("v").rlike(pattern), name)
    votes = long.withColumn("kind", kind.otherwise("text")).groupBy("column", "kind").agg(F.count(F.lit(1)).alias("votes"))
    place = F.array_position(F.array(*(F.lit(k) for k, _ in kinds), F.lit("text")), F.col("kind"))
    best = F.max_by(F.struct("kind", "votes"), F.struct("votes", -place))
    return votes.groupBy("column").agg(best.alias("b")).select("column", "b.kind", "b.votes")


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number stretches of rows from 0: a row where ``starts`` holds begins the next."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("int"))
