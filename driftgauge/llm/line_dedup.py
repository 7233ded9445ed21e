"""Operator 1: boilerplate lines by the spread of sites they appear on.

Each line is hashed after trimming; a HyperLogLog sketch of its sites is built per line hash and merged by partial
aggregation, so a line of a third of all rows costs a few kilobytes a task. The sketch's estimate decides lines that are
clearly below or above ``least_sites``; lines within the sketch's error of the threshold get an exact distinct count. A
line on at least ``least_sites`` sites is boilerplate: its first occurrence (smallest id, then text, then line number)
stays, all others are removed from their documents. What stays once keeps texts that were copied to many sites from
vanishing altogether.

Nulls: a null text is an empty one and stays null-free; a null site is no site; a null id sorts after all others. Blank
lines are never removed, nor are lines of fewer than ``least_words`` words where a caller sets that above one. Repeated rows are kept; their lines are cleaned
alike. Extra columns pass through whatever their names. An empty table gives an empty table. Lines are compared by a
64-bit hash of the whole trimmed line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, written

LEAST_SITES = 10
SKETCH_BITS = 12  # 2^12 registers: a relative standard error of 1.6 %
SPACES = r"[ \t\x0B\f\r]+"


def line_table(docs: DataFrame, text: str, site: str, least_words: int) -> DataFrame:
    """doc_id, text_hash, site, number and hash of every line that may be boilerplate."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole).alias("text_hash"),
        F.col(f"`{site}`").cast("string").alias("site"),
        F.posexplode(F.split(whole, "\n")).alias("number", "line"),
    ).withColumn("line", F.trim(F.regexp_replace("line", SPACES, " ")))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" ")))
    return lines.where((F.length("line") > 0) & (spaces + 1 >= least_words)).select(
        "doc_id", "text_hash", "site", "number", F.xxhash64("line").alias("line_hash")
    )


def wide_spread(lines: DataFrame, least_sites: int = LEAST_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """line_hash, ``first`` occurrence and number of sites (estimate or exact) of lines on at least ``least_sites``."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "number")
    spread = lines.groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_bits))).alias("estimate"),
        F.min(place).alias("first"),
    )
    margin = 1 + 3 * 1.04 / 2 ** (sketch_bits / 2) * least_sites
    spread = written(spread.where(F.col("estimate") >= least_sites - margin), "line-spread")
    near = F.abs(F.col("estimate") - least_sites) <= margin
    exact = (
        lines.join(spread.where(near).select("line_hash"), "line_hash", "left_semi")
        .groupBy("line_hash", "site")
        .agg(F.count("*").alias("n"))
        .groupBy("line_hash")
        .agg(F.count("site").alias("exact"))
    )
    counted = spread.join(exact, "line_hash", "left").withColumn("sites", F.coalesce("exact", "estimate"))
    return counted.where(F.col("sites") >= least_sites).select("line_hash", "first", "sites")


def removals(docs: DataFrame, text: str, site: str, least_sites: int, least_words: int) -> DataFrame:
    """doc_id, text_hash and the numbers of the lines to remove, for documents that lose any."""
    lines = written(line_table(docs, text, site, least_words), "lines")
    spread = written(wide_spread(lines, least_sites), "wide-spread")
    first = F.col("first")
    is_first = (
        F.col("doc_id").eqNullSafe(first["doc_id"])
        & (F.col("text_hash") == first["text_hash"])
        & (F.col("number") == first["number"])
    )
    return (
        lines.join(spread, "line_hash")
        .where(~is_first)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("number").alias("removed"))  # at most the lines of one text
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "own_text"):
        texts, counts = [], []
        for text, removed in zip(block.column("own_text").to_pylist(), block.column("removed").to_pylist(), strict=True):
            lines = text.split("\n")
            gone = set(removed or ())
            texts.append("\n".join([line for i, line in enumerate(lines) if i not in gone]) if gone else text)
            counts.append((len(lines), len(gone)))
        n_lines, n_removed = zip(*counts, strict=True)
        names = [n for n in block.schema.names if n not in ("own_text", "removed")]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(n) for n in names), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())],
            names=[*names, "own_text", "own_lines", "own_removed"],
        )


def without_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    least_sites: int = LEAST_SITES,
    least_words: int = 1,
    extra: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; a column ``n_chars`` is kept in step.

    ``extra`` names two more columns: the lines a text had and the lines it lost.
    """
    gone = removals(docs, text, site, least_sites, least_words).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed"
    )
    names = docs.columns
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text],
        whole.alias("own_text"),
        F.xxhash64(whole).alias("own_hash"),
    )
    id_column = F.col(f"c{names.index('doc_id')}").cast("long")
    joined = rows.join(gone, id_column.eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left")
    joined = joined.drop("gone_id", "gone_hash", "own_hash")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("own_text", "removed"))
    cleaned = joined.mapInArrow(_without, f"{kept + ', ' if kept else ''}own_text string, own_lines long, own_removed long")

    def column(i: int, name: str) -> Column:
        if name == text:
            return F.col("own_text").alias(name)
        if name == "n_chars":
            return F.length("own_text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"c{i}").alias(name)

    more = [] if extra is None else [F.col("own_lines").alias(extra[0]), F.col("own_removed").alias(extra[1])]
    return cleaned.select(*[column(i, c) for i, c in enumerate(names)], *more)
