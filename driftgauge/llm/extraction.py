"""Operator 2: main text of web pages by wrapper induction.

Every page becomes a tree of its block elements. The pages of a host are told apart by their frame (the labels below the
body), and each frame of a host has one reference page, the page with the smallest hash that is not empty. All pages of
the frame are aligned with it by simple tree matching, which tells for each block which *slot* of the template it fills;
a block that fills none is known by its path below the nearest block that does. Labels are the tag and those class words
that hold no digit. Over all pages of a frame each slot is judged:

* one text on nearly all different pages makes it a constant node, part of the template;
* blocks of one label below one slot, outside the article, are a menu if nearly all their text lies in links, on many
  pages, whatever they are called.

Both are dropped. Slots with varying text are content, unless their markup says otherwise: menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by element, role, class and id, which
works on a page that has no siblings too, and where such blocks vary from page to page. If content is found inside the
page's article or main element, only that counts.

Copies of a page count once, so a copied article does not look like a template; below ``least_pages`` different pages
a template is not induced.

Nulls: a null page is an empty one and its text is empty; a null or unreadable address shares one host of its own;
null ids are kept. Repeated rows are all returned. Only the named columns are read. An empty table gives an empty table.
White space includes every character that Unicode counts as such. Matching two pages takes time by the product of their
sibling counts and memory by their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, written
from driftgauge.llm.page_tree import Reference, is_empty, layout, numbered, parse, texts

LEAST_PAGES = 5
CONSTANT_SHARE = 0.8
LINK_SHARE = 0.8
MENU_CHARS = 200  # a menu's entries are shorter on average
BROADCAST_BYTES = 32 << 20  # of reference pages
BROADCAST_ROWS = 500_000  # of pairs of numbers
_BLOCKS = pa.list_(pa.struct([("slot", pa.int32()), ("kin", pa.int32()), ("excluded", pa.bool_()), ("region", pa.bool_()), ("text", pa.string()), ("linked", pa.int32())]))


@lru_cache(maxsize=256)
def _reference(source: str) -> Reference:
    return Reference(numbered(parse(source)))


def page_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "html"):
        found = [(layout(page), is_empty(page)) for page in map(parse, texts_of(batch, "html").to_pylist())]
        columns = [pa.array([f for f, _ in found], pa.int64()), pa.array([e for _, e in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "frame", "empty"])


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "html"):
        rows = []
        for source, model in zip(texts_of(batch, "html").to_pylist(), texts_of(batch, "reference").to_pylist(), strict=True):
            page = parse(source)
            if model:  # a page that is empty itself has no reference
                _reference(model).align(page)
            rows.append([dict(zip(("slot", "kin", "excluded", "region", "text", "linked"), t, strict=True)) for t in texts(page)])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url", "host", "content")), pa.array(rows, _BLOCKS)],
            names=["page_id", "url", "host", "content", "blocks"],
        )


def aligned_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host (its frame included), content (hash of the page) and the blocks of every page, aligned."""
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.xxhash64(F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))).alias("host"),
        F.xxhash64(source).alias("content"),
        source.alias("html"),
    )
    # Parsed here and again below: a second look costs less than moving the pages.
    framed = rows.mapInArrow(page_frames, "page_id long, url string, host long, content long, html string, frame long, empty boolean")
    in_frame = F.xxhash64("host", "frame")
    # The reference is the page with the smallest hash: any page will do, if only all tasks choose the same.
    chosen = framed.where("not empty").groupBy("host", "frame").agg(F.min("content").alias("content"))
    chosen = written(chosen.select("host", "content", in_frame.alias("model_host")), "chosen-pages")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    models = rows.join(chosen, ["host", "content"]).groupBy("model_host").agg(F.min("html").alias("reference"))
    rows = framed.withColumn("host", in_frame)
    models = written(models, "page-models")
    if (models.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= BROADCAST_BYTES:
        models = F.broadcast(models)
    joined = rows.join(models, F.col("host") == F.col("model_host"), "left").drop("model_host")
    return joined.mapInArrow(
        block_rows,
        "page_id long, url string, host long, content long, "
        "blocks array<struct<slot:int,kin:int,excluded:boolean,region:boolean,text:string,linked:int>>",
    )


def constant_slots(pages: DataFrame, least_pages: int, constant_share: float) -> DataFrame:
    """host and ``constants``: slots with the hash of their constant text, and kin that are menus (with a null hash)."""
    many = pages.groupBy("host").agg(F.count_distinct("content").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    many = written(many, "page-hosts")
    if many.count() <= BROADCAST_ROWS:  # then only nodes that pass are brought together by host
        many = F.broadcast(many)
    fills = pages.select("host", "content", F.explode("blocks").alias("b")).where("not b.excluded")
    shown = (
        fills.select("host", "content", "b.slot", F.xxhash64("b.text").alias("text_hash"))
        .distinct()
        .groupBy("host", "slot", "text_hash")
        .agg(F.count("*").alias("n"))
        .where("n >= 2")
    )
    shared = shown.join(many, "host").where(F.col("n") >= constant_share * F.col("n_pages")).select("host", "slot", "text_hash")
    length = F.length("b.text")
    linked = fills.where("not b.region").groupBy("host", "b.kin").agg(
        F.avg(length).alias("length"), (F.sum("b.linked") / F.sum(length)).alias("share"), F.approx_count_distinct("content").alias("n")
    )
    # a text hash of null stands for every text of the kin
    menus = linked.where((F.col("share") >= LINK_SHARE) & (F.col("length") < MENU_CHARS) & (F.col("n") >= least_pages)).join(many, "host")
    menus = menus.select("host", F.col("kin").alias("slot"), F.lit(None).cast("long").alias("text_hash"))
    # At most one text a slot and one menu a kin, so the set is bounded by the slots of a frame.
    return shared.unionByName(menus).groupBy("host").agg(F.collect_set(F.struct("slot", "text_hash")).alias("constants"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page of ``pages`` (``page_id``, ``url``, ``html``)."""
    found = written(aligned_blocks(pages), "page-blocks")
    constants = written(constant_slots(found, least_pages, constant_share), "page-constants").withColumnRenamed("host", "constant_host")
    if (constants.agg(F.sum(F.size("constants") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        constants = F.broadcast(constants)
    joined = found.join(constants, F.col("host") == F.col("constant_host"), "left")
    content = F.filter(
        "blocks",
        lambda b: ~b["excluded"]
        & ~F.coalesce(
            F.exists(
                "constants",
                lambda c: F.when(c["text_hash"].isNull(), (c["slot"] == b["kin"]) & ~b["region"]).otherwise(
                    (c["slot"] == b["slot"]) & (c["text_hash"] == F.xxhash64(b["text"]))
                ),
            ), F.lit(False)
        ),
    )
    inside = F.filter("content", lambda b: b["region"])
    text = F.array_join(F.transform(F.when(F.size(inside) > 0, inside).otherwise(F.col("content")), lambda b: b["text"]), "\n")
    return (
        joined.select("page_id", "url", content.alias("content"))
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
