"""Operator 13: a Merkle manifest of a table, with checkpointed levels and recomputed proofs.

Every row is a leaf: the SHA-256 of its fields (``-`` for null, else the UTF-8 byte count, ``:`` and the value). The
leaves of one value of ``lang`` make a tree of ``FAN`` children a node, the roots of these trees make one more tree. A
node is the SHA-256 of its children's digests as hex text; a run's last node may have fewer children, even one.

Only every ``stride``-th level is written: the leaves in order, then one node for each aligned subtree of
``FAN ** stride`` nodes of the level below. Proofs go down from the root: the subtrees of a written level are gathered
again, the nodes between two written levels are computed from the stored ones, each node's siblings are appended before
those of the subtree above it, and the recomputed nodes are dropped. A subtree has at most ``FAN ** stride`` rows, so no
group grows with the table; order and positions come from a range sort and counts per (tree, partition).

Nulls: a null ``lang`` is a tree of its own, before all others; a null ``doc_id`` comes first in its tree. Rows with the
same ``lang`` and ``doc_id`` follow the order of their leaves; repeated rows are leaves of their own. Null and empty
texts have different leaves. Any text length is hashed whole. A tree of one leaf has that leaf as its root. An empty
table has no trees, and its root is null. Columns beside the named ones pass through only if they are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import bound_batches, written

FAN = 8
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields, each `-` if null, else byte count, `:` and value."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256)
    )


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    joined = F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")
    return F.sha2(joined.cast("binary"), 256)


def tree_name(value: Column) -> Column:
    """A name without null that sorts like the value, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def parents(nodes: list[str]) -> list[str]:
    """Digests of the runs of ``FAN`` nodes."""
    return [hashlib.sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and the recomputed levels above them."""
    found = [nodes]
    for _ in range(levels):
        found.append(parents(found[-1]))
    return found


def steps(levels: list[list[str]], place: int) -> list[dict[str, str]]:
    """The siblings of node ``place`` on every level but the last."""
    found = []
    for nodes in levels[:-1]:
        first = place - place % FAN
        found.append({"before": "".join(nodes[first:place]), "after": "".join(nodes[place + 1 : first + FAN])})
        place //= FAN
    return found


def placed(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` in their tree (from 0) and its number of leaves ``n``.

    A range sort over (tree, order) deals a tree over many tasks; the row number breaks ties, so a row that is repeated
    many times is dealt too. The offsets of (tree, partition) pairs come from their counts.
    """
    mask = (1 << 33) - 1
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    keys = [F.col(tree), *order, F.col("row")]
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    # the id after the sort holds the number of the partition and the row in it
    dealt = written(dealt.withColumn("id", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumn("part", F.shiftright("id", 33))
    counts = dealt.groupBy(tree, "part").agg(F.count("*").alias("c"), F.min(F.col("id").bitwiseAND(mask)).alias("first"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(tree).alias("own_tree"), F.col("part").alias("own_part"), "first",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(whole).alias("n"),
    )
    offsets = written(offsets, "merkle-offsets")
    joined = dealt.join(offsets, (F.col(tree) == F.col("own_tree")) & (F.col("part") == F.col("own_part")))
    place = (F.col("offset") + F.col("id").bitwiseAND(mask) - F.col("first")).alias("place")
    return joined.select(*rows.columns, place, "n")


def _gathered(nodes: DataFrame, tree: str, extra: list[str], size: int) -> DataFrame:
    """One row for each aligned subtree of ``size`` nodes: they and their extra columns, in order."""
    node = F.struct("place", "digest", *extra)
    return nodes.groupBy(tree, F.expr(f"place div {size}").alias("above"), "n").agg(F.collect_list(node).alias("nodes"))


def write_levels(leaves: DataFrame, path: str, stride: int = STRIDE) -> int:
    """Write the leaves (tree, place, n, digest, ...) and every ``stride``-th level above; the number of steps taken.

    Level table k holds the nodes at height k * stride of all trees that are not done at height (k - 1) * stride; a tree
    of at most FAN ** (k * stride) leaves has its root there and goes no further.
    """
    spark, size = leaves.sparkSession, FAN**stride
    bound_batches(spark)
    leaves.write.parquet(f"{path}/level=0")
    largest = spark.read.parquet(f"{path}/level=0").agg(F.max("n")).first()[0] or 0
    k, covered = 0, 1
    while k == 0 or largest > covered:

        def raised(batches: Iterator[pa.RecordBatch], base: int = k * stride) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for nodes, n in zip(batch.column("nodes").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    own = [x["digest"] for x in sorted(nodes, key=lambda x: x["place"])]
                    found.append(subtree(own, min(stride, max(0, height(n) - base)))[-1][0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tree"), batch.column("above"), batch.column("n"), pa.array(found, pa.string())],
                    names=["tree", "place", "n", "digest"],
                )

        here = spark.read.parquet(f"{path}/level={k}")
        open_trees = here if k == 0 else here.where(F.col("n") > covered)
        above = _gathered(open_trees, "tree", [], size).mapInArrow(raised, "tree string, place long, n long, digest string")
        k, covered = k + 1, covered * size
        above.write.parquet(f"{path}/level={k}")
    return k


def roots(spark: SparkSession, path: str, n_steps: int, stride: int = STRIDE) -> DataFrame:
    """tree and digest of the root of every tree."""
    done = [
        spark.read.parquet(f"{path}/level={k}").where(F.col("n") <= FAN ** (k * stride)).select("tree", "digest")
        for k in range(1, n_steps + 1)
    ]
    first, *more = done
    for other in more:
        first = first.unionByName(other)
    return first


def proofs(
    spark: SparkSession, path: str, n_steps: int, top: DataFrame, extra: list[str], carried: list[str], stride: int = STRIDE
) -> DataFrame:
    """Every leaf with its ``extra`` columns, ``proof`` and what ``carried`` names.

    ``top`` has, for each tree, a proof of its root (empty where the root ends the matter) and columns carried down to
    the leaves. From the highest written level down, each subtree gets the proof of the node above it by an equality
    join on (tree, place), one row a subtree.
    """
    size = FAN**stride
    schemas = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{path}/level=0").schema}
    above = None
    for k in range(n_steps - 1, -1, -1):
        here = spark.read.parquet(f"{path}/level={k}")
        open_trees = here if k == 0 else here.where(F.col("n") > FAN ** (k * stride))
        up = spark.read.parquet(f"{path}/level={k + 1}").where(F.col("n") <= FAN ** ((k + 1) * stride))
        up = up.select("tree", "place").join(top, "tree").select("tree", "place", "proof", *carried)
        if above is not None:
            up = up.unionByName(above)
        kept = extra if k == 0 else []
        names = [*kept, *carried]
        up = up.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), "proof", *carried)
        subtrees = _gathered(open_trees, "tree", kept, size).join(
            up, (F.col("tree") == F.col("up_tree")) & (F.col("above") == F.col("up_place"))
        )
        types = schemas | {f.name: f.dataType.simpleString() for f in top.schema}
        schema = ", ".join(
            ["tree string, place long, digest string", *[f"{c} {types[c]}" for c in names], f"proof array<{STEP}>"]
        )

        def descend(
            batches: Iterator[pa.RecordBatch], base: int = k * stride, kept: list[str] = kept
        ) -> Iterator[pa.RecordBatch]:
            step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    nodes = sorted(row["nodes"], key=lambda x: x["place"])
                    levels = subtree([x["digest"] for x in nodes], min(stride, max(0, height(row["n"]) - base)))
                    first = nodes[0]["place"]
                    own = [steps(levels, x["place"] - first) + row["proof"] for x in nodes]
                    same = pa.array([0] * len(nodes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["tree"]] * len(nodes)), pa.array([x["place"] for x in nodes], pa.int64()),
                            pa.array([x["digest"] for x in nodes]),
                            *[pa.array([x[c] for x in nodes], batch.column("nodes").type.value_type.field(c).type) for c in kept],
                            *[batch.column(c).slice(i, 1).take(same) for c in carried], pa.array(own, step),
                        ],
                        names=["tree", "place", "digest", *kept, *carried, "proof"],
                    )

        above = subtrees.select("tree", "n", "nodes", "proof", *carried).mapInArrow(descend, schema)
        if k:
            above = written(above.select("tree", "place", "proof", *carried), "merkle-proofs")
    return above


def write_manifest(
    rows: DataFrame, path: str, by: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
    extra: dict[str, Column] | None = None, stride: int = STRIDE,
) -> tuple[int, int]:
    """Write the manifest of ``rows`` below ``path``: trees of ``by`` in the order of ``key``, and the tree of their roots.

    Returns the numbers of written steps of both, which ``read_proofs`` takes. ``extra`` names more columns to keep.
    """
    named = lambda c: F.col(f"`{c}`")
    leaves = rows.select(
        tree_name(named(by)).alias("tree"), named(key).alias("key"), leaf_digest(*[named(c) for c in fields]).alias("digest"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )
    leaves = written(leaves, "merkle-leaves")
    n_steps = write_levels(placed(leaves, "tree", [F.col("key").asc_nulls_first(), F.col("digest")]), f"{path}/rows", stride)
    spark = rows.sparkSession
    tops = roots(spark, f"{path}/rows", n_steps, stride).select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"
    )
    return n_steps, write_levels(placed(written(tops, "merkle-roots"), "tree", [F.col("key")]), f"{path}/trees", stride)


def read_proofs(
    spark: SparkSession, path: str, n_steps: tuple[int, int], extra: tuple[str, ...] = (), stride: int = STRIDE
) -> DataFrame:
    """key, leaf, extra columns, proof, subroot and root of every row of a written manifest."""
    empty = F.array().cast(f"array<{STEP}>").alias("proof")
    whole = roots(spark, f"{path}/trees", n_steps[1], stride).select("tree", F.col("digest").alias("root"), empty)
    trees = proofs(spark, f"{path}/trees", n_steps[1], whole, ["key"], ["root"], stride)
    trees = written(trees.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "proof", "root"), "merkle-trees")
    found = proofs(spark, f"{path}/rows", n_steps[0], trees, ["key", *extra], ["subroot", "root"], stride)
    return found.select("key", F.col("digest").alias("leaf"), *extra, "proof", "subroot", "root")
