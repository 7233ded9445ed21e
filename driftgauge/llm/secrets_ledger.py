"""Operator 8: secret scans with a ledger of content-addressed blobs.

A version is one text at one path. Its blob is the SHA-256 of the text, so equal texts at any paths and in any versions
are one blob. The ledger holds, for every blob and rule version already scanned, the findings (perhaps none). A run
scans one text of each blob that the ledger lacks for this rule version, adds the result to the ledger, and joins the
findings back to all paths. Running it again on old versions scans nothing. The rule version is a digest of the rules, so
a changed pattern or minimum scans every blob again.

Nulls: a null text is an empty one; a null path is a path like any other. Repeated rows give repeated result rows, and
their blob is scanned once. Only the named columns are read. An empty table gives an empty table. Spans count code
points of the whole text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, written

LEDGER = "blob binary, rule_version string, findings array<struct<kind:string,first:long,end:long>>"
FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the match), and that length's minimum.

    ``hint`` is a cheaper pattern (for the columnar matcher) that every text with a finding matches.
    """

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, (re.IGNORECASE if self.any_case else 0) | re.ASCII)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "(?i)password|passwd|secret|token|api_?key",
        2,
        12,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
)
RULES = BASE_RULES + MORE_RULES
BROADCAST_ROWS = 200_000


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A digest of all that decides what the rules find, so changed rules are a new version by themselves."""
    parts = [(r.kind, r.pattern, r.hint, r.group, r.least, r.any_case) for r in rules]
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob and text of every version."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{path}`").alias("path"), F.unhex(F.sha2(whole, 256)).alias("blob"), whole.alias("text"))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and findings (by start, then rule order) of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = texts_of(block, "text")
            found: list[list[tuple[int, int, str, int]]] = [[] for _ in range(block.num_rows)]
            for order, rule in enumerate(rules):
                for i in pc.indices_nonzero(pc.match_substring_regex(texts, rule.hint)).to_pylist():
                    found[i].extend((a, order, rule.kind, b) for a, b in rule.spans(texts[i].as_py()))
            rows = [[{"kind": kind, "first": a, "end": b} for a, _, kind, b in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([block.column("blob"), pa.array(rows, FINDINGS)], names=["blob", "findings"])

    return versions.select("blob", "text").mapInArrow(find, "blob binary, findings array<struct<kind:string,first:long,end:long>>")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All entries; runs add folders of their own below ``ledger``."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)


def start_ledger(spark: SparkSession, ledger: str) -> None:
    """An empty ledger at a path that does not exist yet."""
    spark.createDataFrame([], LEDGER).write.parquet(f"{ledger}/start")


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks and add it; returns path and blob of every version.

    One version of each unseen blob is chosen on (path, blob) alone. The texts of the chosen ones are then picked out
    by whichever list is shorter, the chosen or the others. That list is sent to the texts if it has at most
    ``BROADCAST_ROWS`` rows of about 70 bytes; beyond that texts and list meet in a shuffle. The ledger has one writer
    at a time.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    places = written(versions.select("path", "blob"), "places")
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == version).select("blob").distinct()
    chosen = (
        places.groupBy("blob")
        .agg(F.min("path").alias("path"))
        .join(seen, "blob", "left_anti")
        .select(F.col("path").alias("chosen_path"), F.col("blob").alias("chosen_blob"))
    )
    chosen = written(chosen, "chosen")
    same = F.col("path").eqNullSafe(F.col("chosen_path")) & (F.col("blob") == F.col("chosen_blob"))
    n_chosen, n_places = chosen.count(), places.count()

    def sent(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= BROADCAST_ROWS else rows

    if 2 * n_chosen <= n_places:
        texts = versions.join(sent(chosen, n_chosen), same, "left_semi")
    else:
        other = places.join(chosen, same, "left_anti").select(
            F.col("path").alias("chosen_path"), F.col("blob").alias("chosen_blob")
        )
        texts = versions.join(sent(written(other, "skipped"), n_places - n_chosen), same, "left_anti")
    entries = scan(texts, rules).dropDuplicates(["blob"])  # a row that repeats path and text comes twice
    entries.select("blob", F.lit(version).alias("rule_version"), "findings").write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")
    return places


def findings_by_path(places: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and findings (null if none) of every version."""
    entries = read_ledger(places.sparkSession, ledger).where((F.col("rule_version") == rule_version(rules)) & (F.size("findings") > 0))
    return places.join(entries.select("blob", "findings"), "blob", "left")


def spans_text(kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the findings (of some kinds), comma-joined."""
    findings = F.coalesce(F.col("findings"), F.array().cast("array<struct<kind:string,first:long,end:long>>"))
    if kinds is not None:
        findings = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["first"], f["end"])), ",")


def count_of(kind: str) -> Column:
    own = F.filter(F.col("findings"), lambda f: f["kind"] == kind)
    return F.coalesce(F.size(own), F.lit(0)).cast("long")
