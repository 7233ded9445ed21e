"""The registered queries of these operators and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftgauge.llm.common import load
from driftgauge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table of all documents, written and read back."""
    from driftgauge.llm.token_files import token_digest, write_tokens

    path = scratch_path(spark, "token-files")
    write_tokens(load(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    from driftgauge.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    from driftgauge.llm.simhash import hex_digits, near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", hex_digits().alias("fingerprint"), "component_id")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    from driftgauge.llm.quality_rules import judge

    judged = judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "failed_rules")


@query("op8_secrets_ledger")
def op8_secrets_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents, scanned once for each blob."""
    from pyspark.sql import functions as F

    from driftgauge.llm import secrets_ledger as ledger

    path = scratch_path(spark, "secrets-ledger")
    docs = load(spark, sf_dir, "documents")
    ledger.start_ledger(spark, path)
    # an older state of the table first, then the whole of it: the second run scans what the ledger lacks
    older = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ledger.update_ledger(ledger.versions_of(older), path)
    places = ledger.update_ledger(ledger.versions_of(docs), path)
    base = tuple(r.kind for r in ledger.BASE_RULES)
    return ledger.findings_by_path(places, path).select(
        F.col("path").alias("doc_id"),
        *[ledger.count_of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(ledger.spans_text(base), 256).alias("base_sha256"),
        ledger.spans_text().alias("spans"),
        F.lower(F.hex("blob")).alias("blob"),
    )


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    from driftgauge.llm.decontamination import contaminated

    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query(
    "op1_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, source, pos AS number, trim(regexp_replace(line, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS line, line AS raw
        FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
    ), spread AS (
        SELECT line, min((doc_id, number)) AS first FROM lines
        WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
    ), judged AS (
        SELECT l.*, (s.line IS NOT NULL AND s.first <> (l.doc_id, l.number)) AS gone
        FROM lines l LEFT JOIN spread s ON s.line = l.line
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           CAST(length(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT gone), '')) AS BIGINT) AS n_chars,
           md5(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT gone), '')) AS text_md5
    FROM judged GROUP BY doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that spread over ten sites or more."""
    from pyspark.sql import functions as F

    from driftgauge.llm.line_dedup import without_boilerplate

    cleaned = without_boilerplate(load(spark, sf_dir, "documents"), extra=("n_lines", "n_removed"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    from driftgauge.llm.quality_classifier import classify

    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    from driftgauge.llm.language import identify

    return identify(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_extraction")
def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from driftgauge.llm.extraction import main_text

    return main_text(load(spark, sf_dir, "pages"))


def _merkle_sql(row_levels: int = 7, tree_levels: int = 7) -> str:
    """All nodes of all levels (trees of up to 8 ** levels leaves), each leaf joined with its ancestors' runs."""

    def part(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, n: int) -> str:
        return ", ".join(
            f"""{name}{k} AS MATERIALIZED (SELECT tree, p, h, n, string_agg(h, '') OVER (PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run
            FROM {f"(SELECT tree, p // 8 AS p, (n + 7) // 8 AS n, any_value(CASE WHEN n > 1 THEN sha256(run) ELSE h END) AS h FROM {name}{k - 1} GROUP BY ALL)" if k else f"{name}_leaves"})"""
            for k in range(n + 1)
        )

    def folds(name: str, n: int, source: str, out: str) -> str:
        steps, at = [], source
        for k in range(n):
            place, node = f"64 * (x.p // {8**k} % 8)", f"{name}{k}"
            before, after = f"substr(y.run, 1, {place})", f"substr(y.run, {place} + 65)"
            steps.append(f"""{out}{k} AS MATERIALIZED (SELECT x.* EXCLUDE (folded, siblings), CASE WHEN y.n > 1 THEN sha256({before} || folded || {after}) ELSE folded END AS folded,
            siblings || CASE WHEN y.n > 1 THEN {before} || {after} ELSE '' END AS siblings FROM {at} x JOIN {node} y ON y.tree = x.tree AND y.p = x.p // {8**k})""")
            at = f"{out}{k}"
        return ", ".join(steps)

    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH r_all AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS h, {leaf(lowered)} AS lower_h, {crc} % 3 = 0 AS changed FROM documents),
    r_leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM r_all),
    {levels("r", row_levels)},
    t_leaves AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n, h FROM r{row_levels}),
    {levels("t", tree_levels)},
    start AS (SELECT doc_id, tree, p, h AS leaf, CASE WHEN changed THEN lower_h ELSE h END AS folded, '' AS siblings FROM r_leaves),
    {folds("r", row_levels, "start", "f")},
    mid AS (SELECT f.doc_id, f.leaf, t.h AS subroot, f.folded, f.siblings, t.tree, t.p FROM f{row_levels - 1} f JOIN t_leaves t ON t.name = f.tree),
    {folds("t", tree_levels, "mid", "g")}
    SELECT doc_id, leaf, subroot, h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = h AS verified
    FROM g{tree_levels - 1} CROSS JOIN (SELECT h FROM t{tree_levels})
    """


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof digest and check of all documents against a manifest, a third of them tampered with."""
    from pyspark.sql import functions as F

    from driftgauge.llm import merkle
    from driftgauge.llm.sampling import fold

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lowered if c == "text" else F.col(c) for c in merkle.FIELDS]
    # stored only where the change shows
    tampered = F.when((fold("doc_id", 3) == 0) & (lowered != F.col("text")), merkle.leaf_digest(*fields))
    path = scratch_path(spark, "merkle")
    n_steps = merkle.write_manifest(load(spark, sf_dir, "documents"), path, extra={"tampered": tampered})
    found = merkle.read_proofs(spark, path, n_steps, ("tampered",))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_language_model")
def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-model log probabilities of all documents."""
    from driftgauge.llm.ppm import language_model

    return language_model(load(spark, sf_dir, "documents"))


@query(
    "op11_collocations",
    r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
    ), words AS (
        SELECT piece, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM pieces
    ), runs AS (
        SELECT lang, w1, lead(w1) OVER one AS w2, lead(w1, 2) OVER one AS w3 FROM words WINDOW one AS (PARTITION BY piece ORDER BY i)
    ), f1 AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY ALL
    ), f2 AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
    ), f3 AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
    ), around AS (
        SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
    ), two AS (
        SELECT lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000 * p.f * p.f // (x.f * y.f) AS score
        FROM f2 p JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2) LEFT JOIN around o USING (lang, w1, w2)
        WHERE o.f IS NULL OR 100 * o.f < 50 * p.f
    ), three AS (
        SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
               1000000 * t.f * t.f // (x.f * yz.f) AS s1, 1000000 * t.f * t.f // (xy.f * z.f) AS s2
        FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w1 = t.w3
        JOIN f2 xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN f2 yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3
    ), every AS (
        SELECT * FROM two UNION ALL
        SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three
    )
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
    JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    from driftgauge.llm.collocations import collocations

    return collocations(load(spark, sf_dir, "documents"))
