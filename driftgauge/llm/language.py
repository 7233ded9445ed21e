"""Operator 4: language by the nearest of several centroids per language.

A text becomes a TF-IDF vector of its character bigrams and trigrams (lower-cased, everything but letters is a space),
hashed into ``DIMENSIONS`` places, logarithmic in the counts and of length one. For every language the vectors of a
bounded sample of labelled texts are clustered by spherical k-means; a text gets the language of the centroid with the
largest cosine. A text farther from its centroid than nearly all sample texts of that cluster is marked as rejected.

The sample (about ``per_language`` distinct rows of each language, see ``sampling.bounded_sample``) is vectorised and
clustered on the executors, one language a task; the driver gets a few centroids of 16 KB for each language. Rows are put
in order of id and text before they are clustered, so the order of arrival changes nothing. Everything else reads all
documents, whole.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows without a language or an id teach nothing; a
null id is not held out. Repeated rows are all returned. Without a single labelled text every text is ``und``. Only the
named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import blocks, texts_of, written
from driftgauge.llm.sampling import bounded_sample, fold

DIMENSIONS = 4096
TEXTS_AT_ONCE = 256
UNKNOWN = "und"
SPACE = 32


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMENSIONS) counts of hashed bigrams and trigrams, and whether each text has a letter."""
    parts = [t.lower() for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    # A space before each text and two after all: no gram of letters reaches from one text into the next.
    points = np.frombuffer(("\n" + "\n".join(parts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    chars = np.where(is_letter, points, np.uint32(SPACE))
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    here, second, third = chars[: len(owner)], chars[1 : len(owner) + 1], chars[2 : len(owner) + 2]
    pair = here * np.uint32(0x9E3779B1) + second
    triple = pair * np.uint32(0x85EBCA6B) + third
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    counts = np.zeros(len(parts) * DIMENSIONS, np.int64)
    for gram, use in (
        (pair * np.uint32(0xC2B2AE35), (here != SPACE) | (second != SPACE)),
        (triple * np.uint32(0x27D4EB2F), second != SPACE),
    ):
        place = owner[use] * DIMENSIONS + (gram[use] >> shift)
        counts += np.bincount(place, minlength=len(counts))
    has_letter = np.bincount(owner, weights=is_letter[: len(owner)], minlength=len(parts)) > 0
    return counts.reshape(len(parts), DIMENSIONS), has_letter


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: centroids and each row's centroid."""
    centroids = x[[0]]
    while len(centroids) < min(k, len(x)):
        centroids = np.concatenate([centroids, x[[int(np.argmin((x @ centroids.T).max(axis=1)))]]])
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in range(len(centroids))])
        used = np.linalg.norm(sums, axis=1) > 0
        centroids = unit_rows(sums[used])
    return centroids, (x @ centroids.T).argmax(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # one for each centroid
    centroids: np.ndarray
    idf: np.ndarray
    nearest: np.ndarray  # cosine below which a text is rejected, one for each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each row."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        return [self.languages[b] for b in best], np.clip(top, 0, 1).astype(float), top < self.nearest[best]


def fit_languages(
    labelled: DataFrame, per_language: int = 500, per_cluster: int = 4, rejected_share: float = 0.005
) -> LanguageModel | None:
    """A model of rows with ``doc_id``, ``text`` and ``lang``; None if there are none."""

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for a in range(0, block.num_rows, TEXTS_AT_ONCE):
                part = block.slice(a, TEXTS_AT_ONCE)
                counts, has_letter = gram_counts(texts_of(part, "text"))
                rows = pa.array([c.tobytes() for c in np.log1p(counts).astype(np.float16)], pa.binary())
                found = [part.column("lang"), part.column("doc_id"), part.column("text_hash"), rows]
                yield pa.RecordBatch.from_arrays(found, names=["lang", "doc_id", "text_hash", "tf"]).filter(pa.array(has_letter))

    def unpacked(tf: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(tf.to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            texts += batch.num_rows
            seen += (unpacked(batch.column("tf")) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([seen.tobytes()], pa.binary())], names=["n", "seen"])

    usable = labelled.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    sample = bounded_sample(usable, "lang", per_language).withColumn("text_hash", F.xxhash64("text"))
    vectors = written(sample.mapInArrow(vectorise, "lang string, doc_id long, text_hash long, tf binary"), "language-sample")
    parts = vectors.select("tf").coalesce(64).mapInArrow(frequencies, "n long, seen binary").toArrow()
    n = sum(parts.column("n").to_pylist())
    if not n:
        return None
    seen = sum(np.frombuffer(x, np.int64) for x in parts.column("seen").to_pylist())
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1

    def cluster(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("text_hash").to_numpy(), group.column("doc_id").to_numpy()))  # however they came
        x = unit_rows(unpacked(group.column("tf"))[order] * idf)
        found, own = clusters(x, per_cluster)
        cosine = (x * found[own]).sum(axis=1)
        nearest = [float(np.quantile(cosine[own == c], rejected_share)) if (own == c).any() else 0.0 for c in range(len(found))]
        rows = pa.array([c.tobytes() for c in found.astype(np.float32)], pa.binary())
        same = group.column("lang").combine_chunks().take(pa.array([0] * len(found)))
        return pa.table({"lang": same, "place": pa.array(range(len(found)), pa.int32()), "centroid": rows, "nearest": pa.array(nearest, pa.float64())})

    # a language's sample is one bounded group; what comes back is per_cluster vectors a language
    table = vectors.groupBy("lang").applyInArrow(cluster, "lang string, place int, centroid binary, nearest double").toArrow()
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "place", "centroid", "nearest")), strict=True))
    centroids = np.stack([np.frombuffer(c, np.float32) for _, _, c, _ in found])
    return LanguageModel([name for name, *_ in found], centroids, idf, np.array([x for *_, x in found]))


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every text."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for a in range(0, block.num_rows, TEXTS_AT_ONCE):
                part = block.slice(a, TEXTS_AT_ONCE)
                counts, has_letter = gram_counts(texts_of(part, "text"))
                if model is None:
                    lang, score, rejected = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                else:
                    lang, score, rejected = model.predict(counts)
                lang = [name if ok else UNKNOWN for name, ok in zip(lang, has_letter, strict=True)]
                columns = [pa.array(lang), pa.array(np.where(has_letter, score, 0.0)), pa.array(rejected | ~has_letter)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, per_language: int = 500) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = fit_languages(own.where(fold("doc_id", folds) != held_out), per_language)
    return predict_languages(own, model).withColumn("held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)))
