"""Quality classifier: importance resampling of documents by hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import count_rows, cut, kth_largest, lean, mix64, sliced, table, texts, total_counts

WORD_BITS, SHAPE_BITS = 12, 14  # buckets of word and of shape n-grams
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
PRIOR = 2.0  # pseudo-counts that draw a bucket's ratio to 1
SAMPLE_DOCS = 20_000  # target documents that the target model is fitted on, about
SEED = 29
REMEMBERED, SHORT = 1 << 16, 64  # words that are remembered, and the bytes that such a word has at most

PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum() and c != ord("_"))


class Features(dict):
    """word -> (hash of its lower-cased core, hash of its shape), remembered up to a bound of words and of bytes.

    A shape is the word's case pattern with the punctuation around its core; it carries what
    words never seen before have in common.
    """

    def __missing__(self, word: bytes) -> tuple[int, int]:
        left = word.lstrip(PUNCTUATION)
        core = left.rstrip(PUNCTUATION)
        head, tail = word[: len(word) - len(left)], left[len(core) :]
        text = core.decode("utf-8", "replace")
        if text.isalpha():
            case = "l" if text.islower() else "u" if text.isupper() and len(text) > 1 else "c"
        else:
            case = "d" if text.isdigit() else "m" if text else "p"
        core_id = xxhash.xxh3_64_intdigest(text.lower().encode())
        got = core_id, xxhash.xxh3_64_intdigest(head + b"|" + case.encode() + b"|" + tail)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


def ngrams(words: list[bytes], known: Features) -> np.ndarray:
    """Buckets of a text's n-grams: cores and shapes, each singly and in pairs; a pair of equal cores is marked."""
    if not words:
        return np.zeros(0, np.int64)
    x = np.array(list(map(known.__getitem__, words)), np.uint64)
    core, shape = x[:, 0], x[:, 1]
    again = (core[1:] == core[:-1]).astype(np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    word = np.concatenate([mix64(core + np.uint64(1)), mix64(core[:-1] * k + core[1:] + np.uint64(2))])
    form = np.concatenate(
        [mix64(shape + np.uint64(3)), mix64((shape[:-1] * k + shape[1:]) * np.uint64(2) + again + np.uint64(4))]
    )
    word, form = word >> np.uint64(64 - WORD_BITS), (form >> np.uint64(64 - SHAPE_BITS)) + np.uint64(1 << WORD_BITS)
    return np.concatenate([word, form]).astype(np.int64)


def log_ratio(grams: np.ndarray, raw: np.ndarray, target: np.ndarray, learned: bool) -> float:
    """Sum of log p_target / p_raw over a text's n-grams.

    The text's own n-grams are taken out of the counts first, so that no text speaks for itself.
    The target model is drawn to the raw one by ``PRIOR`` pseudo-counts in each bucket.
    """
    if not len(grams):
        return 0.0
    bucket, n = np.unique(grams, return_counts=True)
    own = n if learned else 0
    others, good = raw.sum() - len(grams), target.sum() - (len(grams) if learned else 0)
    if others <= 0 or good <= 0:
        return 0.0
    due = (raw[bucket] - n) * (good / others)
    return float((np.log((target[bucket] - own + PRIOR) / (due + PRIOR)) * n).sum())


def fit_models(docs: DataFrame) -> np.ndarray:
    """n-gram counts of the raw and of the target text by bucket, from ``docs(text, target)``.

    The raw model counts the n-grams of every document, the target model those of the rows with
    ``target``; each task counts into two vectors of fixed length, and Spark sums the vectors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Features(), np.zeros((2, BUCKETS), np.int64)
        for batch in sliced(batches, "text"):
            for text, target in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                grams = ngrams((text or b"").split(), known)
                np.add.at(total[0], grams, 1)
                if target:
                    np.add.at(total[1], grams, 1)
        yield count_rows(total.reshape(-1), TaskContext.get().partitionId())

    counted = docs.select("text", "target").mapInArrow(lean(count), "chunk int, part int, counts binary")
    return total_counts(counted, 2 * BUCKETS).reshape(2, BUCKETS).astype(float)


def log_weights(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n_grams, log_weight)`` of every row of ``docs(doc_id, text, target)``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (raw, target) = Features(), shared.value
        for batch in sliced(batches, "text"):
            n, weight = [], []
            for text, fit in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                grams = ngrams((text or b"").split(), known)
                n.append(len(grams))
                weight.append(log_ratio(grams, raw, target, fit))
            columns = [batch.column(0), batch.column(3), pa.array(n, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows_of = docs.select(F.col("doc_id").cast("long"), "text", "target", F.xxhash64("text").alias("text_hash"))
    return rows_of.mapInArrow(lean(score), "doc_id long, text_hash long, n_grams long, log_weight double")


def gumbel_keys(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighted(doc_id, log_weight, ...)`` plus ``key``: log weight + Gumbel noise from a hash of seed and doc_id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id"), 11) + 0.5) / float(1 << 53)
    return weighted.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def resample_quality(
    docs: DataFrame, labels: DataFrame, size: int | None = None, sample_docs: int = SAMPLE_DOCS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, text_hash, n_grams, log_weight, key, kept)`` for every row of ``docs(doc_id, text)``.

    Target text is a bounded sample of the documents with quality 1 in ``labels(doc_id, quality)``
    (a fraction chosen by a hash of doc_id, about ``sample_docs`` of them); raw text is every
    document. A document's importance weight is the product of its n-grams' ratios p_target /
    p_raw. Of all documents a sample of ``size`` is drawn without replacement with chances by
    weight, by Gumbel top-k: key = log weight + Gumbel noise from a hash of seed and doc_id, and
    ``kept`` marks the largest keys; ties at the last one are kept too. Where no size is given, it
    is what accept-reject sampling of the target from raw text is expected to keep: the sum of
    min(1, weight). The k-th key is found by counting, never by gathering keys.

    Null or blank text has no n-grams and log weight 0: no evidence against it. Very long texts are
    counted whole. Repeated rows get equal keys; ``text_hash`` (xxhash64 of the text) tells rows of
    one doc_id with different texts apart. Rows without doc_id take part and share their noise. Without any target document all
    ratios are 1 and everything is kept. Columns of other names are left behind. An empty table gives an empty result.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_docs / max(1, n))
    good = good.where(part).select(F.col("doc_id").alias("__good"))  # about sample_docs rows at most
    flagged = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left")
    flagged = flagged.withColumn("target", F.col("__good").isNotNull())
    counts = fit_models(flagged) if n else np.zeros((2, BUCKETS))
    scored = cut(gumbel_keys(log_weights(flagged, counts), seed), "weights")
    if size is None:
        accepted = scored.agg(F.sum(F.exp(F.least("log_weight", F.lit(0.0)))), F.count("*")).first()
        size = min(accepted[1], round(accepted[0] or 0))
    least = kth_largest(scored, "key", size) if size else float("inf")
    return scored.withColumn("kept", F.col("key") >= least)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = resample_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_grams", "log_weight", "key", "kept")
