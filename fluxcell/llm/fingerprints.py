"""Document fingerprints: content-defined chunks and their length-weighted digest sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import lean, mix64, rows, sliced, table

# Chunk lengths in code points. The gear hash of a place covers the last 32 code points, so
# boundaries depend on nearby text alone and come back after an insertion.
SHORTEST, USUAL, LONGEST = 24, 48, 192
HARD_BITS, EASY_BITS = 6, 4  # zero bits asked for before and after the usual length


def gear(codes: np.ndarray) -> np.ndarray:
    """Gear hash at every place: sum of 2**k * G[code k places back], modulo 2**32."""
    h = mix64(codes.astype(np.uint64)).astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunks(codes: np.ndarray) -> list[tuple[int, int]]:
    """Normalised chunking: after ``SHORTEST`` code points a chunk ends at the first place whose
    hash has ``HARD_BITS`` leading zeros, beyond ``USUAL`` ``EASY_BITS``, at ``LONGEST`` anyway."""
    n = len(codes)
    h = gear(codes)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = (h[easy] < np.uint32(1 << (32 - HARD_BITS))).tolist()
    easy = easy.tolist()
    out, start, i, m = [], 0, 0, len(easy)
    while start < n:
        end = min(start + LONGEST, n)
        while i < m:
            at = easy[i] + 1
            if at > end:
                break
            i += 1
            size = at - start
            if size >= USUAL or (size >= SHORTEST and hard[i - 1]):
                end = at
                break
        out.append((start, end))
        start = end
    return out


def digests(text: str) -> dict[int, int]:
    """48-bit digest of each distinct chunk -> its length."""
    if not text:
        return {}
    data = text.encode("utf-32-le", "surrogatepass")
    digest = xxhash.xxh3_64_intdigest
    return {digest(data[4 * a : 4 * b]) >> 16: b - a for a, b in chunks(np.frombuffer(data, np.uint32))}


def fingerprint(parts: dict[int, int]) -> str:
    """Digest and length of every chunk, in hex, sorted: twelve and two digits each."""
    return "".join(sorted(f"{d:012x}{n:02x}" for d, n in parts.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment weighted by length: shared chunks' lengths over the smaller set's; two empty sets are alike."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if sum(a.values()) <= sum(b.values()) else (b, a)
    return sum(n for d, n in small.items() if d in large) / sum(small.values())


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def compare(this: tuple[int, str, dict], following: tuple[int, str, dict]) -> tuple:
    doc_id, text, parts = this
    k = len(text) // 4
    edited = text[: len(text) - k] + following[1][:k]
    edited_parts = digests(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id,
        len(text),
        sha,
        fingerprint(parts),
        fingerprint(edited_parts),
        likeness(parts, edited_parts),
        likeness(parts, following[2]),
    )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text)``, of its edited text, and their likeness.

    A document's edited text has its last floor(n/4) code points replaced by the first as many of
    the next document in order of doc_id (the last one's next is the first). The ids' quantiles
    split the order into ranges; the first document of each range also goes to the range before
    it, so each task sees every document of its ranges next to its successor and the text is
    shuffled once.

    Very long texts are cut into chunks whole. Null text is empty; equal texts have equal fingerprints; an empty text's is the empty string.
    Rows are ordered by doc_id (null first), then text, so repeated ids follow each other; a
    single row is its own next. An empty table gives an empty result. Other columns are left behind.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    # one row for each range, never more than len(cuts) + 1
    no_id = F.min(F.col("doc_id").isNotNull()).alias("known")
    first = (
        docs.select("doc_id", range_of("doc_id").alias("r")).groupBy("r").agg(F.min("doc_id").alias("least"), no_id)
    ).collect()
    first = sorted((r["r"], None if not r["known"] else r["least"]) for r in first)
    before = {first[i][0]: first[i - 1][0] for i in range(len(first))}
    heads = spark.createDataFrame(
        [(x, r, before[r]) for r, x in first], "least long, r int, before int"
    )
    placed = docs.withColumn("r", range_of("doc_id"))
    halo = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("least")))
    seen = placed.select("r", F.lit(False).alias("halo"), "doc_id", "text").unionByName(
        halo.select(F.col("before").alias("r"), F.lit(True).alias("halo"), "doc_id", "text")
    )
    seen = seen.repartition("r").sortWithinPartitions("r", "halo", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, done = None, None, False
        for batch in sliced(batches, "text"):
            out = []
            for r, is_halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    at, last, done = r, None, False
                if done:
                    continue
                this = (doc_id, text, digests(text))
                if last is not None:
                    out.append(compare(last, this))
                last, done = this, is_halo
            if out:
                yield rows(dict(zip(RESULT.names, zip(*out, strict=True), strict=True)), RESULT)

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"  # noqa: E501
    return seen.mapInArrow(lean(run), kind)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
