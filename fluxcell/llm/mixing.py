"""Mixing sources to target weights by packed blocks and pseudorandom index permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, mix64, running, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST_SHARDS = 4096  # output shards; with more words shards grow instead, so this is a parameter of the mix, not of its size
SLOTS_A_TASK = 1 << 18


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the total by repeating weights; a share stops at ``most`` times its source's size
    and the excess is shared again, by weight, among those below, until none is above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def draw_shards(draws: np.ndarray, seed: int) -> np.ndarray:
    """Slots by output shard (row) and source (column): multinomial source counts for each output shard.

    Each shard's draw uses what is still due from each source as its probabilities and takes no
    more than that, so the counts of all shards sum to ``draws`` exactly. A shard has
    ``SHARD_SLOTS`` slots, or more where that would make over ``MOST_SHARDS`` shards.
    """
    due, out = draws.astype(np.int64).copy(), []
    slots = max(SHARD_SLOTS, -(-int(due.sum()) // MOST_SHARDS))
    while (total := int(due.sum())) > 0:
        need, got = min(slots, total), np.zeros(len(due), np.int64)
        rng = np.random.default_rng([seed, len(out)])
        while (short := need - int(got.sum())) > 0:
            rest = due - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        out.append(got)
        due -= got
    return np.array(out, np.int64).reshape(len(out), len(draws))


def feistel(x: np.ndarray, key: np.ndarray, bits: np.ndarray, inverse: bool) -> np.ndarray:
    """Four rounds over 2 * bits bits of each value, or the same backwards."""
    mask = (np.uint64(1) << bits) - np.uint64(1)
    left, right = x >> bits, x & mask
    for r in reversed(range(4)) if inverse else range(4):
        salt = key + np.uint64(r << 40)
        if inverse:
            left, right = right ^ (mix64(left + salt) & mask), left
        else:
            left, right = right, left ^ (mix64(right + salt) & mask)
    return (left << bits) | right


def permuted(
    source: np.ndarray, epoch: np.ndarray, index: np.ndarray, n: np.ndarray, seed: int, inverse: bool = False
) -> np.ndarray:
    """A bijection of [0, n) for each (source, epoch), or its inverse: a Feistel network, walked until in range."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    key = mix64(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) + np.uint64(seed))
    x, size = index.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        x[todo] = feistel(x[todo], key[todo], bits[todo], inverse)
        todo &= x >= size
    return x.astype(np.int64)


def last_pass(sid: int, words: int, blocks: int, size: int, passes: int, block_words: int, seed: int) -> tuple[int, int]:
    """How the last pass over a source takes ``words`` words, fewer than it has: (whole blocks, words of the next one).

    The blocks come in the pass's order; all have ``block_words`` words but the source's last.
    """
    one = lambda x: np.array([x], np.int64)
    short = int(permuted(one(sid), one(passes), one(blocks - 1), one(blocks), seed, inverse=True)[0])
    missing = blocks * block_words - size  # words that the source's last block is short of
    whole = words // block_words
    if short < whole:  # it is among them, so they hold fewer words
        whole = (words + missing) // block_words
        return whole, words + missing - whole * block_words
    if short == whole and words - whole * block_words >= block_words - missing:
        return whole + 1, words - whole * block_words - (block_words - missing)
    return whole, words - whole * block_words


def mix(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of rows ``sized(rid, doc_id, source, size)``; ``rid`` names a row, ``size`` its words.

    Returns the sources ``(source, source_size, target)`` and the drawn pieces ``(rid, lo, hi, copy,
    shard)``: output shard ``shard`` takes words lo to hi (exclusive) of the row; ``copy`` (1 to 3)
    counts the passes over the source, so pieces of one copy of a row don't overlap.

    Each source's documents, in a pseudorandom order, are one stream of words cut into blocks of
    ``block_words`` (the last may be shorter). A source owes round(target) words: whole passes
    over its blocks, then blocks of one more pass, of which the last drawn is cut to the words
    still due. Every output shard draws multinomial counts of the slots that are owed; a source's
    k-th slot is block permutation(k mod blocks) of pass k div blocks, so no block is drawn more
    than three times. Slots come from a range that Spark splits, and are joined to blocks by
    index. Places in the stream are prefix sums over range partitions, so a hot source isn't
    gathered in one task.

    Only one row for each source, and one count for each shard (at most ``MOST_SHARDS``) and source,
    exist on the driver: a mix is stated by source. Null source is a source of its own, last.
    Rows of size 0 are never drawn. Very long texts are drawn by blocks like others. With no words at all, all targets are 0. Reruns agree.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"] or 0) for r in sums]
    goal = targets(sizes, weights) if sum(sizes) else [0.0] * len(sizes)
    blocks = np.array([-(-n // block_words) for n in sizes], np.int64)
    draws, partial = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, (n, t) in enumerate(zip(sizes, goal, strict=True)):
        passes, words = divmod(min(MOST_REPEATS * n, round(t)), n) if n else (0, 0)
        whole, cut_to = last_pass(i, words, int(blocks[i]), n, passes, block_words, seed) if words else (0, 0)
        draws[i], partial[i] = passes * blocks[i] + whole + (cut_to > 0), cut_to
    sources = spark.createDataFrame(
        [(i, r["source"], n, float(t)) for i, (r, n, t) in enumerate(zip(sums, sizes, goal, strict=True))],
        "sid int, source string, source_size long, target double",
    )
    by_shard = draw_shards(draws, seed)  # a source's slots, in order, go to the shards in order
    first_slot = np.cumsum(draws) - draws
    total = int(draws.sum())
    shared = spark.sparkContext.broadcast((by_shard.cumsum(0), first_slot, blocks, draws, partial))

    @F.pandas_udf("sid int, block long, copy int, words int, shard int")
    def slot(number: pd.Series) -> pd.DataFrame:
        upto, first, n_blocks, n_draws, cut_to = shared.value
        at = number.to_numpy(np.int64)
        sid = np.searchsorted(first, at, "right") - 1
        k, n = at - first[sid], n_blocks[sid]
        shard = np.zeros(len(at), np.int32)
        for i in np.unique(sid):
            mine = sid == i
            shard[mine] = np.searchsorted(upto[:, i], k[mine], "right")
        last = (k == n_draws[sid] - 1) & (cut_to[sid] > 0)
        words = np.where(last, cut_to[sid], block_words)
        block = permuted(sid, k // n, k % n, n, seed)
        return pd.DataFrame({"sid": sid, "block": block, "copy": k // n + 1, "words": words, "shard": shard})

    slots = spark.range(0, total, 1, max(1, -(-total // SLOTS_A_TASK)))
    drawn = slots.select(slot("id").alias("s")).select(
        F.col("s.sid").alias("sid"), F.col("s.block").alias("block"),
        F.struct("s.copy", "s.words", "s.shard").alias("draw"),
    ).groupBy("sid", "block").agg(F.collect_list("draw").alias("draws"))  # three at most
    same = F.col("source").eqNullSafe(F.col("__source"))
    at = sized.where("size > 0").join(
        F.broadcast(sources.select("sid", F.col("source").alias("__source"))), same
    )  # one row for each source
    at = at.select("rid", "sid", "size", F.xxhash64(F.lit(seed), "doc_id").alias("o"), "doc_id")
    at = running(at, ["sid"], ["o", "doc_id", "size", "rid"], {"begin": "size"}, "mix")
    parts = at.select(
        "rid",
        "sid",
        "begin",
        "size",
        F.explode(
            F.sequence(
                F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
            )
        ).alias("block"),
    )
    drawn = cut(drawn, "drawn", small=True)
    lo = F.greatest(F.col("block") * block_words - F.col("begin"), F.lit(0))
    end = F.col("block") * block_words + F.col("draw.words") - F.col("begin")
    pieces = parts.join(drawn, ["sid", "block"]).withColumn("draw", F.explode("draws"))
    pieces = pieces.select(
        "rid",
        lo.alias("lo"),
        F.least(end, F.col("size")).alias("hi"),
        F.col("draw.copy").alias("copy"),
        F.col("draw.shard").alias("shard"),
    ).where("lo < hi")
    return sources.select("source", "source_size", "target"), pieces


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"))
    docs = cut(docs.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    sources, pieces = mix(docs)
    taken = pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = sources.withColumnRenamed("source", "__source")
    return (
        docs.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__source")))  # one row for each source
        .join(taken, "rid", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
