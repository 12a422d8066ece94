"""Whole queries without SQL, recomputed from their definitions in plain Python."""

import hashlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from against_sql import SF
from pyspark.sql import functions as F

from fluxcell.llm import fingerprints, mixing
from fluxcell.llm.queries import QUERIES

M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_chunks(text):
    """Each place's hash from its last 32 code points, and one place after the other asked whether a chunk ends there."""
    g = [mixed(ord(c)) & 0xFFFFFFFF for c in text]
    out, start = [], 0
    for end in range(1, len(text) + 1):
        size = end - start
        h = sum(g[end - 1 - k] << k for k in range(min(32, end))) & 0xFFFFFFFF
        bits = 6 if size < 48 else 4
        if size == 192 or end == len(text) or (size >= 24 and h < 1 << (32 - bits)):
            out.append(text[start:end])
            start = end
    return out


def plain_print(text):
    return {f"{xxhash.xxh3_64_intdigest(c.encode('utf-32-le')) >> 16:012x}": len(c) for c in plain_chunks(text)}


def contained(a, b):
    if not a or not b:
        return float(not a and not b)
    small, large = sorted((a, b), key=lambda p: sum(p.values()))  # stable: the first of equal ones
    return sum(n for d, n in small.items() if d in large) / sum(small.values())


def plain_fingerprints(rows):
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = map(plain_print, (text, edited, following))
        write = lambda p: "".join(sorted(f"{d}{n:02x}" for d, n in p.items()))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), contained(a, b), contained(a, c)))
    return out


def test_fingerprint_query_matches_definition(spark):
    rows = [(d, t or "") for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()]
    got = QUERIES["op4_fingerprints"](spark, SF).select(*fingerprints.RESULT.names).collect()
    assert sorted(map(tuple, got)) == sorted(plain_fingerprints(rows))


def test_fingerprints_of_long_texts_and_clashing_names(spark):
    rng = np.random.default_rng(0)
    long = "".join(rng.choice(list("abcdé 🙂\n"), 60_000))
    texts = [long, long[:50_000] + "x" + long[50_000:], "y" * 20_000, "", long, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("r", "halo", "least", "before", "fingerprint")})
    got = fingerprints.fingerprint_neighbours(df).collect()
    assert sorted(map(tuple, got)) == sorted(plain_fingerprints(list(enumerate(texts))))


def plain_taken(spark, rows):
    """Words that the mix takes of each (doc_id, source, size, rid), by walking each source's blocks in drawn order."""
    hashed = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").distinct()
    order = {r["doc_id"]: r["o"] for r in hashed.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("o")).collect()}
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    # exact shares: water filling in fractions
    weights, goal, open_, left = [5, 2, 1], {}, set(range(len(names))), Fraction(sum(sizes))
    while open_:
        total = sum(weights[i % 3] for i in open_)
        over = {i for i in open_ if left * weights[i % 3] / total > 3 * sizes[i]}
        if not over:
            goal |= {i: left * weights[i % 3] / total for i in open_}
            break
        goal |= {i: Fraction(3 * sizes[i]) for i in over}
        left -= sum(goal[i] for i in over)
        open_ -= over
    taken = {}
    for i, s in enumerate(names):
        mine = sorted((r for r in rows if r[1] == s and r[2] > 0), key=lambda r: (order[r[0]], r[0], r[2], r[3]))
        owner = [r[3] for r in mine for _ in range(r[2])]
        blocks = [owner[k : k + 64] for k in range(0, len(owner), 64)]
        due, n = round(float(goal[i])), 0
        while due > 0:
            index, epoch = n % len(blocks), n // len(blocks)
            one = lambda x: np.array([x], np.int64)
            b = int(mixing.permuted(one(i), one(epoch), one(index), one(len(blocks)), 17)[0])
            for rid in blocks[b][:due]:
                taken[rid] = taken.get(rid, 0) + 1
            due -= len(blocks[b][:due])
            n += 1
    return goal, names, taken


def test_mixing_query_matches_a_walk_over_blocks(spark):
    got = QUERIES["op6_mixing"](spark, SF).collect()
    rows = duckdb.sql(
        f"select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) from '{SF}/documents.parquet'"
    ).fetchall()
    goal, names, taken = plain_taken(spark, [(*r, r[0]) for r in rows])
    made = {r["doc_id"]: r for r in got}
    assert len(made) == len(rows)
    for d, s, n in rows:
        assert (made[d]["size"], made[d]["taken"]) == (n, taken.get(d, 0))
        assert made[d]["target"] == pytest.approx(float(goal[names.index(s)]))


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a", 100), (1, "a", 100), (None, "a", 70), (None, None, 40), (2, None, 0), (3, "b", 1), (4, "c", 5000)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rid long, doc_id long, source string, size long")
    _, pieces = mixing.mix(df)
    got = {r["rid"]: r["n"] for r in pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    _, _, taken = plain_taken(spark, [(d, s, n, k) for k, (d, s, n) in enumerate(rows)])
    assert got == taken
