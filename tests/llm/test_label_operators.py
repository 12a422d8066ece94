"""Toxicity, filter audit and spelling variants against brute force, and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from against_sql import SF
from pyspark.sql import functions as F

from fluxcell.llm import filter_audit, spelling_variants, toxicity
from fluxcell.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string"


# toxicity


def unit(weights):
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm else {}


def brute_scores(docs, labels, k=15, bins=20):
    """(score, evidence) by the operator's definition, comparing every text with every example."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    toxic = {}
    for d, _, x in labels:
        if d is not None and x is not None and not held(d):
            toxic[d] = max(toxic.get(d, 0), int(x == 1))
    words = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in docs]
    examples = [(i, d, toxic[d]) for i, (d, _) in enumerate(docs) if d in toxic]
    n, bad, total, positive = Counter(), Counter(), len(examples), sum(x for _, _, x in examples)
    for i, _, x in examples:
        n.update(words[i].keys())
        bad.update(t for t in words[i] if x)
    seen = [t for t in n if n[t] >= 3]
    terms = set()
    if 0 < positive < total:
        for t in seen:
            a, b, p, q = bad[t], n[t] - bad[t], positive, total - positive
            chi = total * (a * (q - b) - b * (p - a)) ** 2 / (n[t] * (total - n[t]) * p * q) if n[t] < total else 0
            if chi > 2 * math.log(len(seen)) + math.log(total):
                terms.add(t)
    df = Counter(t for w in words for t in w if t in terms)
    idf = {t: math.log((len(docs) + 1) / (df[t] + 1)) + 1 for t in terms}
    vectors = [unit({t: (1 + math.log(c)) * idf[t] for t, c in w.items() if t in terms}) for w in words]
    patterns = defaultdict(list)
    for i, d, x in examples:
        if vectors[i]:
            patterns[tuple(sorted((t, round(w, 12)) for t, w in vectors[i].items()))].append((d, x))

    def vote(v, own=None):
        near = []
        for p, members in patterns.items():
            cosine = round(sum(w * v.get(t, 0) for t, w in p), 9)
            if own is not None and p == tuple(sorted((t, round(w, 12)) for t, w in v.items())):
                members = list(members)
                members.remove(own)
            if cosine > 0 and members:
                near.append((-cosine, min(d for d, _ in patterns[p]), members))
        left, votes, against, evidence = k, 0.0, 0.0, []
        for c, d, members in sorted(near, key=lambda x: x[:2]):
            share = sum(x for _, x in members) / len(members)
            some = min(left, len(members)) / (max(0.0, 1 + c) + 0.02)
            votes, against, left = votes + some, against + some * share, left - min(left, len(members))
            evidence.append(d)
            if left <= 0:
                break
        return (against / votes if votes else None), evidence

    count = defaultdict(lambda: [0, 0])
    for i, d, x in examples:
        share, _ = vote(vectors[i], (d, x))
        b = -1 if share is None else min(bins - 1, int(share * bins))
        count[b][0] += 1
        count[b][1] += x
    base = positive / max(1, total)
    alone = (count[-1][1] + base) / (count[-1][0] + 1)
    blocks = []
    for b in range(bins):
        blocks.append(([b], count[b][0] + 1, count[b][1] + (b + 0.5) / bins))
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            y, x = blocks.pop(), blocks.pop()
            blocks.append((x[0] + y[0], x[1] + y[1], x[2] + y[2]))
    curve = [s / w for bs, w, s in blocks for _ in bs]
    out = []
    for v in vectors:
        share, evidence = vote(v)
        out.append((alone if share is None else float(np.interp(share, [(b + 0.5) / bins for b in range(bins)], curve)), evidence))
    return out


def rude_texts(rng, n=160):
    words, rude = [f"w{i}" for i in range(60)], ["vile", "Nasty", "ROTTEN"]
    texts = []
    for i in range(n):
        t = rng.choice(words, rng.integers(5, 40)).tolist()
        if i % 4 == 0:
            t += rng.choice(rude, rng.integers(1, 5)).tolist()
        texts.append(" ".join(rng.permutation(t)))
    return texts


def test_scores_match_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = rude_texts(rng) + [None, "", "...", "vile", "VILE vile!", "word " * 20_000 + "nasty", texts_twice := "vile nasty w1", texts_twice]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "vile"), (3, "vile w1"), (3, "vile w1")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 160) if i % 5] + [(8, 1, 0), (None, 1, 1), (9999, 1, 1), (7, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"toxic": F.lit(1), "score": F.lit("x"), "terms": F.lit(0)})
    got = toxicity.score_toxicity(df.repartition(3, F.rand(1)), spark.createDataFrame(labels, LABELS)).collect()
    want = sorted(((d, round(s, 6), e) for (d, _), (s, e) in zip(docs, brute_scores(docs, labels), strict=True)), key=repr)
    assert sorted(((r["doc_id"], round(r["score"], 6), [e["example"] for e in r["evidence"]]) for r in got), key=repr) == want
    for r in got:
        assert r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 160]
    assert sum(right) >= 0.95 * len(right)


def test_toxicity_query_matches_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()
    got = {r["doc_id"]: r["score"] for r in QUERIES["op11_toxicity"](spark, SF).collect()}
    want = brute_scores(docs, labels)
    assert [got[d] for d, _ in docs] == pytest.approx([s for s, _ in want], abs=1e-6)


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(900):
        at = np.sort(rng.choice(60, rng.integers(1, 6), replace=False)).astype(np.int32)
        w = rng.integers(1, 4, len(at)).astype(float)  # many ties
        vectors.append((at, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors)
    dense = np.zeros((900, 60))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(0, 900, 9):
        cosine = np.round(dense @ dense[i], 9)
        got = index.search(*vectors[i], 10)
        least = np.sort(cosine)[-10]
        want = sorted(((-c, j) for j, c in enumerate(cosine.tolist()) if c > 0 and c >= least))
        assert [(-round(c, 9), j) for c, j in got] == want
    assert index.scored < 0.5 * 100 * index.blocks  # bounds spare most blocks
    assert toxicity.BlockMaxIndex([]).search(*vectors[0], 3) == []


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    all_toxic = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert all(r["score"] == 1.0 for r in toxicity.score_toxicity(docs, all_toxic).collect())
    assert toxicity.score_toxicity(docs.limit(0), all_toxic).count() == 0
    big = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    marks = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    scores = {r["score"] for r in toxicity.score_toxicity(big, marks, sample_docs=100).collect()}
    assert len(scores) == 1 and 0.3 < scores.pop() < 0.7


# filter audit


def brute_audit(docs, labels):
    good, toxic = Counter(), Counter()
    for d, q, t in labels:
        if d is not None:
            good[d] |= int(q == 1)
            toxic[d] |= int(t == 1)
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        f += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * bool(set(t) & set("#$%&*|"))
        f += "E" * (d is not None and d > least[t])
        fails.append((lang or "", f, good[d], toxic[d]))
    rows = []
    for part in {p for p, *_ in fails}:
        here = [x for x in fails if x[0] == part]
        removed_in_all = Counter()
        for order in permutations("ABCDE"):
            alive = here
            for step, c in enumerate(order, 1):
                out = [x for x in alive if c in x[1]]
                removed_in_all[c] += len(out)
                alive = [x for x in alive if c not in x[1]]
                failing = [x for x in here if c in x[1]]
                only = sum(x[1] == c for x in here)
                lost = sum(x[2] for x in out), sum(x[3] for x in out)
                rows.append([part, "".join(order), step, len(alive), len(out), len(failing) - len(out), only, *lost, c])
        for r in rows:
            if r[0] == part:
                r[-1] = removed_in_all[r[-1]]
    return sorted(map(tuple, rows))


def test_audit_matches_brute_force(spark):
    long, copy = " ".join(f"w{i}" for i in range(150)), "Copy of a text | " + "x " * 200
    texts = [None, "", " \t\n", "A", "AAAA " * 120, long, long, long + " #", copy, copy, copy, "été É " * 60, "w " * 20_000, long.upper(), "a\x00b", "🙂 " * 120]
    docs = [(i, t, [None, "", "en", "fr"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, long, "en"), (None, None, None), (5, long, "en"), (0, None, None), (-3, copy, "fr"), (40, long, None), (40, long, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 45, 2)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (40, None, None)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(7) for c in ("part", "A", "E", "n", "good", "toxic", "key", "digest", "words")})
    marks = spark.createDataFrame(labels, LABELS).withColumns({"good": F.lit(3), "key": F.lit(1)})
    got = filter_audit.filter_audit(df, marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_odd_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x", None)], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    rows = filter_audit.filter_audit(docs, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}
    assert sum(r["removed"] for r in rows) == 120 and {r["shapley"] for r in rows if r["removed"]} == {120}
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    two = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(cells, "XY").collect()}
    assert two["YX", 2]["removed"] == 3 and two["XY", 2]["redundant"] == 2 and two["XY", 1]["shapley"] == 8


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, noise=199):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, count = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = best if best is not None and n[best] >= 5 * n[w] else None, len(found)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_match_brute_force(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("abBé÷"))

    def changed(w):
        w, i = list(w), int(rng.integers(len(w)))
        w[i : i + 1] = [[], [str(rng.choice(letters))], [w[i], str(rng.choice(letters))]][int(rng.integers(3))]
        return "".join(w)

    base = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(12)]
    second = [changed(w) for w in base for _ in range(8)]
    third = [changed(w) for w in second for _ in range(2)]
    words = [w for ws, most in ((base, 400), (second, 60), (third, 9)) for w in ws for _ in range(int(rng.integers(4, most)))]
    rng.shuffle(words)
    docs = [(i, " 1_ ".join(words[i::40])) for i in range(40)] + [(None, "Ünïted ünïted " * 9), (None, None), (7, ""), (7, "unîted\n" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("word", "n", "rank", "run", "kind", "a", "to")})
    got = spelling_variants.spelling_variants(df)
    assert got.columns == COLUMNS
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == brute_variants(docs)
    assert sum(r[1] is not None for r in rows) > 20 and any(r[1] != r[2] for r in rows if r[1])
    counted = spelling_variants.count_words(df, noise=3)
    want = Counter({w: c for w, _, _, c, _, _ in brute_variants(docs, 3)})
    assert {r["word"]: r["n"] for r in counted.where("n >= 5").collect()} == want


def test_variants_of_very_long_runs(spark):
    long = "ab" * 30_000
    texts = [long] * 30 + [long[:5000] + "x" + long[5001:]] * 6 + [long[:-1]] * 5 + ["zz" + long] * 5
    df = spark.createDataFrame([(1000 + 7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["word"][:2] + str(len(r["word"])) + str("x" in r["word"]): r for r in spelling_variants.spelling_variants(df).collect()}
    hashed = [zlib.crc32(f"{1000 + 7 * i}:{t}".encode()) % 199 for i, t in enumerate(texts)]
    assert all(hashed)  # none is misspelt
    assert got["ab60000True"]["form"] == long and got["ab59999False"]["root"] == long
    assert got["ab60000False"]["n_near"] == 2 and got["zz60002False"]["n_near"] == 0


def test_variants_odd_tables(spark):
    df = spark.createDataFrame([(1, "six letters, seldom"), (2, None)], "doc_id long, text string")
    assert spelling_variants.spelling_variants(df).count() == 0
    assert spelling_variants.spelling_variants(df.limit(0)).columns == COLUMNS
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, 3**i * 5) for i in range(12)], "rank long, n long")  # each points to the next
    forms = chain.select("rank", (F.col("rank") + 1).alias("to")).where("rank < 11")
    assert {r["root"] for r in spelling_variants.roots(forms).collect()} == {11}
