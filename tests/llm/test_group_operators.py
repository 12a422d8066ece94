"""Edge cases and brute-force checks of joins, mixing, vectors, dialogues and components."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxcell.llm import chat, common, embedding_dedup, mixing, ngram_join


def components_of(n, links):
    up = {i: i for i in n}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in n}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = components_of({x for p in real for x in p}, real)
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(int(k) if k else None, int(o), int(v)) for k, o, v in zip(rng.integers(0, 3, 200), rng.permutation(200), rng.integers(0, 9, 200), strict=True)]
    df = spark.createDataFrame(data, "k long, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in common.running(df, ["k"], ["o"], {"s": "v"}, "t").collect()}
    for k, o, _ in data:
        assert got[k, o] == sum(v for k2, o2, v in data if k2 == k and o2 < o)


def test_kth_largest(spark):
    x = np.random.default_rng(2).normal(size=500).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 7, 250, 500):
        assert common.kth_largest(df, "v", k, most=20) == sorted(x)[-k]


# n-gram join


def brute_join(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, components_of(sets, links)


def family(rng, words, n, size, edits):
    base = list(rng.choice(words, n))
    out = []
    for _ in range(size):
        t = list(base)
        for k in rng.integers(0, n, edits):
            t[k] = str(rng.choice(words))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("tokens", [1 << 20, 200])
def test_ngram_join_matches_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(900)]
    texts = [t for k in range(8) for t in family(rng, words, int(rng.integers(20, 90)), 9, k % 5)]
    passage = " ".join(rng.choice(words, 40))
    texts += [passage + " " + " ".join(rng.choice(words, 30)) for _ in range(12)] + [passage] * 3
    texts += [None, "", " \t", "a b c", "A  B c", "a b", "x y z", "one two three four five", "ONE two three four five", "é É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: r for r in ngram_join.similar_documents(df).collect()}
    sets, want = brute_join(texts)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_ngram_join_with_colliding_hashes(spark, monkeypatch):
    whole = ngram_join.set_ids
    monkeypatch.setattr(ngram_join, "set_ids", lambda found: (whole(found)[0] & 7, whole(found)[1]))
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(400)]
    texts = [t for k in range(6) for t in family(rng, words, int(rng.integers(20, 60)), 6, k % 4)] + [texts_ for texts_ in family(rng, words, 30, 1, 0) * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(df).collect()}
    assert got == brute_join(texts)[1]


def test_crossing_rows_take_one_shuffle(spark):
    rows = [(1, 10, 5, 0), (1, 11, 6, 0), (2, 10, 5, 0), (2, 12, 5, 1), (3, 10, 5, 0), (3, 13, 7, 1), (3, 14, 7, 1), (4, 15, 8, 2)]
    told = ngram_join.crossing(spark.createDataFrame(rows, "token long, x long, block long, label long"))
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuple(r) for r in told.collect()) == [r for r in rows if r[0] == 3]


def test_ngram_join_packs_sets_and_drops_tables_it_is_done_with(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 500):
        tokens = np.unique(np.concatenate([rng.integers(0, 1 << 57, n), rng.integers(0, 1 << 57, n // 9) + (3 << 57)]).astype(np.uint64))
        assert (ngram_join.unpacked(ngram_join.packed(tokens)) == tokens).all()
    assert len(ngram_join.packed(tokens)) < 0.9 * tokens.nbytes
    monkeypatch.setattr(common, "scratch", lambda _: str(tmp_path))
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 200)
    words = [f"w{i}" for i in range(400)]
    texts = [t for k in range(8) for t in family(rng, words, 60, 9, k % 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ngram_join.similar_documents(df).count() == len(texts)
    assert len(list(tmp_path.glob("shared-*"))) == 1 and len(list(tmp_path.glob("told-*"))) <= 1


def test_filter_of_nodes_takes_no_shuffle_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 12)
    nodes = spark.range(-3000, 3000, 20).select(F.col("id").alias("node"))
    words = common.cut(ngram_join.filter_words(nodes, "node"), "able", small=True)
    assert words.count() <= 64
    found = spark.range(-3000, 3000).selectExpr("id div 3 as token", "0 as salt", "id as node")
    kept = ngram_join.let_pass(found, "node", words)
    assert kept.columns == ["token", "salt", "node"] and "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    got = [r["node"] for r in kept.collect()]
    assert len(got) == len(set(got)) < 1000 and set(range(-3000, 3000, 20)) <= set(got)


def test_shuffle_files_go_when_a_table_is_written(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {p.name for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    made = common.cut(spark.range(5000).repartition(3, "id"), "made")
    counts = spark.createDataFrame([(0, k, np.arange(4).tobytes()) for k in range(3)], "chunk int, part int, counts binary")
    assert common.total_counts(counts, 4).tolist() == [0, 3, 6, 9]
    for _ in range(50):  # they are removed beside what follows
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and made.count() == 5000 and spark.conf.get(common.CLEANUP, None) == setting


def test_ngram_join_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words in this one"), (9, None)], "doc_id long, text string")
    got = ngram_join.similar_documents(df).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] is None} == {4}
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def test_trie_finds_every_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 5000, 60).astype(np.uint64))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 5000, 4).astype(np.uint64)])) for _ in range(4)]
    found = set()
    ngram_join.traverse(sets, [len(s) for s in sets], sets, [len(s) for s in sets], lambda i, j: found.add((i, j)))
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert found == want


# vectors


def brute_vectors(rows):
    sound = {}
    for i, (_, x, label) in enumerate(rows):
        if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            sound[i] = np.array(x, np.float32).astype(float)
    links = []
    for i in sound:
        for j in sound:
            if j < i and rows[i][2] == rows[j][2] and len(sound[i]) == len(sound[j]):
                a, b = sound[i], sound[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    return links


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(size=8) * (0.02 + 0.1 * (i % 3))).tolist(), i % 2) for i in range(200)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [None] + [1.0] * 7, 0), (303, [float("nan")] * 8, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, shard_size=40).collect()}
    links = brute_vectors(rows)
    comp = components_of(range(len(rows)), links)
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert g["n_links"] == sum(i in p for p in links)
        assert g["component_id"] == rows[comp[i]][0] and g["kept"] == (comp[i] == i)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit(rng.normal(size=(1500, 16)))
    single = x.astype(np.float32)
    g = embedding_dedup.build(single, np.arange(1500))
    ids, sim = embedding_dedup.search(single, g, single[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)])
    assert recall > 0.9


def test_audit_without_links_still_measures_recall():
    rng = np.random.default_rng(3)
    x, y = (embedding_dedup.unit(rng.normal(size=(2000, 64))) for _ in range(2))
    single = x.astype(np.float32)
    g = embedding_dedup.build(single, np.arange(2000))
    beam = embedding_dedup.passing_beam(x, single, g, y, 0.98)
    assert (y[:: len(y) // embedding_dedup.AUDITED] @ x.T < 0.98).all()
    # links made afresh, just at the bound, from every node: the beam that the audit chose finds them
    u = rng.normal(size=x.shape)
    u = embedding_dedup.unit(u - (u * x).sum(1, keepdims=True) * x)
    probe = 0.98 * x + np.sqrt(1 - 0.98**2) * u
    assert (probe * x).sum(1) == pytest.approx(0.98)
    ids, _ = embedding_dedup.search(single, g, probe.astype(np.float32), beam)
    assert (ids == np.arange(2000)[:, None]).any(1).mean() >= 0.99
    # a graph whose walks miss half of the nodes is not accepted, though no real query has a link
    half = np.arange(2000) >= 1000
    cut = g["layer0"].copy()
    cut[(cut >= 0) & (half[np.maximum(cut, 0)] != half[:, None])] = -1
    assert embedding_dedup.passing_beam(x, single, {"layer0": cut, "entry": np.array([0])}, y, 0.98) >= len(x)


def test_a_large_group_of_near_copies_is_few_nodes():
    rng = np.random.default_rng(12)
    far = rng.normal(size=(1500, 64))
    near = rng.normal(size=64) + 0.09 * rng.normal(size=(700, 64))
    pairs = far[:60] + 0.1 * rng.normal(size=(60, 64))
    x = embedding_dedup.unit(np.concatenate([far, near, pairs])[rng.permutation(2260)])
    single = x.astype(np.float32)
    g = embedding_dedup.build(single, np.arange(2260), 0.98)
    exact = x @ x.T >= 0.98
    leader = g["leader"]
    assert exact[np.arange(2260), leader].all() and (leader[leader] == leader).all()
    assert len(np.unique(leader)) < 1600
    beam = embedding_dedup.passing_beam(x, single, g, x, 0.98)
    assert beam <= 4 * embedding_dedup.FIRST_BEAM
    got = np.zeros_like(exact)
    for q, node in embedding_dedup.linked(x, single, g, x, beam, 0.98):
        assert not got[q, node].any()
        got[q, node] = True
    assert (got & ~exact).sum() == 0 and got.sum() >= 0.999 * exact.sum() > 100_000


def test_a_graph_that_hides_links_is_scanned():
    rng = np.random.default_rng(8)
    x, y = (embedding_dedup.unit(rng.normal(size=(1200, 16))) for _ in range(2))
    spots = [i for i in range(1200) if i % (1200 // embedding_dedup.AUDITED)][:100]
    y[spots] = x[1000:1100]
    single = x.astype(np.float32)
    g = embedding_dedup.build(single, np.arange(1200))
    cut = g["layer0"]  # links between the halves are taken away, so that a walk stays in the half of its entry
    half = np.arange(1200) >= 600
    cut[(cut >= 0) & (half[np.maximum(cut, 0)] != half[:, None])] = -1
    g = {"layer0": cut, "entry": np.array([0])}
    beam = embedding_dedup.passing_beam(x, single, g, y, 0.98)
    got = sum(len(q) for q, _ in embedding_dedup.linked(x, single, g, y, beam, 0.98))
    assert got == (y @ x.T >= 0.98).sum() >= 100


def test_vectors_in_large_shards_match_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(2800, 32)).astype(np.float32)
    copies = base[rng.choice(2800, 150, False)] + 0.1 * rng.normal(size=(150, 32)).astype(np.float32)
    x = np.concatenate([base, copies])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, shard_size=1500).collect()}
    y = embedding_dedup.unit(x.astype(float))
    links = np.argwhere(np.triu(y @ y.T >= 0.98, 1))
    comp = components_of(range(len(x)), links.tolist())
    count = np.bincount(links.ravel(), minlength=len(x))
    assert len(links) >= 150
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == [(count[i], comp[i]) for i in range(len(x))]


# mixing


def test_targets_share_and_stop():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    t = mixing.targets([10, 1000, 10])
    assert t[0] == 30 and sum(t) == pytest.approx(1020) and t[2] <= 30
    assert mixing.targets([0, 0]) == [0, 0]


def test_permutation_is_a_bijection():
    for n in (1, 2, 7, 100, 1025):
        pass_ = (np.zeros(n, np.int64), np.ones(n, np.int64))
        got = mixing.permuted(*pass_, np.arange(n), np.full(n, n), 3)
        assert sorted(got.tolist()) == list(range(n))
        assert mixing.permuted(*pass_, got, np.full(n, n), 3, inverse=True).tolist() == list(range(n))


def test_shards_draw_each_source_in_full():
    draws = np.array([7000, 3000, 0, 1])
    got = mixing.draw_shards(draws, 1)
    assert got.sum(0).tolist() == draws.tolist() and got.sum(1).tolist() == [4096, 4096, 10_001 - 2 * 4096]


def test_mix_hits_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i), ["a", "b", None, "c"][i % 4], int(s)) for i, s in enumerate(rng.integers(0, 400, 300))]
    rows += [(300, 5, "a", 20), (301, None, "zz", 9), (302, 9, "tiny", 40), (303, 9, "tiny", 1), (304, 2, "long", 100_000)]
    df = spark.createDataFrame(rows, "rid long, doc_id long, source string, size long")
    sources, drawn = mixing.mix(df)
    taken, words = {}, {}
    for r in drawn.collect():
        assert 0 <= r["lo"] < r["hi"] <= rows[r["rid"]][3] and 1 <= r["copy"] <= 3
        taken[r["rid"]] = taken.get(r["rid"], 0) + r["hi"] - r["lo"]
        for w in range(r["lo"], r["hi"]):
            key = (r["rid"], r["copy"], w)
            assert key not in words  # no word twice in one pass
            words[key] = r["shard"]
    goal = {r["source"]: r for r in sources.collect()}
    assert sum(r["target"] for r in goal.values()) == pytest.approx(sum(r[3] for r in rows))
    for s, g in goal.items():
        assert sum(taken.get(r[0], 0) for r in rows if r[2] == s) == round(g["target"])
        # a pass begins only when the one before took every word
        last = max((k[1] for k in words if rows[k[0]][2] == s), default=1)
        assert all((r[0], c, w) in words for r in rows if r[2] == s for c in range(1, last) for w in range(r[3]))
    again = mixing.mix(df)[1].collect()
    assert sorted(again) == sorted(drawn.collect())


def test_last_pass_takes_words_to_the_word():
    for size in (1, 40, 64, 65, 127, 128, 129, 640, 645):
        n = -(-size // 64)
        order = mixing.permuted(np.full(n, 3), np.full(n, 1), np.arange(n), np.full(n, n), 17)
        length = [size - 64 * (n - 1) if b == n - 1 else 64 for b in order]
        for words in range(1, size):
            whole, cut = mixing.last_pass(3, words, n, size, 1, 64, 17)
            assert sum(length[:whole]) + cut == words and (cut == 0 or cut < length[whole])


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "rid long, doc_id long, source string, size long")
    sources, drawn = mixing.mix(df)
    assert sources.count() == 0 and drawn.count() == 0
    zero = spark.createDataFrame([(0, 1, "a", 0)], df.schema)
    sources, drawn = mixing.mix(zero)
    assert sources.first()["target"] == 0 and drawn.count() == 0


def test_very_large_and_very_small_vectors_link(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1e200, 2e200], 0), (3, [1e-200, 2e-200], 0), (4, [3e-310, 6e-310], 0), (5, [1.7e308, -1.7e308], 0), (6, [0.0, 0.0], 0), (7, [-1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


# dialogues


def test_perspectives(spark):
    t = [(1, 0, "ann", "hi"), (1, 1, "bob", "a <|end|> b"), (1, 2, None, None), (1, 2, None, None), (None, 0, "ann", "lost"), (2, 0, "ann", "alone")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = chat.rotate_perspectives(df).collect()
    assert len(got) == 3 * 3 + 1
    for p in ("ann", "bob", "unknown"):
        parts = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == p), key=lambda r: r["seq"])
        whole = "".join(r["rendered"] for r in parts)
        assert whole.count("<|assistant|>") == 1 and whole.count("<|end|>") == 3
        for r in parts:
            assert whole[r["char_start"] : r["char_end"]] == r["rendered"]
            mask = whole[r["mask_start"] : r["mask_end"]]
            assert mask.endswith("<|end|>") if r["speaker"] == p else mask == ""
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
