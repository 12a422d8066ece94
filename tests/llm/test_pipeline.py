import math
import re

import duckdb
import pytest
from against_sql import SF, same
from pyspark.sql import functions as F
from test_text_operators import brute_weights

import corpus_pipeline
from fluxcell.llm import mixing, quality
from fluxcell.llm.queries import QUERIES, SQL


def test_queries_match_sql(spark):
    for name, sql in SQL.items():
        same(QUERIES[name](spark, SF), sql)


def test_quality_stage_keeps_the_largest_keys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    good = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1").fetchall()}
    weights = brute_weights([r["text"] for r in rows], {i for i, r in enumerate(rows) if r["doc_id"] in good})
    noise = quality.gumbel_keys(docs.select("doc_id", F.lit(0.0).alias("log_weight")))
    noise = {r["doc_id"]: r["key"] for r in noise.collect()}
    keys = sorted(((w + noise[r["doc_id"]], r["doc_id"]) for w, r in zip(weights, rows, strict=True)), reverse=True)
    size = round(sum(math.exp(min(0.0, w)) for w in weights))
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {d for _, d in keys[:size]}
    assert size < len(rows)


def test_stages_only_drop(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = docs.persist()
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] >= seen[1] >= seen[2]


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    text = "One two three four five six seven.\n" * 3 + "This line is long enough to count.\tEnd"
    rows = [(None, None), (None, text), (None, text), (1, ""), (1, ""), (1, text), (2, "  \n"), (3, text + " x"), (4, "y" * 5000), (5, "word " * 4000)]
    rows += [(6 + i, text.replace("six", f"six{i}")) for i in range(4)] + [(4, "short and clean. Other words.")]
    return spark.createDataFrame([(d, t, None, [None, "a", "b"][i % 3], None) for i, (d, t) in enumerate(rows)], ROW)


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("text_hash", "gone_id", "gone_hash", "rid", "size", "spans", "words", "copies", "n_lines", "kept_text", "node", "block", "key")})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    docs = odd(spark)
    plain, extra = stage(spark, docs, SF), stage(spark, clashing(docs), SF)
    assert plain.columns == extra.columns and (name == "pieces" or plain.columns == corpus_pipeline.COLUMNS)
    plain = plain.collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, extra.collect()))
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "near_duplicates":  # a row of each group, the one with the smallest doc_id; repeats of other rows go
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in plain) == [
            (False, 1, 0), (False, 1, 143), (False, 2, 3), (False, 4, 29), (False, 4, 5000), (False, 5, 20000),
            *[(False, 6 + i, 146) for i in range(4)], (True, 0, 0),
        ]


def test_mixing_gives_words_and_white_space_back(spark):
    texts = ["a b\tc\n\nd " + " ".join(f"w{i}" for i in range(n)) + "\nlast" for n in (3, 70, 300, 1000)]
    docs = spark.createDataFrame([(i, t, None, s, len(t)) for i, (t, s) in enumerate((t, s) for t in texts for s in "aab")], ROW)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in got} <= set(text)
    whole = 0
    for r in got:
        t = text[r["doc_id"]]
        whole += r["text"] == t
        left = iter(t.split())
        assert all(any(w == x for x in left) for w in r["text"].split())  # the words, in order
        assert all(part in t for part in re.findall(r"\S+(?:[\t\n]+\S+)+", r["text"])) and r["n_chars"] == len(r["text"])
    assert whole > 0
    n = {s: sum(len(t.split()) for i, t in text.items() if docs_source(i) == s) for s in "ab"}
    goal = dict(zip("ab", mixing.targets([n["a"], n["b"]]), strict=True))
    for s in "ab":
        assert sum(len(r["text"].split()) for r in got if r["source"] == s) == round(goal[s])


def docs_source(i):
    return "aab"[i % 3]


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.count() > 0
