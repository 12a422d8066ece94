"""Spelling variants: words one code point apart, by wildcard groups and deletions, without pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, lean, mix64, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
NOISE = 199  # one run in about so many loses a code point
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, GONE, SELF = 0, 1, 2  # kinds of keys
POINTS = 1 << 18  # code points whose keys are made at once


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """``(word, n)``: occurrences of the runs of letters of ``docs(doc_id, text)``, some of them misspelt.

    A run is lower-cased (A-Z only); if ``noise`` divides the crc32 of ``<doc_id>:<run>`` it loses the
    code point at that number modulo its length. Words of under ``least_length`` code points are left out.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    hashed = runs.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    misspelt = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, misspelt).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def ranked(counted: DataFrame) -> DataFrame:
    """``(rank, word, n)``: ``rank`` ascends as n falls and, among equal n, in code-point order. Not consecutive."""
    at = cut(counted, "counted").repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    return cut(at.select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "vocabulary")


def keys_of(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, index of each key's word, two 64-bit hashes of each key), in time and space linear in the letters.

    A string's hash is the sum of a random number for each (position, code point), so that
    of the string with a wildcard, or without one letter, follows from prefix sums. ``WILD``
    stands for (length, position, prefix, suffix), ``GONE`` for a string with one letter taken out
    (once for each such string: the first letter of a run of equal ones), ``SELF`` for the word.
    """
    length = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    at = (np.arange(len(points)) - start[owner]).astype(np.uint64)
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (at[1:] == 0)
    wild, gone, whole = [], [], []
    for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        # numbers wrap: sums are modulo 2^64
        here = mix64(mix64(points + seed) + at * seed)
        left = mix64(mix64(points + seed) + (at - np.uint64(1)) * seed)  # the same letter, one place to the left
        sums, left_sums = np.cumsum(here), np.cumsum(left)
        end = start + length - 1
        total = sums[end] - (sums[start] - here[start])
        before = sums - here - (sums[start] - here[start])[owner]
        after = left_sums[end][owner] - left_sums
        place = mix64(at * seed + length[owner].astype(np.uint64) + np.uint64(1))
        wild.append(mix64((total[owner] - here) ^ place))
        gone.append(mix64(before + after)[first])
        whole.append(mix64(total))
    yield WILD, owner, np.array(wild)
    yield GONE, owner[first], np.array(gone)
    yield SELF, np.arange(len(words)), np.array(whole)


def word_keys(vocabulary: DataFrame) -> DataFrame:
    """``(kind, a, b, rank)`` for every key of every word of ``vocabulary(rank, word)``; (a, b) is a 128-bit hash."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(0).to_numpy()
            words = batch.column(1).to_pylist()
            at = np.cumsum([len(w) for w in words]) // POINTS
            for part in np.unique(at):
                i, j = np.searchsorted(at, [part, part + 1])
                for kind, owner, (a, b) in keys_of(words[i:j]):
                    columns = [np.full(len(owner), kind, np.int8), a.view(np.int64), b.view(np.int64), rank[i:j][owner]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return vocabulary.select("rank", "word").mapInArrow(lean(run), "kind byte, a long, b long, rank long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(rank, n_near, best)`` of every word of ``vocabulary(rank, word)`` with a near one; best is the near word of least rank.

    Words that differ by one replaced letter share exactly one wildcard group, so a word's near
    words of that kind are counted by its groups' sizes less 1, and the best is its group's first or,
    for the first itself, second: groups keep no more, and have at most as many words as there are
    letters. Words that differ by one letter more or less meet where a word's deletions join
    the vocabulary, at most once for each letter. No pair within a group is made.
    """
    keys = cut(word_keys(vocabulary), "keys")
    wild = keys.where(F.col("kind") == WILD).select("a", "b", "rank")
    groups = wild.groupBy("a", "b").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    groups = groups.where("n > 1").select("a", "b", "n", F.get("ranks", F.lit(0)).alias("top"), F.get("ranks", F.lit(1)).alias("next"))
    replaced = wild.join(groups, ["a", "b"]).select(
        "rank",
        (F.col("n") - 1).alias("n_near"),
        F.when(F.col("top") == F.col("rank"), F.col("next")).otherwise(F.col("top")).alias("best"),
    )
    shorter = keys.where(F.col("kind") == SELF).select("a", "b", F.col("rank").alias("short"))
    hit = keys.where(F.col("kind") == GONE).join(shorter, ["a", "b"])
    ends = F.explode(
        F.array(
            F.struct(F.col("rank"), F.col("short").alias("best")),
            F.struct(F.col("short").alias("rank"), F.col("rank").alias("best")),
        )
    )
    indel = hit.select(ends.alias("e")).select("e.rank", F.lit(1).cast("long").alias("n_near"), "e.best")
    both = replaced.unionByName(indel)
    return both.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(rank, root)`` by pointer doubling over ``forms(rank, to)``; counts rise along every pointer, so there is no cycle."""
    links = cut(forms.select("rank", "to"), "forms")
    while True:
        further = links.select(F.col("rank").alias("to"), F.col("to").alias("further"))
        far = links.join(further, "to", "left").select(
            "rank", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")
        )
        far = cut(far, "roots")
        if far.where("moved").isEmpty():
            return far.select("rank", F.col("to").alias("root"))
        links = far.select("rank", "to")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs(doc_id, text)`` with ``least_count`` occurrences.

    Two words are near if one code point is inserted, deleted or replaced. ``form`` is the near word
    of largest n (ties: smallest in code-point order), null unless its n is ``ratio`` times the
    word's; ``root`` follows forms to the last.

    Null and empty texts have no runs; a null doc_id is hashed as the empty string; repeated rows
    count each. Texts and runs of any length are read whole, at a cost linear in their length. Columns
    of other names are left behind. An empty table, or one without such words, gives no rows.
    """
    counted = count_words(docs.select("doc_id", "text")).where(F.col("n") >= least_count)
    vocabulary = ranked(counted)
    near = near_words(vocabulary)
    best = vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    judged = vocabulary.join(near, "rank", "left").join(best, "best", "left")
    judged = cut(judged.withColumn("good", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))), "judged")
    last = roots(judged.where("good").select("rank", F.col("best").alias("to")))
    last = last.join(vocabulary.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root")
    out = judged.join(last.select("rank", "root_word"), "rank", "left")
    return out.select(
        "word",
        F.when(F.col("good"), F.col("best_word")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("good"), F.col("best_n")).alias("form_n"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# crc32 is computed bit by bit: each byte is followed by seven zeros, and each entry is one step
OP13_SQL = """
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY id, run
), bytes AS (
  SELECT run, times, hex(encode(id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(4 * length(x)),
             lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(x, (2 * (i // 8) + 1)::BIGINT, 2))::BIGINT ELSE 0::BIGINT END)),
           lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) AS h
  FROM bytes
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0
           THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b USING (i, head, tail) WHERE a.word <> b.word
  UNION
  SELECT cuts.word, words.word FROM cuts JOIN words ON words.word = head || tail
  UNION
  SELECT words.word, cuts.word FROM cuts JOIN words ON words.word = head || tail
), near AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n
  FROM pairs JOIN words ON words.word = b GROUP BY a
), judged AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), walk AS (
  SELECT word, word AS at FROM judged
  UNION ALL
  SELECT walk.word, form FROM walk JOIN judged ON judged.word = walk.at WHERE form IS NOT NULL
)
SELECT judged.word, judged.form, walk.at AS root, judged.n, judged.n_near, judged.form_n
FROM judged JOIN walk USING (word) JOIN judged AS last ON last.word = walk.at AND last.form IS NULL
"""
