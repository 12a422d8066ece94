"""Filter interaction audit: what each filter removes in every order, by inclusion-exclusion over joint failures."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"


def text_flags(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` as ``(doc_id, part, digest, A, B, C, D)``: what each text fails by itself.

    A: under 100 words; B: under 80 % of the words are distinct; C: over 10 % of the code points are
    ``[A-Z]``; D: one of ``#$%&*|`` occurs. Null text is empty; it has no words, so it fails A alone.
    ``part`` is the language, the empty string for null.
    """
    base = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    worded = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return worded.select(
        "doc_id",
        "part",
        F.sha2("text", 256).alias("digest"),
        (F.size("words") < 100).alias("A"),
        (F.lit(100) * F.size(F.array_distinct("words")).cast("long") < F.lit(80) * F.size("words").cast("long")).alias("B"),
        (F.lit(100) * upper.cast("long") > F.lit(10) * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts ``n``, ``good`` and ``toxic`` of the documents of each ``(part, A, B, C, D, E)``.

    E: the text is that of a smaller doc_id, anywhere in the table. All that depends on the text
    is equal for equal texts, so each text's rows are counted by part and label before they meet,
    with the smallest doc_id and how many rows carry it; a text that many share is a few rows by then.

    Rows with one doc_id are counted each, and those with the smallest doc_id of a text all pass E.
    A null doc_id is neither smaller nor larger than another: such rows pass E and have no label.
    Of several labels of one doc_id, any 1 counts.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    marks = marks.withColumn("no_id", F.lit(False))
    own = text_flags(docs).withColumn("no_id", F.col("doc_id").isNull())
    # rows without doc_id are spread by their text: they meet no label
    own = own.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))
    marked = own.join(marks, ["key", "no_id"], "left").fillna(0, ["good", "toxic"])
    alike = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    by_id = marked.groupBy("key", "no_id", *alike).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("no_id"), F.col("n")).otherwise(0)).alias("n_no_id"),
        F.min(F.when(~F.col("no_id"), F.struct("key", "n"))).alias("first"),
    )
    by_text = cut(by_text, "texts")
    smallest = by_text.groupBy("digest").agg(F.min("first.key").alias("smallest"))
    lead = F.coalesce(F.when(F.col("first.key") == F.col("smallest"), F.col("first.n")), F.lit(0))
    passes = F.col("n_no_id") + lead
    both = F.array(
        F.struct(F.lit(False).alias("E"), passes.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passes).alias("n"))
    )
    split = by_text.join(smallest, "digest").withColumn("both", F.explode(both))
    return split.groupBy("part", "A", "B", "C", "D", "both.E").agg(
        F.sum("both.n").alias("n"),
        F.sum(F.col("both.n") * F.col("good")).alias("good"),
        F.sum(F.col("both.n") * F.col("toxic")).alias("toxic"),
    )


def _survivors(joint: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Each array of 2^k joint counts by set S, replaced by the sum over T in S of (-1)^|T| J(T): differences, a filter at a time."""
    for bit in (1 << i for i in range(k)):
        joint = joint.withColumns(
            {c: F.expr(f"transform({c}, (x, s) -> IF(s & {bit} > 0, {c}[s - {bit}] - x, x))") for c in columns}
        )
    return joint


def audit(cells: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter does at each place of every order, from ``cells(part, <a flag for each filter>, n, good, toxic)``.

    One aggregate sums, for each of the 2^k sets of filters, the documents that fail all of the
    set: the flags' product times the count. Everything else follows from these joint counts J
    by Moebius inversion, in exact integers, without another look at the data:

    * survivors of a set S: sum over T in S of (-1)^|T| J(T); ``kept`` is that of the filters so
      far, ``removed`` (and ``good_lost``, ``toxic_lost``) the fall from the step before;
    * ``redundant``: J of the step's filter less ``removed``;
    * ``unique_fails``: sum over T that hold the filter of (-1)^(|T|-1) J(T);
    * ``shapley``: the game "documents removed by S" has the Harsanyi dividends (-1)^(|T|-1) J(T);
      each goes in equal shares to the filters of T, times the k! orders.

    One row for each part, order and step; a part's rows are all there even if a filter removes
    nothing. Filters are named by one letter each. No cells, no rows.
    """
    k, everything = len(filters), (1 << len(filters)) - 1
    sums = []
    for joint in ("n", "good", "toxic"):
        for s in range(everything + 1):
            product = F.col(joint)
            for i, name in enumerate(filters):
                if s >> i & 1:
                    product = product * F.col(name).cast("long")
            sums.append(F.sum(product).alias(f"{joint}_{s}"))
    joint_counts = cells.groupBy("part").agg(*sums).select(
        "part", *[F.array(*[F.col(f"{w}_{s}") for s in range(everything + 1)]).alias(w) for w in ("n", "good", "toxic")]
    )
    joint_counts = cut(joint_counts, "joint", small=True)
    left = _survivors(joint_counts.withColumn("joint", F.col("n")), ["n", "good", "toxic"], k)
    sets = F.sequence(F.lit(0), F.lit(everything))

    def dividends(i: int, share: bool) -> Column:
        """The sum of (-1)^(|T|-1) J(T) over the sets T that hold filter i, each as it is or in shares, over all orders."""
        def term(t: Column) -> Column:
            size = F.bit_count(t)
            signed = F.get("joint", t) * F.when(size % 2 == 1, 1).otherwise(-1)
            return signed * (F.lit(len(orders)) / size).cast("long") if share else signed

        holding = F.filter(sets, lambda t: t.bitwiseAND(F.lit(1 << i)) > 0)
        return F.aggregate(F.transform(holding, term), F.lit(0).cast("long"), lambda total, x: total + x)

    orders = ["".join(p) for p in permutations(filters)]
    parts = left.select(
        "part",
        "n",
        "good",
        "toxic",
        F.array(*[F.get("joint", F.lit(1 << i)) for i in range(k)]).alias("own"),
        F.array(*[dividends(i, False) for i in range(k)]).alias("unique"),
        F.array(*[dividends(i, True) for i in range(k)]).alias("share"),
        F.explode(F.array(*map(F.lit, orders))).alias("filter_order"),
    )
    steps = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def mask(prefix: Column) -> Column:
        return sum((F.when(F.instr(prefix, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0))

    order = F.col("filter_order")
    steps = steps.withColumns(
        {
            "before": mask(F.substring(order, F.lit(1), F.col("step") - 1)),
            "after": mask(F.substring(order, F.lit(1), F.col("step"))),
            "at": F.instr(F.lit(filters), F.substring(order, F.col("step"), F.lit(1))) - 1,
        }
    )

    def lost(joint: str) -> Column:
        return F.get(joint, "before") - F.get(joint, "after")

    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("n", "after").alias("kept"),
        lost("n").alias("removed"),
        (F.get("own", "at") - lost("n")).alias("redundant"),
        F.get("unique", "at").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("share", "at").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over ``docs(doc_id, text, lang)``, with ``labels(doc_id, quality, toxic)``.

    Nulls, repeated rows and ids: see ``failure_cells``. Very long texts are read whole. Columns of
    other names are left behind. An empty table of documents gives no rows; empty labels give zeros.
    """
    return audit(failure_cells(docs, labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 100)::INT
         + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (fails & (earlier + bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails & earlier = 0 AND fails & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails & earlier > 0 AND fails & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails & earlier = 0 AND fails & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails & earlier = 0 AND fails & bit > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
