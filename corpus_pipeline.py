"""A corpus from raw documents: quality, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, table
from fluxcell.llm.line_dedup import line_dedup
from fluxcell.llm.mixing import WORD, mix
from fluxcell.llm.ngram_join import similar_documents
from fluxcell.llm.pieces import encode
from fluxcell.llm.quality import resample_quality

PIECES_BLOCK = 14_000_000  # smaller than alone: executors hold what earlier stages used as well
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the importance resampling draws, by doc_id (which may be null) and text.

    Null or blank text has no n-grams, so no evidence speaks against it; very long texts are counted whole. Rows with equal
    doc_id and text are drawn or not together; columns of other names are left behind. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    rated = resample_quality(docs, table(spark, sf_dir, "labels")).where("not kept")
    gone = rated.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines repeated across documents; a document left without any line goes.

    Null or empty text is one empty line, which stays. Rows without doc_id, repeated rows, empty
    tables and clashing names are treated as ``line_dedup`` does; texts of any length are split whole.
    """
    docs = docs.select(*COLUMNS)
    out = line_dedup(docs).where("n_dropped < n_lines")
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": n}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, then the smallest hash of its text.

    Rows without doc_id come after all others. Of rows with equal doc_id and text one stays.
    Texts without words (null, empty) are in no group, so only such repeats of them go. Very long texts are compared whole;
    columns of other names are left behind. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    found = cut(similar_documents(docs), "similar")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.where("n_shingles > 0").groupBy("class_h", "class_g").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    first = cut(first.where("first <> last").select(F.col("class_h").alias("h"), F.col("class_g").alias("g"), "first"), "first")
    same = (F.col("class_h") == F.col("h")) & (F.col("class_g") == F.col("g"))
    gone = found.where("n_shingles > 0").join(first, same).where(row != F.col("first"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    here = docs.withColumn("text_hash", F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    rest = here.join(gone, match, "left_anti")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    again = cut(again.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "repeated")
    if not again.isEmpty():
        rest = rest.join(again, match, "left_anti").unionByName(
            rest.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"])
        )
    return rest.select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's words: of each document one row for the words drawn at all, one more for those
    drawn twice, and one for those drawn three times. Words of a row are joined by spaces where
    something between them isn't drawn, else by the white space of the text.

    Null source is a source of its own. Texts without words are never drawn. Rows with one doc_id, or
    none, and repeated rows are drawn each; very long texts are drawn by blocks. Without any words the mix is empty. Columns
    of other names are left behind.
    """
    docs = docs.select(*COLUMNS)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.withColumns({"size": size, "rid": F.monotonically_increasing_id()}), "sized")
    _, drawn = mix(sized.select("rid", "doc_id", "source", "size"))
    drawn = drawn.groupBy("rid", "copy").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    drawn = drawn.groupBy("rid").agg(F.collect_list("spans").alias("copies"))  # at most three
    rows = sized.join(drawn, "rid").withColumn("spans", F.explode("copies"))
    # a word with the white space before it, so that neighbours rejoin as they stood
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.expr(
        """array_join(transform(spans, (s, i) ->
             CASE WHEN i > 0 AND spans[i - 1].hi = s.lo THEN array_join(slice(words, int(s.lo) + 1, int(s.hi - s.lo)), '')
             ELSE concat(IF(i > 0, ' ', ''), ltrim(' \\t\\n\\u000b\\f\\r',
                         array_join(slice(words, int(s.lo) + 1, int(s.hi - s.lo)), ''))) END), '')"""
    )
    whole = (F.size("spans") > 0) & (F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]) == F.col("size"))
    rows = rows.withColumn("words", words).withColumn("text", F.when(whole, F.col("text")).otherwise(text))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as piece ids: one row for each of its rows, with the ids that decode to its text.

    Null and empty text has no ids; rows without doc_id and repeated rows are encoded each, texts of any length whole.
    Columns of other names are left behind. An empty table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    return encode(docs, block_chars=PIECES_BLOCK)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]

ORACLE_SQL = None  # sampling, shingle sets and piece lattices have no SQL of equal meaning


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
