"""Line dedup: lines repeated across documents are dropped, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, table


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    stripped = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are exploded and reduced to a 128-bit hash of their key; the hash is grouped to the
    number of distinct documents and the largest doc_id. Lines of at least ``min_chars`` code
    points found in at least ``min_docs`` documents go from every document but the largest.
    The positions to drop return to their document, whose text is joined again from what lies
    between them. The grouped hashes are written before they are joined. Only hashes and positions are shuffled by key, and partial aggregates carry a
    hot line, so no task gathers its occurrences.

    Null or empty text: one empty line, kept. Very long texts are split whole, and only hashes of their lines travel. Rows with null doc_id keep all lines and count for
    no other. Repeated rows of one doc_id are one document when documents are counted; each
    row keeps its own text. Other columns pass through; those named like the new ones are
    replaced. An empty table gives an empty table.
    """
    drop = [c for c in ("n_lines", "n_dropped", "kept_text") if c in docs.columns]
    docs = docs.drop(*drop)
    full = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("__t"), full.alias("__full")).where("doc_id is not null")
    lines = base.select("doc_id", "__t", F.posexplode(F.split("__full", "\n", -1)).alias("__pos", "__line"))
    lines = lines.select("doc_id", "__t", "__pos", line_key(F.col("__line")).alias("__key"))
    lines = lines.where(F.length("__key") >= min_chars).select(
        "doc_id", "__t", "__pos", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit("second"), "__key").alias("__g")
    )
    held = cut(
        lines.groupBy("__h", "__g", "doc_id")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__h", "__g")
        .agg(F.count("*").alias("__n"), F.max("doc_id").alias("__last"))
        .where(F.col("__n") >= min_docs)
        .select("__h", "__g", "__last"),
        "lines",
    )
    gone = (
        lines.join(held, ["__h", "__g"])
        .where(F.col("doc_id") != F.col("__last"))
        .groupBy(F.col("doc_id").alias("__d"), "__t")
        .agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))
    )
    out = docs.join(gone, (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left").select(
        *docs.columns,
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__lines"),
        F.coalesce("__gone", F.array().cast("array<int>")).alias("__gone"),
    )
    # what lies between dropped positions, so that the cost stays linear in the lines
    cuts = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__lines")))
    kept = F.expr(
        "flatten(transform(sequence(0, size(__cuts) - 2),"
        " i -> slice(__lines, __cuts[i] + 2, __cuts[i + 1] - __cuts[i] - 1)))"
    )
    return (
        out.withColumn("__cuts", cuts)
        .withColumns(
            {
                "n_lines": F.size("__lines").cast("long"),
                "n_dropped": F.size("__gone").cast("long"),
                "kept_text": F.when(F.size("__gone") == 0, F.coalesce("text", F.lit(""))).otherwise(
                    F.array_join(kept, "\n")
                ),
            }
        )
        .drop("__lines", "__gone", "__cuts")
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), held AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT keyed.*, held.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
