"""Readers and writers of layer tables: parquet, csv, MatrixMarket, labelled count files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPR = "cell_id long, gene_id string, layer string, value double"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_wide_csv(spark: SparkSession, path: str, layer: str, id_column: str, sep: str = ",") -> DataFrame:
    """A cells x genes csv (header of gene names) as a layer table without zeros."""
    raw = spark.read.csv(path, header=True, sep=sep)
    genes = [c for c in raw.columns if c != id_column]
    long = raw.unpivot([id_column], genes, "gene_id", "value")
    long = long.select(
        F.col(id_column).cast("long").alias("cell_id"), "gene_id", F.lit(layer).alias("layer"), F.col("value").cast("double").alias("value")
    )
    return long.where("value <> 0")


def read_matrix_market(spark: SparkSession, path: str, layer: str, genes: DataFrame | None = None) -> DataFrame:
    """Coordinate format: comments and the size line are skipped; indices become 0-based; ``genes(index, name)``
    names the columns. Splits anywhere, so a large file is read in parallel."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    t = lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(("i", "j", "v"))])
    size = spark.read.text(path).where(~F.col("value").startswith("%")).limit(1)
    first = size.select(F.trim("value").alias("line")).first()
    t = t.where(F.concat_ws(" ", "i", "j", "v") != F.regexp_replace(F.lit(first["line"] if first else ""), r"\s+", " "))
    t = t.select((F.col("i").cast("long") - 1).alias("cell_id"), (F.col("j").cast("long") - 1).alias("index"), F.col("v").cast("double").alias("value"))
    if genes is not None:
        t = t.join(genes, "index").withColumnRenamed("name", "gene_id")
    else:
        t = t.withColumn("gene_id", F.col("index").cast("string"))
    return t.select("cell_id", "gene_id", F.lit(layer).alias("layer"), "value")


def write_matrix_market(x: DataFrame, path: str) -> None:
    """Triplets ``cell gene value`` (1-based numeric ids) as text parts, without the header lines."""
    line = F.concat_ws(" ", (F.col("cell_id") + 1).cast("string"), (F.col("gene_id").cast("long") + 1).cast("string"), F.col("value").cast("string"))
    x.select(line.alias("value")).write.mode("overwrite").text(path)


def split_labeled(total: DataFrame, share: DataFrame) -> DataFrame:
    """Layers new = total * share and old = total * (1 - share) for ``share(cell_id, gene_id, pi)``;
    entries without a share are dropped."""
    j = total.join(share, ["cell_id", "gene_id"]).where("pi is not null and not isnan(pi)")
    layers = F.array(
        F.struct(F.lit("new").alias("layer"), (F.col("value") * F.col("pi")).alias("value")),
        F.struct(F.lit("old").alias("layer"), (F.col("value") * (1 - F.col("pi"))).alias("value")),
    )
    return j.select("cell_id", "gene_id", F.explode(layers).alias("x")).select("cell_id", "gene_id", "x.layer", "x.value")


def outer_merge(tables: list[DataFrame]) -> DataFrame:
    """Per-cell tables ``(gene_id, value)`` with a cell_id column, as one layer table (absent = no row)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def export_ranks(ranks: dict[str, DataFrame], path: str) -> None:
    """One csv folder for each ranking."""
    for name, df in ranks.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def read_gtf(spark: SparkSession, path: str, feature: str | None = "gene") -> DataFrame:
    """``(chrom, feature, start, end, strand, gene_id, name)`` of an annotation file, read as text by Spark.

    Starts count from 0 and ends are exclusive, as in interval tables (the file counts from 1). Comments and lines without nine fields are
    left out; ``name`` falls back to the gene's id. Only lines of ``feature`` are kept, if one is named.
    """
    part = F.split("value", "\t")
    attribute = lambda key: F.nullif(F.regexp_extract(part[8], rf'(?:^|;)\s*{key} "([^"]*)"', 1), F.lit(""))
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(part) == 9))
    if feature is not None:
        lines = lines.where(part[2] == feature)
    return lines.select(
        part[0].alias("chrom"),
        part[2].alias("feature"),
        (part[3].cast("long") - 1).alias("start"),
        part[4].cast("long").alias("end"),
        part[6].alias("strand"),
        attribute("gene_id").alias("gene_id"),
        F.coalesce(attribute("gene_name"), attribute("gene_id")).alias("name"),
    )


def read_peak_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``(peak_id, gene_id, kind, distance)`` of a peak annotation table with a header, of four columns (peak, genes, distances, kinds, each list
    joined by semicolons) or six (chrom, start, end, gene, distance, kind). Peaks are named ``chrom:start-end``."""
    raw = spark.read.csv(path, sep="\t", header=True)
    c = raw.columns
    if len(c) == 6:
        peak = F.concat(F.col(c[0]), F.lit(":"), F.col(c[1]), F.lit("-"), F.col(c[2]))
        out = raw.select(peak.alias("peak_id"), F.col(c[3]).alias("gene_id"), F.col(c[5]).alias("kind"), F.col(c[4]).cast("long").alias("distance"))
    elif len(c) == 4:
        peak = F.regexp_replace(c[0], r"^(.*)_([0-9]+)_([0-9]+)$", "$1:$2-$3")
        lists = F.arrays_zip(F.split(c[1], ";").alias("gene"), F.split(c[2], ";").alias("distance"), F.split(c[3], ";").alias("kind"))
        each = raw.where(F.col(c[1]).isNotNull()).select(peak.alias("peak_id"), F.explode(lists).alias("a"))
        out = each.select("peak_id", F.col("a.gene").alias("gene_id"), F.col("a.kind").alias("kind"), F.col("a.distance").cast("long").alias("distance"))
    else:
        raise ValueError(f"a peak annotation has 4 or 6 columns, not {len(c)}")
    return out.where("gene_id is not null and gene_id <> ''")


def read_peak_linkage(spark: SparkSession, path: str) -> DataFrame:
    """``(peak_id, gene_id, peak_gene, peak_kind, correlation, distance)`` of a linkage table without header: two places, ``<labels><labels>`` (gene_kind or
    gene, joined by semicolons), the correlation in the 8th column, the distance in the 12th, the sort of link in the 13th.

    A peak-peak link counts for the gene of the one side that is a promoter, and its other side's peak.
    """
    part = F.split("value", "\t")
    place = lambda n: F.concat(part[n], F.lit(":"), part[n + 1], F.lit("-"), part[n + 2])
    sides = F.regexp_extract(part[6], "^<(.*)><(.*)>$", 1), F.regexp_extract(part[6], "^<(.*)><(.*)>$", 2)
    raw = spark.read.text(path).where(F.size(part) >= 13).select(
        place(0).alias("p0"), place(3).alias("p1"), F.split(sides[0], ";").alias("l0"), F.split(sides[1], ";").alias("l1"),
        part[7].cast("double").alias("correlation"), part[11].cast("double").alias("distance"), part[12].alias("sort"),
    )
    raw = raw.withColumn("a", F.explode("l0")).withColumn("b", F.explode("l1"))
    gene = lambda c: F.regexp_extract(c, "^(.*?)(?:_(promoter|distal))?$", 1)
    kind = lambda c: F.regexp_extract(c, "^(.*?)(?:_(promoter|distal))?$", 2)

    def link(rows: DataFrame, peak: str, of: str, to: str) -> DataFrame:
        return rows.select(F.col(peak).alias("peak_id"), gene(to).alias("gene_id"), gene(of).alias("peak_gene"), kind(of).alias("peak_kind"), "correlation", "distance")

    pair = raw.where("sort = 'peak-peak'")
    first, second = kind("a") == "promoter", kind("b") == "promoter"
    out = link(pair.where(first & ~second), "p1", "b", "a").unionByName(link(pair.where(second & ~first), "p0", "a", "b"))
    out = out.unionByName(link(raw.where("sort = 'peak-gene'"), "p0", "a", "b"))
    return out.unionByName(link(raw.where("sort = 'gene-peak'"), "p1", "b", "a"))
