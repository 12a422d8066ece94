"""Intervals and their readers, joint neighbours, and connected communities, on small fixtures."""

import numpy as np
import pytest
from against_sql import same
from pyspark.sql import functions as F

from fluxcell.operators import community, intervals, trees
from fluxcell.plans import model_queries
from fluxcell.sources import tables

PLACE = "chrom string, start long, end long"


def brute_merge(rows, gap):
    out = []
    for c, s, e in sorted(r for r in rows if r[1] is not None and r[2] is not None):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2], out[-1][3] = max(out[-1][2], e), out[-1][3] + 1
        else:
            out.append([c, s, e, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap", [0, 3])
def test_merged_intervals_over_partitions(spark, gap):
    rng = np.random.default_rng(gap)
    rows = [("hot", int(s), int(s + n)) for s, n in zip(rng.integers(0, 4000, 700), rng.integers(0, 9, 700), strict=True)]
    rows += [("hot", 100, 3000), ("b", 1, 2), ("b", 2, 5), ("b", 9, 9), ("b", 9, 9), ("c", None, 4)]
    df = spark.createDataFrame(rows, PLACE).repartition(9)
    assert sorted(tuple(r) for r in intervals.merge_intervals(df, gap).collect()) == brute_merge(rows, gap)
    assert intervals.merge_intervals(df.limit(0)).count() == 0


def test_gene_regions_and_gtf(spark, tmp_path):
    line = lambda c, kind, s, e, strand, attributes: "\t".join([c, "x", kind, str(s), str(e), ".", strand, ".", attributes])
    (tmp_path / "a.gtf").write_text(
        "\n".join(
            [
                "#!genome",
                line("1", "gene", 1001, 2000, "+", 'gene_id "G1"; gene_version "2"; gene_name "ONE";'),
                line("1", "exon", 1001, 1100, "+", 'gene_id "G1"; gene_name "ONE";'),
                line("2", "gene", 51, 90, "-", 'gene_id "G2";'),
                "broken line",
            ]
        )
    )
    genes = tables.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert sorted(tuple(r) for r in genes.collect()) == [("1", "gene", 1000, 2000, "+", "G1", "ONE"), ("2", "gene", 50, 90, "-", "G2", "G2")]
    assert tables.read_gtf(spark, str(tmp_path / "a.gtf"), None).count() == 3
    place = lambda df: {r["gene_id"]: (r["start"], r["end"]) for r in df.collect()}
    assert place(intervals.gene_regions(genes, 200, 10)) == {"G1": (800, 2010), "G2": (40, 290)}
    assert place(intervals.gene_regions(genes, 200, 10, stranded=False)) == {"G1": (800, 2010), "G2": (0, 100)}


def test_links_of_a_repeated_peak_count_by_their_own_place(spark):
    """Peak 1 is annotated to gene A in its body and at distance 2, peak 2 in its body only."""
    annotation = spark.createDataFrame(
        [(9, "A", "promoter", 1), (1, "A", "distal", 0), (1, "A", "distal", 2), (2, "A", "distal", 0)],
        "peak_id long, gene_id string, kind string, distance long",
    )
    links = spark.createDataFrame(
        [(1, "A", "A", "distal", 0.9, 500, 0), (1, "A", "A", "distal", 0.8, 500, 2), (2, "A", "A", "distal", 0.9, 500, 0)],
        "peak_id long, gene_id string, peak_gene string, peak_kind string, correlation double, distance long, peak_distance long",
    )
    roles = lambda df: {(r["peak_id"], r["role"]) for r in df.collect()}
    assert roles(intervals.promoter_enhancer_peaks(annotation, links)) == {(9, "promoter"), (1, "enhancer")}
    assert roles(intervals.promoter_enhancer_peaks(annotation, links.drop("peak_distance"))) == {(9, "promoter")}


def test_aggregate_peaks_with_repeated_peaks_matches_sql(spark):
    same(model_queries.aggregate_peaks(spark, "/root/testdata/sf0.01"), model_queries.SQL["aggregate_peaks"], "/root/testdata/sf0.01")


def test_peak_tables_and_roles(spark, tmp_path):
    six = "chrom\tstart\tend\tgene\tdistance\tpeak_type\n" + "\n".join(
        ["1\t10\t20\tA\t-5\tpromoter", "1\t40\t50\tA\t0\tdistal", "1\t90\t99\tB\t500\tdistal", "2\t5\t9\tB\t1\tpromoter", "2\t70\t75\tC\t9000\tdistal", "2\t80\t85\t\t\tintergenic"]
    )
    four = "peak\tgene\tdistance\tpeak_type\n1_10_20\tA;B\t-5;700\tpromoter;distal\n2_80_85\t\t\t\n"
    (tmp_path / "six.tsv").write_text(six)
    (tmp_path / "four.tsv").write_text(four)
    annotation = tables.read_peak_annotation(spark, str(tmp_path / "six.tsv"))
    assert annotation.count() == 5
    assert sorted(tuple(r) for r in tables.read_peak_annotation(spark, str(tmp_path / "four.tsv")).collect()) == [
        ("1:10-20", "A", "promoter", -5),
        ("1:10-20", "B", "distal", 700),
    ]
    link = lambda a, b, labels, c, d, kind: "\t".join([*a.split("-"), *b.split("-"), labels, str(c), ".", ".", ".", str(d), kind])
    (tmp_path / "link.tsv").write_text(
        "\n".join(
            [
                link("1-10-20", "1-90-99", "<A_promoter><B_distal>", 0.9, 80, "peak-peak"),  # near: an enhancer of A
                link("1-10-20", "1-40-50", "<A_promoter><A_distal>", 0.9, 30, "peak-peak"),  # in the body of A
                link("2-70-75", "2-5-9", "<C_distal><B_promoter>", 0.8, 50_000, "peak-peak"),  # of another gene, and far
                link("2-70-75", "2-5-5", "<C_distal><B>", 0.7, 60, "peak-gene"),  # near B: an enhancer
                link("2-5-5", "1-90-99", "<B><B_distal>", 0.2, 60_000, "gene-peak"),  # too weak
                link("2-9-9", "2-5-9", "<C><B_promoter>", 0.9, 10, "gene-peak"),  # a promoter
            ]
        )
    )
    linkage = tables.read_peak_linkage(spark, str(tmp_path / "link.tsv"))
    assert linkage.count() == 6
    got = {(r["gene_id"], r["peak_id"], r["role"]) for r in intervals.promoter_enhancer_peaks(annotation, linkage).collect()}
    want = {("A", "1:10-20", "promoter"), ("B", "2:5-9", "promoter"), ("A", "1:90-99", "enhancer"), ("B", "2:70-75", "enhancer")}
    assert got == want
    body = {tuple(r) for r in intervals.promoter_enhancer_peaks(annotation, linkage, gene_body=True).collect()}
    assert body == want | {("A", "1:40-50", "body")}


def cliques(*groups):
    return [(i, j) for g in groups for i in g for j in g if i < j]


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in trees.components(spark.createDataFrame(e, "i long, j long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 30: 30, **{100 + i: 100 for i in range(61)}}


def test_refinement_divides_what_moves_leave_in_pieces(spark):
    """Two far cliques start as one community; no single node gains by leaving, so moves alone leave it disconnected."""
    a, b, c = range(0, 6), range(6, 12), range(12, 18)
    df = spark.createDataFrame(cliques(a, b, c) + [(5, 6), (11, 12)], "i long, j long")
    start = spark.createDataFrame([(i, 1 if i in b else 0) for i in range(18)], "node long, label long")
    e = community._both_ways(df)
    total = e.agg(F.sum("w")).first()[0]
    degree = e.groupBy("i").agg(F.sum("w").alias("k")).select(F.col("i").alias("node"), "k").join(start, "node")
    moved, _ = community.local_moves(e, degree.withColumn("label", F.when(F.col("label") == 0, 0).otherwise(6).cast("long")), total, 0, 0)
    label = {r["node"]: r["label"] for r in moved.collect()}
    assert label[0] == label[17] and label[6] != label[0]
    got = {r["node"]: r["label"] for r in community.communities(df, start).collect()}
    assert got == {i: i // 6 * 6 for i in range(18)}
    parts = community.refine(e, moved, total, 0, 0)
    whole = {r["node"]: (r["label"], r["whole"]) for r in parts.collect()}
    for part in {p for p, _ in whole.values()}:
        inside = [i for i in range(18) if whole[i][0] == part]
        assert len({i // 6 for i in inside}) == 1  # the pieces are not joined
    assert community.communities(df.limit(0)).count() == 0
