"""Queries over count matrices: quality control, normalisation, gene statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxcell.functions import scalars as S
from fluxcell.operators import matrix, normalize, qc, select
from fluxcell.plans import bindings as B

QUERIES, SQL = {}, {}


def query(sql: str | None = None, prefix: str = B.COUNTS_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {prefix.strip()}\n{sql}"
        return f

    return add


def r(name: str, alias: str | None = None, digits: int = 6):
    return F.round(F.col(name), digits).alias(alias or name)


@query("SELECT cell_id, gene_id, value FROM e WHERE layer = 'spliced'")
def layer_select(spark, d):
    return matrix.layer(B.counts(spark, d), "spliced").select("cell_id", "gene_id", "value")


@query(
    """SELECT cell_id, count(*) FILTER (WHERE value > 0) AS n_genes, sum(value) AS n_counts, 0.0::DOUBLE AS p_mito
    FROM x GROUP BY cell_id"""
)
def basic_stats_cells(spark, d):
    return qc.cell_stats(B.total_layer(B.counts(spark, d)))


@query(
    "SELECT gene_id, count(*) FILTER (WHERE value > 0) AS n_cells, sum(value) AS n_counts FROM x GROUP BY gene_id",
    B.SPARSE_SQL,
)
def basic_stats_genes(spark, d):
    return qc.gene_stats(B.total_layer(B.sparse_counts(spark, d)))


@query(
    """, c AS (SELECT cell_id, count(*) FILTER (WHERE layer = 'spliced' AND value > 0) AS s,
    count(*) FILTER (WHERE layer = 'unspliced' AND value > 0) AS u FROM e GROUP BY cell_id)
    SELECT cell_id, s BETWEEN 250 AND 320 AND u BETWEEN 200 AND 320 AS kept FROM c""",
    B.SPARSE_SQL,
)
def filter_cells_by_outliers(spark, d):
    limits = {"spliced": (250, 320), "unspliced": (200, 320)}
    return qc.filter_cells_by_outliers(B.sparse_counts(spark, d), limits)


@query(
    """, one AS (
      SELECT gene_id, count(*) FILTER (WHERE value > 0) AS c, sum(value) AS s FROM x GROUP BY gene_id
    ), pairs AS (
      SELECT cell_id, gene_id, sum(value) AS v FROM e WHERE value > 0 GROUP BY ALL HAVING count(DISTINCT layer) = 2
    ), shared AS (SELECT gene_id, sum(v) AS shared FROM pairs GROUP BY gene_id)
    SELECT gene_id, c >= 20 AND s / n_cells BETWEEN 5 AND 9 AND s >= 500 AND coalesce(shared, 0) >= 30 AS kept
    FROM one CROSS JOIN n LEFT JOIN shared USING (gene_id)""",
    B.SPARSE_SQL,
)
def filter_genes_by_outliers(spark, d):
    expr = matrix.with_total(B.sparse_counts(spark, d))
    limits = {"X": {"min_cell": 20, "min_avg": 5, "max_avg": 9, "min_count": 500}}
    return qc.filter_genes_by_outliers(expr, B.n_cells(spark, d), limits, (B.LAYERS, 30.0))


@query(
    """, c AS (SELECT s_suppkey AS cell_id, s_nationkey AS grp FROM supplier),
    sizes AS (SELECT grp, count(*) AS k FROM c GROUP BY grp),
    s AS (SELECT gene_id, layer, grp, sum(value) AS s FROM e JOIN c USING (cell_id) GROUP BY ALL),
    m AS (SELECT gene_id, layer, max(CASE WHEN k > 3 THEN s / k END) AS top FROM s JOIN sizes USING (grp) GROUP BY ALL),
    t AS (SELECT gene_id, layer, sum(s) AS s_all FROM s GROUP BY ALL),
    b AS (SELECT gene_id, layer, coalesce(greatest(top, CASE WHEN (SELECT min(k) FROM sizes) <= 3
          THEN s_all / n_cells END), 0) AS best FROM t LEFT JOIN m USING (gene_id, layer) CROSS JOIN n)
    SELECT gene_id, count(*) FILTER (WHERE best > CASE layer WHEN 'spliced' THEN 8.0 ELSE 7.0 END) = 2 AS kept
    FROM b GROUP BY gene_id""",
    B.SPARSE_SQL,
)
def filter_genes_by_clusters(spark, d):
    return qc.filter_genes_by_clusters(
        B.sparse_counts(spark, d), B.cells(spark, d), {"spliced": 8.0, "unspliced": 7.0}, small=3
    )


@query(
    """SELECT p_partkey AS gene_id, NOT (p_name LIKE 'a%' OR p_name LIKE 'Part#1%' OR p_name LIKE 's%') AS kept FROM part"""
)
def filter_genes_by_pattern(spark, d):
    genes = B.table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), "p_name")
    return qc.filter_genes_by_pattern(genes, ["a", "Part#1", "s"], "p_name")


@query(
    """, gs AS (SELECT gene_id, sum(value) AS s FROM x GROUP BY gene_id), vg AS (SELECT gene_id FROM gs WHERE s > 1.5 * (SELECT avg(s) FROM gs))
    SELECT s_suppkey AS cell_id, s_nationkey::VARCHAR AS grp FROM supplier
    WHERE s_suppkey IN (SELECT cell_id FROM x WHERE gene_id IN (FROM vg) GROUP BY cell_id HAVING sum(value) <> 0)""",
    B.SPARSE_SQL,
)
def filter_cells_by_variable_genes(spark, d):
    x = B.total_layer(B.sparse_counts(spark, d))
    s = x.groupBy("gene_id").agg(F.sum("value").alias("s"))
    high = s.crossJoin(F.broadcast(s.agg(F.avg("s").alias("m")))).where("s > 1.5 * m").select("gene_id")
    return qc.filter_cells_by_variable_genes(x, B.cells(spark, d), high)


@query(
    """, t AS (SELECT cell_id, sum(value) AS v FROM x GROUP BY cell_id),
    q AS (SELECT quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.9) AS b FROM t)
    SELECT cell_id, v AS n_counts FROM t CROSS JOIN q WHERE v BETWEEN a AND b"""
)
def filter_cells_by_quantile(spark, d):
    t = B.total_layer(B.counts(spark, d)).groupBy("cell_id").agg(F.sum("value").alias("n_counts"))
    return qc.filter_cells_by_quantile(t, "n_counts", 0.1, 0.9)


@query(
    """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
    WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 5000) AND NOT c_nationkey < 5"""
)
def predicate_select(spark, d):
    c = B.table(spark, d, "customer")
    either = matrix.any_of([matrix.compare("c_mktsegment", "==", "BUILDING"), matrix.compare("c_acctbal", ">", 5000)])
    return c.where(matrix.all_of([either, ~matrix.compare("c_nationkey", "<", 5)])).select(
        "c_custkey", "c_mktsegment", "c_nationkey"
    )


@query("SELECT s_suppkey AS cell_id, s_nationkey::VARCHAR AS grp FROM supplier WHERE s_nationkey IN (1, 3, 7)")
def select_cells(spark, d):
    return matrix.select_cells(B.cells(spark, d), {"grp": ["1", "3", "7"]})


@query(
    """, parts AS (
      SELECT 0 AS p, cell_id, gene_id, layer, value FROM e WHERE layer = 'spliced'
      UNION ALL SELECT 1, cell_id, gene_id, layer, value FROM e WHERE layer = 'unspliced'
    ), c AS (SELECT cell_id FROM parts GROUP BY cell_id HAVING count(DISTINCT p) = 2),
    gs AS (SELECT gene_id FROM parts GROUP BY gene_id HAVING count(DISTINCT p) = 2)
    SELECT cell_id, gene_id, layer, sum(value) AS value FROM parts
    WHERE cell_id IN (FROM c) AND gene_id IN (FROM gs) GROUP BY ALL""",
    B.SPARSE_SQL,
)
def aggregate_datasets(spark, d):
    e = B.sparse_counts(spark, d)
    return matrix.aggregate_datasets([e.where("layer = 'spliced'"), e.where("layer = 'unspliced'")])


_TOTALS = """, t AS (SELECT s_suppkey AS cell_id, CASE WHEN coalesce(sum(value), 0) = 0 THEN 1.0 ELSE sum(value) END AS t
  FROM supplier LEFT JOIN x ON cell_id = s_suppkey GROUP BY ALL)"""


@query(_TOTALS + " SELECT cell_id, round(t / (SELECT median(t) FROM t), 6) AS size_factor FROM t")
def size_factor_median(spark, d):
    f = normalize.size_factors(B.total_layer(B.counts(spark, d)), B.cells(spark, d))
    return f.select("cell_id", r("size_factor"))


@query(_TOTALS + " SELECT cell_id, round(t / (SELECT exp(avg(ln(t))) FROM t), 6) AS size_factor FROM t")
def size_factor_geometric(spark, d):
    f = normalize.size_factors(B.total_layer(B.counts(spark, d)), B.cells(spark, d), "geometric")
    return f.select("cell_id", r("size_factor"))


@query(
    _TOTALS
    + """ SELECT e.cell_id, gene_id, layer, round(value / (t / (SELECT median(t) FROM t)), 6) AS value
    FROM e JOIN t USING (cell_id)"""
)
def normalize_counts(spark, d):
    e = B.counts(spark, d)
    f = normalize.size_factors(B.total_layer(e), B.cells(spark, d))
    return normalize.normalize(e, f).select("cell_id", "gene_id", "layer", r("value"))


_PF = """, t AS (SELECT cell_id, sum(value) AS t FROM x GROUP BY cell_id),
  pf AS (SELECT x.cell_id, gene_id, value * (SELECT sum(t) / max(n_cells) FROM t CROSS JOIN n) / t AS value
         FROM x JOIN t USING (cell_id))"""


@query(_PF + " SELECT cell_id, gene_id, round(value, 4) AS value FROM pf")
def proportional_fitting(spark, d):
    x = B.total_layer(B.counts(spark, d))
    return normalize.proportional_fit(x, B.n_cells(spark, d)).select("cell_id", "gene_id", r("value", digits=4))


@query(
    _PF
    + """, l AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM pf),
    lt AS (SELECT cell_id, sum(value) AS t FROM l GROUP BY cell_id)
    SELECT l.cell_id, gene_id, round(value * (SELECT sum(t) / max(n_cells) FROM lt CROSS JOIN n) / t, 6) AS value
    FROM l JOIN lt USING (cell_id)"""
)
def pf_log_pf(spark, d):
    return normalize.pf_log_pf(B.total_layer(B.counts(spark, d)), B.n_cells(spark, d)).select(
        "cell_id", "gene_id", r("value")
    )


@query(
    """, l AS (SELECT gene_id, sum(ln(1 + value)) AS l FROM x WHERE value > 0 GROUP BY gene_id)
    SELECT cell_id, gene_id, round(ln(1 + value / exp(l / n_cells)), 6) AS value FROM x JOIN l USING (gene_id) CROSS JOIN n"""
)
def centered_log_ratio(spark, d):
    x = B.total_layer(B.counts(spark, d))
    return normalize.centered_log_ratio(x, B.n_cells(spark, d)).select("cell_id", "gene_id", r("value"))


@query(
    """, c AS (SELECT cell_id, sum(value) AS ct FROM x GROUP BY ALL), f AS (SELECT gene_id, sum(value) AS ft FROM x GROUP BY ALL)
    SELECT cell_id, gene_id, round(ln(1 + value / ct * ln(1 + n_cells / ft) * 1e4), 6) AS value
    FROM x JOIN c USING (cell_id) JOIN f USING (gene_id) CROSS JOIN n""",
    B.SPARSE_SQL,
)
def tf_idf(spark, d):
    x = B.total_layer(B.sparse_counts(spark, d))
    return normalize.tf_idf(x, B.n_cells(spark, d)).select("cell_id", "gene_id", r("value"))


@query(
    """SELECT cell_id, gene_id, round(ln(1 + value), 6) AS log1p, round(ln(value + 0.5) / ln(2), 6) AS log2,
    round(sqrt(value) + sqrt(value + 1), 6) AS ft,
    round(pow(((sqrt(value) + sqrt(value + 1)) ** 2 - 1) / (2 * (sqrt(value) + sqrt(value + 1))), 2), 4) AS back,
    round(asinh(sqrt(0.1 * value)) / sqrt(0.1), 6) AS nb FROM x"""
)
def variance_stabilising(spark, d):
    v = F.col("value")
    return B.total_layer(B.counts(spark, d)).select(
        "cell_id",
        "gene_id",
        F.round(S.log_pseudo(v), 6).alias("log1p"),
        F.round(S.log_pseudo(v, 0.5, 2), 6).alias("log2"),
        F.round(S.freeman_tukey(v), 6).alias("ft"),
        F.round(S.freeman_tukey_inverse(S.freeman_tukey(v)), 4).alias("back"),
        F.round(S.nb_stabilised(v, 0.1), 6).alias("nb"),
    )


_MV = """, s AS (SELECT gene_id, sum(value) AS s, sum(value * value) AS q, max(n_cells) AS n FROM x CROSS JOIN n GROUP BY gene_id),
  mv AS (SELECT gene_id, s / n AS mean, q / n - (s / n) ** 2 AS pop, (q / n - (s / n) ** 2) * n / (n - 1) AS variance FROM s)"""


@query(_MV + " SELECT gene_id, round(mean, 6) AS mean, round(variance, 4) AS variance FROM mv", B.SPARSE_SQL)
def mean_variance(spark, d):
    m = select.mean_variance(B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d))
    return m.select("gene_id", r("mean"), r("variance", digits=4))


@query(
    _MV
    + """ SELECT gene_id, round(CASE WHEN mean > 0 THEN log2(mean) ELSE 0 END, 6) AS log_m,
    round(CASE WHEN pop > 0 THEN log2(sqrt(pop) / mean) ELSE 0 END, 6) AS log_cv FROM mv""",
    B.SPARSE_SQL,
)
def log_mean_cv(spark, d):
    m = select.log_mean_cv(B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d))
    return m.select("gene_id", r("log_m"), r("log_cv"))


@query(
    _MV
    + """, b AS (SELECT gene_id, ln(1 + mean) AS m, CASE WHEN variance > 0 AND mean > 0 THEN ln(variance / mean) END AS d FROM mv),
    lim AS (SELECT min(m) AS lo, max(m) AS hi FROM b),
    bb AS (SELECT gene_id, m, d, greatest(1, ceil((m - lo) / ((hi - lo) / 20))) AS bin FROM b CROSS JOIN lim),
    z AS (SELECT bin, avg(d) AS bm, stddev_samp(d) AS bs FROM bb GROUP BY bin),
    sc AS (SELECT gene_id, m, d, CASE WHEN bs IS NULL THEN d / bm WHEN bs = 0 THEN NULL ELSE (d - bm) / bs END AS score
           FROM bb JOIN z USING (bin)),
    cut AS (SELECT min(score) AS cut FROM (SELECT score FROM sc ORDER BY score DESC NULLS LAST LIMIT 200))
    SELECT gene_id, round(m, 6) AS mean, round(d, 6) AS dispersion, round(score, 6) AS score,
    coalesce(score >= cut, false) AS selected FROM sc CROSS JOIN cut""",
    B.SPARSE_SQL,
)
def seurat_dispersion(spark, d):
    m = select.mean_variance(B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d))
    s = select.seurat_dispersion(m, n_top=200)
    return s.select("gene_id", r("mean"), r("dispersion"), r("score"), "selected")


@query(
    _MV
    + """, f AS (SELECT gene_id, mean, pop / mean AS fano, pop FROM mv WHERE mean > 0),
    a AS (SELECT min(sqrt(pop) / mean) AS a FROM (SELECT * FROM f ORDER BY mean DESC, gene_id LIMIT 20)),
    q AS (SELECT quantile_cont(mean, 0.1) AS m0, quantile_cont(mean, 0.9) AS m1, quantile_cont(fano, 0.1) AS f0,
          quantile_cont(fano, 0.9) AS f1 FROM f),
    box AS (SELECT sqrt(median(fano)) AS b, 1 + stddev_pop(fano) AS t FROM f CROSS JOIN q
            WHERE mean BETWEEN m0 AND m1 AND fano BETWEEN f0 AND f1)
    SELECT gene_id, round(fano, 6) AS fano, round(a * a * mean + b * b, 6) AS expected,
    fano / (a * a * mean + b * b) > t AS selected FROM f CROSS JOIN a CROSS JOIN box""",
    B.SPARSE_SQL,
)
def fano_selection(spark, d):
    x, n = B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d)
    m = select.mean_variance(x, n).crossJoin(n).withColumn("variance", F.col("variance") * (F.col("n_cells") - 1) / F.col("n_cells"))
    return select.fano_selection(m.drop("n_cells")).select("gene_id", r("fano"), r("expected"), "selected")


@query(
    """, dx AS (SELECT s_suppkey AS cell_id, gs.gene_id, coalesce(value, 0) AS v FROM supplier
      CROSS JOIN (SELECT DISTINCT gene_id FROM x) gs LEFT JOIN x ON x.cell_id = s_suppkey AND x.gene_id = gs.gene_id),
    v AS (SELECT gene_id, v - (SELECT min(v) FROM dx) + 1e-7 AS v, row_number() OVER (PARTITION BY gene_id ORDER BY v, cell_id) AS i,
          count(*) OVER (PARTITION BY gene_id) AS n FROM dx)
    SELECT gene_id, round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini FROM v GROUP BY gene_id""",
    B.SPARSE_SQL,
)
def gini_by_gene(spark, d):
    return select.gini(B.total_layer(B.sparse_counts(spark, d)), B.n_cells(spark, d)).select("gene_id", r("gini"))


@query("SELECT cell_id, round(sum(unspliced) / sum(spliced + unspliced), 6) AS ntr FROM w GROUP BY cell_id")
def ntr_by_cell(spark, d):
    w = matrix.wide(B.counts(spark, d), B.LAYERS).withColumn("total", F.col("spliced") + F.col("unspliced"))
    return select.new_to_total(w, "cell_id", "unspliced", "total").select("cell_id", r("ntr"))


@query("SELECT gene_id, round(sum(new) / sum(total), 6) AS ntr FROM lab GROUP BY gene_id", B.LABELED_SQL)
def ntr_by_gene(spark, d):
    return select.new_to_total(B.labeled(spark, d), "gene_id", "new", "total").select("gene_id", r("ntr"))


@query("SELECT gene_id, round(sum(value) / (SELECT sum(value) FROM x), 9) AS frac FROM x GROUP BY gene_id", B.SPARSE_SQL)
def gene_fraction(spark, d):
    return select.gene_fraction(B.total_layer(B.sparse_counts(spark, d))).select("gene_id", r("frac", digits=9))


@query(
    """, top AS (SELECT gene_id, row_number() OVER (ORDER BY sum(value) DESC, gene_id) AS rank FROM x GROUP BY gene_id
    QUALIFY rank <= 30), c AS (SELECT cell_id, sum(value) AS t FROM x GROUP BY cell_id)
    SELECT cell_id, gene_id, rank::INTEGER AS rank, round(value / t, 6) AS fraction FROM x JOIN top USING (gene_id) JOIN c USING (cell_id)""",
    B.SPARSE_SQL,
)
def highest_fraction_genes(spark, d):
    return select.highest_fraction_genes(B.total_layer(B.sparse_counts(spark, d))).select(
        "cell_id", "gene_id", "rank", r("fraction")
    )
