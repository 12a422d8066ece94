"""Helpers shared by the corpus operators: tables, lineage cuts, components, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, by application.

    Only in a local session that doesn't name one (a test) is a temporary folder used; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="fluxcell-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{app}"


def cut(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost a re-read.

    ``small``: a table with few bytes a row of input, put in a 64th as many files. The tables
    belong to the application's own subfolder and may be removed when it has ended.
    """
    if small:
        df = df.coalesce(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64))
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query has shuffled is removed when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds; each minimum is a map-side-combined aggregate
    and is written before it is joined, so the join has two plain exchanges and a hub's rows can
    be split. Nodes without an edge to another node are absent. Null ends are ignored.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and u <> v")
        .distinct()
    )
    e = cut(e, "edges", small=True)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large", small=True)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large-star", small=True)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "small", small=True)
        small = large.join(low, "u")
        e2 = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = cut(e2.distinct(), "small-star", small=True)
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi")
        many = e.groupBy("u").count().where("count > 1")
        if inner.isEmpty() and many.isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


class Forest:
    """Union-find that keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection with good avalanche)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, by way of joined digests: faster than integers one by one."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one value at a time."""
    for x in column.cast(pa.binary()):
        yield x.as_py()


def rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes, to bound what a step makes of one."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        step = max(1, min(n, int(n * most / max(1, col.nbytes))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def lean(run):
    """A ``mapInArrow`` function that gives memory it has freed back to the system when a task ends.

    Python workers outlive their tasks and stages; without this, each keeps the most it ever used.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` plus, for each ``new: column`` of ``sums``, the sum of ``column`` over earlier rows of the same keys.

    A prefix sum that no key can turn into one task: rows are range-partitioned by keys and order,
    written, and summed within a partition; what earlier partitions hold of a key (one row for
    each key and partition) is added. Fully equal rows may take each other's places. Keys may be null.
    """
    at = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    at = cut(at, name)
    part = at.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut(
        part.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            F.col("__part").alias("__p"),
            *[F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__{new}") for new in sums],
        ),
        f"{name}-carry",
        small=True,
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return at.join(carry, same).select(
        *df.columns,
        *[
            (F.col(f"__{new}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(new)
            for new, c in sums.items()
        ],
    )


COUNTS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
CHUNK = 1 << 13


def count_rows(counts: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's count vector as rows of ``COUNTS``, cut so that no group of parts grows large."""
    pieces = counts.astype(np.int64).reshape(-1, min(CHUNK, len(counts)))
    data = {"chunk": range(len(pieces)), "part": [part % 64] * len(pieces), "counts": [p.tobytes() for p in pieces]}
    return rows(data, COUNTS)


def total_counts(df: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' count vectors of one size; what reaches the driver is one such vector."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        first = {"chunk": t.column("chunk")[:1].to_pylist(), "part": [0], "counts": [total.tobytes()]}
        return pa.Table.from_batches([rows(first, COUNTS)])

    kind = "chunk int, part int, counts binary"
    with shuffles_removed(df.sparkSession):
        some = df.groupBy("chunk", "part").applyInArrow(add, kind)
        got = some.groupBy("chunk").applyInArrow(add, kind).collect()
    parts = [np.frombuffer(r["counts"], np.int64) for r in sorted(got, key=lambda r: r["chunk"])]
    return np.concatenate(parts) if parts else np.zeros(size, np.int64)


def kth_largest(df: DataFrame, column: str, k: int, most: int = 10_000) -> float:
    """The k-th largest value, by counting in ever narrower bins; at most ``most`` values reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0  # values over ``high``
    while True:
        inside = df.where(F.col(column).between(low, high))
        if low == high or inside.count() <= most:
            values = sorted((r[0] for r in inside.select(column).take(most)), reverse=True) if low < high else []
            return values[k - above - 1] if values else low
        width = (high - low) / 1024
        binned = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).alias("b"))
        for r in sorted(
            binned.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(),
            key=lambda r: -r["b"],
        ):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
