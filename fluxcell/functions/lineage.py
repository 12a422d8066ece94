"""Lineage cuts by tables in the folder that the cluster names, and quantiles of whole columns."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that driver and executors share (``spark.checkpoint.dir``, by application) and read back.

    Lost executors then cost a re-read, and later plans start from the table. A temporary folder is
    used only in a local session where that setting is absent.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="fluxcell-")
        base = _LOCAL[sc.applicationId]
    path = f"{base.rstrip('/')}/{sc.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """``df`` plus its rows' numbers from 0 in the order of the distinct values of ``key``: counted by range partitions."""
    at = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    at = cut(at)
    part = F.shiftright("__at", 33).alias("__part")
    n = sorted(at.groupBy(part).count().collect())  # a row for each partition
    if not n:
        return at.select(*df.columns, F.col("__at").alias(name))
    before, rows = 0, []
    for p, count in n:
        rows.append((p, before))
        before += count
    start = df.sparkSession.createDataFrame(rows, "__part long, __start long")
    at = at.withColumn("__part", part).join(F.broadcast(start), "__part")
    return at.select(*df.columns, (F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__start")).alias(name))


def order_statistics(df: DataFrame, column: str, k: int, most: int = 10_000) -> tuple[float, float]:
    """The k-th and the next smallest value (from 0; of the largest, itself) of a column of doubles without nulls, by counting in ever
    narrower bins; at most ``most`` values reach the driver."""
    few = df.select(column).limit(most + 1).collect()
    if len(few) <= most:
        values = sorted(r[0] for r in few)
        return values[k], values[min(k + 1, len(values) - 1)]
    low, high = df.agg(F.min(column), F.max(column)).first()
    below, after = 0, None  # values under ``low``; the least over ``high``
    while low < high:
        inside = df.where(F.col(column).between(low, high))
        values = inside.select(column).limit(most + 1).collect()
        if len(values) <= most:
            values = sorted(r[0] for r in values)
            at = k - below
            return values[at], values[at + 1] if at + 1 < len(values) else values[at] if after is None else after
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / ((high - low) / 1024)), F.lit(1023)).alias("b"))
        bins = bins.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        rows = sorted(bins.collect(), key=lambda b: b["b"])  # 1024 rows at most
        for b, more in zip(rows, [*rows[1:], None], strict=True):
            if below + b["n"] > k:
                low, high = b["lo"], b["hi"]
                after = after if more is None else more["lo"]
                break
            below += b["n"]
    n = df.where(F.col(column) == low).count()
    return low, low if below + n > k + 1 or after is None else after


def column_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The q-quantile of a column's values, interpolated linearly; null where there are none. ``df`` should be a written table."""
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = x.count()
    if not n:
        return None
    at = q * (n - 1)
    first, second = order_statistics(x, "x", math.floor(at))
    return first + at % 1 * (second - first)
