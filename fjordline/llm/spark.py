"""What the corpus operators share on the Spark side: columns, written tables, checked broadcasts, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown that it has no more rows; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on this machine one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fjordline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Keeps Arrow batches of texts small, in the JVM as in the workers: at most so many rows and bytes, unless the session asks for fewer."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(key).strip().lower()).groups()
        now = int(number) * _UNITS.get(unit[:1], 1)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


class Table:
    """A DataFrame written as Parquet in the shared folder: it cuts the lineage and outlives executors."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/fjordline-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with small, which is broadcast only if it has at most `limit` rows (counted unless given)."""
    count = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if count <= limit else small, on, how)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need no row per pair of
    a component and a logarithmic number of rounds in practice.  Least neighbours are aggregates, combined
    before they are shuffled, so the centre of a large star is no task of its own; a round is a written table.
    """
    now = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, size = None, now.df.count()
    for _ in range(rounds):
        both = now.df.unionAll(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a is linked to the least node around a.
        around = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = attach(both.where("b > a"), around, "a", rows=2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour of a, and a itself, is linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = attach(large, least, "a", rows=size).select("m", F.explode(F.array("a", "b")).alias("a")).where("a <> m").select("a", F.col("m").alias("b")).distinct()
        after = Table(small)
        size, total = after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now.drop()
        now = after
        if (size, total) == mark:
            break
        mark = (size, total)
    else:
        raise RuntimeError("components did not settle")
    roots = now.df.select(F.col("b").alias("a"), "b").distinct()
    return now.df.unionAll(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def steady(df: DataFrame) -> DataFrame:
    """df, written first unless it is a scan with projections and filters only: tasks that are run again see the same rows in the same order."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation"):
            return Table(df).df
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    return df
