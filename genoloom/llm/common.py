"""Shared helpers: table access, durable intermediate tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, and only in local mode one of our own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="genoloom-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is deleted when the driver exits."""
    path = f"{scratch_dir(spark)}/genoloom-{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_forget_all)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _TABLES.get(spark.sparkContext.applicationId, []):
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that it works for any store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def whole_texts(df: DataFrame) -> DataFrame:
    """df, whose rows hold whole texts and go to Python workers: with Spark's default of 10,000 rows a batch the session's
    batches are set to 2,000, which bounds the memory of a worker. Another setting of the user's stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "2000")
    return df


def scan_partitions(df: DataFrame) -> int:
    """Input splits of a scan: a measure of its size that needs no job of its own."""
    spark = df.sparkSession
    return max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of one key beyond which it is hot, and how many hot keys there can be at most.
HOT_ROWS, HOT_KEYS = 100, 100_000


def join_by_key(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """The inner join of left (`rows` rows, or more) with right, which has one row for each key and in `n` the rows of left that have it.

    Rows of hot keys never meet in one task: a key is hot beyond HOT_ROWS and beyond a HOT_KEYS-th of all rows, so there are
    fewer than HOT_KEYS of them, and their rows of right are broadcast. All other keys are joined by a shuffle.
    """
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    hot = F.broadcast(right.where(F.col("n") > limit).drop("n"))
    cold = right.where(F.col("n") <= limit).drop("n")
    few = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(few.join(cold, key))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (src, dst): rows (node, root), root the smallest node reached.

    Alternates large-star and small-star steps, each a partial minimum per node and a join in which a hub's neighbours never
    meet in one task (join_by_key). Every round is written to the shared folder and the one before it deleted. Null ends
    are ignored; roots, and nodes without an edge to another node, don't appear. Raises where max_rounds don't reach a fixed point.
    """
    now = written(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct(),
        "edges",
    )

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = signature(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # large star: every neighbour above a node hangs on that node's smallest neighbour
        smaller = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("best"), F.lit(0).alias("n"))
        above = now.groupBy("lo").agg(F.lit(None).cast(now.schema["lo"].dataType).alias("best"), F.count("*").alias("n"))
        least = above.unionByName(smaller).groupBy("lo").agg(F.min("best").alias("best"), F.sum("n").alias("n")).where("n > 0")
        joined = join_by_key(now, least.withColumn("best", F.coalesce("best", "lo")), "lo", seen[0])
        large = written(joined.select("hi", F.col("best").alias("lo")).distinct(), "edges")
        # small star: a node and all its smaller neighbours hang on the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("best"), F.count("*").alias("n"))
        joined = join_by_key(large, least, "hi", seen[0])
        small = joined.select(F.col("lo").alias("hi"), F.col("best").alias("lo")).union(joined.select("hi", F.col("best").alias("lo"))).where("hi <> lo").distinct()
        following = written(small, "edges")
        delete(now.sparkSession, now._scratch_path)
        delete(now.sparkSession, large._scratch_path)
        was, now = seen, following
        seen = signature(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
