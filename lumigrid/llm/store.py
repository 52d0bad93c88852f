"""Where intermediate tables live: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session that has none (tests, a laptop) gets a temporary folder:
    on a cluster each executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumigrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there,
    so a lost executor costs a file read instead of the stages above it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows (that satisfy ``what``) were written, counted on the way."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")), name)
    return out, seen.get["n"]


def drop_table(df: DataFrame) -> None:
    """Delete the files that a ``cut`` table was read from."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that no two rows share: the doc_id where it is
    one row's own, else a number above all ids.

    Those other rows are written in the order of (doc_id, all columns), so their
    numbers are the same whenever they are read, and rows in doubt are alike."""
    number = F.col("doc_id").cast("long")
    shared, n = cut_counting(docs.groupBy(number.alias("shared")).count().where("count > 1 or shared is null").select("shared"), "shared")
    if not n:
        return docs.withColumn(name, number)
    top = docs.agg(F.coalesce(F.max(number), F.lit(0)).alias("top")).first().top
    order = [F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])]
    one = docs.where("doc_id is not null").join(shared, number == F.col("shared"), "left_anti").withColumn(name, number)
    some = docs.join(shared, number.eqNullSafe(F.col("shared")), "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    return one.unionByName(cut(some.withColumn(name, F.lit(top + 1) + F.monotonically_increasing_id()), "repeated"))
