"""Session helpers shared by the operators: durable cut points, ranks without one big window, bounded label samples."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quarry-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _local_folder()
    return where.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder and read again.

    Unlike ``DataFrame.checkpoint`` this also resets the plan's size estimate, which else grows with each round of a loop
    until planning takes longer than the work. Tables that a result still reads stay in the application's folder, which whoever runs
    it may delete when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # nothing but this write reads its shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*done: DataFrame) -> None:
    """Delete the tables of ``done``: results of ``checkpoint`` that nothing reads any more."""
    for df in done:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS`` rows at most: whole texts in batches of 10,000 take hundreds of MB beside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, by: list[str], order: list[Column], to: str, salts: int | None = None) -> DataFrame:
    """A 0-based rank of each row within ``by``, gap-free, without one task holding a whole group.

    Rows are spread over ``salts`` (four a shuffle partition, 64 at least) by a hash of ``order``; each salt's rank starts where the salts
    before it end. Equal rows take different ranks.
    """
    salts = salts or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = df.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)) - 1)
    on = F.col("_salt") == F.col("_s")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return ranked.join(sizes, on).withColumn(to, (F.col("_rank") + F.col("_before")).cast("long")).drop("_salt", "_rank", "_before", "_s", *[f"_k_{c}" for c in by])


def label_sample(docs: DataFrame, labels: DataFrame, label: Column, limit: int, even: bool = True) -> list[tuple[str, str]]:
    """At most ``limit`` labelled (label, whole text) rows, evenly by label or as their shares are, chosen by a hash of the id.

    Only this sample, used to fit a classifier, is bounded. Null ids, labels and texts are no training rows. Of several
    label rows of one id the greatest (quality, then toxic) counts; of several documents of one id all are taken.
    """
    known = [c for c in ("quality", "toxic") if c in labels.columns]
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*known)).alias("_l")).select("doc_id", "_l.*")
    side = docs.where("doc_id is not null and text is not null").select("doc_id", *[c for c in ("lang", "source") if c in docs.columns])
    rows = side.join(own, "doc_id").select("doc_id", label.cast("string").alias("label")).where("label is not null").distinct()
    per = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return []
    ids = None
    for name in sorted(per):
        each = max(1, limit // len(per) if even else limit * per[name] // sum(per.values()))
        some = rows.where(F.col("label") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        ids = some if ids is None else ids.unionByName(some)
    chosen = {r["doc_id"]: r["label"] for r in ids.collect()}
    keys = docs.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(keys), "doc_id").collect()  # at most `limit` ids
    return sorted((chosen[r["doc_id"]], r["text"]) for r in texts)
