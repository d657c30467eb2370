"""Session helpers shared by every operator: table loading, lineage cuts, proven-size broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the scan stays lazy so that filters and columns reach the parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``; a private one only where that is unset and all is one process (tests)."""
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, _LOCAL_DIR.removeprefix("file://"), ignore_errors=True)
    return _LOCAL_DIR


#: Tables of :func:`written` that were not deleted yet.
_KEPT: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str, *by: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` once to the shared folder (in parts ``by`` columns) and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{label}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for path in paths:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)
        _KEPT.pop(path, None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written within it: for callers that are done with the results by then."""
    before = set(_KEPT)
    try:
        yield
    finally:
        drop_written(spark, *(set(_KEPT) - before))


def _last_drop() -> None:
    """At the end of the driver, the tables that lazy results still needed."""
    for path, spark in list(_KEPT.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                drop_written(spark, path)


atexit.register(_last_drop)


def hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete whenever it is read: written beside its place and renamed."""
    fs, target = hadoop_path(spark, path)
    _, beside = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None without it."""
    fs, target = hadoop_path(spark, path)
    if not fs.exists(target):
        return None
    size = fs.getFileStatus(target).getLen()
    source = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8") if size else ""
    finally:
        source.close()


def parallelism(spark: SparkSession) -> int:
    """Shuffle width the session was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra or clashing ones never reach an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Bytes (as rows in memory, estimated) up to which a measured side may be broadcast.
BROADCAST_BYTES = 24 << 20


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in memory: its fixed parts and the characters of its strings and arrays."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + 8
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif f.dataType.typeName() not in ("integer", "long", "boolean", "double", "timestamp", "timestamp_ntz"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size


def measured(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` written, and its bytes in memory."""
    kept, _ = written(df, label)
    return kept, bytes_of(kept)


def bytes_of(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes(df).cast("bigint")), F.lit(0))).first()[0]  # one number


def small_side(df: DataFrame, label: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` for the build side of a join: written, measured, and hinted for broadcast only if it is small."""
    kept, size = measured(df, label)
    return F.broadcast(kept) if size <= limit else kept


def lookup(left: DataFrame, right: DataFrame, keys: list[str], label: str = "side", how: str = "inner", limit: int = BROADCAST_BYTES, written_already: bool = False) -> DataFrame:
    """Join (inner or left) to a side with unique ``keys`` that is written and measured first: broadcast if small, else skew-safe."""
    kept, size = (right, bytes_of(right)) if written_already else measured(right, label)
    return left.join(F.broadcast(kept), keys, how) if size <= limit else skewed_lookup(left, kept, keys, max(1, left.count()), how=how)


def skewed_lookup(left: DataFrame, right: DataFrame, keys: list[str], total: int, one_in: int = 1000, how: str = "inner") -> DataFrame:
    """Join (inner or left) of many rows to a side with unique ``keys``, whatever the skew of the left side.

    Keys with at least one in ``one_in`` of the left's ``total`` rows are at most ``one_in``: their few right
    rows are broadcast, so that their left rows stay where they are.  All other rows are joined by shuffle.
    """
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * one_in >= F.lit(total)).select(*keys, F.lit(True).alias("_hot"))
    tagged = left.join(F.broadcast(hot), keys, "left")
    few = right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    cold = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    warm = tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(few), keys, how)
    return cold.unionByName(warm)


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group: of salted parts first, so that no task ranks the whole of a large group."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parallelism(df.sparkSession)))
    parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = df.withColumn("_salt", salt).withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= most).drop("_n", "_salt")
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before work that is heavy per row: shuffled only if its scan has too few splits."""
    want = max(parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
