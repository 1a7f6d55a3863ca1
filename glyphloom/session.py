"""Session settings, the shared folder for cut lineage, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it is known to have no more rows and bytes (written as JSON) than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key is hot when it has more than one row in this many; at most this many keys can be hot.
HOT_SHARE = 200
#: Rows of one hot key that a salted task should get at most.
ROWS_PER_SALT = 200_000
SALT = "__salt"


def session(app: str = "glyphloom", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the session's ``spark.checkpoint.dir``, or, where that is unset and all runs in one local process, one of our own.

    On a cluster a machine's own folder would be lost with the machine, so the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark, "_glyphloom_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark._glyphloom_folder = folder
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written to cut lineage; nothing that was made from them can be read afterwards."""
    folder = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or []:
        files.delete(found.getPath(), True)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there.

    A written table is computed once (an eager ``checkpoint()`` runs its plan twice), is columnar,
    and has a known size, so that joins on it are planned by size. A lost executor costs only its tasks.
    The tables stay until ``release`` or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows of ``size`` bytes together; else unchanged.

    ``df`` should be materialized, as it is read once up to the limit to prove its size.
    """
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def join_hot(fact: DataFrame, dim: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """Join ``fact`` to one row per ``key`` of ``dim`` where a key may own a large share of ``fact``.

    ``dim[weight]`` is the number of rows of ``fact`` that have the key. Keys above one row in ``HOT_SHARE`` are hot; there
    can be no more than ``HOT_SHARE`` of them, so their hashes go into the plan. Rows of hot keys are spread over
    salts by their own hash and the matching rows of ``dim`` are repeated once per salt. Null keys match nothing.
    """
    dim = dim.filter(F.col(key).isNotNull())
    total = dim.agg(F.sum(weight)).first()[0] or 0
    least = max(total // HOT_SHARE, ROWS_PER_SALT)
    hot = [] if total <= least else [(r[0], r[1]) for r in dim.filter(F.col(weight) > least).select(F.xxhash64(key), weight).collect()]
    if not hot:
        return fact.join(dim.drop(weight), key, how)
    salts = max(-(-n // ROWS_PER_SALT) for _, n in hot)
    hashes = [h for h, _ in hot]
    spread = F.when(F.xxhash64(key).isin(hashes), F.pmod(F.xxhash64(*fact.columns), F.lit(salts))).otherwise(F.lit(0))
    every: Column = F.explode(F.when(F.xxhash64(key).isin(hashes), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = fact.withColumn(SALT, spread.cast("int"))
    right = dim.drop(weight).withColumn(SALT, every)
    return left.join(right, [key, SALT], how).drop(SALT)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, from wherever the driver imported it.

    Call it before any operator that runs Python on workers where the package is not installed; ``__spark_entry__`` does.
    """
    context = spark.sparkContext
    if getattr(context, "_glyphloom_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="glyphloom-code-")) / "glyphloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path("glyphloom") / file.relative_to(root))
    context.addPyFile(str(target))
    context._glyphloom_shipped = True
