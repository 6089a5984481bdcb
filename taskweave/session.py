"""Session settings and the shared folder used for checkpoints and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RUNTIME_SETTINGS = {
    # Instants are compared in UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Look-ups are many-to-one: when one key holds a large share of the rows,
    # AQE splits that key's partition, also below an aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on, once, to a session of one's own."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "8", app: str = "taskweave") -> SparkSession:
    """A session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def require_utc(spark: SparkSession) -> None:
    """An error unless the session shows instants in UTC; the session itself is left as it is."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper().removeprefix("ETC/") not in ("UTC", "UCT", "GMT", "Z", "ZULU", "+00:00"):
        raise RuntimeError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


_WORK: ContextVar[str] = ContextVar("work", default="")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    place, files = filesystem(spark, path)
    files.delete(place, True)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes below it) of every entry of a folder; none if there is no folder."""
    place, files = filesystem(spark, path)
    if not files.exists(place):
        return []
    return [(s.getPath().getName(), files.getContentSummary(s.getPath()).getLength() if s.isDirectory() else s.getLen()) for s in files.listStatus(place)]


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, or say that it is there already: of several callers one gets it.

    Stores decide that by themselves in ``create`` without overwrite; a local folder does not,
    so there the file is made by the operating system's exclusive create.
    """
    place, files = filesystem(spark, path)
    files.mkdirs(place.getParent())
    parent = files.resolvePath(place.getParent())
    jvm = spark._jvm
    try:
        if parent.toUri().getScheme() == "file":
            folder = jvm.java.io.File(parent.toUri().getPath())
            return jvm.java.io.File(folder, place.getName()).createNewFile()
        files.create(place, False).close()
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "AlreadyBeingCreatedException"):
            return False
        raise


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """Whatever is stored inside goes to a folder of its own, which is dropped at the end.

    A result that reads stored rows must be written or collected before.
    """
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    token = _WORK.set(path)
    try:
        yield path
    finally:
        _WORK.reset(token)
        drop(spark, path)


def output_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the work folder in use."""
    return f"{_WORK.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a result that several later steps read: it is computed once, keeps its
    columnar layout, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = output_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Below this size a scan in few tasks is left as it is.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan that fewer tasks read than there are cores, dealt to all of them.

    For work per row that is heavy beside reading it: a small table in one file would do all of
    it in one task. Tables of as many parts as cores are left alone, so nothing large is shuffled.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.optimizedPlan().stats().sizeInBytes() < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """1-based position of every row in a total order, without one big task.

    The rows are range partitioned and sorted, stored once, and each partition
    is offset by the row counts before it. Only one row per partition meets in
    the offset window. ``order`` must end in a unique column.
    """
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(
        laid_out.withColumn("_part", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "numbered",
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_row", "_offset")
    )
