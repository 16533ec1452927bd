"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "fieldpulse", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables.

    It lies in the folder the cluster names; only a local session without that
    setting gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or _local_folders.get(app)
    if not folder:
        if not is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = _local_folders[app] = tempfile.mkdtemp(prefix="fieldpulse-")
    return f"{folder.rstrip('/')}/fieldpulse/{app}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to all cores of a local session before heavy per-row work.

    Local tables are a file or two, which one task each would read; on a cluster the rows stay where
    they are, and no text is shuffled for it.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism, key) if is_local(spark) else df


def materialise(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, as ``schema`` if the stored layout has other names.

    Cuts the lineage of iterative jobs and survives lost executors.  Unlike an
    RDD checkpoint the result keeps column pruning and its true size, so later
    joins choose broadcast only when the table is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
