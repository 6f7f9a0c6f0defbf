"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE coalesces small shuffle partitions, splits
# skewed join partitions and picks broadcast joins from measured sizes, so the
# library itself places no broadcast hints on data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Text work is heavy per byte: small scan partitions keep all cores busy on small tables too.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters pass their own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("traceaudit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session is local (tests) a fresh scratch folder is made for it and
    set as the checkpoint folder of the context, where later calls find it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="traceaudit-"))
    return context.getCheckpointDir()


_SCOPE: ContextVar[str | None] = ContextVar("stored_tables", default=None)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of what ``materialise`` stores inside: it is deleted at the end.

    Write or collect results before the block ends; they may read stored tables.
    """
    folder = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For small per-entity or per-example tables that several parts of a report
    use: the pipeline below runs once, and a lost executor costs nothing. Tables
    stored inside ``stored_tables`` go with it, others stay for the caller.
    """
    folder = _SCOPE.get() or f"{checkpoint_root(df.sparkSession)}/tables"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
