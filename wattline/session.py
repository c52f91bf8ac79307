"""Session helpers: a local session for tests and the shared spool folder.

Multi-pass operators cut lineage by writing a table into the folder that the
cluster names in ``spark.checkpoint.dir``. That folder is shared storage, so a
lost executor costs a re-read and never a different answer.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SORT_PARTITION_BYTES = 128 * 1024 * 1024
MAX_SORT_PARTITIONS = 50_000

_LOCAL_SPOOL: dict[str, str] = {}


def local_session(app: str = "wattline", cores: int | str = 8) -> SparkSession:
    """A single-machine session with the settings the tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WATTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def spool_root(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The cluster's ``spark.checkpoint.dir`` wins. Only a local-mode session may
    fall back to a fresh temporary folder; elsewhere a missing setting is an
    error, because a machine-local folder is not visible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SPOOL:
        _LOCAL_SPOOL[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_SPOOL[app]


_KNOWN_LEAVES = ("LogicalRelation", "LocalRelation", "Range", "InMemoryRelation", "OneRowRelation")
_GUESSED = ("Join", "Generate", "Expand")


def size_known(df: DataFrame) -> bool:
    """Whether the optimizer's size of ``df`` comes from files or counted rows.

    The estimate of a join is a product of its sides, that of an explode a guess, and a
    table made from an RDD counts as endless.
    """

    def known(node) -> bool:
        children = node.children()
        if not children.size():
            return node.getClass().getSimpleName() in _KNOWN_LEAVES
        return node.getClass().getSimpleName() not in _GUESSED and all(known(children.apply(i)) for i in range(children.size()))

    return known(df._jdf.queryExecution().optimizedPlan())


def sort_partitions(df: DataFrame) -> int:
    """How many ranges a full sort of ``df`` should use.

    At least ``spark.sql.shuffle.partitions``, and enough that one range holds
    about 128 MB by the optimizer's size estimate, which adaptive execution does
    not adjust for an explicit repartition. Where the estimate is no size
    (``size_known``), store the table first.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(MAX_SORT_PARTITIONS, size // SORT_PARTITION_BYTES + 1))


def spool_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path under the spool folder."""
    return f"{spool_root(spark)}/{label}-{uuid.uuid4().hex}"


def spool(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to shared storage and continue from the stored copy."""
    spark = df.sparkSession
    path = spool_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that ends inside are deleted then, not when the driver next collects garbage.

    For jobs of several passes, none of which reads an earlier one's shuffle.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
