"""Session settings and the two size-aware helpers every module shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a table that may be shipped to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for a dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate of a plan (no job is run)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast only below a checked size; otherwise leave the join to the shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def hash_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The side of a join with a row or a few per key: broadcast below a checked size; otherwise both sides are shuffled
    and this one is hashed, so that the longer one is neither sorted nor spilled."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df.hint("shuffle_hash")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over twice as many tasks as there are shuffle partitions. Adaptive execution judges by compressed
    bytes and would leave narrow rows, which take far more memory when they are sorted, to a few tasks; Spark drops a
    repartition that is like the shuffle below it, hence another number."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input with fewer splits than cores (one small file); an input with
    enough splits, i.e. any large one, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``. Only a session on one machine that names none
    (tests) is given one, once, and it is entered in the session's own settings."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)
