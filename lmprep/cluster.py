"""Session-level helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds under which a helper table may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master; on a cluster a missing
    setting is an error, since a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lmprep-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, read again: unlike rows of a checkpoint it can be pruned and filtered."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table of fixed-width columns when its known row count is within ``limit``; else leave the
    join to AQE."""
    return F.broadcast(df) if rows <= limit else df


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a written table: rows and bytes, so that a few huge strings do not pass as a small table."""
    width = sum((F.octet_length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns), F.lit(16))
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Size of all inputs of a plan, by the optimizer's estimates."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread_small(df: DataFrame, limit_bytes: int = 1 << 30) -> DataFrame:
    """Give every core a share of a small input before CPU-heavy work.

    A small table can be one row group, hence one task. Past ``limit_bytes`` of input the scan has tasks
    enough and nothing is moved.
    """
    if input_bytes(df) > limit_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def once(value: Column) -> Column:
    """For ``select``: a generator over one value. The optimizer copies a plain projection into every
    expression that reads it; a costly value read more than once is computed once behind this."""
    return F.explode(F.array(value))
