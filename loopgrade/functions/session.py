"""Settings that operators read from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset, a local session (tests) gets a folder of its own and a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loopgrade-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and the lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, group: int | None = None) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder, read again: for rows with long texts that several jobs need. :func:`release` removes it.

    ``group``: bytes of a row group, for rows so long that a reader couldn't hold many.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.size", group).option("parquet.enable.dictionary", "false") if group else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that this session's operators wrote to the shared folder and returns their number; results that still read them are lost, so store those first."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over all cores where its files make fewer tasks than these: for maps that cost far more than moving a row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def bounded(df: DataFrame, rows: int = 200_000, size: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast where it has at most ``rows`` rows of ``size`` bytes together; beyond that the join shuffles. Runs a job that counts."""
    from pyspark.sql import functions as F

    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
