"""Written stages: cut lineage through a table in the shared checkpoint folder.

Iterative operators and results used more than once are written as Parquet
under ``spark.checkpoint.dir``, a folder that all executors share, so a lost
executor costs no recomputation.  Only where the session names no such folder
(tests on one machine) is a temporary one set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, label: str = "stage", codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it.  Rows of hashes, which no codec shortens, are better written with ``lz4``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a written stage that nothing will read again."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for own, path in list(_written):
        if any(root.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/") for root in roots):
            _delete(spark, path)
            _written.remove((own, path))


@atexit.register
def release_stages() -> None:
    """Delete every stage written by this process; frames that read them must be done."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass


_NARROW = {"Project", "Filter", "LogicalRelation"}


def _nodes(plan):
    """Class names of a logical plan's nodes."""
    yield plan.getClass().getSimpleName()
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer partitions than there are cores, spread over all of them; anything else as it is.

    Files of one row group give one task, which Python work would then wait for.  Large inputs have more partitions than cores and are not
    shuffled.  Only scans with projections and filters are looked at: asking others for their partitions would run them.
    """
    if not _NARROW.issuperset(_nodes(df._jdf.queryExecution().optimizedPlan())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
