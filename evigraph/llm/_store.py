"""Stage tables in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Bytes of a stage table that one task of an exchange takes.
TASK_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.  Where neither is set, local
    mode (tests) gets one of its own; on a cluster that is an error, since executors do not share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-stage-")
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Remove the files of a stage table that nothing reads any more."""
    jvm = staged.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(staged.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> int:
    """Partitions for an exchange of per-row data made from ``df``: as many as the session says, more for a table of
    many bytes (as Spark's statistics have them)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, math.ceil(size / TASK_BYTES)) if size < 1 << 56 else least  # beyond: Spark's word for not known


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
