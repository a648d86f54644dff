"""Tables that cut lineage: written to the folder the cluster shares, then read back.

Everything goes under ``spark.checkpoint.dir``.  Only where that setting is missing and all tasks
run in this process, as in tests, a folder of this machine is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out in this process, for ``cleanup``.
_ISSUED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context; on a cluster one of them is needed."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _ISSUED.append(path)
    return path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs no more than rereading a file."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def issued() -> int:
    """How many paths were handed out so far; give it to ``cleanup`` to spare those."""
    return len(_ISSUED)


def latest() -> tuple[str, ...]:
    """The path handed out last, if any."""
    return tuple(_ISSUED[-1:])


def cleanup(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Delete what was handed out in this process after ``since``, except paths that ``but`` names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    spared = [p for p in _ISSUED[since:] if p in but]
    for name in (p for p in _ISSUED[since:] if p not in but):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _ISSUED[since:] = spared
