"""Session set-up, checkpoints and size checks shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows (checked by a count).
BROADCAST_ROWS = 200_000


def build_session(app: str = "weftwork", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings that the operators rely on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftwork-")
        atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that this process has written, until they are dropped.
_written: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that materialised() has written so far, when no result reads them any more; how many."""
    jvm, n = spark._jvm, len(_written)
    for path in _written:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
    return n


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder, where it outlives lost executors.

    Unlike checkpoint() it keeps rows column by column and compressed, and later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df as it is (the join then shuffles).

    The count costs one pass over df, so df should be cheap or checkpointed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
