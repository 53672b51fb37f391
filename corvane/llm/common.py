"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it, for Java's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``, found by exact name and picked by position.

    Extra columns, also ones whose names differ in case only or repeat, can't
    make a reference ambiguous. Of a repeated name the first column counts. A
    missing column raises ValueError.
    """
    at = []
    for n in names:
        if n not in df.columns:
            raise ValueError(f"column {n!r} is missing; there are {df.columns}")
        at.append(df.columns.index(n))
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is missing and the master is local, as in tests, a
    temporary folder of the (then single) machine is taken; on a cluster without
    the setting ValueError is raised, as executors would write to disks of their own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder to cut lineage or to be read twice.

    Written tables survive the loss of executors. ``drop`` deletes one early;
    the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            pass


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``df`` should be a written table of narrow rows: it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
