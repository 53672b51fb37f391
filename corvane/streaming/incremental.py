"""An extension: keep postings up to date from a stream of documents.

The operators are batch ones; this runs them per micro-batch. Each batch writes a
new version of the postings and then names it, so a batch that is run again after
a failure overwrites its own version and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import index


class PostingsStore:
    """Versions of a postings table below ``root``; the newest finished one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_SUCCESS")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
        return sorted(int(str(s.getPath().getParent().getName())[2:]) for s in found)

    def read(self, before: int | None = None) -> DataFrame | None:
        v = [x for x in self._versions() if before is None or x < before]
        return self.spark.read.parquet(f"{self.root}/v={v[-1]}") if v else None

    def write(self, posts: DataFrame, version: int) -> None:
        posts.write.mode("overwrite").parquet(f"{self.root}/v={version}")


def maintain(stream: DataFrame, store: PostingsStore, fields: Callable[[], dict[str, Column]], id_col: str, checkpoint: str, removed: str | None = None, **trigger):
    """Start a query that adds each micro-batch's documents; rows where ``removed`` is true are taken out instead."""

    def batch(docs: DataFrame, number: int) -> None:
        old = store.read(before=number)
        gone = docs.where(F.coalesce(F.col(removed), F.lit(False))) if removed else None
        new = docs.where(~F.coalesce(F.col(removed), F.lit(False))) if removed else docs
        posts = index.postings(index.field_terms(new, id_col, fields()))
        if old is not None:
            if gone is not None:
                old = index.remove_documents(old, gone.select(F.col(id_col).alias("doc_id")))
            posts = index.add_documents(old, posts)
        store.write(posts.select("field", "term", "doc_id", "tf"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
