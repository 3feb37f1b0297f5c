"""Delta-maintained totals of token counts by source, language and tokenizer version.

Changes are signed: an insert adds a document and its tokens to its key, a delete takes them away, a revision
takes the old counts from the old key and adds the new ones to the new key. Totals are sums of deltas, so changes
may come in any order. A batch is committed under its id: its summed deltas (one row per key) go to a folder of
that name, and a batch whose folder is complete is not applied again; a half-written one is not counted and is
replaced by the next commit of its id. Replays therefore change nothing. Before the first commit there are no totals.

Null source, language or version is a key value of its own. Null counts are zero. A key whose documents and tokens
are both zero is not listed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# Splits of the built-in counters; a version never changes once used.
COUNTERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]",
}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def _signed(df: DataFrame, sign: int, prefix: str = "") -> DataFrame:
    return df.select(
        *(F.col(prefix + k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("n_docs"),
        (F.lit(sign) * F.coalesce(F.col(prefix + "n_tokens").cast("long"), F.lit(0))).alias("n_tokens"),
    )


def inserts(df: DataFrame) -> DataFrame:
    """Deltas of new documents (source, lang, tokenizer, n_tokens)."""
    return _signed(df, 1)


def deletes(df: DataFrame) -> DataFrame:
    return _signed(df, -1)


def revisions(df: DataFrame) -> DataFrame:
    """Deltas of documents counted anew: columns old_* and new_* of the keys and n_tokens. One pass, two rows each."""
    both = F.array(*(
        F.struct(
            *(F.col(side + k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("n_docs"),
            (F.lit(sign) * F.coalesce(F.col(side + "n_tokens").cast("long"), F.lit(0))).alias("n_tokens"),
        )
        for side, sign in (("old_", -1), ("new_", 1))
    ))
    return df.select(F.inline(both))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenTotals:
    """Totals kept in a folder of the shared store, one subfolder per committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch id may hold letters, digits, '.', '_' and '-'")
        return f"{self.folder}/batch-{batch}"

    def _complete(self, pattern: str) -> list[str]:
        """Folders that match and hold the job's success file, which the driver writes last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().getParent().toString() for f in found or ()]

    def committed(self, batch: str) -> bool:
        return bool(self._complete(self._path(batch)))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if self.committed(batch):
            return False
        summed(deltas).write.mode("overwrite").parquet(self._path(batch))
        return True

    def totals(self) -> DataFrame:
        batches = self._complete(f"{self.folder}/batch-*")
        if not batches:
            return self.spark.createDataFrame([], _SCHEMA)
        parts = self.spark.read.schema(_SCHEMA).parquet(*batches)
        return summed(parts).where("n_docs <> 0 or n_tokens <> 0")
