"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

A batch holds signed changes: a document that came (+1, +tokens), one that went (-1, -tokens), or a revised count (its
old count out, its new one in). A batch is summed by key before any shuffle and committed as one small Parquet table
whose folder is named by the batch's id. The write goes to a folder of its own and is moved into place by one rename,
so a batch is there whole or not at all, and a batch id that is there already is left alone: commits may be repeated
after any failure. Totals are the sums over all committed batches; ``compact`` folds those that it has listed, and no
others, into one table that remembers the ids it holds; it deletes them only after that table is in place.

Defined results: a null source, language or version is a key of its own; null texts count no tokens; null signs and
counts change nothing; keys whose documents and tokens are both 0 again don't show; an empty batch is committed and
changes nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches
from .tokens import Encoder, vocabulary_file

KEYS = ("source", "lang", "tokenizer_version")
#: Beginning of the names of folders that are being written.
WRITING = "_writing-"
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, *, vocabulary: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens`` of every row."""
    vocabulary = vocabulary or vocabulary_file()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for a, b, _, first in encoder.batches(batch.column(3)):
                own = [batch.column(i).slice(a, b - a) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([version] * (b - a), pa.string()), pa.array(np.diff(first))], ["doc_id", "source", "lang", "tokenizer_version", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that came."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows of documents that went."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows of documents whose count (or key) was ``old`` and is ``new``."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Totals kept under one folder of a store that Spark can write and rename in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def _newest(self) -> str | None:
        found = sorted(str(s.getPath()) for s in (self._fs.globStatus(self._at(f"{self.path}/base=*")) or []))
        return found[-1] if found else None

    def _held(self, base: str | None, names: list[str]) -> set[str]:
        """Those of the batch folders ``names`` that a compaction holds."""
        if base is None or not names:
            return set()
        held = self.spark.read.schema("folder string").parquet(f"{base}/held")
        return {r.folder for r in held.where(F.col("folder").isin(names)).collect()}

    def _placed(self, own: str, to: str) -> bool:
        """Moves a folder into place; False, and the folder is gone, if another one is there. A move that fails for any other
        reason raises, and the folder stays."""
        nested = f"{to}/{own.rsplit('/', 1)[1]}"  # some stores move a folder into one that exists
        moved = self._fs.rename(self._at(own), self._at(to))
        if moved and not self._there(nested):
            return True
        if not moved and not self._there(to):
            raise OSError(f"{own} could not be moved to {to}; nothing is committed")
        self._fs.delete(self._at(nested), True)
        self._fs.delete(self._at(own), True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows once; False if it was there already. Raises where it can't be put in place: it is not
        counted then, and may be committed again."""
        to = self._folder(batch)
        if self._there(to) or self._held(self._newest(), [to.rsplit("/", 1)[1]]):
            return False
        rows = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        own = f"{self.path}/{WRITING}{uuid.uuid4().hex}"
        rows.write.parquet(own)
        return self._placed(own, to)

    def _parts(self) -> tuple[str | None, list[str]]:
        """The newest compaction, and the batches beside it that it doesn't hold."""
        base = self._newest()
        batches = {(at := str(s.getPath())).rsplit("/", 1)[1]: at for s in (self._fs.globStatus(self._at(f"{self.path}/batch=*")) or [])}
        held = self._held(base, list(batches))
        return base, sorted(at for name, at in batches.items() if name not in held)

    def _summed(self, base: str | None, batches: list[str]) -> DataFrame:
        at = ([f"{base}/totals"] if base else []) + batches
        if not at:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*at)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """Current totals by key. Read them before the next compaction deletes what they come from."""
        return self._summed(*self._parts())

    def compact(self, stale: float = 86400.0) -> bool:
        """Folds the batches that are there now into one table, and deletes them once it is in place. A batch that is
        committed meanwhile stays beside it. False, and nothing changes, if another compaction was first. Folders that
        writers left behind ``stale`` seconds ago or earlier are deleted too."""
        base, batches = self._parts()
        serial = 0 if base is None else int(base.rsplit("=", 1)[1]) + 1
        own = f"{self.path}/{WRITING}{uuid.uuid4().hex}"
        self._summed(base, batches).coalesce(1).write.parquet(f"{own}/totals")  # a row for each key
        names = self.spark.createDataFrame([(b.rsplit("/", 1)[1],) for b in batches], "folder string")
        held = names if base is None else names.unionByName(self.spark.read.schema("folder string").parquet(f"{base}/held"))
        held.write.parquet(f"{own}/held")
        if not self._placed(own, f"{self.path}/base={serial:012d}"):
            return False
        for old in [base, *batches]:
            if old:
                self._fs.delete(self._at(old), True)
        for left in self._fs.globStatus(self._at(f"{self.path}/{WRITING}*")) or []:
            if left.getModificationTime() < 1000 * (time.time() - stale):
                self._fs.delete(left.getPath(), True)
        return True
