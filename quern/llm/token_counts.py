"""Token counts as delta-maintained rollups.

A batch holds changes: a document's count for a tokenizer version is inserted, revised or deleted. Against what the
earlier batches left, each change becomes signed deltas: the old count with a minus under its old source and language,
the new one with a plus. Deltas are appended, and their sums are added to the totals by source, language and version;
nothing that was counted before is read again but what is held of the documents that a batch names. That is stored by
buckets of documents: a batch reads the buckets that it touches, of a snapshot (a row for each document and version) and
of the few commits since. Every COMPACT commits a snapshot takes the place of the deltas before it, so that the cost of a
batch doesn't grow with the number of batches.

Commits. Deltas and totals go to fresh folders; then one marker file, created only if it doesn't exist yet, names them and
the batch. Readers follow markers alone: what a failed or lost attempt wrote is never seen, a batch that is already
committed is left alone when it comes again, and of two writers that meet one starts over on the other's result.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .columns import own

DELTAS = "doc_id long, source string, lang string, version string, docs long, tokens long, bucket int"
TOTALS = "source string, lang string, version string, docs long, tokens long"
GROUP = ["source", "lang", "version"]
#: Folders of documents in each delta and snapshot, and commits between snapshots.
BUCKETS, COMPACT = 32, 8
#: Fixed value: the pattern that splits text before the merges of the public byte-level BPE ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file, read on the driver: a line for each token, base64 and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokens, words): byte-level BPE tokens and words of each whole text; null and empty have 0.

    A row for each row of docs, repeated ones and those without an id too (a Rollup takes rows of one id, or of none, and
    one version for one document). Texts are counted whole, however long; one text's tokens are in memory at once. Columns
    besides the four named are not read, so no names clash. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            tokens = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
            n = [x for c in words.chunks(pa.chunked_array([b["text"]])) for x in c.counts.tolist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["lang"], pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens", "words"])

    base = docs.select(own(id_col).cast("long").alias("doc_id"), own(source_col).cast("string").alias("source"), own(lang_col).cast("string").alias("lang"), own(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, source string, lang string, tokens long, words long")


class Rollup:
    """Totals in a folder that driver and executors share; any file system that Spark knows will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return []
        return sorted(n for n in (str(s.getPath().getName()) for s in self._fs.listStatus(at)) if n.endswith(".json"))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """The markers in order: batch, deltas, totals, and those of a snapshot. One small file for each batch."""
        return [self._read(n) for n in self._names()]

    def _recent(self) -> tuple[int, set[str], list[dict]]:
        """Commits so far, the names of their batches, and the markers from the last snapshot on."""
        names, out = self._names(), []
        for name in reversed(names):
            out.insert(0, self._read(name))
            if "history" in out[0]:
                break
        return len(names), {c["batch"] for c in out} | set(out[0].get("history", ()) if out else ()), out

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) after the last commit; groups whose documents all went are left out."""
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(self._read(names[-1])["totals"])

    def expire(self) -> None:
        """Deletes deltas that a snapshot covers, and older snapshots and totals. Markers stay: they know the batches."""
        names = self._names()
        recent = self._recent()[2]
        kept = {c[k] for c in recent for k in ("deltas", "snapshot") if k in c} | ({recent[-1]["totals"]} if recent else set())
        for marker in map(self._read, names):
            for k in ("deltas", "snapshot", "totals"):
                if k in marker and marker[k] not in kept:
                    self._fs.delete(self._path(marker[k]), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if a batch of that name is committed already.

        changes: doc_id long, version string, source, lang, tokens long, op string, seq long. op is "upsert" (an insert, or
        a revision that replaces count, source and language) or "delete" (of a document that may be unknown). Of several
        changes to one document and version the one of the largest seq counts, of equal seq the greatest (op, source,
        lang, tokens): so repeated rows count once. Null ids, sources, languages and versions are values like others; a
        null count is 0, a null or other op raises.
        """
        while True:
            number, batches, recent = self._recent()
            if batch in batches:
                return False
            name = uuid.uuid4().hex
            marker: dict = {"batch": batch, "deltas": f"{self.folder}/deltas/{name}", "totals": f"{self.folder}/totals/{name}"}
            held = self._held(recent)
            self._store(self._deltas(changes, held), marker["deltas"])
            added = self.spark.read.schema(DELTAS).parquet(marker["deltas"])
            before = self.spark.read.schema(TOTALS).parquet(recent[-1]["totals"]) if recent else self.spark.createDataFrame([], TOTALS)
            summed = before.union(added.select(*GROUP, "docs", "tokens")).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            summed.where("docs <> 0 or tokens <> 0").coalesce(1).write.parquet(marker["totals"])  # a row for each group
            if (number + 1) % COMPACT == 0:
                marker |= {"snapshot": f"{self.folder}/snapshots/{name}", "history": sorted(batches | {batch})}
                every = added if held is None else held.unionByName(added)
                now = every.groupBy("doc_id", *GROUP, "bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
                self._store(now.drop("bucket"), marker["snapshot"])
            if self._mark(number, marker):
                return True
            for part in {"deltas", "totals", "snapshot"} & marker.keys():  # another writer was first: start over on its result
                self._fs.delete(self._path(marker[part]), True)

    def _store(self, rows: DataFrame, path: str) -> None:
        """Rows in folders by bucket, a file or a few in each; an empty folder with a schema if there are none."""
        dealt = rows.withColumn("bucket", _bucket("doc_id", "version"))
        dealt.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(8))).write.partitionBy("bucket").parquet(path)

    def _held(self, recent: list[dict]) -> DataFrame | None:
        """What is held of all documents, as deltas: the last snapshot, and the commits after it."""
        if not recent:
            return None
        first = recent[0]
        parts = [first["snapshot"], *(c["deltas"] for c in recent[1:])] if "snapshot" in first else [c["deltas"] for c in recent]
        frames = [self.spark.read.schema(DELTAS).parquet(p) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _deltas(self, changes: DataFrame, held: DataFrame | None) -> DataFrame:
        known = F.when(F.col("op").isin("upsert", "delete"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        last = F.max(F.struct("seq", known.alias("op"), "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))).alias("c")
        now = changes.groupBy("doc_id", "version").agg(last).select("doc_id", "version", "c.op", "c.source", "c.lang", "c.tokens")
        plus = now.where("op = 'upsert'").select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
        if held is None:
            return plus
        touched = [r["b"] for r in changes.select(_bucket("doc_id", "version").alias("b")).distinct().collect()]  # BUCKETS rows at most
        named = now.select(F.col("doc_id").alias("i"), F.col("version").alias("v"))
        earlier = held.where(F.col("bucket").isin(touched)).join(named, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("version").eqNullSafe(F.col("v")), "left_semi")
        old = earlier.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        return plus.union(old.select("doc_id", *GROUP, -F.col("docs"), -F.col("tokens")))

    def _mark(self, number: int, marker: dict) -> bool:
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        at = self._path(f"{self.folder}/commits/{number:09d}.json")
        if self._fs.exists(at):
            return False
        # Written aside and renamed: a marker is never seen half, and a rename doesn't replace a file that is there.
        aside = self._path(f"{self.folder}/commits/{marker['totals'].rpartition('/')[2]}.tmp")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(marker).encode("utf-8")))
        finally:
            stream.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            return False
        return self._read(f"{number:09d}.json") == marker


def _bucket(doc_id: str, version: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, version), F.lit(BUCKETS)).cast("int")
