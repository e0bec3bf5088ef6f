"""Token counts as rollups that signed deltas maintain, by source, language and tokenizer version.

A batch has inserts, deletes and revised documents. Each document's present entries are looked up in the journal,
retracted (sign -1) and, unless deleted, entered anew (sign +1); totals are sums over entries, so a batch adds its
summed deltas and touches nothing else. A batch is committed by one marker file that is made only if it is not there
yet; what an attempt without marker wrote is never read, and a batch that comes again changes nothing.

Folder: ``entries/attempt=A``, ``totals/attempt=A`` and ``commits/BATCH``, whose first line is A. ``compact`` commits the
present entries and totals as one attempt, whose marker names in its further lines the attempts that it stands for;
``vacuum`` deletes what these wrote. Their batches stay committed. A batch looks its documents up in what was written
since the last compaction and in that. One writer at a time commits; readers need no lock, but for ``vacuum``.

Defined cases: a batch's last row for a document (by ``order``) counts, and of an upsert and a deletion of the same
order the upsert; an insert of a known document is a revision, a deletion of an unknown one nothing; null source or
language is a group of its own; a null text has no tokens, a very long one is counted in its row's task; rows without
doc_id are ignored, as later batches could not name them; an empty batch is committed and changes nothing; other columns
take no part whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "doc_id long, source string, lang string, version string, tokens long, sign int"
TOTAL = "source string, lang string, version string, docs long, tokens long"
GROUP = ["source", "lang", "version"]


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, Column]):
        """``tokenizers``: for each version, a column that counts the tokens of column ``text``."""
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Batch -> the attempt that was committed for it."""
        return {batch: lines[0] for batch, lines in self._markers().items()}

    def live(self) -> list[str]:
        """The attempts that count: those that no compaction stands for."""
        markers = self._markers().values()
        replaced = {a for lines in markers for a in lines[1:]}
        return sorted(lines[0] for lines in markers if lines[0] not in replaced)

    def _markers(self) -> dict[str, list[str]]:
        where = self._path(f"{self.folder}/commits")
        if not self._fs.exists(where):
            return {}
        out = {}
        for status in self._fs.listStatus(where):
            stream = self._fs.open(status.getPath())
            out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode().split("\n")
            stream.close()
        return out

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/attempt={a}" for a in self.live()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def present(self, touched: DataFrame | None = None) -> DataFrame:
        """The entries that no later one retracts, of the documents ``touched`` or of all."""
        entries = self._read("entries", ENTRY)
        if touched is not None:
            entries = entries.join(touched.select("doc_id"), "doc_id", "left_semi")
        return entries.groupBy("doc_id", *GROUP, "tokens").agg(F.sum("sign").alias("sign")).filter("sign > 0").withColumn("sign", F.col("sign").cast("int"))

    def totals(self) -> DataFrame:
        sums = self._read("totals", TOTAL).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")

    def apply(self, batch: str, changes: DataFrame, order: str = "doc_id") -> bool:
        """Commit ``changes`` (op: upsert or delete; doc_id, text, source, lang) as ``batch``; False if it already was."""
        if batch in self.committed():
            return False
        rows = changes.filter("doc_id is not null").select(F.col("op"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.col(order).alias("_order") if order != "doc_id" else F.lit(0).alias("_order"))
        counts = F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(c, F.lit(0)).cast("bigint").alias("tokens")) for v, c in self.tokenizers.items()])
        rows = rows.select("op", "doc_id", "source", "lang", "_order", counts.alias("counts"))  # texts are counted before any shuffle
        last = Window.partitionBy("doc_id").orderBy(F.desc("_order"), F.desc("op"), F.desc_nulls_last("source"), F.desc_nulls_last("lang"), F.desc("counts"))
        rows = rows.withColumn("_at", F.row_number().over(last)).filter("_at = 1")
        new = rows.filter("op <> 'delete'").select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", "c.version", "c.tokens", F.lit(1).alias("sign"))
        entries = new
        if self.committed():
            old = self.present(rows).withColumn("sign", -F.col("sign"))
            entries = new.unionByName(old).groupBy("doc_id", *GROUP, "tokens").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        attempt = uuid.uuid4().hex
        entries.write.parquet(f"{self.folder}/entries/attempt={attempt}")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/attempt={attempt}")
        deltas = written.groupBy(*GROUP).agg(F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.coalesce(1).write.parquet(f"{self.folder}/totals/attempt={attempt}")
        return self._commit(batch, attempt)

    def compact(self, batch: str) -> bool:
        """Commit, as ``batch``, the present entries and totals in place of all attempts so far; False if it already was."""
        if batch in self.committed():
            return False
        attempt, before = uuid.uuid4().hex, self.live()
        self.present().select(*[c.split()[0] for c in ENTRY.split(", ")]).write.parquet(f"{self.folder}/entries/attempt={attempt}")
        self.totals().select(*[c.split()[0] for c in TOTAL.split(", ")]).write.parquet(f"{self.folder}/totals/attempt={attempt}")
        return self._commit(batch, "\n".join([attempt, *before]))

    def vacuum(self) -> int:
        """Deletes what attempts wrote that count no more or never did; how many."""
        keep, gone = {f"attempt={a}" for a in self.live()}, set()
        for kind in ("entries", "totals"):
            where = self._path(f"{self.folder}/{kind}")
            for status in self._fs.listStatus(where) if self._fs.exists(where) else ():
                if (name := status.getPath().getName()) not in keep:
                    self._fs.delete(status.getPath(), True)
                    gone.add(name)
        return len(gone)

    def _commit(self, batch: str, text: str) -> bool:
        """The marker appears whole: written aside, then renamed, which fails if it is there already."""
        aside, marker = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}"), self._path(f"{self.folder}/commits/{batch}")
        self._fs.mkdirs(marker.getParent())
        self._fs.mkdirs(aside.getParent())
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not self._fs.exists(marker) and bool(self._fs.rename(aside, marker))
