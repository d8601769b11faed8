"""Token counts as delta-maintained rollups.

A store holds, under one folder, a log of what each document counts at present and deltas whose sum are the totals
(documents, tokens) by source, language and tokenizer version.  A batch of changes (insert, delete, revise) is compared with the log
entries of its own documents and becomes signed deltas: an insert adds, a delete subtracts what is there, a revision
subtracts the old count and adds the new.  Log entries and deltas are appended, so what a batch writes follows the batch and not the
store; the log is dealt to buckets by document, and a batch reads the buckets that it touches.

A batch has an id.  Its files lie in folders of their own until a commit record names them: record number n is put in place by
a rename that fails if there is one already, so of two writers that started from the same state one fails and has changed nothing.
A batch whose id a record has is not applied again, so replays after failures change nothing.  Now and then the folders are
merged into one, by a commit of its own; those it replaces are deleted at the next such time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm._shared import WORD, partitions, shared_dir

KEYS = ["source", "lang", "tokenizer"]
LOG = "doc_id string, version bigint, counts array<struct<source: string, lang: string, tokenizer: string, docs: bigint, tokens: bigint>>, part string, bucket int"
TOTALS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
RECORD = "number bigint, batch string, buckets int, log array<string>, deltas array<string>, expired array<string>"
#: Log folders after which they are merged.
COMPACT_AFTER = 32

#: Tokenizer versions: words between white space; runs of letters or digits, and single other signs.
VERSIONS = {"words-1": WORD, "words-2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def token_count(text: str, version: str) -> Column:
    """Tokens of a text column under a version; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(VERSIONS[version])).cast("bigint")


class CommitConflict(RuntimeError):
    """Another writer committed first; the batch can be applied again."""


class RollupStore:
    """Totals under a folder that all executors share.

    A change is a row (doc_id, op, source, lang, tokenizer, tokens) with op 'insert', 'revise' or 'delete' (other columns null).  The
    rows of a document in a batch, or those of its highest seq if there is such a column, are together what it counts from then on;
    deletes among them add nothing.  So a document may have several rows, and repeated rows count as often as they stand.  An insert of
    a document that is present counts as a revision, and a revision or deletion of an unknown one as an insert or as nothing:
    totals always are those of the present counts.  Ids are kept as text; a null one is a document like any other.  Null
    sources, languages and versions are groups of their own; null tokens count as 0.  An empty batch is committed and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """buckets of a new store; the session's shuffle partitions if not given.  A store keeps those that it began with."""
        self.spark, self.buckets = spark, buckets or partitions(spark)
        self.path = path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"

    def _files(self, path: str):
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return fs_path, fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _records(self) -> DataFrame | None:
        path, fs = self._files(f"{self.path}/commits")
        return self.spark.read.schema(RECORD).json(path.toString()) if fs.exists(path) and len(fs.listStatus(path)) else None

    def state(self) -> dict:
        """The last record: its number, and the folders that hold the log and the deltas."""
        records = self._records()
        last = None if records is None else records.orderBy(F.desc("number")).first()
        return last.asDict() if last else {"number": 0, "batch": None, "buckets": self.buckets, "log": [], "deltas": [], "expired": []}

    def _commit(self, record: dict) -> None:
        """Put record in place under its number alone; fails if that number is there."""
        jvm = self.spark._jvm
        target, fs = self._files(f"{self.path}/commits/{record['number']:012d}.json")
        draft, _ = self._files(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as error:
            if fs.exists(target):
                raise CommitConflict(f"number {record['number']} is committed already") from error
            raise

    def _log(self, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        """The last log entry of each document."""
        if not folders:
            return self.spark.createDataFrame([], LOG).select("doc_id", "counts")
        log = self.spark.read.schema(LOG).option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/part={x}" for x in folders])
        log = log if buckets is None else log.filter(F.col("bucket").isin(buckets))
        return log.groupBy("doc_id").agg(F.max_by("counts", "version").alias("counts"))

    def _sum(self, folders: list[str]) -> DataFrame:
        deltas = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/deltas/{x}" for x in folders]) if folders else self.spark.createDataFrame([], TOTALS)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups that became empty are left out."""
        return self._sum(self.state()["deltas"]).filter("docs <> 0 or tokens <> 0")

    def present(self) -> DataFrame:
        """doc_id and its counts (array of source, lang, tokenizer, docs, tokens) of every document that is there."""
        return self._log(self.state()["log"]).filter(F.size("counts") > 0)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply and commit a batch; False if it is committed already, CommitConflict if another writer was faster."""
        records = self._records()
        if records is not None and not records.filter(F.col("batch") == batch).isEmpty():
            return False
        now, name = self.state(), uuid.uuid4().hex
        number = now["number"] + 1
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        rows = changes.select(F.col("doc_id").cast("string").alias("doc_id"), "op", *KEYS, F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), seq.alias("seq"))
        # rows alike are added up before they meet their document's others
        parts = rows.groupBy("doc_id", "seq", F.coalesce(F.col("op") == "delete", F.lit(False)).alias("gone"), *KEYS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
        one = F.struct(*KEYS, "docs", "tokens")
        of_seq = parts.groupBy("doc_id", "seq").agg(F.collect_list(F.when(~F.col("gone"), one)).alias("counts"))
        entries = of_seq.groupBy("doc_id").agg(F.max_by("counts", F.coalesce("seq", F.lit(0))).alias("counts"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(now["buckets"])).cast("int")
        entries = entries.select("doc_id", F.lit(number).cast("bigint").alias("version"), "counts", bucket.alias("bucket"))
        entries.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/log/part={name}")
        new = self.spark.read.schema(LOG).option("basePath", f"{self.path}/log").parquet(f"{self.path}/log/part={name}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many numbers as the store has buckets
        old = self._log(now["log"], touched).join(new.select(F.col("doc_id").alias("changed")), F.col("doc_id").eqNullSafe(F.col("changed")), "left_semi")
        signed = [df.select(F.lit(sign).alias("sign"), F.inline("counts")) for sign, df in ((-1, old), (1, new))]
        deltas = signed[0].union(signed[1]).groupBy(*KEYS).agg(F.sum(F.col("sign") * F.col("docs")).alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.filter("docs <> 0 or tokens <> 0").write.parquet(f"{self.path}/deltas/{name}")
        self._commit({"number": number, "batch": batch, "buckets": now["buckets"], "log": [*now["log"], name] if touched else now["log"], "deltas": [*now["deltas"], name], "expired": now["expired"]})
        if len(now["deltas"]) + 1 >= COMPACT_AFTER:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the folders of log and deltas into one each, and delete those that the merge before replaced."""
        now, name = self.state(), uuid.uuid4().hex
        merged = self._log(now["log"]).filter(F.size("counts") > 0).select("doc_id", F.lit(now["number"]).cast("bigint").alias("version"), "counts", F.pmod(F.xxhash64("doc_id"), F.lit(now["buckets"])).cast("int").alias("bucket"))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/log/part={name}")
        self._sum(now["deltas"]).write.parquet(f"{self.path}/deltas/{name}")
        replaced = [f"log/part={x}" for x in now["log"]] + [f"deltas/{x}" for x in now["deltas"]]
        self._commit({"number": now["number"] + 1, "batch": None, "buckets": now["buckets"], "log": [name], "deltas": [name], "expired": replaced})
        for folder in now["expired"]:
            path, fs = self._files(f"{self.path}/{folder}")
            fs.delete(path, True)


def counts(docs: DataFrame, version: str, op: str = "insert", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Changes that say what docs have under a tokenizer version, one row each; a null text has no tokens.  Only counts move on; texts
    stay where they are read, and columns other than the id, the text, source and lang are not."""
    return docs.select(F.col(id_column).cast("string").alias("doc_id"), F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), token_count(text_column, version).alias("tokens"))
