"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A change feed has rows (op, source, lang, tokenizer, old_tokens, new_tokens): `insert` adds a document with
new_tokens, `delete` takes one with old_tokens away, `revise` replaces old_tokens by new_tokens. apply() sums a batch
to one signed row a key and writes it under batch=<id>; that folder is the commit. A batch id that is there already
is left as it is, so a replay after a lost driver or a repeated delivery changes nothing, and a run that died before its
commit leaves no _SUCCESS file and is written anew. totals() adds up the committed batches; compact() folds them into
one base table without forgetting their ids.

Defined cases: a null source or language is a key of its own; a null count is 0; a null or unknown op is an error; an
empty batch commits nothing but its id; repeated rows count as often as they come; other columns of the feed are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WORD, cut, discard, shared_dir

KEY = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
#: Tokenizer versions that regular expressions express; a version's name is part of the key.
PATTERNS = {"words-1": WORD, "pieces-2": r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]"}


def n_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def signed(feed: DataFrame) -> DataFrame:
    """One signed row a key; summed before the shuffle, so a hot source costs one row a task."""
    new, old = F.coalesce(F.col("new_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op").cast("string"), F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).otherwise(new - old)
    rows = feed.select(*KEY, docs.cast("long").alias("d_docs"), tokens.cast("long").alias("d_tokens"))
    return rows.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class Rollup:
    """Totals in `path`, a folder that driver and executors share. One process writes at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _has(self, at: str) -> bool:
        fs, p = self._fs(at)
        return fs.exists(p)

    def _names(self, at: str) -> list[str]:
        fs, p = self._fs(at)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _base(self) -> str | None:
        """The newest base. It came into place by one rename, with the names of all batches folded into it."""
        return next((f"{self.path}/{n}" for n in reversed(self._names(self.path)) if n.startswith("base-")), None)

    def _folded(self) -> set[str]:
        base = self._base()
        return {n.removeprefix("_folded=") for n in self._names(base) if n.startswith("_folded=")} if base else set()

    def committed(self, batch: str) -> bool:
        return self._has(f"{self.path}/batch={batch}/_SUCCESS") or batch in self._folded()

    def batches(self) -> list[str]:
        """Ids of committed batches that are not yet folded into the base."""
        found, folded = [n.removeprefix("batch=") for n in self._names(self.path) if n.startswith("batch=")], self._folded()
        return [b for b in found if b not in folded and self._has(f"{self.path}/batch={b}/_SUCCESS")]

    def apply(self, batch: str, feed: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self.committed(batch):
            return False
        signed(feed).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; keys without documents are left out."""
        base = self._base()
        paths = ([base] if base else []) + [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.createDataFrame([], SCHEMA)
        for p in paths:  # a batch's folder names no column of the table
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).option("basePath", p).parquet(p))
        sums = rows.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold committed batches into a new base: written aside with the names of its batches, then renamed."""
        todo, old = self.batches(), self._base()
        staged = f"{self.path}/_staged"
        n = int(old.rpartition("-")[2]) + 1 if old else 0
        self.totals().select(*KEY, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens")).write.mode("overwrite").parquet(staged)
        for b in sorted(self._folded() | set(todo)):
            fs, p = self._fs(f"{staged}/_folded={b}")
            fs.create(p, True).close()
        fs, p = self._fs(staged)
        if not fs.rename(p, self._fs(f"{self.path}/base-{n:09d}")[1]):
            raise OSError(f"{staged} could not be renamed; nothing was deleted")
        if self._base() != f"{self.path}/base-{n:09d}" or not set(todo) <= self._folded():
            raise OSError("the new base is not in place; nothing was deleted")
        for at in [*([old] if old else []), *(f"{self.path}/batch={b}" for b in todo)]:
            fs.delete(self._fs(at)[1], True)


def counts(text: Column, suffix: str) -> list[Column]:
    return [n_tokens(text, v).alias(f"{suffix}{i}") for i, v in enumerate(PATTERNS)]


def feed(counted: DataFrame, op: str, old: str | None, new: str | None) -> DataFrame:
    """A change feed with a row for each tokenizer version, from columns named old0, old1, ..."""
    pick = lambda c, i: F.col(f"{c}{i}") if c else F.lit(None).cast("long")
    rows = [F.struct(F.lit(v).alias("tokenizer"), pick(old, i).alias("old_tokens"), pick(new, i).alias("new_tokens")) for i, v in enumerate(PATTERNS)]
    return counted.select("source", "lang", F.inline(F.array(*rows))).withColumn("op", F.lit(op))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents and all tokenizer versions: every document is inserted, every document with
    digits is revised (its digits are masked away), every later exact copy is deleted. Each batch comes twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    masked = F.regexp_replace("text", "[0-9]+", "")
    counted = cut(docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("fp"), F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)).alias("revised"), *counts(F.col("text"), "old"), *counts(masked, "new")), "counted")
    many = cut(counted.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("fp", "first_id"), "copies")
    later = counted.join(many, "fp").where("doc_id > first_id")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.apply("insert", feed(counted, "insert", None, "old"))
        rollup.apply("revise", feed(counted.where("revised"), "revise", "old", "new"))
        rollup.apply("delete-copies", feed(later, "delete", "new", None))
    discard(counted, many)
    rollup.compact()
    return rollup.totals()


def _sql() -> str:
    text, masked = "coalesce(text, '')", "regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g')"
    per = " UNION ALL ".join(f"SELECT source, lang, '{v}' AS tokenizer, len(regexp_extract_all({masked}, '{p}')) AS n FROM kept" for v, p in PATTERNS.items())
    return f"""
WITH kept AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY {text}) AS first_id FROM documents) WHERE doc_id = first_id)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM ({per}) GROUP BY source, lang, tokenizer
"""


SQL = _sql()
