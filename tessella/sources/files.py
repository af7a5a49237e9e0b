"""Reading and writing the text files of a linkage run: raw TSV without quoting, id lists, manifests and logs."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.operators.blocking import PAIR
from tessella.operators.contracts import ContractError
from tessella.operators.decisions import id_lists
from tessella.operators.evaluation import explode_lists
from tessella.operators.sampling import numbered

S1, CAND = PAIR
SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
RAW = {"header": True, "sep": "\t", "quote": "", "escape": "", "nullValue": "\u0000", "emptyValue": ""}


def data_dir(path: str | None = None, variable: str = "LINKAGE_DATA_DIR") -> Path:
    """The dataset's root, from the argument or the environment; it must have train and test."""
    root = Path(path or os.environ.get(variable, "data"))
    if missing := [n for n in ("train", "test") if not (root / n).is_dir()]:
        raise FileNotFoundError(f"{root} lacks {missing}")
    return root


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; on one machine a temporary one."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="tessella-"))
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that models that pass over it many times, and lost executors,
    start from files."""
    df.write.parquet(at := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file as it stands: no quoting, no missing values, every column a string; '' for empty fields.
    Compressed files are read too, each by one task: convert() large ones once."""
    df = spark.read.options(**RAW).csv(path).fillna("")
    return df.select(columns) if columns else df


def convert(spark: SparkSession, tsv: str, parquet: str) -> DataFrame:
    """Parquet beside a TSV file, written again if the TSV is newer; later reads prune columns and push filters down."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = lambda p: (jvm.Path(p).getFileSystem(conf), jvm.Path(p))
    (fs, src), (out, done) = at(tsv), at(f"{parquet}/_SUCCESS")
    if not out.exists(done) or out.getFileStatus(done).getModificationTime() < fs.getFileStatus(src).getModificationTime():
        read_tsv(spark, tsv).write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet)


def load_source(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a source; what is not asked for is not read."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df.select(columns)


def pool(s2: DataFrame, s3: DataFrame, columns: list[str] = SOURCE_COLUMNS) -> DataFrame:
    return s2.select(columns).unionByName(s3.select(columns))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, ordinal) of an id file, in file order; commas in .csv files, else tabs. Ids start with S1-.

    Text files are read with their position, so the order is that of the file however it is split.
    """
    df = spark.read.options(**(RAW | {"sep": "," if path.endswith(".csv") else "\t"})).csv(path)
    name = next((c for c in (S1, "entity_id") if c in df.columns), None)
    if name is None:
        raise ContractError("no column source1_entity_id or entity_id")
    ids = df.select(F.col(name).alias(S1), F.monotonically_increasing_id().alias("_at"))
    if not ids.where(~F.coalesce(F.col(S1).startswith("S1-"), F.lit(False))).isEmpty():
        raise ContractError("ids must start with S1-")
    return numbered(ids, "_at").select(S1, "ordinal")


def prefix(ids: DataFrame, n: int) -> DataFrame:
    """The first n ids of a file."""
    return ids.where(F.col("ordinal") < n)


def candidates(df: DataFrame, max_rank: int | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Candidates to a rank and of some S1; the rank filter reaches a Parquet scan."""
    out = df if max_rank is None else df.where(F.col("rank") <= max_rank)
    return out if universe is None else out.join(universe.select(S1).distinct(), S1, "left_semi")


def whole_groups(df: DataFrame, universe: DataFrame, most: int) -> DataFrame:
    """All candidates of some S1; an error, and never a cut, if they exceed `most`."""
    out = candidates(df, universe=universe)
    if (n := out.count()) > most:
        raise ContractError(f"{n} candidates, at most {most} are allowed")
    return out


def covered_once(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, country) of an id set, which must cover it exactly once."""
    out = records.select("entity_id", "country").join(ids.select(F.col(S1).alias("entity_id")).distinct(), "entity_id", "left_semi")
    want, got = ids.select(S1).distinct().count(), out.agg(F.count("*"), F.count_distinct("entity_id")).first()
    if (got[0], got[1]) != (want, want):
        raise ContractError(f"{want} ids, {got[0]} records of {got[1]}")
    return out


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(universe, pairs) of a ground-truth file of comma lists."""
    wide = read_tsv(spark, path, [S1, "matched_entity_ids"])
    return wide.select(S1), explode_lists(wide, "matched_entity_ids")


def write_tsv(df: DataFrame, path: str) -> None:
    """Part files without quoting, LF at line ends."""
    df.write.mode("overwrite").options(header=True, sep="\t", quote="\u0000", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)


def write_lists(universe: DataFrame, pairs: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    """One row for each S1 of the universe (S1, ordinal), in its order: sorted distinct ids or ''. A universe that
    repeats an id is an error; pairs of other S1 are left out. Rows are range-partitioned by ordinal, so part files in
    name order are the file in order."""
    if not universe.groupBy(S1).count().where("count > 1").isEmpty():
        raise ContractError("the universe repeats an id")
    lists = id_lists(universe, pairs, column).join(universe, S1)
    write_tsv(lists.orderBy("ordinal").select(S1, column), path)


def joined_file(spark: SparkSession, parts: str, target: str) -> None:
    """Part files as one local file with one header, put in place by a rename."""
    files = sorted(Path(parts).glob("part-*"))
    staged = Path(f"{target}.part")
    with staged.open("wb") as out:
        header = None
        for f in files:
            with f.open("rb") as rows:
                first = rows.readline()
                if header is None:
                    out.write(header := first)
                elif first and first != header:
                    raise ContractError(f"{f} has another header")
                while block := rows.read(1 << 20):
                    out.write(block)
    staged.replace(target)


def sha256_file(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def ids_hash(ids: DataFrame, column: str = S1) -> str:
    """A digest of a set of ids that does not depend on their order: SHA-256 over sums of per-id hashes and their count."""
    h = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    g = F.conv(F.substring(F.sha2(F.col(column), 256), 13, 12), 16, 10).cast("decimal(38,0)")
    n, a, b = ids.select(column).distinct().agg(F.count("*"), F.sum(h), F.sum(g)).first()
    return hashlib.sha256(f"{n}|{a}|{b}".encode()).hexdigest()


def write_json(path: str | Path, value: dict) -> None:
    """JSON put in place by a rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(path.name + ".part")
    staged.write_text(json.dumps(value, indent=2, sort_keys=True), encoding="utf-8")
    staged.replace(path)


def log_run(path: str | Path, **facts) -> dict:
    """Append one JSON line with the time, the commit if there is one, and the peak memory of this process."""
    import resource

    git = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True)
    row = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "commit": git.stdout.strip() or None, "peak_rss_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, **facts}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, sort_keys=True) + "\n")
    return row


def write_manifest(path: str | Path, train: DataFrame, validation: DataFrame, seed: str) -> dict:
    """Counts and digests of a split."""
    m = {"train_count": train.distinct().count(), "validation_count": validation.distinct().count(), "train_sha256": ids_hash(train), "validation_sha256": ids_hash(validation), "seed": seed}
    write_json(path, m)
    return m


def verify_manifest(path: str | Path, train: DataFrame, validation: DataFrame) -> None:
    """An error if a split differs from its manifest, or if its sides overlap."""
    m = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, ids in (("train", train), ("validation", validation)):
        if (ids.distinct().count(), ids_hash(ids)) != (m[f"{name}_count"], m[f"{name}_sha256"]):
            raise ContractError(f"{name} ids differ from the manifest")
    if not train.select(S1).intersect(validation.select(S1)).isEmpty():
        raise ContractError("train and validation overlap")


def write_scores(scores: DataFrame, path: str, batch: str) -> bool:
    """A batch of scores as its own partition of a Parquet table; False if it is there. A run that died leaves no
    success mark, and its batch is written anew."""
    spark = scores.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    scores.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return True


def read_scores(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """All batches together, to a rank."""
    df = spark.read.parquet(path)
    return df if max_rank is None else df.where(F.col("rank") <= max_rank)
