"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import hashlib
import pickle
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from math import isqrt

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of cut() inside the innermost passing().
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one is made only where none is set and all executors
    are this machine (tests)."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="tessella-"))
    return at.rstrip("/")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def write_table(df: DataFrame, name: str) -> str:
    df.write.parquet(path := f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages and lost executors start from the files."""
    spark = df.sparkSession
    path = write_table(df, name)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (own := _written.get()) is not None:
        own.append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut() writes inside is deleted at the end, but for the tables handed to the function this gives. A result that
    leaves the block must read only from those."""
    outer, own, stay = _written.get(), [], []
    token = _written.set(own)
    try:
        yield lambda t: stay.append(t._written_to) or t
    finally:
        _written.reset(token)
        for t in own:
            if t._written_to not in stay:
                drop_table(t.sparkSession, t._written_to)
            elif outer is not None:
                outer.append(t)


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that no plan reads any more."""
    for t in tables:
        drop_table(t.sparkSession, t._written_to)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished plans that nothing refers to. Python lets go of its
    handles in the first turn, the JVM of the plans in the second."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def blocks(docs: DataFrame, text: str = "text", per_block: int = 6 << 20, least: int = 240) -> int:
    """How many blocks of about per_block characters hold all texts; from 10 GB on, blocks grow with the input's root."""
    chars = docs.agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 64)).first()[0] or 0
    return max(least, -(-chars // max(per_block, 64 * isqrt(chars))))


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object with the classes it needs, so that executors need no copy of this package. For objects of a
    bounded size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    """What ship() sent. A Python worker keeps the last such object for its next tasks, with what it remembers."""
    kept = sys.__dict__.setdefault("_tessella_received", {})
    key = hashlib.md5(shared.value).digest()
    if key not in kept:
        kept.clear()
        kept[key] = pickle.loads(shared.value)
    return kept[key]


def by_size(rows: Iterator[tuple], size, most: int = 8 << 20) -> Iterator[list[tuple]]:
    """Lists of rows of about `most` bytes together; one row may be larger."""
    out: list[tuple] = []
    n = 0
    for r in rows:
        out.append(r)
        n += size(r)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out
