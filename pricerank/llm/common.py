"""What the operators of this subpackage share: words, hashes, and intermediate tables that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; bytes.split() without arguments splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is held whole on both sides, twice while its buffers grow. A longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, if they are larger. This changes the caller's session, as Spark has no such option of a single query."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.rstrip("b").isdigit() or int(now.rstrip("b")) not in range(1, most + 1):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pricerank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of the query that wrote them, and not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: The tables that stored() has written inside each open intermediate(), the innermost last.
_written: list[list[DataFrame]] = []


@contextmanager
def intermediate() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored() writes inside are deleted at the end, also of a failed run, but for those given to the function that this yields: whatever is read later has to be given to it.
    An intermediate() around this one deletes those in its turn. Not for several threads at once."""
    tables, kept = [], []
    _written.append(tables)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _written.pop()
        for df in tables:
            if not any(df is k for k in kept):
                discard(df)
            elif _written:
                _written[-1].append(df)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, so that a lost executor costs a reread only. Inside intermediate() the table is deleted at its end."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if _written:
        _written[-1].append(table)
    return table


def discard(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name of theirs can clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def byte_lists(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


class WordHashes(dict):
    """word -> 64-bit hash, computed once; emptied when it holds too many words."""

    def __init__(self, most: int = 100_000, seed: int = 0):
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
