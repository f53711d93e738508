"""Shared plumbing of the corpus operators: table access, scratch tables, Arrow helpers.

Scratch tables live under the folder named by ``spark.checkpoint.dir`` (shared by
the driver and all executors), are written by Spark's own committer, and so survive
the loss of executors.  Nothing here uses a machine-local folder on a cluster; only in
a local session without that setting (unit tests) a temporary folder is chosen.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_root, ship_package

#: White space of the contracts that name ``[\x20\x09-\x0D]``, as bytes.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of one number that are sent to every task at most.
SMALL_ROWS = 2_000_000
#: Rows from which a key counts as hot.
HOT_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, *names: str) -> None:
        """Deletes tables no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns, whatever they are called, never matter."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none is a taken column in any case of letters."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows as a saved table with a number of their own, and that column's name.

    What is decided by this number holds for one row alone, whatever its ids and texts
    repeat; the table is written once, so the numbers are the same for every reader.
    """
    (row,) = free_names(docs.columns, "_row")
    return scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without_rows(docs: DataFrame, row: str, gone: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """docs without the rows whose number is in gone (one column, of the same name).

    gone must be a saved table: it is counted, and sent to all tasks only if it is within
    the bound; else both sides are joined by row number, which no key can skew.
    """
    few = gone.count() <= bound
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def join_by_hot_key(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, hot: int = HOT_ROWS) -> DataFrame:
    """rows joined with facts, which holds one row a key and how many rows have it.

    Keys of at least ``hot`` rows are few (all rows / hot): their facts are sent to the
    tasks, so a key with a third of all rows stays where it is.  The others are shuffled.
    """
    known = F.broadcast(facts.where(F.col(count) >= hot))
    near = rows.join(known, keys)
    far = rows.join(F.broadcast(facts.where(F.col(count) >= hot).select(*keys)), keys, "left_anti").join(facts.where(F.col(count) < hot), keys)
    return near.unionByName(far)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist() if len(column) else []


def prepare(spark: SparkSession) -> None:
    """Ships the package; Arrow batches are bounded by bytes as well as by rows, so long texts do not pile up."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
