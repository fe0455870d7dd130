"""What the operators of this subpackage share: tables, blocks of documents and shared scratch tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: Estimated bytes of input that one block of documents holds.
BLOCK_BYTES = 4 << 20
#: Blocks that even a small table gets, so that all cores have work.
LEAST_BLOCKS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def smallest(df: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the smallest ``key`` (a uniform 64-bit hash), then of the smallest ``ties``.

    Rows are counted first, and only those below a bound that keeps about four
    times as many as are wanted are ordered, so a task's share of the order does
    not grow with the table.
    """
    total = df.count()
    if total > 8 * n:
        bound = F.lit(-(1 << 63) + int((1 << 64) * (4 * n / total)))
        few = df.where(key < bound)
        if few.limit(n).count() == n:
            df = few
    return df.orderBy(key, *ties).limit(n)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind ``df``; no job runs."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else 1 << 33


def block_count(df: DataFrame) -> int:
    return max(LEAST_BLOCKS, -(-estimated_bytes(df) // BLOCK_BYTES))


def block_of(doc_id: Column, blocks: int) -> Column:
    """The block that a document belongs to: a hash of its id, so hot sources or texts spread evenly."""
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


_open: list[list[str]] = []


@contextlib.contextmanager
def cleared():
    """Deletes, at the end, the tables that were written inside: for work whose result has been written elsewhere."""
    roots: list[str] = []
    _open.append(roots)
    try:
        yield
    finally:
        _open.remove(roots)
        for root in roots:
            delete(root)


def delete(path: str) -> None:
    """Deletes a folder of the shared file system; one that pyarrow does not know keeps it."""
    try:
        files, at = pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return
    if files.get_file_info(at).type == pafs.FileType.Directory:
        files.delete_dir(at)


@contextlib.contextmanager
def _shuffles_going(spark: SparkSession):
    """Inside, Spark removes what a query shuffled once the query ends: a table that has been written needs it no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables written below spark.checkpoint.dir: they cut lineage, are compressed and outlive lost executors.

    ``keep`` writes a table and reads it back.  Where the session names no
    folder, a temporary one is set on one machine; on a cluster that is an error,
    since its machines would not share it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            at = tempfile.mkdtemp(prefix="strata-")
            spark.sparkContext.setCheckpointDir(at)
            at = spark.sparkContext.getCheckpointDir() or at
        self.root = f"{at.rstrip('/')}/strata-{uuid.uuid4().hex}"
        self.made = 0
        for roots in _open:
            roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.last = f"{self.root}/{self.made}"
        self.made += 1
        with _shuffles_going(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
