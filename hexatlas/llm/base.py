"""Registration and the few helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexatlas.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, expected: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if expected is not None:
            ORACLES[name] = expected
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(ids: Column, folds: int) -> Column:
    """``crc32(id as text) mod folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def aside(docs: DataFrame, used: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` applied to ``docs`` while the columns that it does not use have other names.

    So no column of ``docs`` clashes with one that ``step`` makes for itself. Columns that come
    back new follow those of ``docs`` and replace any of the same name.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in used}
    done = step(docs.toDF(*[names.get(c, c) for c in docs.columns]))
    new = [c for c in done.columns if c not in used and c not in names.values()]
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in new], *new)


#: Texts are up to hundreds of kilobytes each: a Python worker gets this many at a time.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile hand Python workers ``BATCH_ROWS`` rows at a time, or fewer where the session says so."""
    before = spark.conf.get(_BATCH)
    # zero and less mean no limit
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Folders of bucketed tables end so.
_TABLE = ".table"


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].removesuffix(_TABLE).replace("-", "_")


class Scratch:
    """Tables of one job in the shared folder, each deleted when the next ones stand.

    A table is only deleted after everything derived from it is written, so a lost executor
    never needs it again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        with small_batches(self.spark):
            df.write.parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, label: str) -> DataFrame:
        """``df`` as a table of the session that is bucketed by ``key``: later joins on it do not move it again."""
        path = scratch_path(self.spark, label) + _TABLE
        name = _table_name(path)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with small_batches(self.spark):
            df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        self.paths.setdefault(label, []).append(path)
        return self.spark.table(name)

    def drop(self, *labels: str) -> None:
        for label in labels:
            for path in self.paths.pop(label, []):
                if path.endswith(_TABLE):  # leaves the session's list of tables as it was
                    self.spark.sql(f"DROP TABLE {_table_name(path)}")
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
