"""Parquet tables laid out by a leading column, added to by epoch, with the range of that column in every file.

The rows of an epoch are sorted across files by (leading, second) column, so a frequent value spreads over as many files as
it needs. A small table beside them holds the lowest and highest value of each file. A reader that asks for a few values
opens the files that can hold them and no others; it lists no folders and reads no other footers.

A large table is written stretch by stretch of one of its columns: what a stretch shuffles goes before the next one begins, so
the disk holds a part of the shuffled rows at a time. Numbers are stored as differences where they do not repeat.

An epoch counts once ``commit`` has named it. Writing it again replaces it, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

EPOCH = "epoch"
FEW = 1000  # values that a reader may name one by one
STRETCHES = 8  # at most: each reads the files of its input again
STRETCH_BYTES, STRETCH_ROWS = 32 << 20, 2_000_000  # of input in a stretch, at least
STORED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.dictionary.page.size": str(8 << 20)}
# Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage. A frame that is run again makes its own.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


Span = tuple  # (low, high): values from low on and below high; None is open, and NULL lies before all values


def stretches_of(size: int, least: int) -> int:
    return min(STRETCHES, 1 + size // least)


def within(column: str, span: Span) -> Column:
    (low, high), at = span, F.col(column)
    found = F.lit(True) if high is None else at < F.lit(high)
    return at.isNull() | found if low is None else (at >= F.lit(low)) & found


def commit(spark: SparkSession, path: str, epoch: int) -> None:
    spark.createDataFrame([(epoch,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{EPOCH}={epoch}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(epoch): the epochs that count."""
    try:
        return spark.read.schema(f"number int, {EPOCH} int").parquet(f"{path}/commits").select(EPOCH)
    except AnalysisException:  # none yet
        return spark.createDataFrame([], f"{EPOCH} int")


class Ranged:
    """Rows of ``schema`` in the order of ``columns``; ``home`` is the folder whose commits count.

    A row may stand for several values of the second column: ``reach`` names the column that holds the highest of them.
    ``gaps``: paths in Parquet of columns of rising numbers, stored as differences from the first value on."""

    def __init__(
        self, spark: SparkSession, home: str, name: str, schema: StructType, columns: Sequence[str], files: int | None = None, reach: str | None = None,
        gaps: Sequence[str] = (),
    ):
        self.spark, self.home, self.path, self.schema = spark, home, f"{home}/{name}", schema
        self.columns, self.files, self.reach = list(columns), files, reach or columns[-1]
        self.stored = STORED | {f"parquet.enable.dictionary#{path}": "false" for path in gaps}

    def write(self, rows: DataFrame, epoch: int, parts: Sequence[Column] = (), spread: bool = True) -> None:
        """Write an epoch, one after another the rows that meet each of ``parts`` (all at once if there are none). The files of a part
        are sorted among each other if its rows are ``spread``; else each is sorted by itself, and rows stay in their tasks."""
        where = f"{self.path}/rows/{EPOCH}={epoch}"
        rows = rows.select(*self.schema.names)
        for k, part in enumerate(parts or [F.lit(True)]):
            own = rows.filter(part)
            if spread:
                own = own.repartitionByRange(*([self.files] if self.files else []), *self.columns)
            elif self.files:
                own = own.coalesce(self.files)
            own.sortWithinPartitions(*self.columns).write.options(**self.stored).mode("append" if k else "overwrite").parquet(where)
        lead, second = self.columns[0], self.columns[-1]
        own = self.epoch(epoch).select("_metadata.file_name", F.col(lead).alias("low"), F.col(second).alias("first"), F.col(self.reach).alias("last"))
        own = own.select("*", F.col("low").alias("high"), F.lit(1).cast("bigint").alias("rows"))
        outer = [F.min("low").alias("low"), F.max("high").alias("high")]
        inner = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows")]
        if isinstance(self.schema[lead].dataType, StringType):  # texts are sorted to find their least one: each only once a file
            own = own.groupBy("file_name", "low", "high").agg(*inner)
        ranges = own.groupBy("file_name").agg(*outer, *inner)
        ranges.write.mode("overwrite").parquet(f"{self.path}/ranges/{EPOCH}={epoch}")

    def epoch(self, epoch: int) -> DataFrame:
        """Rows as they were written under an epoch, whether it counts yet or not."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{EPOCH}={epoch}")

    def full_schema(self) -> StructType:
        return StructType([*self.schema.fields, StructField(EPOCH, IntegerType())])

    def ranges(self) -> DataFrame:
        """(file_name, low, high, first, last, rows, epoch) of the files that count."""
        return self._every_range().join(committed(self.spark, self.home), EPOCH, "left_semi")

    def _every_range(self) -> DataFrame:
        lead, second = (self.schema[c].dataType.simpleString() for c in (self.columns[0], self.columns[-1]))
        schema = f"file_name string, low {lead}, high {lead}, first {second}, last {second}, rows long, {EPOCH} int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/ranges")

    def spans(self, n: int, epoch: int | None = None) -> list[Span]:
        """Up to ``n`` spans of the leading column that hold all values between them, each with about as many files: those that
        count, or those of an epoch, whether it counts yet or not."""
        if n < 2:
            return [(None, None)]
        files = self.ranges() if epoch is None else self._every_range().filter(F.col(EPOCH) == epoch)
        least, lows = files.agg(F.min("low"), F.percentile_approx("low", [k / n for k in range(1, n)], 1000)).first()
        cuts = [None, *sorted({low for low in lows or () if low > least}), None]
        return list(zip(cuts, cuts[1:]))

    def all(self) -> DataFrame:
        every = self.spark.read.schema(self.full_schema()).parquet(f"{self.path}/rows")
        return every.join(committed(self.spark, self.home), EPOCH, "left_semi").select(*self.schema.names, EPOCH)

    def read(self, values: Sequence = (), prefixes: Sequence[str] = (), seconds: Sequence | None = None, span: Span = (None, None)) -> DataFrame:
        """Rows whose leading column is one of ``values`` or begins with one of ``prefixes`` (a few of either).

        ``seconds`` or a ``span`` narrow the second column: only files that can hold one of them are opened. The list of files to
        open is all that comes to the driver.
        """
        lead = F.col(self.columns[0])
        low, high = F.col("low"), F.col("high")
        meets, wanted = F.lit(False), F.lit(False)
        if len(values):
            held = F.array(*map(F.lit, values))
            meets = meets | F.exists(held, lambda v: (low <= v) & (v <= high))
            wanted = wanted | lead.isin(*values)
        for prefix in prefixes:
            begins = F.startswith(low, F.lit(prefix))
            meets = meets | ((high >= F.lit(prefix)) & ((low <= F.lit(prefix)) | begins))
            wanted = wanted | F.startswith(lead, F.lit(prefix))
        if seconds is not None:
            found = F.exists(F.array(*map(F.lit, seconds)), lambda v: (F.col("first") <= v) & (v <= F.col("last"))) if seconds else F.lit(False)
            meets = meets & found
            wanted = wanted & (self._holds(seconds) if seconds else F.lit(False))
        low, high = span
        if low is not None:
            meets, wanted = meets & (F.col("last") >= F.lit(low)), wanted & (F.col(self.reach) >= F.lit(low))
        if high is not None:
            meets, wanted = meets & (F.col("first") < F.lit(high)), wanted & (F.col(self.columns[-1]) < F.lit(high))
        return self.opened(meets).filter(wanted)

    def _holds(self, seconds: Sequence) -> Column:
        second = F.col(self.columns[-1])
        if self.reach == self.columns[-1]:
            return second.isin(*seconds)
        return F.exists(F.array(*map(F.lit, seconds)), lambda v: (second <= v) & (v <= F.col(self.reach)))

    def opened(self, meets: Column) -> DataFrame:
        files = [f"{self.path}/rows/{EPOCH}={r[EPOCH]}/{r['file_name']}" for r in self.ranges().filter(meets).select(EPOCH, "file_name").collect()]
        if not files:
            return self.spark.createDataFrame([], self.full_schema())
        return self.spark.read.schema(self.full_schema()).option("basePath", f"{self.path}/rows").parquet(*sorted(files))
