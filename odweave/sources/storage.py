"""Tables stored so that readers skip and joins don't shuffle: sorted by ranges, in buckets, or chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from odweave.operators.frames import chunked
from odweave.sources.shared import remove_folder, shared_folder

#: Bytes of a row group of sorted files; footers hold the least and largest key of each.
ROW_GROUP = 8 << 20
#: Rows of a folder of chunks, about.
FOLDER_ROWS = 1 << 17


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, row_group: int = ROW_GROUP, form: str = "parquet") -> None:
    """Write a table in the order of keys: files hold ranges of them, and their names' order is the keys'.

    A filter on the first keys then reads the few files and row groups whose footers fit. Rows of one first key may
    stand in several files, as the further keys cut ranges too.
    """
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    out = ranged.sortWithinPartitions(*keys).write.option("header", True) if form == "csv" else ranged.sortWithinPartitions(*keys).write.option("parquet.block.size", row_group)
    out.format(form).mode("overwrite").save(path)


def ordered_rows(spark: SparkSession, path: str, schema) -> Iterator:
    """The rows of sorted files one after another, a file at a time, without a sort."""
    files = sorted(spark.read.schema(schema).parquet(path).inputFiles())
    for f in files:
        yield from spark.read.schema(schema).parquet(f).toLocalIterator()


def write_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int) -> DataFrame:
    """A table in buckets of its keys, each sorted by them: tables of as many buckets join on the keys without an exchange."""
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


class Chunks:
    """The runs of size rows of an ordered table, each a DataFrame of its own, written once and read by its number.

    Iterating gives the chunks in order; each costs a job, and reads from one folder only. Small chunks share a folder,
    whose file is in their order. each runs a function on all chunks in one job. close, or leaving a with block, deletes
    them.
    """

    def __init__(self, df: DataFrame, size: int, key: str, ties: Sequence[str] = ()):
        self.spark, self.folder = df.sparkSession, shared_folder(df.sparkSession, "chunks")
        all_ = chunked(df, size, key, ties)
        self.shared = max(1, FOLDER_ROWS // size)
        all_ = all_.withColumn("chunk_id_folder", F.floor(F.col("chunk_id") / self.shared))
        self.schema = all_.schema
        ordered = all_.repartition("chunk_id_folder").sortWithinPartitions("chunk_id_folder", "chunk_id")
        ordered.write.option("parquet.block.size", ROW_GROUP).partitionBy("chunk_id_folder").parquet(self.folder)
        self.count = -(-self._stored().count() // size)  # from the files' footers

    def _stored(self, within: str = "") -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(self.folder + within)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> DataFrame:
        if not 0 <= i < self.count:
            raise IndexError(i)
        at = i // self.shared
        return self._stored(f"/chunk_id_folder={at}").filter((F.col("chunk_id_folder") == at) & (F.col("chunk_id") == i)).drop("chunk_id_folder", "chunk_id")

    def __iter__(self) -> Iterator[DataFrame]:
        return (self[i] for i in range(self.count))

    def each(self, function: Callable, schema: StructType | str) -> DataFrame:
        """The rows that function returns for each chunk, both Arrow tables, called in tasks; lazy, so to be read before close."""
        return self._stored().drop("chunk_id_folder").groupBy("chunk_id").applyInArrow(lambda t: function(t.drop_columns("chunk_id")), schema)

    def close(self) -> None:
        """Delete the chunks."""
        remove_folder(self.spark, self.folder)
        self.count = 0

    def __enter__(self) -> Chunks:
        return self

    def __exit__(self, *_) -> None:
        self.close()
