"""A plug-in source, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamstone.sources.tables import broadcast_if_small, fresh, row_bytes


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class QuestionSource(DataSource):
    """Numbered template questions, split over partitions: a pattern for connectors to other stores."""

    @classmethod
    def name(cls) -> str:
        return "questions"

    def schema(self) -> str:
        return "query_id bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _QuestionReader(int(self.options.get("rows", "10")), int(self.options.get("partitions", "2")), self.options.get("template", "question {}"))


class _QuestionReader(DataSourceReader):
    def __init__(self, rows: int, parts: int, template: str) -> None:
        self.rows, self.parts, self.template = rows, max(parts, 1), template

    def partitions(self) -> list[InputPartition]:
        step = -(-self.rows // self.parts)
        return [_Range(s, min(s + step, self.rows)) for s in range(0, self.rows, step)] if self.rows else []

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        ids = list(range(partition.start, partition.end))
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids, pa.int64()), "text": [self.template.format(i) for i in ids]})


class _Group(InputPartition):
    def __init__(self, file: str, group: int) -> None:
        self.file, self.group = file, group


class RowGroupSource(DataSource):
    """Parquet files read row group by row group, one a partition, and of these only the columns of the given schema: for stores that Spark has no reader for but pyarrow has."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> str:
        raise ValueError("a schema is needed")

    def reader(self, schema) -> DataSourceReader:
        return _RowGroupReader(self.options["path"], schema)


class _RowGroupReader(DataSourceReader):
    def __init__(self, path: str, schema) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.arrow = path, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, at = fs.FileSystem.from_uri(self.path)
        found = [store.get_file_info(at)] if store.get_file_info(at).is_file else store.get_file_info(fs.FileSelector(at))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        out: list[InputPartition] = []
        for f in files:
            with store.open_input_file(f) as raw:
                out += [_Group(f, g) for g in range(pq.read_metadata(raw).num_row_groups)]
        return out

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as raw:
            for batch in pq.ParquetFile(raw).iter_batches(row_groups=[partition.group], columns=self.arrow.names):
                yield from pa.Table.from_batches([batch]).select(self.arrow.names).cast(self.arrow).to_batches()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuestionSource)
    spark.dataSource.register(RowGroupSource)


def write_partitioned(df: DataFrame, path: str, *by: str, rows_a_file: int = 1_000_000, bytes_a_file: int = 128 << 20, sort: tuple[str, ...] = ()) -> None:
    """One folder a key, files sorted by some columns if asked. Rows of a key are brought together in as many tasks as its count and bytes ask for, so that small keys make one file and large ones don't end in one task."""
    k, n = fresh("__key", df), fresh("__n", df)
    key = F.struct(*by).alias(k)
    sizes = broadcast_if_small(df.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / rows_a_file), F.ceil(F.sum(row_bytes(df)) / bytes_a_file)).alias(n)), 100_000)
    dealt = df.withColumn(k, key).join(sizes, k).repartition(k, F.pmod(F.xxhash64(*df.columns), F.col(n)))
    rows = dealt.select(*df.columns)
    rows = rows.sortWithinPartitions(*by, *sort) if sort else rows
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key."""
    w, rn = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)), fresh("__rn", df)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old with the rows of new put in by key, where their version is at least as high; ties go to new."""
    mark = fresh("__new", old, new)
    both = old.withColumn(mark, F.lit(0)).unionByName(new.withColumn(mark, F.lit(1)))
    return latest(both, key, version, mark).drop(mark)
