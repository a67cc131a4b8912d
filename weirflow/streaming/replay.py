"""Stored rows as a stream in which they arrive when they did: a source whose offsets are arrival times.

`laid_out` writes the rows once into a folder per tick of arrival time. `replay` streams them: a
micro-batch holds the next tick that has rows, read by as many tasks as its files have row groups, so
each row is read once whatever the number of batches. The source remembers how far it was read in the
folder; a query that goes on from its checkpoint gets the batch that it had begun again, and then the
ticks after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from weirflow.functions.expressions import epoch_ms
from weirflow.sources.staging import shared_path

#: Below every tick.
BEFORE = -(1 << 62)


def laid_out(df: DataFrame, ts: str, tick_ms: int) -> str:
    """Writes df by ticks of `tick_ms` since its first time, and returns the folder. Rows without a time are there from the start."""
    ms = epoch_ms(F.col(ts))
    first = df.agg(F.min(ms).alias("_first"))  # a single row
    tick = F.coalesce(F.floor((ms - F.col("_first")) / tick_ms), F.lit(0))
    timed = df.join(F.broadcast(first), F.lit(True)).withColumn("_tick", tick).drop("_first")
    folder = shared_path(df.sparkSession)
    timed.repartitionByRange("_tick", ts).write.partitionBy("_tick").parquet(folder)
    return folder


def replay(spark: SparkSession, folder: str, schema: StructType | str, reader: str | None = None) -> DataFrame:
    """The rows of `laid_out` as a stream. reader: a name under which the place is remembered; the same name goes on from there, without one the stream
    begins anew. Streams of one query need names of their own."""
    spark.dataSource.register(Arrivals)
    schema = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.readStream.format(Arrivals.name()).option("folder", folder).option("reader", reader or uuid.uuid4().hex).schema(schema).load()


class Files(InputPartition):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


class Arrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weirflow_arrivals"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArrivalsReader(self.options["folder"], self.options["reader"], schema)


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, folder: str, reader: str, schema: StructType):
        self.folder, self.reader, self.schema = folder.rstrip("/"), reader, schema
        self.ticks, self.at = None, BEFORE

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def _known(self) -> list[int]:
        if self.ticks is None:
            from pyarrow import fs

            files, root = self._files()
            names = [i.base_name for i in files.get_file_info(fs.FileSelector(root))]
            self.ticks = sorted(int(n.split("=")[1]) for n in names if n.startswith("_tick="))
            mark = files.get_file_info(f"{root}/_read_{self.reader}")
            if mark.type == fs.FileType.File:
                with files.open_input_stream(mark.path) as f:
                    self.at = max(self.at, json.loads(f.read())["tick"])
        return self.ticks

    def initialOffset(self) -> dict:
        return {"tick": BEFORE}

    def latestOffset(self) -> dict:
        self.at = next((t for t in self._known() if t > self.at), self.at)
        return {"tick": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.at = max(self.at, end["tick"])
        files, root = self._files()
        out: list[InputPartition] = []
        for tick in (t for t in self._known() if start["tick"] < t <= end["tick"]):
            for info in files.get_file_info(fs.FileSelector(f"{root}/_tick={tick}")):
                if info.base_name.endswith(".parquet"):
                    with files.open_input_file(info.path) as f:
                        out += [Files(info.path, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        return out

    def read(self, partition: Files) -> Iterator:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = self._files()
        wanted = to_arrow_schema(self.schema)
        with files.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
            for batch in table.iter_batches(4096, [partition.group], columns=self.schema.names):
                yield batch.select(self.schema.names).cast(wanted)

    def commit(self, end: dict) -> None:
        files, root = self._files()
        with files.open_output_stream(f"{root}/_read_{self.reader}") as f:
            f.write(json.dumps(end).encode())
