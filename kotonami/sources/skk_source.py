"""A data source `skk`: dictionary files as rows (line_no, line), in any charset.

    spark.dataSource.register(SkkSource)
    spark.read.format("skk").option("encoding", "euc-jp").load("dict/*")

Each file is one partition; its lines are read as a stream. Bytes that the charset lacks become U+FFFD.
"""

from __future__ import annotations

import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SkkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skk"

    def schema(self) -> str:
        return "path STRING, src_rank INT, line_no INT, line STRING"

    def reader(self, schema) -> DataSourceReader:
        return SkkReader(self.options)


class SkkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((rank, path)) for rank, path in enumerate(sorted(glob.glob(self.path)))]

    def read(self, partition):
        rank, path = partition.value
        with open(path, encoding=self.encoding, errors="replace", newline="\n") as f:
            for n, line in enumerate(f):
                yield path, rank, n, line.rstrip("\r\n")
