"""File sources and sinks: directory listings as a data source, whole files, and text with a chosen write mode."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomkit.schemas import DIRECTORY_ENTRY


class DirectorySource(DataSource):
    """spark.read.format("directory").option("paths", "a:b").load(): the entries of directories, one partition each.

    Directories are looked at by the task that reads them, so they have to be visible from the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return DIRECTORY_ENTRY

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options["paths"].split(os.pathsep))


class DirectoryReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, bool]]:
        with os.scandir(partition.value) as entries:
            for e in entries:
                yield partition.value, e.name, e.is_dir()


def directory_entries(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(DirectorySource)
    return spark.read.format("directory").option("paths", os.pathsep.join(paths)).load()


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path and content (bytes) of each file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def write_text(df: DataFrame, path: str, mode: str = "overwrite", line_end: str = "\n") -> None:
    """Writes the single string column of a frame: a folder of part files, each row ended by `line_end`.

    Appending adds part files; the logical content is the rows in the order they are read with. Parents are made.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("Invalid mode. Use overwrite or append.")
    df.write.mode(mode).option("lineSep", line_end).text(path)
