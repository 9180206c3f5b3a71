"""Delimited files that arrive in a folder, as a stream of cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import CELLS
from ..sources.cells import COLUMNS, _cell, csv_rows


def stream_csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of each new file; rows are complete as a file is read whole."""
    import pandas as pd

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", "content")

    def cells(parts):
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([_cell(file, "CSV", r, c, v) for r, row in enumerate(csv_rows(content), 1) for c, v in enumerate(row, 1) if v is not None], columns=COLUMNS)

    return files.mapInPandas(cells, CELLS)


def on_each_batch_of_names(spark: SparkSession, folder: str, work: Callable[[list[str], int], None], checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Runs work(paths, batch) on the names of new files as they come, at most files_at_once of them a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder).select("path")

    def batch(found: DataFrame, number: int) -> None:
        if paths := [r["path"] for r in found.collect()]:
            work(paths, number)

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_each_batch_of_files(spark: SparkSession, folder: str, work: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Runs work(cells, widths, batch) on new files as they come, read as `read_csv_cells` reads them.

    Only the files' names stream, so a file may be of any size.
    """
    from ..sources.delimited import cells_of, read_rows, widths_of

    def batch(paths: list[str], number: int) -> None:
        rows = read_rows(spark, paths)
        work(cells_of(rows), widths_of(rows), number)

    return on_each_batch_of_names(spark, folder, batch, checkpoint, files_at_once)


def on_each_batch(cells: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs work on the cells of each micro-batch of files, all that are there."""
    return cells.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
