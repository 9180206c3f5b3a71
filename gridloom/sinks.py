"""Sinks: tables as CSV with their audit as JSON, bundles, projects, and a report of what was found."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .frame import ROW, data_columns, q
from .operators.naming import unique_name

BOM = "﻿"


def safe_name(name: str) -> str:
    return name.translate(str.maketrans("/\\ ", "___"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts in row order, with a header; empty text is quoted, so it differs from null."""
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    ordered.select(*[F.col(q(c)) for c in data_columns(df)]).write.option("header", True).option("emptyValue", '""').mode("overwrite").csv(path)


@dataclass
class _Part(WriterCommitMessage):
    place: int
    uri: str


class _OneCsvWriter(DataSourceWriter):
    """Tasks write parts beside the file; commit joins them in order, abort deletes them."""

    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.folder = f"{path}.parts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator) -> _Part:
        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        place = TaskContext.get().partitionId()
        uri = f"{self.folder}/{uuid.uuid4().hex}"  # a second attempt writes another
        with system.open_output_stream(_open(uri)[1]) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            for row in iterator:
                writer.writerow(["" if v is None else v for v in row])
        return _Part(place, uri)

    def commit(self, messages: list[_Part | None]) -> None:
        system, target = _open(self.path)
        if not self.overwrite and system.get_file_info(target).type.name != "NotFound":
            self.abort(messages)
            raise FileExistsError(self.path)
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(self.columns)
        joined = f"{_open(self.folder)[1]}.joined"
        with system.open_output_stream(joined) as out:
            out.write((BOM + head.getvalue()).encode())
            for m in sorted((m for m in messages if m), key=lambda m: m.place):
                with system.open_input_stream(_open(m.uri)[1]) as part:
                    while piece := part.read(1 << 22):
                        out.write(piece)
        system.move(joined, target)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        system, folder = _open(self.folder)
        if system.get_file_info(folder).type.name != "NotFound":
            system.delete_dir(folder)


class OneCsv(DataSource):
    """A table as one CSV file with a byte-order mark and a header, in the order of the table's partitions."""

    @classmethod
    def name(cls) -> str:
        return "one_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _OneCsvWriter(self.options["path"], schema.names, overwrite)


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_one_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte-order mark, rows in their order; nothing of it passes through the driver but bytes of parts."""
    df.sparkSession.dataSource.register(OneCsv)
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    ordered.select(*[F.col(q(c)) for c in data_columns(df)]).write.format("one_csv").option("path", path).mode("overwrite").save()


def csv_bytes(df: DataFrame) -> bytes:
    """One small table as CSV bytes with a byte-order mark: rows stream to the driver one partition at a time."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(data_columns(df))
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    for row in ordered.select(*[F.col(q(c)) for c in data_columns(df)]).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return (BOM + out.getvalue()).encode()


def audit_json(rows: DataFrame, columns: DataFrame) -> str:
    """Removed aggregate rows and columns as JSON text, non-ASCII kept."""
    plain = lambda df: [r.asDict(recursive=True) for r in df.drop(ROW).toLocalIterator()]
    return json.dumps({"aggregate_rows_removed": plain(rows), "aggregate_columns_removed": plain(columns)}, ensure_ascii=False, default=str)


def write_audit(rows: DataFrame, path: str) -> None:
    """Audit rows as JSON lines, from the executors."""
    rows.drop(ROW).write.mode("overwrite").json(path)


def lineage(audits: dict[str, DataFrame], sources: list[str]) -> DataFrame | None:
    """Audits of a table's sources together, each row with its source."""
    parts = [audits[s].withColumn("source_id", F.lit(s)) for s in sources if s in audits]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def bundle(tables: dict[str, tuple[DataFrame, DataFrame | None, DataFrame | None]], target: str) -> dict[str, str]:
    """A zip of small tables: name.csv and, where something was removed, name_metadata.json. Equal names get a number."""
    import zipfile

    names: dict[str, str] = {}
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for display, (frame, rows, columns) in tables.items():
            name = unique_name(safe_name(display), names.values())
            names[display] = name
            z.writestr(f"{name}.csv", csv_bytes(frame))
            if rows is not None and columns is not None and (rows.head(1) or columns.head(1)):
                z.writestr(f"{name}_metadata.json", audit_json(rows, columns))
    return names


def save_project(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet and a manifest, itself a table, of their names and folders."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for i, (name, frame) in enumerate(tables.items()):
        frame.write.mode("overwrite").parquet(f"{path}/t{i}")
        entries.append((name, f"t{i}"))
    spark.createDataFrame(entries, "name string, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{path}/{r['folder']}") for r in spark.read.schema("name string, folder string").json(f"{path}/manifest").orderBy("folder").collect()}


def tree_text(file: str, tables: DataFrame) -> str:
    """A file's sheets and tables as an indented list; tables is a catalog (a row a table)."""
    lines = [file]
    rows = tables.select("sheet", "table_id", "title").orderBy("sheet", "table_id").collect()
    for sheet in dict.fromkeys(r["sheet"] for r in rows):
        lines.append(f"  {sheet}")
        lines += [f"    {r['table_id']}" + (f": {r['title']}" if r["title"] else "") for r in rows if r["sheet"] == sheet]
    return "\n".join(lines)
