"""From files to final tables: cells, tables, normalised tables with their audits, and what is made of them all.

A catalog is a folder that all executors share, with a batch a call of `add`: cells of the batch's files are read once,
all their tables are detected and extracted together, each is normalised, and frames and audits are written as
Parquet. A manifest, a row a table, is written last: a batch without one never happened, and one that runs again
overwrites itself. So files may come all at once or bit by bit, and earlier ones are never read again.
"""

from __future__ import annotations

import os.path
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..frame import ROW, col, stored
from ..operators import grid, headers
from ..operators.naming import unique_columns
from ..operators.relate import Table
from ..sources.cells import read_workbook_cells
from ..sources.delimited import cells_of, read_rows, widths_of
from .normalize import Options, normalize
from .propose import Final, propose

BOOKS, TEXTS = (".xlsx", ".xlsm"), (".csv", ".tsv", ".txt")
MANIFEST = "place long, id string, file string, sheet string, title string, notes array<string>, kind string, of string, held boolean, log array<string>, frame string, row_audit string, column_audit string, checks string, rollups string"


def paths_below(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names of the files at the paths, sorted; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return sorted(r["path"] for r in files.collect())


def read_cells(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(cells, widths of delimited rows) of workbooks and delimited files together; other files are refused by name."""
    for p in paths:
        if not p.lower().endswith(BOOKS + TEXTS):
            raise ValueError(f"{p}: neither a workbook that can be read nor a delimited file")
    books, texts = ([p for p in paths if p.lower().endswith(ends)] for ends in (BOOKS, TEXTS))
    rows = read_rows(spark, texts) if texts else None
    parts = ([cells_of(rows)] if rows is not None else []) + ([read_workbook_cells(spark, books)] if books else [])
    return stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), None if rows is None else widths_of(rows)


@dataclass
class Found:
    """A table as it was extracted, with its header rows and its place."""

    table: Table
    file: str
    heads: list[list]
    roles: list[str]


def extract_all(spark: SparkSession, paths: list[str], folder: str) -> list[Found]:
    """All tables of the files, by file, sheet and place; those of one form are stored together, sorted by table."""
    cells, widths = read_cells(spark, paths)
    places, frames = [], {}
    for k, form in enumerate(grid.extract_forms(cells, grid.detect_tables(cells, widths))):
        where = f"{folder}/form{k}"
        form.frame.repartitionByRange("__table", ROW).sortWithinPartitions("__table", ROW).write.mode("overwrite").parquet(where)
        rows = spark.read.schema(form.frame.schema).parquet(where)
        for x in form.tables:
            frames[x["__table"]] = rows.where(F.col("__table") == x["__table"]).drop("__table")
        places += form.tables
    places.sort(key=lambda x: (x["file"], x["sheet"], x["region"], x["part"]))
    titles: dict[tuple, list[dict]] = {}
    for x in places:
        titles.setdefault((x["file"], x["sheet"]), []).append(x)
    for own in titles.values():
        for x, title in zip(own, grid.propagate_title([x["title"] or "" for x in own]), strict=True):
            x["title"] = title
    return [Found(Table(x["__table"], x["sheet"], x["title"], frames[x["__table"]], list(x["notes"] or [])), x["file"], x["heads"] or [], x["roles"] or []) for x in places]


def prepare(found: Found, options: Options) -> tuple[Table, Options]:
    """A table as normalisation takes it: header rows that spell axes go along, those that say nothing leave the names."""
    df, name = found.table.frame, unquote(os.path.basename(found.file))
    names = [c for c in df.columns if c != ROW]
    axes = headers.detect_axes(found.heads, found.roles, names) if len(found.heads) > 1 else None
    if axes is None and (dropped := headers.redundant_rows(found.heads, found.roles)) and (left := headers.names_without(found.heads, found.roles, dropped)):
        df = df.select(ROW, *[col(c).alias(n) for c, n in zip(names, unique_columns(left), strict=True)])
    return replace(found.table, frame=df), replace(options, axes=axes, file=name)


def add(spark: SparkSession, path: str | list[str], folder: str, batch: int = 0, options: Options | None = None, at_once: int = 4) -> list[str]:
    """Files into the catalog as one batch; ids of its tables. at_once tables are normalised side by side."""
    home = f"{folder}/batch={batch}"
    paths = paths_below(spark, path)
    found = extract_all(spark, paths, f"{home}/extracted") if paths else []

    def work(k: int) -> list[tuple]:
        f = found[k]
        table, own = prepare(f, options or Options())
        r = normalize(table, own)
        parts = [(table.id, "main", None, r.frame)]
        parts += [(f"{table.id}_uchi_breakdown", "breakdown", table.id, r.breakdown)] if r.breakdown is not None else []
        parts += [(f"{table.id}_unit_master", "master", table.id, r.unit_master)] if r.unit_master is not None else []
        out = []
        for j, (key, kind, of, frame) in enumerate(parts):
            beside = {"frame": frame} | ({"row_audit": r.row_audit, "column_audit": r.column_audit, "checks": r.checks, "rollups": r.rollups} if kind == "main" else {})
            where = {n: f"batch={batch}/t{k}/{j}/{n}" for n, df in beside.items() if df is not None}
            for n, place in where.items():
                beside[n].write.mode("overwrite").parquet(f"{folder}/{place}")
            out.append((k * 4 + j, key, f.file, table.sheet, table.title, table.notes if kind == "main" else [], kind, of, r.held, r.log, where["frame"], *[where.get(n) for n in ("row_audit", "column_audit", "checks", "rollups")]))
        return out

    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for some in pool.map(work, range(len(found))) for row in some]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/batch={batch}")
    return [r[1] for r in rows]


def follow(spark: SparkSession, source: str, folder: str, checkpoint: str, options: Options | None = None, files_at_once: int = 1000):
    """A stream of the files that arrive below source into the catalog; a batch that runs again overwrites itself."""
    from ..streaming.files import on_each_batch_of_names

    return on_each_batch_of_names(spark, source, lambda paths, number: add(spark, paths, folder, number, options), checkpoint, files_at_once)


@dataclass
class Catalog:
    """What the batches of a folder hold; entries are manifest rows by table id, tables are what is analysed."""

    spark: SparkSession
    folder: str
    entries: dict[str, dict]
    tables: list[Table]
    _final: dict[str, Final] = field(default_factory=dict, repr=False)

    def frame(self) -> DataFrame:
        """A row a table: file, sheet, id, title, kind, what became of it."""
        return self.spark.createDataFrame([(e["file"], e["sheet"], i, e["title"], e["kind"], e["held"], e["log"]) for i, e in self.entries.items()], "file string, sheet string, table_id string, title string, kind string, held boolean, log array<string>")

    def saved(self, key: str, what: str) -> DataFrame | None:
        place = self.entries[key].get(what) if key in self.entries else None
        return self.spark.read.parquet(f"{self.folder}/{place}") if place else None

    def finals(self) -> dict[str, Final]:
        if not self._final:
            self._final.update(propose(self.spark, self.tables))
        return self._final

    def lineage(self, key: str, what: str) -> DataFrame | None:
        """What was removed from a final table's sources, each row with its source; none for masters."""
        final = self.finals()[key]
        if final.is_master:
            return None
        audits = {s: df for s in final.sources if (df := self.saved(s, what)) is not None}
        return sinks.lineage(audits, list(final.sources))

    def bundle(self, target: str, keys: list[str] | None = None) -> dict[str, str]:
        """The chosen final tables, or those recommended, with the audits of their sources, as one zip; file names by table."""
        chosen = keys if keys is not None else [k for k, f in self.finals().items() if f.recommended]
        shown: dict[str, str] = {}
        for k in chosen:
            name, n = self.finals()[k].name, 1
            while name in shown.values():
                n += 1
                name = f"{self.finals()[k].name} ({n})"
            shown[k] = name
        names = sinks.bundle({shown[k]: (self.finals()[k].frame, self.lineage(k, "row_audit"), self.lineage(k, "column_audit")) for k in chosen}, target)
        return {k: names[shown[k]] for k in chosen}


def load(spark: SparkSession, folder: str) -> Catalog:
    """The catalog of all whole batches. Sheets of one name in several files get the file's name before theirs."""
    rows = [r.asDict(recursive=True) for r in spark.read.schema(MANIFEST + ", batch long").json(f"{folder}/manifest").orderBy("batch", "place").collect()]
    files: dict[str, set[str]] = {}
    for e in rows:
        files.setdefault(e["sheet"], set()).add(e["file"])
    stem = lambda e: os.path.splitext(unquote(os.path.basename(e["file"])))[0]
    sheet = lambda e: f"{stem(e)} {e['sheet']}" if len(files[e["sheet"]]) > 1 else e["sheet"]
    entries = {e["id"]: e for e in rows}
    tables = [Table(e["id"], sheet(e), e["title"], spark.read.parquet(f"{folder}/{e['frame']}"), e["notes"] or []) for e in entries.values() if not e["held"]]
    return Catalog(spark, folder, entries, tables)


def files_to_bundle(spark: SparkSession, path: str | list[str], folder: str, target: str, options: Options | None = None) -> Catalog:
    """Files to a bundle in one call."""
    add(spark, path, folder, 0, options)
    found = load(spark, folder)
    found.bundle(target)
    return found
