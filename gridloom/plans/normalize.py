"""The normalisation plan of one table, and of a catalog of tables. The order of steps is part of the result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, col, data_columns
from ..operators import aggregates, fill, reshape
from ..operators.naming import Namer
from ..operators.relate import Table


@dataclass
class Options:
    pivot: str | tuple[str, int] = "hold"
    namer: Namer = field(default_factory=Namer)
    file: str | None = None
    axes: reshape.HeaderAxes | None = None


@dataclass
class Result:
    frame: DataFrame
    held: bool = False
    breakdown: DataFrame | None = None
    unit_master: DataFrame | None = None
    row_audit: DataFrame | None = None
    column_audit: DataFrame | None = None
    rollups: DataFrame | None = None
    checks: DataFrame | None = None
    log: list[str] = field(default_factory=list)


def _finish(df: DataFrame, out: Result) -> DataFrame:
    """Aggregates, units and empty columns: for the main table and for what was split off it."""
    protected = F.col("__protected") if "__protected" in df.columns else None
    removal = aggregates.remove_aggregates(df, protected)
    df = removal.frame.drop("__protected")
    if out.row_audit is None:
        out.row_audit, out.column_audit = removal.row_audit, removal.column_audit
    if units := reshape.split_units(df):
        df = units.frame
        out.unit_master = units.master if out.unit_master is None else out.unit_master
    return fill.drop_invalid_columns(df)


def _sample(df: DataFrame, rows: int = 20) -> list[dict]:
    """The table's first rows, for a Namer to look at; they decide nothing else."""
    return [r.asDict() for r in df.orderBy(ROW).limit(rows).select(*[col(c) for c in data_columns(df)]).collect()]


def _place_axis(df: DataFrame, labels: int, namer: Namer) -> DataFrame:
    """Axis and values after all labels, or where a Namer wants them: (a label, before or after)."""
    names = data_columns(df)
    wanted = namer.axis_position(names[:labels]) if labels > 1 else None
    if not wanted or wanted[0] not in names[:labels] or wanted[1] not in ("before", "after"):
        return df
    return df.select(ROW, *[col(c) for c in reshape.place_axis(names, names[labels:], *wanted)])


def normalize(table: Table, options: Options | None = None) -> Result:
    """Pivot, axes or transposition, splits, hierarchy, fill, "of which" rows, aggregates, units, columns; then stacking."""
    options = options or Options()
    df, out = table.frame, Result(table.frame)
    pivoted = False
    if info := reshape.detect_key_value(df):
        wide = reshape.decide_pivot(df, info, options.pivot)
        if wide is None:
            out.held = True
            out.log.append(f"held: {len(info.attributes)} attributes")
            return out
        df, pivoted = wide, wide is not df
        out.log.append("pivot")
    declined = False
    if options.axes is not None:
        names = options.namer.dimension_axes([list(a) for a in options.axes.axes])
        declined = not names
        if names:
            df = reshape.stack_header_axes(df, options.axes, names["names"], names["value"], names.get("indicator"), options.namer)
            out.log.append("axes")
    elif not pivoted and type(options.namer).transpose is not Namer.transpose and (name := options.namer.transpose(_sample(df))):
        df = reshape.transpose(df, name)
        out.log.append("transpose")
    if splits := reshape.detect_name_splits(df):
        df = reshape.split_columns(df, splits)
        out.log.append("split")
    if (found := reshape.detect_annotations(df)) and (names := options.namer.annotation_names(found)):
        df = reshape.split_annotations(df, names)
        out.log.append("annotations")
    if level := reshape.detect_hierarchy(df):
        paths = reshape.sample_paths(df, level) if type(options.namer).level_names is not Namer.level_names else []
        names = (options.namer.level_names(paths) if paths else None) or reshape.level_names(level.column, level.depth)
        df = reshape.expand_hierarchy(df, level, names)
        df, out.rollups = aggregates.rollup_rows(df, names)
        out.log.append("hierarchy")
    df, filled = fill.fill_grouping_columns(df)
    out.log += [f"fill {c}" for c in filled]
    if split := aggregates.split_of_which(df):
        df, out.checks = split.main, split.checks
        out.breakdown = _finish(split.breakdown, Result(split.breakdown))
        out.log.append("of which")
    df = _finish(df, out)
    names = data_columns(df)
    if grid := reshape.detect_wide(names, options.namer, relaxed=declined):
        df, cross = reshape.stack_wide(df, grid, namer=options.namer), None
        out.log.append("wide to long")
    elif cross := reshape.detect_cross_table(names, table.title, options.file, options.namer):
        df = reshape.stack_cross_table(df, cross, namer=options.namer)
        out.log.append("cross table")
    if found := grid or cross:
        df = _place_axis(df, len(found.labels), options.namer)
    if items := options.namer.external_metadata(options.file or "", table.sheet):
        df = reshape.add_constants(df, items)
    out.frame = df
    return out


def normalize_all(tables: list[Table], options: Options | None = None) -> list[tuple[Table, Result]]:
    """Every table, followed by the breakdown tables that were split off."""
    out = []
    for t in tables:
        r = normalize(t, options)
        out.append((Table(t.id, t.sheet, t.title, r.frame, t.notes), r))
        if r.breakdown is not None:
            out.append((Table(f"{t.id}_uchi_breakdown", t.sheet, t.title, r.breakdown), Result(r.breakdown)))
    return out
