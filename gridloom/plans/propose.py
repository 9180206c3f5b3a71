"""From normalised tables to final ones: relations, derived parts, unions, masters, selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import derive, relate
from ..operators.naming import disambiguate, infer_axis_name, strip_common_suffix


@dataclass
class Final:
    frame: DataFrame
    name: str
    sources: tuple[str, ...]
    granularity: str = "detail"
    is_integrated: bool = False
    is_minimum: bool = False
    is_master: bool = False
    recommended: bool = True
    reasons: list[str] = field(default_factory=list)


def propose(spark: SparkSession, tables: list[relate.Table]) -> dict[str, Final]:
    """Final tables by id: parts that notes and totals imply, unions of summands, masters, then every other table."""
    by_id = {t.id: t for t in tables}
    relations = relate.sum_relations(tables)
    sheets = relate.aggregate_sheets(tables)
    kinds = relate.classify(tables, relations, set(sheets))
    out: dict[str, Final] = {}
    derived: dict[derive.Proposal, relate.Table] = {}
    proposals = derive.latent_tables(tables)
    for i, p in enumerate(proposals):
        frame = derive.subtract(by_id[p.source], [by_id[k] for k in p.known]) if len(p.missing) == 1 else None
        if frame is not None:
            derived[p] = relate.Table(f"latent_{i}", by_id[p.source].sheet, p.missing[0], frame)
            out[f"latent_{i}"] = Final(frame, p.missing[0], (p.source, *p.known), recommended=False, reasons=[p.note])
    latent = derive.automatic_integrations(derived, tables)
    everyone = [*tables, *derived.values()]
    by_id = {t.id: t for t in everyone}
    auto = relate.merge_recommendations(relations, tables, set(sheets))
    single = [relate.Recommendation(r.children, (infer_axis_name([by_id[c].title or by_id[c].sheet for c in r.children]),), tuple((v,) for v in strip_common_suffix([by_id[c].title or by_id[c].sheet for c in r.children])), r.parent) for r in relations if len(r.children) >= 2]
    used: set[str] = set()
    rest = derive.clip(relate.combine_recommendations(auto, [], single), [frozenset(p.known) for p in proposals], tables)
    for i, r in enumerate(relate.validate(relate.combine_recommendations(latent, rest, []), everyone)):
        members = [by_id[s] for s in r.sources]
        doubled = derive.redundant_axes(members, list(r.axes), list(r.values))
        keep = [k for k, a in enumerate(r.axes) if a not in doubled]
        frame = derive.integrate(members, [r.axes[k] for k in keep], [tuple(v[k] for k in keep) for v in r.values])
        out[f"integrated_{i}"] = Final(frame, "_".join(r.axes), r.sources, is_integrated=True, is_minimum=True)
        used |= set(r.sources)
        for spec in derive.master_specs(r, everyone):
            out[f"master_{i}_{spec.axis}"] = Final(spec.frame(spark), f"{spec.axis}マスタ", r.sources, "master", is_master=True)
        if len(r.axes) == 2:
            parents = {v[1]: v[0] for v in r.values}
            if len(parents) == len(r.values):
                out[f"master_{i}"] = Final(derive.master(spark, r.axes[1], parents, r.axes[0]), f"{r.axes[1]}マスタ", r.sources, "master", is_master=True)
    names = disambiguate({t.id: (t.sheet, t.title or t.id) for t in tables})
    for t in tables:
        kind, least = kinds[t.id]
        out[t.id] = Final(t.frame, names[t.id], (t.id,), kind, is_minimum=least and t.id not in used, is_master=kind == "master", recommended=least and t.id not in used)
    return out
