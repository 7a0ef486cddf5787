"""Exports to one clean observation table with its quarantine logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from creekline.functions.specs import TargetSpec
from creekline.operators.collapse import collapse_replicates
from creekline.operators.quarantine import ingest_audit, quarantine_cells, quarantine_rows, wide_to_long
from creekline.sources.sinks import write_table

CANONICAL = ["site", "target", "date"]


@dataclass
class Ingested:
    observations: DataFrame
    excluded_rows: DataFrame
    excluded_cells: DataFrame
    audit: DataFrame
    good: dict[str, DataFrame]


def ingest(exports: dict[str, DataFrame], specs: Sequence[TargetSpec], snapshot: str) -> Ingested:
    """``exports`` maps a source name to its landed table (see ``sources.survey.land_survey``)."""
    good, excluded, valid, rejected, audits = {}, [], [], [], []
    for source, raw in exports.items():
        kept, out = quarantine_rows(raw, snapshot)
        good[source] = kept
        excluded.append(out)
        audits.append(ingest_audit(raw, snapshot))
        measured, bad = quarantine_cells(wide_to_long(kept, specs, source), specs)
        valid.append(measured)
        rejected.append(bad)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    observations = collapse_replicates(union(valid))
    return Ingested(observations, union(excluded), union(rejected), union(audits), good)


def write_ingested(result: Ingested, out: str) -> None:
    write_table(result.observations, f"{out}/clean_measurements", ["target"], CANONICAL)
    write_table(result.excluded_rows, f"{out}/excluded_rows")
    write_table(result.excluded_cells, f"{out}/excluded_measurements")
    write_table(result.audit, f"{out}/audit")
