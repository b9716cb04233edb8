"""The two generations of the contract pipeline as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.operators import audit, dedup, grid, mapping, normalize, validate
from tariffmill.session import stage


def clean_contract(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonical tables without repeats: seasons, then rates under the kept labels, bands and supplements.

    The axes of the grid feed several outputs and are short beside the rates, so each is written once to the checkpoint
    folder: its joins, and what they broadcast through the driver, are then run and let go one table at a time.
    """
    seasons = stage(dedup.dedup_seasons(tables["seasons"]))
    return {
        **tables, **{name: stage(tables[name]) for name in ("rooms", "meals")},
        "seasons": seasons,
        "rates": dedup.dedup_rates(dedup.relabel_rates(tables["rates"], seasons)),
        "child_bands": dedup.dedup_bands(tables["child_bands"]),
        "supplements": dedup.dedup_supplements(tables["supplements"]),
    }


def map_contract(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonical tables to the hotel sheet, the supplement sheet and the coverage report."""
    t = tables
    rates = t["rates"]
    axes = (t["rooms"], t["seasons"], t["meals"])
    return {
        "hotel_rows": mapping.map_hotel_rows(t["hotels"], *axes, rates, t["contracts"]),
        "supplement_rows": mapping.supplement_union(
            mapping.build_supplement_rows(t["supplements"], t["hotels"], t["rooms"]),
            mapping.meal_upgrade_rows(rates, t["hotels"], *axes),
            mapping.child_policy_supplements(t["hotels"], t["rooms"], rates, t["child_bands"]),
        ),
        "coverage": grid.coverage(*axes, rates),
    }


def process_rows(
    rows: DataFrame, columns: DataFrame, options: DataFrame, documents: DataFrame, cells: DataFrame,
    staged: bool = True,
) -> dict[str, DataFrame]:
    """Raw gen-1 rows to clean rows, notes and issues: normalise, drop skeletons, audit, validate.

    Read rows and clean rows feed several outputs each, so both are written once to the checkpoint folder when
    ``staged``.
    """
    clean, clean_columns, moved = normalize.normalize_rows(
        rows, columns, options, keep=stage if staged else lambda df: df
    )
    kept, dropped = normalize.drop_skeleton_rows(clean)
    if staged:
        kept = stage(kept)
    lost = audit.unmapped_notes(audit.unmapped_cells(cells, kept))
    thin = audit.completeness_notes(cells, documents, kept)
    shared = ["contract_id", "page", "category", "note", "confidence"]
    notes = moved.select(*shared, "linked_row_id")
    for more in (dropped, lost, thin):
        notes = notes.unionByName(more.select(*shared, F.lit(None).cast("string").alias("linked_row_id")))
    return {
        "rows": kept, "child_columns": clean_columns, "notes": notes,
        "issues": validate.validate(kept, options, documents),
    }
