"""Writers. Every one is a plain partitioned write; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.operators.archive import deidentified


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings, one folder per check."""
    findings.write.mode("overwrite").partitionBy("check").format(fmt).save(path)


def write_claim_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def write_public_catalog(catalog: DataFrame, path: str) -> None:
    """The list that leaves the house: risk, number of dependents, kind, url; no card names."""
    deidentified(catalog).write.mode("overwrite").csv(path, sep="\t")


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").parquet(path)


def write_edits(edits: DataFrame, path: str) -> None:
    """An edit batch in row form, ready for ``apply_edits``."""
    edits.where(~F.col("skipped")).drop("skipped").write.mode("overwrite").json(path)


def write_diff(diff: DataFrame, places: DataFrame, path: str, legacy: DataFrame | None = None) -> None:
    """Changed cards, changed places and, where given, the one row that says whether the reversions changed."""
    diff.write.mode("overwrite").parquet(f"{path}/cards")
    places.write.mode("overwrite").parquet(f"{path}/places")
    if legacy is not None:
        legacy.write.mode("overwrite").parquet(f"{path}/legacy")
