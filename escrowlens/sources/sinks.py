"""CSV export (§2 A10); appends and upserts are in ``sources.versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from escrowlens.session import scratch_path


def export_csv(df: DataFrame, name: str) -> str:
    """Export rows as CSV with a header (one folder of part files)."""
    path = scratch_path(df.sparkSession, f"export-{name}")
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
