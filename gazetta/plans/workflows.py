"""Whole runs: prepare and expand, compare, as jobs from file to file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import ensemble, prep
from ..operators.resolve import darwin_core_columns, to_darwin_core
from ..sources.readers import load_records, read_delimited
from ..sources.writers import default_candidates, default_expanded, export_all, export_delimited, write_delimited


def _write(df: DataFrame, path: str, names: list[str], single_file: bool) -> str:
    if single_file:
        return export_delimited(df, path, fieldnames=names)
    write_delimited(df, path, names)
    return path


def prepare(spark: SparkSession, path: str, output: str | None = None, include_existing: bool = False, max_records: int | None = None, deduplicate: bool = True, single_file: bool = True) -> dict:
    """Write the candidates of a table (one file, or a folder that all tasks write); returns the counters."""
    df = read_delimited(spark, path)
    stats = prep.filter_stats(df, include_existing, max_records, deduplicate).first().asDict()
    chosen = prep.filter_records(df, include_existing, max_records)
    out = prep.tracking_as_text(prep.deduplicate(chosen)) if deduplicate else chosen
    names = [c for c in df.columns if c != S.ROW]
    names += [c for c in (S.DEDUP_KEY, S.OCCURRENCE_IDS, S.OCCURRENCE_COUNT) if deduplicate and c not in names]
    stats["output"] = _write(out, output or default_candidates(path), names, single_file)
    return stats


def expand(spark: SparkSession, original: str, processed: str, output: str | None = None, darwin_core: bool = False, protect_existing: bool = False, single_file: bool = True) -> dict:
    """Write the original table with the results on every row; returns total, matched, unmatched."""
    df = prep.expand(read_delimited(spark, original), load_records(spark, processed), protect_existing)
    stats = prep.expand_stats(df).first().asDict()
    names = [c for c in df.columns if c not in ("__matched", S.ROW)]
    if darwin_core:
        df, names = to_darwin_core(df), darwin_core_columns(names)
    stats["output"] = _write(df, output or default_expanded(original), names, single_file)
    return stats


def compare(spark: SparkSession, primary: str, secondary: str, base: str, formats: list[str]) -> tuple[DataFrame, list[str]]:
    """Compare two result files and export the rows; returns the summary and the paths."""
    out = ensemble.compare(load_records(spark, primary), load_records(spark, secondary)).drop("__matched")
    written, _ = export_all(out, base, formats)
    return ensemble.summarise(out), [os.path.abspath(p) for p in written]
