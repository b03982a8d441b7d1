"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1 << 30


def remainder(id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % of


def sample_by_label(rows: DataFrame, label: str, key: Column, quota: int | dict) -> DataFrame:
    """About ``quota`` rows of each label at most (a dict gives each label's own), chosen by a hash of ``key``; all where a label has fewer.

    The labels' counts set a bar on the hash, so no label's rows meet in one task. A final limit makes
    the bound strict.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    quotas = {v: quota[v] if isinstance(quota, dict) else quota for v in counts}
    bar = F.lit(0)
    for value, n in counts.items():
        bar = F.when(F.col(label) == value, F.lit(min(SPREAD, SPREAD * quotas[value] // n))).otherwise(bar)
    chosen = rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(SPREAD)) < bar)
    return chosen.limit(2 * max(1, sum(quotas.values())))
