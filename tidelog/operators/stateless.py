"""Operators that look at one record at a time. All are projections and filters that Catalyst can move."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import header

Expr = Column | str


def column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def holds(p: Expr) -> Column:
    """A predicate with two values: null is false."""
    return F.coalesce(column(p), F.lit(False))


def filter_(df: DataFrame, predicate: Expr) -> DataFrame:
    return df.where(holds(predicate))


def filter_not(df: DataFrame, predicate: Expr) -> DataFrame:
    return df.where(~holds(predicate))


def map_(df: DataFrame, columns: dict[str, Expr]) -> DataFrame:
    """Replace any columns of the record; all see the record as it was."""
    return df.withColumns({k: column(e) for k, e in columns.items()})


def map_values(df: DataFrame, value: Expr) -> DataFrame:
    return map_(df, {"value": value})


def map_key_value(df: DataFrame, key: Expr, value: Expr) -> DataFrame:
    return map_(df, {"key": key, "value": value})


def select_key(df: DataFrame, key: Expr) -> DataFrame:
    """Another key; the record stays on its partition."""
    return map_(df, {"key": key})


def flat_map(df: DataFrame, values: Expr, into: str = "value") -> DataFrame:
    """One record for each element of an array; none for an empty or null one."""
    columns = [c for c in df.columns if c != into]
    out = df.select(*columns, F.explode(column(values)).alias(into))
    return out.select(*df.columns) if into in df.columns else out


def peek(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Observe metrics as records pass; the records stay as they are."""
    return df.observe(name, *(metrics or (F.count(F.lit(1)).alias("records"),)))


def branch_of(predicates: Sequence[Expr]) -> Column:
    """The index of the first predicate that holds; null where none does."""
    out = F.when(holds(predicates[0]), F.lit(0))
    for k, p in enumerate(predicates[1:], 1):
        out = out.when(holds(p), F.lit(k))
    return out


def branch(df: DataFrame, *predicates: Expr) -> list[DataFrame]:
    """One DataFrame for each predicate: records of which it is the first that holds."""
    return [df.where(branch_of(predicates) == k) for k in range(len(predicates))]


@dataclass(frozen=True)
class Match:
    """Conditions that all hold, and if there are any in ``any``, at least one of those too. An empty one matches all."""

    header_equals: dict[str, bytes | str] = field(default_factory=dict)
    header_exists: Sequence[str] = ()
    key_prefix: bytes | str | None = None
    key_regex: str | None = None
    any: Sequence[Match] = ()

    def column(self) -> Column:
        out = F.lit(True)
        for name, value in self.header_equals.items():
            want = F.lit(value.encode() if isinstance(value, str) else value)
            out = out & (header(name) == want)
        for name in self.header_exists:
            out = out & F.array_contains(F.transform("headers", lambda h: h["key"]), name)
        if self.key_prefix:
            prefix = self.key_prefix.encode() if isinstance(self.key_prefix, str) else self.key_prefix
            out = out & F.startswith("key", F.lit(prefix))
        if self.key_regex:
            out = out & F.decode(F.coalesce("key", F.lit(b"")), "UTF-8").rlike(self.key_regex)
        if self.any:
            either = F.lit(False)
            for m in self.any:
                either = either | m.column()
            out = out & either
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rule:
    match: Match
    targets: Sequence[str]


def route(df: DataFrame, rules: Sequence[Rule], into: str = "target") -> DataFrame:
    """A record for each distinct target of all rules that match it."""
    none = F.array().cast("array<string>")
    hits = [F.when(r.match.column(), F.array(*[F.lit(t) for t in r.targets])).otherwise(none) for r in rules]
    return df.select("*", F.explode(F.array_distinct(F.flatten(F.array(*hits)))).alias(into))


def transform(df: DataFrame, columns: dict[str, Expr], keep: Expr | None = None, error: Expr | None = None) -> DataFrame:
    """Map and filter at once; where ``error`` is not null the batch fails with it."""
    out = df
    if error is not None:
        failed = column(error)
        out = out.where(F.when(failed.isNotNull(), F.raise_error(failed.cast("string")).cast("boolean")).otherwise(True))
    kept = out.where(holds(keep)) if keep is not None else out
    return map_(kept, columns)


def safely(df: DataFrame, result: str, value: Callable[[DataFrame], Column], error: Column) -> tuple[DataFrame, DataFrame]:
    """Records that ``value`` can be made of, and dead letters: the others as they were, with ``error``.

    ``value`` should give null where it fails (``try_`` functions do) and ``error`` say why.
    """
    made = df.withColumn("_made", value(df))
    good = made.where(F.col("_made").isNotNull()).withColumn(result, F.col("_made")).drop("_made")
    bad = made.where(F.col("_made").isNull()).withColumn("error", error).drop("_made")
    return good, bad


def applied(df: DataFrame, f: Callable[[bytes | None], bytes | None], on: str = "value") -> DataFrame:
    """``df`` with ``_made``, what ``f`` gives for each record's value, or the error that it raised."""

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((f(v), None))
            except Exception as e:  # the record's own failure, which goes along with it
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return df.withColumn("_made", F.pandas_udf(run, "value binary, error string")(on))
