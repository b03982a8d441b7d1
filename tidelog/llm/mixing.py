"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap`` copies, exponentially tilted by its size: the rates
closest in entropy to the plain ones (``cap``/2) that meet a token target per source. With
x = size / (the source's mean size) the bounded tilt is rate = cap / (1 + exp(-l x)), and l is found
by Newton's iterations on the convex dual sum(cap log(1 + exp(l x))) - l T, kept inside a bracket.
The iterations run as aggregations over a histogram (source, size, count); sums are decimals, so
that no order of addition changes them and reruns agree.

Rates become whole copies by systematic rounding over each source's documents in order of size:
running sums of rates are cut at whole numbers, which keeps tokens within one largest document of
what the rates say. Documents larger than a hundredth of their source's target are rounded first; the
dual is then solved again for the others and what is left of the target, so a source comes within
about a hundredth of its target wherever its smaller documents can make up for the large ones. Running sums go over bands of size, sizes, then salted groups of documents
of one size, so no source has to fit into a task.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share ``budget``
times all tokens; a target stops at ``cap`` times its source's tokens, and the excess goes to the
others by weight. That is min(cap S, w theta) with one theta for all, found in closed form.

Defined cases: null and empty texts have size 0 and are taken 0 times; a source without tokens has
target 0; with no tokens at all every target is 0; repeated rows are documents of their own, of which
none is told from the others: they share their copies evenly; documents of one size are taken in the
order of a hash of all columns; columns other than text and source are carried in a struct, so no name
can clash. A very long text is one document of a large size; only its number of words leaves the scan.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

UNIT = 1 << 20  # rates are kept in whole units of 1 / UNIT
EXACT = "decimal(38,12)"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    budget: float = 1.5
    cap: int = 2
    steps: int = 40
    tolerance: float = 1e-9
    large: int = 100  # documents of more than a target's hundredth are large
    group_rows: int = 5000  # documents of one size are dealt into groups of about so many


def size_of(text: Column) -> Column:
    """Number of words."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) of a histogram (source, size, n). One row a source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one row for each source: the only tables here that meet in one task
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(mix.weights)
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in mix.weights]), turn))
    full = F.col("source_size") * float(mix.cap)
    # sources in the order in which they reach their caps; before the k-th, theta uses the rest's weights
    upto = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rest = upto.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    theta = (F.sum("source_size").over(all_rows) * mix.budget - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("theta", theta).withColumn("fits", F.when(F.col("theta") * F.col("w") <= full, F.col("theta")))
    level = F.max("fits").over(all_rows)  # the first that fits is the highest
    capped = F.when(level.isNull() | (level * F.col("w") >= full), full).otherwise(level * F.col("w"))
    return per.select("source", "source_size", capped.alias("target"))


def solve(sizes: DataFrame, goals: DataFrame, mix: Mix, scratch: Scratch, tag: str) -> DataFrame:
    """(of, mean, full, lam) for each source, by Newton's iterations over the histogram."""
    mean = sizes.where(F.col("size") > 0).groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    g, m = goals.alias("g"), mean.alias("m")
    full = F.col("target") >= F.col("source_size") * float(mix.cap) * (1 - 1e-12)
    state = g.join(m, F.equal_null(F.col("g.source"), F.col("m.source"))).select(
        F.col("g.source").alias("of"), "mean", (F.col("target") / F.col("mean")).alias("goal"), (full | (F.col("target") <= 0)).alias("done"), full.alias("full"), F.when(F.col("target") <= 0, -1e6).otherwise(0.0).alias("lam"), F.lit(-1024.0).alias("lo"), F.lit(1024.0).alias("hi")
    )
    state = scratch.write(state, f"{tag}0")
    sized = sizes.where(F.col("size") > 0)
    x = F.col("size") / F.col("mean")
    rate = mix.cap / (1 + F.exp(-F.col("lam") * x))
    exact = lambda c: F.sum((c * F.col("n")).cast(EXACT)).cast("double")
    for k in range(mix.steps):
        open_ = state.where(~F.col("done"))
        sums = sized.join(open_, F.equal_null(F.col("source"), F.col("of"))).groupBy("source").agg(exact(rate * x).alias("sum"), exact(rate * (1 - rate / mix.cap) * x * x).alias("slope"))
        gap = F.col("sum") - F.col("goal")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.greatest("slope", F.lit(1e-12))
        inside = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        met = F.abs(gap) <= mix.tolerance * F.greatest("goal", F.lit(1.0))
        moved = open_.join(sums, F.equal_null(F.col("of"), F.col("source"))).select("of", "mean", "goal", met.alias("done"), "full", F.when(met, F.col("lam")).otherwise(inside).alias("lam"), low.alias("lo"), high.alias("hi"))
        state = scratch.write(moved.unionByName(state.where("done")), f"{tag}{k + 1}")
        if not state.where(~F.col("done")).head(1):
            break
    else:
        warnings.warn(f"a source's target was not met to one part in {1 / mix.tolerance:.0e} within {mix.steps} steps", stacklevel=2)
    return state.select("of", "mean", "full", F.round("lam", 9).alias("lam"))


def decide(docs: DataFrame, key: list[str], mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """``row``, a struct of the ``key`` columns, with h (a hash of all columns), size, source_size, target, rate, copies.

    One row for each row of ``docs``. The texts are read once and no exchange carries them.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    col = lambda c: F.col(f"`{c}`")
    read = scratch.write(docs.select(F.struct(*map(col, key)).alias("row"), col(source).alias("source"), size_of(col(text)).alias("size"), row_hash(docs).alias("h")), "read")
    sizes = scratch.write(read.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goals = scratch.write(targets(sizes, mix), "goals")
    tilt = mix.cap / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))
    unit = F.when((F.col("size") == 0) | F.col("mean").isNull(), 0).when(F.col("full"), mix.cap * UNIT).otherwise(F.round(tilt * UNIT)).cast("long")

    def rate(hist: DataFrame, goals: DataFrame, tag: str) -> DataFrame:
        """(src, z, n, source_size, target, unit) of a histogram."""
        state = solve(hist, goals, mix, scratch, tag)
        known = goals.join(state, F.equal_null(F.col("source"), F.col("of")), "left").select(F.col("source").alias("src"), "source_size", "target", "mean", "full", "lam")
        rated = hist.join(known, F.equal_null(F.col("source"), F.col("src"))).select(F.col("source").alias("src"), F.col("size").alias("z"), "n", "source_size", "target", unit.alias("unit"))
        return scratch.write(rated, f"{tag}-rated")

    before = lambda *by: Window.partitionBy(*by)
    prior = Window.unboundedPreceding, -1
    total = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*prior)), F.lit(0))
    cut = lambda at: F.shiftright(at + UNIT // 2, 20)
    # large documents are rounded first; the others are tilted anew to what that leaves of the target
    first = rate(sizes, goals, "all").withColumn("large", F.col("z") * mix.large > F.col("target"))
    at = total(F.col("n") * F.col("unit"), before("src").orderBy("z"))
    fixed = first.where("large").withColumn("at", at).withColumn("k", cut(F.col("at") + F.col("n") * F.col("unit")) - cut(F.col("at"))).groupBy("src").agg(F.sum(F.col("k") * F.col("z")).alias("fixed"))
    small = first.where("NOT large").groupBy("src").agg(F.sum(F.col("n") * F.col("z")).alias("source_size"), F.first("target").alias("goal")).withColumnRenamed("src", "of")
    left = small.join(fixed, F.equal_null(F.col("of"), F.col("src")), "left").select(F.col("of").alias("source"), "source_size", F.greatest(F.lit(0.0), F.least(F.col("goal") - F.coalesce("fixed", F.lit(0)), F.col("source_size") * float(mix.cap))).alias("target"))
    second = rate(first.where("NOT large").select(F.col("src").alias("source"), F.col("z").alias("size"), "n"), scratch.write(left, "left"), "small")
    own = goals.select(F.col("source").alias("of"), F.col("source_size").alias("s"), F.col("target").alias("t"))
    second = second.join(own, F.equal_null(F.col("src"), F.col("of"))).select("src", "z", "n", F.col("s").alias("source_size"), F.col("t").alias("target"), "unit", F.lit(False).alias("large"))
    groups = F.ceil(F.col("n") / mix.group_rows).cast("int")
    band = F.floor(F.log2(F.col("z") + 1) * 8).cast("int")
    rated = second.unionByName(first.where("large")).withColumns({"groups": groups, "band": band})
    rated = scratch.write(rated, "rated")
    # a document's start is the sum of the rates before it: of bands, of sizes in its band, of groups of its size, in its group
    bands = rated.groupBy("src", "large", "band").agg(F.sum(F.col("n") * F.col("unit")).alias("u")).select(F.col("src").alias("bsrc"), F.col("large").alias("bl"), F.col("band").alias("b"), total("u", before("src", "large").orderBy("band")).alias("u0"))
    starts = rated.withColumn("u1", total(F.col("n") * F.col("unit"), before("src", "large", "band").orderBy("z")))
    starts = starts.join(bands, F.equal_null(F.col("src"), F.col("bsrc")) & (F.col("large") == F.col("bl")) & (F.col("band") == F.col("b"))).withColumn("start", F.col("u0") + F.col("u1")).drop("bsrc", "bl", "b", "u0", "u1", "band", "n", "large")
    starts = scratch.write(starts, "starts")
    salted = read.join(starts, F.equal_null(F.col("source"), F.col("src")) & (F.col("size") == F.col("z"))).withColumn("salt", F.pmod("h", "groups").cast("int"))
    salted = scratch.write(salted.drop("src", "z", "groups"), "salted")
    counted = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("m"))
    counted = counted.select(F.col("source").alias("gs"), F.col("size").alias("gz"), F.col("salt").alias("gsalt"), total("m", before("source", "size").orderBy("salt")).alias("m0"))
    ranked = salted.withColumn("place", F.row_number().over(before("source", "size", "salt").orderBy("h", "row")) - 1)
    placed = ranked.join(counted, F.equal_null(F.col("source"), F.col("gs")) & (F.col("size") == F.col("gz")) & (F.col("salt") == F.col("gsalt")))
    at = F.col("start") + (F.col("m0") + F.col("place")) * F.col("unit")
    taken = cut(at + F.col("unit")) - cut(at)
    return placed.select("row", "h", "source", "size", "source_size", "target", (F.col("unit") / UNIT).alias("rate"), taken.cast("long").alias("copies"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; equal rows have equal hashes."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    made = decide(docs, [source], mix, text, source).groupBy("h").agg(F.count("*").alias("_m"), F.sum("copies").alias("_c")).where(F.col("_c") > 0)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("h"))
    # equal rows share what they were given: the k-th of m takes c div m, and one more while k < c mod m
    joined = keyed.join(made, "h").withColumn("k", F.when(F.col("_m") > 1, F.row_number().over(Window.partitionBy("h").orderBy("h")) - 1).otherwise(0))
    n = F.floor(F.col("_c") / F.col("_m")) + F.when(F.col("k") < F.col("_c") % F.col("_m"), 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select("row.*")


def mixing_query(docs: DataFrame) -> DataFrame:
    """The digest of op9."""
    out = decide(docs.select("doc_id", "source", "text"), ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
