"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate credentials in every whole text. The value of each candidate is hashed, and
each hash is counted over distinct owners and distinct repositories of the whole corpus. A value
that several owners hold is a copied example; one that a single owner holds in few repositories and
that looks random is reported as ``owned``, a further span beside the base ones.

Counting is by (hash, owner, repository), then (hash, owner), then (hash), each with partial sums, so
that a value which a third of all rows hold shrinks before each exchange. Spans are found once and
written to the shared folder without the texts.

Defined cases: a null text is empty, and so is an empty one's list of spans; null owners or repositories
count as one unnamed owner or repository; repeated rows are rows of their own and give equal results;
spans of one start are listed by kind; all columns but the text are carried in a struct, so no name can
clash. A very long text takes a few copies of itself in the task that has it, and time in proportion to
its length; to a hundred thousand matches also in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

# The patterns, in the order in which their kinds are listed. The second item is the
# group that holds the value, the third the least length of that value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PATTERNS = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
SECOND = 0x5EC0_4D
MARKS = ("<secret>", "<copied-secret>")
KINDS = ("assign", "access", "hex", "owned")
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|password|secret|your|test|xxxx|1234567890|abcdef)"


SPANS = "array<struct<s:bigint,k:int,e:bigint,v:string>>"
FULL = 64  # items that are added up one by one
BLOCK = 1024  # characters in a block of a text


@dataclass(frozen=True)
class Ownership:
    max_owners: int = 1
    max_repositories: int = 3
    min_length: int = 16
    min_distinct_chars: int = 8


def prefixes(df: DataFrame, columns: dict[str, str], add: Callable[[Column, Column], Column]) -> DataFrame:
    """For each named array of numbers a column of what ``add`` makes of all items before each (0 before the first).

    A fold that gathered them would copy the gathered ones at each step. Here items are added up within
    blocks and blocks before them, all from columns: n items take n * FULL / 2 + (n / FULL) ** 2 / 2 steps.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), add)
    within = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(FULL)), lambda b: total(F.slice(c, b, FULL)))
    before = lambda c: F.transform(c, lambda _, i: total(F.slice(c, F.lit(1), i)))
    each = lambda c, starts: F.flatten(F.transform(starts, lambda s, i: F.transform(F.slice(c, i * FULL + 1, F.lit(FULL)), lambda _, j: add(s, total(F.slice(c, i * FULL + 1, j))))))
    df = df.withColumns({f"_{out}": within(F.col(c)) for out, c in columns.items()})
    df = df.withColumns({f"_{out}": before(F.col(f"_{out}")) for out in columns})
    return df.withColumns({out: each(F.col(c), F.col(f"_{out}")) for out, c in columns.items()}).drop(*[f"_{out}" for out in columns])


def with_spans(df: DataFrame, text: str, into: str) -> DataFrame:
    """Spans (s, k, e, v) of all kinds: of each leftmost, non-overlapping, those too short dropped.

    The pieces between the matches and the matches themselves alternate, so their lengths in code
    points add up to the matches' places.
    """
    t, none = F.col(text), F.array().cast("array<string>")
    kinds = range(len(PATTERNS))
    some = lambda k, x: F.when(t.rlike(PATTERNS[k][1]), x).otherwise(none)
    df = df.withColumns({f"_hit{k}": some(k, F.regexp_extract_all(t, F.lit(PATTERNS[k][1]), F.lit(0))) for k in kinds} | {f"_gap{k}": some(k, F.split(t, PATTERNS[k][1], -1)) for k in kinds} | {f"_val{k}": some(k, F.regexp_extract_all(t, F.lit(PATTERNS[k][1]), F.lit(PATTERNS[k][2]))) for k in kinds})
    # Arrays go through lambdas side by side, not by name: a column named in one may be made anew for each item.
    beside = lambda k, *names: F.arrays_zip(*[F.col(f"_{x}{k}").alias(x) for x in names])
    # each match with the piece before it; the last piece has no match behind it
    df = df.withColumns({f"_len{k}": F.transform(beside(k, "gap", "hit"), lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint")) for k in kinds})
    df = prefixes(df, {f"_at{k}": f"_len{k}" for k in kinds}, lambda a, x: a + x)

    def spans(k: int) -> Column:
        def one(x: Column) -> Column:
            end = x["at"] + x["len"]
            return F.struct((end - F.length(x["hit"])).alias("s"), F.lit(k).alias("k"), end.alias("e"), x["val"].alias("v"))

        return F.filter(F.transform(beside(k, "hit", "at", "len", "val"), one), lambda x: F.length(x["v"]) >= PATTERNS[k][3])

    own = [f"_{x}{k}" for x in ("hit", "gap", "val", "len", "at") for k in kinds]
    return df.withColumn(into, F.concat(*[spans(k) for k in kinds]).cast(SPANS)).drop(*own)


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def looks_live(value: Column, rule: Ownership) -> Column:
    return (
        (F.length(value) >= rule.min_length)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(PLACEHOLDER)
        & (F.size(F.array_distinct(F.split(value, ""))) >= rule.min_distinct_chars)
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, n_owners, n_repositories, n_found) of candidates (h, owner, repository)."""
    by_repository = candidates.groupBy("h", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("h", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, owner: Column, repository: Column, rule: Ownership = Ownership(), text: str = "text") -> DataFrame:
    """``row``, a struct of the columns of ``docs`` but the text, ``base`` and ``owned`` spans.

    Spans are structs (s, k, e, v): start, kind as an index into KINDS, end, value.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias
    read = docs.select(F.struct(*rest).alias("row"), name(owner)("owner"), name(repository)("repository"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    base = with_spans(read, "t", "base").select("row", "owner", "repository", "base")
    base = scratch.write(base.withColumn("id", F.monotonically_increasing_id()), "base")
    some = base.where(F.size("base") > 0)
    key = lambda x: F.sha2(x["v"], 256)
    seen = some.select("owner", "repository", F.explode(F.array_distinct(F.transform("base", key))).alias("h"))
    one_owner = ownership(seen).where((F.col("n_owners") <= rule.max_owners) & (F.col("n_repositories") <= rule.max_repositories)).select("h")
    live = some.select("id", F.explode("base").alias("x")).where(looks_live(F.col("x.v"), rule)).withColumn("h", key(F.col("x")))
    # the value ends where its match ends; kinds that overlap on one value report it once
    value = F.struct((F.col("x.e") - F.length("x.v")).alias("s"), F.lit(3).alias("k"), F.col("x.e").alias("e"), F.col("x.v").alias("v"))
    owned = live.join(one_owner, "h", "left_semi").groupBy("id").agg(F.collect_set(value).alias("owned"))
    empty = F.array().cast(SPANS)
    with_owned = some.join(owned, "id", "left").select("row", "base", F.coalesce("owned", empty).alias("owned"))
    return with_owned.unionByName(base.where(F.size("base") == 0).select("row", "base", empty.alias("owned")))


def redacted(docs: DataFrame, owner: Column, repository: Column, rule: Ownership = Ownership(), text: str = "text") -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``clean_text``, in which marks stand for the values found.

    Values of a single owner and copied ones have marks of their own. Only rows with candidates meet
    in an exchange, by 128 bits of hash over all their columns; all others pass through. Of values that
    overlap the one that begins first is marked for all, of those that begin together the shortest.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    read = docs.select(F.struct(*cols).alias("row"), F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(SECOND), *cols).alias("h2"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), owner.alias("owner"), repository.alias("repository"))
    found = scan(read.select("h", "h2", "text", "owner", "repository"), F.col("owner"), F.col("repository"), rule)
    spans = found.where(F.size("base") > 0).select("row.h", "row.h2", "base", "owned").dropDuplicates(["h", "h2"])
    any_ = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    some = read.where(any_).join(spans, ["h", "h2"], "left")
    # values of a single owner come before the same places as base spans, which then begin too early
    place = lambda k: lambda x: F.struct((x["e"] - F.length(x["v"])).alias("s"), x["e"].alias("e"), F.lit(k).alias("k"))
    none = F.array().cast(SPANS)
    ranges = F.sort_array(F.concat(F.transform(F.coalesce("base", none), place(1)), F.transform(F.coalesce("owned", none), place(0))))
    # pieces are cut from blocks of the text, as a place in a text is found by walking to it
    cut = some.withColumns({"ranges": ranges, "blocks": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))})
    block = lambda i: F.coalesce(F.get(F.col("blocks"), i.cast("int")), F.lit(""))
    part = lambda x, a, n: F.substring(x, (a + 1).cast("int"), n.cast("int"))

    def piece(a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK), F.floor(b / BLOCK)
        whole = F.array_join(F.slice(F.col("blocks"), (i + 2).cast("int"), F.greatest(j - i - 1, F.lit(0)).cast("int")), "")
        across = F.concat(part(block(i), a - i * BLOCK, F.lit(BLOCK)), whole, part(block(j), F.lit(0), b - j * BLOCK))
        return F.when(i == j, part(block(i), a - i * BLOCK, b - a)).otherwise(across)

    # ranges that overlap are one; each begins behind the end of all ranges before it
    cut = prefixes(cut.withColumn("ends", F.transform("ranges", lambda x: x["e"])), {"upto": "ends"}, lambda a, x: F.greatest(a, x))
    shown = F.filter(F.transform(F.arrays_zip(F.col("ranges").alias("r"), F.col("upto").alias("at")), lambda x: F.struct(x["r"]["s"].alias("s"), x["at"].alias("at"), x["r"]["k"].alias("k"))), lambda x: x["s"] >= x["at"])
    cut = cut.withColumns({"shown": shown, "end": F.coalesce(F.array_max("ends"), F.lit(0))})
    pieces = F.transform("shown", lambda x: F.concat(piece(x["at"], x["s"]), F.when(x["k"] == 0, F.lit(MARKS[0])).otherwise(F.lit(MARKS[1]))))
    clean = cut.select("row", F.concat(F.array_join(pieces, ""), piece(F.col("end"), F.length("text"))).alias("clean_text"))
    return clean.unionByName(read.where(~any_).select("row", F.col(f"row.`{text}`").alias("clean_text")))


def secrets_query(docs: DataFrame) -> DataFrame:
    """The digest of op1. A document's source is its owner; each language of a source is a repository."""
    found = scan(docs.select("doc_id", "source", "lang", "text"), F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "row.doc_id",
        *[of(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(F.concat("base", "owned")).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
    )
