"""Line-first cleaning: rules per line, then a verdict on what the document lost.

Each line that has a word is held against three rules (punctuation, navigation, boilerplate). Lines
that fail go; a document that loses more than ``max_loss`` of its characters is rejected. Before
that, whole-document floors (word count, share of repeated words) reject junk outright.

Defined cases: a null text is an empty one; an empty text has no lines, fails the word floor and is
not kept; every input row gives one output row, repeated rows included, and equal texts get equal
verdicts; where words repeat in overlapping windows each is counted once; all columns are carried in a
struct of their own, so no name can clash. A very long text or line takes memory for itself, its lines
and its windows of five words, about ten times its size, in the task that has it; every pattern reads it
in proportion to its length and without recursion.

Everything is a Column expression, without a shuffle: one scan, one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

# What the rules look for.
SYMBOLS = r"[#*$%&|<>]"
ENDINGS = r"[.!?:;,…。)\]\"'”’»-]\s*$"
ITEMS = r"home|about( us)?|contact( us)?|log ?in|log ?out|sign (in|up|out)|register|menu|search|next|previous|back to top|skip to (main )?content|read more|see more|site ?map|faq|share( this)?|tweet|print|help"
SEPARATOR = "[|»›·•>]"
LINE_SYMBOLS = r"[#*$%&|<>{}\\^~=]"
SEPARATED = SEPARATOR + (f"[^{SEPARATOR[1:-1]}]*" + SEPARATOR) * 2
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|(use|uses|accept) (of )?cookies|lorem ipsum|(enable|requires) javascript|subscribe to (our|the) newsletter|powered by wordpress|click here to)"

# A line of nothing but items. As the engine's patterns recurse for each turn of a repeated group, lines
# are held against ITEM alone, which has none; NAVIGATION says the same where patterns are automata.
NAVIGATION = rf"(?i)^\W*({ITEMS})(\W+({ITEMS}))*\W*$"
ITEM = rf"(?i)(?<!\w)({ITEMS})(?!\w)"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    short_line_words: int = 4  # a line of so few words needs an ending
    symbol_percent: int = 10  # symbols in a line's characters
    shout_percent: int = 12  # ! and ? in a line's characters
    max_loss_percent: int = 40


# One anchor of each boilerplate phrase, in lower case: a text without any has no such line.
ANCHORS = ("rights reserved", "terms of", "privacy policy", "cookie", "lorem ipsum", "javascript", "newsletter", "powered by", "click here")

# A match consumes one word and captures it with the four that follow. It begins at a word's start and gives
# nothing back, so that a long word is read once.
WINDOW = "(?<![^ ])(?=([^ ]++(?: [^ ]++){4}))[^ ]++ ?"


def line_fails(line: Column, rules: LineRules, has: Column) -> Column:
    """Whether a line breaks a rule; ``has`` tells which characters and phrases its text has at all."""
    size = F.length(line)
    short = line.rlike(rf"^\s*\S+(\s+\S+){{0,{rules.short_line_words - 1}}}\s*$")
    share = lambda marks: F.regexp_count(line, F.lit(marks)) * 100
    dense = (has["symbol"] & (share(LINE_SYMBOLS) >= size * rules.symbol_percent)) | (has["shout"] & (share("[!?]") >= size * rules.shout_percent))
    punctuation = (short & ~line.rlike(ENDINGS)) | ((size >= 20) & dense)
    navigation = line.rlike(rf"^\W*+{ITEM}") & ~F.regexp_replace(line, ITEM, "").rlike(r"\w")
    return punctuation | (has["separator"] & line.rlike(SEPARATED)) | (has["item"] & navigation) | (has["boilerplate"] & line.rlike(BOILERPLATE))


def repeated_words(windows: Column, ranked: Column) -> Column:
    """Words that windows found twice cover; ``ranked``: (window, place), sorted, null where none repeats."""
    same = lambda x, k, d: F.coalesce(F.get(ranked, k + d)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(ranked, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))
    # each place covers five words, or as many as are left before the next place
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")), lambda s, x: F.struct((s["n"] + F.least(x - s["at"], F.lit(5))).alias("n"), x.alias("at")))["n"]
    return F.when(ranked.isNull(), 0).otherwise(covered)


def line_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", clean: bool = True) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``q``, one of counts, verdicts and (if ``clean``) the cleaned text."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    body = F.col("_t")
    lower = F.lower(body)
    any_anchor = lower.contains(ANCHORS[0])
    for x in ANCHORS[1:]:
        any_anchor = any_anchor | lower.contains(x)
    has = F.struct(body.rlike(LINE_SYMBOLS).alias("symbol"), body.rlike("[!?]").alias("shout"), body.rlike(SEPARATOR).alias("separator"), body.rlike(rf"(?m)^[^\w\n]*+{ITEM}").alias("item"), any_anchor.alias("boilerplate"))
    norm = F.trim(F.regexp_replace(body, SPACE, " "))
    out = docs.withColumns({"_n": norm, "_x": F.regexp_count(body, F.lit(SYMBOLS)), "_has": has, "_l": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    solid = F.length(F.replace("_n", F.lit(" "), F.lit("")))
    out = out.withColumns({
        "_k": F.filter("_l", lambda x: ~line_fails(x, rules, F.col("_has"))),
        "_c": solid,
        "_w": F.when(F.col("_n") == "", 0).otherwise(F.length("_n") - solid + 1),
        "_h": F.regexp_extract_all("_n", F.lit(WINDOW), 1),
    })
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    count = lambda lines: F.length(F.array_join(lines, ""))
    out = out.withColumns({"_r": repeated_words(F.col("_h"), F.col("_s")), "_all": count("_l"), "_left": count("_k"), "_d": F.size("_l") - F.size(F.array_distinct("_l"))})
    n = F.col("_w")
    failed = (n < rules.min_words) | (F.col("_r") * 100 > n * rules.max_repeat_percent)
    lost = (F.col("_all") - F.col("_left")) * 100 > F.col("_all") * rules.max_loss_percent
    q = F.struct(
        n.cast("long").alias("n_words"),
        F.col("_c").cast("long").alias("word_chars"),
        F.col("_x").cast("long").alias("n_symbols"),
        F.col("_d").cast("long").alias("n_dup_lines"),
        F.col("_r").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size("_k")).cast("long").alias("n_failed_lines"),
        *([F.array_join("_k", "\n").alias("clean_text")] if clean else []),
    )
    return out.select("row", q.alias("q"))


def kept_rows(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``row`` and ``q`` of the documents that stay.

    A filter would be moved below the projections, which repeats their expressions in it many times
    over; a column that depends on the row's place keeps it above them.
    """
    placed = line_rules(docs, rules, text).select("row", "q", F.monotonically_increasing_id().alias("place"))
    return placed.where(F.col("q.kept") & (F.col("place") >= 0)).select("row", "q")


def quality_query(docs: DataFrame) -> DataFrame:
    """The digest of op4: counts and verdicts per document."""
    return line_rules(docs.select("doc_id", "text"), clean=False).select("row.doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")])
