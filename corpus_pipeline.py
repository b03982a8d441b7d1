"""The training-text pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.

* quality rules: rejected documents go; of the others, lines that fail go, and n_chars follows.
* n-gram Jaccard join: of each component of near duplicates (five words, similarity of 0.8 or more)
  the document of the smallest id stays.
* secret scans: candidates that a single owner holds are replaced by a mark, and n_chars follows.
* mixing: documents come as often as the mix takes them; those taken 0 times go.
* BPE: the digest of each row's tokens.

Defined cases: null and empty texts are rejected by the quality rules, so no later stage sees them; an empty
table stays empty; of repeated rows one is left by the join; null sources are a source of their own; columns
of any other names are carried to the last stage, whatever they are; a very long text is one row throughout,
and takes about twenty times its size in the task that has it. Ties are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, line_rules, mixing, ngram_join, queries, secrets
from tidelog.llm.scratch import Scratch


def _with_text(row: str, docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` from a struct, with another text and its length."""
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return [new.get(c, F.col(f"{row}.`{c}`")) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_rules.kept_rows(docs)
    whole = F.col("q.n_failed_lines") == 0
    return kept.select(_with_text("row", docs, F.when(whole, F.col("row.text")).otherwise(F.col("q.clean_text"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))).select(_with_text("row", docs, F.col("clean_text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_spans),
    ("mixing", mix),
    ("bpe", tokens),
]

# Entropy balancing and byte-pair merges are not SQL. A test holds all rows of run() against five stages in plain Python,
# copies and token ids included; others hold each stage's operator by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, str(k))
    return docs
