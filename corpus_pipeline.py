"""A training-data pipeline over `documents`: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next
one's input. All but the last keep the columns of documents, extra ones included. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import compression, hyperminhash, linespread, mixing, packing
from braidwork.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.

    A null, empty or short text goes; repeated rows stay or go together; a very long text is judged whole and by chunks.
    """
    return compression.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; of each such line the first place stays.

    A null text stays null, a text of such lines alone becomes empty; `n_chars` follows where a line went. Rows alike in id and
    text count as one document and keep the same lines; a null source is a site; ties for the first place go to the least id, then
    the least text tag. A very long text is cut in one task.
    """
    stripped = linespread.strip_boilerplate(spark, docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col(linespread.N_REMOVED) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        stripped = stripped.withColumn("n_chars", size.cast(dict(docs.dtypes)["n_chars"]))
    return stripped.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    That of the least id stays, and of its rows one (the least text tag). Texts without words and rows without an id
    are near nothing and stay.
    """
    return hyperminhash.deduplicated(spark, docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix shows them, no more than twice; a source's words meet its target to within its largest document.

    Texts without words aren't shown; a null source is one; repeated rows of a source are shown equally often; ties follow a seeded
    order; a very long text counts by its words like any other.
    """
    return mixing.mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    A null or empty text is one piece of the end id; repeated rows are packed each for itself; a very long text becomes
    pieces of 1,024 tokens and one shorter. Columns other than id and text aren't read.
    """
    return packing.pack(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Compression ratios and tokenization can't be told in SQL; a test runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
