"""The corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes what a stage returns to the shared folder before the next reads it, as a stage reads its documents
more than once. In all stages null texts count as empty, texts may be of any length, rows that repeat a doc_id or
are equal are handled each, other columns pass through whatever their names, and an empty table gives an empty one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.common import saved
from callgrid.llm.lines import without_duplicate_lines
from callgrid.llm.minhash import drop_near_duplicates
from callgrid.llm.packing import pack
from callgrid.llm.pii import masked
from callgrid.llm.quality import keep_good


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; the others lose the lines above the limit of their host."""
    return _counted(keep_good(docs))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzy copies of a line the first stays; no document goes, though a text may be left empty; null texts stay null."""
    return _counted(without_duplicate_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similarity 0.8 or more the one with the least doc_id stays, with all its rows; texts without words are like no other."""
    return drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; null texts stay null."""
    return _counted(masked(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens; a text that is null or empty has one token, the end mark."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("minhash_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the sketches nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
