"""The corpus pipeline: language, exact and near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; run() writes what each returns as Parquet in the shared folder and hands
the reread table to the next. All but the last return the columns of documents.

Defined results: null, empty and letterless texts go in the first stage, which knows
no language of theirs, and so does everything where no document is labelled; of
repeated rows of one doc_id and text one stays; a null doc_id ranks lowest among copies;
further columns of documents are dropped in the first stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenura.llm import decontaminate, exact_dedup, jaccard_join, language, packing
from tenura.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that the models reject go."""
    return language.identify(docs, language.fit(docs)).filter("NOT rejected").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_last(docs).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more connect."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens."""
    return packing.pack(docs, packing.vocabulary(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: Language models, similarity search and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
