"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. run()
writes each stage's result in the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, linededup, packing, simhash
from tessera.llm.common import cut, free_name, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go. Learns from the rows that op10 learns from."""
    learnt = docs.select("doc_id", "text", "lang").where(langid.teaching_row())
    lang, score = (free_name(x, docs.columns) for x in ("lang_pred", "score"))
    found = langid.identify(docs, learnt, names=(lang, score)).where(F.col(lang) != langid.UNKNOWN)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of equal or similar lines keeps its first; documents that lose all their lines go."""
    return linededup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar texts one document stays."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others lose the spans that occur in the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences as best fit finds; a row for each piece, as op6 gives it."""
    return packing.best_fit_packing(docs, packing.word_tokenizer())


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Fingerprints, cross-parsing and packing aren't SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
