"""From documents to a training mixture: language, toxicity, near duplicates, benchmark, weights.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of documents;
the last adds the epoch in which a row is read. run() writes each stage's rows to the shared folder
and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelark.llm import decontaminate, langid, mixing, nearcopies, queries, toxicity
from wirelark.llm.shared import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the others' labels teach; null, letterless and foreign texts go."""
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.predict(docs, model).where(langid.accepted()).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels of held-out rows are not used."""
    net = toxicity.fit(docs, queries.table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, net).where(F.col("score") < queries.TOXIC).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four fifths of the five-word shingles), that with the smallest id."""
    return nearcopies.keep_one(docs).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    phrases = decontaminate.load_phrases(queries.table(spark, sf_dir, "benchmark"))
    return decontaminate.mark(docs, phrases, only=["contaminated"]).where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each epoch."""
    return mixing.mix(docs, queries.mixture_levels(), **queries.MIXTURE)


STAGES = [("language ID", known_language), ("toxicity", not_toxic), ("near duplicates", one_of_each_group),
          ("benchmark decontamination", not_in_benchmark), ("mixture", mixture)]

ORACLE_SQL = None                  # models and components cannot be stated in SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(f"stage-{i}", stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = f"stage-{i}"
    return docs
