"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all documents that the one before kept and is written as Parquet before the next.  All but the
last return the columns of `documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldweave.llm import langid, mixing, neardup, toxicity
from goldweave.llm.base import documents, table, tokenizer_path
from goldweave.llm.op2 import learn
from goldweave.llm.op5 import pack_documents
from goldweave.plans.staging import drop_folder, made_since, staged

#: A text of which less than this share looks like its most likely language is rejected.
LEAST_LANGUAGE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or that resemble none of the languages learned from `lang`."""
    return docs.filter(langid.accepts(docs, langid.fit(docs), "text", LEAST_LANGUAGE))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain, learned from those with `labels`, finds toxic."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.flags(docs, model, "toxic", "text"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return neardup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents towards the sources' target weights and shuffles the copies."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into few sequences: the columns of op5."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), "word", 1)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mix), ("packing", pack)]
#: SQL can express neither the trained models nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and its input, are removed when its result is written."""
    docs = documents(spark, sf_dir)
    mark = len(made_since())
    for name, stage in STAGES[:-1]:
        own: list[str] = []
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", own)
        for path in made_since(mark):
            if path not in own:
                drop_folder(spark, path)
        mark = len(made_since()) - 1  # the result itself goes when the next one is there
    return STAGES[-1][1](spark, docs, sf_dir)
