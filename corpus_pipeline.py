"""The corpus pipeline: documents go through STAGES in order; each stage's result is written as Parquet and read by the next.

Every stage works on all that its predecessor kept, and all but the last return the columns that they got. Null texts are empty
texts. Language: documents without letters, or of which no decision is sure enough, go. Quality: documents that the classifier
rejects go; it learns from the labels of its own input. Near duplicates: the document of the least doc_id of each class stays,
and so do documents without words. Decontamination: documents that hold a benchmark item go. Packing: the rest is cut into
sequences of token ids. Empty tables pass through empty. Further columns pass through, whatever their names. Repeated rows pass the first two
stages each; one of those of a doc_id outlasts the third. Ties go to the least doc_id. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontaminate, language_id, near_duplicates, packing, quality
from statloom.llm.shared import stored, table, unused

#: Documents of a less certain language, and of a lower quality score, are rejected.
LEAST_LANGUAGE_SCORE, LEAST_QUALITY = 0.35, 0.3
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, sure = unused(docs, "_lang"), unused(docs, "_sure")
    found = language_id.identify(docs, language_id.fit(docs), (lang, sure))
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(sure) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = unused(docs, "_quality")
    return quality.score(docs, model, found).where(F.col(found) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.representatives(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The SVMs, the n-gram classifier, the SVD and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
