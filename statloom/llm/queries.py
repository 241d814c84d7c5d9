"""The queries of the pipeline operators: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import alignment, chat, decontaminate, exact_dedup, fingerprint, html_text, language_id, licenses, near_duplicates, packing, prefix_trie, quality, url_filter
from statloom.llm.shared import stored, table


def fold(doc_id: str, n: int):
    """crc32 of the decimal text of doc_id, modulo n; -1, a fold that is never held out, for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.select("doc_id", "text"), labels.where(fold("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_column(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of op5, as host/path; the longest that fits decides.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_by(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stored(prefix_trie.turn_arrays(table(spark, sf_dir, "conversations")), "trie-turns")
    conv_id = F.col("conv_id")
    rebuilt = prefix_trie.branched(arrays, conv_id - conv_id % 100, F.crc32(conv_id.cast("string")) % 6, 5)
    return prefix_trie.nodes(rebuilt).drop("turn_hash")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), digest="text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_fingerprint": op8_fingerprint,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_chat_rotation": chat.SQL,
    "op7_near_duplicates": near_duplicates.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
