"""Tokens, chunks and word vectors of texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import col

#: White space of Unicode; the same with the punctuation at the ends of the tokens beside it, and punctuation at either end of a text. A run of
#: punctuation within a token is tried from its first character only, so that long runs take linear time.
SPACE = r"[\s\p{Z}\x{85}]+"
GAPS = r"[\s\p{Z}\x{85}]++\p{P}*+|(?=\p{P})(?<!\p{P})\p{P}++(?:[\s\p{Z}\x{85}]++\p{P}*+|\z)|^\p{P}++"
BLANK_LINES = r"\n[ \t]*\n\s*"


def tokenize(text: Column | str, remove_punctuation: bool = True) -> Column:
    """Lower-case tokens between white space; punctuation at their ends goes, if asked for, and what is then empty."""
    return F.array_remove(F.split(F.lower(col(text)), GAPS if remove_punctuation else SPACE), "")


def as_chunks(pieces: Column) -> Column:
    """Trimmed pieces as structs (index, text); blank ones go, and the rest is numbered from 0."""
    kept = F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, rf"^{SPACE}|{SPACE}$", "")), lambda p: p != "")
    return F.transform(kept, lambda p, i: F.struct(i.alias("index"), p.alias("text")))


def paragraphs(text: Column | str) -> Column:
    """A chunker: the pieces between blank lines."""
    return F.split(col(text), BLANK_LINES)


def lines(text: Column | str) -> Column:
    return F.split(col(text), r"\n")


def sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.!?])\s+")


Chunker = Callable[[Column], Column]


def chunked(df: DataFrame, text: str, chunker: Chunker, *keep: str) -> DataFrame:
    """(keep, index, chunk), one row a chunk of the text; chunker gives an array of pieces."""
    return df.select(*keep, F.explode(as_chunks(chunker(F.col(text)))).alias("c")).select(*keep, F.col("c.index").alias("index"), F.col("c.text").alias("chunk"))


def embedded(df: DataFrame, text: str, embedder: Callable[[Column], Column], name: str = "vector") -> DataFrame:
    """df with the embedder's vector; rows that it refuses (null) go."""
    return df.withColumn(name, embedder(F.col(text))).where(F.col(name).isNotNull())


def embed_tokens(df: DataFrame, tokens: str, vocabulary: DataFrame, *keep: str) -> DataFrame:
    """(keep, position, word, vector) of the tokens that the vocabulary (word, vector) has, in order and with repetitions.

    An equi-join on the word; Spark broadcasts the vocabulary if its size allows, else both sides are shuffled.
    """
    exploded = df.select(*keep, F.posexplode(tokens).alias("position", "word"))
    return exploded.join(vocabulary.select("word", "vector"), "word").select(*keep, "position", "word", "vector")
