"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm import chat, chroma, fertility, langid, lattice, packing, quality_zstd, secrets, simhash, warc
from lakeprofile.llm.common import table


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_zstd.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, played as melodies: the tables hold no sound of their own.

    To each query, an id divisible by 50, comes a copy that begins eight notes
    later and is slightly out of tune, under the id ``-1 - vec_id``: there is
    something to find, and how much of it was found can be seen.
    """
    played = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    untuned = F.transform(F.slice("embedding", 9, 1 << 20), lambda x, i: (x + 0.003 * F.sin(12.9898 * i + F.col("vec_id"))).cast("float"))
    copies = played.where("vec_id % 50 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), untuned.alias("embedding"))
    return chroma.search(played.unionByName(copies), "vec_id", "embedding", chroma.melody)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat.read_back(chat.windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_tokenizer_fertility": op2_tokenizer_fertility,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chroma_alignment": op4_chroma_alignment,
    "op5_chat_windows": op5_chat_windows,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece_lattice": op8_sentencepiece_lattice,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op5_chat_windows": chat.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
}
