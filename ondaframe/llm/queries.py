"""The operators of this folder as queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ecoc_langid, ftrl_toxicity, interleaved, lsh_forest, probminhash, trie_bpe, url_gbt, vector_packing, vlc_ids, warc_revisits
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: The rules of op8 (fixed values).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved.document_media(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc_revisits.resolve(warc_revisits.captures(table(spark, sf_dir, "pages")))
    return done.withColumn("header_lines", warc_revisits.header_lines(F.col("headers"))).drop("headers")


def op3_vlc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vlc_ids.corpus_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), "byte", end_id=2)


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = lsh_forest.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return lsh_forest.search(vectors, vectors.where(F.pmod("id", F.lit(100)) == 0), k=10)


def _held_out(parts: int, part: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ftrl_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return ftrl_toxicity.score(docs.withColumn("held_out", _held_out(3, 1)), model, ["doc_id", "held_out"])


def op8_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge(table(spark, sf_dir, "pages"), RULES)


def op9_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ecoc_langid.fit(docs, ~_held_out(4, 2))
    return ecoc_langid.predict(docs.withColumn("held_out", _held_out(4, 2)), model, ["doc_id", "held_out"])


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), "word", end_id=1)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on instruction data, where all three limits bind: 2048 tokens, 16 conversations, 1024 loss-bearing tokens."""
    return vector_packing.pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path(WORD_BPE))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on raw web pages: their items in order."""
    items = interleaved.parse_sequences(table(spark, sf_dir, "pages"), "page_id")
    return items.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")


QUERIES = {f.__name__: f for f in (op1_interleaved, op2_warc_revisits, op3_vlc_ids, op4_probminhash, op5_trie_bpe, op6_lsh_forest, op7_ftrl_toxicity, op8_url_gbt, op9_ecoc_langid, op10_vector_packing, conversation_packing, media_pages)}
ORACLE_SQL = {"op2_warc_revisits": warc_revisits.SQL}
