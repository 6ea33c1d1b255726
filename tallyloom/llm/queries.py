"""Queries of this package, with their production parameters: name -> (spark, folder) -> rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bins, chat, html, kneser, language, leaks, neighbours, planes, private, quality, simhash, trie, whitening
from tallyloom.llm.store import ship
from tallyloom.llm.subwords import vocabulary_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return kneser.train_and_score(_table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


def op6_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return private.find_private(_table(spark, folder, "documents"))


def op7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_plane_files(spark: SparkSession, folder: str) -> DataFrame:
    return planes.encode_and_read(_table(spark, folder, "documents"), vocabulary_path())


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    return bins.pack_documents(_table(spark, folder, "documents"), vocabulary_path())


def op11_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    # Nothing runs Python on the executors here, so nothing is sent to them.
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = chat.turn_log(turns.unionByName(chat.tricky_turns(spark)), "conv_id", "turn", "role", "text")
    formatted = chat.format_log(log, "conversation", "message", "sequence", "kind", "role", "text")
    return chat.conversation_digests(formatted)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, folder, "embeddings"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, folder, "conversations"))


QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_main_text": op4_main_text,
    "op5_quality": op5_quality,
    "op6_private_data": op6_private_data,
    "op7_leaks": op7_leaks,
    "op8_plane_files": op8_plane_files,
    "op9_neighbours": op9_neighbours,
    "op10_pack_documents": op10_pack_documents,
    "op11_chat_events": op11_chat_events,
    "op12_whitening": op12_whitening,
    "op13_conversation_trie": op13_conversation_trie,
}

#: SQL cannot express the others; tests/llm holds their brute-force versions.
ORACLES: dict[str, str] = {
    "op11_chat_events": chat.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
}
