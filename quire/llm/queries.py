"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import functools
import os
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontam, langid, pii, quality, simhash, syncmers, toxicity, warc
from quire.llm.common import held_out, table

#: The setting that holds the key of pseudonyms, which stay the same as long as it does. Spark blacks out what is called a secret.
PII_SETTING = "spark.quire.pii.secret"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _key_of(application: str) -> str:
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The key that the session or the variable QUIRE_PII_SECRET sets; else one that only this application knows."""
    return spark.conf.get(PII_SETTING, None) or os.environ.get("QUIRE_PII_SECRET") or _key_of(spark.sparkContext.applicationId)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3, 1)
    return langid.identify(docs, langid.train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 3, 1)
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.link(*chat.exchanges(table(spark, sf_dir, "conversations")), chat.REPLY))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.derive(warc.from_pages(table(spark, sf_dir, "pages"))))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.digest(syncmers.compare_next(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_chat, op4_toxicity, op5_decontamination, op6_language, op7_quality, op8_warc, op9_syncmers, op10_pii)}
ORACLE_SQL: dict[str, str] = {"op3_chat": chat.ORACLE_SQL, "op5_decontamination": decontam.ORACLE_SQL}
