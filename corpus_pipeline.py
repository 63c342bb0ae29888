"""From raw documents to token counts: five stages, each over all that the one before kept.

Quality (rejected documents go), near-duplicates (of each group the document with the
smallest id stays), benchmark decontamination (documents with a passage of a benchmark
item go), personal data (values get pseudonyms), tokens (the last, a row of digests for
each document). All stages but the last return the columns of documents.

Nulls, empty texts and repeated rows: as the operators say. A decision holds for a row as named
by its id and text, nulls included, so rows that share an id but not the text are judged each by
itself; rows that repeat both, or a group of copies without any id, are cut down to one. A stage
keeps whole rows, so extra columns go through it. Run as a whole, each stage's rows are kept in
the shared folder before the next begins, so nothing is computed twice and a lost executor costs
one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, pii, quality, queries, simhash
from quire.llm.common import ROW_KEY, held_out, once, row_key, saved, table, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id (of equal ids, the smallest key and text)."""
    keyed = docs.select(row_key().alias(ROW_KEY), "doc_id", "text").withColumn("doc_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW_KEY).alias("key")))
    found = simhash.near_duplicates(keyed.select("doc_id", "text"))
    copies = found.where("component_id <> doc_id").select("doc_id.key").distinct()
    rest = without(docs, copies, row_key())
    # Rows with the key of one that stays: all but one of them go.
    again = found.where("component_id = doc_id").groupBy("doc_id.key").count().where("count > 1").select("key")
    return once(rest, again, row_key())


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs.select(row_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, found.where("n_hit > 0").select("key").distinct(), row_key())


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(docs, queries.pii_key(spark))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, queries.TOKENIZER, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", token_stage),
]
#: The classifier and the pseudonyms can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
