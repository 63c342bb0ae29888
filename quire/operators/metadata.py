"""DocumentInfo and XMP as tables: ``docinfo(doc_id, key, value)`` and ``xmp(doc_id, name, values)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which XMP property mirrors which DocumentInfo entry, and how its value is put.
MIRRORED = {
    "/Author": ("dc:creator", "authors"),
    "/Title": ("dc:title", "text"),
    "/Subject": ("dc:description", "text"),
    "/Keywords": ("pdf:Keywords", "text"),
    "/Creator": ("xmp:CreatorTool", "text"),
    "/Producer": ("pdf:Producer", "text"),
    "/CreationDate": ("xmp:CreateDate", "date"),
    "/ModDate": ("xmp:ModifyDate", "date"),
}


def _mapping() -> str:
    return "map(" + ", ".join(f"'{name}', '{key}'" for key, (name, _) in MIRRORED.items()) + ")"


def docinfo_from_xmp(docinfo: DataFrame, xmp: DataFrame) -> DataFrame:
    """DocumentInfo after the sync: mirrored entries come from XMP, or go if it lacks them; others stay."""
    text = F.array_join(F.filter("values", lambda x: x.isNotNull()), "; ")
    mirrored = xmp.withColumn("key", F.expr(f"{_mapping()}[name]")).where("key is not null").select("doc_id", "key", text.alias("value"))
    return docinfo.where(~F.col("key").isin(*MIRRORED)).select("doc_id", "key", "value").unionByName(mirrored)


def xmp_from_docinfo(xmp: DataFrame, docinfo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XMP with the mirrored entries of DocumentInfo, and the entries that have no place in it."""
    names = F.create_map(*[F.lit(x) for key, (name, _) in MIRRORED.items() for x in (key, name)])
    own = docinfo.withColumn("name", names[F.col("key")])
    fresh = own.where("name is not null").select("doc_id", "name", F.array("value").alias("values"))
    kept = xmp.join(fresh.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    return kept.unionByName(fresh), own.where("name is null").drop("name")


def conformance(xmp: DataFrame, docs: DataFrame, part: str = "pdfaid:part", level: str = "pdfaid:conformance") -> DataFrame:
    """``status``: part and conformance together, empty where there is no part."""
    got = xmp.groupBy("doc_id").agg(F.max(F.when(F.col("name") == part, F.get("values", F.lit(0)))).alias("part"), F.max(F.when(F.col("name") == level, F.get("values", F.lit(0)))).alias("level"))
    return docs.join(got, "doc_id", "left").withColumn("status", F.when(F.col("part").isNotNull(), F.concat("part", F.coalesce("level", F.lit("")))).otherwise("")).drop("part", "level")


def upsert(table: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same key."""
    return table.join(new.select(*on), on, "left_anti").unionByName(new)


def overlay(base: DataFrame, patch: DataFrame, on: list[str]) -> DataFrame:
    """Every object of either, the patch's value where it has one."""
    values = [c for c in base.columns if c not in on]
    p = patch.select(*on, *(F.col(c).alias(f"__{c}") for c in values))
    return base.join(p, on, "full").select(*on, *(F.coalesce(f"__{c}", c).alias(c) for c in values))


def update_pdf_version(xmp: DataFrame, docs: DataFrame) -> DataFrame:
    """XMP in which a version that is told is that of the file (``docs``: ``doc_id, version``); none is added."""
    said = F.when(F.col("name") == "pdf:PDFVersion", F.coalesce(F.array("version"), F.col("values"))).otherwise(F.col("values"))
    return xmp.join(docs.select("doc_id", "version"), "doc_id", "left").select("doc_id", "name", said.alias("values"))
