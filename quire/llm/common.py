"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import kept, shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; where that is unset, a temporary
    folder is taken on one machine, and a cluster is an error.
    """
    return kept(df)


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands 1,000 rows at a time to Python unless it was told another number.

    Texts are long: the usual 10,000 rows hold tens of MB, several times over in each
    executor's and worker's memory.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return shipped(df)


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id's text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


#: Keys up to which a table of them is broadcast: some 60 MB of texts.
BROADCAST_IDS = 1_000_000


#: The column that names a row by its id and text.
ROW_KEY = "__row_key"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's id (as text) and 128 bits of its text's digest; nulls have a key like any other value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    return F.concat(part(F.col(f"`{id_col}`").cast("string")), F.lit("|"), part(F.substring(F.md5(F.col(f"`{text_col}`")), 1, 32)))


def without(rows: DataFrame, keys: DataFrame, key: Column | str) -> DataFrame:
    """``rows`` but those whose ``key`` (an expression over them, or a column) is among ``keys`` (one column, each once); a null key stays.

    The keys are kept and counted; few are broadcast, so that the rows needn't be shuffled,
    and more are joined by a shuffle.
    """
    keys = saved(keys.select(F.col(keys.columns[0]).alias("__gone")))
    few = keys.count() <= BROADCAST_IDS
    own = F.col(f"`{key}`") if isinstance(key, str) else key
    left = rows.withColumn("__key", own).join(F.broadcast(keys) if few else keys, F.col("__key") == F.col("__gone"), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in rows.columns))


def once(rows: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``rows``, of those with a ``key`` among ``keys`` (one column, each once) only one each; it is chosen before anything is shuffled, so many copies don't meet."""
    keys = saved(keys.select(F.col(keys.columns[0]).alias("__again")))
    if keys.isEmpty():
        return rows
    few = keys.count() <= BROADCAST_IDS
    both = rows.withColumn("__key", key).join(F.broadcast(keys) if few else keys, F.col("__key") == F.col("__again"), "left")
    single = both.where("__again is null").drop("__key", "__again")
    return single.unionByName(both.where("__again is not null").drop("__again").dropDuplicates(["__key"]).drop("__key")).select(*(F.col(f"`{c}`") for c in rows.columns))
