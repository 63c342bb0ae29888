"""Actions, their /Next chains and what a sanitizer takes out.

``actions``: ``holder`` (what holds the action slot), ``slot``, ``pos`` (place in the
chain) and ``subtype``, with any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import kept

#: Action subtypes and annotation subtypes by purpose, and dictionary keys of structures.
JAVASCRIPT = ("JavaScript",)
EXTERNAL = ("URI", "Launch", "GoToR", "GoToE", "SubmitForm", "ImportData")
MULTIMEDIA = ("Rendition", "Movie", "Sound", "RichMediaExecute", "GoTo3DView")
MULTIMEDIA_ANNOTATIONS = ("Screen", "Movie", "Sound", "RichMedia", "3D")


def prune_chains(actions: DataFrame, removed: tuple[str, ...] | list[str]) -> DataFrame:
    """Chains without the removed subtypes; survivors close the gap, and a slot whose head goes goes as a whole.

    ``next_pos`` is the place of the following survivor in the new chain. A chain may have any length.
    """
    chain = Window.partitionBy("holder", "slot")
    gone = F.coalesce(F.col("subtype").isin(*removed), F.lit(False))
    head_gone = F.max((F.col("pos") == 0) & gone).over(chain)
    left = actions.withColumn("__head", head_gone).withColumn("__gone", gone).where("not __head and not __gone").drop("__head", "__gone")
    order = chain.orderBy("pos")
    return left.withColumn("pos", F.row_number().over(order) - 1).withColumn("next_pos", F.lead("pos").over(order))


def graft(tree: DataFrame, removed: tuple[str, ...] | list[str]) -> DataFrame:
    """A branching /Next tree without the removed subtypes: the children of a removed node take its place in order.

    ``tree``: ``holder, node, parent (null: the head), pos, subtype``, of any depth. Each node's
    nearest surviving ancestor and the positions on the way give its new place. A removed node's
    way up is doubled each round, so the rounds grow with the logarithm of the longest run of
    removed nodes; nodes on a circle of removed ones have no ancestor and go.
    """
    gone = F.coalesce(F.col("subtype").isin(*removed), F.lit(False))
    nodes = kept(tree.select("holder", "node", "parent", "pos", "subtype", gone.alias("gone")))
    # Of each removed node: the ancestor that its children would have, the places on the way to it, whether that is removed too.
    up = nodes.where("gone").select("holder", F.col("node").alias("at"), F.col("parent").alias("to"), F.array("pos").alias("way"))
    up = kept(up.join(nodes.where("gone").select("holder", F.col("node").alias("to"), F.lit(True).alias("open")), ["holder", "to"], "left").select("holder", "at", "to", "way", F.coalesce("open", F.lit(False)).alias("open")))
    left = up.where("open").count()
    while left:
        via = up.select("holder", F.col("at").alias("to"), F.col("to").alias("next"), F.col("way").alias("more"), F.col("open").alias("again"))
        joined = up.join(via, ["holder", "to"], "left")
        step = F.col("open") & F.col("again").isNotNull()
        up = kept(joined.select("holder", "at", F.when(step, F.col("next")).otherwise(F.col("to")).alias("to"), F.when(step, F.concat("more", "way")).otherwise(F.col("way")).alias("way"), F.when(step, F.col("again")).otherwise(F.col("open")).alias("open")))
        before, left = left, up.where("open").count()
        if left == before:
            break  # what is left goes round in circles
    placed = nodes.where("not gone").join(up.select("holder", F.col("at").alias("parent"), "to", "way", "open"), ["holder", "parent"], "left").where("not coalesce(open, false)")
    over = F.col("way").isNotNull()
    placed = placed.select("holder", "node", F.when(over, F.col("to")).otherwise(F.col("parent")).alias("parent"), F.when(over, F.concat(F.col("way"), F.array("pos"))).otherwise(F.array("pos")).alias("path"), "subtype")
    order = Window.partitionBy("holder", "parent").orderBy("path")
    return placed.withColumn("pos", F.row_number().over(order) - 1).select("holder", "node", "parent", "pos", "subtype")


def structural(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Dictionary entries without the given keys."""
    return entries.where(~F.col("key").isin(*keys))


def without_attachments(entries: DataFrame) -> DataFrame:
    """Without embedded files: their name tree, and associated files that embed one."""
    return entries.where(~(F.col("key") == "/EmbeddedFiles") & ~((F.col("key") == "/AF") & F.col("has_ef")))


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Links of each page in order, from the href of its anchors: in either case, in double or single quotes or in none."""
    tag = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    found = F.transform(F.regexp_extract_all(html, F.lit(tag), 1), lambda x: F.when(x.rlike("^['\"]"), x.substr(F.lit(2), F.length(x) - 2)).otherwise(x))
    return pages.select(key, F.posexplode(found).alias("pos", "uri"))


def uris(actions: DataFrame) -> DataFrame:
    """Actions with their arguments as columns: ``uri``, ``file``, ``dest``, ``name``, ``script``; null where a kind has none.

    ``actions``: ``subtype`` and ``value``, the action as the reader's JSON.
    """
    entry = lambda key: F.regexp_replace(F.get_json_object("value", f"$['{key}']"), "^u:", "")
    kind = F.col("subtype")
    return actions.select(
        "*",
        F.when(kind == "URI", entry("/URI")).alias("uri"),
        F.when(kind.isin("GoToR", "GoToE", "Launch", "SubmitForm", "ImportData"), entry("/F")).alias("file"),
        F.when(kind.isin("GoTo", "GoToR", "GoToE"), entry("/D")).alias("dest"),
        F.when(kind == "Named", entry("/N")).alias("name"),
        F.when(kind == "JavaScript", entry("/JS")).alias("script"),
    )


def reachable_named(holder: Column, subtype: Column, allowed: list[str]) -> Column:
    """Whether an action is one of those allowed."""
    return holder.isNotNull() & subtype.isin(*allowed)
