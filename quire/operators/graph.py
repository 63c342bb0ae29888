"""Navigation of the object graph: trees, references, reachability, inheritance, outlines, names."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import kept


def tree_lookup(tree: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The entries of a name or number tree for keys; a missing key has null values."""
    return keys.join(tree, on, "left")


def tree_delete(tree: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return tree.join(keys.select(*on), on, "left_anti")


def tree_insert(tree: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Entries of ``new`` replace those with the same key."""
    return tree_delete(tree, new, on).unionByName(new)


def dangling(refs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """References to objects that aren't there."""
    return refs.join(objects.select(*on).distinct(), on, "left_anti")


def null_dangling(refs: DataFrame, objects: DataFrame, on: list[str], value: str) -> DataFrame:
    """References with ``value`` null where the object isn't there."""
    known = objects.select(*on).distinct().withColumn("__known", F.lit(True))
    return refs.join(known, on, "left").withColumn(value, F.when(F.col("__known"), F.col(value))).drop("__known")


#: Rounds of a closure after which what was found is written anew, as one table.
ROUNDS_KEPT = 8


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node`` for every node that can be reached in any number of steps, the root included.

    ``edges``: ``src, dst``; ``roots``: ``node``. Rounds of one join each, over the
    nodes found last, until there are no new ones; a node found before isn't followed
    again, so circles end.
    """
    edges = kept(edges.select("src", "dst").distinct())
    found = front = roots.select(F.col("node").alias("root"), "node").distinct()
    for n in count(1):
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = kept(step.join(found, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front)
        if n % ROUNDS_KEPT == 0:
            found = kept(found.repartition("root", "node"))
    return found


def copy_closure(objects: DataFrame, reached: DataFrame, first_new: Column) -> DataFrame:
    """Reached objects under new numbers: ``first_new`` and up, in the order of the old ones."""
    order = Window.partitionBy("root").orderBy("node")
    return reached.withColumn("new_obj", first_new + F.row_number().over(order) - 1).join(objects.withColumnRenamed("obj", "node"), "node")


def orphans(widgets: DataFrame, reachable: DataFrame, on: list[str]) -> DataFrame:
    """Widgets whose field isn't reached from the form."""
    return widgets.join(reachable.select(*on).distinct(), on, "left_anti")


def inherited(levels: list[Column]) -> Column:
    """The value nearest to the field: its own, else its parent's, and so on."""
    return F.coalesce(*levels)


def qualified_name(parts: list[Column]) -> Column:
    """Partial names from the root down, by dots; missing ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ".")


def unique_names(new: DataFrame, taken: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """``new`` with ``new_name``: its name if that is free, else with the smallest suffix ``.1``, ``.2``, ... that is.

    Names are resolved in ``order`` within a name. The suffix of a name's r-th row is r - 1 and
    as many more as are taken before it: a taken suffix is skipped by all rows from the one that
    would have got it, so rows and taken suffixes are sorted together and those counted.
    """
    base = F.col(name)
    used = taken.select(F.col(name).alias("used")).distinct()
    # A used name counts for its base: itself with suffix 0, else what precedes its last dot.
    suffix = used.select(F.regexp_extract("used", r"^(.*)\.([1-9][0-9]{0,8})$", 1).alias(name), F.regexp_extract("used", r"^(.*)\.([1-9][0-9]{0,8})$", 2).try_cast("int").alias("__k")).where("__k is not null")
    own = used.select(F.col("used").alias(name), F.lit(0).alias("__k"))
    # How many suffixes below it are free.
    gone = suffix.union(own).select(name, (F.col("__k") - F.row_number().over(Window.partitionBy(name).orderBy("__k")) + 1).alias("__free"), F.lit(1).alias("__gone"))
    ranked = new.withColumn("__free", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1).withColumn("__gone", F.lit(0))
    before = F.sum("__gone").over(Window.partitionBy(name).orderBy("__free", F.desc("__gone")).rowsBetween(Window.unboundedPreceding, 0))
    counted = ranked.unionByName(gone, allowMissingColumns=True).withColumn("__k", F.col("__free") + before).where("__gone = 0")
    return counted.withColumn("new_name", F.when(F.col("__k") == 0, base).otherwise(F.concat(base, F.lit("."), F.col("__k")))).drop("__k", "__free", "__gone")


def outline_counts(items: DataFrame) -> DataFrame:
    """``doc_id, item, count`` of the items with children: how many are visible below an open item, the same, negative, for a closed one.

    From the leaves up, a round for each level that has children; an item on a circle of parents
    is never settled and has no count.
    """
    nodes = kept(items.select("doc_id", "item", "parent", F.coalesce("closed", F.lit(False)).alias("closed")))
    above = nodes.where("parent is not null").groupBy("doc_id", F.col("parent").alias("item")).agg(F.count("*").alias("kids"))
    left = kept(nodes.join(above, ["doc_id", "item"]))
    # Per parent: children that are settled, and what they add to its count.
    ready = kept(nodes.join(above.select("doc_id", "item"), ["doc_id", "item"], "left_anti").withColumn("below", F.lit(0).cast("long")))
    added, done = None, None
    while True:
        new = ready.where("parent is not null").groupBy("doc_id", F.col("parent").alias("item")).agg(F.count("*").alias("settled"), F.sum(1 + F.when(F.col("closed"), 0).otherwise(F.col("below"))).alias("below"))
        added = kept(new if added is None else added.unionByName(new).groupBy("doc_id", "item").agg(F.sum("settled").alias("settled"), F.sum("below").alias("below")))
        ready = kept(left.join(added, ["doc_id", "item"]).where("settled = kids").drop("settled", "kids"))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = kept(left.join(ready.select("doc_id", "item"), ["doc_id", "item"], "left_anti"))
        added = added.join(ready.select("doc_id", "item"), ["doc_id", "item"], "left_anti")
    if done is None:
        return nodes.select("doc_id", "item", F.lit(0).cast("long").alias("count")).limit(0)
    return done.select("doc_id", "item", F.when(F.col("closed"), -F.col("below")).otherwise(F.col("below")).alias("count"))


def outline_links(items: DataFrame) -> DataFrame:
    """/Prev, /Next, /First, /Last, /Count of outline items.

    ``items``: ``doc_id, item, parent (null at the top), pos, closed``. The count of an
    open item is that of its visible descendants, of a closed one what it would be if open,
    negative; items without children have none.
    """
    siblings = Window.partitionBy("doc_id", "parent").orderBy("pos")
    linked = items.withColumn("prev", F.lag("item").over(siblings)).withColumn("next", F.lead("item").over(siblings))
    ends = items.where("parent is not null").groupBy("doc_id", F.col("parent").alias("item")).agg(F.min_by("item", "pos").alias("first"), F.max_by("item", "pos").alias("last"))
    return linked.join(ends, ["doc_id", "item"], "left").join(outline_counts(items), ["doc_id", "item"], "left")


def duplicates(objects: DataFrame, key: str, value: str) -> DataFrame:
    """``digest, n, first`` of the values that several objects have: how many, and the least key. Counted before anything is shuffled."""
    return objects.groupBy(F.md5(value).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
