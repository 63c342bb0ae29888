"""The page sequence of documents: rows of ``doc_id, page_index`` (from 0, without gaps) and any other columns.

Each operator works on all documents at once. Positions count from the end where they
are negative. Pages of one document meet in one window; documents are independent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def as_pages(rows: DataFrame, doc: str, *order: str) -> DataFrame:
    """Any table as pages: ``doc`` names the document, ``order`` puts its rows in order."""
    return rows.withColumn("doc_id", F.col(doc)).withColumn("page_index", F.row_number().over(_doc().orderBy(*order)) - 1)


def renumber(pages: DataFrame, *order: Column) -> DataFrame:
    return pages.withColumn("page_index", F.row_number().over(_doc().orderBy(*order)) - 1)


def _bounds(n: Column, start: int | None, stop: int | None, step: int) -> tuple[Column, Column]:
    """First and last-but-one position of a slice of a sequence of ``n``."""
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def at(x: int | None, default: Column) -> Column:
        return default if x is None else F.least(F.greatest(F.lit(x) if x >= 0 else n + x, low), high)

    return (at(start, low), at(stop, high)) if step > 0 else (at(start, high), at(stop, low))


def _selected(pages: DataFrame, start: int | None, stop: int | None, step: int) -> DataFrame:
    """``pages`` with ``__at``: the place in the slice, null outside it."""
    if step == 0:
        raise ValueError("a slice has a step")
    first, last = _bounds(F.count("*").over(_doc()), start, stop, step)
    i = F.col("page_index")
    within = (i >= first) & (i < last) if step > 0 else (i <= first) & (i > last)
    return pages.withColumn("__at", F.when(within & ((i - first) % step == 0), ((i - first) / step).cast("int")))


def slice_pages(pages: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    return _selected(pages, start, stop, step).where("__at is not null").withColumn("page_index", F.col("__at")).drop("__at")


def page_at(pages: DataFrame, i: int) -> DataFrame:
    """The page at a position; documents that are too short have none."""
    return pages.withColumn("__n", F.count("*").over(_doc())).where(F.col("page_index") == (F.lit(i) if i >= 0 else F.col("__n") + i)).drop("__n")


def delete_pages(pages: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    return renumber(_selected(pages, start, stop, step).where("__at is null").drop("__at"), F.col("page_index"))


def reverse_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_index", (F.count("*").over(_doc()) - 1 - F.col("page_index")).cast("int"))


def insert_pages(pages: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """Pages of ``new`` before position ``at`` of their documents.

    Documents with fewer pages than ``at`` don't get them; ``insert_problems`` tells which.
    """
    sized = pages.withColumn("__n", F.count("*").over(_doc()))
    place = F.greatest(F.lit(0), F.lit(at) if at >= 0 else F.col("__n") + at)
    old = sized.withColumn("__where", F.when(F.col("page_index") < place, 0).otherwise(2)).drop("__n")
    fits = sized.where("page_index = 0").where(place <= F.col("__n")).select("doc_id")
    fresh = new.join(fits, "doc_id", "left_semi").withColumn("__where", F.lit(1))
    return renumber(old.unionByName(fresh, allowMissingColumns=True), F.col("__where"), F.col("page_index")).drop("__where")


def insert_problems(pages: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """``doc_id, problem`` of the documents of ``new`` for whose pages position ``at`` lies past the end, or that have no pages."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    asked = new.select("doc_id").distinct().join(sizes, "doc_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return asked.where(F.col("__n") < max(at, 0)).select("doc_id", F.concat(F.lit(f"insert at {at} of "), F.col("__n"), F.lit(" pages")).alias("problem"))


def page_position(pages: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``wanted`` with ``page_index``: where the first page with the same values of ``on`` lies in its document, null where none does."""
    first = pages.groupBy("doc_id", *on).agg(F.min("page_index").alias("page_index"))
    return wanted.join(first, ["doc_id", *on], "left")


def remove_pages(pages: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Without the first page of each document that has the values of ``on`` of a row of ``gone``."""
    at = page_position(pages, gone.select("doc_id", *on).distinct(), on).where("page_index is not null").select("doc_id", "page_index")
    return renumber(pages.join(at, ["doc_id", "page_index"], "left_anti"), F.col("page_index"))


def extend_pages(pages: DataFrame, *others: DataFrame) -> DataFrame:
    """The pages of the others after those there are, by document."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("__part", F.lit(k)) for k, df in enumerate((pages, *others))])
    return renumber(all_, F.col("__part"), F.col("page_index")).drop("__part")


def replace_slice(pages: DataFrame, start: int, stop: int, new: DataFrame) -> DataFrame:
    """The pages of a slice of step one replaced by those of ``new``; sizes may differ."""
    marked = _selected(pages, start, stop, 1)
    first, _ = _bounds(F.count("*").over(_doc()), start, stop, 1)
    old = marked.withColumn("__where", F.when(F.col("page_index") < first, 0).otherwise(2)).where("__at is null").drop("__at")
    return renumber(old.unionByName(new.withColumn("__where", F.lit(1)), allowMissingColumns=True), F.col("__where"), F.col("page_index")).drop("__where")


def replace_stepped(pages: DataFrame, new: DataFrame, start: int | None = None, stop: int | None = None, step: int = 2) -> DataFrame:
    """The pages of a slice of any step replaced one by one by those of ``new``, in its order.

    Documents for which ``new`` has another number of pages than the slice stay as they are.
    """
    places = _selected(pages, start, stop, step).where("__at is not null").select("doc_id", F.col("__at").alias("__k"), "page_index")
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    fit = counted(places, "__a").join(counted(new, "__b"), "doc_id").where("__a = __b").select("doc_id")
    fresh = new.withColumn("__k", F.row_number().over(_doc().orderBy("page_index")) - 1).drop("page_index").join(places, ["doc_id", "__k"]).join(fit, "doc_id", "left_semi").drop("__k")
    return pages.join(fresh.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def split_pages(pages: DataFrame, size: int) -> DataFrame:
    """Parts of ``size`` pages: ``part`` from 0, ``page_index`` within it."""
    i = F.col("page_index")
    return pages.withColumn("part", F.floor(i / size).cast("int")).withColumn("page_index", (i % size).cast("int"))


def collate_pages(pages: DataFrame, source: str, target: Column, size: int = 1) -> DataFrame:
    """The pages of several sources in turn, ``size`` of each at a time, as documents ``target``."""
    i = F.col("page_index")
    turned = pages.withColumn("doc_id", target).withColumn("__round", F.floor(i / size))
    return renumber(turned, F.col("__round"), F.col(source), i).drop("__round")


def add_blank_page(pages: DataFrame, docs: DataFrame, width: float = 612, height: float = 792) -> DataFrame:
    """A page of the given size at the end of each of ``docs``."""
    if not (3 <= width <= 14400 and 3 <= height <= 14400):
        raise ValueError("sides are 3 to 14400")
    blank = docs.select("doc_id", F.lit(0).alias("page_index"), F.array(*map(F.lit, (0.0, 0.0, float(width), float(height)))).alias("mediabox"))
    return extend_pages(pages, blank)


def labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pages`` with the label range each falls into: the one with the greatest first page not above it.

    ``ranges``: ``doc_id, first_index, style, prefix, start``. One sort by document;
    pages before the first range have none.
    """
    own = ranges.select("doc_id", F.col("first_index").alias("page_index"), F.struct("first_index", "style", "prefix", "start").alias("range"), F.lit(0).alias("__page"))
    both = pages.withColumn("range", F.lit(None).cast(own.schema["range"].dataType)).withColumn("__page", F.lit(1)).unionByName(own, allowMissingColumns=True)
    before = _doc().orderBy("page_index", "__page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("range", F.last("range", ignorenulls=True).over(before)).where("__page = 1").drop("__page")
