"""Queries on the driver's tables and the same in SQL.

The tables play roles: conversations are documents and their turns pages, events of a
user are an action chain, regions, nations and customers a tree of fields, lines of an
order a content stream. What is computed is the operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import arrays, forms, geometry, images, labels, text, values
from quire.operators import actions, content, graph, metadata, pages
from quire.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return pages.as_pages(chats, "conv_id", "turn").select("doc_id", F.col("page_index").cast("long").alias("page_index"), "role", "turn")


def _out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "role", "turn")


_PAGES = "p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, role, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"WITH {_PAGES} SELECT doc_id, page_index - 1 AS page_index, role, turn FROM p WHERE page_index >= 1 AND page_index < 4")
def page_slice(spark, sf_dir):
    return _out(pages.slice_pages(_pages(spark, sf_dir), 1, 4))


@query(f"WITH {_PAGES} SELECT doc_id, page_index - greatest(n - 2, 0) AS page_index, role, turn FROM p WHERE page_index >= n - 2")
def page_slice_negative(spark, sf_dir):
    return _out(pages.slice_pages(_pages(spark, sf_dir), -2))


@query(f"WITH {_PAGES} SELECT doc_id, (n - 1 - page_index) // 2 AS page_index, role, turn FROM p WHERE (n - 1 - page_index) % 2 = 0")
def page_slice_backwards(spark, sf_dir):
    return _out(pages.slice_pages(_pages(spark, sf_dir), None, None, -2))


@query(f"WITH {_PAGES} SELECT doc_id, n - 1 - page_index AS page_index, role, turn FROM p")
def page_reverse(spark, sf_dir):
    return _out(pages.reverse_pages(_pages(spark, sf_dir)))


@query(f"WITH {_PAGES} SELECT doc_id, page_index, role, turn FROM p WHERE page_index = n - 1")
def page_at(spark, sf_dir):
    return _out(pages.page_at(_pages(spark, sf_dir), -1))


@query(f"WITH {_PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS page_index, role, turn FROM p WHERE NOT (page_index >= 1 AND page_index < 3)")
def page_delete(spark, sf_dir):
    return _out(pages.delete_pages(_pages(spark, sf_dir), 1, 3))


@query(f"WITH {_PAGES}, u AS (SELECT doc_id, page_index, role, turn, CASE WHEN page_index < 2 THEN 0 ELSE 2 END AS k FROM p UNION ALL SELECT DISTINCT doc_id, 0, 'blank', -1, 1 FROM p WHERE n >= 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_index) - 1 AS page_index, role, turn FROM u")
def page_insert(spark, sf_dir):
    own = _pages(spark, sf_dir)
    blank = own.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("page_index"), F.lit("blank").alias("role"), F.lit(-1).cast("long").alias("turn"))
    return _out(pages.insert_pages(own, 2, blank))


@query(f"WITH {_PAGES}, u AS (SELECT doc_id, page_index, role, turn, 0 AS k FROM p WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id - 1, page_index, role, turn, 1 FROM p WHERE doc_id % 2 = 1) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_index) - 1 AS page_index, role, turn FROM u")
def page_extend(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return _out(pages.extend_pages(own.where("doc_id % 2 = 0"), own.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)))


@query(f"WITH {_PAGES}, u AS (SELECT doc_id, page_index, role, turn, CASE WHEN page_index < 1 THEN 0 ELSE 2 END AS k FROM p WHERE NOT (page_index >= 1 AND page_index < 3) UNION ALL SELECT DISTINCT doc_id, 0, 'new', -1, 1 FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_index) - 1 AS page_index, role, turn FROM u")
def page_replace_slice(spark, sf_dir):
    own = _pages(spark, sf_dir)
    new = own.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("page_index"), F.lit("new").alias("role"), F.lit(-1).cast("long").alias("turn"))
    return _out(pages.replace_slice(own, 1, 3, new))


@query(f"WITH {_PAGES} SELECT doc_id, CAST(page_index // 2 AS BIGINT) AS part, page_index % 2 AS page_index, role, turn FROM p")
def page_split(spark, sf_dir):
    return pages.split_pages(_pages(spark, sf_dir), 2).select("doc_id", F.col("part").cast("long").alias("part"), F.col("page_index").cast("long").alias("page_index"), "role", "turn")


@query(f"WITH {_PAGES} SELECT doc_id // 2 AS doc_id, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY page_index, doc_id) - 1 AS page_index, role, turn FROM p")
def page_collate(spark, sf_dir):
    own = _pages(spark, sf_dir).withColumn("source", F.col("doc_id"))
    return _out(pages.collate_pages(own, "source", F.floor(F.col("doc_id") / 2)))


@query("SELECT l_orderkey, l_linenumber, CAST((((l_partkey * 90) % 720 - 360 + 90) % 360 + 360) % 360 AS BIGINT) AS rotation FROM lineitem")
def page_rotate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", geometry.rotate((F.col("l_partkey") * 90) % 720 - 360, 90).cast("long").alias("rotation"))


_ROMAN_SQL = "['', 'M', 'MM', 'MMM', 'MMMM', 'MMMMM'][k // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][k % 1000 // 100 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][k % 100 // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][k % 10 + 1]"
_ALPHA_SQL = "CASE WHEN k <= 26 THEN chr(CAST(64 + k AS INT)) WHEN k <= 702 THEN chr(CAST(65 + (k - 27) // 26 AS INT)) || chr(CAST(65 + (k - 27) % 26 AS INT)) ELSE chr(CAST(65 + (k - 703) // 676 AS INT)) || chr(CAST(65 + (k - 703) // 26 % 26 AS INT)) || chr(CAST(65 + (k - 703) % 26 AS INT)) END"


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey % 5000 + 1 AS k, CASE o_orderkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'a' WHEN 3 THEN 'R' WHEN 4 THEN 'r' END AS style, left(o_orderpriority, 1) || '-' AS prefix FROM orders) SELECT o_orderkey, prefix || CASE style WHEN 'D' THEN CAST(k AS VARCHAR) WHEN 'A' THEN {_ALPHA_SQL} WHEN 'a' THEN lower({_ALPHA_SQL}) WHEN 'R' THEN {_ROMAN_SQL} WHEN 'r' THEN lower({_ROMAN_SQL}) ELSE '' END AS label FROM o")
def page_label(spark, sf_dir):
    key = F.col("o_orderkey")
    style = F.element_at(F.array(*[F.lit(s) for s in ("D", "A", "a", "R", "r", None)]), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.label(style, F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-")), (key % 5000 + 1).cast("int")).alias("label"))


@query("WITH p AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page_index FROM events), r AS (SELECT doc_id, page_index AS first_index, CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'a' END AS style, event_id % 5 + 1 AS start FROM p WHERE event_id % 7 = 0), j AS (SELECT p.doc_id, p.page_index, r.style, p.page_index - r.first_index + r.start AS k FROM p ASOF LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_index >= r.first_index) SELECT doc_id, page_index, CASE WHEN style IS NULL THEN CAST(page_index + 1 AS VARCHAR) WHEN style = 'D' THEN CAST(k AS VARCHAR) ELSE lower(" + _ALPHA_SQL + ") END AS label FROM j")
def page_label_floor_lookup(spark, sf_dir):
    p = pages.as_pages(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("doc_id", "event_id", F.col("page_index").cast("long").alias("page_index"))
    ranges = p.where("event_id % 7 = 0").select("doc_id", F.col("page_index").alias("first_index"), F.when(F.col("event_id") % 2 == 0, "D").otherwise("a").alias("style"), F.lit("").alias("prefix"), (F.col("event_id") % 5 + 1).alias("start"))
    own = pages.labels(p.select("doc_id", "page_index"), ranges)
    r = F.col("range")
    made = labels.label(r.style, r.prefix, labels.label_number(F.col("page_index"), r.first_index, r.start))
    return own.select("doc_id", "page_index", F.when(r.isNull(), (F.col("page_index") + 1).cast("string")).otherwise(made).alias("label"))


_RECT = "least(l_quantity, l_discount * 400) AS llx, least(l_tax * 300, l_linenumber * 5.0) AS lly, greatest(l_quantity, l_discount * 400) AS urx, greatest(l_tax * 300, l_linenumber * 5.0) AS ury"


def _rects(spark, sf_dir):
    f = F.col
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", geometry.normalized(f("l_quantity"), f("l_tax") * 300, f("l_discount") * 400, f("l_linenumber") * 5.0).alias("r"), geometry.rectangle(F.lit(10.0), F.lit(5.0), F.lit(30.0), F.lit(20.0)).alias("frame"), f("l_quantity"), f("l_suppkey"))


def _sides(r, digits=6):
    return [F.round(r[s], digits).alias(s) for s in geometry.SIDES]


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_RECT} FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(llx, 10.0), 6) AS llx, round(greatest(lly, 5.0), 6) AS lly, round(least(urx, 30.0), 6) AS urx, round(least(ury, 20.0), 6) AS ury FROM r")
def rect_intersect(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", geometry.intersection(F.col("r"), F.col("frame")).alias("x")).select("l_orderkey", "l_linenumber", *_sides(F.col("x")))


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_RECT} FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE llx >= 10 AND lly >= 5 AND urx <= 30 AND ury <= 20")
def rect_contains(spark, sf_dir):
    return _rects(spark, sf_dir).where(geometry.inside(F.col("r"), F.col("frame"))).select("l_orderkey", "l_linenumber")


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_RECT} FROM lineitem) SELECT l_orderkey, l_linenumber, round(urx - llx, 6) AS width, round(ury - lly, 6) AS height FROM r")
def rect_bbox(spark, sf_dir):
    r = _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.bbox(F.col("r")).alias("b"))
    return r.select("l_orderkey", "l_linenumber", F.round(F.col("b").urx, 6).alias("width"), F.round(F.col("b").ury, 6).alias("height"))


@query("WITH b AS (SELECT p_partkey, p_size + 500 AS media, CASE WHEN p_size % 2 = 0 THEN p_size + 400 END AS crop, CASE WHEN p_size % 3 = 0 THEN p_size + 300 END AS trim FROM part) SELECT p_partkey, CAST(coalesce(crop, media) AS BIGINT) AS crop, CAST(coalesce(trim, crop, media) AS BIGINT) AS trim, CAST(coalesce(crop, media) AS BIGINT) AS art FROM b")
def box_fallback(spark, sf_dir):
    size = F.col("p_size").cast("long")
    boxes = geometry.page_boxes(size + 500, F.when(size % 2 == 0, size + 400), F.lit(None).cast("long"), F.when(size % 3 == 0, size + 300), F.lit(None).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", boxes.alias("b")).select("p_partkey", "b.crop", "b.trim", "b.art")


_MATRICES = "m AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c, CAST(l_linenumber AS DOUBLE) AS d, l_extendedprice / 1000 AS e, CAST(l_suppkey % 100 AS DOUBLE) AS f FROM lineitem)"


def _matrices(spark, sf_dir):
    f = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.matrix(f("l_quantity"), f("l_discount"), f("l_tax"), f("l_linenumber"), f("l_extendedprice") / 1000, f("l_suppkey") % 100).alias("m"))


def _six(m):
    """Ten-thousandths, cut where no short decimal lies, so that both engines cut alike."""
    return [F.floor(m[x] * 10000 + 0.3141592653).alias(x) for x in geometry.AXES]


@query(f"WITH {_MATRICES} SELECT l_orderkey, l_linenumber, CAST(floor((a * 2 + b * 0) * 10000 + 0.3141592653) AS BIGINT) AS a, CAST(floor((a * 1 + b * 3) * 10000 + 0.3141592653) AS BIGINT) AS b, CAST(floor((c * 2 + d * 0) * 10000 + 0.3141592653) AS BIGINT) AS c, CAST(floor((c * 1 + d * 3) * 10000 + 0.3141592653) AS BIGINT) AS d, CAST(floor((e * 2 + f * 0 + 10) * 10000 + 0.3141592653) AS BIGINT) AS e, CAST(floor((e * 1 + f * 3 + 20) * 10000 + 0.3141592653) AS BIGINT) AS f FROM m")
def matrix_product(spark, sf_dir):
    made = _matrices(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.product(F.col("m"), geometry.matrix(2, 1, 0, 3, 10, 20)).alias("x"))
    return made.select("l_orderkey", "l_linenumber", *_six(F.col("x")))


@query(f"WITH {_MATRICES} SELECT l_orderkey, l_linenumber, CAST(floor((d / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS a, CAST(floor((-b / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS b, CAST(floor((-c / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS c, CAST(floor((a / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS d, CAST(floor(((c * f - d * e) / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS e, CAST(floor(((b * e - a * f) / (a * d - b * c)) * 10000 + 0.3141592653) AS BIGINT) AS f FROM m WHERE a * d - b * c <> 0")
def matrix_inverse(spark, sf_dir):
    made = _matrices(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.inverse(F.col("m")).alias("x")).where("x is not null")
    return made.select("l_orderkey", "l_linenumber", *_six(F.col("x")))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem), t AS (SELECT *, [0 * q, 100 * 0 + 0 * q] AS z FROM r) SELECT l_orderkey, l_linenumber, round(10.0 - (q + 20), 4) AS llx, CAST(20 AS DOUBLE) AS lly, CAST(5 AS DOUBLE) AS urx, round(20.0 + q, 4) AS ury FROM t")
def transform_rect(spark, sf_dir):
    q = F.col("l_quantity")
    turn = geometry.matrix(0, 1, -1, 0, 10, 20)
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.transform_rectangle(turn, geometry.rectangle(F.lit(0.0), F.lit(5.0), q, q + 20)).alias("x"))
    return made.select("l_orderkey", "l_linenumber", *_sides(F.col("x"), 4))


_STEPS = "s AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE l_partkey % 4 WHEN 0 THEN 'q' WHEN 1 THEN 'Q' WHEN 2 THEN 'cm' ELSE 'Do' END AS op, CAST(l_suppkey % 3 + 1 AS DOUBLE) AS sx, CAST(l_linenumber AS DOUBLE) AS tx FROM lineitem)"


@query(f"""WITH RECURSIVE {_STEPS}, f AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS seq, '' AS op, [[1.0::DOUBLE, 0.0::DOUBLE]] AS stack FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL
  SELECT s.doc_id, s.seq, s.op, CASE s.op WHEN 'q' THEN list_prepend(f.stack[1], f.stack) WHEN 'Q' THEN CASE WHEN len(f.stack) > 1 THEN f.stack[2:] ELSE [[1.0::DOUBLE, 0.0::DOUBLE]] END WHEN 'cm' THEN list_prepend([s.sx * f.stack[1][1], s.tx * f.stack[1][1] + f.stack[1][2]], f.stack[2:]) ELSE f.stack END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq = f.seq + 1)
SELECT doc_id, seq, round(stack[1][1], 4) AS a, round(stack[1][2], 4) AS e FROM f WHERE op = 'Do'""")
def ctm_fold(spark, sf_dir):
    lines = pages.as_pages(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    zero, one = F.lit(0.0), F.lit(1.0)
    op = F.element_at(F.array(*map(F.lit, ("q", "Q", "cm", "Do"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    steps = lines.select("doc_id", F.lit(0).alias("page_index"), (F.col("page_index") + 1).alias("seq"), op.alias("operator"), F.array((F.col("l_suppkey") % 3 + 1).cast("double"), zero, zero, one, F.col("l_linenumber").cast("double"), zero).alias("operands"), F.lit("/Im0").alias("name"))
    got = content.ctm(steps)
    return got.select("doc_id", F.col("seq").cast("long").alias("seq"), F.round(F.col("ctm")[0], 4).alias("a"), F.round(F.col("ctm")[4], 4).alias("e"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nametree_lookup(spark, sf_dir):
    tree = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return graph.tree_lookup(tree, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.8)")
def nametree_delete(spark, sf_dir):
    tree, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders")
    large = orders.crossJoin(F.broadcast(orders.agg((F.avg("o_totalprice") * 1.8).alias("bound")))).where("o_totalprice > bound")  # one row
    return graph.tree_delete(tree, large.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def xref_dangling(spark, sf_dir):
    objects = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return graph.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), objects, ["l_partkey"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN l_partkey END AS l_partkey FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def xref_null_dangling(spark, sf_dir):
    objects = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("key"))
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("key"))
    return graph.null_dangling(refs, objects, ["key"], "l_partkey").drop("key")


_EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def _edges(spark, sf_dir):
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("orders", "c", "o_custkey", "o", "o_orderkey"))


@query(f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, dst FROM reach JOIN e ON src = node) SELECT root, node FROM reach")
def copy_closure(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.closure(_edges(spark, sf_dir), roots)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2)")
def orphan_widgets(spark, sf_dir):
    roots = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"))
    reached = table(spark, sf_dir, "nation").join(roots, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"))
    return graph.orphans(table(spark, sf_dir, "supplier"), reached, ["s_nationkey"]).select("s_suppkey", "s_name")


@query("SELECT c_custkey, concat_ws('.', r_name, n_name, c_name) AS name, CASE WHEN c_acctbal > 5000 THEN 'own' WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE 'region' END AS origin FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def field_qualified_name(spark, sf_dir):
    f = F.col
    fields = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), f("c_nationkey") == f("n_nationkey")).join(table(spark, sf_dir, "region"), f("n_regionkey") == f("r_regionkey"))
    value = graph.inherited([F.when(f("c_acctbal") > 5000, "own"), F.when(f("n_nationkey") % 2 == 0, "nation"), F.lit("region")])
    return fields.select("c_custkey", graph.qualified_name([f("r_name"), f("n_name"), f("c_name")]).alias("name"), value.alias("origin"))


_CHAIN = "a AS (SELECT user_id AS holder, event_id, event_type AS subtype, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


def _chains(spark, sf_dir):
    chain = pages.as_pages(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return chain.select(F.col("user_id").alias("holder"), F.lit("A").alias("slot"), F.col("page_index").alias("pos"), F.col("event_type").alias("subtype"), "event_id")


@query(f"WITH {_CHAIN}, h AS (SELECT holder FROM a WHERE pos = 0 AND subtype IN ('click', 'error')), k AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY pos) - 1 AS new_pos FROM a WHERE subtype NOT IN ('click', 'error') AND holder NOT IN (SELECT holder FROM h)) SELECT holder, event_id, subtype, new_pos AS pos, lead(new_pos) OVER (PARTITION BY holder ORDER BY new_pos) AS next_pos FROM k")
def action_prune(spark, sf_dir):
    made = actions.prune_chains(_chains(spark, sf_dir), ["click", "error"])
    return made.select("holder", "event_id", "subtype", F.col("pos").cast("long").alias("pos"), F.col("next_pos").cast("long").alias("next_pos"))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, uri FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS uri, generate_subscripts(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), 1) AS pos FROM pages)")
def link_extract(spark, sf_dir):
    return actions.links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "uri")


@query("WITH n AS (SELECT p_partkey AS seq, left(p_name, 4) AS name FROM part), t AS (SELECT DISTINCT name || '.2' AS name FROM n UNION SELECT DISTINCT name FROM n WHERE seq % 3 = 0), r AS (SELECT seq, name, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM n), f AS (SELECT b.name, s.i, row_number() OVER (PARTITION BY b.name ORDER BY s.i) AS k FROM (SELECT name, count(*) AS c FROM n GROUP BY name) b, LATERAL (SELECT unnest(generate_series(0, b.c + 3)) AS i) s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = CASE WHEN s.i = 0 THEN b.name ELSE b.name || '.' || s.i END)) SELECT r.seq, r.name, CASE WHEN f.i = 0 THEN r.name ELSE r.name || '.' || f.i END AS new_name FROM r JOIN f ON r.name = f.name AND r.k = f.k")
def dest_rename(spark, sf_dir):
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.substring("p_name", 1, 4).alias("name"))
    taken = new.select(F.concat("name", F.lit(".2")).alias("name")).union(new.where("seq % 3 = 0").select("name"))
    return graph.unique_names(new, taken).select("seq", "name", "new_name")


@query("WITH o AS (SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS d, o_orderkey % 24 * 30 - 360 AS z, o_orderdate FROM orders) SELECT o_orderkey, d || CASE WHEN z < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(z) // 60 AS VARCHAR), 2, '0') || '''' || lpad(CAST(abs(z) % 60 AS VARCHAR), 2, '0') AS pdf_date FROM o")
def pdf_date_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pdf_date(F.col("o_orderdate"), (F.col("o_orderkey") % 24 * 30 - 360).cast("int")).alias("pdf_date"))


@query("SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS local, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 330 END AS BIGINT) AS minutes FROM orders")
def pdf_date_decode(spark, sf_dir):
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    coded = F.when(key % 3 == 0, F.date_format(date, "yyyy")).when(key % 3 == 1, F.concat(F.lit("D:"), F.date_format(date, "yyyyMMdd"))).otherwise(text.pdf_date(date, F.lit(330)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", coded.alias("d"))
    return rows.select("o_orderkey", F.date_format(text.parse_pdf_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("local"), text.pdf_date_offset(F.col("d")).cast("long").alias("minutes"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-05:30' END AS xmp FROM orders")
def xmp_date_partial(spark, sf_dir):
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    coded = F.when(key % 4 == 0, F.date_format(date, "yyyy")).when(key % 4 == 1, F.date_format(date, "yyyyMM")).when(key % 4 == 2, F.concat(text.pdf_date(date), F.lit("Z00'00'"))).otherwise(text.pdf_date(date, F.lit(-330)))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.xmp_date(coded).alias("xmp"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x17\\x20-\\x7E\\x{A1}-\\x{AC}\\x{AE}-\\x{FF}" + "".join(f"\\x{{{x:04X}}}" for x in text.PDFDOC.values()) + "]') AS encodable FROM documents")
def pdfdoc_encodable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.pdfdoc_encodable(F.col("text")).alias("encodable"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS BIGINT) AS n, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS digest FROM documents")
def xml_clean(spark, sf_dir):
    clean = text.xml_clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


@query("SELECT conv_id, string_agg(role, '; ' ORDER BY turn) FILTER (role <> 'system') AS authors FROM conversations GROUP BY conv_id")
def authors_join(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations")
    names = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.nullif("role", F.lit("system")).alias("role")))), lambda x: x.role)
    joined = text.authors_join(names)
    return chats.groupBy("conv_id").agg(F.nullif(joined, F.lit("")).alias("authors"))


@query("WITH d AS (SELECT conv_id AS doc_id, CASE turn % 3 WHEN 0 THEN '/Author' WHEN 1 THEN '/Title' ELSE '/Own' || turn END AS key, role AS value FROM conversations), x AS (SELECT DISTINCT conv_id AS doc_id, '/Author' AS key, 'A; B' AS value FROM conversations WHERE conv_id % 2 = 0) SELECT doc_id, key, value FROM d WHERE key NOT IN ('/Author', '/Title') UNION ALL SELECT doc_id, key, value FROM x")
def docinfo_sync(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations")
    info = chats.select(F.col("conv_id").alias("doc_id"), F.expr("case turn % 3 when 0 then '/Author' when 1 then '/Title' else concat('/Own', turn) end").alias("key"), F.col("role").alias("value"))
    xmp = chats.where("conv_id % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.lit("dc:creator").alias("name"), F.array(F.lit("A"), F.lit(None).cast("string"), F.lit("B")).alias("values")).distinct()
    return metadata.docinfo_from_xmp(info, xmp)


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), -1) AS missing FROM events")
def namepath_get_default(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(values.at_path(props, ["k"], "bigint"), F.lit(-1).cast("long")).alias("k"), F.coalesce(values.at_path(props, ["missing"], "bigint"), F.lit(-1).cast("long")).alias("missing"))


_TOKENS = "t AS (SELECT doc_id, generate_subscripts(w, 1) AS seq, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"


def _tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "operator"))
    return words.select("doc_id", F.lit(0).alias("page_index"), (F.col("at") + 1).alias("seq"), "operator")


@query(f"WITH {_TOKENS} SELECT doc_id, seq, word FROM t WHERE word IN ('q', 'the', 'de') OR left(word, 1) IN ('q', 'Q')")
def content_whitelist(spark, sf_dir):
    return content.allowed(_tokens(spark, sf_dir), "q the de").select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("operator").alias("word"))


@query(f"WITH {_TOKENS} SELECT doc_id, md5(string_agg(CASE WHEN seq % 3 = 0 THEN '1 0 ' || word ELSE word END, chr(10) ORDER BY seq)) AS digest FROM t GROUP BY doc_id")
def content_unparse(spark, sf_dir):
    rows = _tokens(spark, sf_dir).withColumn("operands", F.when(F.col("seq") % 3 == 0, F.array(F.lit("1"), F.lit("0"))).otherwise(F.expr("cast(array() as array<string>)")))
    return content.unparse(rows).select("doc_id", F.md5("content").alias("digest"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def object_duplicates(spark, sf_dir):
    return graph.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


_IMAGES = "i AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '/DeviceGray' WHEN 1 THEN '/DeviceRGB' WHEN 2 THEN '/DeviceCMYK' WHEN 3 THEN '/Indexed' WHEN 4 THEN '/Lab' ELSE '/Pattern' END AS cs, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END AS bpc, p_partkey % 11 = 0 AS mask FROM part), b AS (SELECT *, CASE WHEN bpc = 0 THEN CASE WHEN mask THEN 1 ELSE 8 END ELSE bpc END AS bits FROM i)"


def _images(spark, sf_dir):
    size = F.col("p_size")
    cs = F.element_at(F.array(*map(F.lit, ("/DeviceGray", "/DeviceRGB", "/DeviceCMYK", "/Indexed", "/Lab", "/Pattern"))), size % 6 + 1)
    bpc = F.element_at(F.array(*map(F.lit, (0, 1, 2, 4, 8))), size % 5 + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", cs.alias("cs"), bpc.alias("bpc"), (F.col("p_partkey") % 11 == 0).alias("mask"))
    return rows.withColumn("bits", images.bits_per_component(F.col("bpc"), F.col("mask")))


@query(f"WITH {_IMAGES} SELECT p_partkey, CAST(bits AS BIGINT) AS bits, CASE WHEN mask OR bits = 1 AND cs = '/DeviceGray' THEN '1' WHEN cs = '/DeviceGray' THEN 'L' WHEN cs = '/Indexed' THEN 'P' WHEN cs = '/DeviceRGB' THEN 'RGB' WHEN cs = '/DeviceCMYK' THEN 'CMYK' WHEN cs = '/Lab' THEN 'LAB' END AS mode FROM b")
def image_mode(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", F.col("bits").cast("long").alias("bits"), images.mode(F.col("cs"), F.col("bits"), F.col("mask"), F.lit("/DeviceRGB")).alias("mode"))


@query(f"WITH {_IMAGES} SELECT p_partkey, CASE cs WHEN '/DeviceGray' THEN '0,1' WHEN '/DeviceRGB' THEN '0,1,0,1,0,1' WHEN '/DeviceCMYK' THEN '0,1,0,1,0,1,0,1' WHEN '/Indexed' THEN '0,' || CAST(CAST(2 ** bits - 1 AS INT) AS VARCHAR) WHEN '/Lab' THEN '0,100,-100,100,-100,100' END AS decode FROM b")
def image_decode_default(spark, sf_dir):
    decode = images.default_decode(F.col("cs"), F.col("bits"))
    return _images(spark, sf_dir).select("p_partkey", F.array_join(F.transform(decode, lambda x: x.cast("int").cast("string")), ",").alias("decode"))


@query("SELECT p_partkey, CASE WHEN p_size * 20000000 > 1000000000 * 0.8 THEN 'error' WHEN p_size * 20000000 > 400000000 THEN 'warn' ELSE 'ok' END AS verdict FROM part")
def bomb_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", images.bomb_check(F.col("p_size"), F.lit(20_000_000), 400_000_000).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(255 * l_discount + (l_partkey % 256) * (1 - l_tax - l_discount), 0) AS BIGINT) AS sample FROM lineitem")
def decode_apply(spark, sf_dir):
    made = images.apply_decode(F.col("l_partkey") % 256, F.col("l_discount"), 1 - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.cast("long").alias("sample"))


@query("SELECT o_orderkey, concat_ws(',', (o_orderkey % 256 >> 6 & 3) * 85, (o_orderkey % 256 >> 4 & 3) * 85, (o_orderkey % 256 >> 2 & 3) * 85, (o_orderkey % 256 & 3) * 85) AS two, concat_ws(',', (o_orderkey % 256 >> 4 & 15) * 17, (o_orderkey % 256 & 15) * 17) AS four FROM orders")
def subbyte_unpack(spark, sf_dir):
    byte = F.col("o_orderkey") % 256
    joined = lambda bits: F.array_join(images.unpack_samples(byte, bits).cast("array<string>"), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(2).alias("two"), joined(4).alias("four"))


@query("SELECT vec_id, CAST(CASE WHEN embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.1 THEN 0 ELSE 255 END AS BIGINT) AS alpha FROM embeddings")
def colorkey_alpha(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", images.colorkey_alpha(F.col("embedding"), [(-0.1, 0.1), (-0.1, 0.1)]).cast("long").alias("alpha"))


@query("SELECT o_orderkey, (o_orderkey % 4096 >> 2 & 1) = 1 AS print_lowres, (o_orderkey % 4096 >> 4 & 1) = 1 AS extract, (o_orderkey % 4096 >> 10 & 1) = 1 AS modify_assembly, (o_orderkey % 4096 >> 11 & 1) = 1 AS print_highres FROM orders")
def permission_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.permissions(F.col("o_orderkey") % 4096, F.lit(True)).alias("p"))
    return rows.select("o_orderkey", "p.print_lowres", "p.extract", "p.modify_assembly", "p.print_highres")


@query("SELECT p_partkey, (p_partkey & 2) <> 0 AS hidden, (p_partkey & 4) <> 0 AS print, (p_partkey & 2) <> 0 OR (p_partkey & 1) <> 0 AS forbidden FROM part")
def flag_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", values.flags(F.col("p_partkey"), values.ANNOTATION_FLAGS).alias("f"))
    return rows.select("p_partkey", "f.hidden", "f.print", (F.col("f.hidden") | F.col("f.invisible")).alias("forbidden"))


@query("SELECT c_custkey, CAST(trunc(CAST(CAST(c_acctbal AS BIGINT) AS DOUBLE) / 7) AS BIGINT) AS quotient, CAST(c_acctbal AS BIGINT) % 7 AS rest FROM customer")
def int_floordiv_mod(spark, sf_dir):
    whole = F.bround("c_acctbal", 0).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", values.floor_div(whole, F.lit(7)).alias("quotient"), values.remainder(whole, F.lit(7)).alias("rest"))


@query("SELECT p_partkey, CAST(round(10 * list_sum(list_transform(string_split(p_name, ''), lambda c: CASE WHEN ascii(c) BETWEEN 97 AND 109 THEN 500 WHEN ascii(c) BETWEEN 110 AND 122 THEN 556 ELSE 278 END)) / 1000, 3) AS DOUBLE) AS width FROM part")
def text_width(spark, sf_dir):
    widths = spark.range(97, 123).select(F.col("id").cast("int").alias("code"), F.when(F.col("id") <= 109, 500).otherwise(556).alias("width"))
    made = content.text_width(table(spark, sf_dir, "part"), widths, 10, 278, "p_name")
    return made.select("p_partkey", F.round("width", 3).alias("width"))


@query("""WITH RECURSIVE w AS (SELECT item_id, string_split_regex(text, ' +') AS w FROM benchmark), f AS (
  SELECT item_id, w, 1 AS i, [w[1]] AS lines FROM w WHERE len(w) > 0
  UNION ALL
  SELECT item_id, w, i + 1, CASE WHEN length(lines[-1]) + 1 + length(w[i + 1]) <= 40 THEN list_append(lines[:-2], lines[-1] || ' ' || w[i + 1]) ELSE list_append(lines, w[i + 1]) END FROM f WHERE i < len(w))
SELECT item_id, CAST(len(lines) AS BIGINT) AS n, array_to_string(lines, '|') AS lines FROM f WHERE i = len(w)""")
def word_wrap(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(content.word_wrap("text", 40)).alias("lines"))
    return rows.select("item_id", F.size("lines").cast("long").alias("n"), F.array_join("lines", "|").alias("lines"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'error') AND event_type <> 'purchase'")
def sanitize_structural(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"))
    return actions.structural(rows, ["click", "error", "purchase"]).withColumnRenamed("key", "event_type")


@query("SELECT coalesce(b.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(p.v, b.v) AS v FROM (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) b FULL JOIN (SELECT o_orderkey, 'patched' AS v FROM orders WHERE o_orderkey % 5 = 0) p ON b.o_orderkey = p.o_orderkey")
def json_overlay(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return metadata.overlay(base, orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("patched").alias("v")), ["o_orderkey"])


@query("""WITH RECURSIVE i AS (SELECT conv_id AS doc_id, turn AS item, CASE WHEN turn < 2 THEN NULL ELSE turn // 2 - 1 END AS parent, turn AS pos, turn % 3 = 2 AS closed FROM conversations),
l AS (SELECT *, lag(item) OVER s AS prev, lead(item) OVER s AS next FROM i WINDOW s AS (PARTITION BY doc_id, parent ORDER BY pos)),
e AS (SELECT doc_id, parent AS item, min(item) AS first, max(item) AS last FROM i WHERE parent IS NOT NULL GROUP BY 1, 2),
v AS (SELECT doc_id, parent AS top, item, closed FROM i WHERE parent IS NOT NULL UNION ALL SELECT v.doc_id, v.top, i.item, i.closed FROM v JOIN i ON i.doc_id = v.doc_id AND i.parent = v.item WHERE NOT v.closed),
c AS (SELECT doc_id, top AS item, count(*) AS n FROM v GROUP BY 1, 2)
SELECT l.doc_id, l.item, l.parent, prev, next, first, last, CASE WHEN closed THEN -n ELSE n END AS count FROM l LEFT JOIN e ON l.doc_id = e.doc_id AND l.item = e.item LEFT JOIN c ON l.doc_id = c.doc_id AND l.item = c.item""")
def outline_links(spark, sf_dir):
    turn = F.col("turn")
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("item"), F.when(turn >= 2, F.floor(turn / 2) - 1).alias("parent"), turn.alias("pos"), (turn % 3 == 2).alias("closed"))
    return graph.outline_links(items).select("doc_id", "item", "parent", "prev", "next", "first", "last", "count")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority || o_orderstatus, 5) ELSE left(replace(o_orderpriority || chr(10) || o_orderstatus, chr(10), ''), 7) END AS value, CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'button' WHEN 2 THEN 'radio' WHEN 3 THEN 'checkbox' WHEN 4 THEN 'choice' ELSE 'signature' END AS kind FROM orders")
def form_field_rules(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.when(key % 2 == 0, F.concat("o_orderpriority", "o_orderstatus")).otherwise(F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % 6 + 1).cast("int"))
    kind = forms.field_kind(pick("/Tx", "/Btn", "/Btn", "/Btn", "/Ch", "/Sig"), pick(0, 1 << 16, 1 << 15, 0, 0, 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", forms.text_value(raw, F.lit(0), F.when(key % 2 == 0, 5).otherwise(7)).alias("value"), kind.alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'FitR' ELSE 'FitH' END AS fit, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS l, CASE WHEN l_linenumber % 2 = 0 THEN 4.0 ELSE l_quantity END AS top FROM lineitem")
def destination_fit(spark, sf_dir):
    q = F.col("l_quantity").cast("string")
    parts = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("3 0 R"), F.lit("/FitR"), q, F.lit("2"), F.lit("3"), F.lit("4"))).otherwise(F.array(F.lit("3 0 R"), F.lit("/FitH"), q))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", forms.destination(parts).alias("d"))
    return d.select("l_orderkey", "l_linenumber", "d.fit", F.col("d.left").alias("l"), "d.top")


@query("SELECT p_partkey, CASE WHEN r NOT BETWEEN 2 AND 6 THEN 'revision must be 2 to 6' WHEN aes AND r < 4 THEN 'AES needs revision 4 or more' WHEN meta AND r < 4 THEN 'encrypted metadata needs revision 4 or more' WHEN r = 6 AND NOT aes THEN 'revision 6 needs AES' WHEN meta AND NOT aes THEN 'encrypted metadata needs AES' END AS problem FROM (SELECT p_partkey, p_size % 8 AS r, p_partkey % 2 = 0 AS aes, p_partkey % 3 = 0 AS meta FROM part)")
def encryption_rules(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", values.encryption_problem(F.col("p_size") % 8, key % 2 == 0, key % 3 == 0).alias("problem"))


@query(f"WITH {_PAGES}, u AS (SELECT doc_id, page_index, role, turn, 0 AS k FROM p UNION ALL SELECT DISTINCT doc_id, 0, NULL, NULL, 1 FROM p WHERE doc_id % 2 = 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_index) - 1 AS page_index, role, turn FROM u")
def page_blank(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return _out(pages.add_blank_page(own, own.where("doc_id % 2 = 0").select("doc_id").distinct()))


@query("WITH d AS (SELECT conv_id AS doc_id, CASE turn WHEN 0 THEN 'dc:title' WHEN 1 THEN 'pdf:Keywords' ELSE 'own' || turn END AS name, role AS value FROM conversations), i AS (SELECT DISTINCT conv_id AS doc_id, 'dc:title' AS name, 'T' AS value FROM conversations WHERE conv_id % 3 = 0) SELECT doc_id, name, value FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = d.doc_id AND i.name = d.name) UNION ALL SELECT * FROM i")
def xmp_from_docinfo(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations")
    xmp = chats.select(F.col("conv_id").alias("doc_id"), F.expr("case turn when 0 then 'dc:title' when 1 then 'pdf:Keywords' else concat('own', turn) end").alias("name"), F.array("role").alias("values"))
    info = chats.where("conv_id % 3 = 0").select(F.col("conv_id").alias("doc_id"), F.lit("/Title").alias("key"), F.lit("T").alias("value")).distinct()
    return metadata.xmp_from_docinfo(xmp, info)[0].select("doc_id", "name", F.get("values", F.lit(0)).alias("value"))


@query("SELECT c_custkey, CASE WHEN part IS NULL THEN '' ELSE part || coalesce(level, '') END AS status FROM (SELECT c_custkey, max(CASE WHEN o_orderkey % 4 = 0 THEN '2' END) AS part, max(CASE WHEN o_orderkey % 5 = 0 THEN 'B' END) AS level FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def conformance_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    prop = lambda rest, name, value: orders.where(rest).select(F.col("o_custkey").alias("doc_id"), F.lit(name).alias("name"), F.array(F.lit(value)).alias("values"))
    xmp = prop("o_orderkey % 4 = 0", "pdfaid:part", "2").union(prop("o_orderkey % 5 = 0", "pdfaid:conformance", "B"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return metadata.conformance(xmp, docs).select(F.col("doc_id").alias("c_custkey"), "status")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS page_index, CAST(l_suppkey AS VARCHAR) AS name FROM lineitem WHERE l_suppkey % 3 <> 0")
def resources_unused(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), F.col("l_suppkey").cast("string").alias("name"), "l_suppkey")
    used = lines.where("l_suppkey % 3 = 0").select("doc_id", "page_index", F.lit("Do").alias("operator"), F.array("name").alias("operands"))
    return content.unused_resources(lines.select("doc_id", "page_index", "name"), used)


_LISTS = "l AS (SELECT o_orderkey, [o_orderkey % 10, 7, o_orderkey % 4, 7] AS a FROM orders)"


def _lists(spark, sf_dir):
    key = F.col("o_orderkey")
    seven = F.lit(7).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array(key % 10, seven, key % 4, seven).alias("a"))


def _joined(items):
    return F.array_join(items.cast("array<string>"), ",")


@query(f"WITH {_LISTS} SELECT o_orderkey, array_to_string(a || [9], ',') AS appended, array_to_string(a || [1, 2], ',') AS extended, array_to_string(a[1:1] || [5] || a[2:], ',') AS inserted, array_to_string(a[1:3] || [5] || a[4:], ',') AS inserted_back, CAST(len(list_filter(a, lambda x: x = 7)) AS BIGINT) AS sevens, list_contains(a, 3) AS has_three FROM l")
def array_algebra(spark, sf_dir):
    a, long = F.col("a"), lambda x: F.lit(x).cast("long")
    return _lists(spark, sf_dir).select("o_orderkey", _joined(arrays.append(a, long(9))).alias("appended"), _joined(arrays.extend(a, F.array(long(1), long(2)))).alias("extended"), _joined(arrays.insert(a, 1, long(5))).alias("inserted"), _joined(arrays.insert(a, -1, long(5))).alias("inserted_back"), arrays.count(a, long(7)).cast("long").alias("sevens"), arrays.has(a, long(3)).alias("has_three"))


@query(f"WITH {_LISTS} SELECT o_orderkey, a[4] AS popped, array_to_string(a[:3], ',') AS left_over, array_to_string(a[2:], ',') AS without_first, CAST(CASE WHEN a[1] = 3 THEN 0 WHEN a[3] = 3 THEN 2 END AS BIGINT) AS at, CASE WHEN a[1] = 3 THEN array_to_string(a[2:], ',') WHEN a[3] = 3 THEN array_to_string(a[:2] || a[4:], ',') END AS removed FROM l")
def array_pop_remove(spark, sf_dir):
    a, three = F.col("a"), F.lit(3).cast("long")
    return _lists(spark, sf_dir).select("o_orderkey", arrays.pop(a)["value"].alias("popped"), _joined(arrays.pop(a)["items"]).alias("left_over"), _joined(arrays.pop(a, 0)["items"]).alias("without_first"), arrays.index(a, three).cast("long").alias("at"), _joined(arrays.remove(a, three)).alias("removed"))


@query(f"WITH {_LISTS} SELECT o_orderkey, array_to_string(a[2:3], ',') AS middle, array_to_string([a[4], a[3], a[2], a[1]], ',') AS backwards, array_to_string([a[1], a[3]], ',') AS every_other, array_to_string(a[3:], ',') AS last_two, a[4] AS last, array_to_string([a[3], a[1]], ',') AS steps_back FROM l")
def array_slices(spark, sf_dir):
    a = F.col("a")
    return _lists(spark, sf_dir).select("o_orderkey", _joined(arrays.sliced(a, 1, 3)).alias("middle"), _joined(arrays.sliced(a, None, None, -1)).alias("backwards"), _joined(arrays.sliced(a, None, None, 2)).alias("every_other"), _joined(arrays.sliced(a, -2)).alias("last_two"), arrays.at(a, -1).alias("last"), _joined(arrays.sliced(a, 2, None, -2)).alias("steps_back"))


@query("SELECT event_id, json_contains(json_keys(props), '\"k\"') AS has_k, list_contains(json_keys(props), 'none') AS has_none, CAST(len(json_keys(props)) AS BIGINT) AS n, len(json_keys(props)) > 0 AS truth, '[' || props || ']' AS wrapped FROM events".replace("json_contains(json_keys(props), '\"k\"')", "list_contains(json_keys(props), 'k')"))
def object_predicates(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", arrays.has_key(props, "k").alias("has_k"), arrays.has_key(props, "none").alias("has_none"), arrays.length(props).cast("long").alias("n"), arrays.truth(props).alias("truth"), arrays.wrapped(props).alias("wrapped"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey ELSE -1 END AS as_int, o_orderkey % 4 = 2 AND o_orderkey % 8 = 2 AS as_bool, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN o_orderkey + 0.5 ELSE -1.0 END AS as_float, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey = 12 WHEN 1 THEN o_orderkey + 0.5 = 12 WHEN 2 THEN false ELSE false END AS twelve FROM orders")
def object_typed_reading(spark, sf_dir):
    key = F.col("o_orderkey")
    tag = F.element_at(F.array(*map(F.lit, ("integer", "real", "boolean", "name"))), (key % 4 + 1).cast("int"))
    text_ = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(key.cast("string"), F.lit(".5"))).when(key % 4 == 2, F.when(key % 8 == 2, "true").otherwise("false")).otherwise("/N")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag"), text_.alias("text"))
    t, x = F.col("tag"), F.col("text")
    return rows.select("o_orderkey", values.as_int(t, x, F.lit(-1).cast("long")).alias("as_int"), values.as_bool(t, x, F.lit(False)).alias("as_bool"), values.as_float(t, x, F.lit(-1.0)).alias("as_float"), values.known_equal(t, x, F.lit("integer"), F.lit("12")).alias("twelve"))


@query(f"WITH {_MATRICES} SELECT l_orderkey, l_linenumber, CAST(floor((a * 2) * 10000 + 0.3141592653) AS BIGINT) AS sa, CAST(floor((a * 3 + c * 4 + e) * 10000 + 0.3141592653) AS BIGINT) AS te, CAST(floor(-c * 10000 + 0.3141592653) AS BIGINT) AS rc, CAST(floor((a * 5 + c * 6 + e) * 10000 + 0.3141592653) AS BIGINT) AS px FROM m".replace("floor(-c * 10000", "floor((-a) * 10000"))
def matrix_steps(spark, sf_dir):
    """Scaled, translated, turned by a right angle, and a point moved."""
    f, lit = F.col("m"), lambda x: F.lit(float(x))
    whole = lambda x: F.floor(x * 10000 + 0.3141592653)
    turned = geometry.rotated(f, lit(90))
    return _matrices(spark, sf_dir).select("l_orderkey", "l_linenumber", whole(geometry.scaled(f, lit(2), lit(3)).a).alias("sa"), whole(geometry.translated(f, lit(3), lit(4)).e).alias("te"), whole(F.round(turned.c, 9)).alias("rc"), whole(geometry.transform_point(f, lit(5), lit(6)).x).alias("px"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) || ' 0 0.5 1 -0.25 ' || l_linenumber AS encoded FROM lineitem")
def matrix_encode(spark, sf_dir):
    m = geometry.matrix(F.col("l_quantity"), 0, 0.5, 1, -0.25, F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.encode(m).alias("encoded"))


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, {_RECT} FROM lineitem) SELECT l_orderkey, l_linenumber, round(urx, 6) AS x2, round(lly, 6) AS y2, round(llx, 6) AS x4, round(ury, 6) AS y4 FROM r")
def rect_corners(spark, sf_dir):
    c = geometry.corners(F.col("r"))
    return _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.round(c[i][a], 6).alias(f"{a}{i + 1}") for i in (1, 3) for a in ("x", "y")))


@query(f"WITH {_PAGES}, w AS (SELECT doc_id, min(page_index) FILTER (role = 'assistant') AS page_index FROM p GROUP BY 1) SELECT doc_id, page_index FROM w")
def page_index_of(spark, sf_dir):
    own = _pages(spark, sf_dir)
    wanted = own.select("doc_id").distinct().withColumn("role", F.lit("assistant"))
    return pages.page_position(own, wanted, ["role"]).select("doc_id", "page_index")


@query(f"WITH {_PAGES}, k AS (SELECT * FROM p WHERE NOT (role = 'assistant' AND page_index = (SELECT min(page_index) FROM p q WHERE q.doc_id = p.doc_id AND q.role = 'assistant'))) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS page_index, role, turn FROM k")
def page_remove(spark, sf_dir):
    own = _pages(spark, sf_dir)
    gone = own.select("doc_id").distinct().withColumn("role", F.lit("assistant"))
    return _out(pages.remove_pages(own, gone, ["role"]))


@query(f"WITH {_PAGES} SELECT doc_id, page_index, CASE WHEN page_index % 2 = 0 AND (doc_id % 2 = 0 OR n <= 2) THEN 'new' ELSE role END AS role, CASE WHEN page_index % 2 = 0 AND (doc_id % 2 = 0 OR n <= 2) THEN -1 - page_index // 2 ELSE turn END AS turn FROM p")
def page_replace_stepped(spark, sf_dir):
    """Every other page; documents with an odd key get one new page only, which fits those of two pages or fewer."""
    own = _pages(spark, sf_dir)
    new = own.where("page_index % 2 = 0 and (doc_id % 2 = 0 or page_index = 0)").select("doc_id", "page_index", F.lit("new").alias("role"), (-1 - F.floor(F.col("page_index") / 2)).alias("turn"))
    return _out(pages.replace_stepped(own, new))


@query(f"WITH {_PAGES} SELECT doc_id, 'insert at 4 of ' || n || ' pages' AS problem FROM p WHERE page_index = 0 AND n < 4")
def page_insert_problems(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return pages.insert_problems(own, 4, own.select("doc_id").distinct())


@query("SELECT o_orderkey, concat_ws(',', 0.5 * 4, CASE WHEN length(o_orderstatus || o_orderpriority) > 1 THEN 1.5 * 4 END, CASE WHEN length(o_orderstatus || o_orderpriority) > 2 THEN 2.5 * 4 END) AS places FROM orders".replace("0.5 * 4", "'2.0'").replace("1.5 * 4", "'6.0'").replace("2.5 * 4", "'10.0'"))
def comb_layout(spark, sf_dir):
    made = forms.comb_positions(F.concat("o_orderstatus", "o_orderpriority"), 12.0, 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(made.cast("array<string>"), ",").alias("places"))


@query("SELECT o_orderkey, '/F' || o_orderkey % 5 AS font, CASE WHEN o_orderkey % 7 = 0 THEN 11.0 ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS size FROM orders")
def default_appearance(spark, sf_dir):
    key = F.col("o_orderkey")
    da = F.concat(F.lit("0 g /Old 9 Tf /F"), key % 5, F.lit(" "), key % 7, F.lit(" Tf"))
    return table(spark, sf_dir, "orders").select("o_orderkey", forms.default_appearance(da).alias("d")).select("o_orderkey", "d.font", "d.size")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/On' ELSE '/Off' END AS box, CASE WHEN o_orderstatus IN ('O', 'F') OR o_orderkey % 3 = 0 THEN o_orderstatus END AS choice FROM orders")
def button_and_choice(spark, sf_dir):
    key = F.col("o_orderkey")
    edit = F.when(key % 3 == 0, 1 << 18).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", forms.checkbox_value(key % 2 == 0, F.lit("/On")).alias("box"), forms.choice_value(F.col("o_orderstatus"), F.array(F.lit("O"), F.lit("F")), edit).alias("choice"))


@query("""WITH RECURSIVE w AS (SELECT item_id, string_split_regex(text, ' +') AS w FROM benchmark), f AS (
  SELECT item_id, w, 1 AS i, [w[1]] AS lines, list_sum(list_transform(string_split(w[1], ''), lambda c: CASE WHEN c = 'e' THEN 300 ELSE 500 END)) AS wide FROM w WHERE len(w) > 0
  UNION ALL
  SELECT item_id, w, i + 1, CASE WHEN wide + 250 + n <= 16000 THEN list_append(lines[:-2], lines[-1] || ' ' || w[i + 1]) ELSE list_append(lines, w[i + 1]) END, CASE WHEN wide + 250 + n <= 16000 THEN wide + 250 + n ELSE n END
  FROM (SELECT *, list_sum(list_transform(string_split(w[i + 1], ''), lambda c: CASE WHEN c = 'e' THEN 300 ELSE 500 END)) AS n FROM f WHERE i < len(w)))
SELECT item_id, array_to_string(lines, '|') AS lines FROM f WHERE i = len(w)""")
def word_wrap_by_width(spark, sf_dir):
    widths = {i: 500 for i in range(256)} | {ord("e"): 300, 32: 250}
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(content.word_wrap_widths("text", 160, widths, 10, 500)).alias("lines"))
    return rows.select("item_id", F.array_join("lines", "|").alias("lines"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x17\\x20-\\x7E\\x{A1}-\\x{AC}\\x{AE}-\\x{FF}" + "".join(f"\\x{{{x:04X}}}" for x in text.PDFDOC.values()) + "]') AS ok, CAST(length(text) AS BIGINT) AS n FROM documents")
def pdfdoc_checked(spark, sf_dir):
    got = table(spark, sf_dir, "documents").select("doc_id", text.pdfdoc_checked(F.col("text")).alias("c"))
    return got.select("doc_id", "c.ok", F.octet_length("c.raw").cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS rectangle FROM orders")
def object_is_rectangle(spark, sf_dir):
    key, one = F.col("o_orderkey"), F.lit(1.0)
    items = F.when(key % 3 == 0, F.array(one, one, one, one)).when(key % 3 == 1, F.array(one, one, one)).otherwise(F.array(one, one, one, F.lit(None).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", arrays.is_rectangle(items).alias("rectangle"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def text_strings(spark, sf_dir):
    """Texts to the bytes that DocumentInfo stores and back."""
    back = text.text_string(text.docinfo_bytes(F.coalesce(F.col("text"), F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("digest"), F.when(F.col("text").isNotNull(), F.octet_length(back)).cast("long").alias("n"))


@query("WITH s AS (SELECT p_partkey, least(612.0 / (p_size + 100), 792.0 / (p_size * 2 + 50)) AS k, p_size FROM part) SELECT p_partkey, CAST(floor(k * 10000 + 0.3141592653) AS BIGINT) AS scale, CAST(floor((612 - (p_size + 100) * k) / 2 * 10000 + 0.3141592653) AS BIGINT) AS x, CAST(floor((792 - (p_size * 2 + 50) * k) / 2 * 10000 + 0.3141592653) AS BIGINT) AS y FROM s")
def overlay_placement(spark, sf_dir):
    size = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    m = geometry.placement(geometry.rectangle(zero, zero, size + 100, size * 2 + 50), geometry.rectangle(zero, zero, F.lit(612.0), F.lit(792.0)))
    whole = lambda x: F.floor(x * 10000 + 0.3141592653)
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", whole(F.col("m.a")).alias("scale"), whole(F.col("m.e")).alias("x"), whole(F.col("m.f")).alias("y"))


@query("SELECT p_partkey, CAST((p_size * ch * bits + 7) // 8 AS BIGINT) AS row_bytes, CASE WHEN k = 0 THEN '.png' WHEN k = 1 THEN '.jpg' WHEN k = 2 THEN '.tif' ELSE '.tiff' END AS suffix FROM (SELECT p_partkey, p_size, p_partkey % 4 + 1 AS ch, CASE p_partkey % 2 WHEN 0 THEN 4 ELSE 8 END AS bits, p_partkey % 4 AS k FROM part)")
def image_extract_kind(spark, sf_dir):
    key = F.col("p_partkey")
    k = (key % 4 + 1).cast("int")
    filters = F.element_at(F.array(F.array(F.lit("/FlateDecode")), F.array(F.lit("/FlateDecode"), F.lit("/DCTDecode")), F.array(F.lit("/CCITTFaxDecode")), F.array(F.lit("/FlateDecode"))), k)
    mode = F.element_at(F.array(*map(F.lit, ("RGB", "RGB", "1", "CMYK"))), k)
    return table(spark, sf_dir, "part").select("p_partkey", images.row_bytes(F.col("p_size"), key % 4 + 1, F.when(key % 2 == 0, 4).otherwise(8)).cast("long").alias("row_bytes"), images.extract_kind(filters, F.lit(False), mode).alias("suffix"))


from quire import file_queries  # noqa: E402  (its queries join these)

QUERIES |= file_queries.QUERIES
ORACLE_SQL |= file_queries.ORACLE_SQL
