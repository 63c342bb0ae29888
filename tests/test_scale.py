"""What lets queries grow: no work per row that grows with its group, files dealt over all cores, each made and read once."""

import pytest
from pyspark.sql import functions as F

from quire import file_queries
from quire.operators import graph
from quire.sources import crypt, edit, tables
from quire.sources.values import Malformed

SF = "/root/testdata/sf0.001"


def test_unique_names_of_a_large_group(spark):
    """Names by brute force; the plan makes no list of suffixes for a row."""
    new = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("name"))
    gone = ["a", "a.1", "a.2", "a.7", "a.2399", "a.2401", "b.3", "b.03", "a.1.1", "c"]
    got = graph.unique_names(new, spark.createDataFrame([(x,) for x in gone * 2], "name string"))
    used, want = set(gone), {}
    for i in range(3000):
        name = base = "b" if i % 5 == 0 else "a"
        k = 0
        while name in used:
            k += 1
            name = f"{base}.{k}"
        used.add(name)
        want[i] = name
    assert got.columns == ["seq", "name", "new_name"]
    assert {r.seq: r.new_name for r in got.collect()} == want
    assert "sequence(" not in got._jdf.queryExecution().toString()


#: How often a query makes the files, where that is not once: none in the plan, as what it keeps is made before; twice for two kinds of files, or for objects and trailers.
MADE = {"file_table_function": 0, "file_source": 0, "xmp_pdf_version": 0, "job_object_streams": 2, "file_json_round_trip": 2}
FINDINGS = "job_encrypt edit_by_path file_table_function job_decrypt job_remove job_object_streams page_remove_unused job_collate job_merge file_rebuilt file_source file_images file_ctm job_normalize file_json_round_trip file_name_trees file_outline sanitized_structure file_references job_overlay file_pages file_documents file_annotations page_contents_add file_image_bytes file_docinfo job_labels page_flatten_annotations job_flatten xmp_pdf_version".split()


@pytest.mark.parametrize("name", FINDINGS)
def test_files_are_dealt_and_made_once(spark, name):
    """By a number of partitions that adaptive execution keeps, and not anew for each table that is read of them."""
    plan = file_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    made = MADE.get(name, 1)
    assert plan.count("FileScan parquet") == made
    assert plan.count("REPARTITION_BY_NUM") >= made


def test_files_in_many_tasks(spark):
    """However few bytes the turns have."""
    assert file_queries.files(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert file_queries.pictures(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_several_tables_are_those_of_each(spark):
    files = file_queries.files(spark, SF).limit(5).unionByName(spark.createDataFrame([("bad", bytearray(b"no file")), ("none", None)], "path string, content binary"))
    wanted = {"docs": ("n_pages", "problem"), "pages": ("page_index", "obj", "mediabox"), "objects": ("obj", "raw"), "xmp": ("values",), "docinfo": (), "problems": ("problem",)}
    rows = tables.several(files, wanted).collect()
    assert all(r.n_bytes > 100 for r in rows if r.path not in ("bad", "none"))
    for table, columns in wanted.items():
        alone = tables.tables(files, table).select("path", *columns).collect()
        assert len(alone) and sorted(map(repr, (tuple(r[c] for c in ("path", *(f"{table}_{c}" for c in columns))) for r in rows if r.table == table))) == sorted(map(repr, map(tuple, alone)))


@pytest.mark.parametrize("size", [0, 16, 4096])
def test_library_ciphers_are_those_of_the_tables(size):
    key, iv, data = bytes(range(32)), bytes(range(16)), bytes(i * 7 & 255 for i in range(size))
    for k in (key, key[:16]):
        coded = crypt._aes_encrypt(k, iv, data)
        assert crypt.aes_encrypt(k, iv, data) == coded
        assert crypt.aes_decrypt(k, iv, coded + b"rest") == crypt._aes_decrypt(k, iv, coded + b"rest") == data
    assert crypt.rc4(key[:5], data) == crypt._rc4(key[:5], data)
    with pytest.raises(Malformed):
        crypt.rc4(b"", data)


def test_numbers_of_new_objects_go_on():
    """Without a look at all others, and never onto one that is there."""
    e = edit.Editor()
    assert [e.add(None).obj for _ in range(3)] == [3, 4, 5]
    e.objects[6, 0] = True
    assert e.add(None).obj == 7 and e.objects[6, 0] is True
