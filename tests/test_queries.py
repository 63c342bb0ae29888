import os

import duckdb
import pytest
from quire import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_as_in_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rel = duck.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    want = [dict(zip(cols, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_package():
    """The entry imports and lists the document queries where that package is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_import_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
