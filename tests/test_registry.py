import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["millrace.llm", "corpus_pipeline", "ahocorasick", "public_tokenizers"])
def test_other_queries_are_there_without_the_subpackage(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; from millrace import plans; assert set(e.queries()) == set(plans.QUERIES) and set(e.oracle_sql()) == set(plans.ORACLES)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), check=True, timeout=120)
