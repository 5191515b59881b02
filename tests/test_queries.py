import duckdb
import pytest

import __spark_entry__
from quarry import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in plans.ORACLES:
        cursor = db.execute(plans.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["nodes_below", "sql_functions", "cannot_downgrade", "encode_documents", "migrate_grown", "migrate_documents", "migrate_refuses"])
def test_no_side_made_in_tasks_is_sent_whole(spark, name):
    """What a task makes of a text is far larger than the row that Spark estimates it by, so such sides are sorted, never broadcast."""
    assert "Broadcast" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
