"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.plans import audits, catalogue, files, policies, process

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (catalogue, process, audits, files, policies)
QUERIES, SQL = ({k: v for m in PLANS for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "SQL"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are missing")


def differences(query, sql, spark, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    df.write.mode("overwrite").parquet(str(folder))
    con.execute(f"CREATE TABLE o AS {sql}")
    names = [r[0] for r in con.execute("DESCRIBE o").fetchall()]
    assert sorted(names) == sorted(df.columns)
    c = ", ".join(f'"{x}"' for x in sorted(names))
    a, b = f"SELECT {c} FROM '{folder}/*.parquet'", f"SELECT {c} FROM o"
    return [con.execute(f"({x}) EXCEPT ALL ({y}) LIMIT 3").fetchall() for x, y in ((a, b), (b, a))]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tmp_path, name):
    assert differences(QUERIES[name], SQL[name], spark, tmp_path / "out") == [[], []]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in PLANS)
