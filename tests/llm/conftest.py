import duckdb
import pytest

LLM_TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in LLM_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def results(spark):
    """Each registered query's rows over sf0.01, computed once."""
    from perkflow.llm.queries import QUERIES
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, SF).toPandas()
        return kept[name]

    return get


@pytest.fixture()
def matches_sql(results, duck):
    """Asserts that a query's rows are its DuckDB twin's."""
    from perkflow.llm.queries import ORACLE_SQL
    from tests.oracle_check import compare

    def check(name):
        problem = compare(results(name), duck.execute(ORACLE_SQL[name]).df())
        assert problem is None, problem

    return check
