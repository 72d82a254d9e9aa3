import duckdb
import pytest

from veilcast.plans import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NAMES = list(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: str(x) if not isinstance(x, float) else None if x != x else round(x, 4)
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, oracle, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), oracle.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == y or abs(float(x) - float(y)) <= 0.011 for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", list(catalogue.NOISY))
def test_noisy_answers_repeat(spark, sf_dir, name):
    q = catalogue.queries()[name]
    assert rows(q(spark, sf_dir).toPandas()) == rows(q(spark, sf_dir).toPandas())
