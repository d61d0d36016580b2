import pytest

from laborlens.plans import registry
from tests.compare import database, differences, sql_rows

ENTRIES = registry.entries()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf, db):
    df = registry.queries()[name](spark, sf)
    sql = ENTRIES[name][1]
    assert sql and not differences(df, db, sql)
    assert sql_rows(db, sql)[1], "no row to compare"
