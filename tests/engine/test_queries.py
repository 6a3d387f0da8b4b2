import pytest

import __spark_entry__
from millrace.plans import registry
from tests.oracle import connect, same_rows


FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return {folder: connect(folder) for folder in FOLDERS}


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, folder, name):
    df = registry.QUERIES[name](spark, folder)
    if name in registry.ORACLE_SQL:
        same_rows(df, duck[folder], registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert {r.route for r in __spark_entry__.entry(spark).collect()} <= {"agent", "unchanged", "identical", "skip"}


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
