"""Every registered query against its SQL on the small tables; the others must give rows."""

import os

import oracle
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF_DIR)


def test_every_check_has_its_query():
    assert set(ORACLES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, con, name):
    fn = driver.queries()[name]
    if name in ORACLES:
        assert oracle.compare(spark, con, name, fn, ORACLES[name], SF_DIR) is None
    else:
        assert fn(spark, SF_DIR).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["split", "score", "n_class", "n_split", "quota"]
