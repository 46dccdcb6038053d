"""Every query of the library's own against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*(F.col(c) for c in cols)).collect()), key=repr)
    expected = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted((plain(r) for r in expected), key=repr)


def test_entry_has_what_is_registered():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
