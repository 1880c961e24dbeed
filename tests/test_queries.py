"""Every query of the analytics modules against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import arrivals, entities, history, intake, requests, review, timeline, upkeep

DATA = Path("/root/testdata/sf0.001")
MODULES = (arrivals, entities, history, intake, requests, review, timeline, upkeep)


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_queries_give_the_rows_of_their_sql(spark, module):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert module.QUERIES.keys() == module.ORACLE_SQL.keys()
    wrong = []
    for name, query in module.QUERIES.items():
        df = query(spark, str(DATA))
        want = con.execute(module.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        if sorted(names) != sorted(df.columns) or Counter(tuple(map(plain, r)) for r in df.select(*names).collect()) != Counter(tuple(map(plain, r)) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong
