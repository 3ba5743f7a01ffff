"""Every registered query that has SQL against it, on the two small table sets."""

import duckdb
import pytest

from shelfkin.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(name, spark, data_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data_dir)
    found = db.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_all_are_registered():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
