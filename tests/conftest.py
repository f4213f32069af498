import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from seamark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sql, sf_dir, columns):
        con = duckdb.connect()
        for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(sql)
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == sorted(columns)
        return sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows():
    def run(df):
        columns = sorted(df.columns)
        return columns, sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)

    return run
