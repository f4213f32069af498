from datetime import datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from seamark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(name, spark, sf, duck, rows):
    columns, own = rows(catalog.queries()[name](spark, sf))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert own
    else:
        assert own == duck(sql, sf, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ann_recall(spark, sf):
    from pyspark.sql import functions as F

    from seamark.operators import ann, search

    found = catalog.queries()["ann_cells"](spark, sf)
    exact = search.knn_batch(catalog._vectors(spark, sf), catalog._asked(spark, sf), 10)
    assert ann.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def swapped(folder, sf, name, columns):
    """A copy of the tables in ``sf`` by links, with ``name`` made of ``columns``."""
    for f in Path(sf).glob("*.parquet"):
        if f.stem != name:
            (folder / f.name).symlink_to(f)
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("odd", [(7, ""), (7, None), (None, "x" * 3000)], ids=["empty text", "null text", "null id"])
def test_cap_chunks_of_odd_rows(spark, sf, duck, rows, tmp_path, odd):
    ids, texts = zip(odd, (1, "x"), (2, "x" * 2048), (3, "x" * 2047 + "é"), (4, "x" * 2045 + "😀" * 600), strict=True)
    d = swapped(tmp_path, sf, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * 5, "source": ["src1"] * 5})
    columns, own = rows(catalog.queries()["cap_chunks"](spark, d))
    assert own == duck(catalog.oracle_sql()["cap_chunks"], d, columns)
    assert len(own) == 7


def test_freshness_due_within_seconds(spark, sf, duck, rows, tmp_path):
    now, limit = datetime(2024, 1, 15), datetime(2024, 1, 14, 23, 50)
    times = [t + timedelta(microseconds=n) for t in (now, limit, limit + timedelta(seconds=1)) for n in (-1_000_000, -1, 0, 1, 500_000, 999_999)]
    times += [None, datetime(1969, 12, 31, 23, 59, 59, 1), datetime(1800, 1, 1, 0, 0, 0, 999_999)]
    d = swapped(tmp_path, sf, "events", {"event_id": [None, *range(1, len(times))], "ts": pa.array(times, pa.timestamp("us"))})
    columns, own = rows(catalog.queries()["freshness_due"](spark, d))
    assert own == duck(catalog.oracle_sql()["freshness_due"], d, columns)
    assert len(own) == 17
