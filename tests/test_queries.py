"""Every registered query against its SQL on the same tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from spokeworks.plans import QUERIES, SQL

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def _plain(value):
    return float(value) if isinstance(value, Decimal) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    opened = {}

    def connect(folder):
        if folder not in opened:
            opened[folder] = duckdb.connect()
            for file in Path(folder).glob("*.parquet"):
                opened[folder].execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        return opened[folder]

    return connect


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("folder", FOLDERS, ids=lambda f: f.rsplit("/", 1)[1])
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name, folder):
    result = QUERIES[name](spark, folder)
    found = duck(folder).execute(SQL[name])
    names = [column[0] for column in found.description]
    assert sorted(result.columns) == sorted(names)
    expected = _rows(names, found.fetchall())
    assert _rows(result.columns, [tuple(r) for r in result.collect()]) == expected
    assert expected
