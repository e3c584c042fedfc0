"""Queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from tracelake.llm import registry

SF = "/root/testdata/sf0.001"


def shown(value) -> str:
    return "NULL" if value is None or value != value else repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows_of(columns, rows) -> list[tuple[str, ...]]:
    """Rows as texts, columns in order of their names. Values are not taken through pandas, which turns long columns with nulls into doubles."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
