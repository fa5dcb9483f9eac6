"""Every registered query that has SQL gives the rows of its SQL; the others give rows."""

import datetime
import math

import duckdb
import pytest

from tidewire.plans import corpus_queries, model_queries, payload_queries, profile_queries, sequence_queries, source_queries, window_queries  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return own


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    con.execute(SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted("|".join(map(text, r)) for r in con.fetchall())
    assert sorted("|".join(map(text, r)) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["p1_feature_selection", "s4_packet_table", "w1_interval", "f1_byte_entropy", "w4_gap_in_window"])
def test_floats_are_equal_to_the_last_digit(spark, name):
    """Values themselves, over a larger table: rounding that SQL does and the query doesn't shows here."""
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    own.execute(SQL[name])
    names = [c[0] for c in own.description]
    assert sorted(map(repr, own.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
