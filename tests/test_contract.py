"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from lumisift.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame, cols):
    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        if isinstance(v, bool) or str(type(v)).endswith("bool_'>"):
            return str(bool(v))
        try:
            f = float(v)
            return repr(f) if not isinstance(v, str) and not math.isnan(f) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(got, cols) == plain(want, cols)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["query_id", "item_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_titles_of_odd_pages_same_as_sql(spark, duck, tmp_path):
    """A reference without its semicolon, none known, doubled ones, white space, several titles, none, no page."""
    inside = ["a&amp;&amp", "&amp", " A &amp; B ", "&amp;lt; &lt;b&gt; &quot;x&quot;", "&#38; &nbsp; &ampx", "\t x \n", "\u00a0 y\u2003", "x\n ", "x \n", "", "  ", "x</title><title>y", "a\nb", "\u00e9&lt"]
    pages = [(i, f"<html><head><title>{t}</title></head></html>") for i, t in enumerate(inside)] + [(90, "<p>none"), (91, None), (92, "<TITLE>x</TITLE>"), (93, "<title>never ends"), (94, "<title></title><title>z</title>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duck.sql(ORACLES["h1_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["h1_titles"](spark, str(tmp_path)).collect())) == sorted(want)
