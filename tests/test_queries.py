"""Every registered query of the library against its SQL."""

import pytest
from compare import rows, sql_rows

from knowspan.plans import catalog

QUERIES, SQL = {}, {}
for package in ("knowspan.operators", "knowspan.sources", "knowspan.streaming"):
    q, s = catalog.gather(package)
    QUERIES |= q
    SQL |= s


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck):
    assert rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == sql_rows(duck, SQL[name])


def test_without_sql(spark):
    from knowspan.functions import kernels as K

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    found = {r.page_id: r.markdown for r in QUERIES["t22_html_markdown"](spark, d).collect()}
    assert found == {k: K.html_markdown(v) for k, v in pages.items()}
    assert all("<" not in m or "track(" not in m for m in found.values())
    parts = sorted((r.page_id, r.chunk, r.path) for r in QUERIES["t11_chunks"](spark, d).collect())
    assert parts == sorted((k, n, p) for k, v in pages.items() for n, p, _ in K.chunks(K.html_markdown(v)))
    scores = {r.page_id: r.score for r in QUERIES["t10_page_score"](spark, d).collect()}
    assert scores == {k: K.rule_score(".html", len(v.encode()), v)[-1] for k, v in pages.items()}
    assert all(r.length <= 12_288 for r in QUERIES["t24_compress"](spark, d).collect())
    assert set(QUERIES) - set(SQL) == {"m13_reparent", "t22_html_markdown", "t11_chunks", "t10_page_score", "t24_compress"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
