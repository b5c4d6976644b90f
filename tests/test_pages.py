"""Pages with character references that are cut, unknown or quotes: the queries give the SQL's rows."""

import duckdb
import pytest

from sparkloom.plans import catalogue
from sparkloom.sources import html

PAGES = [
    (1, "u1", "<html><head><title>t</title></head><body><h1>Cut &amp;&amp;&amp</h1><p>Salt &amp; pepper &amp</p><p>&copy; R&D &middot; a &lt;b&gt; &quot;c&quot;</p></body></html>"),
    (2, "u2", '<html><body><h1>A &quot;word&quot; of it</h1><p>Twice &amp;lt; and &quot;quoted&quot; <a href="?a=1&b=2">link</a></p></body></html>'),
    (3, "u3", "<html><body><h1>Plain</h1><p>Other &nbsp &#233; &eacute; &lt</p></body></html>"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"file://{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["html_clean", "chunk_structure_pages", "html_sections", "ingestion_report", "page_title"])
def test_references_are_read_as_the_sql_has_them(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, f"file://{folder}").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_the_operator_reads_references_as_html_does():
    assert html.clean_page("1", None, None, PAGES[0][2])["title"] == "Cut &&&"
    assert html.clean_page("1", None, None, PAGES[0][2], ("amp",))["title"] == "Cut &&&amp"
