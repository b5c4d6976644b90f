from sparkloom.operators import chunking
from sparkloom.sources import html, tables

PAGE = """<html><head><meta name="docsearch:version" content="1.4.0"></head><body><nav>Navigation</nav><main>
<h1>Linear Models<a class="headerlink" href="#x">¶</a></h1><p>Intro text.</p><aside>Side</aside>
<h2>Ridge</h2><p>Ridge <code>alpha</code> text.</p><div class="highlight"><pre>from x import y</pre></div>
<h3>Details</h3><ul><li>one</li><li>two</li></ul>
<table><tr><th>Metric</th><th>Function</th></tr><tr><td>Accuracy</td><td>accuracy_score</td></tr></table>
<dl><dt>alpha</dt><dd>strength</dd></dl><div class="admonition"><p class="admonition-title">Tip</p><p>Scale first.</p></div></main><footer>Foot</footer></body></html>"""


def test_clean_page():
    d = html.clean_page("linear_models", "u", "c", PAGE)
    assert (d["title"], d["version"], d["headings"]) == ("Linear Models", "1.4.0", ["Linear Models", "Ridge", "Details"])
    for noise in ("Navigation", "Side", "Foot", "¶"):
        assert noise not in d["content"]
    for kept in ("# Linear Models", "## Ridge", "`alpha`", "```python\nfrom x import y\n```", "- one\n- two", "| Metric | Function |\n| --- | --- |\n| Accuracy | accuracy_score |", "**alpha**", ": strength", "> **Tip:** Scale first."):
        assert kept in d["content"], kept
    assert [s["title"] for s in d["sections"]] == ["Linear Models", "Ridge", "Details"]
    assert d["char_count"] == len(d["content"])


def test_unclosed_paragraphs_nest():
    d = html.clean_page("a_b", None, None, "<body><p>one<p>two<p>three</body>")
    assert d["title"] == "A B" and len(d["sections"]) == 1 and "three" in d["sections"][0]["content"]


def test_deep_and_broken_pages():
    assert html.clean_page("x", None, None, "<div>" * 30_000 + "deep").get("content") == "deep"
    assert html.clean_page("x", None, None, "")["content"] == ""
    assert html.clean_page("x", None, None, "</p></div><b>t")["content"] == "t"


def test_pages_table_with_bad_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 7), (2, "u", None, 7), (None, "u", "x", 7)], "page_id long, url string, html string, title int")
    got = {r["doc_id"]: r for r in html.clean_pages(rows).collect()}
    assert got["1"]["title"] == "Linear Models" and got["2"]["error"] == "no content" and got[None]["error"] == "no id"
    report = tables.ingestion_report(html.clean_pages(rows)).first()
    assert (report["processed"], report["failed"]) == (1, 2)


def sentence(word, n):
    return " ".join(f"{word} sentence number {i} has exactly eight words." for i in range(n))


DOC = {"content": f"# Doc\n\n{sentence('First', 30)}\n\n## Second\n\n{sentence('Second', 40)}\n\n## Third\n\n{sentence('Third', 30)}", "sections": [("First", 2, sentence("First", 30)), ("Second", 2, sentence("Second", 40)), ("Third", 2, sentence("Third", 30))]}


def test_strategies():
    fixed = chunking.Fixed(400, 40).chunks("Doc", DOC["content"], [])
    assert len(fixed) >= 2 and all(c.tokens == chunking.n_tokens(c.text) for c in fixed)
    overlap = chunking.Overlap(300, 60, 30).chunks("Doc", DOC["content"], [])
    assert len(overlap) >= 3 and len(set(overlap[0].text.split()[-60:]) & set(overlap[1].text.split()[:80])) >= 10 - 2
    assert overlap[1].text.startswith(overlap[0].text.split("\n\n")[-1]) or overlap[0].text.split("\n\n")[-1] in overlap[1].text
    structure = chunking.Structure(350, 30).chunks("Doc", "", DOC["sections"])
    assert len(structure) >= 3 and max(c.tokens for c in structure) <= 450
    assert structure[0].text.startswith("## First")


def test_fixed_edges():
    assert chunking.Fixed().chunks("t", "", []) == [] and chunking.Fixed().chunks("t", " \n\n ", []) == []
    tail = chunking.Fixed(50, 20).chunks("t", "\n\n".join(["word " * 50, "short end"]), [])
    assert len(tail) == 1 and tail[0].text.endswith("short end")
    label = chunking.Fixed(10, 5).chunks("t", "one two three four five six seven eight\n\n# Next\n\nnine ten eleven twelve thirteen fourteen fifteen", [])
    assert label[0].section == "Next"  # a heading counts from the chunk it closes


def test_structure_joins_short_sections_and_splits_long_ones():
    short = chunking.Structure(100, 30).chunks("t", "", [("A", 2, "few words"), ("B", 3, "word " * 40)])
    assert len(short) == 1 and short[0].section == "A" and "### B" in short[0].text
    long = chunking.Structure(100, 30).chunks("t", "", [("L", 5, sentence("Long", 40))])
    assert [c.part for c in long] == list(range(1, len(long) + 1)) and all(c.parts == len(long) and c.split for c in long)
    assert long[0].text.startswith("#### L (Part 1/")
    assert chunking.Structure().chunks("t", "", []) == []


def test_chunk_table_and_stats(spark):
    rows = spark.createDataFrame([("d", "u", "Doc", DOC["content"], None), (None, None, None, None, None), ("e", "u", "E", "", "x")], "doc_id string, source_url string, title string, content string, strategy string")
    chunks = chunking.chunk(rows, "fixed")
    assert chunks.first()["chunk_id"] == "d_fixed_0001"
    stats = chunking.chunk_stats(chunks).first()
    assert stats["total_chunks"] == chunks.count() and stats["complete_pct"] == 100
    made = spark.createDataFrame([("fixed", "c1", "d", "u", "t", "s", "x", 20, 100), ("fixed", "c2", "d", "u", "t", "s", "y", 150, 600)], "strategy string, chunk_id string, doc_id string, source_url string, doc_title string, section_title string, content string, token_count int, char_count int")
    got = chunking.chunk_stats(made, 50, 200).first()
    assert (got["total_tokens"], got["avg_tokens"], got["under_count"], got["under_pct"], got["over_count"]) == (170, 85.0, 1, 50.0, 0)


def test_preservation_falls_back_to_all_chunks(spark):
    chunks = spark.createDataFrame([("fixed", "c1", "d", "Alpha and Beta"), ("fixed", "c2", "e", "gamma")], "strategy string, chunk_id string, doc_id string, content string")
    probes = spark.createDataFrame([("p1", "a", "d", ["alpha", "BETA"]), ("p2", "a", "gone", ["gamma"]), ("p3", "b", "d", ["gamma"])], "question_id string, category string, target_doc_id string, key_phrases array<string>")
    got = {r["question_id"]: r["preserved"] for r in chunking.preservation(chunks, probes).collect()}
    assert got == {"p1": True, "p2": True, "p3": False}
    rates = {r["category"]: r["rate"] for r in chunking.preservation_rates(chunking.preservation(chunks, probes)).collect()}
    assert rates == {"(all)": 66.67, "a": 100.0, "b": 0.0}


def test_sources_and_sinks(spark, tmp_path):
    assert tables.curated_sources(spark).count() == 19
    base = f"file://{tmp_path}"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_text(PAGE)
    pages = tables.read_html_files(spark, f"{base}/raw")
    docs = html.clean_pages(pages, "doc_id", "url", "html")
    assert docs.first()["title"] == "Linear Models"
    tables.write_documents(docs, f"{base}/docs", "json")
    (tmp_path / "docs" / "zz.json").write_text("{broken\n")
    (tmp_path / "docs" / "manifest.json").write_text('{"doc_id": "m"}\n')
    back = tables.read_documents(spark, f"{base}/docs", "doc_id string, title string")
    assert [r["doc_id"] for r in back.collect()] == ["a"]
    chunks = chunking.chunk_all(docs)
    tables.write_chunks(chunks, f"{base}/chunks")
    assert tables.read_chunks(spark, f"{base}/chunks").count() == chunks.count()
    (tmp_path / "b.json").write_text('[{"question_id": "b", "query": "x"}, {"question_id": "a", "query": "y"}]')
    bench = tables.read_benchmark(spark, f"{base}/b.json")
    assert [r["question_id"] for r in tables.filter_benchmark(bench, limit=1).collect()] == ["a"]
    assert tables.filter_benchmark(bench, limit=0).count() == 2


def test_outputs_are_guarded():
    import pytest

    with pytest.raises(ValueError, match="differ"):
        tables.check_outputs("a/b", "a/b")
    with pytest.raises(ValueError, match="protected"):
        tables.check_outputs("a/b", protected=("a//b",))
