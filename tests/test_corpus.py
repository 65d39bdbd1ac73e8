"""Readers, packages, references, reports, streaming and the driver's entry points."""

import io
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

EN = r"""\documentclass{article}
\begin{document}
\section{Results}
The $N=14$ raters gave a mean score of 4.33 on the scale.
Our route reached a rate of 0.641 (Table~\ref{tab:m}).
\input{more}
\begin{table}\caption{Rates.}\label{tab:m}
\begin{tabular}{lc}
Route & Rate \\
Our route & 0.645 \\
\end{tabular}
\end{table}
\end{document}
"""
MORE = "The difference was large ($t = 1.10$, $p = 0.002$).\n"
MD = """# 研究

## 结果

""" + "本研究描述了植物的生长情况。" * 40 + """

表 1 结果

| 方法 | 得分 |
|---|---|
| 新的方法 | 0.912 |
| 旧的方法 | 0.805 |

新的方法的得分为 0.915。

## 参考文献

"""


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{s}<w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>'
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    row = lambda *cs: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cs) + "</w:tr>"
    body = p("Results", head) + p("Table 1. Rates.") + f"<w:tbl>{row('Route', 'Rate')}{row('Our route', '0.645')}</w:tbl>" + p("Our route reached 0.641 there. Of the sites, 30/120 (27%) closed.")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("papers")
    def put(path, data):
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(data if isinstance(data, bytes) else data.encode())
    put("en/main.tex", EN)
    put("en/more.tex", MORE)
    put("en/refs.bib", "@article{x, title={T}, year={2001}}\n")
    put("en/results/grid.json", json.dumps({"m": {"a": 0.11, "b": 0.14, "c": 0.17, "d": 0.20}}))
    put("en/tests/test_a.py", "pass\n")
    put("zh/paper.md", MD)
    put("word/paper.docx", _docx())
    put("plain.txt", "We kept 500 pots (20 trays x 40 rows).")
    put("broken/paper.docx", b"no archive")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("inner/main.tex", EN.replace(r"\input{more}", ""))
    put("zipped/all.zip", z.getvalue())
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as f:
        f.writestr("../evil.tex", EN)
    put("unsafe/all.zip", bad.getvalue())
    return str(top)


def test_readers_and_report(spark, folder):
    from veriloom.plans import report
    from veriloom.sources import readers

    docs = readers.manuscripts(spark, folder).cache()
    rows = {r.path.split("/")[0]: r for r in docs.collect()}
    assert set(rows) == {"en", "zh", "word", "plain.txt", "broken", "zipped"}
    assert rows["en"].kind == "latex" and "t = 1.10" in rows["en"].text and "\\input" not in rows["en"].text and "@article{x" in rows["en"].bib
    assert rows["zh"].language == "zh" and "\\begin{tabular}{ll}" in rows["zh"].text and "\\caption{表 1 结果}" in rows["zh"].text
    assert "\\section{Results}" in rows["word"].text and "27\\%" in rows["word"].text and "\\caption{Table 1. Rates.}" in rows["word"].text
    assert rows["broken"].text is None and rows["broken"].notes
    files = readers.package_files(spark, folder)
    assert {r.rel_path for r in files.collect()} >= {"results/grid.json", "tests/test_a.py"}

    found = report.check_corpus(docs.where("text is not null"), files).cache()
    by = {k: sorted(r.category for r in found.where(F.col("doc_id") == v.doc_id).collect()) for k, v in rows.items()}
    assert by["en"] == ["constructed_series_json", "grim_infeasible_mean", "prose_table_number_disagreement", "pvalue_recompute_mismatch"]
    assert by["zipped"] == ["grim_infeasible_mean", "prose_table_number_disagreement"]
    assert by["zh"] == ["prose_table_number_disagreement"] and by["plain.txt"] == ["product_total_mismatch"]
    assert by["word"] == ["percent_count_mismatch", "prose_table_number_disagreement"]
    first = found.where(F.col("doc_id") == rows["en"].doc_id).orderBy("position").first()
    assert first.id == "S1" and first.group == "numbers" and first.order == "first" and first["where"] == "Results" and first.quote.startswith("Our route reached")

    out = report.results(docs.where("text is not null"), found, _statements(docs), report.not_verified(docs, files))
    result = json.loads(out.where(F.col("doc_id") == rows["en"].doc_id).first().result)
    assert [f["id"] for f in result["findings"]] == ["S1", "S2", "S3", "S4"] and len(result["statements"]) == 10
    text = json.dumps(result | {"path": "<b>"})
    assert "S1" in report.as_markdown(text) and "&lt;b&gt;" in report.as_html(text, "zh") and "<b></b>" not in report.as_html(text)


def _statements(docs):
    from veriloom.operators.writing import statements

    return statements(docs.where("text is not null"))


def test_repartitioning_and_copies(spark):
    from veriloom.plans import report

    text = "\\begin{document}Of the plants, 30/120 (27\\%) died. The drug was better (P = 0.30).\\end{document}"
    one = spark.createDataFrame([(1, text, "", "en")], "doc_id long, text string, bib string, language string")
    many = spark.createDataFrame([(i, text, "", "en") for i in range(20)], one.schema)
    want = [r[1:] for r in report.check_corpus(one).orderBy("position").collect()]
    for n in (1, 7):
        got = report.check_corpus(many.repartition(n)).orderBy("doc_id", "position").collect()
        assert len(got) == 20 * len(want) and [r[1:] for r in got[: len(want)]] == want


def test_package(spark):
    from veriloom.operators import package

    files = [
        ("results/A_table.csv", "x"), ("results/B_rates.csv", "x"), ("results/c_one.json", "x"), ("results/D_gain.csv", "t,v\n0.4127,0.07210\n0.6308,0.01504\n"), ("results/all.csv", "\n".join(f"{i / 1000:.3f}" for i in range(1000))),
        ("tests/test_t.py", "open('results/A_table.csv'); load('B_rates'); glob('results/c_*.json')"), ("grid.json", json.dumps([{"s": [0.5, 0.75, 1.0, 1.25]}, {"s": [1, 2, 3, 4]}])), ("free.json", json.dumps({"s": [0.5, 0.76, 1.0, 1.25], "b": [True, False, True, True]})), ("bad.json", "{"),
        ("solved.csv", "seed,a,b\n1,0.500010,0.200100\n2,0.499990,0.199900\n3,0.500020,0.200000\n4,0.499980,0.200050\n5,0.500000,0.199950\n"), ("flat.csv", "seed,a,b\n" + "".join(f"{i},0.500000,0.41\n" for i in range(6))),
        ("make.py", "def fit(y_true, desired_auc):\n    return 1\n"), ("loop.py", "def go(lab, s, goal):\n    for i in range(9):\n        r = auc(lab, s)\n        if r > goal:\n            break\n"), ("fine.py", "def score(y, p):\n    best = 0\n    for i in p:\n        r = auc(y, i)\n        if r > best:\n            best = r\n"), ("torn.py", "def ("),
    ]
    df = spark.createDataFrame([(1, p, os.path.splitext(p)[1], len(c), c) for p, c in files], "doc_id long, rel_path string, ext string, size long, content string")
    docs = spark.createDataFrame([(1, "\\begin{document}Gains of 0.0721 at 0.413 and 0.0150 at 0.631.\\end{document}")], "doc_id long, text string")
    got = sorted((r.category, r.target) for r in package.package_findings(docs, df).collect())
    assert got == [("back_solved_mean", "solved.csv"), ("constructed_series_json", "grid.json"), ("label_derived_score", "loop.py"), ("label_derived_score", "make.py"), ("unbound_released_record", "results/D_gain.csv")]


def test_references(spark):
    from veriloom.operators import entries as E
    from veriloom.operators import references as R

    bib = "".join(f"@article{{{k}, title={{{{{t}}}}}, journal={{Letters}}, year={{{y}}}, {x}}}\n" for k, t, y, x in [
        ("ok", "Slow growth of coastal dunes", 2001, "doi={https://doi.org/10.1000/ok}"), ("gone", "A work that is gone", 2001, "doi={10.1000/gone}"), ("other", "Birds over the northern sea", 2001, "doi={10.1000/ok}"),
        ("pre", "Tides and sand in models", 2001, "eprint={2101.00001}, archiveprefix={arXiv}"), ("nopre", "Tides and sand in models", 2001, "note={arXiv:2101.00002}"), ("seek", "Found by its title alone", 1999, ""), ("never", "Never found by anyone anywhere", 1999, ""), ("down", "Registry was down that day", 1999, "doi={10.1000/down}"), ("old", "Slow growth of coastal dunes", "n.d.", "doi={10.1000/ok}"),
    ])
    e = {x["key"]: x for x in E.read_entries("", bib)}
    assert e["ok"]["doi"] == "10.1000/ok" and e["pre"]["arxiv"] == "2101.00001" and e["nopre"]["arxiv"] == "2101.00002" and e["ok"]["title"] == "Slow growth of coastal dunes"
    work = lambda t, y=2001, **k: {"message": {"DOI": "10.1000/ok", "title": [t], "issued": {"date-parts": [[y]]}, **k}}
    hit = lambda t, y: {"DOI": f"10.1000/{y}", "title": [t], "issued": {"date-parts": [[y]]}}
    table = {
        R.WORK + "10.1000/ok": work("Slow Growth of Coastal Dunes"), R.WORK + "10.1000/gone": {"_status": 404}, R.HANDLE + "10.1000/gone": {"responseCode": 100},
        R.ARXIV + "2101.00001": {"_text": "<title>q</title><title>Tides and sand\n in models</title>"}, R.ARXIV + "2101.00002": {"_text": "<title>q</title><title>Error</title>"},
        R.search_url(e["seek"]["raw"]): {"message": {"items": [hit("Found by its title alone", 1980), hit("Found by its title alone", 1998), hit("Another", 1999)]}},
        R.search_url(e["never"]["raw"]): {"message": {"items": []}}, R.fallback_url(e["never"]["title"]): {"results": []},
    }
    lookups = spark.createDataFrame([(u, json.dumps(b)) for u, b in table.items()], "url string, body string")
    docs = spark.createDataFrame([(1, "\\begin{document}\\end{document}", bib)], "doc_id long, text string, bib string")
    v = R.verdicts(R.entries(docs), lookups).cache()
    status = {r.key: r.status for r in v.collect()}
    assert status == {"ok": "verified", "gone": "problem", "other": "problem", "pre": "verified", "nopre": "problem", "seek": "verified", "never": "not_found", "down": "unverifiable", "old": "verified"}
    assert {r.key: r.matched.doi for r in v.collect() if r.matched}["seek"] == "10.1000/1998"
    assert sorted(r.category for r in R.reference_findings(v).collect()) == ["reference_arxiv_unresolved", "reference_doi_mismatch", "reference_doi_unresolved", "reference_not_found"]
    listed = "Text [1].\nReferences\n[1] Marsh AB, Reed C. The slow growth of coastal dunes under wind. J Dunes. 2001;3(2):1-9. doi:10.1000/abc.\n[2] Hill, D. (2003). A book on the tides of the sea. Press.\n[3] \"A title that stands in quotes\", by E. Moor, 1999.\n"
    es = E.read_entries(listed, "")
    assert [x["title"] for x in es] == ["The slow growth of coastal dunes under wind", "A book on the tides of the sea", "A title that stands in quotes"]
    assert [x["year"] for x in es] == ["2001", "2003", "1999"] and es[0]["doi"] == "10.1000/abc"


def test_review(spark):
    from veriloom.plans import registry, report

    text = "\\begin{document}Of the plants, 30/120 (27\\%) died. We use profound learning.\\end{document}"
    docs = spark.createDataFrame([(1, text, "", "en")], "doc_id long, text string, bib string, language string")
    found = report.check_corpus(docs)
    edits = spark.createDataFrame([(1, "S1", "fix", "Print 25%."), (1, "S1", "source", "forged")], "doc_id long, id string, field string, value string")
    gone = spark.createDataFrame([(1, "S2", "a quote")], "doc_id long, id string, reason string")
    none = spark.createDataFrame([(1, 1, "Causal wording", None, None, "first", None, "X causes Y", None, None, None, None)], "doc_id long, n int, title string, group string, severity string, order string, where string, quote string, evidence string, calculation string, fix string, context string")
    kept, aside = report.reviewed(found, edits, gone, none)
    rows = {r.id: r for r in kept.collect()}
    assert set(rows) == {"S1", "R1"} and rows["S1"].fix == "Print 25%." and rows["S1"].source == "script" and rows["R1"].group == "claims"
    assert [(r.id, r.reason) for r in aside.collect()] == [("S2", "a quote")]
    assert registry.QUERIES


def test_corrections(spark):
    from veriloom.operators.corrections import by_check, caught, corrected_numbers

    v = spark.createDataFrame([(1, "a rate of 0.51 (from 0.40) over time", "a rate of 0.53 (from 0.40) over all time"), (2, None, "x")], "doc_id long, old string, new string")
    c = corrected_numbers(v)
    assert [(r.doc_id, r.old, r.new) for r in c.collect()] == [(1, "0.51", "0.53")]
    f = spark.createDataFrame([(1, "grim", "gives 0.51 there", ["7"]), (1, "grim", "gives 10.51", ["1"])], "doc_id long, check string, evidence string, numbers array<string>")
    assert caught(c, f).count() == 1 and caught(c, f.where("evidence like '%10.51%'")).count() == 0 and by_check(f).first().n == 2


def test_streaming(spark, tmp_path):
    from veriloom.streaming.drop_folder import arriving, check_arrivals

    (tmp_path / "in").mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for i, p in enumerate(("25", "27")):
        (tmp_path / "in" / f"{i}.tex").write_text(f"\\begin{{document}}Of the plants, 30/120 ({p}\\%) died.\\end{{document}}")
        check_arrivals(arriving(spark, str(tmp_path / "in")), out, mark).awaitTermination()
    assert [r.category for r in spark.read.parquet(out).collect()] == ["percent_count_mismatch"]


def test_text_functions(spark):
    from veriloom.functions import numbers as N
    from veriloom.functions import text as T

    df = spark.createDataFrame([("ab12 cd3. E é4",)], "t string")
    spots = df.select(T.found(F.col("t"), r"[a-zé]*(\d+)", ("n",)).alias("f")).first().f
    assert [(s.start, s.end, s.n) for s in spots] == [(0, 4, "12"), (5, 8, "3"), (12, 14, "4")]
    tokens = spark.createDataFrame([("0.850",), ("60.0",), ("1,024",), ("x ",), ("-0.0030",)], "t string")
    assert [r[0] for r in tokens.select(N.canonical(F.col("t"))).collect()] == ["0.85", "60", "1,024", "x", "-0.003"]
    sizes = spark.createDataFrame([("~2.5K",), ("1,200",), ("3M",), ("?",)], "t string")
    assert [r[0] for r in sizes.select(N.with_suffix(F.col("t"))).collect()] == [2500.0, 1200.0, 3e6, None]
    full = spark.createDataFrame([("１２％，Ａ（x）",)], "t string")
    assert full.select(T.normalize(F.col("t"))).first()[0] == "12\\%, Ａ(x)"
    assert spark.range(1).select(T.escape_percent(F.lit("5% and 6\\%"))).first()[0] == "5\\% and 6\\%"


def test_registry_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{d}/{t}'")
    mine = [n for n in sql if not n.startswith("op")]
    assert len(mine) > 40 and __spark_entry__.entry(spark).count() > 0
    for name in mine:
        a, b = queries[name](spark, d).toPandas(), con.execute(sql[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        tidy = lambda x: x[cols].map(lambda v: round(v, 9) if isinstance(v, float) else v).astype(str).sort_values(cols).reset_index(drop=True)  # noqa: B023, E731
        assert tidy(a).equals(tidy(b)), name


def test_works_without_corpus_operators():
    code = "import sys; sys.modules['veriloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_reference_items(spark):
    from veriloom.operators import entries as E
    from veriloom.operators import references as R

    text = "We begin. Dunes grow [1, 3-4]. Then [2] says more.\n\nLast [1].\nReferences\n" + "".join(f"[{i}] Writer {i}. A title of work number {i} here. Journal. 2001.\n" for i in range(1, 6))
    docs = spark.createDataFrame([(1, text, "")], "doc_id long, text string, bib string")
    refs = R.entries(docs)
    cited = {r.n: r.cited_in for r in R.citing_sentences(docs, refs).collect()}
    assert cited[0][:2] == ["Dunes grow [1, 3-4].", "Last [1]."] or cited[0][0] == "Dunes grow [1, 3-4]."
    assert cited[3][0] == "Dunes grow [1, 3-4]." and cited[1][0].startswith("Then [2] says more.")
    tex = spark.createDataFrame([(2, "Sand moves \\citep{ka, kb} far. \\begin{document}", "@article{ka, title={T}}\n@article{kb, title={U}}")], docs.schema)
    keyed = R.citing_sentences(tex, R.entries(tex)).collect()
    assert len(keyed) == 2 and all(r.cited_in == ["Sand moves \\citep{ka, kb} far."] for r in keyed)
    lookups = spark.createDataFrame([("u", json.dumps({"results": [{"doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"Sand": [0, 2], "and": [1]}}]}))], "url string, body string")
    assert R.abstracts(lookups).first().abstract == "Sand and Sand"
    items = R.reference_items(docs, R.verdicts(refs, lookups), lookups)
    assert items.count() == 5 and {r.status for r in items.collect()} == {"unverifiable"}


def test_server():
    from veriloom import serve

    said = []
    serve.serve(['{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}\n', "\n", '{"jsonrpc": "2.0", "method": "notifications/initialized"}\n', '{"jsonrpc": "2.0", "id": 2, "method": "tools/list"}', '{"jsonrpc": "2.0", "id": 3, "method": "nothing"}', "{", '{"jsonrpc": "2.0", "id": 4, "method": "ping"}', '{"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "check_folder", "arguments": {}}}'], said.append)
    replies = [json.loads(x) for x in said]
    assert replies[0]["result"]["serverInfo"]["name"] == "veriloom" and {t["name"] for t in replies[1]["result"]["tools"]} == {"check_folder", "render_report"}
    assert replies[2]["error"]["code"] == -32601 and replies[3]["error"]["code"] == -32700 and replies[4]["result"] == {} and replies[5]["result"]["isError"]
    assert len(replies) == 6


def test_command_line(spark, folder, tmp_path):
    from veriloom import __main__ as command
    from veriloom.plans import report

    out = str(tmp_path / "out")
    assert command.main([folder, "--out", out]) == 3  # one file cannot be read
    assert command.main(["render", out]) == 0
    pages = spark.read.parquet(out + "/reports").collect()
    assert len(pages) == 6 and all(p.html.startswith("<!doctype html>") for p in pages)
    one = spark.read.parquet(out + "/results").where(F.col("result").contains("plain.txt")).first().result
    assert "product" in report.as_text(one).lower() or "S1" in report.as_text(one)


def test_review_on_the_command_line(spark, tmp_path, capsys):
    """JSON on standard output, the exit policy, and a review that changes, dismisses and adds."""
    from veriloom import __main__ as command

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Results\n\nOf the plants, 30/120 (27%) died. We use profound learning.\n")
    out = str(tmp_path / "out")
    assert command.main([str(tmp_path / "in"), "--out", out, "--json"]) == 1
    said = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [f["category"] for f in said[0]["findings"]] == ["percent_count_mismatch", "tortured_phrase"] and said[0]["counts"] == {"first": 1, "major": 0, "minor": 1}
    review = {"path": "a.md/a.md", "summary": "One number is wrong.", "guideline": "STROBE", "items": [{"item": "Setting", "status": "missing", "where": "Methods", "note": "n"}], "edits": [{"id": "S1", "field": "fix", "value": "Print 25%."}], "dismissed": [{"id": "S2", "reason": "a quote"}], "added": [{"title": "Causal <words>", "group": "claims", "severity": "major", "order": "second", "quote": "X"}]}
    (tmp_path / "review.json").write_text(json.dumps(review) + "\n")
    assert command.main(["render", out, "--review", str(tmp_path / "review.json")]) == 0
    page = spark.read.parquet(out + "/reports").first()
    assert "Print 25%." in page.markdown and "One number is wrong." in page.markdown and "a quote" in page.markdown and "STROBE" in page.markdown
    assert "Causal &lt;words&gt;" in page.html and "<nav>" in page.html and "R1" in page.html and "<details>" in page.html


def test_one_reading_for_all_checks(spark, tmp_path):
    """All checks together: the manuscripts are scanned once, for the relation that is kept."""
    from veriloom.plans import report

    rows = [(i, f"\\begin{{document}}Of the plants, {i}/120 (27\\%) died. We use profound learning.\\end{{document}}", "", "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, bib string, language string").write.parquet(str(tmp_path / "docs"))
    out = report.check_corpus(spark.read.parquet(str(tmp_path / "docs")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    held = plan[plan.index("InMemoryRelation") :]
    assert plan.count("FileScan") <= held.count("FileScan")  # every scan of files stands under the relation that is kept
    once = out.prepared._jdf.queryExecution().executedPlan().toString()
    assert once.count("FileScan") <= 2 and "hashpartitioning(doc_id" in once
    assert {r.category for r in out.collect()} >= {"percent_count_mismatch", "tortured_phrase"}
    out.prepared.unpersist()


def test_references_beyond_the_limit(spark):
    from veriloom.operators import references as R
    from veriloom.plans import report

    bib = "".join(f"@article{{k{i}, title={{A work of some length number {i}}}, year={{2001}}}}\n" for i in range(203))
    docs = spark.createDataFrame([(1, "x", bib)], "doc_id long, text string, bib string")
    lookups = spark.createDataFrame([("u", "{}")], "url string, body string")
    gaps = {r.item: r.reason for r in report.not_verified(docs, None, R.verdicts(R.entries(docs), lookups)).collect()}
    assert gaps["References beyond the first 200"] == "3 references were not looked up"


def test_all_references_are_judged(spark):
    """Long lists: every reference with a lookup gets its verdict and findings; only those without one count as not looked up."""
    from veriloom.operators import references as R
    from veriloom.plans import report

    bib = "".join(f"@article{{k{i}, title={{A work of some length number {i}}}, year={{2001}}, eprint={{2101.{i:05d}}}, archiveprefix={{arXiv}}}}\n" for i in range(450))
    docs = spark.createDataFrame([(1, "x", bib), (2, "x", bib[: bib.index("@article{k190")])], "doc_id long, text string, bib string")
    told = lambda i: "Error" if i % 3 == 1 else f"A work of some length number {i}" if i % 3 == 0 else "Matters of birdsong"
    lookups = spark.createDataFrame([(f"{R.ARXIV}2101.{i:05d}", json.dumps({"_text": f"<title>q</title><title>{told(i)}</title>"})) for i in range(440)], "url string, body string")
    v = R.verdicts(R.entries(docs), lookups).cache()
    found = sorted((r.doc_id, r.seq // 10, r.category) for r in R.reference_findings(v).collect())
    kind = {1: "reference_arxiv_unresolved", 2: "reference_arxiv_mismatch"}
    assert found == [(d, i, kind[i % 3]) for d, n in ((1, 440), (2, 190)) for i in range(n) if i % 3]
    gaps = sorted((r.doc_id, r.item, r.reason) for r in report.not_verified(docs, None, v).collect() if r.item != "Code and data")
    assert gaps == sorted([(1, f"Reference k{i}", "lookup failed") for i in range(440, 450)] + [(1, "References beyond the first 200", "10 references were not looked up")])


def test_lists_beyond_three_digits():
    """Numbers of four digits begin entries where they go on from the list; a year at a line's beginning does not."""
    from veriloom.operators import entries as E

    for form in ("[{}] ", "{}. "):
        lines = [form.format(i) + f"Marsh AB, Reed C. The slow growth of dune number {i}. Heft.\n2001. Sand and wind.\n" for i in range(1, 1021) if i not in (5, 1003)]
        es = E.read_entries("Known.\nReferences\n" + "".join(lines), "")
        numbers = [i for i in range(1, 1021) if i not in (5, 1003)]
        assert [e["label"] for e in es] == [f"[{i}]" for i in numbers] and [e["n"] for e in es] == list(range(len(numbers)))
        assert [e["title"] for e in es] == [f"The slow growth of dune number {i}" for i in numbers]
