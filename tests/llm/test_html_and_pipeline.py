"""Rendered pages, the pipeline, and what the driver sees."""

import json
import os
import subprocess
import sys

import random

import corpus_pipeline
import pytest
from conftest import prose

import __spark_entry__
from flowsentry.llm.html_text import extract, render

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PAGES = [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b  c<br>d", "a\n\nb c\nd"),
    ("<ul><li>x<li>y<ol start=3><li>in<li>more</ol><li>z</ul>tail", "- x\n- y\n  3. in\n  4. more\n- z\n\ntail"),
    ("<table><caption>T</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>sum</table>after",
     "T\nName  | Qty\napple | 3\nsum\n\nafter"),
    ("x<span style='visibility:hidden'>h<b style='visibility: visible'>v</b></span>y<i hidden>no</i>"
     "<div style='Display : none'>no</div><p aria-hidden=true>no", "xvy"),
    ("<head><title>t</title><style>p{}</style></head><script>if(a<b){'</p>'}</script>seen<!-- no --><noscript>no</noscript>", "seen"),
    ("<pre>  a\n    b\n\nc</pre>q", "  a\n    b\n\nc\n\nq"),
    ("</p></br>x</div>", "x"), ("a < b and <3", "a < b and <3"),
    ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"),
    ("<table>stray<tr><td>a<td><table><tr><td>i<td>j</table></table>", "stray\na | i | j"),
    ("<img alt='picture'> <input type=hidden value=no><input type=submit value=go>", "picture go"),
    ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"), ("<p", ""),
]


def test_pages_of_any_depth_keep_their_visibility():
    deep = "<div>" * 20_000
    page = f"{deep}in<script>alert(1)</script><div style='display:none'>hid</div><p>end" + "</div>" * 20_000 + "out"
    assert render(page) == "in\n\nend\n\nout"
    assert render("<table><tr><td>" * 300 + "x" + "</td></tr></table>" * 300) == "x"


def test_wide_tables_are_aligned_by_wrapping():
    words = " ".join(f"word{i}" for i in range(60))
    got = render(f"<table><tr><td>a<td>{words}<td>z<tr><td>longer<td>b<td>y</table>").split("\n")
    assert " ".join(" ".join(line.split("|")[1].split()) for line in got[:-1]) == words
    assert {line.index("|") for line in got} == {7} and all(len(line) <= 60 for line in got)
    assert got[0].startswith("a      | word0") and got[0].endswith("| z") and got[-1].startswith("longer | b ")
    link = "http://a.org/" + "x" * 300
    assert link in render(f"<table><tr><td>{link}<td>b<tr><td>c<td>d</table>")


def test_cells_that_span_rows_keep_their_column():
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a | b\n  | c\nd | e"
    assert render("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == (
        "a | b | c\nd |   | e\nf |   | g")


def test_bars_and_text_inputs_are_text():
    assert render("<table><tr><td>|<tr><td>x</table>") == "|\nx"
    assert render("<input type=search value=s><input type=email value=e><input type=password value=p><input value=t>") == "set"


@pytest.mark.parametrize("page,text", PAGES)
def test_render(page, text):
    assert render(page) == text


def test_deep_and_long_pages_keep_their_text():
    assert "deep" in render("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert render("<b>" * 3000 + "x" + "<table><tr><td>" * 500 + "y").split() == ["x", "y"]
    assert len(render("<p>word " * 20_000).split()) == 20_000


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (None, None, "u"), (1, "<p>a", "u"), (3, "", "u")],
                               "page_id long, html string, text string")
    assert sorted(map(str, extract(df).collect())) == sorted(map(str, [
        extract(df).collect()[0].__class__(page_id=i, text=t) for i, t in ((1, "a"), (None, ""), (1, "a"), (3, ""))]))
    assert extract(df.limit(0)).count() == 0


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(11)
    good = [(i, prose(rng, rng.randint(60, 200))) for i in range(80)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for i in range(40)]
    items = [(i, prose(rng, 30) + ". " + prose(rng, 8) + f" end{i}.") for i in range(8)]
    leaks = [(200 + i, prose(rng, 60) + " " + items[i][1] + " " + prose(rng, 60)) for i in range(4)]
    copies = [(300 + i, good[i][1] + " ") for i in range(10)] + [(320 + i, good[i][1].upper().lower()) for i in range(3)]
    rows = good + bad + leaks + copies + [(400, None)]
    out = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    got = corpus_pipeline.run(spark, out).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {i for i, _ in bad} and not ids & {i for i, _ in leaks}
    for i in range(10):  # of equal texts the longest stays, then near copies leave the smallest id
        assert len(ids & {i, 300 + i, 320 + i}) == 1
    assert {i for i, _ in good[10:]} <= ids
    assert all(r.n_tokens == len(r.ids) for r in got)
    docs = spark.read.parquet(f"{out}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, out).columns == docs.columns, name
        assert stage(spark, docs.limit(0), out).count() == 0


def test_entry_loads_without_a_session_and_without_the_subpackage():
    names = json.loads(subprocess.run([sys.executable, "-c", (
        "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))")],
        cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    blocked = ("import sys\nclass No:\n def find_spec(self, name, path=None, target=None):\n"
               "  if name.startswith(('flowsentry.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
               "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nprint(any(x.startswith('op') for x in e.queries()))")
    assert subprocess.run([sys.executable, "-c", blocked], cwd=ROOT, capture_output=True, text=True,
                          check=True).stdout.strip() == "False"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op11_conversation_repair", "op13_warc"])
def test_queries_equal_their_sql(spark, name):
    from compare import compare, duck

    folder = "/root/testdata/sf0.001"
    assert compare(__spark_entry__.queries()[name](spark, folder), duck(folder),
                   __spark_entry__.oracle_sql()[name]) is None
