"""Pages to blocks: what is content, in what order, under which headings."""

import re

import pytest
from pyspark.sql import functions as F

from loomwork.operators import html_blocks as B


def read(html):
    return [(b.kind, b.path, b.body) for b in B.read_blocks(html)[0]]


@pytest.mark.parametrize("html, want", [
    ("<h1>A</h1><p>x</p><h2>B <b>c</b></h2><p>y<br>z</p><h2>D</h2><p>w</p><h1>E</h1>", [("heading", "A", "A"), ("paragraph", "A", "x"), ("heading", "A / B c", "B c"), ("paragraph", "A / B c", "y\nz"), ("heading", "A / D", "D"), ("paragraph", "A / D", "w"), ("heading", "E", "E")]),
    ("<p>one<p>two<div>out</div><p>three", [("paragraph", "", "one"), ("paragraph", "", "two"), ("paragraph", "", "three")]),
    ("<ul><li>a<li>b <i>c</i><ol><li>d<li>e</ol><li>f</ul>", [("list", "", "- a\n- b c\n  1. d\n  2. e\n- f")]), ("<ol><li><p>a</p></li><li></li><li>b</li></ol>", [("ordered_list", "", "1. a\n3. b")]),
    ('<pre class="x language-py">\nif a:\n    b  &lt; c\n</pre>', [("code", "", "```py\nif a:\n    b  < c\n```")]), ("<p>use <code>f(x)</code> now</p><pre><code>g\n\n h</code></pre>", [("paragraph", "", "use f(x) now"), ("code", "", "```\ng\n\n h\n```")]),
    ("<table><tr><th>a<th>b|c<tr><td colspan=2>wide<tr><td rowspan='2'>tall</td><td>1</td></tr><tr><td>2</td></tr></table>", [("table", "", "| a | b\\|c |\n| --- | --- |\n| wide | wide |\n| tall | 1 |\n| tall | 2 |")]),
    ("<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>", [("table", "", "| xiny | z |\n| --- | --- |")]),
    ("<nav><p>n</p></nav><div class='site-menu big'><p>m</p></div><div id=Cookie_bar><p>c</p><img></div><div role=search><p>s</p></div><p class=menus>kept</p><div aria-label='Share this'><h1>t</h1></div>", [("paragraph", "", "kept")]),
    ("<p>a</p><form><p>mail</p><input type=PASSWORD><ul><li>q</ul></form><form><p>b</p><input type=text></form>", [("paragraph", "", "a"), ("paragraph", "", "b")]),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><template><p>t</p></template><!-- <p>c</p> --><p>&eacute;&amp;&lt; &#65;\0</p>", [("paragraph", "", "é&< A")]),
    ("<div>only <b>text</b><br>here</div><script>x</script>", [("visible_text", "", "only\ntext\nhere")]), ("", []), ("<p> </p><ul><li> </ul><table></table><pre></pre>", []), ("no tags", [("visible_text", "", "no tags")]), ("</p></div><p>x</span></p></table>", [("paragraph", "", "x")]),
    ("<body class=login><main id=search><h1>A</h1></main></body>", [("heading", "A", "A")]), ("<h3>deep</h3><p>x</p><h1>top</h1>", [("heading", "deep", "deep"), ("paragraph", "deep", "x"), ("heading", "top", "top")]),
])
def test_blocks(html, want):
    assert read(html) == want


def test_left_out_parts_are_counted():
    assert B.read_blocks("<head><title>t</title></head><nav>a</nav><div class=promo>b<nav>c</nav></div><form><input type=password></form><p>x</p>")[1] == 3


def test_wide_spans_and_deep_nesting_end():
    assert len(read('<table><tr><td colspan="99999999">a</td></tr></table>')[0][2]) < 20_000
    assert read("<div>" * 3000 + "<p>x</p>")[-1][2] == "x"


def test_all_pages_by_cutting_tags(spark, small):
    """Every word of a page's article is in its blocks, in order."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {}
    for r in B.html_blocks(spark.read.parquet(f"{small}/pages.parquet"), "page_id", "html").orderBy("page_id", "block").collect():
        got.setdefault(r["page_id"], []).extend(r["body"].split())
    import html as h

    assert got == {i: h.unescape(re.sub("<[^>]*>", " ", re.search("(?s)<article>(.*?)(?:</article>|<footer>|$)", t)[1])).split() for i, t in pages.items()}


def test_documents_and_odd_rows(spark):
    rows = [(1, "<h1>A</h1><p>b c</p><h2>D</h2><ul><li>e</ul><pre>f</pre><table><tr><td>g</table>"), (2, None), (3, ""), (None, "<p>x</p>"), (4, "<p>" + "word " * 200_000), (5, "text")]
    blocks = B.html_blocks(spark.createDataFrame([(*r, "k", 1) for r in rows], "id long, h string, kind string, block int"), "id", "h")
    got = {r["id"]: r for r in B.documents(blocks, "id").collect()}
    assert set(got) == {1, None, 4, 5}
    one = got[1]
    assert one["markdown"] == "# A\n\nb c\n\n## D\n\n- e\n\n```\nf\n```\n\n| g |\n| --- |" and [(o["level"], o["section_path"]) for o in one["outline"]] == [(1, "A"), (2, "A / D")]
    assert tuple(one[c] for c in ("n_headings", "n_paragraphs", "n_lists", "n_tables", "n_code")) == (2, 1, 1, 1, 1) and got[4]["n_words"] == 200_000 and got[5]["markdown"] == "text"
    assert B.html_blocks(blocks.select(F.col("id"), F.lit(None).cast("string").alias("h")), "id", "h").count() == 0


def test_sql_reads_references_without_semicolon(spark, tmp_path):
    """A heading that was cut inside a reference: the SQL of both queries of pages decodes it as HTML does."""
    import duckdb

    from loomwork.plans import catalogue

    html = ["a &amp;&amp", "&quot;b&quot", "c &am", "d &amp;quot; &ampe"]
    rows = [(i, f"<!DOCTYPE html><html><head><title>{h}</title></head><body><article><h1>{h}</h1><p>x &amp; {h}</p></article></body></html>") for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_documents", "html_blocks"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalogue.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
