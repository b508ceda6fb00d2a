import pytest
from pyspark.sql import functions as F

from sightings.llm import html_extract as hx
from tests.llm.util import by_id

SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("a < b and c > d", "a < b and c > d"),
    ("<p>Hi <b>x</b> y<br>z</p>tail", "Hi x y z\ntail"),
    ("<p><b>One<br><p>Two\n  more</p>", "One\nTwo more"),
    ("<title>t</title><style>p{}</style><script>var t=\"</p>\";</script><p>x&nbsp;&#233;&middot;</p>", "x é·"),
    ("<nav>n<p>k</p></nav><header><h1>site</h1></header><main><header><h1>T</h1></header><p>a<p>b<aside>no</aside>"
     "<ul><li>1<li>2</ul><section id='comments'><p>bad</p></section></main><footer>f</footer>", "T\na\nb\n1\n2"),
    ("<article><p>one<div class=\"ad box\">x</div>two</p><form>f<input></form><div role=alert>r</div></article>"
     "<article class='comment'>c</article><div>outside</div>", "one\ntwo"),
    ("<div class='cookie-notice'>c</div><div id='sidebar'>s</div><!-- no --><div>yes</div><div hidden>h</div>", "yes"),
    ("<article><h1>x</h1><table><tr><td>c1</td><td>c2</td></tr></table></article", "x\nc1\nc2"),
])
def test_main_text(source, want):
    assert hx.main_text(source) == want


def page(k, words):
    return (f"<html><head><title>t{k}</title></head><body><div class='top'><span>Site name</span></div><div class='body'><p>text {words} {k}</p>"
            f"<p>second {k * 7}</p></div><div class='end'>All rights reserved</div></body></html>")


def table(spark):
    rows = [(k, f"http://Host.example/{k}", page(k, "alpha")) for k in range(12)]
    rows += [(100 + k, "http://host.example/copy", page(3, "alpha")) for k in range(30)]  # copies count once
    rows += [(200, "http://other.example/", page(5, "beta")), (201, None, None), (202, "nonsense", ""), (None, "http://host.example/", page(77, "x"))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_template_words_are_left_out_and_slots_kept(spark):
    rows, df = table(spark)
    got = {r.page_id: r for r in hx.op5(df.withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    for p, url, source in rows:
        r = got[p]
        assert r.url == url and r.n_chars == len(r.text)
        if source and url and "host.example" in url.lower():
            k = 77 if p is None else 3 if p >= 100 else p
            assert r.text == f"text {'x' if p is None else 'alpha'} {k}\nsecond {k * 7}"
    assert got[200].text == "Site name\ntext beta 5\nsecond 35\nAll rights reserved"  # too few pages for a template
    assert got[201].text == got[202].text == ""


def test_classes_group_equal_vectors_and_nest(spark):
    _, df = table(spark)
    pages = df.withColumn("host", hx.host_of(F.col("url")))
    got = {r.host: r.classes for r in hx.templates(pages).collect()}
    classes = got["host.example"]
    assert "other.example" not in got or not got["other.example"]
    words = [w.path for c in classes for w in c.words]
    assert sorted(words) == ["/html/body/div.end", "/html/body/div.top/span"]
    paths = {p for c in classes for p in c.paths}
    assert {"/html", "/html/body", "/html/body/div.body", "/html/body/div.body/p"} <= paths
    assert classes[0].path == "/html"


def test_articles_keep_text_that_the_host_repeats(spark):
    rows = [(k, "http://h/", f"<body><nav>menu</nav><article><h1>Title {k}</h1><p>Same line everywhere</p></article></body>") for k in range(20)]
    got = by_id(hx.op5(spark.createDataFrame(rows, SCHEMA)), "page_id")
    assert all(got[k]["text"] == f"Title {k}\nSame line everywhere" for k in range(20))


def test_boxes_of_the_template_within_articles_are_left_out(spark):
    rows = [(k, "http://h/", f"<body><main><div><article><h1>Title {k}</h1><div><p>Read our <b>terms</b> first</p><ul><li>Rules</ul></div><p>Same line"
             f"</p><div><p>Same too</p><p>own {k}</p></div><section/><p>body {k}</p></article></div></main></body>") for k in range(20)]
    got = by_id(hx.op5(spark.createDataFrame(rows, SCHEMA)), "page_id")
    assert all(got[k]["text"] == f"Title {k}\nSame line\nSame too\nown {k}\nbody {k}" for k in range(20))


def test_an_article_that_is_all_template_stays():
    source = "<div role=main><div>a</div><p>b</p></div>"
    constants = {(path, hx._name(what)) for kind, path, what, *_ in hx.walk(source) if kind == "text"}
    assert hx.main_text(source, constants) == "b"


def test_empty_table(spark):
    assert hx.op5(spark.createDataFrame([], SCHEMA)).count() == 0
