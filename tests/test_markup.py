import random
import time

from hearsay.functions import markup as M
from tests.test_text import nodes


def texts(html):
    return M.Tree(html).texts


def test_text_nodes_equal_the_standard_parser_on_whole_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rng = random.Random(3)
    parts = ["<div>", "</div>", "<p>", "</p>", "<b class=x>", "</b>", "<br/>", "<img src='a>b'>",
             "text ", "&amp;", "&#20013;", "<!-- c > <b> -->", "<script>a<b</script>", "\n", "é"]
    pages += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    for html in pages:
        assert texts(html) == nodes(html)


def test_elements_hold_what_is_inside():
    tree = M.Tree("<ul><li>a<li>b <i>c</i></ul><p>d<div>e</div>f</p></b>")
    found = {(e.tag, tree.text(i)) for i, e in enumerate(tree.elements)}
    assert found == {("ul", "ab" + "c"), ("li", "a"), ("li", "bc"), ("i", "c"), ("p", "d"),
                     ("div", "e")}


def test_links_keep_nested_titles():
    assert M.anchors("<a href='/p/1'><img src=x><b>o<i>n</i>e</b> </a><a>no</a><a href>e</a>") == [
        {"href": "/p/1", "title": "one"}, {"href": "", "title": "e"}]
    assert M.anchors(None) == M.anchors("") == M.anchors("<a href='/p/1") == []


def test_hits():
    page = """<div class="s_post"><a href="/p/1"><img></a><div class="p_title"><p><a href="/p/2">
      <b>Two</b> &amp; <span>more</span></a></p></div><div class="p_content">a <div>b</div> c</div>
      </div><div class="s_post"><a href="/p/2">again</a></div><div class="s_post"><a href="/q"></a>
      <div class="s_post"><a href="https://x/p/3">three</a><a href="/f?kw=k">K</a></div></div>"""
    got = M.search_hits(page)
    assert [(h["tid"], h["title"], h["excerpt"], h["forum_name"]) for h in got] == [
        ("2", "Two&more", "a b c", ""), ("3", "three", "", "K")]
    assert [h["tid"] for h in M.search_hits("<a href='/p/5'>x</a><a href='y/p/6'>z</a>")] == ["5"]
    assert M.search_hits(None) == []


def test_hostile_pages_are_linear():
    n = 50_000
    start = time.time()
    for html in ["x<!--" * n, "<a" * n, "<a href='" * n + ">", "<b>" * n, "<b></i>" * n, "<" * n,
                 "<div class='s_post'>" * n, "<?x" * n, "<script>" * n, "<a = " * n + ">",
                 "<p><li>" * n, "<!-->" * n]:
        M.search_hits(html)
    assert time.time() - start < 30
