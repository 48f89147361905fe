import html
from html.parser import HTMLParser

from pyspark.sql import functions as F

from hearsay.functions import text as X

CASES = [
    "<p>a</p> <p>b &amp;&#20013;&#x4e2d; c</p>", "no tags &amp;", "a < b", None, "",
    "<div><script>x<b></script>hi<br/>there <!-- c < d --></div>", "<p>x</p><p> y </p>",
    "<style>p{}</style><b>1</b>2<i></i>3", "<p>&#0; &#9999999; &amp;lt; &nbsp;z</p>",
    "<script>never closed", "<a href='x>y'>l</a>",
]


class Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.open, self.hidden = [], False, 0

    def handle_starttag(self, tag, attrs):
        self.open = False
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.open = False
        self.hidden -= tag in ("script", "style")

    handle_startendtag = lambda self, tag, attrs: setattr(self, "open", False)

    def handle_comment(self, data):
        self.open = False

    def add(self, data):
        if self.hidden:
            return
        if self.open:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.open = True

    handle_data = add
    handle_entityref = lambda self, n: self.add(html.unescape(f"&{n};"))
    handle_charref = lambda self, n: self.add(html.unescape(f"&#{n};"))


def nodes(text):
    parser = Nodes()
    parser.feed(text)
    parser.close()
    return parser.nodes


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.withColumn("v", fn(F.col("t"))).orderBy("i").collect()]


def test_strip_html(spark):
    plain = column(spark, CASES, X.strip_html)
    assert plain[:7] == [
        "a   b &中中 c", "no tags &amp;", "a < b", "", "", "hi there ", "x  y "]
    assert plain[7] == "1 2 3"
    assert plain[8] == "&#0; &#9999999; &lt; \u00a0z"
    assert plain[9] == ""
    lines = column(spark, CASES, lambda t: X.strip_html(t, "\n", True))
    assert lines[5:8] == ["hi\nthere", "x\ny", "1\n2\n3"]
    assert column(spark, CASES, X.clean_text)[:2] == ["a b &中中 c", "no tags &amp;"]


def test_strip_html_equals_a_parser_on_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = pages.select("html", X.strip_html(F.col("html")).alias("a"),
                       X.strip_html(F.col("html"), "\n", True).alias("b")).collect()
    assert len(out) == 50
    for r in out:
        found = nodes(r.html)
        assert r.a == " ".join(found)
        assert r.b == "\n".join(n.strip() for n in found if n.strip())


def test_clauses(spark):
    assert column(spark, ["我喜欢，但不好！ok~好"], X.clauses) == [["我喜欢", "但不好", "ok", "好"]]


def test_max_match(spark):
    cut = X.max_match_tokenizer(spark, ["非常", "非常好", "喜欢"])
    assert column(spark, ["我非常好喜欢abc12非", None, ""], cut) == [
        ["我", "非常好", "喜欢", "abc12", "非"], None, []]
    try:
        X.max_match_tokenizer(spark, ["a", "b"], max_words=1)
    except ValueError:
        pass
    else:
        raise AssertionError("an oversized dictionary must be refused")


def test_adjacent_tags_comments_and_references(spark):
    import html

    many = "a" + "<b></i>" * 50_000 + "z"
    texts = [many, "<!-- " + "never closed " * 20_000, "<p>x</p>" + "<" * 50_000,
             "<i>&eacute;&notin;&frac12;&AMP;&amp;lt;&copy 1&unknown;&;&#x1F600;&#65 &</i>",
             "\u3000\u00a0lead<b>\u3000mid\u2003</b>\u3000"]
    plain = column(spark, texts, X.strip_html)
    assert plain[0] == "a z"
    assert plain[3] == html.unescape("&eacute;&notin;&frac12;&AMP;&amp;lt;&copy 1&unknown;&;"
                                     "&#x1F600;") + "&#65 &"
    tight = column(spark, texts, lambda c: X.strip_html(c, "", strip=True))
    assert tight[0] == "az" and tight[4] == "leadmid"
    assert column(spark, texts[:1], X.clean_text) == ["a z"]


def test_markup_that_never_closes_is_linear(spark):
    import re
    import time

    n = 100_000
    texts = ["x<!--" * n, "<a" * n, "<script" * n, "<b" * n + "<!-- > -->", "<!-- > " * n,
             "<!-->" * n, "</script  " * n, "<script>" * n + "</script " * n, "-->" * n + "<!--" * n,
             "<" * n, "a<b>-->c<!-- d <i>e", "<!-- a --><script>b --> c", "p<!-- q -> r <b>s"]
    start = time.time()
    plain = column(spark, texts, X.strip_html)
    column(spark, texts, X.clean_text)
    dropped = column(spark, texts, X.drop_tags)
    assert time.time() - start < 5 * 3
    # Without a closing mark nothing changes; the short ones equal the plain patterns.
    assert plain[0] == texts[0] and plain[1] == texts[1] and plain[2] == texts[2]
    assert plain[3] == "<b" * n and plain[9] == texts[9]
    assert plain[10:] == ["a -->c e", "", "p  r  s"]
    assert dropped[:3] == texts[:3] and dropped[9] == texts[9]
    assert dropped[10:] == [re.sub("<[^>]+>", "", t) for t in texts[10:]]


def paths(text, costs, unknown):
    """All ways to cut a text, as (total cost, sizes negated, words)."""
    if not text:
        return [(0, (), ())]
    out = []
    for n in range(1, len(text) + 1):
        cost = costs.get(text[:n], unknown if n == 1 else None)
        if cost is not None:
            out += [(cost + c, (-n, *s), (text[:n], *w)) for c, s, w in
                    paths(text[n:], costs, unknown)]
    return out


def test_best_path_equals_all_paths(spark):
    import random

    rng = random.Random(2)
    words = [("研究", 50), ("研究生", 20), ("生命", 60), ("命", 9), ("起源", 30), ("的", 500),
             ("生", 9), ("ab", 7), ("b1", 7), ("", 5), ("无", 0), ("命", 1)]
    table = spark.createDataFrame(words, "word string, n bigint")
    rows = X.word_costs(table).collect()
    costs, unknown = {r.word: r.cost for r in rows}, rows[0].unknown
    assert set(costs) == {w for w, _ in words} - {"", "无"}
    texts = ["".join(rng.choice("研究生命起源的ab1") for _ in range(rng.randrange(12)))
             for _ in range(60)]
    cut = X.best_path_tokenizer(spark, table, whole_runs=False)
    got = column(spark, texts, cut)
    assert got == [list(min(paths(t, costs, unknown))[2]) for t in texts]
    kept = column(spark, ["研究生命的起源", "研究ab12生命 c", None, "", "ab"],
                  X.best_path_tokenizer(spark, table))
    assert kept == [["研究", "生命", "的", "起源"], ["研究", "ab12", "生命", " ", "c"], None, [], ["ab"]]
    try:
        X.best_path_tokenizer(spark, table, max_words=3)
    except ValueError:
        pass
    else:
        raise AssertionError("an oversized dictionary must be refused")


def test_every_step_of_strip_html_is_computed_once(spark):
    df = spark.createDataFrame([("<p>a</p>",)], "t string")
    for strip in (False, True):
        out = df.select(X.strip_html(F.col("t"), "\n", strip).alias("v"))
        text = out._jdf.queryExecution().optimizedPlan().toString()
        # Three marks are looked for; written out as a tree, the same steps came up dozens of times.
        assert text.count("substring_index(") == 3
        assert text.count("(script|style|template)") == 1
        assert out.first().v == "a"


def test_references_are_read_once(spark):
    df = spark.createDataFrame([("<i>&lt;&#65;&AMP&x;</i>",)], "t string")
    out = df.select(X.strip_html(F.col("t")).alias("v"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 3
    assert out.first().v == "<A&&x;"
