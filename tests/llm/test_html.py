from tallyglass.llm.html_layout import render, visible_text

CASES = [
    ("", ""),
    (None, ""),
    ("plain &amp; text  here", "plain & text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<head><title>t</title></head><body>x<script>y()</script></body>", "x"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a<br>b", "a\nb"),
    ("x < y and z", "x < y and z"),
    ("<b>un<i>closed", "unclosed"),
    ("</p></div>stray", "stray"),
    ("<!-- c --><p>k<!-- d -->m</p>", "km"),
    ("<h1>T</h1><p>P</p><hr><blockquote>q</blockquote>", "T\n\nP\n\n---\n\n  q"),
    ("<script>var t='</p>'</script>after", "after"),
]


def test_cases():
    for source, expected in CASES:
        assert render(source)[0] == expected, source


def test_all_visible_words_survive(spark, sf):
    """Every word of the pages' visible text nodes, in order, read by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("head", "script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.replace("|", " ").split()

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in visible_text(pages).collect():
        reader = Reader()
        reader.feed(source[r.page_id])
        words = [w for w in r.text.replace("|", " ").split() if w not in ("-", "---")]
        assert "".join(words) == "".join(w for w in reader.words if w not in ("-", "---")), r.page_id


def test_counts_of_the_given_pages(spark, sf):
    """Items, rows of tables and lines, counted in the source by patterns and in the text line by line."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    full = lambda body: bool(re.sub(r"<[^>]*>|\s", "", body))
    for r in visible_text(pages).collect():
        html = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", "", source[r.page_id])
        shown = [x for x in r.text.split("\n") if x.strip()]
        assert r.n_chars == len(r.text)
        assert r.n_lines == len(shown), r.page_id
        assert r.n_items == sum(map(full, re.findall(r"(?s)<li\b[^>]*>(.*?)(?=<li\b|</[uo]l>)", html))), r.page_id
        assert r.n_rows == sum(map(full, re.findall(r"(?s)<tr\b[^>]*>(.*?)(?=<tr\b|</table>)", html))), r.page_id


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "<div>" * 5000 + "deep", "x"), (None, "<p>a", "x")]
    out = visible_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert sorted(r.text for r in out.collect()) == ["", "", "", "a", "deep"]
    assert visible_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
