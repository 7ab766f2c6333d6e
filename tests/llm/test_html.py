import time
from collections import Counter

from pyspark.sql import functions as F

from sparkveil.llm import html
from sparkveil.llm import html as h


def text(source):
    page = h.Page(source)
    return page.text(page.removed())


def test_article_is_kept_and_the_rest_goes():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div class="cookie-notice">Cookies</div><article><h1>Head &amp; tail</h1><p><b>One
      two<br>three &#233;<p>Four <script>x</script>five<ul><li>a<li>b &lt;x&gt;</ul><aside>side</aside><form>f</form>
    <p title="a > b">six</p></article><section id="comments"><p>I say</p></section><footer>&copy; all</footer>"""
    assert text(source) == "Head & tail\nOne two three é\nFour five\na\nb <x>\nsix"


def test_odd_pages():
    assert text("") == "" and text("just text &amp; more") == "just text & more"
    assert text("<p>a<p>b</div></p></b>c") == "a\nb\nc"
    assert text("<main><p>m</p></main><p>out") == "m"
    assert text("<p>a < b and c</p><p>unclosed <b") .startswith("a < b and c")
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<body><table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text("<article>x<article class=comment>c</article>y</article>") == "x\ny"


def rows(n):
    page = "<body><div class=box><p>Follow us everywhere</p></div><div><p>Text {0} of page {0}, long enough to be content</p><p>shared line</p></div><section>All rights</section></body>"
    own = [(i, f"http://Host.example/{i}", page.format(i), "x") for i in range(n)]
    quoted = [(500 + i, f"http://b.example/{i}", f"<article><p>Quoted often</p><p>Own {i} text</p></article>", "x") for i in range(20)]
    copies = [(600 + i, "http://c.example/same", "<body><div>The same long page</div></body>", "x") for i in range(20)]
    return own + quoted + copies + [(None, None, None, "x"), (901, "", "", "x"), (902, "nonsense", "<p>lone", "x"), (902, "nonsense", "<p>lone", "x")]


def test_templates_of_a_host_go_and_content_stays(spark):
    df = spark.createDataFrame(rows(30), "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in h.main_text(df).collect()}
    joined = {r.page_id: r for r in h.main_text(df, broadcast_rows=0).collect()}
    assert got == joined and h.main_text(df).count() == df.count()
    assert got[3].text == "Text 3 of page 3, long enough to be content" and got[3].n_chars == len(got[3].text)
    assert got[505].text == "Quoted often\nOwn 5 text"
    assert got[605].text == "The same long page"
    assert (got[None].text, got[901].text, got[902].text) == ("", "", "lone")
    assert h.main_text(df.limit(0)).collect() == []


def test_templates_of_a_hot_host_and_on_short_pages(spark):
    box = "<div class=box><p>Only this section carries the box</p></div>"
    page = "<body>{1}<div><p>Text {0} of page {0}, long enough to be more than a half</p></div></body>"
    hot = [(i, "http://hot.example/", page.format(i, box if i % 20 == 0 else "")) for i in range(400)]
    hot.append((400, "http://hot.example/", f"<body>{box}<div><p>Short</p></div></body>"))
    content = [(1000 + i, "http://d.example/", f"<body><div><p>The same story on most pages of this host</p></div><div><p>{i}</p></div></body>") for i in range(20)]
    df = spark.createDataFrame(hot + content, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert got == {r.page_id: r.text for r in h.main_text(df, broadcast_rows=0).collect()}
    assert got[20] == "Text 20 of page 20, long enough to be more than a half" and got[400] == "Short"
    assert got[1003] == "The same story on most pages of this host\n3"


def test_deep_nesting_is_read_in_one_pass():
    began = time.time()
    page = html.Page("<p>first<p>second" + "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<table><tr><td><p>" + "<div>" * 20_000 + "x")
    assert page.text(page.removed()) == "first\nsecond\ndeep\nx"
    assert time.time() - began < 5


def test_templates_are_what_recurs_and_equal_a_plain_count(spark):
    box = '<div class="q{0}"><p>{1}</p></div>'
    rows = []
    for i in range(40):
        own = f"<article><h1>Title {i}</h1><p>Own words of page {i}.</p><p>A line that many articles quote.</p></article>"
        extra = box.format(1, "Read our other site") if i < 12 else ""  # no telling name: only its recurrence gives it away
        rare = box.format(2, "A box on few pages") if i < 9 else ""
        rows.append((i, f"http://h{i % 1}.example/{i}", f"<body><div>{extra}{rare}<p>Loose text {i}</p></div>{own.replace('article', 'section')}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = Counter(h for r in rows for h in {h for _, h, _ in html.Page(r[2]).subtrees()})
    counts = {r["hash"] for r in html.host_templates(df.select(F.lit(1).cast("long").alias("host"), "html")).collect()}
    assert counts == {h for h, n in seen.items() if n >= html.LEAST_PAGES} and counts
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    for i, text in got.items():
        want = ([] if i >= 9 else ["A box on few pages"]) + [f"Loose text {i}", f"Title {i}", f"Own words of page {i}."]
        assert text.split("\n") == want
    assert got == {r.page_id: r.text for r in html.main_text(df, broadcast_rows=0).collect()}


def test_templates_are_deleted_from_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = html.host_templates(pages.select(html._host(F.col("url")).alias("host"), "html"))
    assert found.count() > 0
