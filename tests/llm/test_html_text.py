import html
import re

from buildproof.llm.html_text import Page, extract


def test_page_reads_blocks():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
    <nav><ul><li>Home</ul></nav><div class="ad">Buy</div><aside>side</aside><article><header><h1>Title &amp; more</h1></header>
    <p><b>One   two<br>three<p>Four&nbsp;five &#233; &lt;b&gt;</p><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table>
    <section class="comments"><p>first!</p></section><form>Mail <input></form><!-- no --></article><footer>&copy; x"""
    assert Page(source).text(set()) == "Title & more\nOne two three\nFour five é <b>\na\nb\n1 2"
    assert Page("").text(set()) == "" and Page("plain <b>text").text(set()) == "plain text"
    assert Page("<p>a < b and c</p><p title='x > y'>d</p>").text(set()) == "a < b and c\nd"


def test_templates_go_and_passages_in_articles_stay(spark):
    rows = []
    for k in range(40):
        box = f"<div class='box'><p>Follow us</p><p>Number {k % 3}</p></div>"
        rows.append((k, f"http://A.example/{k}", f"<body>{box}<article><h1>H{k}</h1><p>Same words everywhere.</p></article><div>Page {k} only</div></body>"))
    rows += [(100, None, None), (101, "http://b.example", ""), (102, "http://b.example/2", "<div class='box'><p>Follow us</p></div>"), (103, "x", "word " * 50_000), (None, "x", "<p>t</p>")]
    rows += [(200 + k, "http://c.example/same", "<div>Fetched again</div>") for k in range(9)]
    got = {(r.id, r.url): r.text for r in extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    for k in range(40):
        assert got[k, f"http://A.example/{k}"] == f"H{k}\nSame words everywhere.\nPage {k} only"
    assert got[100, None] == "" and got[101, "http://b.example"] == "" and got[102, "http://b.example/2"] == "Follow us"
    assert got[103, "x"] == ("word " * 50_000).strip() and got[204, "http://c.example/same"] == "Fetched again"


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.id: r.text for r in extract(pages).collect()}
    assert got == want
    assert extract(pages.limit(0)).count() == 0


def test_shared_passages_of_pages_without_articles_stay(spark):
    rows = []
    for k in range(1200):
        passage = "<p>A notice that a few texts quote.</p>" if k % 200 == 0 else ""
        often = "<p>A paragraph that many texts quote.</p>" if k % 5 == 0 else ""
        body = f"<div class='text'><p>Own words of page {k}, and more of them.</p>{passage}{often}<p>The end of text {k}.</p><p>Printed by the site.</p></div>"
        box = "" if k % 3 else "<div class='box'><p>Follow us</p></div>"
        rows.append((k, f"http://big.example/{k}", f"<body><div class='top'><p>Big Example</p></div>{body}{box}<div class='end'>Since 1990</div></body>"))
    rows += [(2000 + k, None, f"<body><p>Lone page {k}.</p>{'<p>Cited by some.</p>' if k < 6 else ''}</body>") for k in range(20)]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1200):
        want = [f"Own words of page {k}, and more of them.", f"The end of text {k}."]
        want[1:1] = ["A notice that a few texts quote."] * (k % 200 == 0) + ["A paragraph that many texts quote."] * (k % 5 == 0)
        assert got[k] == "\n".join(want)
    assert all(got[2000 + k] == f"Lone page {k}." + "\nCited by some." * (k < 6) for k in range(20))


def test_passages_of_a_template_box_go_with_it():
    source = "<body><div class='text'>Long words of this page only.<div class='box'><p>Follow us</p></div><p>Cited</p></div></body>"
    page = Page(source)
    box, follow, cited = (next(k for k, x in enumerate(page.label) if x == label and k >= at) for label, at in (("div.box", 0), ("p.", 0), ("p.", 4)))
    assert page.text({box, follow, cited}) == "Long words of this page only.\nCited"
    assert page.text({box, follow, cited}, {cited}) == "Long words of this page only."
    page = Page("<body><div class='top'>Site</div><div class='text'><div>Long words of this page only.</div><div>Cited</div></div></body>")
    assert page.text({1, 4}) == "Long words of this page only.\nCited" and page.text({1, 4}, {1, 4}) == "Long words of this page only."


def test_names_delete_nothing_of_an_article():
    inside = "<h2 id='related-work'>Related</h2><section id='search'><p>Search</p></section><div class='social-history'>Social</div><p>x <math><mi>y</mi></math></p>"
    assert Page(f"<div class='page-widget'><article>{inside}<div class='ad'>Buy</div></article></div>").text(set()) == "Related\nSearch\nSocial\nx y"


def test_reading_takes_time_in_proportion():
    import time

    for unit in ("<a ", '<a "', "<a b='", "<p", "<!--", "<div>", "</p>", "<p><article></p>", "<li><ul>", "<script>", "&", "<a b=' \">"):
        began = time.perf_counter()
        page = Page(unit * (1_000_000 // len(unit)))
        page.hashes()
        page.text(set())
        assert time.perf_counter() - began < 8, unit
    began = time.perf_counter()
    assert Page('<a "' * 250_000).text(set()).startswith("<a")
    assert time.perf_counter() - began < 1


def test_counts_alone_find_boilerplate_without_telling_names(spark):
    rows = [(k, f"http://plain.example/{k}", f"<div class='q{k % 2}'>Start here</div><div class='w7'><b>Offer</b> of the week</div><main><p>Text {k}</p></main><div>Written by the house</div>") for k in range(60)]
    rows += [(100 + k, f"http://slots.example/{k}", f"<div class='ad'>Buy thing {k}</div><div class='widget'>once</div><p>Text {k}</p>" if k == 7 else f"<div class='ad'>Buy thing {k}</div><p>Text {k}</p>") for k in range(300)]
    got = {r.id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Text {k}" and got[k].n_template == 3 for k in range(60))
    assert all(got[100 + k].text == f"Text {k}" for k in range(300) if k != 7) and got[107].text == "once\nText 7"


def test_counts_remove_subtrees_of_the_given_pages(spark):
    found = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert found.selectExpr("count_if(n_template > 0) > 0.5 * count(*)").first()[0]


def test_counts_alone_give_the_text_of_the_given_pages(spark, monkeypatch):
    """Without telling names the text is that of the whole operator; without the counts of boxes it isn't."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = lambda **how: {r.id: r.text for r in extract(pages, **how).collect()}
    whole, counted, n = texts(), texts(names=False), pages.count()
    assert sum(whole[k] != counted[k] for k in whole) <= 0.05 * n
    uncounted = texts(names=False, min_pages=1 << 40)
    assert sum(whole[k] != uncounted[k] for k in whole) > 0.3 * n


def test_boxes_of_changing_text_go_by_their_slot(spark):
    """Any class, on a large host, in few of its pages, and on hosts with a page each; what is larger than the content stays."""
    page = lambda k, beside: f"<body><div class='wrap'><h1 class='title'>Title {k}</h1><main><p>Content of page {k}, some words of it.</p></main>{beside}</div></body>"
    rows = [(k, f"http://big.example/{k}", page(k, f"<div class='x9'>Thing {k}</div>" if k % 2 else "")) for k in range(900)]
    rows += [(1000 + k, f"http://big.example/c{k}", page(k, f"<section id=comments><p>Reader {k} says this.</p></section>")) for k in range(4)]
    rows += [(2000 + k, f"http://host{k}.example/", page(k, f"<ul class='zz'><li>Other page {k}</li></ul>")) for k in range(8)]
    rows += [(3000 + k, f"http://long{k}.example/", page(k, f"<div class='text'>{'The text itself. ' * 20}{k}</div>")) for k in range(8)]
    rows += [(4000, "http://once.example/", page(0, "<div class='seen-once'>Stays</div>"))]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in list(range(900)) + [1000 + k for k in range(4)] + [2000 + k for k in range(8)]:
        assert got[k] == f"Title {k % 1000}\nContent of page {k % 1000}, some words of it.", k
    assert all("The text itself." in got[3000 + k] for k in range(8)) and got[4000].endswith("\nStays")
