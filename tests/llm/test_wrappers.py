"""Main text of pages: hand-written pages, the corpus, and wrappers."""

import html
import re

from parchment.llm import wrappers

DATA = "/root/testdata/sf0.01"


def page(i, body=None, extra=""):
    body = body or "".join(f"<p>Paragraph {k} of {i}: caf&eacute; &amp; <b>bo</b>ld\n\n text</p>" for k in range(1 + i % 4))
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="page">
<header><a href="/">Site</a></header><nav><ul>{"".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(i % 5 + 1))}</ul></nav>
<div class="cookie-notice">We use cookies {i}</div><article><h1>Title {i}</h1>{body}<p>Thanks for reading the daily site.</p>
<div id="comments"><p>first! {i}</p></div><form><label>Mail</label><input name=a></form></article>{extra}
<aside><p>aside {i}</p></aside><footer>&copy; {i}</footer></body></html>"""


def want(i, last=False):
    return " ".join([f"Title {i}", *(f"Paragraph {k} of {i}: café & bold text" for k in range(1 + i % 4)), *["Thanks for reading the daily site."] * last])


def test_article_without_wrapper():
    assert all(wrappers.extract(page(i), None) == want(i, True) for i in range(8))


def test_template_text_of_a_host_goes(spark):
    rows = [(i, f"https://www.Host.example/{i}?x=1", page(i)) for i in range(30)] + [(99, "http://other/", page(3)), (100, None, page(3))]
    rows += [(101, "http://h/", None), (None, "http://h/", ""), (101, "http://h/", "<p>only <p>bare &lt;text"), (101, "http://h/", "<p>only <p>bare &lt;text")]
    rows += [(102, "http://same/", page(1, "<p>x</p>"))] * 20 + [(103, "http://long/", page(1, f"<p>{'word ' * 40_000}</p>"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text", "4 AS n", "5 AS h")
    got = wrappers.main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 30:
            assert r.text == want(r.page_id)
        if r.page_id in (99, 100):
            assert r.text == want(3, True)
    assert sorted(r.text for r in got if r.page_id in (None, 101)) == ["", "", "only bare <text", "only bare <text"]
    assert {r.text for r in got if r.page_id == 102} == {"Title 1 x Thanks for reading the daily site."}
    assert next(len(r.text) for r in got if r.page_id == 103) > 199_000
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_inference_makes_groups_options_and_slots():
    found = wrappers.infer([page(i, extra="<div class=x>now and then</div>" if i % 2 else "") for i in range(6)])
    items = {s: (c, o) for s, c, o in found["items"]}
    assert ("(li a # /a /li)+" in items) and items["article"] == (None, 0) and items["div.x"][1] == 1
    assert ["#", "Thanks for reading the daily site.", 0] in found["items"]


def test_awkward_markup():
    cases = {
        "<article><p>a<br>b<p>c<b>d</article>x": "a b cd",
        "<main><p>one &amp two &#233; &bogus; 1 < 2</p><!-- no --></main>": "one & two é &bogus; 1 < 2",
        "<div><p>body text</p></div><div hidden>no</div><div style='display: none'>no</div>": "body text",
        "<article><p>kept</p><div class='ad-slot'><p>bought</p></div><section id=related><p>more</p></section><p>also</article>": "kept also",
        "<article><header><h1>Head</h1></header><p>text <a title='a>b'>link</a>.</p><table><tr><td>1<td>2</table></article>": "Head text link. 1 2",
        "<article><p>cut off in a tag <em": "cut off in a tag",
        "<script>never closed <p>x": "",
        "<nav><p>unclosed nav": "",
        "": "",
    }
    for raw, text in cases.items():
        assert wrappers.extract(raw, None) == text, raw


def test_query_against_the_pages_layout(spark):
    """The tables' pages have one article of h1 and p elements, some of them cut off."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in wrappers.op9_html_text(spark, DATA).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ")) if body else []
        expected = " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)))
        assert r.text == expected and r.n_chars == len(expected)


def test_pages_of_another_layout_do_not_hide_the_template(spark, monkeypatch):
    """Each tenth page of a host is cut off before its template text; the others' still goes."""
    rows = [(i, "http://big/", page(i).split("<p>Thanks")[0] if i % 10 == 0 else page(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    monkeypatch.setattr(wrappers, "BLOCK", 9, raising=False)
    monkeypatch.setattr(wrappers, "MERGED", 3, raising=False)
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert got == {i: want(i) for i in range(200)}


def unnamed(i, article=None):
    """A page whose elements have no names: links, an advert, the article and a footer, all divs."""
    words = " ".join(f"w{i}x{k}" for k in range(2 if i % 6 == 5 else 60))
    article = article or f"<h1>Head {i}</h1><p>{words}</p><p>By <a href=x>someone</a>, {i}.</p>"
    links = "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(3 + i % 3))
    advert = f"<div>Buy {i} of these now while they last, they are cheap {i}</div>" if i % 2 else ""
    return f"<html><body><div><ul><li><a href='/'>Home</a></li>{links}</ul></div>{advert}<div>{article}</div><div><p>&copy; Example Corp {i % 4}</p></div></body></html>"


def article_of(i):
    return " ".join([f"Head {i}", *[" ".join(f"w{i}x{k}" for k in range(2 if i % 6 == 5 else 60))], f"By someone, {i}."])


def test_the_wrapper_finds_the_article_among_unnamed_elements(spark):
    """The hosts' pages decide where the article is, also for pages that have more advert than article."""
    rows = [(i, "http://plain/", unnamed(i)) for i in range(40)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: article_of(i) for i in range(40)}
    alone = {i: wrappers.extract(unnamed(i), None) for i in range(40)}
    assert all(alone[i] != got[i] for i in range(5, 40, 6))


def test_results_come_from_the_wrapper(spark):
    """With all names taken out of the corpus's pages, the wrapper still finds the same articles, and
    without the article's place nearly all pages have other texts."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r.text for r in wrappers.op9_html_text(spark, DATA).collect()}
    host = wrappers.host("url")
    large = [r.h for r in pages.groupBy(host.alias("h")).count().where(f"count >= {wrappers.ENOUGH}").collect()]
    plain = [(r.page_id, r.url, re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1div>", r.html).replace('<div class="ad">', "<div>")) for r in pages.where(host.isin(large)).collect()]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(plain, "page_id bigint, url string, html string")).collect()}
    assert len(got) > 100 and got == {i: found[i] for i in got}
    nowhere = wrappers.json.dumps({"main": "", "menus": [], "items": []})
    assert sum(wrappers.extract(x, nowhere) != got[i] for i, _, x in plain) > 0.9 * len(plain)


def test_names_are_whole_and_a_tie_break():
    parts = "".join(f'<div class="{c}"><p>Study text</p></div>' for c in ("social-science", "side-effects", "share-price", "notice-of-results"))
    assert wrappers.extract(f"<article><h1>T</h1>{parts}</article>", None) == " ".join(["T"] + ["Study text"] * 4)
    # An element that is called a widget but holds all pages' text is the article.
    raw = [f"<body><div class=widget><h1>T{i}</h1><p>{'text ' * 50}{i}</p></div><div class=x><p>short {i}</p></div></body>" for i in range(30)]
    wrapper = wrappers.json.dumps(wrappers.infer(raw))
    assert wrappers.extract(raw[3], wrapper) == f"T3 {'text ' * 50}3"


def test_copies_of_an_article_are_no_template():
    raw = [f"<html><body><nav>{'<a>m</a>' * (i % 3)}</nav><article><p>{'same words ' * 30}</p></article><footer>{i}</footer></body></html>" for i in range(20)]
    wrapper = wrappers.json.dumps(wrappers.infer(raw))
    assert wrappers.extract(raw[0], wrapper) == " ".join(["same words"] * 30)
