import re
from collections import defaultdict
from html import unescape

from tenura.llm import html_text
from tenura.llm.html_text import Page, main_text, op2_html_text

SCHEMA = "page_id long, url string, html string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(rows)], SCHEMA)


def test_plain_cases():
    text = lambda h: Page(h).text()
    assert text("") == "" and text("just text &amp; more") == "just text & more"
    assert text("<p>a<b>b</b>\n c<p>d<br>e") == "ab c\nd e"
    assert text("<ul><li>one<li>two<ul><li>in</ul></ul>") == "one\ntwo\nin"
    assert text("<nav>x</nav><article><header><h1>T</h1></header><p>a<footer>f</footer><div class='user-comments'>c</div><form>q</form></article><footer>y</footer>") == "T\na"
    assert text("<div class='page has-sidebar'><main><p>kept</main><div id=sidebar>no</div></div>") == "kept"
    assert text("<script>var a='</p>';</script><style>p{}</style><!-- x --><p>y</p><div hidden>z</div>") == "y"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b\nc"
    assert text("<p>1 < 2 &lt;b&gt; &copy; &#233;&nbsp;z</p>") == "1 < 2 <b> © é z"
    assert text("<p>a</b>b</p></div>c<p") == "ab\nc<p"
    assert text("<div>" * 30000 + "deep") == "deep"


def test_names_and_quotes():
    text = lambda h: Page(h).text()
    kept = "<p class='share-price'>a</p><div class='related-work'>b</div><section id=notice-period>c</section><div class='ad-hoc'>d</div>"
    assert text(f"<article>{kept}</article>") == "a\nb\nc\nd"
    assert text("<article><p>a</p><div class=cookie-notice>n</div><div class='box ads'>x</div><div class='share-it'><a href=x>s</a></div></article>") == "a"
    assert text('a <a title="x>link b') == "a link b" and text("<p title='x>a</p><p>b</p>") == "a\nb"
    assert text('<a title="q>r</a> <a href="/y">z</a>') == "r z" and text('<a href="/x>y" b>k</a>') == "k"


def test_the_article_stays_whatever_is_around_it():
    text = lambda h: Page(h).text()
    words = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    for n in (55, 61, 90):
        body = words(n, "a")
        assert text(f"<div class='content-with-sidebar'><p>{body}</p></div><div class=footer>{words(100 - n, 'f')}</div>") == body
        assert text(f"<div id=sidebar-content><p>{body}</p></div><div class=footer>{words(45, 'f')}</div>") == body
    assert text("<form id=aspnet><input type=hidden value=x><article>The text</article><button>Go</button></form>") == "The text"
    assert text(f"<form><div><p>{words(30, 'a')}</p><select><option>x</select></div></form><form>search</form>") == words(30, "a")
    assert text("<article>Main<form>subscribe</form></article>") == "Main"
    assert text("<article><p>Text</p><div class='comments'><article>reader comment</article></div></article>") == "Text"
    assert text("<article>Text</article><article class='comment'>reader</article><section id=comments><article>more</article></section>") == "Text"
    assert text("<div><p>Text of some length here</p></div><article class=comment>reader</article>") == "Text of some length here"
    assert text(f"<div><p>Text</p></div><div class=comments>{words(90, 'c')}</div>") == "Text"


def test_hostile_markup_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    n = 60_000
    many = [
        '<a "' * n, '<a "' * n + ">", "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n, "<p><b>" * n, "<!--" * n, "<![CDATA[" * n, "<" * n, "&#" * n,
        "<td><p>" * n, "</x>" * n, "<script>" * n, "<a class='" * n, "<li><b>" * n, "&#" + "9" * n + ";", "&#" + "0" * n + "65;x", "<table><tr><td>" * n, "<select><option>" * n,
    ]
    texts = [Page(h).text() for h in many]
    assert time.perf_counter() - began < 60 and texts[-4] == "\ufffd" and texts[-3] == "Ax"
    began = time.perf_counter()
    Page('<a "' * 1_250_000).text()
    assert time.perf_counter() - began < 5


def wild_pages():
    """Two hosts with menus, notices and in-article boxes that recur, and paragraphs that do too."""
    menu = "<div><ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li></ul></div>"
    long_box = f"<div><p>{'about the writer ' * 20}</p></div>"
    rows = []
    for k in range(30):
        box = "<section><p>Read our terms</p></section>" if k % 3 == 0 else ""
        rows.append((f"http://a.example/{k}", f"<body>{menu}<article><h1>T{k}</h1><p>Same words here.</p>{box}<p>Text {k}</p>{long_box}</article><div>House of A</div></body>"))
        rows.append((f"http://b.example/{k}", f"<body>{menu}<div>Body {k} of the page</div><p>Same end</p>{long_box if k < 9 else ''}</body>"))
    return rows


def test_counts_by_host_against_brute_force(spark):
    rows = wild_pages()
    frame = html_text.with_host(pages(spark, rows))
    hosts = dict(frame.select("url", "host").distinct().collect())
    seen: dict = defaultdict(set)
    for url, source in rows:
        page = Page(source)
        for node in range(1, len(page.tags)):
            if page.may_be_template(node):
                seen[html_text.joint(hosts[url], page.key(node))].add(page.content)
    want = {k: len(v) for k, v in seen.items() if len(v) >= (html_text.LONG_PAGES if k & 1 else html_text.MIN_PAGES)}
    assert len(want) > 5 and want == dict(html_text.templates(frame).collect())


def test_templates_go_without_any_word_list(spark, monkeypatch):
    for name in ("CHROME_TAGS", "CHROME_ROLES", "CHROME_WORDS"):
        monkeypatch.setattr(html_text, name, set())
    rows = wild_pages()
    got = {r["url"]: Page(r["html"]).text(html_text.Templates(keys_of(spark, rows), r["host"])) for r in html_text.with_host(pages(spark, rows)).collect()}
    for k in range(30):
        # the long box recurs on 30 pages of a, on 9 of b
        assert got[f"http://a.example/{k}"] == f"T{k}\nSame words here.\nText {k}"
        assert got[f"http://b.example/{k}"] == f"Body {k} of the page"


def keys_of(spark, rows):
    import numpy as np

    return np.sort(np.array([r["subtree"] for r in html_text.templates(html_text.with_host(pages(spark, rows))).collect()], np.int64))


def test_many_templates_are_joined_to_the_same_result(spark):
    rows = [*wild_pages(), *wild_pages()[:4], (None, None)]
    few, many = (sorted(map(str, main_text(pages(spark, rows), broadcast_rows=n).collect())) for n in (1000, 0))
    assert few == many


def test_recurring_menus_of_the_table_are_found(spark):
    """Each nav and footer on MIN_PAGES or more articles of its host is a template."""
    sf = "/root/testdata/sf0.1"
    frame = html_text.with_host(spark.read.parquet(f"{sf}/pages.parquet"))
    found, seen = {r["subtree"] for r in html_text.templates(frame).collect()}, defaultdict(set)
    for r in frame.collect():
        page = Page(r["html"])
        for node in range(1, len(page.tags)):
            if page.tags[node] in ("nav", "footer"):
                seen[html_text.joint(r["host"], page.key(node))].add(page.content)
    recurring = {k for k, v in seen.items() if len(v) >= html_text.MIN_PAGES}
    assert len(recurring) > 50 and recurring <= found


def test_templates_by_host(spark):
    def page(n, body="div"):
        return f"<html><body><div><span>Our shop ships worldwide and tells you more</span></div><{body}><p>Text {n} alpha beta.</p></{body}><div><p>All rights of this house</p></div></body></html>"

    rows = [(f"http://a.example/{k}", page(k)) for k in range(12)] + [(f"http://b.example/{k}", page(k)) for k in range(3)] + [(None, None), ("x", "")]
    got = {r["page_id"]: r["text"] for r in main_text(pages(spark, rows)).collect()}
    assert all(got[k] == f"Text {k} alpha beta." for k in range(12))
    assert got[12].count("\n") == 2 and got[15] == got[16] == ""
    # copies of one page aren't a template, nor are an article's own paragraphs
    same = [("http://c.example/1", page(1))] * 40
    assert {r["text"].count("\n") for r in main_text(pages(spark, same)).collect()} == {2}
    rows = [(f"http://d.example/{k}", f"<article><p>Shared passage of the article.</p><div><a href=x>Share this now</a></div><p>{k}</p></article>") for k in range(9)]
    assert {r["text"] for r in main_text(pages(spark, rows)).collect()} == {f"Shared passage of the article.\n{k}" for k in range(9)}
    assert main_text(pages(spark, [])).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r for r in op2_html_text(spark, sf).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
