import pytest

from veriledge.llm import style_tree as sst


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c<br>d</p>e", "abc d e"),
    ("<nav>menu</nav><article><h1>T</h1><p>one<p>two</article><footer>f", "T one two"),
    ("<article><header><h1>T</h1></header><div class='ad'>buy</div><p>x</p>"
     "<section id=comments><p>nice</p></section></article>", "T x"),
    ("<body class='sidebar-left'><header>h</header><p>kept</p><aside>a</aside><form>f</form></body>", "kept"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- no --></p>", "yes"),
    ("<p>a <script>never closed", "a"), ("<p>x<!-- open", "x"), ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
    ("<p title='a>b'>q</p><p title=\"x>r</p>", "q r"), ("<ul><li>a<li>b</ul>&nbsp;&#233;&copy;", "a b é©"),
    ("<div role=navigation>m</div><div class='cookie-notice'>c</div><main>m<p>n</main>", "m n"),
    ("<html><head><title>t</title></head><body>\n a \t b \n</body>", "a b"), ("<b>a</i></b></p>z", "a z"),
])
def test_pages(html, text):
    assert sst.Page(html).text() == text


@pytest.mark.parametrize("html,text", [
    ("<article><h2 id='search-methods'>S</h2><section class='related-work'>r</section>"
     "<p class='notice-period'>n<section id='social-policy'>p</section><div id=login>l</div></article>", "S r n p l"),
    ("<article>a<math><mi>x</mi></math><dialog>d</dialog><map>m</map><div class='box related'>no</div></article>",
     "ax d m"),
    ("<p>so <math><mi>y</mi></math>", "so y"),
    ("<body><form id=aspnetForm><nav>n</nav><p>the whole story</p><input><select>s</select></form>", "the whole story"),
    ("<form class='search'><nav>n</nav><article>long story<form>reply here</form></article></form>", "long story"),
    ("<p>much longer than the form</p><form>find</form>", "much longer than the form"),
])
def test_article_text_is_not_removed_by_words_in_names(html, text):
    assert sst.Page(html).text() == text


@pytest.mark.parametrize("html,text", [
    ("<div class='layout has-sidebar'><h1>T</h1><p>story</p></div>", "T story"),
    ("<div id='menu-page'><p>story</p></div>", "story"),
    ("<div class='post-comments-open'><p>story</p></div>", "story"),
    ("<p>intro</p><section class='related-work'>r</section><section class='social-policy'>s</section>", "intro r s"),
    ("<article><p>a</p><div class='comments-section'>c</div><div class='user-comments'>c</div>"
     "<ul class='comment-list'><li>c</ul><div class='ad-slot'>x</div><div class='share-buttons'>x</div>"
     "<div class='newsletter-signup'>x</div><div class='cookie-banner'>x</div><ol class='breadcrumbs-list'>x</ol>"
     "<div class='related-posts'>x</div><div class=commentThread>c</div><section id='user-comments'>c</section>"
     "<p>b</p></article>", "a b"),
    ("<main><p>short</p><div class='comments'>" + "long reader comment " * 20 + "</div></main>", "short"),
    ("<div class='sidebar'><main><p>in</p></main></div>", "in"),
    ("<div class='footer-links'>f</div><div class='site-nav'>n</div><p>the text is here</p>", "the text is here"),
])
def test_names_vote_and_never_empty_a_page(html, text):
    assert sst.Page(html).text() == text


def test_long_deep_and_crossed_pages_take_linear_time():
    import time

    begin = time.time()
    assert sst.Page("<b>a</i>" * 20_000).text() == "a" * 20_000
    assert sst.Page("<div>" * 20_000 + "deep" + "</div>" * 20_000).text() == "deep"
    assert sst.Page("<b><p>x</p>" * 5_000).text() == " ".join("x" * 5_000)
    assert len(sst.Page("<p>long words &amp; more</p>" * 40_000).text()) == 40_000 * 18 - 1
    assert time.time() - begin < 20


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_branches_of_a_host_go(spark):
    body = ("<div class=top>Acme portal <a>home</a></div><div class=story><p>{}</p></div>"
            "<div class=rail><ul><li>one<li>two</ul></div>")
    rows = [(i, f"https://Acme.example:8080/{i}", body.format(f"story {i} of many")) for i in range(8)]
    rows += [(50, "https://lonely.example/", body.format("alone"))]
    rows += [(60 + i, "https://copies.example/", body.format("same")) for i in range(5)]
    rows += [(70, None, None), (71, "odd url", "<p>x"), (70, None, None)]
    df = pages(spark, rows).selectExpr("*", "1 AS host", "2 AS noise", "3 AS key").repartition(4)
    got = {}
    for r in sst.main_text(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [f"story {i} of many"] for i in range(8))
    # One page, or copies of one page, are no template.
    assert got[50] == ["Acme portal home alone one two"]
    assert all(got[60 + i] == ["Acme portal home same one two"] for i in range(5))
    assert got[70] == ["", ""] and got[71] == ["x"]


def test_importance_decides_inside_and_beside_articles(spark):
    body = ("<div class=page><div class=logo>Acme</div><div class=lead><p>lead {0} <b>bold</b></p></div>"
            "<div class=claim>we are Acme</div><article><h2>Methods</h2><p>story {0} <i>note</i></p>"
            "<div id=part-{1}><p>part {0}</p></div><div class=join><b>Join us</b> now</div></article>"
            "<div class=foot>imprint</div></div>")
    rows = [(i, "https://a.example/", body.format(f"of {i}", chr(97 + i) * 3)) for i in range(6)]
    rows += [(9, "https://lonely.example/", body.format("alone", "x"))]
    got = {r["page_id"]: r["text"] for r in sst.main_text(pages(spark, rows)).collect()}
    for i in range(6):
        assert got[i] == f"lead of {i} bold Methods story of {i} note part of {i}"
    # Nothing is measured on a single page.
    assert got[9] == "Methods story alone note part alone Join us now"


def test_many_nodes_are_joined_by_salted_hosts(spark, monkeypatch):
    monkeypatch.setattr(sst, "SENT_NODES", 0)
    rows = [(i, "http://h/", f"<div class=a>menu</div><p>text {i}</p>") for i in range(6)]
    assert sorted(r["text"] for r in sst.main_text(pages(spark, rows)).collect()) == [
        f"text {i}" for i in range(6)]


def test_host_and_empty_table(spark):
    urls = ["http://A.b:80/x", "https://u@c.d?q", "e.f/g", None, "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(sst.host_of(df.url)).collect()] == ["a.b", "c.d", "", "", ""]
    assert sst.main_text(pages(spark, [])).collect() == []


def test_importance_equals_a_plain_recomputation(spark):
    import math

    rows = [(i, "http://h/", f"<div class=a>menu<b>{i % 2}</b></div><div class=s><p>text {i}</p>"
             + "<i>x</i>" * (i % 3 == 0) + "</div>") for i in range(6)]
    rows += [rows[0]]
    found = {r["key"]: r for r in sst.site_importance(pages(spark, rows).selectExpr("'h' AS host", "html")).collect()}
    seen = {}
    for html in {r[2] for r in rows}:
        for key, parent, style, content in sst.Page(html).nodes():
            seen.setdefault(key, (parent, []))[1].append((style, content))

    def entropy(values):
        m = len(values)
        return -sum(values.count(v) / m * math.log(values.count(v) / m, m) for v in set(values)) if m > 1 else 1.0

    shown = {k: v for k, v in seen.items() if len(v[1]) >= sst.PAGES}
    assert set(found) == set(shown)

    def value(key):
        pairs = shown[key][1]
        style, content = entropy([a for a, _ in pairs]), entropy([b for _, b in pairs])
        texts = any(b is not None for _, b in pairs)
        kids = [value(k) for k, v in shown.items() if v[0] == key]
        parts = kids + ([content] if texts else [])
        if not kids:
            return content if texts else 0.0
        weight = sst.DECAY ** len(parts)
        return (1 - weight) * style + weight * sum(parts) / len(parts)

    for key, row in found.items():
        assert row["importance"] == pytest.approx(value(key))
