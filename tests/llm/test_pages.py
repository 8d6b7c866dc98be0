import re

import pytest

from netloom.llm import html, queries, urls


def test_main_text_rules():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav>menu</nav>
    <div class="cookie-notice">Accept</div><main><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp;word<br>two<p>three &lt;3
    <div class="comments"><p>hi</p></div><aside>side</aside><script>var x = "</p>";</script><form>send</form></main><footer>end</footer></body>"""
    assert html.main_text(page) == "Title & more One bold word two three <3"
    assert html.main_text("") == "" and html.main_text("plain text") == "plain text"
    assert html.main_text("a < b <> c <!-- x --> d <") == "a < b <> c d <"
    assert html.main_text("<article>kept<p>to the end") == "kept to the end"
    assert html.main_text("<p hidden>x</p><p style='display: none'>y</p><p role='banner'>z</p><span class='ad'>w</span>t") == "t"
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_templates_of_a_host(spark):
    """A bar without any telling name stands on every page of the host, the articles vary."""
    rows = [(i, f"http://h.example/{i}", f"<div><p>Welcome to our site</p></div><div><p>Story {i} begins</p><p>and ends {i * i}</p></div>") for i in range(12)]
    rows += [(100, None, None), (101, "http://h.example/x", ""), (102, "http://few.example/", "<p>Welcome to our site</p>"), (103, "no host", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 host", "3 n", "4 seed").repartition(3)
    out = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark, df).collect()}
    assert out[3] == ("Story 3 begins and ends 9", 25)
    assert out[100] == out[101] == ("", 0) and out[102][0] == "Welcome to our site" and out[103][0] == "x"


@pytest.mark.parametrize("odd", ["", None, "<p>Not found</p>", "<section>" * 300 + "x", "<div><p>Welcome to our site</p></div><p>" + "long " * 250_000])
def test_templates_beside_odd_pages(spark, odd):
    """A tenth and more of the pages, the first by page_id among them, are empty, errors, deep or longer than 1 MiB."""
    rows = [(i, f"http://h.example/{i}", odd) for i in range(3)]
    rows += [(i, f"http://h.example/{i}", f"<div><p>Welcome to our site</p></div><div><p>Story {i} begins</p><p>and ends {i * i}</p></div>") for i in range(3, 15)]
    out = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 15 and all(out[i] == f"Story {i} begins and ends {i * i}" for i in range(3, 15))


def test_each_layout_has_a_template(spark):
    bar, foot = "<div><p>Welcome to our site</p></div>", "<section><p>Read on below</p></section>"
    rows = [(i, f"http://h.example/{i}", f"{bar}<div><p>Story {i}</p></div>" if i % 2 else f"<ul><li>Item {i}</li></ul>{foot}") for i in range(20)]
    out = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Story {i}" if i % 2 else f"Item {i}" for i in range(20)}


def test_copies_are_not_templates(spark):
    rows = [(i, "http://c.example/", "<article><p>Same story</p></article>") for i in range(9)]
    out = html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {"Same story"}
    assert html.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_pages(n=14, first=""):
    """Pages of nested divs only: no article, no telling names; the bars' links vary a little, the stories much."""
    rows = []
    for i in range(n):
        bar = f"<div><div>Our <b>site</b></div><div>Daily news</div><div>Now: topic {i}</div></div>"
        story = f"<div><h1>Title {i}</h1><div>Story {i} begins here, goes on for a while and tells a lot</div><div>then {'so ' * (i % 3)}it ends {i * i}</div></div>"
        foot = f"<div><div>All rights reserved</div><div>page {i}</div></div>"
        rows.append((i, f"http://plain.example/{i}", f"{first if i == 0 else ''}{bar}{story}{foot}", " ".join(f"Title {i} Story {i} begins here, goes on for a while and tells a lot then {'so ' * (i % 3)}it ends {i * i}".split())))
    return rows


def texts_of(spark, rows):
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(spark, df).collect()}


@pytest.mark.parametrize("limit", [html.MAX_SEED_BYTES, 0])
def test_the_wrapper_finds_the_article(spark, monkeypatch, limit):
    """With broadcast wrappers and with joined ones."""
    monkeypatch.setattr(html, "MAX_SEED_BYTES", limit)
    rows = plain_pages()
    assert texts_of(spark, rows) == {r[0]: r[3] for r in rows}


def test_without_tree_matching_the_bars_stay(spark):
    """Ablation: what markup alone gives for these pages is the whole page."""
    for _, _, page, text in plain_pages():
        alone = html.main_text(page)
        assert text in alone and "Daily news" in alone and "All rights reserved" in alone


def test_wrapper_beats_markup():
    """A slot that holds the varying text is content even where another element calls itself the article."""
    seed = html.Seed(html.skeleton(html.parse("<div><article>Top <p>x</p></article><div><p>a</p><p>b</p></div></div>")))
    page = "<div><article>Top <p>y</p></article><div><p>long story</p><p>of today</p></div></div>"
    own = html.Seed(html.parse(page))
    learned = html.content_slot(seed, html.varying(html.aligned(seed, own), own), {seed.tags.index("article"): 3})
    assert html.main_text(page) == "Top y" and html.main_text(page, html.Wrapper(seed, frozenset(), *learned)) == "long story of today"


def test_names_of_bars_count_outside_of_articles_only():
    assert html.main_text("<div class='header'>Bar</div><article><div class='header'>Dear all</div><p class='related'>kin</p><div class='comments'>me too</div></article>") == "Dear all kin"
    assert html.main_text("<div class='header'>Bar</div><p>text</p>") == "text"


def test_size_of_the_first_page_changes_nothing(spark, monkeypatch):
    """Whichever page is the seed: one of over 1 MB, or a small one."""
    small, big = plain_pages(), plain_pages()
    big[0] = (*big[0][:2], big[0][2].replace("begins here", "begins " + "very " * 250_000 + "here"), "")
    want = {r[0]: r[3] for r in small[1:]}
    for sign in (1, -1):  # the least and the largest hash is the seed
        monkeypatch.setattr(html.F, "xxhash64", lambda c, sign=sign: sign * html.F.length(c).cast("long"))
        out = texts_of(spark, big)
        assert len(out[0]) > 1 << 20 and {i: t for i, t in out.items() if i} == want


def test_any_depth(spark):
    deep = "<section>" * 100_000 + "x" + "</section>" * 100_000
    for tag in ("blockquote", "body", "ul"):
        assert html.layout(html.parse(f"<{tag}>" * 100_000 + "x<li>y")) and html.main_text(f"<{tag}>" * 100_000 + "x") == "x"
    seed = html.Seed(html.skeleton(html.parse(deep)))
    assert len(html.tree_match(seed, html.parse(deep))) == 100_001
    assert len(html.tree_match(seed, html.parse("<section>" * 50_000 + "<p>x"))) == 50_001
    deep = "<section>" * 20_000 + "x" + "</section>" * 20_000
    rows = [(i, f"http://deep.example/{i}", deep) for i in range(6)] + plain_pages()
    out = texts_of(spark, [(r[0] + 100 * (len(r) > 3), "http://deep.example/", *r[2:]) for r in rows])
    assert out[0] == "x" and out[103] == plain_pages()[3][3]


def test_long_lists_align_in_linear_memory():
    import random

    r = random.Random(4)
    items = [r.choice(["<p>a</p>", "<ul><li>a</li></ul>", "<div><p>a</p></div>"]) for _ in range(3000)]
    other = [x for x in items if r.random() < 0.9]
    seed = html.Seed(html.skeleton(html.parse("".join(items))))
    assert len(html.tree_match(seed, html.parse("".join(other)))) == len(html._in_order(html.parse("".join(other))))


def brute_match(seed, s, page):
    """Largest simple tree matching, by the plain recursion."""
    if seed.tags[s] != page.tag:
        return 0
    a, b = seed.kids[s], page.kids
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(seed, a[i], b[j]))
    return best[-1][-1] + 1


def test_tree_matching_is_largest():
    import random

    r = random.Random(3)

    def tree(depth):
        tag = r.choice(["div", "section", "p"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 3) if depth and tag != "p" else 0)) + f"</{tag}>"

    for _ in range(150):
        seed, page = html.Seed(html.skeleton(html.parse(tree(3)))), html.parse(tree(3))
        assert len(html.tree_match(seed, page)) == brute_match(seed, 0, page)


def test_articles_of_the_test_pages(spark, sf):
    import html as h
    import re

    out = {r.page_id: r.text for r in queries.op3_html_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p)>|<br>", " ", body))
        assert out[r.page_id] == " ".join(h.unescape(body).split())


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(99)) for _ in range(n))


@pytest.mark.parametrize("tag", ["article", "div", "main", "section"])
def test_no_varying_text_of_the_article_is_lost(spark, tag):
    """A lead, the text and an end in containers of their own: all of it is content, whatever its share."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(14):
        lead, end, body = words(r, 9), words(r, 13), [words(r, 40) for _ in range(4)]
        page = f'<{tag}><div class="lead"><p>{lead}</p></div><div class="text">{"".join(f"<p>{b}</p>" for b in body)}</div><div class="end"><p>{end}</p></div></{tag}>'
        rows.append((i, f"http://three.example/{i}", f"<html><body><div>Our site</div>{page}<div>All rights reserved</div></body></html>", " ".join([lead, *body, end])))
    assert texts_of(spark, rows) == {r[0]: r[3] for r in rows}


def test_random_wrappers(spark):
    """Hosts of random templates: bars before and behind, nested wrappers, leads, ends and asides; the article is known."""
    import random

    r = random.Random(11)
    rows = []
    for host in range(12):
        deep, tag = r.randrange(3), r.choice(["div", "section", "article", "main"])
        bar = f"<div><p>{words(r, 12)}</p></div>" if r.random() < 0.7 else ""
        foot = f"<section><p>{words(r, 15)}</p></section>" if r.random() < 0.7 else ""
        head, lead, end, dated = (r.random() < 0.5 for _ in range(4))
        for i in range(9):
            parts = [f"<h1>{words(r, 5)}</h1>"] if head else []
            parts += [f"<div><p>{words(r, r.randint(1, 20))}</p></div>"] if lead else []
            parts += [f"<div>{''.join(f'<p>{words(r, r.randint(5, 30))}</p>' for _ in range(r.randint(1, 6)))}</div>"]
            parts += [f"<ul><li>{words(r, 3)}</li><li>{words(r, 2)}</li></ul>"] if end else []
            text = " ".join(re.sub("<[^>]*>", " ", "".join(parts)).split())
            parts.insert(r.randrange(len(parts) + 1), f"<aside>{words(r, 30)}</aside><div class='comments'>{words(r, 30)}</div><form>{words(r, 4)}</form>")
            top = f"<div><p>{words(random.Random(host), 12)}</p><p>Page {i}</p></div>" if dated else ""
            page = f"{'<div>' * deep}<{tag}>{''.join(parts)}</{tag}>{'</div>' * deep}"
            rows.append((100 * host + i, f"http://host{host}.example/{i}", f"<body>{bar}{top}{page}{foot}</body>", text))
    got = texts_of(spark, rows)
    wrong = [(i, want, got[i]) for i, _, _, want in rows if got[i] != want]
    assert not wrong, wrong[:2]


def test_constant_headings_of_articles_stay(spark):
    rows = [(i, f"http://head.example/{i}", f"<div>Bar</div><article><h1>Daily report</h1><p>Read it daily</p><p>Story {i * i} of many</p></article>") for i in range(8)]
    assert texts_of(spark, rows) == {i: f"Daily report Story {i * i} of many" for i in range(8)}


@pytest.mark.parametrize("tag", ["svg", "math", "select", "object", "canvas", "iframe", "noscript", "template"])
def test_unclosed_elements_end_with_their_parent(tag):
    assert html.main_text(f"<body><p>Intro text here</p><div><{tag}><circle></div><p>After</p></body>") == "Intro text here After"
    assert html.main_text(f"<p>a</p><{tag}>gone</{tag}><p>b") == "a b"
    if tag in ("svg", "math", "select"):
        assert html.main_text(f"<p>a</p><{tag}><p>b") == "a b"
    if tag in html.CLOSABLE:
        assert html.main_text(f"<p>a</p><{tag} x='y'/>b") == "a b"


@pytest.mark.parametrize("page", ["<p " * 350_000 + '"', "<p '" * 250_000, '<p "' * 250_001, "<p a=\"'" * 150_000, "<" * 1_000_000, "<a " * 300_000, "<!--" * 250_000, "<p a='" * 170_000 + ">x"])
def test_parsing_is_linear(page):
    """Open quotes and tags of a megabyte."""
    import time

    start = time.perf_counter()
    html.parse(page)
    assert time.perf_counter() - start < 4


def test_quotes():
    assert html.main_text("<p title='a>b'>c</p>") == "c" and html.main_text("<p title=\"it's>\">c</p><p it's>d</p>") == "c d"
    assert html.main_text('<p a="x>y') == "y" and html.main_text("<p class=\"ad\" \">gone</p>x") == "x"


URLS = ["http://example.com/en/1", "https://WWW.example.com/en/", "http://a.www.example.com/en/x?y", "http://x.net/es/", "http://x.net/Es/", "http://com/", "http://com", "http://notexample.com/en/", "http://x.net/fr#z", None, "no host", "://", "http://?/net/fr/", "http://EXAMPLE.com:80/en/"]


@pytest.mark.parametrize("limit", [urls.MAX_RULE_BYTES, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "MAX_RULE_BYTES", limit)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' host", "'y' rule")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark, df, queries.URL_RULES).collect()}
    assert out[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert out[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[2] == ("a.www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert out[3] == ("x.net", "/es/", "net/es/", "block") and out[4][2:] == (None, "allow")
    assert out[5] == ("com", "/", "com/", "allow") and out[6] == ("com", "", None, "allow")
    assert out[7][2] == "com/" and out[8] == ("x.net", "/fr", None, "allow")
    assert out[9] == out[10] == out[11] == ("", "", None, "allow")
    assert out[12][:2] == ("", "") and out[13] == ("example.com:80", "/en/", None, "allow")
    assert urls.judge(spark, df.limit(0), queries.URL_RULES).count() == 0


def test_url_rules_of_repeated_and_very_long_urls(spark):
    rules = [("com", "/", True), ("a.com", "/" + "x" * 5000, False), ("é.com", "/ü", False)]
    long = "http://" + "b." * 3000 + "a.com/" + "x" * 100_000
    rows = [(1, long), (1, long), (1, None), (2, "http://sub.é.com/ü/1"), (None, "http://a.com/x")]
    out = urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert [(r.page_id, r.verdict) for r in out] == [(1, "block"), (1, "block"), (1, "allow"), (2, "block"), (None, "allow")]
    assert out[0].rule == "a.com/" + "x" * 5000 and out[2].rule is None and out[3].rule == "é.com/ü"


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)
    rules = [(f"h{i}.com", "/" + "p" * (i % 4), i % 2 == 0) for i in range(40)]
    array = urls.DigestArray(rules).mapped()
    keys = [f"{h}\n{p}" for h, p, _ in rules] + ["none\n/", "h1.com\n/"]
    got = array.find(keys)
    assert [array.key(i) if i >= 0 else None for i in got] == [f"{h}\n{p}" for h, p, _ in rules] + [None, None]
