import html as h
import random
import re
import time

from helixmill.llm.html_text import best_stretch, extract, fit, main_text, pieces, scores

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home page of the site</a></header><nav><ul><li><a href="/a">one</a></li><li>two</li></ul></nav><!-- <p>no</p> -->
<div class="ad">buy this <b>now</b> or never</div><div id="cookie-notice"><p>we use cookies</p></div>
<article><h1>A &amp; B</h1><p class="notice">hidden note<p>First   para&shy;graph<br>with <i>in</i>line and 1 &lt; 2.</p>
<div class='advert'>middle advert</div><blockquote>Quoted &#8212; text</blockquote><form><input name=q>search here</form><p><b>Unclosed.<br><p>Last one.
<section class="comments"><p>great post</p></section></article>
<aside>side bar words</aside><footer>&copy; me &middot; all rights</footer></body></html>"""


def test_page(spark):
    rows = [(1, "u", PAGE, 5), (None, None, None, 5), (2, "v", "", 5), (2, "v", "", 5), (3, "w", "no tags at all", 5), (4, "x", "<p>" * 3000 + "deep</p>" * 3000, 5), (5, "y", "<div class=ad>x</div> < broken <b", 5)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows)
    assert by[1, "u"].text == "A & B First para­graph with inline and 1 < 2. Quoted — text Unclosed. Last one."
    assert by[1, "u"].n_chars == len(by[1, "u"].text)
    assert by[None, None].text == "" and by[2, "v"].n_chars == 0
    assert by[3, "w"].text == "no tags at all"
    assert by[4, "x"].text.count("deep") == 3000
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_labels():
    assert extract("<div><p>plain words here</p></div>", {"": 1.0, "other": -1.0}) == "plain words here"


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = fit(pages)
    assert weights[""] > 0 and all(w < 0 for n, w in weights.items() if n)
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if body:
            want = re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", body[1])
            assert got[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]*>", " ", want)).split())


WEIGHTS = {"": 1.0, "other": -0.1, "marked": -2.0}


def test_marks_in_parts_of_names_bar_nothing():
    parts = ['<h2 id="discussion">One two three</h2>', '<section id="related-work"><p>four five six</p></section>', '<h3 id="search-algorithms">seven eight nine</h3>',
             '<div id="notice-period"><p>ten eleven twelve</p></div>', '<section id="discussion"><p>a b c</p></section>', '<h2 class="related">d e f</h2>']
    page = f"<body><article><p>{'word ' * 30}</p>{''.join(parts)}<div class='advert'>buy</div><p>last words of it</p></article></body>"
    want = "word " * 30 + "One two three four five six seven eight nine ten eleven twelve a b c d e f last words of it"
    assert extract(page, WEIGHTS) == want


def test_wrappers_bar_nothing():
    text = "plain words of a page that has no article " * 3
    for tag in ('div class="layout has-sidebar"', 'div class="no-sidebar"', 'div id="search"', 'div class="site"', "form"):
        assert extract(f"<body><{tag}><p>{text}</p><div class='ad'>buy this</div></{tag.split()[0]}></body>", WEIGHTS) == text.strip()
    page = f"<article><div class='overlay'><p>{text}</p></div><div class='ad'>buy this</div></article>"
    assert extract(page, WEIGHTS) == text.strip()


def test_formulas_are_text():
    page = "<article><p>we know that <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m tex</annotation></semantics></math> holds here</p></article>"
    assert extract(page, WEIGHTS) == "we know that E=m holds here"


def test_best_stretch_equals_trying_all():
    r = random.Random(7)
    for _ in range(300):
        v = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2, 4]) for _ in range(r.randint(0, 14))]
        a, b = best_stretch(v)
        sums = [sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)]
        assert sum(v[a:b]) == max([0, *sums])


def test_pages_without_an_article_equal_trying_all():
    r = random.Random(9)
    tags = ["<p>", "</p>", "<div>", "</div>", "<li>", "<a href='x'>", "</a>", "<br>", "<nav>", "</nav>"]
    for _ in range(60):
        page = "".join(r.choice(tags) if r.random() < 0.6 else " w" * r.randint(1, 4) + " " for _ in range(25))
        seq = pieces(page)
        v = scores(seq, WEIGHTS)
        best = max([0.0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])
        kept = len(extract(page, WEIGHTS).split())
        a, b = best_stretch(v)
        assert abs(sum(v[a:b]) - best) < 1e-9 and kept == sum(p.words for p in seq[a:b] if p.name is None and not p.out)


def test_odd_tags_take_linear_time():
    for page in ("<b>" * 200_000 + "words" + "</i>" * 200_000, "<b>" * 100_000 + "<br>" * 100_000, "<div class=sidebar>" * 50_000 + "some words here" + "</div>" * 50_000, "<p><b>" * 60_000 + "x", "<nav><article>" * 60_000 + "x"):
        began = time.time()
        extract(page, WEIGHTS)
        assert time.time() - began < 10
