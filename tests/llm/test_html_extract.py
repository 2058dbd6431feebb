import random
import re

from tessera.llm import html_extract
from tessera.llm.html_extract import extract

LONG = "Some words that stand in the middle of a page and say what it is about, at some length."


def test_the_article_of_a_whole_page():
    page = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Title here</title><style>p{{margin:0}}</style><script>var t="</p>";go("<article>");</script></head>
    <body><div class="cookie-notice"><p>We use cookies. {LONG}</p></div><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad <p>7</p> --><div class="ad">Buy {LONG}</div>
    <article><header><h1>The   title &amp; more</h1></header><p>First &eacute; para<b>graph</b>.<br>Same block.</p><p>Open one <i>{LONG}
    <p>Next &#x41;&#66;&nbsp;c<aside>Aside {LONG}</aside><ul><li>item one<li>item two</ul><form><input value="x">Send {LONG}</form><table><tr><td>cell</td><td>other</td></tr></table><p>1 < 2 & 3 > 2</p>
    <section class="comments"><p>Reader: {LONG}</p></section></article>
    <div class="sidebar">Side {LONG}</div><footer>&copy; {LONG}</footer></body></html>"""
    assert extract(page).split("\n\n") == ["The title & more", "First é paragraph. Same block.", f"Open one {LONG}", "Next AB c", "item one", "item two", "cell", "other", "1 < 2 & 3 > 2"]


def test_pages_without_containers_or_ends():
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(4))
    want = "\n\n".join(f"{k} {LONG}" for k in range(4))
    assert extract(f"<html><body><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul>{body}<div id='footer'>Imprint</div>") == want
    assert extract(f"<div class='post-content'>{body}</div><div id='comments'>{body}</div>") == want
    assert extract(f"<main><p>{LONG}") == LONG
    assert extract(f'<main><p title="a > b" class="x">{LONG}</p></main>') == LONG


def test_odd_pages():
    assert extract(None) == extract("") == extract("<script>x") == extract("<nav>menu</nav>") == ""
    assert extract("<article><p>short</p></article>") == "short"
    assert extract("<article>" + "<b>" * 5000 + "deep" + "</article>") == "deep"
    assert extract("<p a=\"" * 2000) == ""
    long = " ".join(f"w{i}" for i in range(200_000))
    assert extract(f"<article><p>{long}</p></article>") == long


def test_generated_layouts():
    """Pages of another seed than the labelled ones: the words of the main pieces come out and no others."""
    shares = []
    for pieces in html_extract.labelled_pages(60, seed=77):
        want = set(re.sub(r"<[^>]*>", " ", " ".join(p for p, main in pieces if main)).split())
        got = set(extract("".join(p for p, _ in pieces)).split())
        shares.append(len(want & got) / len(want | got))
    assert sum(shares) / len(shares) > 0.95


def test_brute_force_of_the_scan():
    rng = random.Random(3)
    for _ in range(50):
        page = "<body>" + "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "word " * rng.randrange(1, 5), "<a>", "</a>", "<li>"]) for _ in range(25))
        score, _ = html_extract._scored(html_extract.tokenize(page), html_extract.weights())
        i, j, best = html_extract.best_region(score)
        most = max((sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=0)
        assert abs(best - max(most, 0)) < 1e-9 and abs(sum(score[i:j]) - best) < 1e-9


def test_the_weights_decide():
    """Words of main text score positive, tags negative; without the weights, or with others, other text comes out."""
    w = html_extract.weights()
    assert all(v < 0 for v in w.tags.values())
    page = f"<nav><p>Menu {LONG}</p></nav><article><h1>Title</h1><p>{LONG}</p><div class='ad'>{LONG}</div></article><footer>{LONG}</footer>"
    assert extract(page) == f"Title\n\n{LONG}"
    assert extract(page, html_extract.Weights(0.0, {}, {})) == ""
    assert "Title" not in extract(page, html_extract.Weights(-w.bias, {k: -v for k, v in w.features.items()}, w.tags))
    no_names = html_extract.Weights(w.bias, {k: v for k, v in w.features.items() if ":name:" not in k}, w.tags)
    assert extract(page, no_names) == f"Title\n\n{LONG}\n\n{LONG}"


def test_names_that_only_look_like_boilerplate():
    body = f"<p>{LONG}</p>" * 2
    want = f"{LONG}\n\n{LONG}"
    assert extract(f'<article><div class="post-header"><h1>Title</h1></div>{body}</article>') == f"Title\n\n{want}"
    for names in ('id="side-effects"', 'class="related-work"', 'id="comment-on-method"', 'class="notice-period"'):
        assert extract(f"<article><h1>Title</h1>{body}<section {names}><h2>Part</h2><p>{LONG}</p></section></article>") == f"Title\n\n{want}\n\nPart\n\n{LONG}", names
    for names in ('class="related-posts"', 'id="comments"', 'class="sidebar"', 'class="cookie-notice"', 'class="ad"', 'class="newsletter-signup"', 'class="shareButtons"', 'role="complementary"', "hidden"):
        assert extract(f"<article><h1>Title</h1>{body}<div {names}><p>{LONG}</p></div><p>End of it.</p></article>") == f"Title\n\n{want}\n\nEnd of it.", names
    assert extract(f"<article><div>{LONG}</div>{LONG}<br><br>and more</article>") == f"{LONG}\n\n{LONG} and more"
    assert extract(f"<body><div>{LONG}</div><div>{LONG}</div></body>") == want


def test_attributes_of_any_length():
    for n in (10, 70_000, 500_000):
        assert extract(f'<article><p>{LONG}</p><img alt="{"x > y class=ad " * (n // 15)}"><p title=\'{"<b>" * (n // 3)}\'>{LONG}</p></article>') == f"{LONG}\n\n{LONG}"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 9), (1, "u", "<article><p>a b</p></article>", 9), (2, None, None, 9), (None, "v", "", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_extract.extract_pages(spark, df).collect()), key=repr) == [(1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0), (None, "v", "", 0)]
    assert html_extract.extract_pages(spark, df.limit(0)).count() == 0
