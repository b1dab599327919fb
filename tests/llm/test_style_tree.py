"""Main texts: against the articles of the given pages, entropies by hand, templates without telling names, odd pages."""

import html
import math
import random
import re

from spanwise.llm import style_tree as st
from spanwise.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text int, n_chars string, host int, nodes int"


def test_query_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op4_style_tree"](spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S).group(1)
        article = html.unescape(re.sub(r"<[^>]*(?:>|$)", "", re.sub(r"</?(?:p|h1|br)>", " ", article)))
        assert (r.text, r.n_chars, r.url) == (" ".join(article.split()), len(r.text), pages[r.page_id].url)


def text_of(page):
    return " ".join(t for _, t, out in st.blocks_of(page)[0] if not out)


def test_blocks():
    assert text_of("<p>a<b>b</b>c &amp; d<br>e<p>f &lt;g&gt;\n h<ul><li>i<li>j</ul>") == "abc & d e f <g> h i j"
    assert text_of("<p>x<!-- <p>no</p> --><script>if (a<b) '</p>'</script>y</p><style>p{}</style><textarea>z</textarea>") == "xy"
    assert text_of("<div><form>a<p>b</form>c</div><p class='Comment-list x'>d</p><p id=sidebar>e</p><header>f</header><article><header>g</header></article>") == "c g"
    assert text_of("a < b <p title='x > y'>c</p></div></b> d <unclosed") == "a < b c d"
    assert text_of("") == "" and text_of("<") == "<" and text_of("plain") == "plain"


def test_importance_by_hand(spark):
    pages = [(i, f"<div><p>Same.</p><q-x>Own {i}.</q-x></div>") for i in range(10)]
    found = {r.node: r.importance for r in st.style_trees(spark.createDataFrame([("h", p) for _, p in pages], "host string, page string"), "host", "page").collect()}
    assert math.isclose(found[st._number("/div/p")], 0, abs_tol=1e-9)
    assert math.isclose(found[st._number("/div/q-x")], 1 - st.PRESENTATION, abs_tol=1e-9)


def test_templates_without_telling_names_are_removed(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(word() for _ in range(6)) + "." for _ in range(5)]
    rows, want = [], {}
    for i in range(400):
        body = [" ".join(word() for _ in range(12)) + "." for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            body.insert(0, lines[0])  # a sentence that many articles quote stays
        want[i] = " ".join(body)
        page = f"<body><div class=x{i}><div>{rng.choice(lines)}</div></div><section>{''.join(f'<p>{b}' for b in body)}</section><div>{rng.choice(lines)}</div></body>"
        rows.append((i, f"https://{'big' if i % 3 else f's{i % 40}'}.example/{i}", page, 1, "x", 1, 1))
    found = st.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.page_id: r.text for r in found} == want


def test_odd_rows(spark):
    rows = [(1, None, None, 1, "", 1, 1), (2, "not a url", "", 1, "", 1, 1), (None, "http://a.example", "<p>" + "long words " * 50_000, None, None, None, None),
            (3, "http://a.example/x", "<p>one</p>", 1, "", 1, 1), (3, "http://a.example/x", "<p>one</p>", 1, "", 1, 1), (4, "", "<nav>n</nav>", 1, "", 1, 1)]
    found = st.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 6 and by[1].text == by[2].text == by[4].text == "" and by[1].n_chars == 0
    assert by[None].n_chars == len("long words " * 50_000) - 1 and by[3].url == "http://a.example/x"
    assert st.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_of_frames_and_an_open_head():
    text = "The story of the page is told here at length."
    for page in (f"<body class='right-sidebar'><p>{text}</body>", f"<main class=no-sidebar><p>{text}</main>", f"<article class='post comment-enabled'>{text}</article>",
                 f"<div class='with-sidebar'><p>{text}</p></div><p class=sidebar>x</p>", f"<html><head><title>t</title><meta name=a><body><p>{text}</body></html>",
                 f"<head><title>t</title><p>{text}", f"<head><link rel=a><b>The</b>{text[3:]}"):
        assert text_of(page).removesuffix(" x") == text
    assert text_of(f"<body class=has-banner><p>{text}</p><div class=banner>no</div></body>") == text


def test_copied_pages_count_once(spark):
    rng = random.Random(1)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)) + "."
    texts = [say() for _ in range(150)]
    texts += [texts[0]] * 150
    rows = [(i, f"https://one.example/{i}", f"<body><div>Always here.</div><section><p>{t}</section></body>", 1, "x", 1, 1) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"https://same.example/{i}", f"<section><p>{texts[1]}</section>", 1, "x", 1, 1) for i in range(200)]
    found = {r.page_id: r.text for r in st.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {**dict(enumerate(texts)), **{1000 + i: texts[1] for i in range(200)}}


def test_every_page_has_a_row_and_copies_count_as_one(spark):
    """Pages of hosts without any text, null pages and urls; a host with half of its pages copied keeps its articles."""
    rows = [(1, "http://none.example/a", "<html><body><img src='x'></body></html>"), (2, "http://none.example/b", ""), (3, None, None)]
    rows += [(10 + i, "http://half.example/p", "<body><nav>Home About News</nav><article><p>%s</p></article></body>" % (
        "The one article that half of the pages show, word for word." if i % 2 else f"Page {i} tells of number {'abcdefghij'[i % 10] * (2 + i)} alone. And more of {i}.")) for i in range(60)]
    found = st.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == 63 and texts[1] == texts[2] == texts[3] == ""
    assert all(texts[10 + i].startswith("The one article" if i % 2 else f"Page {i} tells") and "Home" not in texts[10 + i] for i in range(60))
