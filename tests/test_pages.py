import pytest
from pyspark.sql import functions as F

from roleweave.functions import html as H
from roleweave.operators.pages import extract_pages, page_texts

LONG = "words about the work " * 8


@pytest.fixture
def page(one):
    return lambda markup, rules=H.PageRules(): tuple(one(H.main_text(F.col("x"), rules), x=markup))[::1]


def test_container_with_nested_noise(page):
    markup = (
        '<body><nav>menu</nav><div class="job-description">Start <script>var a="</p>";</script><b>bold</b>'
        '<div class="cookie-bar">no <div>inner</div> still no</div><p>unclosed ' + LONG + "</div><p>outside</p></body>"
    )
    text, step = page(markup)
    assert step == "container"
    assert text == ("Start bold unclosed " + LONG).strip()


@pytest.mark.parametrize(("n", "step"), [(99, "body"), (100, "container")])
def test_container_length_boundary(page, n, step):
    markup = f'<body><div class="posting">{"x" * n}</div><span>{"y" * 400}</span></body>'
    assert page(markup)[1] == step


def test_container_by_id_and_class_order(page):
    by_class = f'<div id="vacancy">{LONG}one</div><div class="job text">{LONG}two</div>'
    assert page(by_class)[0].endswith("two")
    assert page(f'<div id="vacancy">{LONG}one</div>')[0].endswith("one")


def test_vendor_container_replaces_a_short_one(page):
    markup = f'<div class="description">short</div><section class="adp-template">{"v" * 51}</section>'
    assert page(markup) == ("v" * 51, "vendor")
    markup = f'<div class="description">short</div><section class="adp-template">{"v" * 50}</section>'
    assert page(markup) == ("short", "container")


def test_headings_collect_sibling_elements_only(page):
    markup = (
        "<body><div><h2>Key Skills</h2> bare text <ul><li>one</li><li>two <b>x</b></li></ul><p>three</p>"
        "<h3>Other</h3><p>not this</p></div><p>nor this</p><div><strong>Duties</strong><p>four</p></div></body>"
    )
    assert page(markup) == ("one two x three four", "headings")


def test_blocks_in_order_without_repeats(page):
    same = "The same paragraph text. " * 6
    markup = (
        f"<body><p>{same}</p><p>{same}</p><p>{same} with another end</p><p>short</p><p>First <b>kept</b> paragraph<br>here"
        "<p>Second kept paragraph</p><ul><li>A list item of some length<li>Another &lt;item&gt; &amp; more</ul></body>"
    )
    text, step = page(markup)
    assert step == "blocks"
    assert text == " ".join(
        [same.strip(), same.strip() + " with another end", "short", "First kept paragraph here", "Second kept paragraph", "A list item of some length", "Another <item> & more"]
    )


def test_body_is_kept_whole(page):
    assert page(f"<html><body><span>{'z' * 10}</span></body></html>") == ("z" * 10, "body")
    assert page(f"<html><body><span>{'z' * 9000}</span></body></html>") == ("z" * 9000, "body")


def test_long_texts_and_paragraphs_are_kept_whole(page):
    assert page(f'<div class="posting">{"w" * 9000}</div>') == ("w" * 9000, "container")
    assert page(f"<body><p>{'a' * 2500}</p><p>{'b' * 130}1</p><p>{'b' * 130}2</p></body>")[0].split() == ["a" * 2500, "b" * 130 + "1", "b" * 130 + "2"]


def test_limits_can_be_set(page):
    rules = H.PageRules(max_chars=50, min_block_chars=3, max_block_chars=200, block_prefix=5)
    assert page(f'<div class="posting">{"w" * 900}</div>', rules)[0] == "w" * 50
    assert page(f"<p>ab<p>abcdef one<p>abcdef two<p>{'x' * 201}<p>{'other ' * 20}", rules)[0].startswith("abcdef one other other")


PARAGRAPH = "long text of the job " * 40


@pytest.mark.parametrize(
    "markup",
    [
        '<li class="share">a<li>b</ul><p>', '<p class="login">Sign in<p>', '<table><tr><td class="social">x<td>y</table><p>',
        '<article><p class="login"><b>Sign in<br><p>', '<dl><dt class="promo">x<dd class="promo">y</dl><p>', '<section><div class="share">never closed</section><p>', '<ul><li class="share">x</ul><p>',
    ],
)
def test_noise_without_an_end_tag_ends_with_its_place(page, markup):
    text, step = page(markup + PARAGRAPH)
    assert step == "blocks" and text.endswith(PARAGRAPH.strip()) and "Sign" not in text and "closed" not in text


def test_sections_end_with_their_parent(page):
    markup = f"<div><p><strong>Duties</strong><span>{LONG}</span></p><p>outside</p></div>"
    assert page(markup) == (LONG.strip(), "headings")


def test_container_and_sibling_without_end_tags(page):
    assert page(f'<ul><li class="posting">{LONG}<li>{LONG}no</ul>')[0] == LONG.strip()
    markup = f"<div><h2>Requirements</h2><p>{LONG}<p>two <b>bold</b> more<ul><li>a<li>b</ul><h2>Other</h2><p>no</div>"
    assert page(markup) == (f"{LONG}two bold more a b", "headings")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a &amp;lt; b", "a &lt; b"),
        ("&eacute;&#233;&#xe9;&#x1F600;", "ééé😀"),
        ("&unknown; & &#0;", "&unknown; & \ufffd"),
        ("We&apos;re &#146;so&#x92;", "We're ’so’"),
        ("a &amp b &ltc &notit;", "a & b <c ¬it;"),
        ("&hellip;&CounterClockwiseContourIntegral;&#x110000;&#169 x", "…∳\ufffd© x"),
        ("AT&T", "AT&T"),
        ("a&nbsp;b", "a\xa0b"),
    ],
)
def test_unescape(one, given, want):
    assert one(H.unescape(F.col("x")), x=given) == want


@pytest.mark.parametrize("markup", [None, "", "<!-- x -->", "<p>", "</div></p>"])
def test_broken_markup_yields_nothing(page, markup):
    assert page(markup) == ("", "none")


def test_extract_pages_and_page_texts(spark):
    rows = [("u", f'<div class="posting">{"a" * 150}</div>'), ("u", f'<div class="posting">{"b" * 200}</div>'), ("v", "")]
    got = extract_pages(spark.createDataFrame(rows, "job_link string, html string"))
    assert got.columns == ["job_link", "text", "step", "n_chars"]
    assert [tuple(r) for r in page_texts(got).collect()] == [("u", "b" * 200)]


def test_many_noise_elements(page):
    parts = "".join(f'<p>kept {i} text</p><div class="share">gone <b>{i}</b></div>' for i in range(300))
    text, step = page(f"<body>{parts}</body>")
    assert step == "blocks" and text.split() == [w for i in range(300) for w in ("kept", str(i), "text")]
