import html
import re
import time

import pytest

from trovelight.llm import crf
from trovelight.llm import html as H


def texts(*pages):
    return H.main_texts(list(pages), H.model())


def test_held_out_accuracy():
    rows, tags = H.labelled_blocks(120, seed=77)
    found = crf.decode(rows, H.model(), H.SLOTS)
    pairs = [(a, b) for x, y in zip(found, tags, strict=True) for a, b in zip(x, y, strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


def test_features_fill_the_slots():
    assert {len(f) for f in H.features(H.blocks("<article><p>a<p>b<ul><li>c<li>d</ul></article><footer>x"))} == {H.SLOTS}


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    model = crf.Model(("a", "b", "c"), {str(i): i for i in range(1, 9)}, rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    rows = [[[str(rng.integers(1, 9)), str(rng.integers(1, 12))] for _ in range(n)] for n in (1, 4, 0, 6, 4)]
    for row, found in zip(rows, crf.decode(rows, model, 2), strict=True):
        emit = [sum(model.weights[model.ids.get(f, 0)] for f in t) for t in row]
        score = lambda p: sum(e[k] for e, k in zip(emit, p, strict=True)) + model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(row)), key=score) if row else ()
        assert found == [model.labels[k] for k in best]


def test_given_pages_against_their_template(spark, folder):
    def plain(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inner))
        return "\n".join(p for p in parts if p)

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = {r.page_id: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == plain(r.html) and found[r.page_id].n_chars == len(plain(r.html)) and found[r.page_id].url == r.url


def test_other_layouts():
    page = """<html><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We use cookies here.</p></div>
    <main><article><h1>Big &amp; &#233;t&eacute;</h1><p>One  two
    three<br>four <i>five</i>.</p><aside><p>Read also this.</p></aside><p>Six.</p><script>x<y</script><!-- hidden -->
    <section class="comments"><p>First comment!</p></section></article></main><div class="sidebar"><p>Side text.</p></div><form><label>Name</label></form><footer>Foot</footer>"""
    assert texts(page) == ["Big & été\nOne two three four five.\nSix."]


BODY = "<article><h1>Some title</h1><p>One two three four five.</p><p>Six seven eight nine ten eleven.</p></article><footer>Foot here.</footer>"
TEXT = "Some title\nOne two three four five.\nSix seven eight nine ten eleven."


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>t</title>",
        "<html><head><title>t</title><meta charset=utf-8><link rel=x><script>var a</script><noscript><style>p{}</style></noscript> \n",
        "<html><head><head><title>t</title></head>",
        "<html><head><title>t</title><template><div>Hidden.</div></template>",
        "<html><head><title>t</title><noscript><img src=x></noscript></head>",
        "<html><title>t</title><style>p{}</style>",
        "<head><title>t</title></head>",
        "<html><head><title>t</title><body>",
    ],
)
def test_heads_left_open(start):
    assert texts(start + BODY) == [TEXT]


def test_text_ends_a_head():
    assert [b.text() for b in H.blocks("<html><head><title>t</title>Text &amp; more.<p>And this.</p>")] == ["Text & more.", "And this."]


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "where x=2 holds"),
        ("see <noscript>this picture of it</noscript> here", "see this picture of it here"),
        ("see <object data=x>the inner drawing</object> here", "see the inner drawing here"),
        ("hear <audio src=x>the spoken text</audio> here", "hear the spoken text here"),
        ("watch <video src=x>the short film</video> here", "watch the short film here"),
        ("see <canvas>the plotted line</canvas> here", "see the plotted line here"),
    ],
)
def test_elements_inside_the_article(inner, text):
    page = f"<html><head></head><body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>One two three {inner} four five.</p><p>Six seven eight.</p></article><footer>Foot</footer></body></html>"
    assert texts(page) == [f"Title of it\nOne two three {text} four five.\nSix seven eight."]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "&", "<!--", "<script>var a", "</p></p>", "<![CDATA[x]]>", "<a <b <c>", "<p>" * 3000, "<div>" * 2000 + "x"])
def test_odd_pages(page):
    assert isinstance(texts(page)[0], str)


def test_frames(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article><p>a b c d.</p></article>", "y"), (3, "u", "<article><p>a b c d.</p></article>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [tuple(r) for r in H.extract(pages).collect()] == [(1, None, "", 0), (2, "u", "", 0), (3, "u", "a b c d.", 8), (3, "u", "a b c d.", 8)]
    assert H.extract(pages.limit(0)).count() == 0


def test_deep_and_broken_pages_stay_linear():
    """A hundred thousand open tags, each with its own text, and as many end tags without a start."""
    start = time.perf_counter()
    deep = "".join(f"<div>text {i} here" for i in range(100_000))
    assert len(H.features(H.blocks(deep))) == 100_000
    broken = "<div>" * 50_000 + "x" + "</section></p></li>" * 50_000
    assert [b.text() for b in H.blocks(broken)] == ["x"]
    assert time.perf_counter() - start < 60
