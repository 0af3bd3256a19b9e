import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelight.functions import markup as H
from trovelight.functions import text as T
from trovelight.operators import enrichment as E

SAMPLES = [
    "Straße ÜBER Ünï_42 fôo",
    "  a b\tc\n\nd  ",
    "ΣΊΣΥΦΟΣ ﬁne ŉ ı İ ẞ Ꭰꭰ",
    "",
    "Какво е това? Yes! No. x.y",
    None,
]


def apply(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_casefold_matches_python(spark):
    values = [v for v in SAMPLES if v is not None]
    assert apply(spark, values, T.casefold) == [v.casefold() for v in values]


def test_tokenizers_stay_distinct(spark):
    values = [v or "" for v in SAMPLES]
    ascii_words = [re.findall("[a-z0-9]+", v.casefold()) for v in values]
    any_words = [[w.casefold() for w in re.findall(r"[^\W_]+", v)] for v in values]
    assert apply(spark, SAMPLES, T.tokenize_ascii) == ascii_words
    assert apply(spark, SAMPLES, T.tokenize_unicode) == any_words
    assert apply(spark, ["Straße", "Ünï_42 fôo"], T.tokenize_unicode) == [["strasse"], ["ünï", "42", "fôo"]]


def test_norms(spark):
    values = [v or "" for v in SAMPLES]
    squeezed = [re.sub(r"\s+", " ", v).strip() for v in values]
    assert apply(spark, SAMPLES, T.norm) == [v.casefold() for v in squeezed]
    assert apply(spark, SAMPLES, T.norm_lower) == [v.lower() for v in squeezed]
    assert apply(spark, ["A_b--C ß"], T.normalize) == ["a_b c ss"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_characters="\x00")), min_size=1, max_size=30))
def test_text_functions_on_latin_text(spark, values):
    assert apply(spark, values, T.norm) == [re.sub(r"\s+", " ", v).strip().casefold() for v in values]
    assert apply(spark, values, T.tokenize_unicode) == [
        [w.casefold() for w in re.findall(r"[^\W_]+", v)] for v in values
    ]


def test_terms(spark):
    found = apply(spark, ["The Услуга план plan-5 ab plan-5 brand"], lambda c: T.terms(c, ("brand",)))
    assert found == [["план", "plan-5"]]


def test_urls_and_titles(spark):
    assert apply(spark, ["https://x.y/bg/news/one?q=1", "https://x.y/bg"], T.category_for) == ["news", "other"]
    assert apply(spark, ["my first-page 2x"], T.title_case) == ["My First-Page 2X"]
    rows = spark.createDataFrame(
        [
            ('<meta property="og:title" content="A &amp; B | Site">', "u"),
            ("<title> C\n D </title>", "u"),
            ("", "https://x.y/a/some-page/"),
        ],
        "page string, url string",
    )
    titles = rows.select(H.fallback_title(F.col("page"), F.col("url"), " | Site").alias("t")).collect()
    assert [r.t for r in titles] == ["A & B", "C D", "Some Page"]
    both = spark.createDataFrame([("T", "T\n\n rest"), ("", "body"), ("X", "body")], "a string, b string")
    cut = both.select(T.drop_leading_title(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in cut] == ["rest", "body", "body"]


def test_salvage_json(spark):
    replies = ['<think>x</think>```json {"a":1} ```', 'noise {"a":2} tail', '{"a":3}', "[1]", "none", '{"a":']
    found = apply(spark, replies, lambda c: T.salvage_json(c, "a int"))
    assert [None if f is None else f.a for f in found] == [1, 2, 3, None, None, None]


def test_article_reader_quirks(spark):
    page = (
        "<html lang='bg'><main><article><h1>Big  <b>Title</b></h1><p>one</p>"
        "<nav>menu</nav><p>two<img src=x>lost</p>back"
        "<div class='share-buttons'>no</div></article><article>second</article></main></html>"
    )
    rows = spark.createDataFrame([(page,), ("<article>bare</article>",), (None,)], "h string")
    strict = [r.a for r in rows.select(H.extract_article()("h").alias("a")).collect()]
    assert (strict[0].title, strict[0].language) == ("Big Title", "bg")
    # a void tag hides text until the next closing tag; a sibling article is read too
    assert strict[0].raw == "\nBig  Title\none\ntwobacksecond"
    assert strict[1].raw == "" and strict[2].raw == ""
    loose = rows.select(H.extract_article(None)("h").alias("a")).collect()
    assert loose[1].a.raw == "bare"


def test_clean_text(spark):
    raw = ["\r\n a  b \t\n\n \n c ", "Submitted by admin  on 1 May\n\nText"]
    assert apply(spark, raw, H.clean_text) == ["a b\n\nc", "Text"]


def test_budgets_round_half_to_even(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 5, 7, 9, 11, 39, 41)], "n int")
    found = rows.select(E.unbounded_budget(F.col("n")).alias("u"), E.bounded_budget(F.col("n")).alias("b")).collect()
    assert [r.u for r in found] == [0, 0, 2, 2, 4, 4, 6, 20, 20]
    assert [r.b for r in found] == [5, 5, 5, 5, 5, 5, 6, 20, 20]


def test_score_clamp_and_fact_ids(spark):
    assert apply(spark, ["9", "0", "3", "x", None], E.score_1_to_5) == [5, 1, 3, 1, 1]
    rows = spark.createDataFrame([(["2", "0", "2", "-1", "x", "7"],)], "r array<string>")
    assert rows.select(E.valid_fact_ids(F.col("r"), F.lit(3)).alias("x")).first().x == [0, 2]
