import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm.html import Node, extract, main_text, measure, tree
from tarnflow.llm.langid import codes, fitted, gram_sets, has_letter, held_out, op8_language, predict, train, training_sample
from tarnflow.llm.neighbours import Codes, nearest, probes

# Nearest vectors.


def test_probes_cover_the_radius():
    for radius in (3, 8, 17):
        own = {p for p in range(256) if bin(p).count("1") <= radius // 8}
        assert set(probes(radius)) == own


def brute_nearest(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            s = sorted(((-float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in ok if i != q))[:k]
            out[q] = [(i, -c) for c, i in s]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    truth = brute_nearest(rows)
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(truth) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for i, _ in truth[q]} & {i for i, _ in got[q].values()}) for q in truth)
    assert hits >= 0.9 * 5 * len(truth)
    by_id = dict(rows)
    for q, g in got.items():
        for i, s in g.values():
            x, y = np.array(by_id[q]), np.array(by_id[i])
            assert abs(s - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, None]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<float>, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 6, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 6, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_beyond_k_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [0.0, 2.0]) for i in range(30, 20, -1)] + [(40, [3.0, 0.0]), (41, [1.0, 0.0, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, i + 1, 21 + i) for i in range(5)]


def test_codes_fit_short_vectors():
    x = np.random.default_rng(1).standard_normal((40, 3))
    assert len(Codes(x).of(x)) == 40


# Main text.

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><a href=/>Site</a></header><div id="main-menu"><ul><li><a href=a>one</a><li><a href=b>two</a></ul></div>
<div class="cookie-notice">We use cookies to make this site work and to learn how it is used by its readers.</div>
<div class="content"><h1>A title</h1><p>First <b>bold &amp; more</b>
 text,<br>second line. <a href=x>A link</a><p>Short.<ul><li>item one<li>item&nbsp;two</ul><div class="ad">buy now buy now</div>
<blockquote>Quoted &lt;words&gt; of some length that belong to it.</blockquote></div>
<aside>aside text aside text</aside><section id="comments"><p>A reader says a lot of things here, again and again and again.</p></section>
<form><p>subscribe</p></form><footer>&copy; all</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "A title\n\nFirst bold & more text, second line. A link\n\nShort.\n\nitem one\n\nitem two\n\nQuoted <words> of some length that belong to it."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a", "a"), ("<", "<"), ("<script>x", ""), ("<!-- <p>x</p>", ""), ("<nav>x</nav>", ""), ("<p>a<p>b</p>c", "a\n\nb\n\nc"), ("<div>" * 3000 + "x", "x")])
def test_odd_pages(page, text):
    assert main_text(page) == text


LONG = "This is a sentence of the article, which is long enough to count as text. " * 3
STORY = f"<article><p>{LONG}</p><p>Second. {LONG}</p></article>"


@pytest.mark.parametrize("name", ["page has-sidebar", "content no-sidebar", "entry share-enabled", "nav-open wrapper", "page sidebar", "banner", "comments-open"])
def test_marks_around_the_article_leave_it(name):
    for page in (f"<body><div class='{name}'>{STORY}</div></body>", f"<body><div class='{name}'><h1>A title</h1><p>{LONG}</p></div></body>", f"<body><div id='{name}'><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></body>"):
        assert LONG.strip() in main_text(page)


def test_marked_parts_of_an_article_stay():
    text = main_text(f"<body><article><p>{LONG}</p><p class='notice'>A notice of the author.</p><section class=discussion><p>We discuss this.</p></section><div class=share>Tell others</div></article></body>")
    assert "A notice of the author." in text and "We discuss this." in text and "Tell others" not in text


def test_comments_and_related_articles_go():
    rest = f"<section id=comments><article class=comment><p>{LONG * 5} says a reader</p></article></section><div class=related><article><p>Another page</p></article></div>"
    assert main_text(f"<body><main><h1>A title</h1>{STORY}{rest}</main></body>") == "\n\n".join(["A title", LONG.strip(), f"Second. {LONG.strip()}"])


def test_headline_and_second_article_belong_to_the_text():
    assert main_text(f"<body><main><h1>A title</h1>{STORY}</main></body>").startswith("A title\n\n")
    assert main_text(f"<body><div>{STORY}<article><p>Another part. {LONG}</p></article></div></body>").endswith(f"Another part. {LONG.strip()}")


def test_hidden_is_an_attribute_of_its_own():
    assert main_text(f"<body><div title='the hidden  hidden text'><p>{LONG}</p></div></body>") == LONG.strip()
    assert main_text(f"<body><div hidden><p>no</p></div><div aria-hidden=true>no</div><div style='display: none'>no</div><p>{LONG}</p></body>") == LONG.strip()


def test_frames_around_the_page_leave_it():
    text = main_text(PAGE)
    for name, attributes in (("form", "id=aspnetForm"), ("form", ""), ("fieldset", ""), ("aside", ""), ("header", "")):
        framed = PAGE.replace("<body>", f"<body><{name} {attributes}>").replace("</body>", f"</{name}></body>")
        assert framed != PAGE and main_text(framed) == text
    assert "Let x be" in main_text(f"<article><p>Let <math><mi>x</mi></math> be. {LONG}</p></article>")


def test_densities_equal_their_definition():
    """Each node's counts and densities anew, from all of its descendants."""
    root = tree(PAGE.replace("<form>", f"<div><a href=q>{LONG}</a><p>{LONG}</p></div><form>"))
    nodes = measure(root)

    def below(n):
        return [n, *(y for x in n.inside if isinstance(x, Node) for y in below(x))]

    def chars(n):
        return sum(len(t.strip()) for x in below(n) for t in x.inside if isinstance(t, str))

    def linked(n):  # characters below links, and links
        if n.tag == "a":
            return chars(n), 1 + sum(x.tag == "a" for x in below(n)[1:])
        own = [linked(x) for x in n.inside if isinstance(x, Node)]
        return sum(c for c, _ in own), sum(k for _, k in own)

    c_all, (l_all, _) = chars(root), linked(root)
    dense = {}
    for n in reversed(nodes):
        c, t, (lc, lt) = chars(n), max(len(below(n)) - 1, 1), linked(n)
        base = math.log(c * max(lc, 1) / max(c - lc, 1) + l_all / c_all * c + math.e) if c else 1
        dense[id(n)] = max(0.0, c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base) if c else 0.0
        children = [dense[id(x)] for x in n.inside if isinstance(x, Node)]
        assert n.density == pytest.approx(dense[id(n)]) and n.total == pytest.approx(sum(children) if children else dense[id(n)])
    assert sum(n.density > 0 for n in nodes) > 8


def test_density_alone_finds_the_article():
    """No article element, no class, id or role: lists of links and short lines are less dense than the body's threshold."""
    links = "".join(f"<li><a href=/{i}>Page number {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{i}. {LONG}</p>" for i in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><div><h1>A title</h1>{body}</div><div><ul>{links}</ul></div></div><div><a href=x>Imprint</a> <a href=y>Contact</a></div></body>"
    assert main_text(page) == "\n\n".join(["A title", *(f"{i}. {LONG.strip()}" for i in range(6))])
    assert main_text(page.replace("<div><h1>", "<article><h1>").replace("</p></div>", "</p></article>")) == main_text(page)


@pytest.mark.parametrize("page", [
    "<a" * 100_000, "<a \"" * 50_001, "<a '>" * 50_000, "<b>" * 50_000 + "</x>" * 50_000, "<nav>" + "<b>" * 50_000 + "</x>" * 50_000, "<b>" * 50_000 + "<p>x</p>" * 50_000,
    "<div>" * 30_000 + "<li>x" * 30_000, "<" * 200_000, "<!" * 100_000, "<script>" * 50_000,
], ids=range(10))
def test_malformed_pages_take_time_in_proportion(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 10


def test_extraction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    rows = sorted(extract(df).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.url, r.n_chars) for r in rows] == [(1, "u", len(main_text(PAGE))), (2, None, 0), (2, None, 0)]
    assert extract(df.limit(0)).count() == 0


# Language.


def text_of(rng, lang):
    parts = {"en": ["the", "and", "ing", "tion", "er", "of"], "de": ["und", "der", "sch", "ung", "ein", "ß"], "fr": ["les", "eau", "que", "é", "oi", "ç"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))


def test_kernel_scores_equal_brute_force():
    rng = random.Random(5)
    labelled = [(text_of(rng, g), g) for g in ("en", "de", "fr") for _ in range(30)]
    model = train(labelled, per_lang=8)
    marks = [t for g in sorted({"en", "de", "fr"}) for t in [t for t, x in labelled if x == g][:8]]
    texts = [text_of(rng, g) for g in ("en", "de", "fr") for _ in range(10)]
    for t, row in zip(texts, model.scores(texts)):
        a = set(gram_sets(t).tolist())
        k = np.array([len(a & set(gram_sets(m).tolist())) / np.sqrt(len(a) * len(gram_sets(m))) for m in marks])
        assert np.allclose(k @ model.weights, row, atol=1e-4)
    assert [model.langs[i] for i in model.scores(texts).argmax(1)] == [g for g in ("en", "de", "fr") for _ in range(10)]


def test_codes_are_the_bytes():
    assert codes(np.frombuffer(b"abc", np.uint8), 2).tolist() == [0x6162, 0x6263] and len(codes(np.zeros(1, np.uint8), 4)) == 0


def test_query_on_held_out_documents(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, text_of(rng, g), g, "s") for i, g in enumerate(rng.choice(["en", "de", "fr"]) for _ in range(300))]
    rows += [(1000, None, "en", None), (1001, "", "en", None), (1002, "12 $$", "en", None), (1003, "the and of", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op8_language(spark, str(tmp_path)).collect()}
    lang = {r[0]: r[2] for r in rows}
    held = [i for i in range(300) if out[i].held_out]
    assert 30 < len(held) < 130 and sum(out[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(7)
    rows = [(i, text_of(rng, "en"), "en") for i in range(40)] + [(100 + i, " ".join(text_of(rng, "de") for _ in range(120)), "de") for i in range(12)]
    df = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string")
    assert min(len(t) for _, t, g in rows if g == "de") > 8000
    sample = training_sample(df)
    assert len(sample) == len(set(sample)) and set(sample) == {(t, g) for _, t, g in rows}
    assert {r.doc_id: r.lang_pred for r in predict(df, fitted(df)).collect()} == {i: g for i, _, g in rows}


def test_signs_that_are_no_letters():
    assert not any(map(has_letter, ("", "½ ² ①", "12_3 ⅷ", "!?"))) and all(map(has_letter, ("½ a", "é", "字", "ªb")))


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text"), (None, None)], "doc_id long, text string")
    assert {r.lang_pred for r in predict(df, train([])).collect()} == {"und"}
    assert predict(df.limit(0), train([])).count() == 0
    assert df.select(held_out(F.col("doc_id"))).count() == 2
