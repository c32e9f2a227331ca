import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.llm import html_blocks as H, string_kernel as S, toxic_crf as T
from fieldledger.llm.common import fold

SYLLABLES = {"aa": "ka lo mi ru ten sha".split(), "bb": "öl bän grü stz pfe ich".split(), "cc": "ção ñez lla ió que".split()}


def text(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def test_language_held_out_and_cases(spark):
    draw = random.Random(1)
    rows = [(i, text(draw, lang, draw.randrange(5, 120)), lang) for i, lang in enumerate(draw.choices(sorted(SYLLABLES), k=400))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ..", "aa"), (1003, text(draw, "bb", 100_000), "aa"), (1004, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = S.train(docs, ~held_out)
    got = {r["doc_id"]: r for r in S.predict(docs, model).withColumn("h", held_out).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["h"]]
    assert len(held) > 60 and sum(a == b for a, b in held) >= .98 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert got[1004]["lang_pred"] == rows[0][2] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in S.predict(docs, S.train(docs, F.lit(False))).collect()} == {"und"}
    assert S.predict(docs.limit(0), model).count() == 0


def test_presence_is_that_of_the_text():
    seen, sizes = S.presence(S.code_points("abcab" * 300))
    assert list(sizes) == [512, 512, 476] and seen.max() == 1
    assert np.array_equal(S.presence(S.code_points("ABCAB"))[0], S.presence(S.code_points("abcab"))[0])


def chain_by_hand(logits, starts, step):
    """Marginals by listing all label sequences of each document."""
    out, a = [], 0
    edges = [*[i for i, s in enumerate(starts) if s], len(logits)]
    for a, b in zip(edges, edges[1:]):
        weight = {}
        for y in range(1 << (b - a)):
            bits = [y >> k & 1 for k in range(b - a)]
            s = sum(logits[a + k] for k, v in enumerate(bits) if v) + sum(step[u, v] for u, v in zip(bits, bits[1:]))
            weight[y] = np.exp(s)
        total = sum(weight.values())
        out += [sum(w for y, w in weight.items() if y >> k & 1) / total for k in range(b - a)]
    return out


def test_marginals():
    draw = np.random.default_rng(0)
    logits, step = draw.normal(size=40) * 2, draw.normal(size=(2, 2))
    starts = np.zeros(40, bool)
    starts[[0, 1, 9, 18, 19, 30]] = True
    for block in (1, 7, 256):
        assert np.allclose(T.marginals(logits, starts, step, block)[0], chain_by_hand(logits, starts, step))


def test_toxic_held_out_spans_and_cases(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        words = text(draw, draw.choice(sorted(SYLLABLES)), draw.randrange(20, 90)).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(["zorgface", "Zorghead,", "vilewort"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(1000, None), (1001, ""), (1002, "ka lo " * 50_000 + "zorgface!"), (1003, "ka lo " * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held_out)
    got = {r["doc_id"]: r for r in T.score(docs, model, spans=True).withColumn("h", held_out).collect()}
    held = [((got[i]["score"] >= .3), y == 1) for i, y in labels if got[i]["h"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= .98 * len(held)
    assert [got[i]["score"] >= .3 for i in (1000, 1001, 1002, 1003)] == [False, False, True, False]
    [span] = got[1002]["spans"]
    assert rows[702][1][span["begin"]:span["end"]] == "zorgface!" and got[1001]["spans"] == []
    assert {r["score"] for r in T.score(docs, None).collect()} == {0.0} and T.score(docs.limit(0), model).count() == 0


def page(title, body, extra=""):
    return (f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a>"
            f"</li><li><a href='/y'>News</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy this thing now</div><article><h1>{title}</h1>{body}"
            f"</article>{extra}<footer>&copy; site</footer></body></html>")


@pytest.fixture(scope="module")
def labeller():
    draw = random.Random(4)
    say = lambda n: text(draw, draw.choice(sorted(SYLLABLES)), n).capitalize() + "."
    return H.fit([page(say(4), "".join(f"<p>{say(draw.randrange(1, 60))}</p>" for _ in range(draw.randrange(1, 9)))) for _ in range(80)])


OTHER = """<body><div id="cookie-notice"><p>We use cookies on this site.</p></div><header><h1>Site</h1></header>
<div class="menu"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div><main><h1>The title</h1><p>First &amp; fore<b>most</b>
 paragraph<br>with a break<p>Unclosed &lt;second&gt; one<div class="advert"><p>Buy</p></div><ul><li>An item</ul></main>
<aside><p>You may also like this story</p></aside><section class="comments"><div class="comment"><p>Great article, thanks a lot.</p></div></section>
<form><label>Name</label><button>Send</button></form><footer><p>Imprint</p></footer>"""


def test_main_text(spark, labeller):
    rows = [(1, "u", page("A title", "<p>One.</p><p>Two  words\n here</p>", "<section class='comments'><p>I like it</p></section>"), "n"),
            (2, "u", OTHER, "n"), (3, "u", None, "n"), (4, None, "", "n"), (5, "u", "<p", "n"),
            (6, "u", page("Cut off", "<p>Text that ends &amp; " + "goes on " * 20_000)[:90_000], "n")]
    got = {r["page_id"]: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labeller).collect()}
    assert got[1]["text"] == "A title\n\nOne.\n\nTwo words here"
    assert got[2]["text"] == "The title\n\nFirst & foremost paragraph with a break\n\nUnclosed <second> one\n\nAn item"
    assert got[3]["text"] == got[4]["text"] == got[5]["text"] == "" and got[3]["n_chars"] == 0
    assert got[6]["text"].startswith("Cut off\n\nText that ends & goes on goes on") and got[6]["n_chars"] > 80_000
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = H.extract(pages, H.train(pages, most=60)).select("page_id", "text").collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got:
        assert r["text"] == "\n\n".join(b.text for b in H.parse(html[r["page_id"]]) if "article" in b.path)


def test_scripts_heads_and_nesting(labeller):
    script = '<script>var s="<body>"; evil()</script>'
    blocks = H.parse(f"<html><head><title>t</title>{script}<style>p {{}}</style><body><p>one{script}<p>two<style>a<body>b</style> three</p>")
    assert [(b.text, b.path) for b in blocks] == [("one", ("html", "body", "p")), ("two three", ("html", "body", "p"))]
    assert [b.text for b in H.parse("<head><title>t</title><p>in the body</p>")] == ["in the body"]
    assert [b.text for b in H.parse("<head><title>t</title><meta x></head>bare <b>text</b>")] == ["bare text"]
    for depth in (10, 3000):
        deep = H.parse("<div class='a b'>" * depth + "<ul><li>x" * 5 + "</p>y<li>z" * depth)
        assert len(deep) == 5 + 2 * depth - 1 or len(deep) == 1 + 2 * depth
        assert max(len(b.path) for b in deep) <= H.DEEPEST
    listed = H.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")
    assert [(b.text, len(b.path)) for b in listed] == [("a", 2), ("b", 4), ("c", 4), ("d", 2)]


def test_work_grows_with_the_length_of_a_deep_page():
    import time

    def seconds(n):
        start = time.perf_counter()
        H.parse("<div>" * n + "</p>x" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(40_000) for _ in range(3)) < 60 * min(seconds(4000) for _ in range(3))


def test_empty_table_of_pages(spark, labeller):
    pages = spark.createDataFrame([], "page_id long, url string, html string, n_chars string")
    assert H.extract(pages, labeller).count() == 0
    assert H.train(pages) is not None


def test_gradient():
    draw = np.random.default_rng(1)
    blocks = [[H.Block(("html", "body", "p"), "a b c", 0), H.Block(("nav", "li"), "x", 1), H.Block(("p",), "tail end.", 0)],
              [H.Block(("div", ".ad"), "buy", 0), H.Block(("p",), "w", 0)]]
    x, truth = H.inputs(blocks, H.Places()), np.array([1, 0, 1, 0, 1], np.float32)
    model = H.Model.new()
    model.values = {k: v.astype(float) for k, v in model.values.items()}

    def loss():
        p = H.probabilities(model, x)
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))

    grad = H.gradients(model, x, truth)
    for name in ("wf", "wb", "cf", "out"):
        flat, g = model.values[name].reshape(-1), grad[name].reshape(-1)
        for i in draw.integers(len(flat), size=6):
            was = flat[i]
            flat[i] = was + 1e-2
            up = loss()
            flat[i] = was - 1e-2
            down = loss()
            flat[i] = was
            assert g[i] == pytest.approx((up - down) / 2e-2, abs=2e-4)
