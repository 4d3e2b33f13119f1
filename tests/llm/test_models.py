"""op1, op5, op7, op9: held-out accuracy, recall against brute force, and small pages."""

import random

import numpy as np
import pytest

from emberline.llm import cross_polytope, html_text, language_id, toxicity


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !?", "de"), (None, "the and of", None), (-5, "x" * 200_000, None)], docs.schema)
    out = language_id.identify_documents(docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert len(out) == docs.count() + 5
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.93
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 and not by_id[k]["accepted"] for k in (-1, -2, -3))
    assert by_id[-5]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in out)


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify_documents(docs).collect()} == {"und"}
    assert language_id.identify_documents(docs.limit(0)).count() == 0


def brute(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 100 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            own = np.flatnonzero(ids != ids[q])
            best = own[np.lexsort((ids[own], d[own]))][:k]
            out[int(ids[q])] = list(zip(ids[best].tolist(), d[best].tolist(), strict=True))
    return out


@pytest.mark.parametrize("scales", [False, True])
def test_neighbours_recall(spark, scales):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    x = centres[rng.integers(0, 8, 1200)] + 0.9 * rng.normal(size=(1200, 64))
    x *= rng.uniform(0.5, 2, size=(1200, 1)) if scales else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    x[300:700] = x[300]  # a bucket with a third of the rows
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5100, []), (5200, [0.0] * 64), (5300, [float("nan")] * 64), (5400, [None] * 64), (5500, [1.0] * 3), (None, [1.0] * 64)]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>")
    vectors = cross_polytope.usable(frame, "vec_id", "embedding")
    found = cross_polytope.nearest_neighbours(vectors.where("id % 100 = 0"), vectors).collect()
    wanted, got = brute(rows), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(wanted)
    assert all([r for *_, r in own] == list(range(1, 11)) for own in got.values())
    assert np.mean([len({v for v, *_ in got[q]} & {v for v, _ in own}) / 10 for q, own in wanted.items()]) >= 0.9
    exact = {(q, v): d for q, own in wanted.items() for v, d in own}
    assert all(abs(exact[q, v] - d) < 1e-9 for q, own in got.items() for v, d, _ in own if (q, v) in exact)
    assert [v for v, *_ in got[400]] == [v for v, _ in wanted[400]]  # among copies: the smallest ids


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_given_vectors(spark, scale):
    vectors = cross_polytope.usable(spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet"), "vec_id", "embedding")
    table = vectors.toPandas()
    ids, x = table["id"].to_numpy(), np.array(table["vector"].tolist(), dtype=np.float64)
    square = (x * x).sum(axis=1)
    distance = square[:, None] - 2 * x @ x.T + square
    np.fill_diagonal(distance, np.inf)
    wanted = {int(i): set(ids[best].tolist()) for i, best in zip(ids, np.argsort(distance, axis=1)[:, :10], strict=True)}
    found = cross_polytope.nearest_neighbours(vectors, vectors).toPandas().groupby("query_id")["vec_id"].agg(set)  # every row is a query
    share = {i: len(found[i] & own) / 10 for i, own in wanted.items()}
    assert np.mean(list(share.values())) >= 0.92
    assert np.mean([v for i, v in share.items() if i % 100 == 0]) >= 0.9


def test_neighbours_of_few_and_none(spark):
    frame = spark.createDataFrame([(100, [1.0, 2.0]), (200, [2.0, 1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    vectors = cross_polytope.usable(frame, "vec_id", "embedding")
    found = cross_polytope.nearest_neighbours(vectors.where("id % 100 = 0"), vectors, probes=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(100, 3), (100, 200), (200, 3), (200, 100)]
    none = cross_polytope.usable(frame.limit(0), "vec_id", "embedding")
    assert cross_polytope.nearest_neighbours(none, none).count() == 0


ARTICLE = "The first paragraph of the story is long enough to be content, with commas and all."
PAGES = {
    "plain article": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no'</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        f"<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>{ARTICLE}<p>Second\n  para &#233;&nbsp;x<br>more <b>bold<p>Third</article><footer>© me</footer></body></html>",
        f"Head & line\n{ARTICLE}\nSecond para é x more bold\nThird",
    ),
    "no article element": (
        f"<body class='has-sidebar'><header><h2>Site</h2></header><div id=content><p>{ARTICLE}</p><p>{ARTICLE} Again.</p><p>Short.</p></div>"
        "<div id='side-bar' class='sidebar'><p>Links links links</p></div><div class='comments'><p>I think that this reader comment is rather long too, as they are.</p></div></body>",
        f"{ARTICLE}\n{ARTICLE} Again.\nShort.",
    ),
    "wrapped in a form and named wrapper": (
        f"<form><div class='page-with-menu'><main><p>{ARTICLE}</p><aside>Aside</aside><form><input>Sign up</form><div role='alert'>Notice</div>"
        "<section id=comments><p>A comment</p></section><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table></main></div></form>",
        f"{ARTICLE}\nOne\nTwo\na\nb",
    ),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<div><img src=x></div>", ""),
    "bare text": ("just text", "just text"),
    "only a menu": ("<nav>menu</nav>", ""),
    "unclosed script": ("<article><p>Words here</p><script>var x = 1;", "Words here"),
    "long": ("<article>" + "<p>word word word</p>" * 5000 + "</article>", "\n".join(["word word word"] * 5000)),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_pages(spark):
    rows = [(k, f"u{k}", p, "clash") for k, (p, _) in enumerate(PAGES.values())] + [(None, None, "<p>x</p>", "")]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {**{k: (f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES.values())}, None: (None, "x", 1)}
    assert html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def toxic_corpus():
    rng = random.Random(1)
    words, insults = [f"word{k}" for k in range(500)], ["oaf", "lout", "cretinous", "cretinish", "vermin"]
    docs, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        kind = "toxic" if k % 5 == 0 else "junk" if k % 7 == 0 else "clean"
        if kind == "toxic":
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(insults))
        if kind == "junk":
            text = [f"{w}!!" for w in text[:3]] * 20
        docs.append((k, " ".join(text), "en", kind))
        labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    rows = [*docs, (1000, None, "en", "clean"), (1001, "", "en", "clean"), (None, "word1 word2", "en", "clean"), (1002, "word3 " * 30000 + "oaf lout vermin cretinous", "en", "toxic"), (1003, "what a cretinly lout and OAF", "en", "toxic")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string")
    known = spark.createDataFrame([*labels[:400], (0, None, 1), (None, 1, 1), (9999, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(frame, known)
    assert kept.columns == frame.columns
    kept = {(r["doc_id"], r["text"]) for r in kept.collect()}
    wrong = [r for r in rows if ((r[0], r[1]) in kept) == (r[3] == "toxic")]
    assert not [r for r in wrong if r[0] is None or r[0] >= 1000] and len(wrong) <= 3


def test_form_reads_long_texts_whole():
    assert toxicity.form("aB" * 2000)[3] == toxicity.form("aB" * 10)[3] == 0.5


def test_toxicity_without_labels(spark):
    docs, _ = toxic_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(frame, none).count() == len(docs)
    assert toxicity.without_toxic(frame.limit(0), none).count() == 0


def test_chain_uses_earlier_probabilities(spark):
    docs, labels = toxic_corpus()
    chain = toxicity.fit(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    sizes = [len(w) - len(chain.terms) for w in chain.weights]
    assert [b - a for a, b in zip(sizes, sizes[1:], strict=False)] == [1, 1]


def test_language_sample_counts_distinct_ids(spark, monkeypatch):
    few = [(k, f"{w} {w}a", lang) for k, (w, lang) in enumerate([("und das ist", "de"), ("the and of", "en")] * 10)]
    hot = [(500, f"the word {k}", "en") for k in range(4000)]  # one id on most rows
    labelled = spark.createDataFrame([*few, *hot], "doc_id long, text string, label string")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda rows: seen.append(rows))
    language_id.fit(labelled, 100)
    assert len(seen[0]) == 21 and set(seen[0]["label"]) == {"de", "en"}


def test_toxicity_sample_counts_distinct_ids(spark, monkeypatch):
    rows = [(k, "vile hateful words" if k % 2 else "kind words", k % 2) for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(7, f"vile {k}") for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, toxic) for k, _, toxic in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, chosen: seen.append(rows))
    toxicity.fit(docs, labels, 100)
    assert len(seen[0]) == 20 and sum(seen[0]["toxic"]) == 10


LONG = "Buy our great new thing today, as it is cheap and good. " * 8


@pytest.mark.parametrize("times", [1, 2, 4, 8])
def test_adverts_and_comments_go_however_long_they_are(times):
    short = "<h2>Short</h2><p>Dear all.</p><ul><li>One thing</li><li>Two things</li></ul>"
    assert html_text.main_text(f"<article>{short}<div class='advert'><p>{LONG * times}</p></div></article>") == "Short\nDear all.\nOne thing\nTwo things"
    comments = f"<section class='comments'><p>{LONG * times}</p></section>"
    assert html_text.main_text(f"<article><p>A short paragraph.</p><p>Another one.</p>{comments}</article>") == "A short paragraph.\nAnother one."
    assert html_text.main_text(f"<body><div id='comments-list'><p>{LONG}</p></div></body>") == LONG.strip()  # there is no other text


@pytest.mark.parametrize("name", ["no-sidebar", "post-header", "with-comments", "entry-reply-count", "article-header", "content ad"])
def test_names_that_only_touch_such_words_drop_nothing(name):
    page = f"<body><div class='{name}'><p>A paragraph of some words, rather short.</p><p>{LONG}</p></div><div>Site</div></body>"
    assert html_text.main_text(page) == f"A paragraph of some words, rather short.\n{LONG.strip()}"


@pytest.mark.parametrize(
    "own, beside",
    [
        ([20, 12, 12, 25, 40, 30, 25, 20], [1, 2, 1, 1, 1, 2, 20, 1, 1]),
        ([25, 12, 12, 30, 20], [1, 2, 1, 1, 1, 2, 15, 2, 1]),
        ([20, 30, 40, 20, 20], [1, 1, 1, 2, 1, 1, 20, 1]),
        ([3, 12, 20, 25, 20, 30], [2, 2, 1, 1, 18, 2, 1]),
    ],
)
def test_smoothing_decides(monkeypatch, own, beside):
    """One long teaser among short ones: a dense line without dense neighbours is no content."""
    words = "the river ran past an old mill where nobody had lived for years and then one day somebody came back to open all its doors".split()
    sentence = lambda n, k: " ".join(words[(j + k) % len(words)] for j in range(n)).capitalize() + "."
    content = [sentence(n, k) for k, n in enumerate(own)]
    teasers = [sentence(n, 3 * k) for k, n in enumerate(beside)]
    page = "<body><div>" + "".join(f"<div><span>{x}</span></div>" for x in teasers) + "</div><div>" + "".join(f"<p>{x}</p>" for x in content) + "</div></body>"
    assert html_text.main_text(page) == "\n".join(content)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios)
    assert html_text.main_text(page) != "\n".join(content)
