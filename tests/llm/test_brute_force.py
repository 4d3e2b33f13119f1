"""op1, op5, op7, op8 and op9 against plain versions of themselves, and their edge cases."""

import random
import re
import time

import numpy as np
import pytest

from emberline.llm import cross_polytope, decontaminate, html_text, language_id, toxicity
from emberline.llm.textkit import mix64
from emberline.session import Scratch
from tests.llm.test_models import ARTICLE, brute, toxic_corpus

# op1


def subwords_by_hand(text):
    out = []
    text = "".join(c if c.isalpha() else " " for c in text.lower() + " ")
    for n in range(1, language_id.LONGEST + 1):
        for k in range(len(text) - n + 1):
            run = text[k : k + n]
            if " " not in run[1:-1] and (run[0] != " " or run[-1] != " "):  # word ends are marked by a space
                key = 0
                for c in text[k : k + n]:
                    key = (key * 0x100000001B3 + ord(c)) % 2**64
                out.append(int(mix64(np.array([key], dtype=np.uint64), n)[0]) % language_id.BUCKETS)
    return sorted(out)


def test_subwords_also_of_texts_that_are_cut(monkeypatch):
    texts = ["Ab c", "", "x", "Ünïcode? 12 ab34cd", "straßE " * 9, "!?"]
    for piece in (1 << 18, 7, 1):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = [[] for _ in texts]
        for row, bucket in language_id.subwords(texts):
            for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                got[r].append(b)
        assert [sorted(g) for g in got] == [subwords_by_hand(t) for t in texts]


def test_prediction_is_the_average_of_subword_scores():
    rng = np.random.default_rng(5)
    model = language_id.Model(["a", "b", "c"], rng.normal(size=(language_id.BUCKETS, 3)), rng.normal(size=3), 0.7)
    texts = ["one two", "THREE", "", "4"]
    languages, scores, _ = model.predict(texts)
    for text, language, score in zip(texts, languages, scores, strict=True):
        own = subwords_by_hand(text)
        if not own:
            assert (language, score) == ("und", 0)
            continue
        z = (model.table[own].mean(axis=0) + model.bias) / 0.7
        p = np.exp(z) / np.exp(z).sum()
        assert language == "abc"[int(p.argmax())] and abs(score - p.max()) < 1e-9


def test_language_ties_repeated_rows_and_columns_named_like_outputs(spark):
    docs = spark.createDataFrame([(1, "aaa", "x"), (1, "aaa", "x"), (2, "aaa", "w"), (3, None, "x")], "doc_id long, text string, lang string")
    out = language_id.identify_documents(docs).collect()
    assert len(out) == 4 and len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] != 3}) == 1
    model = language_id.Model(["p", "q"], np.zeros((language_id.BUCKETS, 2)), np.zeros(2))
    assert model.predict(["tie"])[0] == ["p"]
    named = docs.selectExpr("doc_id", "text", "lang as label")
    assert language_id.identify(named, model).count() == 4


# op5


@pytest.mark.parametrize("dimensions", range(1, 9))
def test_neighbours_in_few_dimensions(spark, dimensions):
    x = np.random.default_rng(dimensions).normal(size=(220, dimensions)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    vectors = cross_polytope.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    found = cross_polytope.nearest_neighbours(vectors.where("id % 100 = 0"), vectors).collect()
    wanted = brute(rows)
    got = {q: {r["vec_id"] for r in found if r["query_id"] == q} for q in wanted}
    assert all(len(g) == 10 for g in got.values())
    assert np.mean([len(got[q] & {v for v, _ in own}) / 10 for q, own in wanted.items()]) >= 0.9


def test_few_vectors_are_all_found_and_repeated_ids_are_vectors_each(spark):
    x = np.random.default_rng(2).normal(size=(6, 64)).astype(np.float32)
    rows = [(100 * k, v.tolist()) for k, v in enumerate(x)] + [(100, x[4].tolist()), (100, x[1].tolist())]
    vectors = cross_polytope.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    found = cross_polytope.nearest_neighbours(vectors, vectors).collect()
    by_query = {q: sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q) for q in range(0, 600, 100)}
    assert {v for _, v in by_query[0]} == {100, 200, 300, 400, 500} and all(q not in {v for _, v in own} for q, own in by_query.items())


def test_axes_come_nearest_first_and_no_more_than_there_are():
    x = np.random.default_rng(0).normal(size=(5, 4))
    assert cross_polytope.axes(x, 3, 24).shape == (5, 8)
    for few in (2, 5):
        assert (cross_polytope.axes(x, 3, few) == cross_polytope.axes(x, 3, 24)[:, :few]).all()


def test_a_query_ranks_well_below_half_of_the_rows():
    x = np.random.default_rng(1).normal(size=(4000, 64))
    unit = cross_polytope.on_sphere(x / np.linalg.norm(x, axis=1, keepdims=True), 1.0)
    met = np.zeros((40, 4000), dtype=bool)
    for t in range(cross_polytope.TABLES):
        own = cross_polytope.axes(unit, t, 1)[:, 0]
        for k, few in enumerate(cross_polytope.axes(unit[:40], t, cross_polytope.probes_for(64))):
            met[k] |= np.isin(own, few)
    assert met.mean() < 0.35


# op7

P = f"<p>{ARTICLE}</p>"


@pytest.mark.parametrize("name", ["layout no-sidebar", "post-header", "content with-comments", "entry-reply-count"])
def test_names_are_no_veto(name):
    assert html_text.main_text(f"<html><body><div class='{name}'>{P}</div></body></html>") == ARTICLE


KEPT = {
    "title in an article's own header": (f"<body><article><div class='article-header'><h1>Title</h1></div>{P}</article></body>", ["Title", ARTICLE]),
    "a list that holds most": (f"<body><div><p>intro</p><ul>{'<li>one of many words in a list</li>' * 9}</ul><p>closing</p></div></body>", ["intro", *["one of many words in a list"] * 9, "closing"]),
    "all articles of main": (f"<main><article>{P * 3}</article><article>{P}</article></main>", [ARTICLE] * 4),
    "no names at all": (
        f"<div><div><a href=1>First</a></div><div><a href=2>Second</a></div><div><a href=3>Third</a></div></div><div><h1>T</h1>{P * 3}<p>End.</p></div><div><a href=4>Imprint</a> 2020</div>",
        ["T", *[ARTICLE] * 3, "End."],
    ),
    "reader comments after an article": (f"<div id=content>{P * 4}<div class='comment-list'><p>{'I like it a lot, I do. ' * 4}</p></div></div>", [ARTICLE] * 4),
    "an advert within": (f"<article>{P}<div class=ad-slot>Buy this now</div>{P}</article>", [ARTICLE] * 2),
}


@pytest.mark.parametrize("name", KEPT)
def test_regions(name):
    page, lines = KEPT[name]
    assert html_text.main_text(page) == "\n".join(lines)


def test_ratios_decide(monkeypatch):
    page = KEPT["no names at all"][0]
    before = html_text.main_text(page)
    monkeypatch.setattr(html_text, "line_ratios", lambda lines, evidence: np.ones(len(lines)))
    assert html_text.main_text(page) != before


def test_smoothing_and_clusters_by_hand():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        ratios = rng.exponential(10, n) * rng.integers(0, 2, n)
        smooth = []
        for i in range(n):
            near = [(np.exp(-((i - j) ** 2) / (2 * html_text.SIGMA**2)), ratios[j]) for j in range(n) if abs(i - j) <= html_text.REACH]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert np.allclose(html_text.smoothed(ratios), smooth)
        least = min(np.mean(smooth), np.median(smooth) + np.std(smooth))
        clusters, last = [], None
        for i, s in enumerate(html_text.smoothed(ratios)):
            if s >= least or np.isclose(s, least):
                clusters = clusters if last == i - 1 and clusters else [*clusters, []]
                clusters[-1].append(i)
                last = i
        weights = [sum(ratios[i] for i in c) for c in clusters]
        dense = {i for c, w in zip(clusters, weights, strict=True) if w >= html_text.HEAVY * max(weights) for i in c}
        assert set(np.flatnonzero(html_text.dense_lines(ratios)[0]).tolist()) == dense


def test_depth_costs_no_more_than_length():
    began = time.process_time()
    assert html_text.main_text("<div>" * 100_000 + "text") == "text"
    assert html_text.main_text("<article>" + "<b>" * 50_000 + "</div>" * 50_000 + "<li>" * 50_000 + "text") == "text"
    assert time.process_time() - began < 15


def test_repeated_pages(spark):
    rows = [(1, "u", f"<article>{P}</article>")] * 3 + [(1, "u", None)]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in out) == ["", ARTICLE, ARTICLE, ARTICLE]


# op8


def planted(rng, n_items=30, n_docs=150):
    vocabulary = [f"word{k}" for k in range(4000)]
    often = vocabulary[:60]
    make = lambda n: [rng.choice(often if rng.random() < 0.3 else vocabulary) for _ in range(n)]
    items = [(f"i{k}", " ".join(make(26)) + ". " + " ".join(make(8)) + ".") for k in range(n_items)]
    docs, where = [], {}
    for k in range(n_docs):
        words = make(rng.randint(60, 300))
        if k % 3 == 0:
            item = k // 3 % n_items
            own = [w for w in items[item][1].replace(".", "").split() if rng.random() >= 0.2]
            own = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in own]
            at = rng.randrange(len(words))
            words[at:at] = own
            where[k] = item
        docs.append((k, " ".join(words), "clash"))
    return items, docs, where


def test_rewordings_are_found_by_latent_cosines(spark):
    items, docs, where = planted(random.Random(8))
    frame = spark.createDataFrame(docs, "doc_id int, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(frame, benchmark).collect()}
    wanted = {(k, f"i{i}") for k, i in where.items()}
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found - wanted) <= 2


def by_hand(spark, docs, items):
    """Exact vectors and a full decomposition; and cosines of all passages of all documents with all items."""
    hashes = [decontaminate._hashes(t) for _, t, *_ in docs]
    features = [decontaminate._features(h) for h in hashes]
    blocks = [(d, lo) for d, f in enumerate(features) for lo in range(0, len(f), decontaminate.BLOCK)]
    counts = np.zeros(decontaminate.FEATURES)
    for d, lo in blocks:
        counts[np.unique(features[d][lo : lo + decontaminate.BLOCK])] += 1
    weights = np.log1p((len(blocks) + 1) / (counts + 1))
    vector = lambda f: np.bincount(f, weights=weights[f], minlength=decontaminate.FEATURES)
    passages = [features[d][lo : lo + 2 * decontaminate.BLOCK] for d, lo in blocks]
    return weights, vector, passages, [decontaminate._features(decontaminate._hashes(t)) for _, t in items]


def test_space_and_cosines_against_a_full_decomposition(spark):
    items, docs, _ = planted(random.Random(3), 20, 60)
    weights, vector, passages, own = by_hand(spark, docs, items)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    corpus = decontaminate.read_corpus(frame, Scratch(spark, "test"))
    assert np.allclose(corpus.weights, weights, rtol=1e-5)
    sample = [np.frombuffer(r["passage"], dtype=np.int32) for r in corpus.sample.collect()]
    assert sorted(map(bytes, sample)) == sorted({p.tobytes() for p in passages})  # a small corpus is taken whole, each text once
    rank = 24
    assert rank < len(sample) / 5
    space = decontaminate.build_space(spark, list(enumerate(own)), corpus, len(sample), rank)
    unit = lambda f: (v := vector(f)) / np.linalg.norm(v)
    matrix = np.array([unit(p) for p in sample] + [unit(p) * np.sqrt(len(sample) / len(own)) for p in own])
    used = np.flatnonzero(matrix.any(axis=0))
    _, _, right = np.linalg.svd(matrix[:, used], full_matrices=False)
    exact = right[:rank].T
    found = space.basis[used] / weights[used, None]
    energy = lambda basis: (np.linalg.norm(matrix[:, used] @ basis) ** 2)
    assert space.basis.shape[1] == rank and energy(found) >= 0.97 * energy(exact)
    # Latent cosines aren't those of the TF-IDF vectors: the space holds less than these do.
    latent = np.array([space.basis[p].sum(axis=0) for p in passages])
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    plain = np.array([unit(p) for p in passages]) @ np.array([unit(p) for p in own]).T
    assert np.abs(latent @ space.passages.T - plain).mean() > 0.05


def test_the_decomposition_is_of_all_passages(spark):
    n = 40_000  # more than any sample of it would hold
    texts = [" ".join([*(f"group{k % 50}word{j}" for j in range(decontaminate.BLOCK - 1)), f"own{k}"]) for k in range(n)]
    corpus = decontaminate.read_corpus(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "test"))
    assert corpus.size == n and corpus.sample.count() > 0.95 * n  # of hashed words a few are alike
    directions = np.zeros((decontaminate.FEATURES, 50))
    met = np.zeros(50)
    for g in range(50):
        at, times = np.unique(decontaminate._features(decontaminate._hashes(texts[g]))[:-1], return_counts=True)
        directions[at, g] = times * corpus.weights[at]
        directions[:, g] /= np.linalg.norm(directions[:, g])
    for k, t in enumerate(texts):
        at, times = np.unique(decontaminate._features(decontaminate._hashes(t)), return_counts=True)
        vector = times * corpus.weights[at]
        met[k % 50] += (vector @ directions[at, k % 50] / np.linalg.norm(vector)) ** 2
    assert np.allclose(((corpus.leading.T @ directions) ** 2).sum(axis=0), met, rtol=0.02)


def test_products_with_all_passages_by_hand(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(rng.choice([0, 3, 24, 25, 48, 200]))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    weights = np.random.default_rng(1).uniform(0.7, 9, decontaminate.FEATURES).astype(np.float32)
    directions = np.random.default_rng(2).standard_normal((decontaminate.FEATURES, 5)).astype(np.float32)
    wanted = np.zeros((decontaminate.FEATURES, 5))
    for t in texts:
        feature = decontaminate._features(decontaminate._hashes(t or ""))
        for lo in range(0, len(feature), decontaminate.BLOCK):
            at, times = np.unique(feature[lo : lo + 2 * decontaminate.BLOCK], return_counts=True)
            vector = times * weights[at] / np.linalg.norm(times * weights[at])
            wanted[at] += np.outer(vector, vector @ directions[at])
    found = decontaminate.times_passages(docs, weights, directions)
    assert np.allclose(found, wanted, rtol=1e-3, atol=1e-3 * np.abs(wanted).max())


def test_candidates_against_all_cosines(spark):
    items, docs, _ = planted(random.Random(4), 12, 40)
    weights, _, _, own = by_hand(spark, docs, items)
    corpus = decontaminate.read_corpus(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), Scratch(spark, "test"))
    space = decontaminate.build_space(spark, list(enumerate(own)), corpus, corpus.sample.count(), 16)
    import pyarrow as pa

    words = decontaminate._words(pa.array([t for _, t, _ in docs]))
    start, first = decontaminate._blocks(words)
    feature = decontaminate._features(words.hashes)
    got = {(b, p) for b, p, _ in decontaminate._near(space, feature, start, decontaminate._follows(first, len(start)))}
    wanted, close = set(), set()
    block = 0
    for d in range(len(docs)):
        mine = feature[words.first[d] : words.first[d + 1]]
        for lo in range(0, len(mine), decontaminate.BLOCK):
            x = space.basis[mine[lo : lo + 2 * decontaminate.BLOCK]].sum(axis=0)
            for p, cosine in enumerate(space.passages @ x / np.linalg.norm(x)):
                if cosine >= decontaminate.COSINE:
                    wanted.add((block, p))
                if abs(cosine - decontaminate.COSINE) < 1e-4:
                    close.add((block, p))
            block += 1
    assert wanted and wanted - close == got - close


def test_repeated_items_null_ids_and_ties(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    item = make(20)
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, None), (4, "!?")], "item_id int, text string")
    docs = spark.createDataFrame([("a", f"{make(9)} {item}"), (None, item), ("b", make(50)), ("c", "")], "doc_id string, text string")
    found = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.find_items(docs, benchmark).collect())
    assert found == sorted((d, i) for d in ("a", "None") for i in ("1", "1", "2", "None"))


# op9


def test_scores_by_hand(spark):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    chain = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for _, text, *_ in docs[:40]:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        own = words | {w[:5] + "*" for w in words if len(w) > 5}
        earlier = []
        for w in chain.weights:
            z = sum(w[k] for t, k in chain.terms.items() if t in own)
            z += float(np.dot(w[len(chain.terms) :], [1.0, *toxicity.form(text), *earlier]))
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose(chain.score([text])[0], earlier, atol=1e-9)


def test_toxicity_of_repeated_rows_ties_and_any_order(spark):
    docs, labels = toxic_corpus()
    again = [(*d[:2],) for d in docs[:200]] * 2
    known = spark.createDataFrame(labels[:200] * 2, "doc_id long, quality int, toxic int")
    one = toxicity.fit(spark.createDataFrame(again, "doc_id long, text string"), known)
    two = toxicity.fit(spark.createDataFrame(again[::-1], "doc_id long, text string").repartition(3), known)
    assert one.terms == two.terms and all((a == b).all() for a, b in zip(one.weights, two.weights, strict=True))
    scored = toxicity.score_documents(spark.createDataFrame(again, "doc_id long, text string"), one).collect()
    assert len(scored) == 400 and len({(r["doc_id"], r["p_toxic"]) for r in scored}) == 200


def test_severe_never_decides(spark):
    docs, labels = toxic_corpus()
    chain = toxicity.fit(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    before = chain.score([d[1] for d in docs])[:, 1] >= chain.threshold
    chain.weights[2] = -chain.weights[2]
    assert ((chain.score([d[1] for d in docs])[:, 1] >= chain.threshold) == before).all()
