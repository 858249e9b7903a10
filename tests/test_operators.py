"""Matrices, scores, entities, features, sampling, graph and models on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.operators import embed, entities, features, graph, learning, matrix, sampling, scores, topics
from presslens.sources import connectors, io


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is None, x) for x in r])


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("A", "d1", 4), ("B", "d1", 1), ("B", "d2", 1), ("C", "d2", 2)], "phrase string, domain string, n bigint")


def test_scores(abc):
    p = {(a, d): v for a, d, v in rows(scores.pmi(abc), "phrase", "domain", "pmi")}
    assert p[("A", "d1")] == pytest.approx(0.678072, abs=1e-6) and p[("B", "d2")] == pytest.approx(0.415037, abs=1e-6)
    m = dict(rows(scores.mi(abc), "phrase", "mi"))
    assert m["A"] == pytest.approx(0.339036, abs=1e-6) and sum(m.values()) == pytest.approx(0.704434, abs=1e-6)
    assert scores.total_mi(abc).first()[0] == pytest.approx(sum(m.values()))
    t = {(a, d): v for a, d, v in rows(scores.tf_idf(abc), "phrase", "domain", "tfidf")}
    assert t[("A", "d1")] == pytest.approx(0.984546, abs=1e-6) and t[("B", "d2")] == pytest.approx(0.335176, abs=1e-6)
    for d in ("d1", "d2"):
        assert sum(v * v for (_, x), v in t.items() if x == d) == pytest.approx(1)


def test_zero_matrix_raises(spark):
    z = spark.createDataFrame([("A", "d", 0)], "phrase string, domain string, n bigint")
    with pytest.raises(Exception, match="no counts"):
        scores.require_nonzero(z).collect()


def test_filters(abc):
    assert rows(matrix.too_good(abc), "phrase") == [("A",), ("C",)]
    assert rows(matrix.ubiquitous(abc, matrix.domain_count(abc)), "phrase") == [("B",)]


def test_purge_does_not_cascade(spark):
    m = spark.createDataFrame([("social", "d", 10), ("partid", "d", 10), ("social democrat", "d", 8), ("partid social", "d", 6), ("partid social democrat", "d", 6)], "phrase string, domain string, n bigint")
    assert rows(matrix.redundant(m), "phrase") == [("partid social",), ("social",), ("social democrat",)]


def test_wide_and_long(abc):
    assert rows(matrix.unpivot_matrix(matrix.pivot_matrix(abc, "phrase"), "phrase"), "phrase", "domain", "n") == rows(abc, "phrase", "domain", "n")


def test_sentiment_features(spark):
    c = spark.createDataFrame([("e1", "d1", 2, 0, 1), ("e1", "d2", 2, 1, 0), ("e2", "d1", 1, 3, 0)], "entity string, domain string, pos_count bigint, neg_count bigint, neu_count bigint")
    f = {r["domain"]: r for r in entities.domain_features(entities.with_scores(c)).collect()}
    assert f["d1"]["bias_score"] == pytest.approx(0.083333, abs=1e-6) and f["d1"]["pos_tfidf"] == pytest.approx(2.079442, abs=1e-6)
    assert f["d1"]["entropy"] == pytest.approx(1.004242, abs=1e-6) and f["d2"]["entropy"] == pytest.approx(0.636514, abs=1e-6)
    assert f["d2"]["neg_tfidf"] == pytest.approx(0.693147, abs=1e-6)


def test_stances(spark):
    a = spark.createDataFrame([("d", [("e", "pozitiv"), ("e", "UNKNOWN"), ("f", "ERROR"), (None, "POZITIV")]), ("d", None), (None, [("e", "POZITIV")])], "source_domain string, stance array<struct<entity:string,stance:string>>")
    assert rows(entities.stance_counts(a), "entity", "domain", "pos_count", "total") == [("e", "d", 1, 1)]


def test_normalize(spark):
    a = spark.createDataFrame([("u", [" x ", "y"]), ("v", []), ("w", None)], "url string, ner array<string>")
    m = spark.createDataFrame([("x", "X")], "raw string, canonical string")
    assert rows(entities.normalize_list(a, "url", "ner", m), "url", "ner") == [("u", ["X", "y"]), ("v", []), ("w", [])]


def test_silhouette_and_clusters(spark):
    pts = spark.createDataFrame([("a", 0.0, 0), ("b", 1.0, 0), ("c", 10.0, 1), ("d", 12.0, 1)], "domain string, x double, cluster int")
    want = np.mean([(11 - 1) / 11, (10 - 1) / 10, (9.5 - 2) / 9.5, (11.5 - 2) / 11.5])
    assert entities.silhouette(pts, "domain", ["x"]).first()[0] == pytest.approx(want)
    best, sweep = entities.best_clusters(pts.drop("cluster"), "domain", ["x"])
    assert len(set(rows(best, "cluster"))) == 2 and [r[0] for r in sweep.orderBy("k").collect()] == [2, 3]


def test_standardize_constant_column(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = rows(entities.standardize(d, ["a", "b"]), "a", "b")
    assert [b for _, b in got] == [0, 0, 0] and sum(a for a, _ in got) == pytest.approx(0)


def test_features(spark):
    d = spark.createDataFrame([([0.5, 0.25, 0.0, 0.25], [1.0, 0.0, 1.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0])], "p array<double>, a array<double>, b array<double>, z array<double>")
    r = d.select(features.entropy(F.col("p")), features.cosine(F.col("a"), F.col("b")), features.cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(1.5) and r[1] == pytest.approx(0.5) and r[2] == 0
    t = spark.createDataFrame([("Votare vot",), (None,)], "t string")
    assert [x[0] for x in t.select(features.bias_word_count(F.col("t"), F.array(F.lit("vot")))).collect()] == [2, 0]


def test_labelling_boundaries(spark):
    base = dict(bias_word_ratio=None, exclaim_count=None, question_count=None, text_sentiment=None, sentiment_confidence=None, topic_entropy=None, cond_mood_count=None, topic_sim_bias=None, first_pronouns=None, second_pronouns=None, avg_sentence_length=None, positive_stance_polarity=None, negative_stance_polarity=None)
    cases = [
        (dict(bias_word_ratio=0.09), "high_bias_word_ratio", -1), (dict(bias_word_ratio=0.0901), "high_bias_word_ratio", 0), (dict(bias_word_ratio=math.nan), "high_bias_word_ratio", -1), ({}, "high_bias_word_ratio", -1),
        (dict(exclaim_count=5.0), "excessive_exclaims", -1), (dict(exclaim_count=6.0), "excessive_exclaims", 0), (dict(topic_entropy=3.0), "low_topic_entropy", -1), (dict(topic_entropy=2.99), "low_topic_entropy", 0),
        (dict(topic_entropy=5.0), "high_entropy", -1), (dict(topic_entropy=5.01), "high_entropy", 1), (dict(negative_stance_polarity=0.6), "excess_negative_stance", 0), (dict(positive_stance_polarity=0.3), "excess_positive_stance", -1),
        (dict(avg_sentence_length=5.0), "short_sentences", -1), (dict(avg_sentence_length=11.9), "short_sentences", 1), (dict(avg_sentence_length=12.0), "short_sentences", -1),
    ]
    kinds = ", ".join(f"{k} {'string' if k == 'text_sentiment' else 'double'}" for k in base)
    df = spark.createDataFrame([(str(i), *(base | c[0]).values()) for i, c in enumerate(cases)], "url string, " + kinds)
    got = {r["url"]: r for r in features.label_matrix(df).collect()}
    assert [got[str(i)][c[1]] for i, c in enumerate(cases)] == [c[2] for c in cases]
    assert len(features.LABELLERS) == 16


def test_parts_and_batches(spark):
    n18 = spark.createDataFrame([(f"{i:02}",) for i in range(18)], "k string")
    sizes = dict(rows(sampling.assign_part(n18, "k").groupBy("part").count(), "part", "count"))
    assert sizes == {**{i: 2 for i in range(1, 8)}, 8: 4}
    assert set(rows(sampling.assign_part(n18.limit(5), "k"), "part")) == {(8,)}
    assert rows(sampling.assign_part(n18.limit(0), "k"), "part") == []
    assert [len(x) for (x,) in rows(sampling.batches(n18, "k", 7), "items")] == [7, 7, 4]


def test_quantiles(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert rows(sampling.quantile_bins(d, "x"), "x_bin") == [(0,), (1,), (2,), (3,), (None,)]


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 100), (7, None), (5, 4)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(e, "a int, b int")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    n, u, v, w = rng.poisson(2, (5, 4)).astype(float), rng.normal(0, 0.3, (5, 2)), rng.normal(0, 0.3, (4, 2)), np.array([1.0, 0.7])
    _, gu, gv, gw = embed.loss_and_gradients(n, u, v, w)
    for x, g in ((u, gu), (v, gv), (w, gw)):
        for i in np.ndindex(x.shape):
            kept = x[i]
            x[i] = kept + 1e-6
            up = embed.loss_and_gradients(n, u, v, w)[0]
            x[i] = kept - 1e-6
            down = embed.loss_and_gradients(n, u, v, w)[0]
            x[i] = kept
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-3)


def test_embedder(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(0, 1, (30, 2)), rng.normal(0, 1, (6, 2))
    n = rng.poisson(np.exp(np.clip(u @ v.T, -3, 3)))
    m = spark.createDataFrame([(f"r{i}", f"d{j}", int(n[i, j])) for i in range(30) for j in range(6) if n[i, j]], "phrase string, domain string, n bigint")
    model = embed.PoissonEmbedder(rank=2).fit(m, max_iter=5)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 1
    left, domains, s = model.orthogonalize()
    sv = [r[1] for r in s.orderBy("bias_dim").collect()]
    assert sv[0] >= sv[1] > 0
    vecs = np.array([r[1:] for r in domains.collect()])
    assert np.allclose(vecs.T @ vecs, np.eye(2), atol=1e-8)
    lv = np.array([r[1:] for r in left.collect()])
    assert np.allclose(lv.T @ lv, np.eye(2), atol=1e-6)
    assert model.orthogonalize(full=True)[2].count() == 6
    assert np.abs(model.w - 1).max() > 1e-4 and np.abs(model.w).max() <= embed.WEIGHT and [r[1] for r in model.weights().orderBy("bias_dim").collect()] == pytest.approx(model.w.tolist())
    assert model.reconstruct().count() == len(rows(m.select("phrase").distinct(), "phrase")) * 6


def test_embedder_solves_equal_rows_once(spark):
    """Rows with the same counts are one row to solve, have the very same vector, and weigh as often as they occur."""
    rng = np.random.default_rng(5)
    kinds = np.unique(rng.poisson(1.5, (7, 5)) + np.eye(7, 5, dtype=int), axis=0)
    own = [i % len(kinds) for i in range(200)]
    m = spark.createDataFrame([(f"r{i}", f"d{j}", int(kinds[k][j])) for i, k in enumerate(own) for j in range(5) if kinds[k][j]], "phrase string, domain string, n bigint")
    model = embed.PoissonEmbedder(rank=2).fit(m, max_iter=3)
    sizes = [(len(np.frombuffer(r["size"], np.int32)), np.frombuffer(r["times"]).sum()) for r in model.blocks.collect()]
    assert sum(a for a, _ in sizes) == len(kinds) and sum(b for _, b in sizes) == 200
    found = {r[0]: r[1:] for r in model.phrases().collect()}
    assert len(found) == 200 and all(len({found[f"r{i}"] for i in range(200) if own[i] == k}) == 1 for k in range(len(kinds)))
    u = np.array([found[f"r{i}"] for i in range(200)])
    loss, gu, gv, gw = embed.loss_and_gradients(kinds[own].astype(float), u, model.V, model.w)
    assert np.abs(gu + 2 * model.l2 * u).max() < 1e-3
    assert loss + model.l2 * ((u * u).sum() + (model.V**2).sum() + (model.w**2).sum()) == pytest.approx(model.losses[-1], rel=1e-9)
    (_, v, w, _, _), _ = model._pass()
    assert np.allclose(v, gv, rtol=1e-3, atol=0.05) and np.allclose(w, gw, rtol=1e-3, atol=0.05)
    assert model._pass(model.losses[-1] / 2)[0][0] == np.inf


def test_domain_side_writes_and_joins_no_phrases(spark, monkeypatch):
    """The domains' side and the singular values come from the distinct rows alone."""
    m = spark.createDataFrame([(f"r{i}", f"d{j}", 1 + (i + j) % 3) for i in range(40) for j in range(4) if (i + j) % 5], "phrase string, domain string, n bigint")
    model = embed.PoissonEmbedder(rank=2).fit(m, max_iter=2)
    written = []
    monkeypatch.setattr(embed, "materialize", lambda df, name: written.append(name) or df)
    left, right, values = model.orthogonalize()
    found = right.collect()
    assert not written and len(found) == 4
    u, s, v = (np.array([r[1:] for r in sorted(x.collect())]) for x in (left, values, right))
    p, d = (np.array([r[1:] for r in sorted(x.collect())]) for x in (model.phrases(), model.domain_vectors()))
    assert np.allclose(u * s[:, 0] @ v.T, p * model.w @ d.T, atol=1e-8)


@pytest.mark.parametrize("score", ["mi", "max_tf_idf"])
def test_scores_of_some_rows_are_those_among_all(spark, score):
    m = spark.createDataFrame([(f"r{i}", f"d{j}", 1 + (i * j) % 4) for i in range(30) for j in range(4) if (i + j) % 3], "phrase string, domain string, n bigint")
    some = spark.createDataFrame([("r3",), ("r17",)], "phrase string")
    everything = dict(map(tuple, getattr(scores, score)(m).collect()))
    found = dict(map(tuple, getattr(scores, score)(m, only=some).collect()))
    assert found == pytest.approx({k: everything[k] for k in ("r3", "r17")})


def test_label_model_recovers_accuracies(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    acc = [0.9, 0.8, 0.7, 0.6]
    votes = [[int(t if rng.random() < a else 1 - t) if rng.random() < 0.8 else -1 for a in acc] for t in y]
    names = [f"l{i}" for i in range(4)]
    m = spark.createDataFrame([(str(i), *v) for i, v in enumerate(votes)], "url string, " + ", ".join(f"{n} int" for n in names))
    model = learning.LabelModel().fit(m, names)
    assert np.abs(model.accuracy - acc).max() < 0.06
    got = {r["url"]: r["label"] for r in model.predict(m).collect()}
    assert np.mean([got[str(i)] == t for i, t in enumerate(y)]) > 0.85


def test_metrics(spark):
    d = spark.createDataFrame([("unbiased", "unbiased"), ("unbiased", "biased"), ("biased", "biased"), ("biased", "unbiased")], "t string, g string")
    assert tuple(features.metrics(d, "t", "g").first()) == (4, 0.5, 0.5, 0.5, 0.5)


def test_injected_models(spark):
    a = spark.createDataFrame([("u", "Ion Pop a zis da. Altceva.", ["Ion Pop", "Ana"]), ("v", None, ["X"])], "url string, cleantext string, ner array<string>")

    def ask(p):
        if "zis" not in p:
            raise ValueError
        return "Negativ"

    assert rows(learning.entity_stances(a, ask), "url", "entity", "stance") == [("u", "Ana", "NO_ENTITY"), ("u", "Ion Pop", "NEGATIV"), ("v", "X", "NO_ENTITY")]
    assert rows(learning.extract_entities(a, lambda t: ["b", "a", "a"] if t else 1 / 0), "url", "ner") == [("u", ["a", "b"]), ("v", [])]
    assert rows(learning.text_sentiment(a.where("url = 'v'"), ask), "text_sentiment") == [(None,)]


def test_coherence(spark):
    w = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "topic int, term string")
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")], "doc_id int, term string")
    assert dict(rows(topics.npmi_coherence(w, d), "topic", "coherence")) == {0: pytest.approx(1.0), 1: -1.0}


def test_io(spark, tmp_path):
    a = spark.createDataFrame([("u", " t\n\"q\" ", None, "", "x, y", "d", "A; B")], io.ARTICLE)
    io.write_csv(a, str(tmp_path / "c"))
    assert [tuple(r) for r in io.read_articles_csv(spark, str(tmp_path / "c")).collect()] == [("u", " t\n\"q\" ", None, "", "x, y", "d", "A; B")]
    assert io.read_json_map(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('{"a": "b"}')
    assert rows(io.read_json_map(spark, str(tmp_path / "m.json")), "raw", "canonical") == [("a", "b")]
    (tmp_path / "p.txt").write_text("# c\n\n x* \ny\n")
    assert io.read_patterns(str(tmp_path / "p.txt")) == ["x*", "y"]
    for i, v in enumerate(("old", "new")):
        io.append_batch(spark.createDataFrame([("k", v)], "raw string, canonical string"), str(tmp_path / "b"), i)
    assert rows(io.read_batches(spark, str(tmp_path / "b"), "raw", "canonical", "raw string, canonical string"), "raw", "canonical") == [("k", "new")]


def test_export_and_merge(spark):
    a = spark.createDataFrame([("u", "x", ["A", "B"]), ("v", "  ", None), (None, "y", None)], "url string, maintext string, authors array<string>")
    for c in ("title", "date_publish", "description", "source_domain"):
        a = a.withColumn(c, F.lit(None).cast("string"))
    assert rows(io.exportable(a), "url", "authors") == [("u", "A; B")]
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "url string, x int")
    two = spark.createDataFrame([("a", 3, "z"), ("c", 4, "z")], "url string, x int, extra string")
    assert rows(io.merge_articles([one, two]), "url", "x") == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(io.duplicate_keys(one.union(one)), "url", "n") == [("a", 2), ("b", 2)]


def test_article_query(spark):
    a = spark.createDataFrame([("http://x/a", "Guvern", "t", "s"), ("http://x/amp", "guvern", "t", "s"), ("http://x/b", None, None, None)], "url string, title string, maintext string, source_domain string").withColumn("date_publish", F.lit("2024-01-01").cast("timestamp"))
    assert rows(connectors.article_query(a, ["GUVERN"], ["/amp"], "2023-01-01", "2025-01-01"), "url") == [("http://x/a",)]


def test_embedder_is_as_good_as_gradient_descent(spark):
    """On a small matrix the loss is no worse than that of many steps of plain gradient descent on all of U, V and w."""
    rng = np.random.default_rng(4)
    n = rng.poisson(np.exp(np.clip(rng.normal(0, 1, (25, 2)) @ rng.normal(0, 1, (5, 2)).T, -2, 2))).astype(float)
    n[0, 0] += 1
    m = spark.createDataFrame([(f"r{i}", f"d{j}", int(n[i, j])) for i in range(25) for j in range(5) if n[i, j]], "phrase string, domain string, n bigint")
    model = embed.PoissonEmbedder(rank=2).fit(m, max_iter=60)
    kept = n[n.sum(1) > 0]
    a, s, b = np.linalg.svd(kept, full_matrices=False)
    u, v, w = a[:, :2] * s[:2], b[:2].T.copy(), np.ones(2)
    penalty = lambda: model.l2 * float((u * u).sum() + (v * v).sum() + (w * w).sum())
    best, step = np.inf, 1e-3
    for _ in range(20000):
        loss, gu, gv, gw = embed.loss_and_gradients(kept, u, v, w)
        loss += penalty()
        if loss < best:
            best, saved = loss, (u.copy(), v.copy(), w.copy())
            step *= 1.05
        else:
            u, v, w = (x.copy() for x in saved)
            step /= 2
            _, gu, gv, gw = embed.loss_and_gradients(kept, u, v, w)
        u -= step * (gu + 2 * model.l2 * u)
        v -= step * (gv + 2 * model.l2 * v)
        w = np.clip(w - step * (gw + 2 * model.l2 * w), -10, 10)
    assert model.losses[-1] <= best + 0.01 * abs(best)


def test_bias_words(spark):
    from presslens.operators import vocabulary as V

    docs = spark.createDataFrame([(i, "Reforma fiscală vine azi" if i < 4 else "fiscală azi", "s") for i in range(6)] + [(9, None, "s")], "id int, text string, source string")
    counts = V.vectorize(docs, "id", "text", (1, 2), min_df=2, max_df=0.9)
    assert {r[0] for r in counts.select("term").distinct().collect()} == {"reforma", "vine", "reforma fiscală", "fiscală vine", "vine azi", "fiscală azi"}
    terms = counts.join(docs.select("id", "source"), "id")
    allowed = spark.createDataFrame([("reforma",), ("reforma fiscală",), ("azi",)], "term string")
    assert {r[0] for r in V.bias_terms(terms, allowed).select("term").distinct().collect()} == {"reforma fiscală"}
    assert {r[0] for r in V.bias_terms(terms, allowed, strict_reference=True).select("term").distinct().collect()} == {"reforma", "reforma fiscală"}
    kept = V.bias_terms(terms, allowed)
    assert rows(V.source_words(kept, ["none"]), "source", "word", "n") == [("s", "reforma fiscală", 4)] and V.source_words(kept, ["reforma fiscală"]).count() == 0
    assert rows(V.article_words(kept, "id"), "id", "bias_words")[0] == (0, ["reforma fiscală"])


def test_guards_reports_and_pictures(spark, tmp_path):
    from presslens.sources import plots

    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b")], "t string, g string")
    with pytest.raises(ValueError, match="'x'.*'t'"):
        features.require_columns(df, "t", "x")
    assert rows(features.class_report(df, "t", "g"), "label", "support", "precision", "recall") == [("a", 2, 1.0, 0.5), ("b", 1, pytest.approx(1 / 3), 1.0)]
    pts = spark.createDataFrame([("<d>", 0.0, 1.0, 0), ("e", 2.0, None, 1), ("f", 1.0, 3.0, 1)], "d string, x double, y double, k int")
    plots.scatter_svg(pts, "x", "y", str(tmp_path / "a.svg"), "d", "k", "t")
    svg = (tmp_path / "a.svg").read_text()
    assert svg.count("<circle") == 2 and "&lt;d&gt;" in svg
    plots.word_cloud_html(pts, "d", "x", str(tmp_path / "b.html"))
    assert (tmp_path / "b.html").read_text().count("<span") == 3


def test_one_row_and_missing_files(spark, tmp_path):
    df = spark.createDataFrame([("u", "a", None), ("u", None, 2), ("v", "c", 1), (None, "x", 1)], "url string, t string, n int")
    assert rows(io.one_row(df), "url", "t", "n") == [("u", "a", 2), ("v", "c", 1)] and io.one_row(df.limit(0)).count() == 0
    assert io.read_json_map(spark, f"file://{tmp_path}/none.json").count() == 0 and io.read_batches(spark, f"{tmp_path}/none", "raw", "c", "raw string, c string").count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert io.read_json_map(spark, f"{tmp_path}/bad.json").count() == 0


def test_cv_coherence(spark):
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d")], "topic int, term string")
    docs = spark.createDataFrame([("a b x", ), ("b a y",), ("c x",), ("d y z",), (None,)], "text string")
    got = dict(rows(topics.cv_coherence(words, docs), "topic", "coherence"))
    assert got[0] == pytest.approx(1.0) and got[1] < 0.3
    n = {(t, a, b): n for t, a, b, n in rows(topics.window_counts(docs, words, window=2).where("topic is not null"), "topic", "a", "b", "n")}
    assert n[(0, "a", "b")] == 2 and n[(0, "a", "a")] == 3 and n[(1, "c", "d")] == 0


def test_names_of_a_failed_batch_are_kept(spark):
    names = spark.createDataFrame([("A",), ("B",)], "raw string")

    def fails(items):
        raise ValueError

    assert rows(learning.normalize_names(names, fails), "raw", "canonical") == [("A", None), ("B", None)]
    arts = spark.createDataFrame([("u", "x")], "url string, cleantext string")
    found = learning.extract_entities(arts, lambda t: [("Ana", "PERSON"), ("Eu", "PERSON"), ("2024", "DATE"), ("Iași", "GPE")], pronouns=["eu"])
    assert found.first()["ner"] == ["Ana", "Iași"]
