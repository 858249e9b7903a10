"""Queries on embeddings, topics, models and streams (families K, L, P and the extension of 2.O of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presslens.functions import tokens as K
from presslens.operators import features as A
from presslens.operators import learning as L
from presslens.operators import matrix as M
from presslens.operators import scores as S
from presslens.operators import topics as T
from presslens.operators import vocabulary as V
from presslens.operators.embed import PoissonEmbedder
from presslens.plans import articles as PA
from presslens.plans import entities as PE
from presslens.plans import ingest as PI
from presslens.plans.phrases import _pruned
from presslens.session import norm_source, table
from presslens.storage import materialize, shared_dir
from presslens.streaming import articles as stream

ARTICLES = "romanian_political_articles_v2_shuffled"


_models: dict[tuple, PoissonEmbedder] = {}


def _fit(spark, sf_dir, row="entity"):
    """The model of entities or of pruned phrases by domain, fitted once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, row)
    if key not in _models:
        m = _pruned(spark, sf_dir) if row == "phrase" else materialize(M.entity_matrix(PE._named(spark, sf_dir)), "entities")
        _models[key] = PoissonEmbedder(rank=3).fit(m, row)
    return _models[key]


def poisson_domain_embedding(spark, sf_dir):
    return _fit(spark, sf_dir).domain_vectors()


def poisson_entity_embedding(spark, sf_dir):
    return _fit(spark, sf_dir).phrases()


def poisson_phrase_embedding(spark, sf_dir):
    return _fit(spark, sf_dir, "phrase").phrases()


def poisson_weights(spark, sf_dir):
    return _fit(spark, sf_dir).weights()


def poisson_reconstruction(spark, sf_dir):
    return _fit(spark, sf_dir).reconstruct()


def singular_values(spark, sf_dir):
    return _fit(spark, sf_dir).orthogonalize()[2]


def embedding_rules(spark, sf_dir):
    """What a fit must keep: a loss that falls, weights that move within their bounds, orthonormal sides and ordered singular values that give the same table."""
    import numpy as np

    model = _fit(spark, sf_dir)
    left, right, values = model.orthogonalize()
    dims = [f"bias_dim_{i}" for i in range(len(model.w))]

    def gram(df):
        sums = df.agg(*(F.sum(F.col(a) * F.col(b)) for a in dims for b in dims)).first()
        return np.array(sums, float).reshape(len(dims), len(dims))

    s = np.array([r[0] for r in values.orderBy("bias_dim").select("singular_value").collect()])
    product = np.array(left.select(*(F.sum(F.abs(c)) for c in dims)).first(), float)
    rules = {
        "loss falls": all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 1,
        "weights move": bool(np.abs(model.w - 1).max() > 1e-6),
        "weights are bounded": bool(np.abs(model.w).max() <= 10),
        "rows are orthonormal": bool(np.allclose(gram(left), np.eye(len(dims)), atol=1e-5)),
        "domains are orthonormal": bool(np.allclose(gram(right), np.eye(len(dims)), atol=1e-5)),
        "singular values fall": bool((np.diff(s) <= 1e-9).all() and (s >= 0).all()),
        "every dimension is used": bool((product > 0).all()),
    }
    return spark.createDataFrame(list(rules.items()), "rule string, holds boolean")


def domain_scatter(spark, sf_dir):
    """Domains on the first two orthogonal dimensions of the entities, ready to plot."""
    return _fit(spark, sf_dir).orthogonalize()[1].select("domain", "bias_dim_0", "bias_dim_1")


def phrase_domain_scatter(spark, sf_dir):
    """Domains on the second and third orthogonal dimensions of the phrases."""
    return _fit(spark, sf_dir, "phrase").orthogonalize()[1].select("domain", "bias_dim_1", "bias_dim_2")


def domain_scatter_3d(spark, sf_dir):
    """Domains on the three orthogonal dimensions of the phrases."""
    return _fit(spark, sf_dir, "phrase").orthogonalize()[1].select("domain", "bias_dim_0", "bias_dim_1", "bias_dim_2")


def scatter_picture(spark, sf_dir):
    """The scatter of the clusters and a word cloud as files: how many marks each has."""
    import os
    import tempfile

    from presslens.sources import plots

    clusters, words = materialize(PE.domain_clusters(spark, sf_dir), "clusters"), PA.source_bias_words(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(200)
    with tempfile.TemporaryDirectory() as folder:
        plots.scatter_svg(clusters, "PC1", "PC2", os.path.join(folder, "a.svg"), "domain", "cluster", "Sources by cluster")
        plots.word_cloud_html(words, "word", "n", os.path.join(folder, "b.html"), "Bias words")
        marks = [open(os.path.join(folder, f), encoding="utf-8").read().count(tag) for f, tag in (("a.svg", "<circle"), ("b.html", "<span"))]
    return spark.createDataFrame(list(zip(("scatter", "cloud"), marks)), "picture string, marks bigint")


def _by_dim(spark, sf_dir, score, name, dim="bias_dim_0"):
    rows = A.require_columns(_fit(spark, sf_dir, "phrase").orthogonalize()[0], "phrase", dim)
    best = materialize(rows.select("phrase", dim).orderBy(F.desc(dim), "phrase").limit(500), "best-by-dim")  # every phrase has a score, so only these need theirs
    top = best.join(score(_pruned(spark, sf_dir), only=best), "phrase").orderBy(F.desc(name), "phrase").limit(100)
    return top.orderBy(F.desc(name), "phrase").limit(10).select("phrase", dim, name)


def top_by_dim_then_mi(spark, sf_dir):
    """Nested top-k: 500 by dimension, of these 100 by mutual information, 10 shown."""
    return _by_dim(spark, sf_dir, S.mi, "mi")


def top_by_dim_then_tfidf(spark, sf_dir):
    return _by_dim(spark, sf_dir, S.max_tf_idf, "max_tfidf")


def source_word_cloud(spark, sf_dir):
    """At most 200 words a source by frequency, as a word cloud takes them."""
    counts = PA.source_bias_words(spark, sf_dir)
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank <= 200").select("source", "word", "n")


def ranked_report(spark, sf_dir):
    """Fixed-width lines of a ranking: place, name, signed score."""
    from pyspark.sql import Window

    top = A.require_columns(PE.entity_mi(spark, sf_dir), "entity", "mi").orderBy(F.desc("mi"), "entity").limit(20)
    name = F.when(F.length("entity") < 40, F.rpad("entity", 40, " ")).otherwise(F.col("entity"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "entity"))).select(F.concat(F.format_string("%4d. ", "rank"), name, F.format_string("  %+10.4f", "mi")).alias("line"))


def _topics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return T.cluster_topics(T.reduce_vectors(e, "embedding"))


def topic_assignments(spark, sf_dir):
    return _topics(spark, sf_dir).select("vec_id", "topic", "probs")


def topic_summary(spark, sf_dir):
    """Number of topics and of outliers."""
    return _topics(spark, sf_dir).agg(F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("topics"), F.count_if(F.col("topic") < 0).alias("outliers"))


def topic_rules(spark, sf_dir):
    """What an assignment of topics must keep, by document."""
    t = materialize(_topics(spark, sf_dir).select("vec_id", "topic", "probs"), "topics")
    sizes = t.groupBy("topic").agg(F.count("*").alias("n"))
    one = F.abs(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9
    likeliest = (F.col("topic") < 0) | (F.array_position("probs", F.array_max("probs")) - 1 == F.col("topic"))
    return t.join(sizes, "topic").select("vec_id", one.alias("sums_to_one"), likeliest.alias("likeliest"), ((F.col("topic") < 0) | (F.col("n") >= 10)).alias("large_enough"))


def embedding_topic_words(spark, sf_dir):
    """Topics of the vectors, and the words of the documents with these numbers that mark them out."""
    found = _topics(spark, sf_dir).where("topic >= 0").select(F.col("vec_id").alias("doc_id"), "topic")
    terms = V.vectorize(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", stop=K.ROMANIAN_STOP_WORDS).join(found, "doc_id")
    return T.topic_words(PA._topic_scores(terms)).select("topic", "term", "rank")


def _plain_topic_words(spark, sf_dir, n):
    """The best single words of each topic."""
    scored = S.class_tf_idf(PA._topic_terms(spark, sf_dir), "topic").withColumn("score", F.round("score", 9))
    return T.topic_words(scored, n)


def topic_words(spark, sf_dir):
    return _plain_topic_words(spark, sf_dir, 15).select("topic", "term", "rank")


def diverse_topic_words(spark, sf_dir):
    """Words of each topic that are relevant and unlike each other, by their counts over topics."""
    terms = materialize(PA._topic_terms(spark, sf_dir), "topic-terms")
    best = T.topic_words(S.class_tf_idf(terms, "topic"), 30).select(F.col("topic").cast("int").alias("topic"), "term", "score")
    topics = [r[0] for r in terms.select("topic").distinct().orderBy("topic").collect()]  # a row a topic
    counts = terms.join(best.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("topic", "tf"))).alias("m"))
    vectors = counts.select("term", F.array(*(F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0)).cast("double") for t in topics)).alias("v"))
    return T.diverse_words(best, vectors)


def topic_coherence(spark, sf_dir):
    words = materialize(_plain_topic_words(spark, sf_dir, 10).select("topic", "term"), "topic-words")
    a = PA._articles(spark, sf_dir).where("cleantext is not null")
    terms = a.select(F.col("url").alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("cleantext"), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    return T.npmi_coherence(words, terms).select("topic", F.round("coherence", 6).alias("coherence"))


def topic_coherence_cv(spark, sf_dir):
    """c_v coherence over sliding windows."""
    words = materialize(_plain_topic_words(spark, sf_dir, 10).select(F.col("topic").cast("int").alias("topic"), "term"), "topic-words")
    return T.cv_coherence(words, PA._articles(spark, sf_dir).where("cleantext is not null").select(F.col("cleantext").alias("text")))


def label_model(spark, sf_dir):
    m = PA._matrix(spark, sf_dir)
    names = list(A.LABELLERS)
    return L.LabelModel().fit(m, names).predict(m).select("url", F.round("p_unbiased", 6).alias("p_unbiased"), A.label_name(F.col("label")).alias("label"))


def _texts(spark, sf_dir):
    a = table(spark, sf_dir, "article_labels").where("url is not null and cleantext <> '' and snorkel_label in ('biased', 'unbiased')")
    return a.groupBy("url").agg(F.max("cleantext").alias("text"), F.max("snorkel_label").alias("label"))


def classifier_predictions(spark, sf_dir):
    """A classifier trained on nine tenths of the labelled articles, stored, loaded, and run on all of them."""
    from pyspark.ml import PipelineModel

    from presslens.operators.sampling import stratified_split

    d = materialize(stratified_split(_texts(spark, sf_dir), "label", "url"), "labelled")
    path = f"{shared_dir(spark)}/presslens/model-{uuid.uuid4().hex}"
    L.classifier(1 << 14).fit(d.where("not is_eval")).write().save(path)
    guess = F.when(F.col("prediction") == 0, "biased").otherwise("unbiased")
    return PipelineModel.load(path).transform(d).select("url", "is_eval", "label", guess.alias("guess"))


def training_rows(spark, sf_dir):
    """Gold rows joined by the weak rows of other urls."""
    labels = table(spark, sf_dir, "article_labels").where("url is not null and snorkel_label is not null")
    gold = labels.where(F.substring(F.md5(F.col("url").cast("binary")), 1, 1) == "0").groupBy("url").agg(F.max("snorkel_label").alias("label"))
    weak = labels.groupBy("url").agg(F.min("snorkel_label").alias("label"))
    return L.training_set(gold, weak)


def extracted_entities(spark, sf_dir):
    a = PA._articles(spark, sf_dir).where("cleantext is not null")
    return L.extract_entities(a).select("url", F.concat_ws("|", "ner").alias("names"))


def _answer(prompt: str) -> str:
    """A stand-in for a served model: counts words of approval and of rejection."""
    low = prompt.lower()
    good, bad = (sum(low.count(w) for w in ws) for ws in (("susține", "aprobă", "salută"), ("critică", "respinge", "contestă")))
    word = "pozitiv" if good > bad else "negativ" if bad > good else "neutru"
    return f"Sentiment: {word}\nÎncredere: 0.{min(99, 50 + 10 * abs(good - bad))}"


def model_stances(spark, sf_dir):
    """Stances asked of an injected model, one entity and its sentences at a time."""
    return L.entity_stances(PA._articles(spark, sf_dir).where("ner is not null"), _answer).distinct()


def model_sentiment(spark, sf_dir):
    return L.text_sentiment(PA._articles(spark, sf_dir), _answer)


def model_names(spark, sf_dir):
    """Canonical names asked of an injected model in batches of 200."""
    import json

    names = table(spark, sf_dir, "romanian_political_articles_v2_ner").select(F.explode("ner").alias("raw"))
    return L.normalize_names(names, lambda items: "```json\n" + json.dumps({x: x.upper() for x in items}, ensure_ascii=False) + "\n```")


def streamed_events(spark, sf_dir):
    """Windowed counts of the events, run as a stream to its end."""
    path = f"{shared_dir(spark)}/presslens/events-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").write.parquet(path)
    schema = spark.read.parquet(path).schema
    name = f"presslens_{uuid.uuid4().hex}"
    out = stream.windowed_events(spark.readStream.schema(schema).parquet(path), delay="400 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def streamed_matrix(spark, sf_dir):
    """The phrase matrix of single words kept by a stream of articles, batch by batch."""
    base = f"{shared_dir(spark)}/presslens/stream-{uuid.uuid4().hex}"
    a = table(spark, sf_dir, ARTICLES).where("url is not null and maintext is not null").groupBy("url").agg(F.max("maintext").alias("maintext"), F.max(norm_source(F.col("source_domain"))).alias("source_domain"), F.max("scraped_at").alias("scraped_at"))
    a.repartition(4).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    arrived = stream.read_articles(spark, f"{base}/in", schema, 2).withWatermark("scraped_at", "3650 days").dropDuplicatesWithinWatermark(["url"])
    q = arrived.writeStream.foreachBatch(stream.matrix_sink(f"{base}/out", "maintext", sizes=(1,))).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.read_matrix(spark, f"{base}/out")


def batch_matrix(spark, sf_dir):
    """The same matrix in one batch."""
    a = table(spark, sf_dir, ARTICLES).where("url is not null and maintext is not null").groupBy("url").agg(F.max("maintext").alias("maintext"), F.max(norm_source(F.col("source_domain"))).alias("source_domain"))
    return M.phrase_matrix(a, "maintext", "source_domain", sizes=(1,))


QUERIES = {
    f.__name__: f
    for f in (poisson_domain_embedding, poisson_entity_embedding, poisson_phrase_embedding, poisson_weights, embedding_rules, phrase_domain_scatter, scatter_picture, topic_rules, embedding_topic_words, topic_coherence_cv, poisson_reconstruction, singular_values, domain_scatter, domain_scatter_3d, top_by_dim_then_mi, top_by_dim_then_tfidf, source_word_cloud, ranked_report, topic_assignments, topic_summary, topic_words, diverse_topic_words, topic_coherence, label_model, classifier_predictions, training_rows, extracted_entities, model_stances, model_sentiment, model_names, streamed_events, streamed_matrix, batch_matrix)
}
_MATRIX = r"""WITH a AS (SELECT url, max(maintext) AS t, max(nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '')) AS domain FROM romanian_political_articles_v2_shuffled WHERE url IS NOT NULL AND maintext IS NOT NULL GROUP BY url),
w AS (SELECT DISTINCT url, domain, unnest(list_filter(regexp_extract_all(t, '[\p{L}\p{N}\-]+'), lambda x: regexp_full_match(replace(x, '-', ''), '\p{L}+'))) AS phrase FROM a WHERE domain IS NOT NULL AND len(regexp_extract_all(t, '[^\s]+')) > 30)
SELECT phrase, domain, count(*) AS n FROM w WHERE NOT contains(phrase, 'PERIOD') GROUP BY phrase, domain"""
ORACLES = {
    "training_rows": "WITH l AS (SELECT * FROM article_labels WHERE url IS NOT NULL AND snorkel_label IS NOT NULL), g AS (SELECT url, max(snorkel_label) AS label FROM l WHERE md5(url)[1] = '0' GROUP BY url) SELECT * FROM g UNION ALL SELECT url, min(snorkel_label) FROM l WHERE url NOT IN (SELECT url FROM g) GROUP BY url",
    "streamed_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_matrix": _MATRIX,
    "batch_matrix": _MATRIX,
    "source_word_cloud": PA.ORACLES["source_bias_words"],
    "extracted_entities": PA._A + r" SELECT url, array_to_string(list_sort(list_distinct(regexp_extract_all(cleantext, '\p{Lu}[\p{L}\-]+(?: \p{Lu}[\p{L}\-]+)+'))), '|') AS names FROM a WHERE cleantext IS NOT NULL",
}

_NAMED = "SELECT DISTINCT url, {cols}, unnest(ner) AS entity FROM a WHERE ner IS NOT NULL"
_MENTION = f"(CASE WHEN regexp_matches(entity, '^[{PI._W}]') THEN '(^|[^{PI._W}])' ELSE '[{PI._W}]' END) || regexp_escape(entity) || (CASE WHEN regexp_matches(entity, '[{PI._W}]$') THEN '($|[^{PI._W}])' ELSE '[{PI._W}]' END)"
_GOOD, _BAD = ("(" + " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in ws) + ")" for ws in (("susține", "aprobă", "salută"), ("critică", "respinge", "contestă")))
_PLAIN_WORDS = PA._A + rf""", w AS (SELECT topic, unnest(regexp_extract_all(lower(cleantext), '\p{{L}}+')) AS term FROM a WHERE topic >= 0 AND cleantext IS NOT NULL),
t AS (SELECT topic, term, count(*) AS tf FROM w WHERE NOT list_contains({PA._STOP}, term) GROUP BY topic, term),
sc AS (SELECT topic, term, round(sqrt(tf / sum(tf) OVER (PARTITION BY topic)) * ln(((SELECT avg(n) FROM (SELECT sum(tf) AS n FROM t GROUP BY topic)) + 1) / (sum(tf) OVER (PARTITION BY term) + 0.5)), 9) AS score FROM t),
rk AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM sc)"""
ORACLES |= {
    "ranked_report": "SELECT printf('%4d. ', rn) || CASE WHEN length(entity) < 40 THEN rpad(entity, 40, ' ') ELSE entity END || '  ' || printf('%+10.4f', mi) AS line FROM (SELECT *, row_number() OVER (ORDER BY mi DESC, entity) AS rn FROM (" + PE.ORACLES["entity_mi"] + ")) WHERE rn <= 20",
    "topic_rules": "SELECT vec_id, true AS sums_to_one, true AS likeliest, true AS large_enough FROM embeddings",
    "topic_words": _PLAIN_WORDS + " SELECT topic, term, rank FROM rk WHERE rank <= 15",
    "topic_coherence": _PLAIN_WORDS
    + r""", tw AS (SELECT topic, term FROM rk WHERE rank <= 10), dt AS (SELECT DISTINCT url, unnest(regexp_extract_all(lower(cleantext), '\p{L}+')) AS term FROM a WHERE cleantext IS NOT NULL),
nd AS (SELECT count(DISTINCT url)::DOUBLE AS n FROM dt), df AS (SELECT term, count(*) AS k FROM dt GROUP BY term),
pr AS (SELECT x.topic, x.term AS a, y.term AS b FROM tw x JOIN tw y ON x.topic = y.topic AND x.term < y.term),
bo AS (SELECT topic, a, b, count(y.url) AS k FROM pr JOIN dt x ON x.term = a LEFT JOIN dt y ON y.url = x.url AND y.term = b GROUP BY topic, a, b),
sc2 AS (SELECT bo.topic, CASE WHEN bo.k = 0 THEN -1 WHEN bo.k = n THEN 1 ELSE ln(bo.k * n / (fa.k * fb.k)) / -ln(bo.k / n) END AS v FROM bo JOIN df fa ON fa.term = a JOIN df fb ON fb.term = b, nd)
SELECT topic, round(avg(v), 6) AS coherence FROM sc2 GROUP BY topic""",
    "embedding_rules": "SELECT unnest(['loss falls', 'weights move', 'weights are bounded', 'rows are orthonormal', 'domains are orthonormal', 'singular values fall', 'every dimension is used']) AS rule, true AS holds",
    "scatter_picture": PE._ST + ", m AS (SELECT count(DISTINCT domain) AS n FROM s), z AS (" + PA.ORACLES["source_bias_words"] + ") SELECT 'scatter' AS picture, n AS marks FROM m UNION ALL SELECT 'cloud', least(count(DISTINCT word), 200) FROM z",
    "model_names": "SELECT DISTINCT raw, trim(upper(raw)) AS canonical FROM (SELECT unnest(ner) AS raw FROM romanian_political_articles_v2_ner) WHERE raw IS NOT NULL",
    "model_sentiment": PA._A + f", p AS (SELECT url, lower(replace(substring(coalesce(cleantext, ''), 1, 7800), chr(10), ' ')) AS low FROM a), c AS (SELECT url, {_GOOD} AS g, {_BAD} AS b FROM p) SELECT url, CASE WHEN g > b THEN 'pozitiv' WHEN b > g THEN 'negativ' ELSE 'neutru' END AS text_sentiment, ('0.' || least(99, 50 + 10 * abs(g - b)))::DOUBLE AS sentiment_confidence FROM c",
    "model_stances": PA._A
    + rf""", e AS ({_NAMED.format(cols="coalesce(cleantext, '') AS t")}),
h AS (SELECT url, entity, list_filter(list_filter(list_transform(string_split(regexp_replace(t, '([.!?…])[ \t\n\x{{0b}}\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: regexp_matches(x, '(?is)' || {_MENTION})) AS l FROM e WHERE entity IS NOT NULL),
k AS (SELECT url, entity, len(l) AS n, lower(entity || chr(10) || array_to_string(l, ' ')) AS low FROM h), c AS (SELECT url, entity, n, {_GOOD} AS g, {_BAD} AS b FROM k)
SELECT DISTINCT url, entity, CASE WHEN n = 0 THEN 'NO_ENTITY' WHEN g > b THEN 'POZITIV' WHEN b > g THEN 'NEGATIV' ELSE 'NEUTRU' END AS stance FROM c""",
}
