"""Queries on article features, labels and topics (families I, J13, L, M, N of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.functions import tokens as K
from presslens.operators import features as A
from presslens.operators import scores as S
from presslens.operators import topics as T
from presslens.operators import vocabulary as V
from presslens.session import norm_source, spread, table
from presslens.sources import io
from presslens.storage import materialize, once

TOPICS = "romanian_political_articles_v2_nlp_with_topics"
PROBS = [f"topic_{i}" for i in range(8)]
# Our own list of words that tell nothing about a source; the original's is a parameter.
IGNORED = "consilier ministrul deputatul senatorul primarul premierul economistul juristul aproximativ potrivit".split()


def _articles(spark, sf_dir):
    """One row a url: the greatest of each column, topic shares as one array."""
    t = table(spark, sf_dir, TOPICS)
    return spread(io.one_row(t.select("url", norm_source(F.col("source_domain")).alias("source"), "maintext", "cleantext", "ner", "stance", F.array(*PROBS).alias("topic_probs"), "topic")))


def _vectors(spark, sf_dir):
    """(url, source, topic, term, tf) of the vectorizer's vocabulary, written once a session."""

    def build():
        a = _articles(spark, sf_dir).select("url", "source", "topic", "cleantext")
        return V.vectorize(a, "url", "cleantext", (1, 2), 5, 0.85, K.ROMANIAN_STOP_WORDS).join(a.drop("cleantext"), "url")

    return once(spark, (sf_dir, "vectors"), build)


def _topic_scores(counts):
    """BM25 class scores of the topics' terms, rounded so that ties are ties everywhere."""
    by_topic = counts.where("topic >= 0").groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
    return S.class_tf_idf(by_topic, "topic").withColumn("score", F.round("score", 9))


def _bias_terms(spark, sf_dir):
    """Terms of articles that are words of topics, without those a longer one makes redundant."""
    counts = _vectors(spark, sf_dir)
    return once(spark, (sf_dir, "bias-terms"), lambda: V.bias_terms(counts, T.topic_words(_topic_scores(counts), 15)))


def _with_words(spark, sf_dir):
    return _articles(spark, sf_dir).join(V.article_words(_bias_terms(spark, sf_dir), "url"), "url", "left")


def article_bias_words(spark, sf_dir):
    """The bias words of each article, before the ignore list."""
    return V.article_words(_bias_terms(spark, sf_dir), "url").select("url", F.array_join("bias_words", "|").alias("bias_words"))


def bias_words_strict(spark, sf_dir):
    """The same with the purge that had no effect."""
    counts = _vectors(spark, sf_dir)
    kept = V.bias_terms(counts, T.topic_words(_topic_scores(counts), 15), strict_reference=True)
    return kept.groupBy("term").agg(F.count("*").alias("articles"), F.sum("tf").alias("n"))


def bm25_topic_words(spark, sf_dir):
    """The 15 best words of each topic with their BM25 class scores."""
    return T.topic_words(_topic_scores(_vectors(spark, sf_dir)), 15).select("topic", "term", "rank", "score")


def _biased(spark, sf_dir):
    return table(spark, sf_dir, "known_source_bias").where("label = 'biased'").select(norm_source(F.col("source_domain")).alias("source"))


def _features(spark, sf_dir):
    a = _with_words(spark, sf_dir)
    center = A.centroid(_articles(spark, sf_dir).join(_biased(spark, sf_dir), "source", "left_semi"), "topic_probs")
    return A.article_features(a, _biased(spark, sf_dir), center)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def article_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir))


def stance_features(spark, sf_dir):
    a = _articles(spark, sf_dir)
    s = F.col("stance")
    return _rounded(a.select("url", F.coalesce(F.size("ner"), F.lit(0)).cast("bigint").alias("entity_count"), A.stance_polarity(s).alias("stance_polarity"), A.stance_share(s, "NEGATIV").alias("negative"), A.stance_share(s, "POZITIV").alias("positive")))


def lexical_features(spark, sf_dir):
    a = _with_words(spark, sf_dir).withColumn("outside", F.regexp_replace(F.coalesce("maintext", F.lit("")), X.QUOTATION, ""))
    return _rounded(a.select("url", X.word_count(F.col("cleantext")).cast("bigint").alias("text_length"), X.avg_sentence_length(F.coalesce("cleantext", F.lit(""))).alias("avg_sentence_length"), X.count_of(F.col("outside"), "?").cast("bigint").alias("questions"), X.count_of(F.col("outside"), "!").cast("bigint").alias("exclaims"), A.bias_word_count(F.col("cleantext"), F.col("bias_words")).cast("bigint").alias("bias_words")))


def topic_entropy(spark, sf_dir):
    return _rounded(_articles(spark, sf_dir).select("url", A.entropy(F.col("topic_probs")).alias("topic_entropy")))


def topic_centroid(spark, sf_dir):
    """The mean topic shares of sources known as biased."""
    a = _articles(spark, sf_dir).join(_biased(spark, sf_dir), "source", "left_semi")
    return A.centroid(a, "topic_probs").select(F.posexplode("centroid").alias("topic", "share")).select(F.col("topic").cast("bigint").alias("topic"), F.round("share", 6).alias("share"))


def topic_similarity(spark, sf_dir):
    a = _articles(spark, sf_dir)
    center = A.centroid(a.join(_biased(spark, sf_dir), "source", "left_semi"), "topic_probs")
    return _rounded(a.withColumn("c", center.scalar()).select("url", A.cosine(F.col("topic_probs"), F.col("c")).alias("similarity")))


def topic_counts(spark, sf_dir):
    """Articles of each topic; -1 is none."""
    return _articles(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"))


def topic_argmax(spark, sf_dir):
    return _articles(spark, sf_dir).select("url", (F.array_position("topic_probs", F.array_max("topic_probs")) - 1).alias("best"))


def topics_tall(spark, sf_dir):
    """Topic columns chosen by their prefix, long."""
    t = table(spark, sf_dir, TOPICS).where("url is not null")
    cols = [c for c in t.columns if c.startswith("topic_")]
    return t.select("url", *cols).distinct().unpivot(["url"], cols, "name", "share").where("share is not null")


def _sentiment(spark, sf_dir):
    """Answers of an offline model by rule, parsed like any model's."""
    a = _articles(spark, sf_dir)
    answer = F.concat(F.lit("Sentiment: "), F.when(F.col("topic") < 0, "necunoscut").when(F.col("topic") % 3 == 0, "Pozitiv").when(F.col("topic") % 3 == 1, "Negativ").otherwise("Neutru"), F.lit("\nÎncredere: "), F.format_string("0.%d", 70 + F.col("topic") * 4))
    return a.select("url", X.sentiment_label(answer).alias("text_sentiment"), X.sentiment_confidence(answer).alias("sentiment_confidence"))


def parsed_answers(spark, sf_dir):
    return _sentiment(spark, sf_dir)


def parsed_stances(spark, sf_dir):
    """Stance words found in answers, made here of the stored stances."""
    a = _articles(spark, sf_dir).where("stance is not null").select("url", F.explode("stance").alias("s"))
    answer = F.concat(F.lit("Răspuns: "), F.lower(F.coalesce("s.stance", F.lit("?"))), F.lit("."))
    return a.select("url", F.col("s.entity").alias("entity"), X.stance_word(answer).alias("stance"))


def _matrix(spark, sf_dir):
    f = _features(spark, sf_dir).join(_sentiment(spark, sf_dir), "url", "left")
    return materialize(A.label_matrix(f), "labels")


def label_matrix(spark, sf_dir):
    f = _features(spark, sf_dir).join(_sentiment(spark, sf_dir), "url", "left")
    return A.label_matrix(f)


def lf_summary(spark, sf_dir):
    return _rounded(A.lf_summary(_matrix(spark, sf_dir), list(A.LABELLERS)))


def majority_vote(spark, sf_dir):
    return A.majority_vote(_matrix(spark, sf_dir), list(A.LABELLERS)).select("url", A.label_name(F.col("label")).alias("label"))


def _judged(spark, sf_dir):
    """Labels beside the known bias of their sources."""
    known = table(spark, sf_dir, "known_source_bias").select(norm_source(F.col("source_domain")).alias("source"), F.col("label").alias("gold"))
    labels = table(spark, sf_dir, "article_labels").where("url is not null and snorkel_label in ('biased', 'unbiased')").select("url", "snorkel_label").distinct()
    return labels.join(_articles(spark, sf_dir).select("url", "source"), "url").join(known, "source")


def gold_eval_metrics(spark, sf_dir):
    return _rounded(A.metrics(_judged(spark, sf_dir), "gold", "snorkel_label"))


def label_histogram(spark, sf_dir):
    return table(spark, sf_dir, "article_labels").groupBy("snorkel_label").agg(F.count("*").alias("n"))


def _topic_terms(spark, sf_dir):
    """(topic, term, tf) over the words of articles that have a topic."""
    a = _articles(spark, sf_dir).where("topic >= 0 and cleantext is not null")
    words = F.filter(F.regexp_extract_all(F.lower("cleantext"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.isin(*K.ROMANIAN_STOP_WORDS))
    return a.select("topic", F.explode(words).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))


def ctfidf_topic_words(spark, sf_dir):
    """Class-based tf-idf of every topic and term."""
    return _rounded(S.class_tf_idf(_topic_terms(spark, sf_dir), "topic", bm25=False))


def source_bias_words(spark, sf_dir):
    """Occurrences of each bias word by source, without the ignored ones."""
    return V.source_words(_bias_terms(spark, sf_dir), IGNORED)


def class_report(spark, sf_dir):
    """Precision, recall and support of each label against the known bias of the sources."""
    return _rounded(A.class_report(_judged(spark, sf_dir), "gold", "snorkel_label"))


def confusion(spark, sf_dir):
    return A.confusion(_judged(spark, sf_dir), "gold", "snorkel_label")


def centroid_cosine(spark, sf_dir):
    """Vectors against the centroid of their label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centers = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))
    return e.join(centers, "label").select("vec_id", F.round(A.cosine(F.col("v"), F.col("c")), 5).alias("cosine"))


QUERIES = {
    f.__name__: f
    for f in (article_features, stance_features, lexical_features, topic_entropy, topic_centroid, topic_similarity, topic_counts, topic_argmax, topics_tall, parsed_answers, parsed_stances, label_matrix, lf_summary, majority_vote, gold_eval_metrics, label_histogram, ctfidf_topic_words, article_bias_words, bias_words_strict, bm25_topic_words, source_bias_words, class_report, confusion, centroid_cosine)
}
_P = "[" + ", ".join(PROBS) + "]"
_A = rf"""
WITH a AS (SELECT url, max(nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '')) AS source, max(maintext) AS maintext, max(cleantext) AS cleantext, max(ner) AS ner, max(stance) AS stance, max({_P}) AS p, max(topic) AS topic
  FROM {TOPICS} WHERE url IS NOT NULL GROUP BY url),
b AS (SELECT nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '') AS source FROM known_source_bias WHERE label = 'biased')"""
_WORDS = rf""", wl AS (SELECT url, source, topic, list_filter(regexp_extract_all(lower(cleantext), '\p{{L}}+'), lambda x: NOT list_contains({"[" + ", ".join("'" + w + "'" for w in K.ROMANIAN_STOP_WORDS) + "]"}, x)) AS w FROM a WHERE cleantext IS NOT NULL),
wo AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM wl),
wc AS (SELECT url, any_value(source) AS source, any_value(topic) AS topic, term, count(*) AS tf FROM (SELECT url, source, topic, w[i] AS term FROM wo UNION ALL SELECT url, source, topic, w[i] || ' ' || w[i + 1] FROM wo WHERE i < len(w)) GROUP BY url, term),
wv AS (SELECT term FROM wc GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.85::DOUBLE * (SELECT count(*) FROM wl)),
wx AS (SELECT topic, term, sum(tf) AS tf FROM wc SEMI JOIN wv USING (term) WHERE topic >= 0 GROUP BY topic, term),
ws AS (SELECT topic, term, round(sqrt(tf / sum(tf) OVER (PARTITION BY topic)) * ln(((SELECT avg(n) FROM (SELECT sum(tf) AS n FROM wx GROUP BY topic)) + 1) / (sum(tf) OVER (PARTITION BY term) + 0.5)), 9) AS score FROM wx),
ww AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM ws) WHERE rank <= 15),
wk AS (SELECT wc.* FROM wc SEMI JOIN ww USING (term)),
wn AS (SELECT term, sum(tf) AS total FROM wk WHERE source IS NOT NULL GROUP BY term),
wr AS (SELECT DISTINCT s.term FROM wn s JOIN (SELECT unnest(string_split(term, ' ')) AS term, total FROM wn WHERE contains(term, ' ')) l ON l.term = s.term WHERE NOT contains(s.term, ' ') AND l.total >= 0.5::DOUBLE * s.total),
wb AS (SELECT wk.* FROM wk ANTI JOIN wr USING (term)),
wa AS (SELECT url, list_sort(list(DISTINCT term)) AS bias_words FROM wb GROUP BY url)"""
_HITS = "coalesce(list_sum(list_transform(bias_words, lambda b: (length(t) - length(replace(t, b, ''))) // length(b))), 0)"
_C = _A + ", e AS (SELECT i, avg(p[i]) AS x FROM a, range(1, 9) AS r(i) WHERE source IN (SELECT source FROM b) GROUP BY i), c AS (SELECT list(x ORDER BY i) AS c FROM e)"
_STOP = "[" + ", ".join("'" + w + "'" for w in K.ROMANIAN_STOP_WORDS) + "]"
_N = "len(list_filter(stance, lambda s: upper(s.stance) = '{}'))"
_SENT = _A + ", s AS (SELECT url, CASE WHEN topic < 0 THEN 'unknown' WHEN topic % 3 = 0 THEN 'pozitiv' WHEN topic % 3 = 1 THEN 'negativ' WHEN topic % 3 = 2 THEN 'neutru' END AS text_sentiment, CASE WHEN topic IS NOT NULL THEN ('0.' || (70 + topic * 4))::DOUBLE END AS sentiment_confidence FROM a)"
ORACLES = {
    "stance_features": _A + f" SELECT url, coalesce(len(ner), 0) AS entity_count, round(coalesce(abs({_N.format('POZITIV')} - {_N.format('NEGATIV')}) / nullif(len(stance), 0), 0), 6) AS stance_polarity, round(coalesce({_N.format('NEGATIV')} / nullif(len(stance), 0), 0), 6) AS negative, round(coalesce({_N.format('POZITIV')} / nullif(len(stance), 0), 0), 6) AS positive FROM a",
    "lexical_features": _A + _WORDS + r""", o AS (SELECT *, regexp_replace(coalesce(maintext, ''), '["''„”‘’«»]{1,10}[^"''„”‘’«»]{1,1000}?["''„”‘’«»]{1,10}', '', 'gs') AS q, lower(coalesce(cleantext, '')) AS t,
  list_filter(string_split(coalesce(cleantext, ''), '.'), lambda x: regexp_matches(x, '[^\s]')) AS z FROM a LEFT JOIN wa USING (url))
SELECT url, coalesce(len(regexp_extract_all(cleantext, '[^\s]+')), 0) AS text_length, round(coalesce(list_sum(list_transform(z, lambda x: len(regexp_extract_all(x, '[^\s]+')))) / nullif(len(z), 0), 0), 6) AS avg_sentence_length,
  (length(q) - length(replace(q, '?', '')))::BIGINT AS questions, (length(q) - length(replace(q, '!', '')))::BIGINT AS exclaims, """ + _HITS + "::BIGINT AS bias_words FROM o",
    "article_bias_words": _A + _WORDS + " SELECT url, array_to_string(bias_words, '|') AS bias_words FROM wa",
    "bias_words_strict": _A + _WORDS + " SELECT term, count(*) AS articles, sum(tf)::BIGINT AS n FROM wk GROUP BY term",
    "bm25_topic_words": _A + _WORDS + " SELECT topic, term, rank, score FROM ww",
    "topic_entropy": _A + " SELECT url, round(-coalesce(list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * log2(x))), 0), 6) AS topic_entropy FROM a",
    "topic_centroid": _C + " SELECT i - 1 AS topic, round(x, 6) AS share FROM e",
    "topic_similarity": _C + " SELECT url, round(coalesce(list_dot_product(p, c) / nullif(sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(c, c)), 0), 0), 6) AS similarity FROM a, c",
    "topic_counts": _A + " SELECT topic, count(*) AS n FROM a GROUP BY topic",
    "topic_argmax": _A + " SELECT url, list_position(p, list_max(p))::BIGINT - 1 AS best FROM a",
    "topics_tall": f"SELECT url, name, share FROM (SELECT DISTINCT url, {', '.join(PROBS)} FROM {TOPICS} WHERE url IS NOT NULL) UNPIVOT (share FOR name IN ({', '.join(PROBS)}))",
    "parsed_stances": _A + ", s AS (SELECT url, unnest(stance) AS s FROM a WHERE stance IS NOT NULL) SELECT url, s.entity AS entity, CASE WHEN upper(s.stance) IN ('POZITIV', 'NEGATIV', 'NEUTRU') THEN upper(s.stance) ELSE 'UNKNOWN' END AS stance FROM s",
    "gold_eval_metrics": _A + r""", l AS (SELECT DISTINCT url, snorkel_label AS g FROM article_labels WHERE url IS NOT NULL AND snorkel_label IN ('biased', 'unbiased')),
j AS (SELECT k.label AS t, g FROM l JOIN a USING (url) JOIN (SELECT nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '') AS source, label FROM known_source_bias) k ON k.source = a.source),
m AS (SELECT count(*) AS n, avg((t = g)::INT) AS accuracy, count(*) FILTER (t = 'unbiased' AND g = 'unbiased') AS tp, count(*) FILTER (t <> 'unbiased' AND g = 'unbiased') AS fp, count(*) FILTER (t = 'unbiased' AND g <> 'unbiased') AS fn FROM j),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m)
SELECT n, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q""",
    "label_histogram": "SELECT snorkel_label, count(*) AS n FROM article_labels GROUP BY snorkel_label",
    "ctfidf_topic_words": _A + rf""", w AS (SELECT topic, unnest(regexp_extract_all(lower(cleantext), '\p{{L}}+')) AS term FROM a WHERE topic >= 0 AND cleantext IS NOT NULL),
t AS (SELECT topic, term, count(*) AS tf FROM w WHERE NOT list_contains({_STOP}, term) GROUP BY topic, term),
x AS (SELECT *, sum(tf) OVER (PARTITION BY topic) AS c, sum(tf) OVER (PARTITION BY term) AS f FROM t)
SELECT topic, term, round(sqrt(tf / c) * ln(1 + (SELECT avg(n) FROM (SELECT sum(tf) AS n FROM t GROUP BY topic)) / f), 6) AS score FROM x""",
    "source_bias_words": _A + _WORDS + " SELECT source, term AS word, sum(tf)::BIGINT AS n FROM wb WHERE source IS NOT NULL AND term NOT IN (" + ", ".join(f"'{w}'" for w in IGNORED) + ") GROUP BY source, term",
    "centroid_cosine": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) AS r(i) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM x GROUP BY label) SELECT vec_id, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 5) AS cosine FROM e JOIN c USING (label)",
    "parsed_answers": _SENT + " SELECT url, coalesce(text_sentiment, 'unknown') AS text_sentiment, coalesce(sentiment_confidence, 0) AS sentiment_confidence FROM s",
}


_QUOTES = X.QUOTES.replace("'", "''")
_QUOTATION = f"[{_QUOTES}]{{1,10}}[^{_QUOTES}]{{1,1000}}?[{_QUOTES}]{{1,10}}"


def _in(words):
    return "len(list_filter(regexp_extract_all(t, '\\p{L}+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


_F = (
    _C
    + _WORDS
    + rf""", o AS (SELECT a.*, bias_words, c.c, regexp_replace(coalesce(maintext, ''), '{_QUOTATION}', '', 'gs') AS q, lower(coalesce(cleantext, '')) AS t,
  list_filter(string_split(coalesce(cleantext, ''), '.'), lambda x: regexp_matches(x, '[^\s]')) AS z FROM a LEFT JOIN wa USING (url), c),
f0 AS (SELECT url, coalesce(len(regexp_extract_all(cleantext, '[^\s]+')), 0)::INT AS text_length, coalesce(list_sum(list_transform(z, lambda x: len(regexp_extract_all(x, '[^\s]+')))) / nullif(len(z), 0), 0) AS avg_sentence_length,
  coalesce(len(ner), 0)::INT AS entity_count, """
    + f"coalesce(abs({_N.format('POZITIV')} - {_N.format('NEGATIV')}) / nullif(len(stance), 0), 0) AS stance_polarity, coalesce({_N.format('NEGATIV')} / nullif(len(stance), 0), 0) AS negative_stance_polarity, coalesce({_N.format('POZITIV')} / nullif(len(stance), 0), 0) AS positive_stance_polarity, "
    + f"{_in(A.CONDITIONAL)}::INT AS cond_mood_count, (length(q) - length(replace(q, '?', '')))::INT AS question_count, (length(q) - length(replace(q, '!', '')))::INT AS exclaim_count, {_in(A.FIRST_PERSON)}::INT AS first_pronouns, {_in(A.SECOND_PERSON)}::INT AS second_pronouns, {_HITS}"
    + "::INT AS bias_word_count, CASE WHEN source IN (SELECT source FROM b) THEN 1 ELSE 0 END AS source_known_biased, coalesce(list_dot_product(p, c) / nullif(sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(c, c)), 0), 0) AS topic_sim_bias, -coalesce(list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * log2(x))), 0) AS topic_entropy FROM o), "
    + "f AS (SELECT *, coalesce(bias_word_count / nullif(text_length, 0), 0) AS bias_word_ratio FROM f0)"
)
_VOTES = {
    "high_bias_word_ratio": "bias_word_ratio > 0.09::DOUBLE THEN 0", "excessive_exclaims": "exclaim_count > 5 THEN 0", "excessive_questions": "question_count > 5 THEN 0", "strong_sentiment": "text_sentiment IN ('pozitiv', 'negativ') AND sentiment_confidence > 0.8::DOUBLE THEN 0",
    "low_topic_entropy": "topic_entropy < 3 THEN 0", "conditional_hedging": "cond_mood_count > 6 THEN 0", "topic_sim_to_biased": "topic_sim_bias > 0.5::DOUBLE THEN 0", "high_entropy": "topic_entropy > 5 THEN 1",
    "neutral_sentiment": "text_sentiment = 'neutru' AND sentiment_confidence > 0.7::DOUBLE THEN 1", "clean": "bias_word_ratio <= 0.1::DOUBLE AND exclaim_count = 0 AND question_count = 0 AND cond_mood_count <= 2 AND text_sentiment = 'neutru' THEN 1",
    "high_first_pronouns": "first_pronouns > 4 THEN 0", "high_second_pronouns": "second_pronouns > 2 THEN 0", "short_sentences": "avg_sentence_length > 5 AND avg_sentence_length < 12 THEN 1",
    "balanced_stance": "positive_stance_polarity <= 0.3::DOUBLE AND negative_stance_polarity < 0.6::DOUBLE THEN 1", "excess_positive_stance": "positive_stance_polarity > 0.3::DOUBLE THEN 0", "excess_negative_stance": "negative_stance_polarity >= 0.6::DOUBLE THEN 0",
}
_L = _F + _SENT.removeprefix(_A).replace(", s AS", ", s AS", 1) + ", l AS (SELECT url, " + ", ".join(f"CASE WHEN {v} ELSE -1 END AS {k}" for k, v in _VOTES.items()) + " FROM f LEFT JOIN (SELECT url, coalesce(text_sentiment, 'unknown') AS text_sentiment, coalesce(sentiment_confidence, 0) AS sentiment_confidence FROM s) USING (url))"
_ALL = "[" + ", ".join(_VOTES) + "]"
_FEATURE_COLUMNS = "url text_length entity_count cond_mood_count question_count exclaim_count first_pronouns second_pronouns bias_word_count source_known_biased".split()
_FEATURE_SHARES = "avg_sentence_length stance_polarity negative_stance_polarity positive_stance_polarity bias_word_ratio topic_sim_bias topic_entropy".split()
_BINS = _F + """, h AS (SELECT url, round(coalesce(bias_word_ratio, 0), 9) AS x, round(coalesce(topic_entropy, 0), 9) AS y FROM f),
qx AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS q, quantile_cont(y, [0.25, 0.5, 0.75]) AS r FROM h),
cells AS (SELECT url, (x >= q[1])::INT + (x >= q[2])::INT + (x >= q[3])::INT AS bx, (y >= r[1])::INT + (y >= r[2])::INT + (y >= r[3])::INT AS by_ FROM h, qx),
picked AS (SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || url), url) AS n FROM a WHERE source IS NOT NULL) WHERE n <= 4
  UNION SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY bx, by_ ORDER BY md5('42:' || url), url) AS n FROM cells) WHERE n <= 2)"""
_JUDGED = _A + r""", l AS (SELECT DISTINCT url, snorkel_label AS g FROM article_labels WHERE url IS NOT NULL AND snorkel_label IN ('biased', 'unbiased')),
j AS (SELECT k.label AS t, g FROM l JOIN a USING (url) JOIN (SELECT nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '') AS source, label FROM known_source_bias) k ON k.source = a.source)"""
ORACLES |= {
    "template_sample": _BINS + " SELECT url, 'abstain' AS label FROM picked ORDER BY md5('42:' || url), url LIMIT 100",
    "confusion": _JUDGED + " SELECT t AS gold, g AS snorkel_label, count(*) AS n FROM j GROUP BY t, g",
    "class_report": _JUDGED + """, k AS (SELECT label, (SELECT count(*) FROM j WHERE t = label) AS support, (SELECT count(*) FROM j WHERE g = label) AS given, (SELECT count(*) FROM j WHERE g = label AND t = label) AS hit FROM (SELECT t AS label FROM j UNION SELECT g FROM j)),
r AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS c FROM k)
SELECT label, support, round(p, 6) AS precision, round(c, 6) AS recall, round(coalesce(2 * p * c / nullif(p + c, 0), 0), 6) AS f1 FROM r""",
    "article_features": _F + " SELECT " + ", ".join(_FEATURE_COLUMNS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURE_SHARES) + " FROM f",
    "label_matrix": _L + " SELECT * FROM l",
    "majority_vote": _L + f", v AS (SELECT url, len(list_filter({_ALL}, lambda x: x = 0)) AS z, len(list_filter({_ALL}, lambda x: x = 1)) AS o FROM l) SELECT url, CASE WHEN z > o THEN 'biased' WHEN o > z THEN 'unbiased' ELSE 'abstain' END AS label FROM v",
    "lf_summary": _L + f", v AS (SELECT *, list_filter({_ALL}, lambda x: x >= 0) AS w FROM l) " + " UNION ALL ".join(f"SELECT '{k}' AS lf, round(avg(({k} >= 0)::INT), 6) AS coverage, round(avg(({k} >= 0 AND len(w) > 1)::INT), 6) AS overlaps, round(avg(({k} >= 0 AND len(list_distinct(w)) > 1)::INT), 6) AS conflicts, coalesce(array_to_string(list_sort(list(DISTINCT {k}) FILTER ({k} >= 0)), ','), '') AS polarity FROM v" for k in _VOTES),
}
