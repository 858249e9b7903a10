"""Queries on phrases and sources (families F, J and D of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.functions import tokens as K
from presslens.operators import matrix as M
from presslens.operators import scores as S
from presslens.operators import vocabulary as V
from presslens.session import norm_source, table
from presslens.sources import io
from presslens.storage import materialize, once, shared_dir

STOP = K.ROMANIAN_STOP_WORDS


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of all documents with 1- to 3-grams, written once a session for all queries that read it."""
    return once(spark, (sf_dir, "phrases"), lambda: M.phrase_matrix(table(spark, sf_dir, "documents"), "text", "source", STOP))


_STOP_SQL = "[" + ", ".join("'" + w + "'" for w in STOP) + "]"
_GRAMS = rf"""
WITH d AS (SELECT doc_id, source AS domain, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}\-]+'), lambda x: regexp_full_match(replace(x, '-', ''), '\p{{L}}+')) AS w
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND len(regexp_extract_all(text, '[^\s]+')) > 30),
o AS (SELECT doc_id, domain, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, domain, w[i:i] AS p FROM o UNION ALL SELECT doc_id, domain, w[i:i + 1] FROM o WHERE i + 1 <= len(w) UNION ALL SELECT doc_id, domain, w[i:i + 2] FROM o WHERE i + 2 <= len(w)),
s AS (SELECT DISTINCT doc_id, domain, array_to_string(p, ' ') AS phrase FROM g WHERE len(list_filter(p, lambda x: NOT list_contains({_STOP_SQL}, lower(x)))) > 0),
m AS (SELECT phrase, domain, count(*) AS n FROM s WHERE NOT contains(phrase, 'PERIOD') GROUP BY phrase, domain)
"""
_TOTALS = _GRAMS + ", t AS (SELECT phrase, sum(n)::BIGINT AS total, max(n) AS top, count(*) AS domains FROM m GROUP BY phrase)"
_REDUNDANT = (
    _TOTALS
    + """, z AS (SELECT phrase, total, string_split(phrase, ' ') AS w FROM t),
l AS (SELECT DISTINCT unnest([w[1], w[2]]) AS phrase, phrase AS big, total FROM z WHERE len(w) = 2
  UNION SELECT DISTINCT unnest(w), phrase, total FROM z WHERE len(w) = 3
  UNION SELECT DISTINCT unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]), phrase, total FROM z WHERE len(w) = 3),
r AS (SELECT DISTINCT z.phrase FROM z JOIN l ON z.phrase = l.phrase WHERE l.total >= 0.7::DOUBLE * z.total)"""
)
_PRUNED = (
    _REDUNDANT
    + """, k AS (SELECT m.* FROM m ANTI JOIN r USING (phrase)),
kt AS (SELECT phrase FROM k GROUP BY phrase HAVING max(n) / sum(n) <= 0.9::DOUBLE AND count(*) / (SELECT count(DISTINCT domain) FROM m) <= 0.9::DOUBLE),
q AS (SELECT k.* FROM k SEMI JOIN kt USING (phrase))"""
)


def phrase_source_matrix(spark, sf_dir):
    return _phrases(spark, sf_dir)


def phrase_totals(spark, sf_dir):
    return M.totals(_phrases(spark, sf_dir), "phrase")


def too_good_phrases(spark, sf_dir):
    return M.too_good(_phrases(spark, sf_dir)).withColumn("dominance_ratio", F.round("dominance_ratio", 6))


def ubiquitous_phrases(spark, sf_dir):
    m = _phrases(spark, sf_dir)
    return M.ubiquitous(m, M.domain_count(m)).withColumn("phrase_ubiquity", F.round("phrase_ubiquity", 6))


def redundant_ngrams(spark, sf_dir):
    return M.redundant(_phrases(spark, sf_dir))


def pruned_matrix(spark, sf_dir):
    return M.prune(_phrases(spark, sf_dir))


def _pruned(spark, sf_dir):
    return once(spark, (sf_dir, "pruned"), lambda: pruned_matrix(spark, sf_dir))


def pmi_cells(spark, sf_dir):
    return S.pmi(_pruned(spark, sf_dir)).withColumn("pmi", F.round("pmi", 6))


def phrase_mi(spark, sf_dir):
    return S.mi(S.require_nonzero(_pruned(spark, sf_dir))).withColumn("mi", F.round("mi", 9))


def phrase_mi_top(spark, sf_dir):
    return phrase_mi(spark, sf_dir).orderBy(F.desc("mi"), "phrase").limit(50)


def total_mi(spark, sf_dir):
    return S.total_mi(_pruned(spark, sf_dir)).select(F.round("total_mi", 6).alias("total_mi"))


def tfidf_phrase(spark, sf_dir):
    return S.tf_idf(_pruned(spark, sf_dir)).withColumn("tfidf", F.round("tfidf", 6))


def max_tfidf_top(spark, sf_dir):
    return S.max_tf_idf(_pruned(spark, sf_dir)).withColumn("max_tfidf", F.round("max_tfidf", 6)).orderBy(F.desc("max_tfidf"), "phrase").limit(50)


def matrix_marginals(spark, sf_dir):
    """Grand total, row sums and column sums as grouping sets."""
    m = _phrases(spark, sf_dir)
    m.createOrReplaceTempView("presslens_matrix")
    sums = spark.sql("SELECT grouping_id(phrase, domain) AS level, phrase, domain, sum(n) AS n FROM presslens_matrix GROUP BY GROUPING SETS ((), (phrase), (domain))")
    return sums.select(F.col("level").cast("bigint").alias("level"), "phrase", "domain", "n")


def word_filter(spark, sf_dir):
    """Documents long enough for the matrix (more than 30 words) and for the models (30 terms or more)."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", (X.word_count(F.col("text")) > 30).alias("for_matrix"), (F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) >= 30).alias("for_models"))


def vectorizer_vocab(spark, sf_dir):
    """Terms in at least 5 documents and at most a share of 0.85 of them, with their documents and occurrences."""
    counts = V.vectorize(table(spark, sf_dir, "documents"), "doc_id", "text", (1, 2), 5, 0.85, STOP)
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vocab_by_size(spark, sf_dir):
    return vectorizer_vocab(spark, sf_dir).groupBy(K.gram_size(F.col("term")).cast("bigint").alias("size")).agg(F.count("*").alias("terms"), F.sum("tf").alias("occurrences"))


def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("sentences"))


def chunk_rules(spark, sf_dir):
    """What chunks of sentences must keep: all words in their order, and at most 512 words unless a sentence alone has more."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", X.sentences(F.col("text")).alias("s"))
    d = d.withColumn("c", K.chunk_sentences(F.col("s"), 512))
    size = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^\s]+"), F.lit(0)))
    fits = F.forall("c", lambda x: (size(x) <= 512) | F.array_contains("s", x))
    return d.select("doc_id", (F.array_join(F.filter("c", lambda x: x != ""), " ") == F.array_join("s", " ")).alias("whole"), fits.alias("fits"))


def sentence_chunks(spark, sf_dir):
    """Chunks of sentences under 512 words, as a model takes them."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(K.chunk_sentences(X.sentences(F.col("text")), 512)).alias("chunk", "text"))


def author_lists(spark, sf_dir):
    """Distinct author names of each article, sorted."""
    d = table(spark, sf_dir, "romanian_political_articles_v2_shuffled").where("url is not null and authors is not null")
    names = d.select("url", F.explode(F.split("authors", ";")).alias("name")).select("url", F.trim("name").alias("name")).where("name <> ''").distinct()
    return names.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("authors"))


def matrix_csv(spark, sf_dir):
    """The entity matrix written wide as a labelled CSV, read back, and made long again."""
    import uuid

    m = materialize(M.entity_matrix(table(spark, sf_dir, "romanian_political_articles_v2_ner").select("url", norm_source(F.col("source_domain")).alias("source_domain"), "ner")), "entities")
    path = f"{shared_dir(spark)}/presslens/wide-{uuid.uuid4().hex}"
    io.write_csv(M.pivot_matrix(m, "entity"), path, index_label="label")
    back = M.unpivot_matrix(io.read_matrix_csv(spark, path, "entity"), "entity")
    return back.select("entity", "domain", F.col("n").cast("bigint").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (phrase_source_matrix, phrase_totals, too_good_phrases, ubiquitous_phrases, redundant_ngrams, pruned_matrix, pmi_cells, phrase_mi, phrase_mi_top, total_mi, tfidf_phrase, max_tfidf_top, matrix_marginals, word_filter, vectorizer_vocab, vocab_by_size, sentence_counts, sentence_chunks, chunk_rules, author_lists, matrix_csv)
}
_MI = _PRUNED + """, rs AS (SELECT phrase, sum(n)::DOUBLE AS r FROM q GROUP BY phrase), cs AS (SELECT domain, sum(n)::DOUBLE AS c FROM q GROUP BY domain),
a AS (SELECT sum(n)::DOUBLE AS t FROM q), c2 AS (SELECT q.phrase, q.domain, n::DOUBLE AS n, r, c, t FROM q JOIN rs USING (phrase) JOIN cs USING (domain), a)"""
_TFIDF = _PRUNED + """, f AS (SELECT *, n * (ln((1 + (SELECT count(DISTINCT domain) FROM q)) / (1 + count(*) OVER (PARTITION BY phrase))) + 1) AS w FROM q),
x AS (SELECT phrase, domain, w / sqrt(sum(w * w) OVER (PARTITION BY domain)) AS tfidf FROM f)"""
_VOCAB = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: NOT list_contains({_STOP_SQL}, x)) AS w FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, w[i] AS term FROM o UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM o WHERE i < len(w)),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.85::DOUBLE * (SELECT count(*) FROM d))
"""
ORACLES = {
    "phrase_source_matrix": _GRAMS + "SELECT * FROM m",
    "phrase_totals": _TOTALS + " SELECT * FROM t",
    "too_good_phrases": _TOTALS + " SELECT phrase, total, round(top / total, 6) AS dominance_ratio FROM t WHERE top / total > 0.9::DOUBLE",
    "ubiquitous_phrases": _TOTALS + " SELECT phrase, total, round(domains / (SELECT count(DISTINCT domain) FROM m), 6) AS phrase_ubiquity FROM t WHERE domains / (SELECT count(DISTINCT domain) FROM m) > 0.9::DOUBLE",
    "redundant_ngrams": _REDUNDANT + " SELECT phrase FROM r",
    "pruned_matrix": _PRUNED + " SELECT * FROM q",
    "pmi_cells": _MI + " SELECT phrase, domain, round(log2(n * t / (r * c)), 6) AS pmi FROM c2",
    "phrase_mi": _MI + " SELECT phrase, round(sum(n / t * log2(n * t / (r * c))), 9) AS mi FROM c2 GROUP BY phrase",
    "phrase_mi_top": _MI + " SELECT phrase, round(sum(n / t * log2(n * t / (r * c))), 9) AS mi FROM c2 GROUP BY phrase ORDER BY mi DESC, phrase LIMIT 50",
    "total_mi": _MI + " SELECT round(sum(n / t * log2(n * t / (r * c))), 6) AS total_mi FROM c2",
    "tfidf_phrase": _TFIDF + " SELECT phrase, domain, round(tfidf, 6) AS tfidf FROM x",
    "max_tfidf_top": _TFIDF + " SELECT phrase, round(max(tfidf), 6) AS max_tfidf FROM x GROUP BY phrase ORDER BY max_tfidf DESC, phrase LIMIT 50",
    "matrix_marginals": _GRAMS + " SELECT 3 AS level, NULL AS phrase, NULL AS domain, sum(n)::BIGINT AS n FROM m UNION ALL SELECT 1, phrase, NULL, sum(n)::BIGINT FROM m GROUP BY phrase UNION ALL SELECT 2, NULL, domain, sum(n)::BIGINT FROM m GROUP BY domain",
    "word_filter": r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) > 30 AS for_matrix, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) >= 30 AS for_models FROM documents WHERE text IS NOT NULL",
    "sentence_counts": r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[ \t\n\x{0b}\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> ''))::BIGINT AS sentences FROM documents WHERE text IS NOT NULL",
    "chunk_rules": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text IS NOT NULL",
    "matrix_csv": r"SELECT entity, domain, count(*) AS n FROM (SELECT DISTINCT url, nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '') AS domain, unnest(ner) AS entity FROM romanian_political_articles_v2_ner) WHERE url IS NOT NULL AND domain IS NOT NULL AND entity IS NOT NULL GROUP BY entity, domain",
    "vectorizer_vocab": _VOCAB + "SELECT * FROM v",
    "vocab_by_size": _VOCAB + "SELECT len(string_split(term, ' ')) AS size, count(*) AS terms, sum(tf)::BIGINT AS occurrences FROM v GROUP BY 1",
    "author_lists": "SELECT url, array_to_string(list_sort(list(DISTINCT name)), '; ') AS authors FROM (SELECT url, trim(unnest(string_split(authors, ';'))) AS name FROM romanian_political_articles_v2_shuffled WHERE url IS NOT NULL AND authors IS NOT NULL) WHERE name <> '' GROUP BY url",
}
