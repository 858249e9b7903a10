"""Queries on entities, stances and domains (families E, F, I, K of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.operators import entities as E
from presslens.operators import matrix as M
from presslens.operators import scores as S
from presslens.session import norm_source, table
from presslens.storage import materialize

NER, TOPICS, FEATURES = "romanian_political_articles_v2_ner", "romanian_political_articles_v2_nlp_with_topics", "entity_source_sentiment_features"


def _named(spark, sf_dir):
    return table(spark, sf_dir, NER).select("url", norm_source(F.col("source_domain")).alias("source_domain"), "ner")


def _stances(spark, sf_dir):
    a = table(spark, sf_dir, TOPICS).select("url", norm_source(F.col("source_domain")).alias("source_domain"), "stance")
    return a.where("url is not null")


def entity_domain_crosstab(spark, sf_dir):
    return M.entity_matrix(_named(spark, sf_dir))


def entity_matrix_wide_long(spark, sf_dir):
    """The entity matrix made wide and long again."""
    m = materialize(M.entity_matrix(_named(spark, sf_dir)), "entities")
    return M.unpivot_matrix(M.pivot_matrix(m, "entity"), "entity")


def entity_pmi(spark, sf_dir):
    return S.pmi(M.entity_matrix(_named(spark, sf_dir)), "entity").withColumn("pmi", F.round("pmi", 6))


def entity_mi(spark, sf_dir):
    return S.mi(M.entity_matrix(_named(spark, sf_dir)), "entity").withColumn("mi", F.round("mi", 9))


def entity_tfidf(spark, sf_dir):
    return S.tf_idf(M.entity_matrix(_named(spark, sf_dir)), "entity").withColumn("tfidf", F.round("tfidf", 6))


def stance_counts(spark, sf_dir):
    return E.stance_counts(_stances(spark, sf_dir)).withColumn("bias_score", F.round("bias_score", 6)).withColumn("polarity", F.round("polarity", 6))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def domain_sentiment_features(spark, sf_dir):
    return _rounded(E.domain_features(E.stance_counts(_stances(spark, sf_dir))))


def domain_sentiment_by_document(spark, sf_dir):
    return _rounded(E.domain_features(E.stance_counts(_stances(spark, sf_dir)), "document"))


def summed_batches(spark, sf_dir):
    """Counts of a name and domain added up over batches, repeated rows once."""
    f = table(spark, sf_dir, FEATURES).where("entity is not null and domain is not null")
    each = f.select("entity", "domain", "batch", "pos_count", "neg_count", "neu_count").distinct()
    sums = each.groupBy("entity", "domain").agg(*(F.sum(c).alias(c) for c in ("pos_count", "neg_count", "neu_count")))
    return _rounded(E.with_scores(sums))


def _mapping(spark, sf_dir):
    """A canonical form by rule: names in upper case to capitals."""
    names = table(spark, sf_dir, NER).select(F.explode("ner").alias("raw")).where("raw is not null").select(F.trim("raw").alias("raw")).distinct()
    return names.where("raw = upper(raw) and raw <> lower(raw)").select("raw", F.lower("raw").alias("canonical"))


def normalize_entities(spark, sf_dir):
    """Names of each article through a map with the name itself as default."""
    a = table(spark, sf_dir, NER).where("url is not null and size(ner) > 0").groupBy("url").agg(F.max("ner").alias("ner"))
    out = E.normalize_list(a, "url", "ner", _mapping(spark, sf_dir))
    return out.select("url", F.concat_ws("|", "ner").alias("names"))


def normalized_stances(spark, sf_dir):
    return E.stance_counts(_stances(spark, sf_dir), mapping=_mapping(spark, sf_dir)).select("entity", "domain", "pos_count", "neg_count", "neu_count", "total")


def _standard(spark, sf_dir):
    f = E.domain_features(E.stance_counts(_stances(spark, sf_dir)))
    return materialize(E.standardize(f.select("domain", *E.FEATURES), E.FEATURES), "standard")


def standardized_features(spark, sf_dir):
    f = E.domain_features(E.stance_counts(_stances(spark, sf_dir)))
    return E.standardize(f.select("domain", *E.FEATURES), E.FEATURES).select("domain", *(F.round(c, 5).alias(c) for c in E.FEATURES))


def domain_pca(spark, sf_dir):
    """Domains on their first two principal components."""
    return E.pca(_standard(spark, sf_dir), E.FEATURES)[0].select("domain", "PC1", "PC2")


def domain_clusters(spark, sf_dir):
    """Domains with the clusters of the best k on the two components."""
    pcs = materialize(domain_pca(spark, sf_dir), "pcs")
    return E.best_clusters(pcs, "domain", ["PC1", "PC2"])[0].select("domain", "PC1", "PC2", "cluster")


def silhouette_by_k(spark, sf_dir):
    pcs = materialize(domain_pca(spark, sf_dir), "pcs")
    return E.best_clusters(pcs, "domain", ["PC1", "PC2"])[1]


def pca_shares(spark, sf_dir):
    """Explained variance of the two components."""
    shares = E.pca(_standard(spark, sf_dir), E.FEATURES)[1]
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(shares)], "component int, share double")


def cluster_rules(spark, sf_dir):
    """What components and clusters must keep."""
    pcs, shares = E.pca(_standard(spark, sf_dir), E.FEATURES)
    pcs = materialize(pcs.select("domain", "PC1", "PC2"), "pcs")
    made, scores = E.best_clusters(pcs, "domain", ["PC1", "PC2"])
    made = materialize(made.select("domain", "PC1", "PC2", "cluster"), "made")
    v = pcs.agg(F.var_pop("PC1"), F.var_pop("PC2"), F.covar_pop("PC1", "PC2"), F.avg("PC1"), F.avg("PC2")).first()
    best = max(r[1] for r in scores.collect())
    centers = made.groupBy("cluster").agg(F.avg("PC1").alias("x"), F.avg("PC2").alias("y"))
    d = made.crossJoin(F.broadcast(centers.withColumnRenamed("cluster", "other"))).withColumn("d", F.hypot(F.col("PC1") - F.col("x"), F.col("PC2") - F.col("y")))  # a row a domain, a handful of centers
    near = d.groupBy("domain", "cluster").agg(F.min_by("other", "d").alias("nearest"))
    rules = {
        "components are centred": abs(v[3]) < 1e-6 and abs(v[4]) < 1e-6,
        "components are uncorrelated": abs(v[2]) < 1e-6,
        "the first explains more": v[0] >= v[1] and shares[0] >= shares[1],
        "shares are of variances": abs(shares[0] * v[1] - shares[1] * v[0]) < 1e-6,
        "the best silhouette is kept": abs(E.silhouette(made, "domain", ["PC1", "PC2"]).first()[0] - best) < 1e-9,
        "domains are in their nearest cluster": near.where("cluster <> nearest").count() == 0,
    }
    return spark.createDataFrame([(k, bool(x)) for k, x in rules.items()], "rule string, holds boolean")


def _fixed_clusters(spark, sf_dir):
    """Domains by the sign of their bias, for exact comparison."""
    f = E.domain_features(E.stance_counts(_stances(spark, sf_dir)))
    return f.select("domain", *E.FEATURES, (F.col("bias_score") > 0).cast("int").alias("cluster"))


def silhouette_given_labels(spark, sf_dir):
    return E.silhouette(_fixed_clusters(spark, sf_dir), "domain", ["pos_rate", "neg_rate"]).select(F.round("silhouette_score", 6).alias("silhouette_score"))


def cluster_summary(spark, sf_dir):
    return E.cluster_summary(_fixed_clusters(spark, sf_dir), ["pos_rate", "neg_rate", "entropy"])


QUERIES = {
    f.__name__: f
    for f in (entity_domain_crosstab, entity_matrix_wide_long, entity_pmi, entity_mi, entity_tfidf, stance_counts, domain_sentiment_features, domain_sentiment_by_document, summed_batches, normalize_entities, normalized_stances, standardized_features, domain_pca, pca_shares, cluster_rules, domain_clusters, silhouette_by_k, silhouette_given_labels, cluster_summary)
}
_SRC = r"nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '')"
_M = f"""
WITH e AS (SELECT DISTINCT url, {_SRC} AS domain, unnest(ner) AS entity FROM {NER}),
m AS (SELECT entity, domain, count(*) AS n FROM e WHERE url IS NOT NULL AND domain IS NOT NULL AND entity IS NOT NULL GROUP BY entity, domain)"""
_MC = _M + """, r AS (SELECT entity, sum(n)::DOUBLE AS r FROM m GROUP BY entity), c AS (SELECT domain, sum(n)::DOUBLE AS c FROM m GROUP BY domain), a AS (SELECT sum(n)::DOUBLE AS t FROM m),
x AS (SELECT entity, domain, n::DOUBLE AS n, r, c, t FROM m JOIN r USING (entity) JOIN c USING (domain), a)"""
_ST = f"""
WITH e AS (SELECT {_SRC} AS domain, unnest(stance) AS s FROM {TOPICS} WHERE url IS NOT NULL),
f AS (SELECT domain, s.entity AS entity, upper(s.stance) AS stance FROM e WHERE domain IS NOT NULL AND s.entity IS NOT NULL AND upper(s.stance) IN ('POZITIV', 'NEGATIV', 'NEUTRU')),
c AS (SELECT entity, domain, count(*) FILTER (stance = 'POZITIV') AS pos_count, count(*) FILTER (stance = 'NEGATIV') AS neg_count, count(*) FILTER (stance = 'NEUTRU') AS neu_count, count(*) AS total FROM f GROUP BY entity, domain),
s AS (SELECT *, (pos_count - neg_count) / total AS bias_score, abs(pos_count - neg_count) / total AS polarity FROM c)"""


def _features_sql(seen: str) -> str:
    return (
        _ST
        + f""", i AS (SELECT entity, ln((SELECT count(DISTINCT domain) FROM s)::DOUBLE / ({seen.format('pos_count')} + 1e-9)) AS pi, ln((SELECT count(DISTINCT domain) FROM s)::DOUBLE / ({seen.format('neg_count')} + 1e-9)) AS ni FROM s GROUP BY entity),
d AS (SELECT domain, sum(pos_count)::BIGINT AS pos_count, sum(neg_count)::BIGINT AS neg_count, sum(neu_count)::BIGINT AS neu_count, avg(bias_score) AS bias_score, avg(polarity) AS polarity, sum(pos_count * pi) AS pos_tfidf, sum(neg_count * ni) AS neg_tfidf FROM s JOIN i USING (entity) GROUP BY domain),
g AS (SELECT *, pos_count + neg_count + neu_count AS total_mentions FROM d),
h AS (SELECT *, pos_count / total_mentions AS pos_rate, neg_count / total_mentions AS neg_rate, neu_count / total_mentions AS neu_rate FROM g),
k AS (SELECT *, -(greatest(pos_rate, 1e-9) * ln(greatest(pos_rate, 1e-9)) + greatest(neg_rate, 1e-9) * ln(greatest(neg_rate, 1e-9)) + greatest(neu_rate, 1e-9) * ln(greatest(neu_rate, 1e-9))) AS entropy FROM h)"""
    )


_DISTINCT, _DOCUMENT = _features_sql("count(DISTINCT CASE WHEN {0} > 0 THEN {0} END)"), _features_sql("count(*) FILTER ({0} > 0)")
_OUT = " SELECT domain, pos_count, neg_count, neu_count, total_mentions, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("bias_score", "polarity", "pos_tfidf", "neg_tfidf", "pos_rate", "neg_rate", "neu_rate", "entropy")) + " FROM k"
_MAP = f"(SELECT DISTINCT trim(r) AS raw, lower(trim(r)) AS canonical FROM (SELECT unnest(ner) AS r FROM {NER}) WHERE r IS NOT NULL AND trim(r) = upper(trim(r)) AND trim(r) <> lower(trim(r)))"
_SIL = _DISTINCT + """, p AS (SELECT domain, pos_rate AS x, neg_rate AS y, CASE WHEN bias_score > 0 THEN 1 ELSE 0 END AS cl FROM k),
w AS (SELECT a.domain, a.cl, b.cl AS oc, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b ON a.domain <> b.domain GROUP BY 1, 2, 3),
z AS (SELECT p.domain, max(CASE WHEN w.cl = oc THEN d END) AS a, min(CASE WHEN w.cl <> oc THEN d END) AS b FROM p LEFT JOIN w USING (domain) GROUP BY p.domain)"""
ORACLES = {
    "entity_domain_crosstab": _M + " SELECT * FROM m",
    "entity_matrix_wide_long": _M + " SELECT * FROM m",
    "entity_pmi": _MC + " SELECT entity, domain, round(log2(n * t / (r * c)), 6) AS pmi FROM x",
    "entity_mi": _MC + " SELECT entity, round(sum(n / t * log2(n * t / (r * c))), 9) AS mi FROM x GROUP BY entity",
    "entity_tfidf": _M + """, f AS (SELECT *, n * (ln((1 + (SELECT count(DISTINCT domain) FROM m)) / (1 + count(*) OVER (PARTITION BY entity))) + 1) AS w FROM m)
SELECT entity, domain, round(w / sqrt(sum(w * w) OVER (PARTITION BY domain)), 6) AS tfidf FROM f""",
    "stance_counts": _ST + " SELECT entity, domain, pos_count, neg_count, neu_count, total, round(bias_score, 6) AS bias_score, round(polarity, 6) AS polarity FROM s",
    "domain_sentiment_features": _DISTINCT + _OUT,
    "domain_sentiment_by_document": _DOCUMENT + _OUT,
    "summed_batches": f"""WITH c AS (SELECT entity, domain, sum(pos_count)::BIGINT AS pos_count, sum(neg_count)::BIGINT AS neg_count, sum(neu_count)::BIGINT AS neu_count FROM (SELECT DISTINCT entity, domain, batch, pos_count, neg_count, neu_count FROM {FEATURES} WHERE entity IS NOT NULL AND domain IS NOT NULL) GROUP BY entity, domain),
t AS (SELECT *, pos_count + neg_count + neu_count AS total FROM c)
SELECT *, round(CASE WHEN total > 0 THEN (pos_count - neg_count) / total ELSE 0 END, 6) AS bias_score, round(CASE WHEN total > 0 THEN abs(pos_count - neg_count) / total ELSE 0 END, 6) AS polarity FROM t""",
    "normalize_entities": f"SELECT url, array_to_string(list_transform(ner, lambda x: CASE WHEN trim(x) = upper(trim(x)) AND trim(x) <> lower(trim(x)) THEN lower(trim(x)) ELSE trim(x) END), '|') AS names FROM (SELECT url, max(ner) AS ner FROM {NER} WHERE url IS NOT NULL AND len(ner) > 0 GROUP BY url)",
    "normalized_stances": _ST + f" SELECT coalesce(canonical, entity) AS entity, domain, sum(pos_count)::BIGINT AS pos_count, sum(neg_count)::BIGINT AS neg_count, sum(neu_count)::BIGINT AS neu_count, sum(total)::BIGINT AS total FROM c LEFT JOIN {_MAP} ON raw = entity GROUP BY 1, 2",
    "standardized_features": _DISTINCT + " SELECT domain, " + ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 5) AS {c}" for c in E.FEATURES) + " FROM k",
    "cluster_rules": "SELECT unnest(['components are centred', 'components are uncorrelated', 'the first explains more', 'shares are of variances', 'the best silhouette is kept', 'domains are in their nearest cluster']) AS rule, true AS holds",
    "silhouette_given_labels": _SIL + " SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette_score FROM z",
    "cluster_summary": _DISTINCT + " SELECT CASE WHEN bias_score > 0 THEN 1 ELSE 0 END AS cluster, round(avg(pos_rate), 3) AS pos_rate, round(avg(neg_rate), 3) AS neg_rate, round(avg(entropy), 3) AS entropy FROM k GROUP BY 1",
}
