"""Stances by entity and domain, features by domain, and clusters of domains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.storage import materialize

BROADCAST_NAMES = 200_000
MAX_POINTS = 5_000
FEATURES = ["bias_score", "polarity", "pos_tfidf", "neg_tfidf", "pos_rate", "neg_rate", "entropy"]


def normalize_list(articles: DataFrame, key: str, names: str, mapping: DataFrame) -> DataFrame:
    """``(key, names)`` with every name replaced by its canonical form, trimmed; unknown names stay. ``mapping(raw, canonical)`` may be large."""
    each = articles.select(key, F.posexplode_outer(names).alias("_at", "_raw")).withColumn("_raw", F.trim("_raw"))
    # the distinct names that the map changes: a small part, sent to all where it is measured to be small
    changed = materialize(mapping.select(F.col("raw").alias("_raw"), "canonical").join(each.select("_raw").distinct(), "_raw", "left_semi"), "renamed")
    known = each.join(F.broadcast(changed) if changed.count() <= BROADCAST_NAMES else changed, "_raw", "left")
    back = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("canonical", "_raw").alias("v")))).alias("_l"))
    return back.select(key, F.transform(F.filter("_l", lambda x: x["_at"].isNotNull()), lambda x: x["v"]).alias(names))


def stance_counts(articles: DataFrame, domain: str = "source_domain", mapping: DataFrame | None = None) -> DataFrame:
    """``(entity, domain, pos_count, neg_count, neu_count, total, bias_score, polarity)``; other stances make no row."""
    each = articles.select(F.col(domain).alias("domain"), F.explode("stance").alias("s")).select("domain", F.col("s.entity").alias("entity"), F.upper("s.stance").alias("stance"))
    each = each.where("stance in ('POZITIV', 'NEGATIV', 'NEUTRU') and entity is not null and domain is not null")
    if mapping is not None:
        each = each.join(mapping.withColumnRenamed("raw", "entity"), "entity", "left").withColumn("entity", F.coalesce("canonical", "entity")).drop("canonical")
    counts = each.groupBy("entity", "domain").agg(*(F.count_if(F.col("stance") == v).alias(n) for n, v in (("pos_count", "POZITIV"), ("neg_count", "NEGATIV"), ("neu_count", "NEUTRU"))))
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    total = F.col("pos_count") + F.col("neg_count") + F.col("neu_count")
    diff = F.col("pos_count") - F.col("neg_count")
    return counts.withColumn("total", total).withColumn("bias_score", F.coalesce(F.try_divide(diff, total), F.lit(0.0))).withColumn("polarity", F.coalesce(F.try_divide(F.abs(diff), total), F.lit(0.0)))


def domain_features(counts: DataFrame, mode: str = "distinct") -> DataFrame:
    """Features of each domain from entity-by-domain counts.

    With ``mode="distinct"`` a count's idf uses the number of distinct positive
    values it takes for the entity; with ``"document"``, the number of domains.
    """
    n = counts.select("domain").distinct().agg(F.count("*").cast("double"))
    seen = (lambda c: F.count_distinct(F.when(F.col(c) > 0, F.col(c)))) if mode == "distinct" else (lambda c: F.count_if(F.col(c) > 0))
    idf = counts.groupBy("entity").agg(seen("pos_count").alias("p"), seen("neg_count").alias("q"))
    idf = idf.withColumn("n", n.scalar()).select("entity", F.ln(F.col("n") / (F.col("p") + 1e-9)).alias("pos_idf"), F.ln(F.col("n") / (F.col("q") + 1e-9)).alias("neg_idf"))
    d = counts.join(idf, "entity").groupBy("domain").agg(
        *(F.sum(c).alias(c) for c in ("pos_count", "neg_count", "neu_count")), F.avg("bias_score").alias("bias_score"), F.avg("polarity").alias("polarity"),
        F.sum(F.col("pos_count") * F.col("pos_idf")).alias("pos_tfidf"), F.sum(F.col("neg_count") * F.col("neg_idf")).alias("neg_tfidf"),
    )
    d = d.withColumn("total_mentions", F.col("pos_count") + F.col("neg_count") + F.col("neu_count"))
    for r in ("pos", "neg", "neu"):
        d = d.withColumn(f"{r}_rate", F.coalesce(F.try_divide(f"{r}_count", "total_mentions"), F.lit(0.0)))
    part = lambda c: F.greatest(F.col(c), F.lit(1e-9)) * F.ln(F.greatest(F.col(c), F.lit(1e-9)))
    return d.withColumn("entropy", -(part("pos_rate") + part("neg_rate") + part("neu_rate")))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; constant columns to 0; nulls count as 0."""
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
    stats = df.agg(F.struct(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)))
    w = df.withColumn("_stats", stats.scalar())
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_stats.{c}.m"), F.col(f"_stats.{c}.s")), F.lit(0.0))
    return w.withColumns({c: z(c) for c in columns}).drop("_stats")


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population covariance; one row of numbers comes to the driver."""
    row = df.agg(*(F.covar_pop(a, b) for a in columns for b in columns)).first()
    return np.array([x or 0.0 for x in row]).reshape(len(columns), len(columns))


def pca(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Adds PC1 ... PCk of standardized columns; the largest loading of each is positive. Also the shares of variance."""
    values, vectors = np.linalg.eigh(covariance(df, columns))
    order = np.argsort(-values)[:k]
    out = df
    for i, j in enumerate(order):
        v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
        out = out.withColumn(f"PC{i + 1}", sum((F.col(c) * float(x) for c, x in zip(columns, v)), F.lit(0.0)))
    return out, values[order] / max(values.sum(), 1e-300)


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=100).fit(v).transform(v).drop("_v")


def silhouette(df: DataFrame, key: str, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Exact mean Euclidean silhouette of a table of domains, for which all distances are wanted: every domain meets every other once, by cluster. Tables of more than ``MAX_POINTS`` rows are refused."""
    if df.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    pts = df.select(key, cluster, F.array(*columns).alias("v"))
    other = pts.select(F.col(cluster).alias("oc"), F.struct(F.col(key).alias("k"), "v").alias("p")).groupBy("oc").agg(F.collect_list("p").alias("ps"))
    others = other.agg(F.collect_list(F.struct("oc", "ps"))).scalar()
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    each = pts.withColumn("o", F.explode(others)).select(key, cluster, "v", F.col("o.oc").alias("oc"), F.col("o.ps").alias("ps"))
    total = F.aggregate("ps", F.lit(0.0), lambda s, p: s + dist(F.col("v"), p["v"]))
    own = F.col(cluster) == F.col("oc")
    n = F.size("ps") - F.when(own, 1).otherwise(0)
    means = each.select(key, own.alias("own"), F.try_divide(total, n).alias("d"), n.alias("n"))
    ab = means.groupBy(key).agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.agg(F.avg(s).alias("silhouette_score"))


def best_clusters(df: DataFrame, key: str, columns: list[str], ks=range(2, 8), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clusters of the k with the best silhouette, and the scores of all k."""
    spark = df.sparkSession
    n = df.count()
    scores, best = [], None
    for k in (k for k in ks if k < n):
        made = kmeans(df, columns, k, seed)
        score = silhouette(made, key, columns).first()[0]
        scores.append((k, float(score)))
        if best is None or score > best[0]:
            best = (score, made)
    return (best[1] if best else df.withColumn("cluster", F.lit(0))), spark.createDataFrame(scores, "k int, silhouette_score double")


def cluster_summary(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Means of each cluster, rounded half to even."""
    return df.groupBy(cluster).agg(*(F.bround(F.avg(c), 3).alias(c) for c in columns))
