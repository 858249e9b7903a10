"""Topics from document vectors: reduction, clusters, words and coherence.

The reference's reducer, density clusterer and sentence encoder are not
available; principal components, k-means with a least cluster size, and given
vectors stand in for them, and no equality of topics is claimed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_vectors(df: DataFrame, vector: str, k: int = 10) -> DataFrame:
    """Adds ``reduced``: principal components of the unit vectors."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    v = Normalizer(inputCol="_v", outputCol="_n").transform(v)
    return PCA(k=k, inputCol="_n", outputCol="reduced").fit(v).transform(v).drop("_v", "_n")


def cluster_topics(df: DataFrame, k: int = 10, least: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``topic`` (-1 for clusters of fewer than ``least``) and ``probs``, the soft assignment by distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    model = KMeans(k=k, seed=seed, featuresCol="reduced", predictionCol="_c").fit(df)
    made = model.transform(df)
    sizes = made.groupBy("_c").agg(F.count("*").alias("_n"))
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    x = vector_to_array("reduced")
    d2 = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y) for c in centers]
    e = F.transform(F.array(*d2), lambda d: F.exp(-F.sqrt(d)))
    made = made.withColumn("_e", e).withColumn("probs", F.transform("_e", lambda y: y / F.aggregate("_e", F.lit(0.0), lambda s, z: s + z)))
    return made.join(sizes, "_c").withColumn("topic", F.when(F.col("_n") >= least, F.col("_c")).otherwise(-1)).drop("_c", "_n", "_e", "reduced")


def topic_words(scored: DataFrame, n: int = 15, topic: str = "topic") -> DataFrame:
    """The best words of each topic, without outliers."""
    w = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return scored.where(F.col(topic) >= 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diverse_words(candidates: DataFrame, vectors: DataFrame, n: int = 15, diversity: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over at most a few dozen candidates of a topic: ``(topic, term, score)`` with ``vectors(term, v)``."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v = np.array(pdf["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, sim, chosen = pdf["score"].to_numpy(), v @ v.T, []
        score = score / max(score.max(), 1e-12)
        while len(chosen) < min(n, len(pdf)):
            left = [i for i in range(len(pdf)) if i not in chosen]
            gain = [(1 - diversity) * score[i] - (diversity * sim[i, chosen].max() if chosen else 0) for i in left]
            chosen.append(left[int(np.argmax(gain))])
        return pd.DataFrame({"topic": pdf["topic"].iloc[chosen].to_numpy(), "term": pdf["term"].iloc[chosen].to_numpy(), "place": range(1, len(chosen) + 1)})

    return candidates.join(vectors, "term").orderBy("topic", F.desc("score"), "term").groupBy("topic").applyInPandas(pick, "topic int, term string, place int")


def npmi_coherence(words: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """``(topic, coherence)``: mean normalized PMI of the pairs of a topic's words over documents ``(doc_id, term)``."""
    listed = words.select("topic", "term").distinct()
    n = doc_terms.select("doc_id").distinct().agg(F.count("*").cast("double"))
    held = doc_terms.join(listed.select("term").distinct(), "term", "left_semi").distinct()
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    per_doc = held.join(listed, "term").groupBy("doc_id", "topic").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    # a topic has n words, so a document has few pairs of them
    at = F.explode(F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    both = per_doc.select("topic", at.alias("p")).groupBy("topic", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n_ab"))
    pairs = listed.withColumnRenamed("term", "a").join(listed.withColumnRenamed("term", "b"), "topic").where("a < b").join(both, ["topic", "a", "b"], "left")
    p = pairs.join(df.select(F.col("term").alias("a"), F.col("df").alias("n_a")), "a").join(df.select(F.col("term").alias("b"), F.col("df").alias("n_b")), "b").withColumn("n", n.scalar())
    npmi = F.when(F.col("n_ab").isNull(), -1.0).when(F.col("n_ab") == F.col("n"), 1.0).otherwise(F.ln(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))) / -F.ln(F.col("n_ab") / F.col("n")))
    return p.groupBy("topic").agg(F.avg(npmi).alias("coherence"))


WINDOW = 110


def window_counts(docs: DataFrame, words: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(topic, a, b, n)``: sliding windows of the documents that hold both words of a topic (a = b: the word itself), and their number as topic null.

    ``words(topic, term)`` are few (a dozen for each topic). A text of fewer words than a window is one window.
    """
    listed: dict[int, list[str]] = {}
    for r in words.select("topic", "term").distinct().orderBy("topic", "term").limit(MAX_WORDS + 1).collect():
        listed.setdefault(r["topic"], []).append(r["term"])
    if sum(map(len, listed.values())) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words")
    every = {w: i for i, w in enumerate(sorted({w for ws in listed.values() for w in ws}))}

    def run(batches):
        import re

        import numpy as np

        total, n = {t: np.zeros((len(ws), len(ws)), np.int64) for t, ws in listed.items()}, 0
        word = re.compile(r"[^\W\d_]+")
        for pdf in batches:
            for t in pdf[text]:
                got = [every.get(w, -1) for w in word.findall((t or "").lower())]
                if not got:
                    continue
                width = min(window, len(got))
                starts = len(got) - width + 1
                n += starts
                seen = {}
                for w in set(got) - {-1}:
                    upto = np.concatenate([[0], np.cumsum(np.array(got) == w)])
                    seen[w] = upto[width:] > upto[:starts]
                for topic, ws in listed.items():
                    on = [(i, seen[every[w]]) for i, w in enumerate(ws) if every[w] in seen]
                    if on:
                        at, flags = [i for i, _ in on], np.array([f for _, f in on], np.int64)
                        total[topic][np.ix_(at, at)] += flags @ flags.T
        rows = [(topic, ws[i], ws[j], int(total[topic][i, j])) for topic, ws in listed.items() for i in range(len(ws)) for j in range(len(ws))]
        yield pd.DataFrame([*rows, (None, None, None, n)], columns=["topic", "a", "b", "n"])

    return docs.select(text).mapInPandas(run, "topic int, a string, b string, n bigint").groupBy("topic", "a", "b").agg(F.sum("n").alias("n"))


MAX_WORDS = 5000


def cv_coherence(words: DataFrame, docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(topic, coherence)``: c_v, the mean cosine of each word's vector of normalized PMI with the sum of its topic's vectors, over sliding windows."""
    import numpy as np

    counts = window_counts(docs, words, text, window).toPandas()  # bounded by the words
    n = float(counts.loc[counts["topic"].isna(), "n"].sum()) or 1.0
    out = []
    for topic, part in counts[counts["topic"].notna()].groupby("topic"):
        p = part.pivot(index="a", columns="b", values="n").to_numpy(float) / n
        own = np.diag(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.log((p + 1e-12) / np.outer(own, own)) / -np.log(p + 1e-12)
        npmi = np.where(np.outer(own, own) > 0, npmi, 0.0)
        all_of = npmi.sum(0)
        norm = np.linalg.norm(npmi, axis=1) * np.linalg.norm(all_of)
        out.append((int(topic), float(np.where(norm > 0, npmi @ all_of / np.where(norm > 0, norm, 1), 0).mean())))
    return docs.sparkSession.createDataFrame(out, "topic int, coherence double")
