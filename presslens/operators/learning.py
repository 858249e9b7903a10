"""Label model, classifier, and model-backed steps with injected models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.functions import text as X


class LabelModel:
    """Accuracies of labelling functions by expectation-maximization over the distinct vote patterns.

    Spark counts the patterns, of which there are at most three to the power of
    the functions and in practice few; ``MAX_PATTERNS`` bounds what the driver gets.
    """

    MAX_PATTERNS = 200_000

    def fit(self, matrix: DataFrame, names: list[str], rounds: int = 300, prior: float = 0.5, start: float = 0.7) -> LabelModel:
        self.names = names
        got = matrix.groupBy(*names).agg(F.count("*").alias("n")).limit(self.MAX_PATTERNS + 1).toPandas()
        if len(got) > self.MAX_PATTERNS:
            raise ValueError(f"more than {self.MAX_PATTERNS} vote patterns")
        votes, n = got[names].to_numpy(), got["n"].to_numpy(float)
        self.accuracy, self.prior = np.full(len(names), start), prior
        for _ in range(rounds):
            p = self._posterior(votes)
            right = (votes == 1) * p[:, None] + (votes == 0) * (1 - p)[:, None]
            on = (votes >= 0) * n[:, None]
            new = np.clip(((right * n[:, None]).sum(0) + start) / (on.sum(0) + 1), 0.05, 0.95)
            moved, self.accuracy = np.abs(new - self.accuracy).max(initial=0), new
            if moved < 1e-7:
                break
        return self

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        w = np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + ((votes == 1) * w - (votes == 0) * w).sum(1))))

    def predict(self, matrix: DataFrame, key: str = "url") -> DataFrame:
        """``(key, p_unbiased, label)``; ties and rows without votes go to a side by the key's hash."""
        z = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for n, w in zip(self.names, np.log(self.accuracy / (1 - self.accuracy))):
            z = z + F.when(F.col(n) == 1, float(w)).when(F.col(n) == 0, -float(w)).otherwise(0.0)
        tie = F.pmod(F.xxhash64(key, F.lit(123)), F.lit(2)).cast("int")
        return matrix.select(key, (1 / (1 + F.exp(-z))).alias("p_unbiased"), F.when(z > 0, 1).when(z < 0, 0).otherwise(tie).alias("label"))


#: Weights of the classes, as the reference trains with: fixed values.
CLASS_WEIGHTS = {"biased": 1.268, "unbiased": 0.825}


def classifier(features: int = 1 << 16, class_weights: dict[str, float] | None = None):
    """A pipeline of hashed tf-idf and weighted logistic regression over ``(text, label)``; call ``fit`` on its result."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, StringIndexer

    weights = class_weights or CLASS_WEIGHTS
    cases = " ".join(f"WHEN label = '{k}' THEN {v}D" for k, v in weights.items())
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\p{L}+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features", minDocFreq=2),
            SQLTransformer(statement=f"SELECT *, CASE {cases} ELSE 1D END AS _weight FROM __THIS__"),
            StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep"),
            LogisticRegression(featuresCol="features", labelCol="target", weightCol="_weight", maxIter=20, regParam=0.01),
        ]
    )


def training_set(gold: DataFrame, weak: DataFrame, key: str = "url") -> DataFrame:
    """Gold rows and the weak rows whose key has no gold one; urls that are null stay."""
    return gold.unionByName(weak.join(gold.select(key), key, "left_anti"), allowMissingColumns=True)


def extract_entities(articles: DataFrame, find: Callable[[str], list] | None = None, key: str = "url", text: str = "cleantext", kinds: tuple[str, ...] = ("PERSON", "GPE"), pronouns: Iterable[str] = ()) -> DataFrame:
    """``(key, ner)``: sorted distinct names. A text that fails gives an empty list.

    A model gives names, or pairs of name and kind, of which the wanted kinds
    stay; pronouns are left out. Without a model, runs of two or more capitalised words.
    """
    pronouns = {p.casefold() for p in pronouns}
    if find is None:
        runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}[\p{L}\-]+(?: \p{Lu}[\p{L}\-]+)+"), F.lit(0))
        return articles.select(key, F.array_sort(F.array_distinct(runs)).alias("ner"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(t):
            try:
                named = [x if isinstance(x, tuple) else (x, kinds[0]) for x in find(t or "")]
                return sorted({x for x, kind in named if x and kind in kinds and x.casefold() not in pronouns})
            except Exception:
                return []

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ner": [one(t) for t in pdf[text]]})

    kind = dict(articles.dtypes)[key]
    return articles.select(key, text).mapInPandas(run, f"{key} {kind}, ner array<string>")


def with_retries(call: Callable, tries: int = 3, wait: float = 0.0):
    """A call repeated on errors, after ``wait`` seconds, which double each time; None when all fail."""

    def run(x):
        for k in range(tries):
            try:
                return call(x)
            except Exception:
                if wait and k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    return run


def entity_stances(articles: DataFrame, ask: Callable[[str], str], key: str = "url", text: str = "cleantext", cap: int = 6000) -> DataFrame:
    """``(key, entity, stance)``: sentences that mention each entity go to the model; NO_ENTITY without any, ERROR when it fails."""
    from presslens.functions import tokens as K

    # sentences are chosen within the article's row, so that its text is not copied to every entity
    sents = X.sentences(F.coalesce(text, F.lit("")))
    names = F.filter(F.col("ner"), lambda e: e.isNotNull())
    asked = K.bound(sents, lambda t: F.transform(names, lambda e: F.struct(e.alias("entity"), F.array_join(K.sentence_prefix(F.filter(t, lambda s: X.mentions(s, e)), cap), " ").alias("context"))))
    each = articles.select(key, F.inline(asked))
    call = with_retries(ask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [None if not c else call(f"{e}\n{c}") for e, c in zip(pdf["entity"], pdf["context"])]
            yield pd.DataFrame({key: pdf[key], "entity": pdf["entity"], "has": [bool(c) for c in pdf["context"]], "answer": answers})

    kind = dict(articles.dtypes)[key]
    got = each.mapInPandas(run, f"{key} {kind}, entity string, has boolean, answer string")
    stance = F.when(~F.col("has"), "NO_ENTITY").when(F.col("answer").isNull(), "ERROR").otherwise(X.stance_word(F.col("answer")))
    return got.select(key, "entity", stance.alias("stance"))


def text_sentiment(articles: DataFrame, ask: Callable[[str], str], key: str = "url", text: str = "cleantext") -> DataFrame:
    """``(key, text_sentiment, sentiment_confidence)`` of a model's answers; null when it fails."""
    call = with_retries(ask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": [call(t) for t in pdf["prompt"]]})

    kind = dict(articles.dtypes)[key]
    got = articles.select(key, X.truncate(F.coalesce(text, F.lit(""))).alias("prompt")).mapInPandas(run, f"{key} {kind}, answer string")
    on = F.col("answer").isNotNull()
    return got.select(key, F.when(on, X.sentiment_label(F.col("answer"))).alias("text_sentiment"), F.when(on, X.sentiment_confidence(F.col("answer"))).alias("sentiment_confidence"))


def normalize_names(names: DataFrame, ask: Callable[[list[str]], str], size: int = 200, done: DataFrame | None = None) -> DataFrame:
    """``(raw, canonical)`` of distinct names that are not done yet, in batches to a model that answers with a JSON map.

    A name that the answer leaves out, or whose batch failed, comes out with a null, so that it is known as not done.
    """
    from presslens.operators.sampling import batches as in_batches

    left = names.select(F.col(names.columns[0]).alias("raw")).where("raw is not null").distinct()
    if done is not None:
        left = left.join(done.select("raw"), "raw", "left_anti")
    call = with_retries(ask)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"items": pdf["items"], "answer": [call(list(x)) for x in pdf["items"]]})

    answers = in_batches(left, "raw", size).select("items").mapInPandas(run, "items array<string>, answer string")
    each = answers.withColumn("m", X.first_json_map(F.col("answer"))).select("m", F.explode("items").alias("raw"))
    return each.select("raw", F.try_element_at("m", F.trim("raw")).alias("canonical"))
