"""Article features, labelling functions and votes as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.functions.tokens import bound

ABSTAIN, BIASED, UNBIASED = -1, 0, 1

#: Closed classes of Romanian, chosen by us: forms that mark conditional or subjunctive, and pronouns.
CONDITIONAL = "aș ai ar am ați să".split()
FIRST_PERSON = "eu mie îmi mă mine noi nouă ne".split()
SECOND_PERSON = "tu ție îți te tine voi vouă vă".split()


def listed_count(c: Column, words: list[str]) -> Column:
    """Words of a text that are in a closed list."""
    return F.coalesce(F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.isin(*words))), F.lit(0))


def conditional_count(c: Column) -> Column:
    """Conditional forms followed by another word, and ``să``."""
    return listed_count(c, CONDITIONAL)


def stance_share(stances: Column, wanted: str) -> Column:
    """Share of a stance among the stances of an article; 0 without any."""
    hits = F.size(F.filter(stances, lambda s: F.upper(s.stance) == wanted))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(stances)), F.lit(0.0))


def stance_polarity(stances: Column) -> Column:
    pos = F.size(F.filter(stances, lambda s: F.upper(s.stance) == "POZITIV"))
    neg = F.size(F.filter(stances, lambda s: F.upper(s.stance) == "NEGATIV"))
    return F.coalesce(F.try_divide(F.abs(pos - neg).cast("double"), F.size(stances)), F.lit(0.0))


def bias_word_count(text: Column, words: Column) -> Column:
    """Occurrences of an article's bias words as substrings, case folded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return bound(low, lambda t: F.aggregate(F.coalesce(words, F.array().cast("array<string>")), F.lit(0), lambda a, w: a + X.count_of(t, F.lower(w))))


def entropy(p: Column) -> Column:
    """Entropy in bits over the positive entries, which are not rescaled."""
    return -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s + x * F.log2(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """``(centroid)``: one row with the mean of an array column."""
    each = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid"))


def article_features(articles: DataFrame, known_biased: DataFrame, center: DataFrame) -> DataFrame:
    """All features of articles ``(url, source, maintext, cleantext, ner, stance, bias_words, topic_probs)`` in one projection.

    ``known_biased(source)``: a small dimension. ``center``: one row, the centroid of biased sources' topics.
    """
    outside = F.regexp_replace(F.coalesce("maintext", F.lit("")), X.QUOTATION, "")
    a = articles.withColumn("_outside", outside).withColumn("text_length", X.word_count(F.col("cleantext"))).withColumn("bias_word_count", bias_word_count(F.col("cleantext"), F.col("bias_words")))
    a = a.join(known_biased.select("source", F.lit(1).alias("source_known_biased")).distinct(), "source", "left").withColumn("_center", center.scalar())
    return a.select(
        "url", "text_length", X.avg_sentence_length(F.coalesce("cleantext", F.lit(""))).alias("avg_sentence_length"), F.coalesce(F.size("ner"), F.lit(0)).alias("entity_count"),
        stance_polarity(F.col("stance")).alias("stance_polarity"), stance_share(F.col("stance"), "NEGATIV").alias("negative_stance_polarity"), stance_share(F.col("stance"), "POZITIV").alias("positive_stance_polarity"),
        conditional_count(F.col("cleantext")).alias("cond_mood_count"), X.count_of(F.col("_outside"), "?").alias("question_count"), X.count_of(F.col("_outside"), "!").alias("exclaim_count"),
        listed_count(F.col("cleantext"), FIRST_PERSON).alias("first_pronouns"), listed_count(F.col("cleantext"), SECOND_PERSON).alias("second_pronouns"),
        "bias_word_count", F.coalesce(F.try_divide(F.col("bias_word_count").cast("double"), "text_length"), F.lit(0.0)).alias("bias_word_ratio"),
        F.coalesce("source_known_biased", F.lit(0)).alias("source_known_biased"), cosine(F.col("topic_probs"), F.col("_center")).alias("topic_sim_bias"), entropy(F.col("topic_probs")).alias("topic_entropy"),
    )


LABELLERS: dict[str, Callable[[], Column]] = {}


def lf(name: str):
    """Registers a labelling function: it gives a column of -1, 0 or 1."""

    def add(f):
        LABELLERS[name] = f
        return f

    return add


def num(c: str) -> Column:
    """A column whose NaN counts as missing, as comparisons with it must not hold."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def vote(label: int, condition: Column) -> Column:
    return F.when(condition, label).otherwise(ABSTAIN)


# Thresholds of the labelling functions, in the order of the label matrix: fixed values.
_RULES: list[tuple[str, int, Callable[[], Column]]] = [
    ("high_bias_word_ratio", BIASED, lambda: num("bias_word_ratio") > 0.09),
    ("excessive_exclaims", BIASED, lambda: num("exclaim_count") > 5),
    ("excessive_questions", BIASED, lambda: num("question_count") > 5),
    ("strong_sentiment", BIASED, lambda: F.col("text_sentiment").isin("pozitiv", "negativ") & (num("sentiment_confidence") > 0.8)),
    ("low_topic_entropy", BIASED, lambda: num("topic_entropy") < 3),
    ("conditional_hedging", BIASED, lambda: num("cond_mood_count") > 6),
    ("topic_sim_to_biased", BIASED, lambda: num("topic_sim_bias") > 0.5),
    ("high_entropy", UNBIASED, lambda: num("topic_entropy") > 5),
    ("neutral_sentiment", UNBIASED, lambda: (F.col("text_sentiment") == "neutru") & (num("sentiment_confidence") > 0.7)),
    ("clean", UNBIASED, lambda: (num("bias_word_ratio") <= 0.1) & (num("exclaim_count") == 0) & (num("question_count") == 0) & (num("cond_mood_count") <= 2) & (F.col("text_sentiment") == "neutru")),
    ("high_first_pronouns", BIASED, lambda: num("first_pronouns") > 4),
    ("high_second_pronouns", BIASED, lambda: num("second_pronouns") > 2),
    ("short_sentences", UNBIASED, lambda: (num("avg_sentence_length") > 5) & (num("avg_sentence_length") < 12)),
    ("balanced_stance", UNBIASED, lambda: (num("positive_stance_polarity") <= 0.3) & (num("negative_stance_polarity") < 0.6)),
    ("excess_positive_stance", BIASED, lambda: num("positive_stance_polarity") > 0.3),
    ("excess_negative_stance", BIASED, lambda: num("negative_stance_polarity") >= 0.6),
]
for _name, _label, _rule in _RULES:
    lf(_name)(lambda label=_label, rule=_rule: vote(label, rule()))


def label_matrix(features: DataFrame, key: str = "url") -> DataFrame:
    """``(key, one column for each labelling function)`` in one projection."""
    return features.select(key, *(f().alias(name) for name, f in LABELLERS.items()))


def lf_summary(matrix: DataFrame, names: list[str]) -> DataFrame:
    """``(lf, coverage, overlaps, conflicts, polarity)`` as shares of the rows, in one aggregation."""
    votes = F.array(*(F.col(n) for n in names))
    m = matrix.withColumn("_votes", F.filter(votes, lambda v: v >= 0)).withColumn("_n", F.size("_votes")).withColumn("_kinds", F.size(F.array_distinct("_votes")))
    cells = []
    for n in names:
        on = F.col(n) >= 0
        cells.append(F.struct(F.lit(n).alias("lf"), F.avg(on.cast("int")).alias("coverage"), F.avg((on & (F.col("_n") > 1)).cast("int")).alias("overlaps"), F.avg((on & (F.col("_kinds") > 1)).cast("int")).alias("conflicts"), F.array_join(F.array_sort(F.collect_set(F.when(on, F.col(n)))), ",").alias("polarity")))
    return m.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def majority_vote(matrix: DataFrame, names: list[str], key: str = "url") -> DataFrame:
    """``(key, label)``: the label with more votes; -1 for a tie or no vote."""
    biased = sum((F.when(F.col(n) == BIASED, 1).otherwise(0) for n in names), F.lit(0))
    unbiased = sum((F.when(F.col(n) == UNBIASED, 1).otherwise(0) for n in names), F.lit(0))
    return matrix.select(key, F.when(biased > unbiased, BIASED).when(unbiased > biased, UNBIASED).otherwise(ABSTAIN).alias("label"))


def label_name(c: Column) -> Column:
    return F.when(c == BIASED, "biased").when(c == UNBIASED, "unbiased").otherwise("abstain")


def metrics(df: DataFrame, truth: str, guess: str, positive: str = "unbiased") -> DataFrame:
    """``(n, accuracy, precision, recall, f1)`` of string labels; the positive class is named."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    c = df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.select("n", "accuracy", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(label, support, precision, recall, f1)`` of every label that is a truth or a guess, from the counts of pairs."""
    cells = df.select(F.col(truth).alias("t"), F.col(guess).alias("g")).groupBy("t", "g").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    side = lambda label, hit, support, given: F.struct(F.col(label).alias("label"), hit.alias("hit"), support.alias("support"), given.alias("given"))
    hit = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(none)
    each = cells.select(F.inline(F.array(side("t", hit, F.col("n"), none), side("g", none, none, F.col("n")))))
    sums = each.where("label is not null").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("hit", "support", "given")))
    p, r = (F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col(c)), F.lit(0.0)) for c in ("given", "support"))
    return sums.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself; an error that lists its columns where one is missing."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}; there are {df.columns}")
    return df


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))
