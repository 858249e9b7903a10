"""Cleaning, answers and tokens against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.functions import tokens as K


def run(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "step, given_, wanted",
    [
        (X.strip_quotations, "a 'b' c", "a  c"),
        (X.strip_quotations, "l'a dit 'x' z", "lx' z"),
        (X.strip_quotations, "“x” y", "“x” y"),
        (X.strip_numbers, "țara 12 5G 1999 2024 20245 20.5 ș12 a_1", "țara  5G  2024 20245 . ș12 a_1"),
        (X.strip_tags, "<a\nb>x<i>y</i>", "<a\nb>xy"),
        (lambda c: X.strip_boilerplate(c, ["Citește și"]), "CITEȘTE ȘI x", " x"),
        (X.clean_nlp, "<b>Ştiri</b> &lt;i&gt;test  2024 și 1999 vezi a.pdf https://x.ro/p „citat” * 20245", "Știri <i>test 2024 și vezi 20245"),
        (X.clean_nlp, "    ", ""),
        (X.clean_nlp, None, ""),
        (X.mark_sentences, "One two. Three four? five", "one two. PERIOD three four? PERIOD five"),
        (X.avg_sentence_length, "a b. c.  .", 1.5),
        (X.avg_sentence_length, "", 0.0),
        (X.stance_word, "Este Negativ.", "NEGATIV"),
        (X.stance_word, "nu știu", "UNKNOWN"),
        (X.sentiment_label, "Sentiment: Pozitiv\nÎncredere: 0.85", "pozitiv"),
        (X.sentiment_confidence, "Sentiment: Pozitiv\nÎncredere: 0.85", 0.85),
        (X.sentiment_confidence, "Încredere: 1", 0.0),
        (X.sentiment_label, "Încredere: 1", "unknown"),
        (X.word_count, None, 0),
        (X.word_count, "", 0),
        (X.first_json_map, 'x ```json\n{"A": " b "}\n``` {"c"}', {"A": "b"}),
        (X.parse_list, "['a', \"b'c\", None]", ["a", "b'c", None]),
        (X.parse_list, "no list", []),
        (X.html_text, "<p>A&amp;B</p><script>x</script><div>c<br>d</div>", "A&B\nc\nd"),
    ],
)
def test_cases(spark, step, given_, wanted):
    assert run(spark, [given_], step) == [wanted]


def test_sentences_are_trimmed(spark):
    assert run(spark, [" Una.  Două ! ", "   ", ""], lambda c: X.sentences(c)) == [["Una.", "Două !"], [], []]


def test_stances_drop_tuples(spark):
    got = run(spark, ["[{'entity': \"O'Neil\", 'stance': 'NEUTRU'}, ('B', 'NO_ENTITY')]", None], X.parse_stances)
    assert [tuple(x) for x in got[0]] == [("O'Neil", "NEUTRU")] and got[1] == []


def test_ngrams(spark):
    got = run(spark, ["Partid - de la covid19 Cluj-Napoca", "", None], lambda c: K.phrase_set(K.tokens(c), (1, 2, 3), ["de", "la"]))
    assert set(got[0]) == {"Partid", "Cluj-Napoca", "Partid de", "la Cluj-Napoca", "Partid de la", "de la Cluj-Napoca"}
    assert got[1] == [] and not got[2]
    assert run(spark, ["a PERIOD b b"], lambda c: K.phrase_set(K.tokens(c), (1, 2))) == [["a", "b", "b b"]]


def test_chunks(spark):
    text = "a b. c d. e f g h i. j"
    assert run(spark, [text], lambda c: K.chunk_sentences(X.sentences(c), 3)) == [["a b.", "c d.", "e f g h i.", "j"]]
    assert run(spark, [text], lambda c: K.chunk_sentences(X.sentences(c), 1))[0][0] == ""
    assert run(spark, [text], lambda c: K.sentence_prefix(X.sentences(c), 4)) == [["a b.", "c d."]]
