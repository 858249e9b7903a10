"""Each operator against brute force or hand-made cases on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presslens.llm import bpe, p1_splits, p2_names, p3_lines, p4_terms, p5_near, p6_forms, p7_phrases, p8_encode, p9_leaks, p10_pieces
from presslens.llm import textvec as tv


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


ALPHABET = "ab șțŞ12 .\n-– ​̆ﬁＡ𝐚аοЖ"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=12))
def test_vectorized_words_equal_plain_ones(texts):
    codes, offsets = tv.codes_of(pa.array(texts, pa.string()))
    folded, fo = tv.fold_codes(codes, offsets)
    h, r, s, n = tv.words_of(folded, fo)
    got = [(int(i), "".join(map(chr, folded[a : a + k]))) for i, a, k in zip(r, s, n)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{N}]+", tv.fold_text(t))]
    assert len({w for _, w in got}) == len(set(h.tolist()))


def articles(spark, data, extra=True):
    df = spark.createDataFrame(data, "url string, maintext string, source_domain string")
    return df.withColumn("source", F.lit(1)).withColumn("lines", F.lit("x")).withColumn("id", F.lit(0)).withColumn("group", F.lit(None).cast("int")) if extra else df


def test_p3_rule(spark):
    data = [(f"u{i}", f"Publicat la {i}:00\ntext {chr(97 + i) * 3}\n\nLăsă un comentariu", "www.S.ro " if i % 2 else "s.ro") for i in range(6)]
    data += [("u0", "Publicat la 0:00\ntext aaa\n\nLăsă un comentariu", None), ("n", None, "s.ro"), ("e", "", "s.ro"), (None, "Publicat la", "s.ro"), ("o", "Publicat la 7", None)]
    got = rows(p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data))), "url", "line_no")
    assert got == sorted((f"u{i}", k) for i in range(6) for k in (0, 3))
    cleaned = dict(rows(p3_lines.clean(articles(spark, data), p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data)))), "url", "maintext"))
    assert cleaned["u2"] == "text ccc\n" and cleaned["o"] == "Publicat la 7" and cleaned["e"] == ""
    assert p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data).limit(0))).count() == 0


def test_p3_near_duplicate_lines(spark):
    """Bylines that differ in names and dates are no repeated line, but one cluster."""
    who = "Ana Maria Pop, Ion Pop, Radu Ilie, Dan Nica, Ene Stan, Ilie Mic".split(", ")
    data = [(f"u{i}", f"Articol scris de {w} la data de {i + 3} martie\n{w} vorbește despre {chr(97 + i) * 4} și {chr(98 + i) * 5}", "s.ro") for i, w in enumerate(who)]
    arts = p3_lines.article_lines(articles(spark, data))
    assert p3_lines.repeated_lines(arts).count() == 0
    assert rows(p3_lines.near_repeated_lines(arts), "url", "line_no") == [(f"u{i}", 0) for i in range(6)]


def test_p3_one_line_in_capitals_and_not(spark):
    data = [(f"u{i}", f"text {chr(97 + i) * 3}\n{'Lasă Un Comentariu' if i % 2 else 'LASĂ UN COMENTARIU'}", "s.ro") for i in range(8)]
    assert rows(p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data))), "url", "line_no") == [(f"u{i}", 1) for i in range(8)]


def test_p3_share(spark):
    data = [(f"u{i}", ("Nota redacției" if i < 5 else f"rând {chr(97 + i % 26)}{chr(97 + i // 26)}"), "s") for i in range(101)]
    assert p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data))).count() == 0  # 5 of 101 is under a twentieth
    assert p3_lines.repeated_lines(p3_lines.article_lines(articles(spark, data[:100]))).count() == 5


def test_p3_spellings_that_mask_differently(spark):
    forms = ["Lasă un comentariu nou", "LASĂ UN COMENTARIU NOU", "Lasă un co-men-tariu 7 nou"]
    data = [(f"u{i}", f"text {chr(97 + i) * 3}\n{forms[i % 3]}", "s") for i in range(7)] + [(f"v{i}", forms[i], "t") for i in range(3)]
    arts = p3_lines.article_lines(articles(spark, data))
    assert rows(p3_lines.repeated_keys(arts), "source", "articles") == [("s", 7)]
    assert rows(p3_lines.repeated_lines(arts), "url", "line_no") == [(f"u{i}", 1) for i in range(7)]


def brute_groups(texts, share=0.45):
    sets = {}
    for u, t in texts.items():
        w = regex.findall(r"[\p{L}\p{N}]+", tv.fold_text(t))
        if len(w) >= 3:
            sets[u] = set(zip(w, w[1:], w[2:]))
    group = {u: u for u in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= share * min(len(sets[a]), len(sets[b])):
            group[find(b)] = find(a)
    out = {}
    for u in sets:
        out.setdefault(find(u), set()).add(u)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


@pytest.mark.parametrize("broadcast", [True, False])
def test_p5_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(p5_near, "BROADCAST_KEYS", -1)
    rng = random.Random(5)
    vocabulary = [f"cuvânt{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    texts = {}
    for i in range(60):
        w = list(base[0 if i < 20 else i % 12])  # a third are copies of one
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[f"u{i:02}"] = " ".join(w).upper() if i % 3 else ", ".join(w)
    texts["long"] = " ".join(rng.choice(vocabulary) for _ in range(400)) + " " + " ".join(base[11][:90])
    texts["two"], texts["two2"], texts["empty"] = "doar două", "doar două", ""
    data = [(u, t, f"s{i % 3}") for i, (u, t) in enumerate(texts.items())] + [("null", None, "s"), ("u01", texts["u01"], None)]
    got = {}
    for u, g in rows(p5_near.near_groups(articles(spark, data)), "url", "group"):
        got.setdefault(g, []).append(u)
    assert sorted(sorted(v) for v in got.values()) == brute_groups(texts)
    assert all(g == min(v) for g, v in got.items())


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n)]


def _groups(spark, texts):
    got = {}
    for u, g in rows(p5_near.near_groups(articles(spark, [(u, t, f"s{u}") for u, t in texts.items()])), "url", "group"):
        got.setdefault(g, []).append(u)
    return sorted(sorted(v) for v in got.values())


@pytest.mark.parametrize("most", [2, 16])
def test_p5_passage_of_many_articles(spark, monkeypatch, most):
    """A passage that many unlike articles quote ties nothing, and hides neither the pair that shares more nor the short articles made of it."""
    monkeypatch.setattr(p5_near, "MOST", most)
    rng = random.Random(3)
    passage = _words(rng, 30)
    texts = {f"q{i:02}": _words(rng, 200) + passage + _words(rng, 200) for i in range(25)}
    texts["short"] = passage + _words(rng, 30)
    texts["only"] = list(passage)
    texts["long"] = _words(rng, 900) + passage + texts["short"][30:50] + _words(rng, 900)
    texts = {u: " ".join(x) for u, x in texts.items()}
    assert _groups(spark, texts) == brute_groups(texts)


def test_p5_small_articles_within_large_ones(spark):
    """150 words placed inside 1,550, with a word changed in every 15: 80 % of the runs of the smaller one are shared."""
    rng, texts = random.Random(8), {}
    for i in range(40):
        small = _words(rng, 150)
        edited = [x if k % 15 else _words(rng, 1)[0] for k, x in enumerate(small)]
        texts[f"s{i:02}"], texts[f"t{i:02}"] = " ".join(small), " ".join(_words(rng, 700) + edited + _words(rng, 700))
    assert _groups(spark, texts) == [[f"s{i:02}", f"t{i:02}"] for i in range(40)]


def test_p5_articles_of_few_words(spark):
    texts = {"a": "unu doi trei", "b": "x y unu doi trei patru cinci", "c": " ".join(_words(random.Random(1), 40)) + " unu doi trei", "d": "trei doi unu", "e": "doi"}
    assert _groups(spark, texts) == [["a", "b", "c"]]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 60), st.integers(0, 60))
def test_p5_a_shared_passage_gives_a_common_anchor(seed, before, after):
    rng = np.random.default_rng(seed)
    n = p5_near.LONG + p5_near.WINDOW - 1
    passage = rng.integers(1, 2**63, n, dtype=np.uint64)
    pad = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64)
    texts = [np.concatenate([pad(before), passage, pad(after)]), np.concatenate([pad(after), passage, pad(before + 5)])]
    keys, _, row = p5_near.anchors(np.concatenate(texts), np.repeat([0, 1], [len(t) for t in texts]))
    assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


def test_p5_runs_are_sent_once_to_a_part(spark, monkeypatch):
    """All pairs of a group are checked in one part, so its articles are sent once; a group of very many is spread. The pairs found are the same."""
    ids = range(10)
    signed = spark.createDataFrame([(i, np.arange(i % 2 * 50, i % 2 * 50 + 20 + i, dtype=np.uint32).tobytes()) for i in ids], "id bigint, runs binary")
    pairs = spark.createDataFrame(list(itertools.combinations(ids, 2)), "a bigint, b bigint")
    sent = lambda: len({(r["part"], x) for r in p5_near._homes(pairs, 64).collect() for x in (r["a"], r["b"])})
    same = [(a, b) for a, b in itertools.combinations(ids, 2) if a % 2 == b % 2]
    assert sent() == 10 and rows(p5_near._checked(signed, pairs), "a", "b") == same
    monkeypatch.setattr(p5_near, "HOME", 2)
    monkeypatch.setattr(p5_near, "PART_PAIRS", 1)
    assert sent() > 10 and rows(p5_near._checked(signed, pairs), "a", "b") == same


def test_p5_empty(spark):
    assert p5_near.near_groups(articles(spark, [("u", None, "s")])).count() == 0


def test_minmax_is_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = (p5_near.minmax(tv.mix(s), np.array([0])) for s in (a, b))
    assert abs((x == y).mean() - 200 / 400) < 0.13


@pytest.mark.parametrize(
    "text, found, plain",
    [("Ｕltima", True, "Ultima"), ("ﬁn", True, "fin"), ("și", True, "și"), ("a​b", True, "ab"), ("a b", True, "a b"), ("ştiri", True, "știri"), ("Mobanοzescu", True, "Mobanozescu"), ("Москва „da” – …", False, None), ("și\tda\r\n", False, None), ("", False, None), ("μετα αβ", False, None), ("x̆", True, "x̆"), ("̆x", False, None)],
)
def test_p6_cases(text, found, plain):
    counts = {}
    for c in text + "aăâbcdefghiîlmnoprsștțuvz " * 3:
        counts[c] = counts.get(c, 0) + 1
    for a, b in zip(text, text[1:]):
        if len(unicodedata.normalize("NFC", a + b)) == 1:
            counts[a + b] = 1
    run = p6_forms.rewriter(p6_forms.build_rules(counts), True)
    got = next(run([pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array([text])], ["item", "text"])]))
    assert got.column(2).to_pylist() == [found] and got.column(1).to_pylist() == [text if plain is None else plain]


def test_p6_representative_follows_frequency():
    rules, letters = p6_forms.build_rules({"ş": 9, "ș": 1, "ș": 2, "𝐚": 1})
    assert rules["ş"] == rules["ș"] == rules["ş"] == "ș" and rules["𝐚"] == "a" and letters["а"] == "a"


def test_p4_scores(spark):
    data = [(f"a{i}", "Alfa beta", "x") for i in range(4)] + [("b", "beta gama", "y"), ("b", "beta gama", "y"), ("c", "", "y"), ("d", None, "y"), ("e", "alfa", None), (None, "alfa", "y")]
    df = spark.createDataFrame(data, "url string, cleantext string, source_domain string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1))
    got = {(s, t): (a, n, v) for s, t, a, n, v in rows(p4_terms.distinctive_terms(df), "source_domain", "term", "articles", "all_articles", "score")}
    assert got[("x", "alfa")][:2] == (4, 4) and got[("x", "beta")][:2] == (4, 5) and got[("y", "gama")][:2] == (1, 1)
    o = np.array([[4, 0], [0, 2]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert got[("x", "alfa")][2] == pytest.approx(2 * np.sum(np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / e), 0)), abs=1e-5)
    assert got[("y", "beta")][2] < 0 and p4_terms.distinctive_terms(df.limit(0)).count() == 0


def test_p4_found_is_told_by_counts(spark, tmp_path, monkeypatch):
    """No ratio is made that changes nothing; a source of most articles may avoid a term of which it has four fifths."""
    monkeypatch.setattr(p4_terms, "log_likelihood", lambda *x: pytest.fail("the ratio has no effect on the terms found"))
    data = [(f"u{i}", "alfa" if i < 4 else "beta", "x") for i in range(45)] + [("v", "alfa gama", "y"), *((f"w{i}", "gama", " ") for i in range(4))]
    spark.createDataFrame(data, "url string, cleantext string, source_domain string").write.parquet(f"{tmp_path}/{p4_terms.TOPICS}.parquet")
    assert rows(p4_terms.p4_found(spark, str(tmp_path)), "source_domain", "term") == [("x", "alfa"), ("x", "beta")]


def test_p7_counts(spark):
    data = [(f"u{i}", [" A  b", "a b", "c"] if i < 3 else ["", None, "c"], "S" if i < 2 else None) for i in range(5)] + [("u0", [" A  b", "a b", "c"], None), ("n", None, "s"), ("z", [], "s"), (None, ["x"], "s")]
    df = spark.createDataFrame(data, "url string, all_ngrams array<string>, source_domain string").withColumn("id", F.lit(0)).withColumn("ngram", F.lit(0))
    got = rows(p7_phrases.phrase_counts(df), "ngram", "occurrences", "articles", "sources", "rare", "common")
    assert got == [("a b", 6, 3, 1, False, True), ("c", 5, 5, 1, False, True)]
    assert p7_phrases.phrase_counts(df.limit(0)).count() == 0


TEXTS = ["", None, "a", "  două   spații\n\nși 12 ani, don't <|endoftext|> ", "x" * 3000, "日本語 ﬁ  a\u0085b", "și\tș 🙂🙂 ok", " ", "\r\n\r\n x"]


def test_p8_round_trip_and_reference(spark):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("ids", F.lit("x"))
    df = df.union(df)
    want = sorted((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(TEXTS)) * 2
    for bound in (p8_encode.BROADCAST_BYTES, 0):
        got = p8_encode.encode(df, broadcast_bytes=bound)
        assert sorted((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == sorted(want)
    one = p8_encode.encode(df.limit(len(TEXTS)))
    assert dict(rows(p8_encode.decode(one), "doc_id", "text")) == {i: x or "" for i, x in enumerate(TEXTS)}
    assert p8_encode.encode(df.limit(0)).count() == 0 and p8_encode.encode(df.limit(0), broadcast_bytes=0).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=60), max_size=6), st.lists(st.text(alphabet="abc ", max_size=60), max_size=4))
def test_p9_against_brute_force(docs, items):
    w, r = p9_leaks.text_words(pa.array(docs, pa.string()))
    tw, tr = p9_leaks.text_words(pa.array(items, pa.string()))
    d, i, n, p, q = p9_leaks.find_matches(w, r, tw, tr, p9_leaks._room(tr) if len(tr) else tr)
    want = {}
    for a, x in enumerate(docs):
        for b, y in enumerate(items):
            x1, y1 = x.split(), y.split()
            best = max((k for s in range(len(x1)) for u in range(len(y1)) for k in [next((m for m in range(min(len(x1) - s, len(y1) - u)) if x1[s + m] != y1[u + m]), min(len(x1) - s, len(y1) - u))]), default=0)
            if best >= p9_leaks.MATCH:
                want[(a, b)] = best
    assert {(int(a), int(b)): int(k) for a, b, k in zip(d, i, n)} == want
    for a, b, k, x, y in zip(d, i, n, p, q):
        assert docs[a].split()[x : x + k] == items[b].split()[y : y + k]


def test_p9_tables(spark, monkeypatch):
    monkeypatch.setattr(p9_leaks, "BLOCK_WORDS", 10)  # many blocks
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"x {passage.upper()}, y"), (2, None), (3, ""), (4, passage[:30]), (5, f"a {passage}"), (5, f"a {passage}")], "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("words", F.lit(0))
    items = spark.createDataFrame([(7, passage), (8, "intro " + passage), (9, None), (10, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    assert sorted(set(rows(p9_leaks.leaks(docs, items), "doc_id", "item_id", "words"))) == [(1, 7, 14), (1, 8, 14), (5, 7, 14), (5, 8, 14)]
    assert p9_leaks.leaks(docs, items.limit(0)).count() == 0 and p9_leaks.leaks(docs.limit(0), items).count() == 0


def test_p10_pieces(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["banii", "legea", "votul", "oraș", "munte"]) for _ in range(12)).capitalize() + "."
    texts = {1: "\n\n".join(" ".join(sentence() for _ in range(5)) for _ in range(12)), 2: "fără puncte " * 300, 3: "q" * 4000, 4: "scurt", 5: "", 6: None, 7: "\n".join(f"a;{i};b" for i in range(400)), 8: " " * 900 + "x" * 10}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("piece", F.lit(1)).withColumn("tokens", F.lit("x"))
    enc = bpe.encoding()
    got = {}
    for r in p10_pieces.pieces(df, 256, 32).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {k for k, t in texts.items() if t and len(enc.encode_ordinary(t)) > 256}
    for k, ps in got.items():
        t, end = texts[k], 0
        assert [p["piece"] for p in ps] == list(range(len(ps))) and ps[0]["begin_char"] == 0 and ps[-1]["end_char"] == len(t)
        for p in ps:
            assert t[p["begin_char"] : p["end_char"]] == p["text"] and p["begin_char"] <= end and p["end_char"] > end
            assert len(enc.encode_ordinary(p["text"])) == p["tokens"] <= 256
            end = p["end_char"]
    assert all(p["text"].rstrip().endswith(".") for p in got[1])
    assert all(8 <= p["overlap"] <= 64 for p in got[1][1:])
    assert p10_pieces.pieces(df.limit(0)).count() == 0


NAMES = {
    "p": ["Dumitru Șisamazescu", "DUMITRU ȘISAMAZESCU", "Șisamazescu, Dumitru", "D. Șisamazescu", "D.Șisamazescu", "Mitică Șisamazescu", "Dumitru Șisamzescu", "dl. Dumitru Șisamazescu"],
    "q": ["Corina-Emil Cișigimescu", "Corina E. Cișigimescu", "Cișigimescu Corina-Emil", "Corina Cișigimescu"],
    "r": ["Alexandru Cișigimescu", "Cișigimescu Sandu", "Alexandru Ｃișigimescu"],
    "o": ["Sindicatul Acțiunea Modernă Matolacona", "Sind. Acțiunea Modernă Matolacona", "Sindicatul A.M. Matolacona", "Acțiunea Modernă Matolacona, Sindicatul", "Sindicatul „Acțiunea Modernă” Matolacona", "Acțiunea Modernă Matolacona", "SAMM", "S.A.M.M.", "Sindicatul Acțuinea Modernă Matolacona"],
}


def test_p2_variants(spark):
    single = ["Dunărea", "DUNĂREA", "Fozibemești", "", "...", None, "Parlamentul European", "C. Cișigimescu"]
    ner = spark.createDataFrame([(v * 3,) for v in NAMES.values()] + [(single,), (None,), ([],)], "ner array<string>").withColumn("name", F.lit(1)).withColumn("entity", F.lit(1))
    feats = spark.createDataFrame([("Dumitru Șisamazescu", 1), (None, 2)], "entity string, n int")
    got = {}
    for n, e in rows(p2_names.link_names(p2_names.names_of(ner, feats)), "name", "entity"):
        got.setdefault(e, set()).add(n)
    want = [set(v) for v in NAMES.values()]
    # the initial C. fits Corina only
    want[1].add("C. Cișigimescu")
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert p2_names.link_names(p2_names.names_of(ner.limit(0), feats.limit(0))).count() == 0


def test_p2_frequent_family_name(spark):
    """A family name with hundreds of bearers: typos at the start of a given name are linked, no block is needed whole."""
    made = [f"{a}{b}{c}una Ionescu" for a in "bdfgklmpst" for b in "aeiou" for c in "bdfgk"]
    names = ["Cristina Ionescu", "Rcistina Ionescu", "Ristina Ionescu", *made]
    links = p2_names.link_names(p2_names.names_of(spark.createDataFrame([(names,)], "ner array<string>"), spark.createDataFrame([], "entity string")))
    assert [n for n, e in rows(links, "name", "entity") if e == "Cristina Ionescu"] == ["Cristina Ionescu", "Rcistina Ionescu", "Ristina Ionescu"]


def test_p2_typos_of_several_names_and_ties(spark):
    """A misspelt family name in three spellings, and one that is as frequent as the right one; bearers of a like family name stay apart."""
    same = [["Ion Ionescu", "IONESCU Ion", "Ionescu, Ion", "dl. Ion Ionescu", "Ion Ionsecu", "IONSECU Ion", "Ionsecu, Ion"], ["Maria Dobrogeanu", "Maria Dobrgoeanu"], ["Horia Darocevescu", "H. Darocevescu", "Darocevescu"], ["Paula Darosecescu", "P. Darosecescu", "Darosecescu"]]
    given_name = [f"Maria {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}olteanu" for i in range(0, 20, 3)]
    ner = spark.createDataFrame([(v,) for v in [*same, given_name]], "ner array<string>")
    got = {}
    for n, e in rows(p2_names.link_names(p2_names.names_of(ner, spark.createDataFrame([], "entity string"))), "name", "entity"):
        got.setdefault(e, []).append(n)
    assert sorted(got.values()) == sorted(sorted(v) for v in same)


def test_p2_two_slips_in_several_spellings(spark):
    """A family name with two slips is linked however many spellings it has; two replaced letters in several spellings make another name."""
    given_name = [f"Anca {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}olteanu" for i in range(0, 23, 2)]
    same = [["Ion Constantinescu", "CONSTANTINESCU Ion", "Constantinescu, Ion", "Ion Cosntantniescu", "COSNTANTNIESCU Ion", "Cosntantniescu, Ion", "Ion Constantnesccu", "CONSTANTNESCCU Ion"], ["Anca Difasagescu", "DIFASAGESCU Anca", "dl. Anca Difasagescu"], ["Anca Didanagescu", "DIDANAGESCU Anca"]]
    ner = spark.createDataFrame([(v,) for v in [*same, given_name]], "ner array<string>")
    got = {}
    for n, e in rows(p2_names.link_names(p2_names.names_of(ner, spark.createDataFrame([], "entity string"))), "name", "entity"):
        got.setdefault(e, []).append(n)
    assert sorted(got.values()) == sorted(sorted(v) for v in same)


@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_p2_symmetric_deletion_finds_all_edits(a, b):
    n = min(p2_names.allowed(a, b), p2_names.allowed(b, a))
    if n and p2_names.edits(a, b, n) <= n:
        assert set(p2_names.deletions(a)) & set(p2_names.deletions(b))
    assert p2_names.edits(a, b, 9) == p2_names.edits(b, a, 9)


TOKENS = st.tuples(st.sampled_from("cristina rcistina ristina cris c cr ion ionel ionut i ioan ioana maria mari m alexandra alex sanda sandra dan daniel daniil marian".split()), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKENS, min_size=1, max_size=4), st.lists(TOKENS, min_size=1, max_size=5))
def test_p2_forms_that_relate_have_a_common_key(a, b):
    form = lambda x: ("popescu", [t for t, _ in x], [d for _, d in x])
    if len(b) >= len(a) and p2_names.relate(form(a), form(b)):
        batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array(["h", "h"]), pa.array([form(x)[1] for x in (a, b)]), pa.array([form(x)[2] for x in (a, b)])], ["id", "hub", "t", "d"])
        keys = next(p2_names._key_batches([batch]))
        assert set(keys.column(3)[0].as_py()) & set(keys.column(2)[1].as_py())


@settings(max_examples=200, deadline=None)
@given(st.lists(TOKENS, min_size=1, max_size=5), st.lists(TOKENS, min_size=1, max_size=5))
def test_p2_both_assignments_agree(a, b):
    x, y = p2_names.align(a, b), p2_names._align_wide(a, b)
    assert (x is None) == (y is None)
    if x:
        cost = lambda p: sum(r[0] * 2 + r[1] * 3 + (i != j) for i, j in enumerate(p) for r in [p2_names.relation(*a[i], *b[j])])
        assert cost(x[2]) == cost(y[2]) and y[0] <= x[0]


def test_p2_long_names_are_aligned():
    a = [(t, False) for t in "asociatia nationala pentru apararea drepturilor pacientilor varstnici din dobrogea romana".split()]
    assert p2_names.align(a, a) == (p2_names.SAME, 0, list(range(10)))
    assert p2_names.align(a, [("filiala", False), ("noua", False), *a[:9]]) is None


def test_p1_ties_and_splits(spark):
    arts = [("u1", "a.ro", "Ana; Ion "), ("u2", "WWW.b.ro", "ana"), ("u3", "c.ro", None), ("u4", "d.ro", ";;"), ("u5", None, "Ana"), ("u6", "e.ro", "x"), ("u1", None, "Zoe")]
    arts += [(f"k{i}", f"k{i}.ro", "Redacția") for i in range(9)] + [("u9", "z.ro", "Ana")]
    labels = [("u1", "t1", "biased"), ("u1", "t1", None), ("u2", "t2", None), ("u3", "same", "biased"), ("u4", "same", "unbiased"), ("u5", "t1", "biased"), ("u6", "", "biased"), ("none", None, None), (None, "same", "biased"), ("far", "same", "biased")]
    labels += [(f"k{i}", f"x{i}", "biased") for i in range(9)]
    a = spark.createDataFrame(arts, "url string, source_domain string, authors string").withColumn("source", F.lit(1)).withColumn("label", F.lit(1))
    n = spark.createDataFrame(labels, "url string, cleantext string, snorkel_label string").withColumn("source", F.lit(1)).withColumn("node", F.lit(1))
    urls, names = p1_splits.labelled(n, a)
    ties = p1_splits.author_ties(names).union(p1_splits.text_ties(n, urls, False))
    assert {frozenset(x) for x in rows(ties.where("a <> b"), "a", "b")} == {frozenset(("a.ro", "b.ro")), frozenset(("c.ro", "d.ro"))}
    got = {u: (s, x) for u, s, x in (tuple(r) for r in p1_splits.assign_splits(n, a).select("url", "source", "split").collect())}
    assert set(got) == {u for u, _, _ in labels if u}
    assert got["u1"][1] == got["u2"][1] == got["u5"][1] and got["u3"][1] == got["u4"][1] == got["far"][1]
    assert p1_splits.assign_splits(n.limit(0), a).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from("xyz"), st.integers(1, 9), min_size=1), st.integers(1, 30)), min_size=1, max_size=8))
def test_p1_allocation_keeps_quotas(bundles):
    counts = p1_splits.allocate(bundles)
    assert [sum(c) for c in counts] == [n for _, n in bundles] and all(x >= 0 for c in counts for x in c)
    sizes = [sum(p.values()) for p, _ in bundles]
    total, largest = sum(s * n for s, (_, n) in zip(sizes, bundles)), max(sizes)
    for k, (_, share) in enumerate(p1_splits.SPLITS):
        assert abs(sum(c[k] * s for c, s in zip(counts, sizes)) - share * total) <= largest * (len(bundles) + 1)
    for label in "xyz":
        of = sum(p.get(label, 0) * n for p, n in bundles)
        for k, (_, share) in enumerate(p1_splits.SPLITS):
            assert abs(sum(c[k] * p.get(label, 0) for c, (p, _) in zip(counts, bundles)) - share * of) <= largest * (len(bundles) + 1)


def test_p1_labels_keep_their_quotas_too():
    counts = np.array(p1_splits.allocate([({"a": 1}, 1000), ({"b": 1}, 500), ({"a": 3, "b": 1}, 10)]))
    sizes, a, b = np.array([1, 1, 4]) @ counts, np.array([1, 0, 3]) @ counts, np.array([0, 1, 1]) @ counts
    assert sizes.tolist() == [1232, 154, 154] and np.abs(a - [824, 103, 103]).max() <= 2 and np.abs(b - [408, 51, 51]).max() <= 2


def test_p1_found_is_told_from_the_assignment(spark, tmp_path):
    rows_ = [(f"u{i}", f"s{i % 6}.ro", {0: "Ana", 1: "Ana", 2: "Ion", 3: "Ion"}.get(i % 6)) for i in range(60)]
    spark.createDataFrame(rows_, "url string, source_domain string, authors string").write.parquet(f"{tmp_path}/{p1_splits.SHUFFLED}.parquet")
    # a url without source holds two texts: it ties its sources' splits, but makes them no case
    labels = [(u, f"t{u}", "biased") for u, _, _ in rows_] + [("far", "x", "biased"), ("far", "y", "biased"), ("u4", "x", "biased"), ("u5", "y", "biased")]
    spark.createDataFrame(labels, "url string, cleantext string, snorkel_label string").write.parquet(f"{tmp_path}/{p1_splits.LABELS}.parquet")
    assert rows(p1_splits.p1_found(spark, str(tmp_path)), "source_a", "source_b") == [("s0.ro", "s1.ro"), ("s2.ro", "s3.ro")]
    split = {s: x for s, x in rows(p1_splits.p1_splits(spark, str(tmp_path)).where("source is not null"), "source", "split")}
    assert split["s0.ro"] == split["s1.ro"] and split["s2.ro"] == split["s3.ro"] and split["s4.ro"] == split["s5.ro"]
