"""Variant spellings of names typed by people (problem 2).

Method: every name is folded and split into tokens (titles off, ``Last, First``
put in order); a symmetric-delete index over the distinct tokens finds those
within one edit (two for long tokens); a name's anchor is the token that
fewest names have (a typo counts with the token it is a typo of; tokens about as
rare are anchors too), and names meet in the blocks of their anchors. Within a block tokens are aligned by optimal
assignment, permitting edits, initials, abbreviations and nicknames. Full forms
are linked first; shortened forms (initials, nicknames, a dropped name, the
family name alone) only where one identity fits. Acronyms are joined to the one
organisation whose usual form has these initials. Identities are the connected
components of the links.

Forms to align are looked up by their tokens (symmetric deletions, nicknames,
initials and other beginnings), which finds every form that can be aligned, by
joins within the blocks: no block is gathered in a task, however many names it
has, and all blocks are treated alike.

Nulls and names without letters take no part. A single word is a name only if
it is the anchor of a longer one, or an acronym; places therefore stay alone.
Repeated elements count as occurrences. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm import textvec as tv
from presslens.operators.graph import connected_components
from presslens.session import table
from presslens.storage import materialize

NER, FEATURES = "romanian_political_articles_v2_ner", "entity_source_sentiment_features"
WIDE = 8  # tokens above which the assignment is solved by augmenting paths
ALIKE = 3  # a token of up to so many times the rarest one's names is an anchor beside it
LONG = 8  # tokens of so many letters may have two edits

# Forms of address and titles before a name, folded.
TITLES = set("dl dna dnul dra domnul doamna domnisoara prof profesor profesorul dr doctor ing av avocat avocatul gen general generalul col senator senatorul deputat deputatul ministru ministrul premier premierul presedinte presedintele europarlamentar primar primarul".split())

# Romanian hypocoristics and the given names they stand for, folded.
NICKNAMES = {
    "ada": "adriana", "adi": "adrian", "aura": "aurelia", "alex": "alexandru alexandra", "alecu": "alexandru", "ana": "anca", "ancuta": "anca", "andra": "alexandra", "bebe": "bogdan", "bianc": "bianca", "bibi": "bianca",
    "bogdi": "bogdan", "catalin": "catalin", "cata": "catalin catalina", "cati": "ecaterina catalina", "cora": "corina", "costel": "constantin", "costica": "constantin", "costi": "constantin", "dinu": "constantin", "cristi": "cristian cristina", "cris": "cristina cristian",
    "dan": "daniel", "dani": "daniel daniela", "danut": "daniel dan", "deea": "andreea", "didi": "dumitru", "dida": "andreea", "doinita": "doina", "dora": "teodora", "dori": "doina teodora", "dumi": "dumitru", "emi": "emil emilia", "emilut": "emil",
    "fane": "stefan", "fanel": "stefan", "fania": "stefania", "feli": "felicia", "flori": "florin florina", "florica": "florin floarea", "florinel": "florin", "gabi": "gabriel gabriela", "geo": "george gheorghe", "genu": "eugen", "jenica": "eugen", "gica": "gheorghe", "gicu": "gheorghe", "ghita": "gheorghe",
    "gigi": "gheorghe", "gogu": "gheorghe", "horica": "horia", "horatiu": "horia", "iancu": "ioan", "ica": "maria", "ilinca": "elena", "ilut": "ilie", "iliuta": "ilie", "ionel": "ion ioan", "ionela": "ioana", "ionut": "ion ioan", "nelu": "ion ioan",
    "iuli": "iulian iuliana", "iulica": "iulian", "lau": "laurentiu laura", "lavi": "lavinia", "lena": "elena", "lenuta": "elena", "leni": "elena", "lia": "lavinia", "lica": "vasile", "lili": "liliana", "lori": "loredana", "loredanca": "loredana", "magda": "magdalena",
    "mari": "maria marian", "marinel": "marian marin", "marinica": "marian marin", "marius": "marian", "mihaita": "mihai", "misu": "mihai mihail", "mitica": "dumitru", "mitu": "dumitru", "moni": "simona monica", "nati": "natalia", "nata": "natalia", "neculai": "nicolae",
    "nicu": "nicolae", "nicusor": "nicolae", "nae": "nicolae", "nico": "nicolae nicoleta", "oana": "ioana", "oli": "olimpia", "oly": "olimpia", "tavi": "octavian", "paulica": "paula", "pauli": "paula", "petre": "petru", "petrica": "petru petre", "puiu": "petru", "radut": "radu", "raducu": "radu",
    "rodi": "rodica", "roxi": "roxana", "roxanica": "roxana", "sanda": "alexandra", "sandu": "alexandru", "seba": "sebastian", "sebi": "sebastian", "simo": "simona", "simi": "simona", "stefi": "stefania stefan", "teo": "teodora teodor", "tibi": "tiberiu",
    "tica": "constantin", "titi": "constantin", "vali": "valentin valentina", "valentino": "valentin", "vasi": "vasile", "vasilica": "vasile", "sile": "vasile", "vica": "victoria viorica", "viki": "victoria", "vicki": "victoria", "vio": "viorica viorel", "zoli": "zoltan",
}
NICKNAMES = {k: frozenset(v.split()) for k, v in NICKNAMES.items()}

_TITLE_DASH = regex.compile(r"^d[- ]?(?:na|nul|ra|lui)\b\.?\s*")
_TOKEN = regex.compile(r"([\p{L}\p{N}]+)(\.?)")


def parse(name: str) -> tuple[list[str], list[bool], str]:
    """Tokens, which of them end with a dot, and the acronym that the name is (or nothing)."""
    plain = tv.fold_text(name.replace("ß", "ss")).strip()
    plain = regex.sub(r"\s+", " ", plain)
    plain = _TITLE_DASH.sub("", plain)
    head, comma, tail = plain.partition(",")
    if comma and tail.strip():
        plain = f"{tail.strip()} {head.strip()}"
    found = [(m[1], bool(m[2])) for m in _TOKEN.finditer(plain)]
    while len(found) > 1 and found[0][0] in TITLES:
        found.pop(0)
    tokens, dots = [t for t, _ in found], [d for _, d in found]
    acronym = ""
    if len(tokens) == 1 and 3 <= len(tokens[0]) <= 6 and name.strip().isupper():
        acronym = tokens[0]
    elif len(tokens) >= 3 and all(len(t) == 1 for t in tokens):
        acronym = "".join(tokens)
    return tokens, dots, acronym


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting as one; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """How many edits two tokens may differ by."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < LONG else 2


def replaced(a: str, b: str) -> bool:
    """Whether two words differ by two replaced letters: most such family names are names of their own, while a slip swaps, drops or doubles letters."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 2 and edits(a, b, 2) == 2


def deletions(t: str) -> list[str]:
    """The word without up to two of its letters (one, for words of middle length)."""
    if len(t) < 4:
        return []
    out = {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}
    if len(t) >= LONG:
        out |= {s[:i] + s[i + 1 :] for s in list(out) if len(s) < len(t) for i in range(len(s))}
    return sorted(out)


SAME, NICK, ABBREVIATION, INITIAL = 0, 1, 2, 3


def relation(x: str, xd: bool, y: str, yd: bool) -> tuple[int, int] | None:
    """(kind, edits) of how one token may stand for another."""
    if x == y:
        return SAME, 0
    if len(x) > len(y):
        x, xd, y = y, yd, x
    if len(x) == 1:
        return (INITIAL, 0) if y[0] == x else None
    if xd and y.startswith(x):
        return ABBREVIATION, 0
    n = allowed(x, y)
    if n and (e := edits(x, y, n)) <= n:
        return SAME, e
    for a, b in ((x, y), (y, x)):
        for full in NICKNAMES.get(a, ()):
            if b == full or (len(b) >= 5 and edits(b, full, 1) <= 1):
                return NICK, 0
    if 3 <= len(x) <= 5 and len(y) >= len(x) + 2 and y.startswith(x):
        return NICK, 0
    return None


def align(a: list[tuple[str, bool]], b: list[tuple[str, bool]]) -> tuple[int, int, list[int]] | None:
    """Optimal assignment of the tokens of the shorter ``a`` to tokens of ``b``: (weakest kind, edits, places in b), or None."""
    if len(a) > WIDE:
        return _align_wide(a, b)
    best: dict[tuple[int, ...], tuple[int, int, int]] = {(): (0, 0, 0)}
    for x, xd in a:
        grown: dict[tuple[int, ...], tuple[int, int, int]] = {}
        for used, (cost, kind, n) in best.items():
            for j, (y, yd) in enumerate(b):
                if j in used or (r := relation(x, xd, y, yd)) is None:
                    continue
                c = (cost + r[0] * 2 + r[1] * 3 + (len(used) != j), max(kind, r[0]), n + r[1])
                key = (*used, j)
                if key not in grown or c < grown[key]:
                    grown[key] = c
        # of assignments that use the same places only the best need be kept
        least: dict[frozenset, tuple] = {}
        for used, c in grown.items():
            s = frozenset(used)
            if s not in least or c < least[s][1]:
                least[s] = (used, c)
        best = dict(least.values())
        if not best:
            return None
    used, (_, kind, n) = min(best.items(), key=lambda u: (u[1], u[0]))
    return kind, n, list(used)


def _align_wide(a: list[tuple[str, bool]], b: list[tuple[str, bool]]) -> tuple[int, int, list[int]] | None:
    """``align`` in cubic time: least cost, then the least weakest kind, then the fewest edits."""
    if len(a) > len(b):
        return None
    related = [[relation(x, xd, y, yd) for y, yd in b] for x, xd in a]
    unit = 3 * len(a) + 1  # more than all edits together
    most = None
    for kind in (INITIAL, SAME, NICK, ABBREVIATION, INITIAL):
        cost = [[(r[0] * 2 + r[1] * 3 + (i != j)) * unit + r[1] if r and r[0] <= kind else None for j, r in enumerate(row)] for i, row in enumerate(related)]
        places = _assign(cost)
        if most is None:
            if places is None:
                return None
            most = sum(cost[i][j] for i, j in enumerate(places)) // unit
        elif places and sum(cost[i][j] for i, j in enumerate(places)) // unit == most:
            return kind, sum(related[i][j][1] for i, j in enumerate(places)), places
    return None


def _assign(cost: list[list[int | None]]) -> list[int] | None:
    """Column of each row at the least total cost, by shortest augmenting paths; None where a row cannot be placed. Pairs without cost are not allowed."""
    rows, cols = len(cost), len(cost[0])
    never = 1 + rows * max((c for row in cost for c in row if c is not None), default=0)
    u, v, owner = [0] * rows, [0] * cols, [-1] * cols
    for i in range(rows):
        least, came, done = [None] * cols, [-1] * cols, [False] * cols
        row, col = i, -1
        while True:
            step, to = None, -1
            for j in range(cols):
                if not done[j]:
                    c = (never if cost[row][j] is None else cost[row][j]) - u[row] - v[j]
                    if least[j] is None or c < least[j]:
                        least[j], came[j] = c, col
                    if step is None or least[j] < step:
                        step, to = least[j], j
            u[i] += step
            for j in range(cols):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            col, done[to] = to, True
            if owner[col] < 0:
                break
            row = owner[col]
        while col >= 0:
            before = came[col]
            owner[col] = i if before < 0 else owner[before]
            col = before
    places = [-1] * rows
    for j, i in enumerate(owner):
        if i >= 0:
            places[i] = j
    return None if any(cost[i][j] is None for i, j in enumerate(places)) else places


@lru_cache(maxsize=200_000)
def bonds(t: str, dotted: bool) -> tuple[frozenset[tuple[str, str]], frozenset[tuple[str, str]]]:
    """(filed, sought): of two tokens with a relation, one is filed under a key that the other is sought by, either way round."""
    both = {("whole", s) for x in (t, *NICKNAMES.get(t, ())) for s in (x, *deletions(x))}
    heads = [t[:i] for i in range(1, len(t) + 1)]
    stub = [t] if dotted or len(t) == 1 or 3 <= len(t) <= 5 else []
    return frozenset(both | {("head", h) for h in heads} | {("stub", x) for x in stub}), frozenset(both | {("stub", h) for h in heads} | {("head", x) for x in stub})


FORM = "name string, hub string, id string, anchor string, t array<string>, d array<boolean>"


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, tokens, dots, anchor, hub) -> the form of the name in the block of the hub: its anchor, and the rest of its tokens."""
    for batch in batches:
        name, tokens, dots, anchor, hub = (c.to_pylist() for c in batch.columns)
        rest, ids = [], []
        for ts, ds, x, h in zip(tokens, dots, anchor, hub):
            i = ts.index(x)
            rest.append((ts[:i] + ts[i + 1 :], ds[:i] + ds[i + 1 :]))
            ids.append("\x1f".join([h, x, " ".join(t + "." * d for t, d in zip(*rest[-1]))]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(4), pa.array(ids, pa.string()), batch.column(3), pa.array([t for t, _ in rest], pa.list_(pa.string())), pa.array([d for _, d in rest], pa.list_(pa.bool_()))],
            ["name", "hub", "id", "anchor", "t", "d"],
        )


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hub, t, d) -> the keys the form is filed under, by all tokens, and those it is sought by: each token must have its like, so those of the longest will do."""
    for batch in batches:
        filed, sought, n, full = [], [], [], []
        for ts, ds in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            both = list(zip(ts, ds))
            filed.append(sorted({f"{kind} {key}" for t in both for kind, key in bonds(*t)[0]}))
            sought.append(sorted(f"{kind} {key}" for kind, key in bonds(*max(both, key=lambda t: (len(t[0]), t)))[1]) if both else [])
            n.append(len(ts))
            full.append(bool(ts) and all(len(t) > 1 for t in ts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(filed, pa.list_(pa.string())), pa.array(sought, pa.list_(pa.string())), pa.array(n, pa.int32()), pa.array(full, pa.bool_())],
            ["id", "hub", "filed", "sought", "n", "full"],
        )


RELATION = "k string, j string, alike boolean, dropped boolean, short boolean, same boolean, full boolean"


def relate(a: tuple, b: tuple) -> tuple[bool, bool, bool, bool] | None:
    """How the form ``a`` may stand for the form ``b``, both ``(anchor, tokens, dots)``: (alike, with a token dropped, shortened, of the very same anchor), or None."""
    (x, xt, xd), (y, yt, yd) = a, b
    r = align(list(zip(xt, xd)), list(zip(yt, yd)))
    if r is None:
        return None
    kind, e, places = r
    apart = edits(x, y, 2)
    if e + apart > 2:
        return None
    n, m = len(xt), len(yt)
    plain, leads = kind in (SAME, ABBREVIATION), 0 in places
    # one token alone must stand for the first; an initial too, unless the other is one token as well
    fits = not (m > n and n == 1 and not leads) and (kind != INITIAL or m == n == 1 or leads or n > 1)
    full = all(len(t) > 1 for t in xt)
    return full and plain and m == n, full and plain and m == n + 1 and fits, fits, apart == 0


def _relate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, anchor, t, d, j, anchor, t, d) -> related forms."""
    for batch in batches:
        k, ax, at, ad, j, bx, bt, bd = (c.to_pylist() for c in batch.columns)
        out = []
        for i in range(len(batch)):
            r = relate((ax[i], at[i], ad[i]), (bx[i], bt[i], bd[i]))
            if r is not None and any(r[:3]):
                out.append((k[i], j[i], *r, all(len(t) > 1 for t in at[i])))
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.bool_()) for i, c in enumerate(cols)], ["k", "j", "alike", "dropped", "short", "same", "full"])


def _merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps(id, c)`` after the components that ``edges(a, b)`` join have become one."""
    cc = connected_components(edges).select(F.col("node").alias("c"), "component")
    return materialize(comps.join(cc, "c", "left").select("id", F.coalesce("component", "c").alias("c")), "p2-comps")


def _only_fit(relations: DataFrame, comps: DataFrame) -> DataFrame:
    """``(k, a, b)``: forms for which only one identity fits, their own component and that one. If bearers of the very same anchor fit, only they count."""
    r = relations.join(comps.select(F.col("id").alias("k"), F.col("c").alias("own")), "k").join(comps.select(F.col("id").alias("j"), F.col("c").alias("root")), "j")
    of = lambda same: F.when((F.col("same") == same) & (F.col("root") != F.col("own")), F.col("root"))
    least = [f(of(same)).alias(n) for same, t in ((True, "s"), (False, "o")) for f, n in ((F.min, f"{t}_least"), (F.max, f"{t}_most"))]
    sums = r.groupBy("k", "own").agg(F.bool_or("same").alias("has"), *least)
    pick = lambda n: F.when(F.col("has"), F.col(f"s_{n}")).otherwise(F.col(f"o_{n}"))
    return sums.select("k", F.col("own").alias("a"), pick("least").alias("b"), pick("most").alias("_most")).where("b = _most").drop("_most")


def link_forms(homes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the names of ``homes(name, tokens, dots, anchor, hub)`` that meet in a block.

    No block is gathered: forms meet by the keys of their tokens within it, and
    whether only one identity fits is told from the least and the greatest one.
    Each step sees the identities that the steps before it have made.
    """
    made = materialize(homes.select("name", "tokens", "dots", "anchor", "hub").mapInArrow(_form_batches, FORM), "p2-forms")
    forms = materialize(made.select("id", "hub", "anchor", "t", "d").dropDuplicates(["id"]), "p2-distinct")
    # few bytes but much work: the partitions must not be put together
    spread = int(homes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialize(forms.select("id", "hub", "t", "d").repartition(spread, "id").mapInArrow(_key_batches, "id string, hub string, filed array<string>, sought array<string>, n int, full boolean"), "p2-keys")
    filed = keyed.where("full").select(F.col("id").alias("j"), "hub", F.col("n").alias("m"), F.explode("filed").alias("key"))
    sought = keyed.where("n > 0").select(F.col("id").alias("k"), "hub", "n", F.explode("sought").alias("key"))
    pairs = sought.join(filed, ["hub", "key"]).where("k <> j and m between n and n + 2").select("k", "j").distinct()
    side = lambda name: forms.select(F.col("id").alias(name), F.col("anchor").alias(f"{name}_anchor"), F.col("t").alias(f"{name}_t"), F.col("d").alias(f"{name}_d"))
    both = pairs.join(side("k"), "k").join(side("j"), "j").select("k", "k_anchor", "k_t", "k_d", "j", "j_anchor", "j_t", "j_d").repartition(spread)
    related = materialize(both.mapInArrow(_relate_batches, RELATION), "p2-related")
    comps = forms.select("id", F.col("id").alias("c"))
    # full forms of as many tokens, then a dropped token where one identity fits
    comps = _merged(comps, related.where("alike").select(F.col("k").alias("a"), F.col("j").alias("b")))
    comps = _merged(comps, _only_fit(related.where("dropped"), comps).select("a", "b"))
    # full forms with nicknames before initials, which more forms fit; of them those that stand alone, as nicknames do
    sizes = comps.groupBy(F.col("c").alias("a")).agg((F.count("*") == 1).alias("alone"))
    nick = forms.select(F.col("id").alias("k"), F.exists("t", lambda x: x.isin(*NICKNAMES)).alias("nick"))
    fit = _only_fit(related.where("short and full"), comps).join(sizes, "a").join(nick, "k").where("alone or nick")
    comps = _merged(comps, fit.select("a", "b"))
    comps = _merged(comps, _only_fit(related.where("short and not full"), comps).select("a", "b"))
    # the anchor alone: the one identity of its bearers, or of those of the name it is a typo of
    placed = forms.join(comps, "id").join(keyed.select("id", "full"), "id").select("hub", "anchor", "c", "full", (F.size("t") == 0).alias("single"))
    roots = placed.where("full").groupBy("hub", "anchor").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    alone = placed.where("single").select("hub", "anchor", F.col("c").alias("a"))
    own = alone.join(roots, ["hub", "anchor"], "left")
    other = own.where("least is null").select("hub", "a").join(roots.where("anchor = hub").select("hub", "least", "most"), "hub")
    comps = _merged(comps, own.select("a", "least", "most").union(other.select("a", "least", "most")).where("least = most").select("a", F.col("least").alias("b")))
    grouped = made.select("name", "id", (F.size("t") > 0).alias("long")).join(comps, "id")
    lead = grouped.groupBy("c").agg(F.min("name").alias("b"), F.max("name").alias("most"), F.bool_or("long").alias("long")).where("b <> most and long").select("c", "b")
    return grouped.join(lead, "c").where("name <> b").select(F.col("name").alias("a"), "b").distinct()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [parse(x) for x in batch.column(0).to_pylist()]
        cols = [pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.list_(pa.bool_())), pa.array([m[2] for m in made], pa.string())]
        cols.append(pa.array([[len(t) < 4 or d or t in NICKNAMES for t, d in zip(m[0], m[1])] for m in made], pa.list_(pa.bool_())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["name", "n", "tokens", "dots", "acronym", "short"])


def _delete_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([deletions(t) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["token", "support", "keys"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [edits(a, b, allowed(a, b)) if allowed(a, b) else 9 for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        ok = [e <= allowed(a, b) for e, a, b in zip(d, batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        other_name = [replaced(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32()), pa.array(other_name, pa.bool_())], ["token", "support", "other", "other_support", "d", "replaced"])
        yield out.filter(pa.array(ok, pa.bool_()))


def names_of(ner: DataFrame, features: DataFrame) -> DataFrame:
    """``(name, n)``: distinct names with their occurrences."""
    both = ner.select(F.explode("ner").alias("name")).union(features.select(F.col("entity").alias("name")))
    return both.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def token_neighbours(parsed: DataFrame) -> DataFrame:
    """``(token, support, other, other_support, d, replaced)``: tokens within their allowed edits, by symmetric deletion."""
    tokens = parsed.select("name", F.explode(F.array_distinct("tokens")).alias("token")).where("length(token) >= 4").groupBy("token").agg(F.count("*").alias("support"))
    keyed = tokens.mapInArrow(_delete_batches, "token string, support bigint, keys array<string>").select("token", "support", F.explode("keys").alias("key"))
    other = keyed.select(F.col("token").alias("other"), F.col("support").alias("other_support"), "key")
    pairs = keyed.join(other, "key").where("token <> other").select("token", "support", "other", "other_support").distinct()
    return pairs.mapInArrow(_verify_batches, "token string, support bigint, other string, other_support bigint, d int, replaced boolean")


def link_names(names: DataFrame) -> DataFrame:
    """``(name, entity)`` for names that have another spelling; the entity is named by its least spelling."""
    parsed = materialize(names.mapInArrow(_parse_batches, "name string, n bigint, tokens array<string>, dots array<boolean>, acronym string, short array<boolean>").where("size(tokens) > 0"), "p2-parsed")
    near = materialize(token_neighbours(parsed), "p2-tokens")
    # the rarer of two neighbours may be a typo of the other, either of two as frequent ones of the other; whether it is one the alignment tells,
    # but for two replaced letters it cannot, as most of these are family names of their own: there a token of one name only is taken for a typo
    hubs = near.where("support <= other_support and (not replaced or support = 1)").select("token", F.col("other").alias("hub"), "other_support", (F.expr("support < other_support and support <= case when d > 1 then 1 else 2 end")).alias("rare"))
    support = parsed.select("name", F.inline(F.arrays_zip(F.col("tokens").alias("token"), "short")))
    counts = support.select("name", "token").distinct().groupBy("token").agg(F.count("*").alias("support"))
    best = hubs.groupBy("token").agg(F.max("other_support").alias("hub_support"), F.max(F.when(F.col("rare"), F.col("other_support"))).alias("rare_support"))
    known_by = support.join(counts, "token").join(best, "token", "left")
    # a token of several names may be a typo or a word of its own: it is weighed both ways, and both ways give anchors
    weighed = known_by.select("name", "token", "short", F.posexplode(F.array(*(F.greatest("support", F.coalesce(c, F.lit(0))) for c in ("rare_support", "hub_support")))).alias("way", "weight"))
    # initials, abbreviations and nicknames never are anchors where there is another word; tokens about as rare as the rarest are anchors too
    order = F.struct("short", "weight", (-F.length("token")).alias("len"), "token")
    rarest = F.min(order).over(Window.partitionBy("name", "way"))
    also = ~F.col("short") & (F.col("weight") <= ALIKE * F.col("o.weight") + ALIKE)
    anchors = weighed.withColumn("o", rarest).where((F.col("token") == F.col("o.token")) | also).select("name", F.col("token").alias("anchor")).distinct()
    placed = parsed.where("acronym = ''").select("name", "tokens", "dots").join(anchors, "name")
    homes = placed.withColumn("hub", F.col("anchor")).unionByName(placed.join(hubs.select(F.col("token").alias("anchor"), "hub"), "anchor"))
    comps = connected_components(link_forms(homes)).select(F.col("node").alias("name"), "component")
    known = materialize(parsed.join(comps, "name", "left").select("name", "n", "tokens", "acronym", F.coalesce("component", "name").alias("entity")), "p2-known")
    return _with_acronyms(known)


def _with_acronyms(known: DataFrame) -> DataFrame:
    """Adds acronyms to the organisation whose usual form has these initials."""
    long_forms = known.where("acronym = '' and size(tokens) >= 3 and not exists(tokens, t -> length(t) < 3)")
    initials = F.array_join(F.transform("tokens", lambda t: F.substring(t, 1, 1)), "")
    usual = long_forms.groupBy("entity").agg(F.max_by(initials, F.struct("n", "name")).alias("acronym"), F.sum("n").alias("weight"))
    w = Window.partitionBy("acronym")
    ranked = usual.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "entity"))).withColumn("next", F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("weight"))).over(w), F.lit(0)))
    chosen = ranked.where("rank = 1 and weight >= 3 * next").select("acronym", F.col("entity").alias("org"))
    joined = known.join(chosen.withColumnRenamed("acronym", "acr"), (F.col("acronym") != "") & (F.col("acronym") == F.col("acr")), "left")
    same = F.when(F.col("acronym") != "", F.coalesce("org", F.concat(F.lit("acronym "), "acronym"))).otherwise(F.col("entity"))
    every = joined.select("name", same.alias("entity"))
    sized = every.groupBy("entity").agg(F.count("*").alias("size"), F.min("name").alias("least")).where("size > 1")
    return every.join(sized.select("entity", "least"), "entity").select("name", F.col("least").alias("entity"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(names_of(table(spark, sf_dir, NER).select("ner"), table(spark, sf_dir, FEATURES).select("entity")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(p2_entities(spark, sf_dir), "p2-entities")
    return known.select("entity", F.col("name").alias("name_a")).join(known.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
