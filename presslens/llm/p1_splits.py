"""Train, validation and test splits that keep related articles together (problem 1).

Sources are tied by an author who writes for both (an author of more than
``DESK`` sources is a desk and ties nothing) or by one and the same labelled
text; ties carry on (connected components), and articles without source are
tied to all that have their text. Method for the splits: components of the same
size and label profile form a bundle; a min-cost flow of articles from the
label classes to the splits, with costs for deviating from the quotas, gives
each class's shares; bundles take them up in order of size, shares are rounded
to whole components, and components are moved between splits while that brings
sizes and the counts of every label nearer to their quotas; a hash decides
which components of a bundle go where. What reaches the driver is one row for
each bundle and salt: components of more than a few articles are few, as each
takes whole sources.

Nulls: labels without url take no part; a url that no article has, or without
source, is tied by its text only. Null or empty texts and empty names tie
nothing; a url with several labels takes the least, null counts as a label of
its own. Repeated rows count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.operators.graph import connected_components
from presslens.session import norm_source, table
from presslens.storage import materialize

SHUFFLED, LABELS = "romanian_political_articles_v2_shuffled", "article_labels"
DESK = 8
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
BLANKS = r"[\s\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SALTS = 64


def author_names(c):
    """Distinct names of an ``authors`` string."""
    return F.array_distinct(F.transform(F.split(c, ";"), lambda x: F.lower(F.trim(F.regexp_replace(x, BLANKS, " ")))))


def labelled(labels: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(url, source, label)`` for each labelled url and ``(source, name)`` of the authors of labelled articles."""
    urls = labels.where("url is not null").groupBy("url").agg(F.min(F.coalesce("snorkel_label", F.lit("~"))).alias("label"))
    rows = articles.where("url is not null").select("url", norm_source(F.col("source_domain")).alias("source"), "authors").join(urls.select("url"), "url", "left_semi")
    per_url = rows.groupBy("url").agg(F.max("source").alias("source"), F.collect_set("authors").alias("authors"))
    joined = urls.join(per_url, "url", "left")
    names = joined.where("source is not null").select("source", F.explode("authors").alias("authors")).select("source", F.explode(author_names(F.col("authors"))).alias("name")).where("name <> ''").distinct()
    return joined.select("url", "source", "label"), names


def author_ties(names: DataFrame) -> DataFrame:
    """Edges (a, b) from the least source of a name to its others."""
    sizes = names.groupBy("name").agg(F.count("*").alias("n"), F.min("source").alias("b")).where(f"n > 1 and n <= {DESK}").select("name", "b")
    return names.join(sizes, "name").select(F.col("source").alias("a"), "b").distinct()


def text_ties(labels: DataFrame, urls: DataFrame, with_unsourced: bool) -> DataFrame:
    """Edges (a, b) from the least source of a text to its others; urls without source count as ``url: ...`` if wanted."""
    texts = labels.where("url is not null and cleantext <> ''").select("url", F.md5(F.col("cleantext").cast("binary")).alias("text"))
    node = F.coalesce("source", F.concat(F.lit("url: "), "url")) if with_unsourced else F.col("source")
    held = texts.join(urls.select("url", node.alias("node")), "url").where("node is not null").select("text", "node").distinct()
    lead = held.groupBy("text").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("text", "b")
    return held.join(lead, "text").select(F.col("node").alias("a"), "b").distinct()


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> dict[int, int]:
    """Successive shortest paths over ``arcs`` (from, to, capacity, cost); returns the flow of each arc."""
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]
    where = []
    for k, (u, v, cap, cost) in enumerate(arcs):
        graph[u].append([v, cap, cost, len(graph[v]), k])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1, -1])
        where.append((u, len(graph[u]) - 1, cap))
    while True:
        dist, via, queued = [float("inf")] * nodes, [None] * nodes, [False] * nodes
        dist[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            queued[u] = False
            for i, (v, cap, cost, _, _) in enumerate(graph[u]):
                if cap > 0 and dist[u] + cost < dist[v]:
                    dist[v], via[v] = dist[u] + cost, (u, i)
                    if not queued[v]:
                        queued[v] = True
                        queue.append(v)
        if dist[sink] == float("inf"):
            break
        push, v = float("inf"), sink
        while v != source:
            u, i = via[v]
            push, v = min(push, graph[u][i][1]), u
        v = sink
        while v != source:
            u, i = via[v]
            graph[u][i][1] -= push
            graph[v][graph[u][i][3]][1] += push
            v = u
    return {k: cap - graph[u][i][1] for k, (u, i, cap) in enumerate(where)}


def quotas(total: int) -> list[int]:
    """Whole shares of the splits that add up to the total: the parts cut off go to the largest remainders."""
    exact = [total * share for _, share in SPLITS]
    out = [int(x + 1e-9) for x in exact]
    for s in sorted(range(len(SPLITS)), key=lambda s: (out[s] - exact[s], s))[: total - sum(out)]:
        out[s] += 1
    return out


def class_shares(of_class: dict[str, int]) -> dict[str, list[int]]:
    """Articles of each label class for each split, by min-cost flow: deviations from a class's quota cost 1, from the whole's 4."""
    classes, k = sorted(of_class), len(SPLITS)
    total = sum(of_class.values())
    first_cell, first_split = 1 + len(classes), 1 + len(classes) * (1 + k)
    sink = first_split + k
    arcs, cells = [], []
    for i, c in enumerate(classes):
        arcs.append((0, 1 + i, of_class[c], 0))
        for s, quota in enumerate(quotas(of_class[c])):
            cell = first_cell + i * k + s
            cells.append((len(arcs), c, s))
            arcs += [(1 + i, cell, of_class[c], 0), (cell, first_split + s, quota, 0), (cell, first_split + s, of_class[c], 1)]
    for s, quota in enumerate(quotas(total)):
        arcs += [(first_split + s, sink, quota, 0), (first_split + s, sink, total, 4)]
    flow = min_cost_flow(arcs, sink + 1, 0, sink)
    out = {c: [0] * k for c in classes}
    for arc, c, s in cells:
        out[c][s] = flow[arc]
    return out


def allocate(bundles: list[tuple[dict[str, int], int]]) -> list[list[int]]:
    """For bundles (articles of each label in a component, components): how many components of each go to each split."""
    k = len(SPLITS)
    labels = sorted({x for profile, _ in bundles for x in profile})
    profiles = np.array([[p.get(x, 0) for x in labels] for p, _ in bundles], np.int64).reshape(len(bundles), len(labels))
    number, size = np.array([n for _, n in bundles], np.int64), profiles.sum(1)
    classes = [labels[i] for i in profiles.argmax(1)]
    of_class: dict[str, int] = defaultdict(int)
    for c, n in zip(classes, (size * number).tolist()):
        of_class[c] += n
    left = class_shares(of_class)
    counts = np.zeros((len(bundles), k), np.int64)
    # the largest components first, each to the split that lacks most of its class
    for b in sorted(range(len(bundles)), key=lambda b: (-size[b], classes[b], bundles[b][1], b)):
        room, rest = left[classes[b]], int(number[b])
        for s in sorted(range(k), key=lambda s: (-room[s], s)):
            take = min(rest, max(room[s], 0) // int(size[b]))
            counts[b, s] += take
            room[s] -= take * int(size[b])
            rest -= take
        for _ in range(rest):
            s = max(range(k), key=lambda s: (room[s], -s))
            counts[b, s] += 1
            room[s] -= int(size[b])
    return _improve(counts, profiles, number).tolist()


def _improve(counts: np.ndarray, profiles: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Moves single components between splits while the deviations of sizes (4 an article) and of each label's count (1) fall."""
    goal_labels = np.array([quotas(int(n)) for n in profiles.T @ number]).reshape(-1, counts.shape[1])
    goal_sizes = np.array(quotas(int((profiles.sum(1) * number).sum())))
    cost = lambda at: 4 * np.abs(at.sum(-2) - goal_sizes).sum(-1) + np.abs(at - goal_labels).sum((-2, -1))
    at = profiles.T @ counts  # articles of each label in each split
    now = cost(at)
    while True:
        best = None
        for s in range(counts.shape[1]):
            some = np.flatnonzero(counts[:, s])
            for t in range(counts.shape[1]):
                if s != t and len(some):
                    tried = np.repeat(at[None], len(some), 0)
                    tried[:, :, s] -= profiles[some]
                    tried[:, :, t] += profiles[some]
                    c = cost(tried)
                    i = int(c.argmin())
                    if c[i] < now and (best is None or c[i] < best[0]):
                        best = (c[i], int(some[i]), s, t)
        if best is None:
            return counts
        now, b, s, t = best
        counts[b, s] -= 1
        counts[b, t] += 1
        at[:, s] -= profiles[b]
        at[:, t] += profiles[b]


def _tied(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """``(url, source, label, tied, component)``: the component of sources a source is in, and that of sources and texts a url is in."""
    urls, names = labelled(labels, articles)
    urls = materialize(urls, "p1-urls")
    sources = connected_components(author_ties(names).union(text_ties(labels, urls, False))).withColumnRenamed("component", "tied")
    urls = urls.join(sources.withColumnRenamed("node", "source"), "source", "left").withColumn("tied", F.coalesce("tied", "source"))
    urls = materialize(urls.select("url", "source", "label", "tied"), "p1-tied")
    # articles without source, and what their texts tie
    nodes = urls.select("url", F.col("tied").alias("source"))
    comps = connected_components(text_ties(labels, nodes, True))
    placed = urls.withColumn("node", F.coalesce("tied", F.concat(F.lit("url: "), "url"))).join(comps, "node", "left")
    return materialize(placed.select("url", "source", "label", "tied", F.coalesce("component", "node").alias("component")), "p1-placed")


def _assigned(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """``(url, source, tied, split)`` for every labelled url."""
    placed = _tied(labels, articles)
    profile = placed.groupBy("component", "label").agg(F.count("*").alias("n"))
    per = profile.groupBy("component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("profile"))  # a handful of labels
    per = per.select("component", "profile", F.to_json("profile").alias("bundle"), F.pmod(F.xxhash64("component"), F.lit(SALTS)).alias("salt"))
    per = materialize(per, "p1-components")
    salted = per.groupBy("bundle", "salt").agg(F.count("*").alias("n"), F.any_value("profile").alias("profile")).collect()
    spark = labels.sparkSession
    bundles: dict[str, tuple[dict[str, int], int]] = {}
    for r in salted:
        bundles[r["bundle"]] = (r["profile"], r["n"] + bundles.get(r["bundle"], (None, 0))[1])
    order = sorted(bundles)
    counts = dict(zip(order, allocate([bundles[b] for b in order]))) if order else {}
    # rank of a component within its bundle: components of earlier salts, and the rank within its salt
    before, rows = defaultdict(int), []
    for r in sorted(salted, key=lambda r: (r["bundle"], r["salt"])):
        c = counts[r["bundle"]]
        rows.append((r["bundle"], r["salt"], before[r["bundle"]], c[0], c[0] + c[1]))
        before[r["bundle"]] += r["n"]
    cuts = spark.createDataFrame(rows, "bundle string, salt bigint, before bigint, cut0 bigint, cut1 bigint")
    rank = F.row_number().over(Window.partitionBy("bundle", "salt").orderBy(F.xxhash64("component", F.lit(7)), "component")) + F.col("before")
    split = F.when(F.col("rank") <= F.col("cut0"), SPLITS[0][0]).when(F.col("rank") <= F.col("cut1"), SPLITS[1][0]).otherwise(SPLITS[2][0])
    decided = per.join(cuts, ["bundle", "salt"]).select("component", rank.alias("rank"), "cut0", "cut1").select("component", split.alias("split"))
    return placed.join(decided, "component").select("url", "source", "tied", "split")


def assign_splits(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """``(url, source, split)`` for every labelled url."""
    return _assigned(labels, articles).select("url", "source", "split")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, LABELS).select("url", "cleantext", "snorkel_label"), table(spark, sf_dir, SHUFFLED).select("url", "source_domain", "authors")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(*_tables(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each split and label, as they came out and as the quotas ask."""
    labels, articles = _tables(spark, sf_dir)
    each = assign_splits(labels, articles).join(labelled(labels, articles)[0].select("url", "label"), "url")
    counts = each.groupBy("label", "split").agg(F.count("*").alias("n"))
    share = F.when(F.col("split") == SPLITS[0][0], SPLITS[0][1]).when(F.col("split") == SPLITS[1][0], SPLITS[1][1]).otherwise(SPLITS[2][1])
    totals = counts.groupBy("label").agg(F.sum("n").alias("of_label"))
    return counts.join(totals, "label").select("label", "split", "n", F.round(share * F.col("of_label"), 1).alias("wanted"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that are tied, from the assignment that keeps them in one split."""
    placed = _assigned(*_tables(spark, sf_dir)).where("source is not null").select("source", "tied", "split").distinct()
    placed = materialize(placed, "p1-found")
    one, other = (placed.select("tied", "split", F.col("source").alias(n)) for n in ("source_a", "source_b"))
    return one.join(other, ["tied", "split"]).where("source_a < source_b").select("source_a", "source_b")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares}
