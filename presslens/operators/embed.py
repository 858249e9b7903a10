"""Poisson factorization of a matrix and its orthogonal form.

log of the expected count of (row, domain) = U diag(w) V'. Rows of U stay
distributed beside the row's counts; V and w (one number a domain and rank) are
all that the driver holds and sends out. Rows with the same counts have the
same vector, so each distinct row is solved once and counts as often as it
occurs. Distinct rows are kept sparse, in blocks with their last vectors, from
which the next pass starts; the loss has an exponential in every cell, so a few
rows at a time are made dense in the workers. Sums over rows are added up by
Spark, element by element.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.storage import discard, materialize

MAX_DOMAINS = 5000
CLIP, WEIGHT = 20.0, 10.0
DENSE_CELLS, BLOCK_ROWS = 100_000, 4096
BLOCK = "size binary, at binary, n binary, times binary, u binary, sums array<double>"


def sparse_rows(matrix: DataFrame, row: str) -> tuple[DataFrame, list[str]]:
    """``(row, at: array<int>, n: array<double>)``: places of the sorted domains, and counts."""
    domains = [r[0] for r in matrix.select("domain").distinct().orderBy("domain").limit(MAX_DOMAINS + 1).collect()]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    index = matrix.sparkSession.createDataFrame(list(enumerate(domains)), "at int, domain string")
    cells = matrix.join(F.broadcast(index), "domain").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", F.col("n").cast("double").alias("n")))).alias("_c"))  # bounded by MAX_DOMAINS
    return cells.select(row, F.col("_c.at").alias("at"), F.col("_c.n").alias("n")), domains


@dataclass
class Block:
    """Some distinct rows: how many cells each has, their places and counts one after the other, how often each row occurs, and its vector."""

    size: np.ndarray
    at: np.ndarray
    n: np.ndarray
    times: np.ndarray
    u: np.ndarray

    def record(self, sums: np.ndarray | None = None) -> pa.RecordBatch:
        data = [pa.array([x.tobytes()], pa.binary()) for x in (self.size, self.at, self.n, self.times, self.u)]
        return pa.RecordBatch.from_arrays([*data, pa.array([sums], pa.list_(pa.float64()))], ["size", "at", "n", "times", "u", "sums"])

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, at, n, times, u = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("size", np.int32), ("at", np.int32), ("n", float), ("times", float), ("u", float)))
                yield Block(size, at, n, times, u.reshape(len(size), -1))

    def times_columns(self, v: np.ndarray) -> np.ndarray:
        """The rows times ``v``; each row has a cell at least."""
        return np.add.reduceat(self.n[:, None] * v[self.at], np.cumsum(self.size) - self.size, axis=0)

    def least_losses(self) -> np.ndarray:
        """The loss of each row where every count is expected as it is."""
        n = np.maximum(self.n, 1e-300)
        return np.add.reduceat(self.n - self.n * np.log(n), np.cumsum(self.size) - self.size)

    def by_domain(self, x: np.ndarray, domains: int) -> np.ndarray:
        """The transposed rows times ``x``."""
        x = np.repeat(x, self.size, axis=0) * self.n[:, None]
        return np.stack([np.bincount(self.at, c, domains) for c in x.T], axis=1)


def distinct_blocks(rows: DataFrame, rank: int) -> DataFrame:
    """The distinct rows of ``(at, n)`` in blocks, spread over all cores, with vectors of zeros."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, BLOCK_ROWS):
                at, n, times = batch.slice(b, BLOCK_ROWS).columns
                size = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
                yield Block(size, *(x.to_numpy(zero_copy_only=False).astype(t) for x, t in ((at.flatten(), np.int32), (n.flatten(), float), (times, float))), np.zeros((len(size), rank))).record()

    return rows.groupBy("at", "n").agg(F.count("*").alias("times")).repartition(parts).mapInArrow(run, BLOCK)


def added_up(each: DataFrame) -> np.ndarray:
    """The sum of the vectors in ``sums``: only the total comes to the driver."""
    each = each.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return each.toPandas().sort_values("i")["x"].to_numpy()


def summed(blocks: DataFrame, part) -> np.ndarray:
    """The sum of ``part(block)``, a vector, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in Block.read(batches):
            total = part(block) if total is None else total + part(block)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    return added_up(blocks.mapInArrow(run, "sums array<double>"))


def loss_and_gradients(n: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """Loss without the penalty, and the gradients of u, v and w; the gradient ignores the clip."""
    logits = np.clip((u * w) @ v.T, -CLIP, CLIP)
    expected = np.exp(logits)
    r = expected - n
    gu = (r @ v) * w
    gv = r.T @ (u * w)
    gw = ((r @ v) * u).sum(0)
    return float((expected - n * logits).sum()), gu, gv, gw


@dataclass
class PoissonEmbedder:
    """``fit`` solves the distributed rows for given V and w, from their vectors of the pass before, and takes damped Newton steps (by the diagonal) on V and w together; a step is kept only if the loss falls."""

    rank: int = 3
    seed: int = 42
    l2: float = 1e-4
    losses: list[float] = field(default_factory=list)

    def fit(self, matrix: DataFrame, row: str = "phrase", max_iter: int = 30) -> PoissonEmbedder:
        rows, self.domains = sparse_rows(matrix, row)
        self.row, self.rows = row, materialize(rows, "embed-rows")
        self.blocks = materialize(distinct_blocks(self.rows, min(self.rank, len(self.domains))), "embed-blocks")
        self.V = self._singular_vectors()
        self.w = np.ones(self.V.shape[1])
        step = 1.0
        (loss, gv, gw, hv, hw), solved = self._pass()
        self._keep(solved)
        self.losses = [loss]
        for _ in range(max_iter):
            tried = self.V, self.w
            self.V = tried[0] - step * (gv + 2 * self.l2 * tried[0]) / (hv + 2 * self.l2)
            self.w = np.clip(tried[1] - step * (gw + 2 * self.l2 * tried[1]) / (hw + 2 * self.l2), -WEIGHT, WEIGHT)
            new, solved = self._pass(loss)
            if new[0] < loss:
                self._keep(solved)
                done = loss - new[0] < 1e-5 * abs(loss)
                (loss, gv, gw, hv, hw), step = new, min(1.0, step * 1.5)
                self.losses.append(loss)
                if done:
                    break
            else:
                discard(solved)
                (self.V, self.w), step = tried, step / 4
                if step < 1e-3:
                    break
        return self

    def _keep(self, solved: DataFrame) -> None:
        discard(self.blocks)
        self.blocks = solved

    def _singular_vectors(self, passes: int = 6) -> np.ndarray:
        """The first right singular vectors by subspace iteration: each pass sums one thin array."""
        d = len(self.domains)
        r = min(self.rank, d)
        v = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(d, min(d, r + 6))))[0]

        def part(block, v):
            return block.by_domain(block.times_columns(v) * block.times[:, None], d).ravel()

        for _ in range(passes):
            y = summed(self.blocks, lambda block, v=v: part(block, v)).reshape(v.shape)
            small = np.linalg.eigh((v.T @ y + y.T @ v) / 2)
            best = v @ small[1][:, np.argsort(-small[0])[:r]]
            v = np.linalg.qr(y)[0]
        sign = np.sign(best[np.abs(best).argmax(0), range(r)])
        return best * np.where(sign == 0, 1, sign)

    def _pass(self, before: float = np.inf):
        """The loss with its first and second derivatives by V and w, and the blocks with the vectors at which they hold.

        A task stops, with an infinite loss, once its rows alone put the loss
        over ``before``, as they do if it is over the least loss of any model by
        more than the loss before was.
        """
        v, w, l2, d = self.V, self.w, self.l2, len(self.domains)
        penalty = l2 * float((v * v).sum() + (w * w).sum())
        most = before - penalty - self.least if np.isfinite(before) else np.inf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total = None, None
            for block in Block.read(batches):
                if last is not None:
                    yield last.record()
                found = solve_block(block, v, w, l2, d, most - (0 if total is None else total[1]))
                if found is None:
                    yield block.record(np.full(2 + 2 * v.size, np.inf))
                    return
                last, total = found[0], found[1] if total is None else total + found[1]
            if last is not None:
                yield last.record(total)

        solved = materialize(self.blocks.mapInArrow(run, BLOCK), "embed-blocks")
        sums = added_up(solved.select("sums"))
        loss = float(sums[0]) + penalty
        self.least = self.least if np.isfinite(before) else float(sums[0] - sums[1])
        g, h = np.where(np.isfinite(sums[2:]), sums[2:], 0).reshape(2, *v.shape)
        return (loss, g * w, (g * v).sum(0), h * w**2, (h * v * v).sum(0)), solved

    def weights(self) -> DataFrame:
        """``(bias_dim, weight)``."""
        return self.rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(self.w)], "bias_dim int, weight double")

    def phrases(self) -> DataFrame:
        """``(row, bias_dim_0, ...)``."""
        names = [f"bias_dim_{i}" for i in range(len(self.w))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in Block.read(batches):
                starts = pa.array(np.concatenate([[0], np.cumsum(b.size)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(starts, pa.array(b.at)), pa.ListArray.from_arrays(starts, pa.array(b.n)), *(pa.array(x) for x in b.u.T)], ["at", "n", *names])

        vectors = self.blocks.mapInArrow(run, "at array<int>, n array<double>, " + ", ".join(f"{n} double" for n in names))
        return self.rows.join(vectors, ["at", "n"]).select(self.row, *names)

    def domain_vectors(self) -> DataFrame:
        names = [f"bias_dim_{i}" for i in range(len(self.w))]
        return self.rows.sparkSession.createDataFrame([(d, *map(float, x)) for d, x in zip(self.domains, self.V)], "domain string, " + ", ".join(f"{n} double" for n in names))

    def reconstruct(self) -> DataFrame:
        """``(row, domain, expected)`` of every cell."""
        v = self.rows.sparkSession.createDataFrame([(d, [float(a * b) for a, b in zip(x, self.w)]) for d, x in zip(self.domains, self.V)], "domain string, v array<double>")
        names = [f"bias_dim_{i}" for i in range(len(self.w))]
        vs = v.agg(F.collect_list(F.struct("domain", "v"))).scalar()
        each = self.phrases().select(self.row, F.array(*names).alias("u"), F.explode(vs).alias("d"))
        dot = F.aggregate(F.zip_with("u", F.col("d.v"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return each.select(self.row, F.col("d.domain").alias("domain"), F.exp(F.greatest(F.least(dot, F.lit(CLIP)), F.lit(-CLIP))).alias("expected"))

    def orthogonalize(self, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Singular form of U diag(w) V': rows, domains and singular values. ``full`` pads with zeros to the smaller side."""
        names = [f"bias_dim_{i}" for i in range(len(self.w))]
        u = self.phrases()
        r = len(self.w)
        sums = summed(self.blocks, lambda b: np.concatenate([[b.times.sum()], (b.u.T @ (b.u * b.times[:, None])).ravel()]))
        m, gram = int(sums[0]), sums[1:].reshape(r, r)
        values, e = np.linalg.eigh(gram)
        values = np.clip(values, 0, None)
        ru = (np.sqrt(values)[:, None] * e.T) @ np.diag(self.w)
        qv, rv = np.linalg.qr(self.V)
        a, s, bt = np.linalg.svd(ru @ rv.T, full_matrices=False)
        right = qv @ bt.T
        sign = np.sign(right[np.abs(right).argmax(0), range(right.shape[1])])
        sign[sign == 0] = 1
        right = right * sign
        to_left = (e * np.where(values > 1e-300, 1 / np.sqrt(np.maximum(values, 1e-300)), 0)) @ a * sign
        extra = max(0, min(m, len(self.domains)) - r) if full else 0
        out = u.select(self.row, *(sum((F.col(c) * float(to_left[i, j]) for i, c in enumerate(names)), F.lit(0.0)).alias(f"bias_dim_{j}") for j in range(len(s))), *(F.lit(0.0).alias(f"bias_dim_{len(s) + k}") for k in range(extra)))
        spark = u.sparkSession
        domains = spark.createDataFrame([(d, *map(float, x), *([0.0] * extra)) for d, x in zip(self.domains, right)], "domain string, " + ", ".join(f"bias_dim_{j} double" for j in range(len(s) + extra)))
        return out, domains, spark.createDataFrame([(j, float(x)) for j, x in enumerate([*s, *([0.0] * extra)])], "bias_dim int, singular_value double")


def solve_block(block: Block, v: np.ndarray, w: np.ndarray, l2: float, domains: int, most: float = np.inf) -> tuple[Block, np.ndarray] | None:
    """The block with its rows' vectors for V and w, and in one vector their loss, by how much it is over the least loss of any model, and the sums of (expected - n) * u and expected * u * u by domain. None as soon as it is over by more than ``most``."""
    b, end, u = block.times_columns(v * w), np.cumsum(block.size), block.u.copy()
    loss, over, least, g, h = 0.0, 0.0, block.least_losses(), np.zeros((domains, len(w))), np.zeros((domains, len(w)))
    step = max(1, DENSE_CELLS // max(1, domains))
    for i in range(0, len(u), step):
        s = slice(i, i + step)
        cells = slice(end[i] - block.size[i], end[s][-1])
        u[s], value, expected = solve_rows(block.size[s], block.at[cells], block.n[cells], b[s], u[s], v * w, l2)
        times = block.times[s, None]
        loss, over = loss + float((value * times[:, 0]).sum()), over + float(((value - least[s]) * times[:, 0]).sum())
        if over > most:
            return None
        g, h = g + expected.T @ (u[s] * times), h + expected.T @ (u[s] ** 2 * times)
    g -= block.by_domain(u * block.times[:, None], domains)
    return Block(block.size, block.at, block.n, block.times, u), np.concatenate([[loss, over], g.ravel(), h.ravel()])


def solve_rows(size: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, u: np.ndarray, a: np.ndarray, l2: float, steps: int = 25):
    """The rows' vectors, losses and expected counts for the domains' vectors ``a``: damped Newton steps from ``u`` on a convex problem for each row, until it no longer moves. ``b``: the rows times ``a``."""
    r = a.shape[1]
    i, j = np.triu_indices(r)
    sides = np.column_stack([np.ones(len(a)), a, a[:, i] * a[:, j]])  # one product gives the sum, the slope and the curve
    owner = np.repeat(np.arange(len(size)), size)
    u, value, expected = u.copy(), np.empty(len(u)), np.empty((len(u), len(a)))
    slope, curve = np.empty((len(u), r)), np.empty((len(u), r, r))

    def tried(rows, x):
        logits = x @ a.T
        data = (x * b[rows]).sum(1)
        if np.abs(x).max() * np.abs(a).sum(1).max() > CLIP and (logits.max() > CLIP or logits.min() < -CLIP):
            place = np.full(len(u), -1)
            place[rows] = np.arange(len(rows))
            mine = place[owner] >= 0
            row = place[owner[mine]]
            np.clip(logits, -CLIP, CLIP, out=logits)
            data = np.bincount(row, n[mine] * logits[row, at[mine]], len(rows))
        mu = np.exp(logits, out=logits)
        sums = mu @ sides
        return sums[:, 0] - data + l2 * (x * x).sum(1), mu, sums

    def keep(rows, x, val, mu, sums):
        u[rows], value[rows], expected[rows] = x, val, mu
        slope[rows] = sums[:, 1 : r + 1] - b[rows] + 2 * l2 * x
        for k, (p, q) in enumerate(zip(i, j), r + 1):
            curve[rows, p, q] = curve[rows, q, p] = sums[:, k]
        curve[rows] += 2 * l2 * np.eye(r)

    left = np.arange(len(u))
    keep(left, u, *tried(left, u))
    for _ in range(steps):
        delta = np.linalg.solve(curve[left], slope[left][..., None])[..., 0]
        gain = (slope[left] * delta).sum(1) / 2
        moves = gain > 1e-7 + 1e-14 * np.abs(value[left])
        last = ~moves & (gain > 0)  # after this step a row is some 1e-12 from its least loss
        u[left[last]] -= delta[last]
        value[left[last]] -= gain[last]
        left, delta = left[moves], delta[moves]
        if not len(left):
            break
        before = value[left]
        todo, t = np.arange(len(left)), 1.0
        for _ in range(12):
            x = u[left[todo]] - t * delta[todo]
            val, mu, sums = tried(left[todo], x)
            good = val <= before[todo] + 1e-12 + 1e-14 * np.abs(before[todo])
            if good.all():
                keep(left[todo], x, val, mu, sums)
            else:
                keep(left[todo[good]], x[good], val[good], mu[good], sums[good])
            todo, t = todo[~good], t / 2
            if not len(todo):
                break
        left = left[before - value[left] >= 1e-9]  # rows for which no step is good have gained nothing
    return u, value, expected
