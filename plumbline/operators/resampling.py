"""Bootstrap intervals of statistics with mergeable state, resampling whole clusters.

A statistic says how its state begins, takes in rows with their weights, merges with another state and ends as
values; every state holds all draws at once. A task weighs a block of rows against all draws by one matrix of
hashed Poisson(1) weights and keeps one state per group, so nothing is exploded: what is shuffled is a state per
group and task. States are merged in two steps, the first one spread over ``FAN_IN`` keys, so that one large group
does not gather all tasks' states in one task at once; they are read as a stream.

The weight of a cluster in a draw depends on the seed, the cluster and the draw only: any partitioning, order and
repetition of the work gives the same draws, and SQL can repeat them.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_int

#: Rows weighed at once (16 MB of weights for 2,000 draws).
BLOCK = 1024
#: First-step keys of a group.
FAN_IN = 32
#: Bytes of states a task keeps before it sends them on.
STATES = 64 << 20

#: Draws that one row of counts by score carries.
SPAN = 125

# The odd step between draws and the multiplier of the 32-bit mixer.
STEP, MULTIPLIER = 2654435769, 73244475


def poisson_thresholds(terms: int = 13) -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to 32 bits."""
    out, total = [], 0.0
    for k in range(terms):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * 2**32))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(MULTIPLIER)
    return x ^ (x >> np.uint32(16))


def weights(first: np.ndarray, second: np.ndarray, draws: int) -> np.ndarray:
    """(rows, draws + 1) weights of clusters with these two 32-bit hashes; column 0 is 1: the rows as they are."""
    x = first[:, None] + np.arange(1, draws + 1, dtype=np.uint32) * np.uint32(STEP)
    x = _mixed(_mixed(x) ^ second[:, None])
    w = np.zeros(x.shape, np.uint8)
    for cut in poisson_thresholds():
        if cut < 2**32:
            w += x >= np.uint32(cut)
    return np.hstack([np.ones((len(x), 1)), w.astype(np.float64)])


def sql_weights(rows: str, cluster: str, seed: str, draws: int) -> str:
    """SQL: the rows of a table with ``b`` (draw) and ``wt`` (weight; 1 in draw 0), for checking."""
    step = f"SELECT * EXCLUDE x, xor(x, x // 65536) * {MULTIPLIER} % 4294967296 AS x FROM"
    end = "SELECT * EXCLUDE x, xor(x, x // 65536) AS x FROM"
    start = f"SELECT r.*, b, h[['{seed}+:' || {cluster}]] AS h2, (h[['{seed}:' || {cluster}]] + b * {STEP}) % 4294967296 AS x FROM {rows} r, range(0, {draws + 1}) d(b)"
    first = f"SELECT * EXCLUDE x, xor(x, h2) AS x FROM ({end} ({step} ({step} ({start}))))"
    mixed = f"{end} ({step} ({step} ({first})))"
    total = " + ".join(f"CASE WHEN x >= {t} THEN 1 ELSE 0 END" for t in poisson_thresholds())
    return f"SELECT * EXCLUDE (x, h2), CASE WHEN b = 0 THEN 1 ELSE {total} END AS wt FROM ({mixed})"


class Statistic:
    """What is resampled. ``x`` has a row per input row and a column per value; ``w`` a column per draw."""

    def start(self, draws: int):
        """The state of no rows."""
        raise NotImplementedError

    def add(self, state, x: np.ndarray, w: np.ndarray):
        """The state after some rows."""
        raise NotImplementedError

    def merge(self, a, b):
        """The state of the rows of both."""
        raise NotImplementedError

    def end(self, state) -> dict[str, tuple[np.ndarray, float]]:
        """By name: the value of every draw (NaN: undefined) and how many rows it rests on."""
        raise NotImplementedError


class Means(Statistic):
    """Means by name. The columns are each name's sum and count, in turn."""

    def __init__(self, names: list[str]):
        self.names = names

    def start(self, draws: int) -> np.ndarray:
        return np.zeros((2 * len(self.names), draws))

    def add(self, state: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return state + x.T @ w

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def end(self, state: np.ndarray) -> dict[str, tuple[np.ndarray, float]]:
        n = state[1::2]
        values = np.divide(state[::2], n, out=np.full(n.shape, np.nan), where=n > 0)
        return {name: (values[i], n[i, 0]) for i, name in enumerate(self.names)}


class Spread(Statistic):
    """Largest less smallest value of the first column: no ratio of sums."""

    def start(self, draws: int) -> np.ndarray:
        return np.vstack([np.full(draws, -np.inf), np.full(draws, np.inf), np.zeros(draws)])

    def add(self, state: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x[:, 0])
        v, drawn = x[known, :1], w[known] > 0
        if not len(v):
            return state
        return self.merge(state, np.vstack([np.where(drawn, v, -np.inf).max(0), np.where(drawn, v, np.inf).min(0), drawn.sum(0)]))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.vstack([np.maximum(a[0], b[0]), np.minimum(a[1], b[1]), a[2] + b[2]])

    def end(self, state: np.ndarray) -> dict[str, tuple[np.ndarray, float]]:
        return {"spread": (np.where(state[2] > 0, state[0] - state[1], np.nan), state[2, 0])}


def _group_codes(columns: list[pa.Array], n: int) -> np.ndarray:
    codes = np.zeros(n, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        codes = codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _key(row: pa.RecordBatch) -> tuple:
    return tuple("NaN" if v != v else v for v in (c[0].as_py() for c in row.columns))


class _Kept:
    """States by group, with one row of the group's columns each."""

    def __init__(self, merge):
        self.merge, self.states, self.bytes = merge, {}, 0

    def put(self, row: pa.RecordBatch, state) -> None:
        key = _key(row)
        if key in self.states:
            state = self.merge(self.states[key][1], state)
        else:
            self.bytes += len(pickle.dumps(state))
        self.states[key] = row, state


def _rows(rows: list[pa.RecordBatch], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    if not rows:
        return pa.record_batch(list(extra.values()), names=list(extra))
    table = pa.Table.from_batches(rows)
    columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    return pa.record_batch([*columns, *extra.values()], names=[*table.column_names, *extra])


def bootstrap(df: DataFrame, groups: list[str], cluster: str, values: list[str], statistic: Statistic, seed="0", n_resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(groups, measure, point, lo, hi, n, n_draws): percentile intervals of a statistic of ``values``, one row per
    group and name of the statistic. Draws in which a value is undefined are left out.

    Rows of one cluster should be put together first; they may be apart, as they get the same weights. Missing
    values reach the statistic as NaN. Groups without rows are not returned, and neither is anything of an empty
    table."""
    draws, g = n_resamples + 1, len(groups)
    # A group column of its own keeps ungrouped statistics apart from nothing.
    own = [f"_g{i}" for i in range(g)]
    src = df.select(*[F.col(c).alias(o) for c, o in zip(groups, own)], F.lit(0).alias("_g"), seeded_int(seed, F.col(cluster)).alias("_h1"), seeded_int(f"{seed}+", F.col(cluster)).alias("_h2"),
                    *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    keys = [*own, "_g"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema)

    def sent(kept: _Kept, part: int) -> pa.RecordBatch:
        rows, states = zip(*kept.states.values())
        out = _rows(list(rows), {"_part": pa.array([part] * len(rows), pa.int32()), "_state": pa.array([pickle.dumps(s) for s in states], pa.binary())})
        kept.states.clear()
        kept.bytes = 0
        return out

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, part = _Kept(statistic.merge), TaskContext.get().partitionId() % FAN_IN
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = _group_codes(batch.columns[:g], batch.num_rows)
            order = np.argsort(codes, kind="stable")
            batch, codes = batch.take(pa.array(order)), codes[order]
            first, second = (batch.column(g + 1 + i).to_numpy(zero_copy_only=False).astype(np.uint32) for i in (0, 1))
            x = np.column_stack([batch.column(g + 3 + i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(values))])
            for lo in range(0, len(codes), BLOCK):
                hi = min(lo + BLOCK, len(codes))
                w = weights(first[lo:hi], second[lo:hi], n_resamples)
                cuts = [0, *(np.flatnonzero(np.diff(codes[lo:hi])) + 1).tolist(), hi - lo]
                for a, b in zip(cuts, cuts[1:]):
                    kept.put(batch.slice(lo + a, 1).select(range(g + 1)), statistic.add(statistic.start(draws), x[lo + a : lo + b], w[a:b]))
                if kept.bytes > STATES:
                    yield sent(kept, part)
        if kept.states:
            yield sent(kept, part)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, object]]:
        """One state per group of rows sorted by group."""
        open_, last = None, None
        for batch in batches:
            states = batch.column(g + 2)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).select(range(g + 1))
                key, state = _key(row), pickle.loads(states[i].as_py())
                if open_ is not None and key == last:
                    open_ = row, statistic.merge(open_[1], state)
                else:
                    if open_ is not None:
                        yield open_
                    open_, last = (row, state), key
        if open_ is not None:
            yield open_

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, state in merged(batches):
            yield _rows([row], {"_part": pa.array([0], pa.int32()), "_state": pa.array([pickle.dumps(state)], pa.binary())})

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, state in merged(batches):
            out = []
            for name, (v, n) in statistic.end(state).items():
                good = v[1:][~np.isnan(v[1:])]
                lo, hi = np.quantile(good, [alpha / 2, 1 - alpha / 2]) if len(good) else (None, None)
                out.append((name, None if np.isnan(v[0]) else v[0], lo, hi, int(n), len(good)))
            name, point, lo, hi, n, k = zip(*out)
            yield _rows([row] * len(out), {"measure": pa.array(name, pa.string()), "point": pa.array(point, pa.float64()), "lo": pa.array(lo, pa.float64()), "hi": pa.array(hi, pa.float64()),
                                           "n": pa.array(n, pa.int64()), "n_draws": pa.array(k, pa.int32())})

    states = src.mapInArrow(taken, f"{kind}, _part int, _state binary")
    states = states.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").mapInArrow(halfway, f"{kind}, _part int, _state binary")
    out = states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(ended, f"{kind}, measure string, point double, lo double, hi double, n long, n_draws int")
    return out.select(*[F.col(o).alias(c) for c, o in zip(groups, own)], "measure", "point", "lo", "hi", "n", "n_draws")


def means(df: DataFrame, groups: list[str], cluster: str, named: dict[str, Column], **kw) -> DataFrame:
    """Intervals of several means at once, all under the same draws; null values are outside a mean's denominator.
    Rows are put together to a sum and a count per cluster before anything is resampled."""
    v = df.select(*groups, cluster, *[c.cast("double").alias(f"_m{i}") for i, c in enumerate(named.values())])
    columns = [x for i in range(len(named)) for x in (f"_s{i}", f"_n{i}")]
    sums = [x for i in range(len(named)) for x in (F.coalesce(F.sum(f"_m{i}"), F.lit(0.0)).alias(f"_s{i}"), F.count(f"_m{i}").alias(f"_n{i}"))]
    return bootstrap(v.groupBy(*groups, cluster).agg(*sums), groups, cluster, columns, Means(list(named)), **kw)


def hashed_weights(seed: str, clusters: list[str | None], draws: int) -> np.ndarray:
    """(clusters, draws) Poisson(1) weights from md5 of seed, draw and cluster, each hashed once."""
    begin, out = [f"{seed}:{b}" for b in range(1, draws + 1)], np.zeros((len(clusters), draws), np.uint8)
    first = [f"{x}:".encode() for x in begin], [x.encode() for x in begin]
    for i, cluster in enumerate(clusters):
        if cluster is None:
            digests = [hashlib.md5(x).digest() for x in first[1]]
        else:
            end = cluster.encode()
            digests = [hashlib.md5(x + end).digest() for x in first[0]]
        u = np.frombuffer(b"".join(digests), ">u4")[::4]
        for cut in poisson_thresholds():
            if cut < 2**32:
                out[i] += u >= cut
    return out


def auroc_draws(per: DataFrame, groups: list[str], cluster: str, seed, n_resamples: int) -> DataFrame:
    """(groups, draw, auroc) from (groups, cluster, score, pos, neg): every draw weighs the clusters' counts anew. Draws
    without a positive or a negative row have null.

    A cluster's rows meet in one task, which hashes its draws once and keeps, for every score, the weighted counts of all
    draws; they are sent on ``SPAN`` draws a row. Scores are then read in order, ranges of them at once: positives of a
    range win over the negatives below it, half of those tied."""
    own, g = [f"_g{i}" for i in range(len(groups))], len(groups)
    src = per.select(*[F.col(c).alias(o) for c, o in zip(groups, own)], F.col("score").alias("_s"), F.col(cluster).cast("string").alias("_c"), F.col("pos").cast("double").alias("_p"), F.col("neg").cast("double").alias("_n"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*own, "_s").schema) + ", _d int, _state binary"

    def sent(kept: _Kept) -> Iterator[pa.RecordBatch]:
        for row, state in kept.states.values():
            parts = [np.ascontiguousarray(state[:, d : d + SPAN]).tobytes() for d in range(0, n_resamples, SPAN)]
            yield _rows([row] * len(parts), {"_d": pa.array(range(len(parts)), pa.int32()), "_state": pa.array(parts, pa.binary())})
        kept.states.clear()
        kept.bytes = 0

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(np.add)
        for batch in batches:
            codes = _group_codes(batch.columns[: g + 1], batch.num_rows)
            order = np.argsort(codes, kind="stable")
            batch, codes = batch.take(pa.array(order)), codes[order]
            names = batch.column(g + 1).dictionary_encode(null_encoding="encode")
            w, of = hashed_weights(str(seed), names.dictionary.to_pylist(), n_resamples), names.indices.to_numpy(zero_copy_only=False)
            counts = np.stack([batch.column(g + 2 + i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                for lo in range(a, b, BLOCK):
                    hi = min(lo + BLOCK, b)
                    kept.put(batch.slice(a, 1).select(range(g + 1)), counts[:, lo:hi] @ w[of[lo:hi]].astype(np.float64))
                if kept.bytes > STATES:
                    yield from sent(kept)
        yield from sent(kept)

    def folded(columns: list[int], merge, begin):
        """One row per value of these columns, of rows sorted by them and the score."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, row, state = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    this = batch.slice(i, 1)
                    key, new = _key(this.select(columns)), begin(np.frombuffer(this.column(g + 2)[0].as_py()))
                    if row is not None and key == last:
                        state = merge(state, new)
                    else:
                        if row is not None:
                            yield told(row, state)
                        last, row, state = key, this, new
            if row is not None:
                yield told(row, state)

        def told(row: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
            if len(state) == 2:  # all counts of a score: ties are half won
                state = np.vstack([state, state[0] * state[1] / 2])
            return _rows([row.select(range(g + 2))], {"_state": pa.array([state.tobytes()], pa.binary())})

        return work

    def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.vstack([a[0] + b[0], a[1] + b[1], a[2] + b[2] + b[0] * a[1]])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in folded([*range(g), g + 1], above, lambda x: x.reshape(3, -1))(batches):
            p, n, u = np.frombuffer(batch.column(g + 2)[0].as_py()).reshape(3, -1)
            value = np.divide(u, p * n, out=np.full(len(u), np.nan), where=(p > 0) & (n > 0))
            yield _rows([batch.select(range(g))] * len(u) if g else [], {"draw": pa.array(np.arange(1, len(u) + 1) + batch.column(g + 1)[0].as_py() * SPAN, pa.int32()), "auroc": pa.array(value, mask=np.isnan(value))})

    states = src.repartition("_c").sortWithinPartitions("_c").mapInArrow(taken, kind)
    scores = states.repartition(*own, "_s", "_d").sortWithinPartitions(*own, "_s", "_d").mapInArrow(folded(list(range(g + 2)), np.add, lambda x: x.reshape(2, -1)), kind)
    ranges = scores.repartitionByRange(*own, "_d", "_s").sortWithinPartitions(*own, "_d", "_s").mapInArrow(folded([*range(g), g + 1], above, lambda x: x.reshape(3, -1)), kind)
    out = ranges.repartition(*own, "_d").sortWithinPartitions(*own, "_d", "_s").mapInArrow(ended, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*own).schema), "draw int", "auroc double"]))
    return out.select(*[F.col(o).alias(c) for c, o in zip(groups, own)], "draw", "auroc")
