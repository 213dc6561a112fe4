"""Tree models of prices: a pooled forest, forests and boosting per series.

A series model is fitted to one bounded monthly series, which travels as one row of arrays; its
trees grow level by level on columns that were sorted once, all trees of a forest, all lags of a
scan, or several series, in the same array operations.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import groupby
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary.operators.series import TASK, Series, calendar_features, lag_months, rolling_past, spread
from granary.sources.tables import kept

# Sizes of the models.
SEED = 42
PANEL_FOREST = {"numTrees": 100, "maxDepth": 30}
SERIES_FOREST = {"trees": 200, "depth": 10}
SERIES_BOOSTING = {"rounds": 200, "rate": 0.05, "depth": 5}
SCAN_BOOSTING = {"rounds": 100, "rate": 0.05, "depth": 4}
PRICE_LAGS = (1, 3, 6, 12, 24)
SCAN_LAGS = tuple(range(25))
SCAN_MIN_ROWS = 36
#: Boosting leaves are shrunk by one row's weight, and a split must gain more than this.
PENALTY, LEAST_GAIN = 1.0, 1e-6
#: Classes a feature of the pooled forest is cut into; one with at most this many values is split exactly.
MAX_BINS = 256


# --- trees -------------------------------------------------------------------------------

def grown(x: np.ndarray, order: np.ndarray, g: np.ndarray, w: np.ndarray, depth: int, penalty: float, least: float):
    """One regression tree for each of many fits: value of every row's leaf, gain by feature.

    ``x`` is (fits, features, rows) without NaN and ``order`` sorts its rows; ``g`` and ``w`` are
    (fits, rows): weighted targets and weights. Rows of weight 0 are only sent down the tree. A
    node's value is sum(g) / (sum(w) + penalty); a split lies midway between two neighbouring
    values of the node and gains the squares it explains. Of equal gains, give or take the last
    bits of the squares, the first feature and the smallest value win.
    """
    fits, features, n = x.shape
    at, cells = np.arange(fits)[:, None], x.size
    # Flat places of a fit's rows in (fits, rows) and of a column's in (fits, features, rows).
    of_fit, of_column = (np.arange(fits) * n)[:, None, None], (np.arange(fits * features) * n).reshape(fits, features, 1)
    equal = 1e-12 * np.divide(g ** 2, w, out=np.zeros_like(g), where=w > 0).sum(axis=1)
    node, still = np.zeros((fits, n), np.int16), np.ones((fits, n), bool)
    out, gains = np.zeros((fits, n)), np.zeros((fits, features))
    for level in range(depth + 1):
        k = 2 ** level
        live = still & (w > 0)
        own = (at * k + node)[live]
        gt = np.bincount(own, weights=g[live], minlength=fits * k).reshape(fits, k)
        wt = np.bincount(own, weights=w[live], minlength=fits * k).reshape(fits, k)
        value = np.divide(gt, wt + penalty, out=np.zeros((fits, k)), where=wt > 0)
        out = np.where(still, value[at, node], out)
        if level == depth:
            break
        # Rows of a node stay sorted by value: a stable sort by node keeps the order it finds.
        held = np.where(live, node, np.int16(k))
        again = np.argsort(held.ravel().take(order + of_fit), axis=2, kind="stable")
        order = order.ravel().take(again + of_column)
        row, cell = order + of_fit, order + of_column
        s, xs = held.ravel().take(row), x.ravel().take(cell)
        left_g, left_w = (np.where(live, v, 0.0).ravel().take(row).cumsum(2) for v in (g, w))
        name = s + (np.arange(fits) * (k + 1))[:, None, None]

        def of_node(v: np.ndarray) -> np.ndarray:
            return np.append(v, np.zeros((fits, 1)), axis=1).ravel().take(name)

        left_g -= of_node(gt.cumsum(1) - gt)
        left_w -= of_node(wt.cumsum(1) - wt)
        right_g, right_w = of_node(gt) - left_g, of_node(wt) - left_w
        cuts = np.zeros(x.shape, bool)
        cuts[..., :-1] = (s[..., :-1] == s[..., 1:]) & (s[..., :-1] < k) & (xs[..., :-1] < xs[..., 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g * left_g / (left_w + penalty) + right_g * right_g / (right_w + penalty)
        gain = np.where(cuts, gain, -np.inf).ravel()
        # Best cut of each (fit, feature, node): its rows are neighbours.
        first = np.ones(x.shape, bool)
        first[..., 1:] = s[..., 1:] != s[..., :-1]
        starts = np.flatnonzero(first)
        top = np.maximum.reduceat(gain, starts)
        hit = gain >= np.repeat(top - equal[starts // (features * n)], np.diff(np.append(starts, cells)))
        place = np.minimum.reduceat(np.where(hit, np.arange(cells), cells), starts)
        best, cut = np.full((fits, features, k + 1), -np.inf), np.zeros((fits, features, k + 1), np.int64)
        where = (starts // (features * n), starts // n % features, s.ravel()[starts])
        best[where], cut[where] = top, place
        best = best[:, :, :k]
        feature = (best >= best.max(axis=1, keepdims=True) - equal[:, None, None]).argmax(axis=1)
        nodes = np.arange(k)[None, :]
        gained = best[at, feature, nodes] - gt * value
        cut = cut[at, feature, nodes]
        split = gained > least
        if not split.any():
            break
        low, high = xs.ravel()[cut], xs.ravel()[np.minimum(cut + 1, cells - 1)]
        middle = (low + high) / 2
        middle = np.where(middle > low, middle, high)
        np.add.at(gains, (np.nonzero(split)[0], feature[split]), gained[split])
        right = x[at, feature[at, node], np.arange(n)[None, :]] >= middle[at, node]
        still &= split[at, node]
        node = np.where(still, 2 * node + right, 0).astype(np.int16)
    return out, gains


def sorted_rows(x: np.ndarray) -> np.ndarray:
    return np.argsort(x, axis=2, kind="stable")


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int, rate: float, depth: int):
    """Gradient boosting of the squared error for many fits: predictions of all rows, gain by feature."""
    order = sorted_rows(x)
    total = w.sum(axis=1, keepdims=True)
    predicted = np.repeat((w * y).sum(axis=1, keepdims=True) / np.maximum(total, 1), y.shape[1], axis=1)
    gains = np.zeros(x.shape[:2])
    for _ in range(rounds):
        step, gained = grown(x, order, w * (y - predicted), w, depth, PENALTY, LEAST_GAIN)
        predicted += rate * step
        gains += gained
    return predicted, gains


def bagged(x: np.ndarray, y: np.ndarray, train: np.ndarray, trees: int, depth: int, seed: int, at_once: int = 50):
    """A forest on one (features, rows) table: mean prediction of each row, mean share of gain by feature.

    Every tree draws as many training rows as there are, with replacement, and weighs all features at each split.
    """
    rows = np.flatnonzero(train)
    middle = y[rows].mean()
    least = 1e-12 * max(((y[rows] - middle) ** 2).sum(), 1e-300)
    rng, order = np.random.default_rng(seed), sorted_rows(x[None])
    total, gains = np.zeros(len(y)), np.zeros(len(x))
    for start in range(0, trees, at_once):
        size = min(at_once, trees - start)
        drawn = rows[rng.integers(0, len(rows), (size, len(rows)))]
        w = np.zeros((size, len(y)))
        np.add.at(w, (np.arange(size)[:, None], drawn), 1.0)
        many = (size, *x.shape)
        value, gained = grown(np.broadcast_to(x, many), np.broadcast_to(order, many), w * (y - middle), w, depth, 0.0, least)
        total += value.sum(axis=0)
        gains += np.divide(gained, gained.sum(axis=1, keepdims=True), out=np.zeros_like(gained), where=gained.sum(axis=1, keepdims=True) > 0).sum(axis=0)
    share = gains.sum()
    return middle + total / trees, gains / share if share else gains


# --- series ------------------------------------------------------------------------------

def series_features(df: DataFrame, s: Series, target: str = "log_price", lags: Sequence[int] = PRICE_LAGS) -> DataFrame:
    """Price lags, rolling mean and deviation of the past and calendar columns.

    ``df`` is a monthly panel; all windows share one layout by series.
    """
    out = lag_months(df, s, target, lags, "lag_price")
    out = out.withColumns({
        "roll_mean_3": rolling_past(s, target, 3, "mean"), "roll_mean_6": rolling_past(s, target, 6, "mean"),
        "roll_std_6": rolling_past(s, target, 6, "std")})
    return calendar_features(out, s.time)


#: A model takes tables of shape (series, features, rows), targets, training marks and a seed each,
#: and returns predictions of all rows and the share of the gain by feature.
Model = Callable[[np.ndarray, np.ndarray, np.ndarray, Sequence[int]], tuple[np.ndarray, np.ndarray]]
#: Series fitted together.
TOGETHER = 16


def forest_model(trees: int, depth: int) -> Model:
    def fit(x, y, train, seeds):
        each = [bagged(x[i], y[i], train[i], trees, depth, seed) for i, seed in enumerate(seeds)]
        return np.array([e[0] for e in each]), np.array([e[1] for e in each])
    return fit


def boosting_model(rounds: int, rate: float, depth: int) -> Model:
    def fit(x, y, train, seeds):
        predicted, gains = boosted(x, y, train.astype(float), rounds, rate, depth)
        total = gains.sum(axis=1, keepdims=True)
        return predicted, np.divide(gains, total, out=np.zeros_like(gains), where=total > 0)
    return fit


def series_arrays(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """One row per series: its months in order with the columns as doubles. A series is bounded by the calendar."""
    month = F.struct(F.col(s.time).cast("date").alias("_month"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return spread(df, s.keys).groupBy(*s.keys, TASK).agg(F.array_sort(F.collect_list(month)).alias("_months"))


def _tables(batch: pa.RecordBatch) -> list[tuple[pa.Array, np.ndarray]]:
    """Months and (columns, months) of each series of a batch, NaN where null."""
    months = batch.column("_months")
    flat, ends = months.flatten(), months.offsets.to_numpy() - months.offsets[0].as_py()
    days = flat.field("_month")
    values = np.array([flat.field(i + 1).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields - 1)], float)
    return [(days[a:b], values[:, a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _padded(tables: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of (columns, rows) as one (tables, columns, rows), filled up with zeros; and which rows are theirs."""
    n = max(t.shape[1] for t in tables)
    out, held = np.zeros((len(tables), len(tables[0]), n)), np.zeros((len(tables), n), bool)
    for i, t in enumerate(tables):
        out[i, :, :t.shape[1]], held[i, :t.shape[1]] = t, True
    return out, held


def _named(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def series_fits(df: DataFrame, s: Series, target: str, features: Sequence[str], model: Model, hold_out: int = 12) -> DataFrame:
    """One model per series: one row with its months (split, actual, predicted) and the weight of each feature.

    ``df`` holds one row a month. Months without a value in any of the columns are left out; the
    last ``hold_out`` of the others are the test. A series with no more months than that has no row.
    """
    keys = list(s.keys)
    schema = (f"{_named(df, keys)}, months array<struct<month date, split string, actual double, predicted double>>, "
              "weights array<double>")

    def run(batches):
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            ready = []
            for name, (days, values) in zip(names, _tables(batch)):
                whole = np.flatnonzero(~np.isnan(values).any(axis=0))
                if len(whole) > hold_out:
                    ready.append((name, days.take(pa.array(whole)).to_pylist(), values[:, whole]))
            for start in range(0, len(ready), TOGETHER):
                part = ready[start:start + TOGETHER]
                table, held = _padded([values for _, _, values in part])
                sizes = held.sum(axis=1, keepdims=True)
                train = np.arange(held.shape[1])[None] < sizes - hold_out
                seeds = [zlib.crc32("|".join(map(str, name)).encode()) ^ SEED for name, _, _ in part]
                predicted, weights = model(table[:, 1:], table[:, 0], train, seeds)
                months = [[{"month": d, "split": "train" if t else "test", "actual": a, "predicted": p}
                           for d, t, a, p in zip(days, train[i], table[i, 0].tolist(), predicted[i].tolist())]
                          for i, (_, days, _) in enumerate(part)]
                yield pa.RecordBatch.from_pydict({**{k: [name[j] for name, _, _ in part] for j, k in enumerate(keys)},
                                                  "months": months, "weights": weights.tolist()}, schema=shape)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    return series_arrays(df, s, [target, *features]).mapInArrow(run, schema)


def fitted_months(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual and predicted prices by month, from models of log prices."""
    return fits.select(*keys, F.inline("months")).withColumns({"actual": F.exp("actual"), "predicted": F.exp("predicted")})


def feature_weights(fits: DataFrame, keys: Sequence[str], features: Sequence[str], top: int) -> DataFrame:
    """The heaviest features of each series, ranked; equal weights in the order of the features."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.zip_with(names, F.col("weights"), lambda f, v: F.struct(f.alias("feature"), v.alias("importance")))
    rows = fits.select(*keys, F.posexplode(pairs).alias("at", "pair")).select(*keys, "at", "pair.*")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("importance"), "at"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).drop("at")


def drought_lag_scan(df: DataFrame, s: Series, target: str, index: str, flag: str, base: Sequence[str],
                     lags: Sequence[int] = SCAN_LAGS, hold_out: int = 12, min_rows: int = SCAN_MIN_ROWS, **params) -> DataFrame:
    """One boosted model per series and lag of the index and its drought flag: error on the last months.

    ``df`` is a monthly panel without gaps and carries the base features. All lags of a series
    are fitted together in the task that holds it. A lag with fewer than ``min_rows`` complete
    months is left out. ``best`` marks the lag of the highest R2, the shortest of equal ones.
    """
    keys, base, lags = list(s.keys), list(base), list(lags)
    params = {**SCAN_BOOSTING, **params}
    schema = f"{_named(df, keys)}, lag int, n long, n_train long, sse_train double, sst_train double, rmse double, r2 double, best boolean"

    def scanned(values: np.ndarray) -> list[tuple]:
        y, n = values[0], values.shape[1]
        x = np.repeat(np.concatenate([values[3:], np.full((2, n), np.nan)])[None], len(lags), axis=0)
        for i, k in enumerate(lags):
            x[i, -2:, k:] = values[1:3, :max(n - k, 0)]
        whole = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
        count = whole.sum(axis=1)
        kept = np.flatnonzero(count >= min_rows)
        if not len(kept):
            return []
        x, whole, count = x[kept], whole[kept], count[kept]
        train = whole & (whole.cumsum(axis=1) <= (count - hold_out)[:, None])
        clean = np.repeat(np.nan_to_num(y)[None], len(kept), axis=0)
        predicted, _ = boosted(np.nan_to_num(x), clean, train.astype(float), **params)
        rows = []
        for i, k in enumerate(kept):
            test, seen = whole[i] & ~train[i], train[i]
            actual, guess = np.exp(clean[i][test]), np.exp(predicted[i][test])
            sse, sst = ((actual - guess) ** 2).sum(), ((actual - actual.mean()) ** 2).sum()
            rows.append((lags[k], count[i], seen.sum(), ((clean[i] - predicted[i])[seen] ** 2).sum(),
                         ((clean[i] - clean[i][seen].mean())[seen] ** 2).sum(), np.sqrt(sse / len(actual)), 1 - sse / sst if sst > 0 else None))
        scored = [r for r in rows if r[-1] is not None]
        best = min(scored, key=lambda r: (-r[-1], r[0]))[0] if scored else None
        return [(*r, r[0] == best) for r in rows]

    def run(batches):
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            rows = [(*name, *row) for name, (_, values) in zip(names, _tables(batch)) for row in scanned(values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(shape), shape)], schema=shape)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    return series_arrays(df, s, [target, index, flag, *base]).mapInArrow(run, schema)


# --- pooled ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """A forest that weighs all features at every split, to be grown on any number of rows.

    Rows travel as codes between the cut points. While a node has more than ``together`` rows, its
    counts and sums per code are added up over all tasks, one round per level for all trees at once;
    the rows of a smaller node meet in one task, which grows what is left of the tree below it.
    """

    target: str
    numTrees: int = PANEL_FOREST["numTrees"]
    maxDepth: int = PANEL_FOREST["maxDepth"]
    maxBins: int = MAX_BINS
    seed: int = SEED
    together: int = 1 << 16


@dataclass
class Tops:
    """The upper parts of all trees: per tree and node the feature, the last code that goes left and the left child (0: none)."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    depth: list[np.ndarray]

    @staticmethod
    def of(trees: int) -> Tops:
        return Tops(*([np.zeros(1, np.int64) for _ in range(trees)] for _ in range(4)))

    def split(self, tree: int, node: int, feature: int, cut: int) -> int:
        """Splits a node; its left child, which the right one follows."""
        child, below = len(self.left[tree]), self.depth[tree][node] + 1
        self.feature[tree][node], self.cut[tree][node], self.left[tree][node] = feature, cut, child
        for v, new in ((self.feature, 0), (self.cut, 0), (self.left, 0), (self.depth, below)):
            v[tree] = np.append(v[tree], [new, new])
        return child


def forest(target: str, **params) -> Forest:
    return Forest(target, **params)


def walked(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without children that each row of (features, rows) codes ends in."""
    node, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    while len(rows):
        rows = rows[left[node[rows]] > 0]
        at = node[rows]
        node[rows] = left[at] + (codes[feature[at], rows] > cut[at])
    return node


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def times_drawn(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson of mean 1, by a hash of the row, the tree and the seed."""
    h = rows.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + (seed << 20))) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON[:-1], (h >> np.uint64(11)) / 2.0 ** 53, side="right")


def gains_of(gl: np.ndarray, wl: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a split explains of the squares, given sums and weights of its left side and of the node."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return gl * gl / wl + (g - gl) ** 2 / (w - wl) - g * g / w


def grown_below(codes: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: float):
    """One tree on (features, rows) codes: per node feature, cut, left child (0: none) and value.

    Columns are sorted once and stay sorted within the nodes. Of equal gains the first feature and the smallest code win.
    """
    g = w * y
    feature, cut, left = (np.zeros(1, np.int64) for _ in range(3))
    value = np.array([g.sum() / w.sum()])
    orders = [np.argsort(c, kind="stable") for c in codes]
    # Nodes of this level are numbered from 0; ``first`` is the number of the first one in the tree.
    slot, first, k = np.zeros(len(y), np.int64), 0, 1
    for _ in range(depth):
        live = np.flatnonzero(slot >= 0)
        size = np.bincount(slot[live], minlength=k)
        gt, wt = np.bincount(slot[live], g[live], k), np.bincount(slot[live], w[live], k)
        starts = np.cumsum(size) - size
        s = np.repeat(np.arange(k), size)
        same = np.append(s[1:] == s[:-1], False)
        g_of, w_of = gt[s], wt[s]
        best, chosen, code = np.full(k, least), np.zeros(k, np.int64), np.zeros(k, np.int64)
        kind = np.uint16 if k < 2 ** 16 else np.int64
        for f, column in enumerate(codes):
            o = orders[f]
            at = slot[o]
            o, at = o[at >= 0], at[at >= 0]
            o = orders[f] = o[np.argsort(at.astype(kind), kind="stable")]
            c = column[o]
            gl, wl = g[o].cumsum(), w[o].cumsum()
            gl -= np.repeat(np.append(0.0, gl)[starts], size)
            wl -= np.repeat(np.append(0.0, wl)[starts], size)
            cuts = same & np.append(c[1:] != c[:-1], False)
            place = np.flatnonzero(cuts)
            if not len(place):
                continue
            gain = gains_of(gl[place], wl[place], g_of[place], w_of[place])
            own = s[place]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top = np.maximum.reduceat(gain, begin)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(begin, len(own)))))[::-1]
            at_top = np.zeros(k, np.int64)
            at_top[own[hit]] = place[hit]
            nodes = own[begin]
            better = top > best[nodes] * (1 + 1e-12)
            nodes = nodes[better]
            best[nodes], chosen[nodes], code[nodes] = top[better], f, c[at_top[nodes]]
        split = np.flatnonzero(best > least)
        if not len(split):
            break
        rank = np.full(k, -1)
        rank[split] = np.arange(len(split))
        new = len(left)
        feature[first + split], cut[first + split], left[first + split] = chosen[split], code[split], new + 2 * np.arange(len(split))
        own = slot[live]
        right = codes[chosen[own], live] > code[own]
        slot[live] = np.where(rank[own] >= 0, 2 * rank[own] + right, -1)
        first, k = new, 2 * len(split)
        live = live[slot[live] >= 0]
        gt, wt = np.bincount(slot[live], g[live], k), np.bincount(slot[live], w[live], k)
        value = np.append(value, gt / wt)
        feature, cut, left = (np.append(v, np.zeros(k, np.int64)) for v in (feature, cut, left))
    return feature, cut, left, value


def cut_points(df: DataFrame, features: Sequence[str], most: int) -> list[list[float]]:
    """Ascending cut points per feature: between all its values if these are few, at equal shares of the rows otherwise."""
    sizes = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    few = [f for f in features if sizes[f] <= 2 * most]
    shares = [i / most for i in range(1, most)]
    found = df.agg(*[(F.array_sort(F.collect_set(f)) if f in few else F.percentile_approx(f, shares, 20 * most)).alias(f) for f in features]).first()

    def middles(values: list[float]) -> list[float]:
        values = sorted(set(values))
        if len(values) > most:
            # More values than bins after all: the middles next to equal shares of the values.
            values = [values[i * len(values) // most] for i in range(most)]
        return [(a + b) / 2 for a, b in zip(values, values[1:])]

    return [middles(found[f]) if f in few else sorted(set(found[f])) for f in features]


def coded(df: DataFrame, features: Sequence[str], target: str, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """(_row, _draw, train, y, codes): the codes of all features of a row in one value of two bytes each."""

    def run(batches):
        for batch in batches:
            x = [batch.column(f"_f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]
            codes = np.stack([np.searchsorted(np.asarray(c), v, side="left").astype("<u2") for c, v in zip(cuts, x)], axis=1)
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(features)), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_draw", "train", "y")), held.cast(pa.binary())],
                                             names=["_row", "_draw", "train", "y", "codes"])

    source = df.select("_row", "_draw", (F.col("split") == "train").alias("train"), F.col(target).cast("double").alias("y"),
                       *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    return source.mapInArrow(run, "_row bigint, _draw bigint, train boolean, y double, codes binary")


def _codes(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, features).T


def grown_tops(rows: DataFrame, model: Forest, features: int, middle: float, least: float) -> Tops:
    """The splits of all nodes with more than ``together`` drawn rows."""
    tops, bins = Tops.of(model.numTrees), model.maxBins
    open_ = {(t, 0) for t in range(model.numTrees)}
    train = rows.filter("train").drop("_row", "train")
    if train.limit(model.together + 1).count() <= model.together:
        return tops
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while open_:
        state = rows.sparkSession.sparkContext.broadcast((tops, open_))

        def counted(batches):
            tops, open_ = state.value
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                codes, y = _codes(batch.column("codes"), features), batch.column("y").to_numpy() - middle
                draws = batch.column("_draw").to_numpy()
                cell = codes + (np.arange(features) * bins)[:, None]
                for t in sorted({t for t, _ in open_}):
                    drawn = np.flatnonzero(w := times_drawn(draws, t, model.seed))
                    node = walked(codes[:, drawn], tops.feature[t], tops.cut[t], tops.left[t])
                    for k in np.unique(node).tolist():
                        if (t, k) in open_:
                            own = drawn[node == k]
                            at = cell[:, own].ravel()
                            held = sums.setdefault((t, k), np.zeros((3, features * bins)))
                            for i, v in enumerate((np.ones(len(own)), w[own], w[own] * y[own])):
                                held[i] += np.bincount(at, np.tile(v, features), features * bins)
            for (t, k), held in sums.items():
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([k], pa.int32()), "sums": [held.tobytes()]})

        def chosen(batches):
            for name, many in groupby(((batch.column("tree")[i].as_py(), batch.column("node")[i].as_py(), batch.column("sums")[i].as_py())
                                       for batch in batches for i in range(batch.num_rows)), key=lambda r: r[:2]):
                total = np.zeros((3, features, bins))
                for *_, held in many:
                    total += np.frombuffer(held).reshape(total.shape)
                n, w, g = total.cumsum(axis=2)
                gain = gains_of(g[:, :-1], w[:, :-1], g[:, -1:], w[:, -1:])
                # A cut below or above all rows is none, and one between codes without rows is the one before.
                gain = np.where((n[:, :-1] > 0) & (n[:, :-1] < n[:, -1:]) & (total[0, :, :-1] > 0), gain, -np.inf)
                f, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, c] > least:
                    yield pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int32()) for k, v in zip(("tree", "node", "feature", "cut"), (*name, f, c))},
                                                      "n_left": [int(n[f, c])], "n_right": [int(n[f, -1] - n[f, c])]})

        parts = train.mapInArrow(counted, "tree int, node int, sums binary").repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node")
        found = parts.mapInArrow(chosen, "tree int, node int, feature int, cut int, n_left bigint, n_right bigint").collect()
        open_ = set()
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            child = tops.split(r["tree"], r["node"], r["feature"], r["cut"])
            if tops.depth[r["tree"]][child] < model.maxDepth:
                open_ |= {(r["tree"], child + i) for i, n in enumerate((r["n_left"], r["n_right"])) if n > model.together}
        state.unpersist()
    return tops


def predictions(rows: DataFrame, model: Forest, features: int, tops: Tops, middle: float, least: float) -> DataFrame:
    """(_row, predicted): each tree is grown below its tops, node by node, by the task that holds the node's rows."""
    state = rows.sparkSession.sparkContext.broadcast(tops)
    width = 2 * features

    def dealt(batches):
        tops = state.value
        for batch in batches:
            codes, ids, y = _codes(batch.column("codes"), features), batch.column("_row").to_numpy(), batch.column("y").to_numpy() - middle
            train, draws = batch.column("train").to_numpy(zero_copy_only=False), batch.column("_draw").to_numpy()
            for t in range(model.numTrees):
                w = np.where(train, times_drawn(draws, t, model.seed), 0)
                node = walked(codes, tops.feature[t], tops.cut[t], tops.left[t])
                # Drawn rows first: they grow the tree before any row is sent down.
                order = np.lexsort((w == 0, node))
                name = 2 * node[order] + (w[order] == 0)
                ends = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name))
                out = []
                for a, b in zip(np.append(0, ends[:-1]), ends):
                    own = order[a:b]
                    out.append((t, int(name[a]) // 2, int(name[a]) % 2, ids[own].tobytes(), codes.T[own].tobytes(),
                                y[own].tobytes() if w[own[0]] else b"", w[own].astype(np.uint8).tobytes() if w[own[0]] else b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), packed)], schema=packed)

    def fitted(batches):
        records = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for (t, k), many in groupby(records, key=lambda r: (r["tree"], r["node"])):
            grows, tree = [], None

            def grow():
                codes = np.concatenate([np.frombuffer(r["codes"], "<u2").reshape(-1, features) for r in grows]).T
                y, w = (np.concatenate([np.frombuffer(r[c], kind) for r in grows]) for c, kind in (("y", float), ("w", np.uint8)))
                return grown_below(np.ascontiguousarray(codes), y, w.astype(float), model.maxDepth - int(state.value.depth[t][k]), least)

            def sent(r):
                codes = np.frombuffer(r["codes"], "<u2").reshape(-1, features).T
                feature, cut, left, value = tree
                return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(value[walked(codes, feature, cut, left)])], names=["_row", "value"])

            for r in many:
                if tree is None and not r["rest"]:
                    grows.append(r)
                    continue
                tree = tree or grow()
                yield sent(r)
            tree = tree or grow()
            for r in grows:
                yield sent(r)

    schema = "tree int, node int, rest int, ids binary, codes binary, y binary, w binary"
    packed = to_arrow_schema(StructType.fromDDL(schema))
    nodes = sum(int((left == 0).sum()) for left in tops.left)
    # A task gets about one node, so that it holds no more than that node's rows.
    blocks = rows.mapInArrow(dealt, schema).repartition(min(nodes, 10_000), "tree", "node").sortWithinPartitions("tree", "node", "rest")
    values = blocks.mapInArrow(fitted, "_row bigint, value double")
    return values.groupBy("_row").agg((F.sum("value") / model.numTrees + middle).alias("predicted"))


def fit_and_score(df: DataFrame, model: Forest, features: Sequence[str], target: str, keep: Sequence[str] = ()):
    """Fit on the rows marked ``train`` and predict all.

    Returns the predictions (``actual``, ``predicted``) and the upper parts of the trees. The rows
    are written once, since they are read several times and the panel behind them is a long plan.
    Rows are drawn by a hash of their ``keep`` columns (all columns, if there are none), so that
    reruns agree.
    """
    features = list(features)
    rows = df.dropna(subset=[target, *features]).select(*dict.fromkeys([*keep, "split", target, *features]))
    rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_draw": F.xxhash64(*(keep or rows.columns))})
    rows = kept(rows, "forest-rows")
    train = rows.filter(F.col("split") == "train")
    total = train.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("spread")).first()
    if not total["n"]:
        raise ValueError("no row is marked train")
    middle, least = total["mean"], 1e-12 * max(total["n"] * total["spread"], 1e-300)
    codes = kept(coded(rows, features, target, cut_points(train, features, model.maxBins)), "forest-codes")
    tops = grown_tops(codes, model, len(features), middle, least)
    values = predictions(codes, model, len(features), tops, middle, least)
    scored = rows.join(values, "_row").select(*keep, "split", F.col(target).alias("actual"), "predicted")
    return scored, tops
