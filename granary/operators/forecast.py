"""Seasonal forecasts with outside factors, for many series at once.

Spark prepares the series (log, gaps, lags, splits); a group is one monthly series, so the
numeric part works on arrays as long as the calendar. The estimator is autoregression with
outside factors by conditional least squares; moving-average terms enter through the
residuals of a long autoregression (Hannan and Rissanen 1982).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.numeric import log_of
from granary.operators.panel import best_row
from granary.operators.series import TASK, Series, as_monthly, interpolate, split_tail, spread
from granary.operators.summary import fit_metrics

#: Held-out months, orders and the shortest series.
HOLD_OUT = 12
MIN_MONTHS = 24
SUBSET_MIN_ROWS, SUBSET_MIN_TEST = 50, 6
_Z95 = 1.959963984540054


@dataclass(frozen=True)
class Order:
    p: int = 1
    d: int = 1
    q: int = 1
    sp: int = 1
    sd: int = 0
    sq: int = 0
    season: int = 12

    def lags(self) -> tuple[list[int], list[int]]:
        seasonal = lambda n: [self.season * k for k in range(1, n + 1)]
        return sorted({*range(1, self.p + 1), *seasonal(self.sp)}), sorted({*range(1, self.q + 1), *seasonal(self.sq)})

    def filters(self) -> list[int]:
        """Months back of each difference."""
        return [1] * self.d + [self.season] * self.sd

    def label(self) -> str:
        return f"({self.p},{self.d},{self.q})x({self.sp},{self.sd},{self.sq},{self.season})"


SUBSET_ORDER = Order(1, 0, 0, 0, 0, 0)


def order_grid(season: int = 12) -> list[Order]:
    return [Order(*v, season) for v in product((0, 1), repeat=6)]


def _lagged(v: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([v[start - k: len(v) - k] for k in lags]) if lags else np.empty((len(v) - start, 0))


#: A column whose part beyond the others is a smaller share of its square than this is not swept in.
COLLINEAR = 1e-6


class Sweep:
    """Least squares of one target on any columns of one table, by sweeping its Gram matrix.

    The matrix is formed once, of columns scaled to length one (centred where there is a
    constant). From one fit to the next only the columns that differ are swept in or out, so
    subsets in Gray-code order cost one sweep each. Nearly collinear columns are solved by
    orthogonal decomposition instead, which gives the shortest coefficients.
    """

    def __init__(self, columns: np.ndarray, target: np.ndarray, constant: bool):
        self.columns, self.target, self.constant = columns, target, constant
        z = np.column_stack([columns, target])
        self.means = z.mean(axis=0) if constant else np.zeros(z.shape[1])
        flat = 1e-12 * np.linalg.norm(z, axis=0)
        z = z - self.means
        self.scale = np.linalg.norm(z, axis=0)
        self.scale[self.scale <= flat] = 1.0
        z = z / self.scale
        self.gram = z.T @ z
        self.inside: set[int] = set()

    def _turn(self, k: int) -> bool:
        """Sweeps column ``k`` in, or out again; False where it is collinear with those inside."""
        a, pivot = self.gram, self.gram[k, k]
        if k not in self.inside and pivot < COLLINEAR:
            return False
        row, column = a[k] / pivot, a[:, k].copy()
        a -= np.outer(column, row)
        a[k], a[:, k] = row, (column if k in self.inside else -column) / pivot * (-1 if k in self.inside else 1)
        a[k, k] = 1 / pivot
        self.inside ^= {k}
        return True

    def fit(self, wanted: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (a constant first) and residuals."""
        wanted = list(wanted)
        design = self.columns[:, wanted]
        if self.constant:
            design = np.hstack([np.ones((len(design), 1)), design])
        if all([self._turn(k) for k in sorted(self.inside ^ set(wanted), key=lambda k: k in wanted)]):
            coef = self.gram[wanted, -1] * self.scale[-1] / self.scale[wanted]
            if self.constant:
                coef = np.concatenate([[self.means[-1] - coef @ self.means[wanted]], coef])
        else:
            coef = np.linalg.lstsq(design, self.target, rcond=None)[0]
        return coef, self.target - design @ coef


class Sample:
    """Training months of one series with the factors of the months to come; keeps what its models share."""

    def __init__(self, y: np.ndarray, x: np.ndarray, x_next: np.ndarray):
        self.y, self.x, self.x_next = y, x, x_next
        self.kept: dict[tuple, object] = {}

    def once(self, key: tuple, make):
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def differenced(self, o: Order):
        """Series and factors after the differences of an order, and what undoes them; None if too short."""
        def make():
            w, u, heads = self.y, np.vstack([self.x, self.x_next]), []
            for k in o.filters():
                if len(w) <= k:
                    return None
                heads.append(w[-k:])
                w, u = w[k:] - w[:-k], u[k:] - u[:-k]
            return w, u[: len(w)], u[len(w):], heads
        return self.once(("w", o.d, o.sd), make)

    def shocks(self, o: Order, exog: Sequence[int], w: np.ndarray, u: np.ndarray):
        """Residuals of a long autoregression and the months it needs; None if too short."""
        def make():
            skip = max(1, min(10, len(w) // 5))
            rows = len(w) - skip
            if rows <= skip + len(exog) + 1:
                return None
            e = np.zeros(len(w))
            long_ar = np.hstack([np.ones((rows, 1)), _lagged(w, range(1, skip + 1), skip), u[skip:, exog]])
            e[skip:] = w[skip:] - long_ar @ np.linalg.lstsq(long_ar, w[skip:], rcond=None)[0]
            return e, skip
        return self.once(("e", o.d, o.sd, tuple(exog)), make)

    def sweep(self, o: Order, start: int, exog: Sequence[int], w: np.ndarray, u: np.ndarray, e: np.ndarray, skip: int):
        """The table of every lag an order with this start may use, to be swept; and the place of each."""
        def make():
            ar = [k for k in sorted({1, o.season}) if k <= start]
            ma = [k for k in sorted({1, o.season}) if skip and skip + k <= start]
            table = np.hstack([_lagged(w, ar, start), _lagged(e, ma, start), u[start:]])
            places = {("ar", k): i for i, k in enumerate(ar)} | {("ma", k): len(ar) + i for i, k in enumerate(ma)}
            return Sweep(table, w[start:], not o.filters()), places, len(ar) + len(ma)
        return self.once(("s", o.d, o.sd, start, skip, tuple(exog) if skip else ()), make)


def _project(sample: Sample, o: Order, exog: Sequence[int]):
    """Point forecast, its standard error and AIC; None where the series is too short."""
    ready = sample.differenced(o)
    if ready is None:
        return None
    w, u, u_next, heads = ready
    filters, (ar, ma) = o.filters(), o.lags()
    const = 0 if filters else 1
    e, skip = np.zeros(len(w)), 0
    if ma:
        ready = sample.shocks(o, exog, w, u)
        if ready is None:
            return None
        e, skip = ready
    start = max(max(ar, default=0), skip + max(ma, default=0))
    n = len(w) - start
    n_params = const + len(ar) + len(ma) + len(exog)
    if n <= n_params + 1:
        return None
    sweep, places, first = sample.sweep(o, start, exog, w, u, e, skip)
    coef, err = sweep.fit([*(places["ar", k] for k in ar), *(places["ma", k] for k in ma), *(first + i for i in exog)])
    sse = float(err @ err)
    if not np.isfinite(sse) or sse <= 0:
        return None
    phi, theta = coef[const: const + len(ar)], coef[const + len(ar): const + len(ar) + len(ma)]
    effect = u_next[:, exog] @ coef[const + len(ar) + len(ma):] + (coef[0] if const else 0.0)
    h = len(u_next)
    shocks = np.concatenate([e[:start], err, np.zeros(h)])
    path = np.concatenate([w, np.zeros(h)])
    impulse = np.zeros(h)
    for t in range(h):
        i = len(w) + t
        path[i] = effect[t] + sum(c * path[i - k] for c, k in zip(phi, ar)) + sum(c * shocks[i - k] for c, k in zip(theta, ma))
        impulse[t] = (t == 0) + sum(c * impulse[t - k] for c, k in zip(phi, ar) if k <= t) \
            + sum(c for c, k in zip(theta, ma) if k == t)
    step = path[len(w):]
    for k, head in zip(reversed(filters), reversed(heads)):
        full, wave = np.concatenate([head, np.zeros(h)]), np.zeros(h)
        for t in range(h):
            full[k + t] = full[t] + step[t]
            wave[t] = impulse[t] + (wave[t - k] if t >= k else 0.0)
        step, impulse = full[k:], wave
    sigma2 = sse / (n - n_params)
    llf = -n / 2 * (np.log(2 * np.pi * sse / n) + 1)
    return step, np.sqrt(sigma2 * np.cumsum(impulse ** 2)), -2 * llf + 2 * (n_params + 1), n


def gray_rank(members: Sequence[int]) -> int:
    """Place of a subset in Gray-code order, in which neighbours differ in one member."""
    mask, rank = sum(1 << i for i in members), 0
    while mask:
        rank ^= mask
        mask >>= 1
    return rank


def prepare(df: DataFrame, s: Series, price: str, eps: float = 1e-6) -> DataFrame:
    """Monthly grid, interpolated price and its log."""
    return interpolate(as_monthly(df, s), s, price).withColumn("log_price", log_of(F.col(price), eps))


_FORECAST = ("model_order string, features string, month date, actual_log double, predicted_log double, "
             "se_log double, aic double, n_train int")

Spec = tuple[Order, tuple[str, ...]]


@dataclass(frozen=True)
class Sizes:
    """Fewest complete rows of a series, fewest and wanted test rows."""

    rows: int = MIN_MONTHS
    test_rows: int = 1
    hold_out: int = HOLD_OUT


def _forecast_groups(df: DataFrame, s: Series, y: str, specs: Sequence[Spec], sizes: Sizes, split: str | None) -> DataFrame:
    """One row per series, spec and test month.

    The specs are tried inside the task of a series: its few hundred rows are shuffled
    once, not once per spec. Without a ``split`` column the last complete months of each
    spec are held out.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = list(s.keys)
    used = sorted({x for _, xs in specs for x in xs})
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _FORECAST

    at_of = {x: i for i, x in enumerate(used)}
    ordered = sorted(specs, key=lambda spec: gray_rank([at_of[x] for x in spec[1]]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_month")
        target = pdf["_y"].to_numpy(float)
        x = pdf[used].to_numpy(float).reshape(len(pdf), len(used))
        held = (pdf[split] == "test").to_numpy() if split else None
        parts, samples = [], {}
        for o, xs in ordered:
            exog = [at_of[c] for c in xs]
            rows = np.flatnonzero(~np.isnan(target) & ~np.isnan(x[:, exog]).any(axis=1))
            if split:
                test, train = rows[held[rows]], rows[~held[rows]]
            else:
                train, test = rows[:-sizes.hold_out], rows[-sizes.hold_out:]
            if len(rows) < sizes.rows or len(test) < sizes.test_rows or not len(train):
                continue
            # Specs with the same complete months share one table; a factor missing in one of them is in no such spec.
            known = rows.tobytes()
            if known not in samples:
                samples[known] = Sample(target[train], np.nan_to_num(x[train]), np.nan_to_num(x[test]))
            got = _project(samples[known], o, exog)
            if got is None or not np.isfinite(got[0]).all():
                continue
            parts.append((o.label(), ", ".join(xs), test, got))
        if not parts:
            return pd.DataFrame(columns=[*keys, *(c.split(" ")[0] for c in _FORECAST.split(", "))])
        sizes_of = [len(test) for _, _, test, _ in parts]
        each = lambda values: np.repeat(np.array(list(values), dtype=object), sizes_of)
        joined = lambda arrays, kind=float: np.concatenate([np.empty(0, kind), *arrays])
        at = joined((test for _, _, test, _ in parts), int).astype(int)
        return pd.DataFrame({
            **{k: [pdf[k].iloc[0]] * len(at) for k in keys},
            "model_order": each(p[0] for p in parts), "features": each(p[1] for p in parts),
            "month": pdf["_month"].to_numpy()[at], "actual_log": target[at],
            "predicted_log": joined(p[3][0] for p in parts), "se_log": joined(p[3][1] for p in parts),
            "aic": each(p[3][2] for p in parts).astype(float), "n_train": each(p[3][3] for p in parts).astype("int32")})

    cols = [*[F.col(k) for k in keys], F.col(s.time).alias("_month"), F.col(y).cast("double").alias("_y"),
            *[F.col(x).cast("double").alias(x) for x in used], *([F.col(split)] if split else [])]
    return spread(df.select(*cols), keys).groupBy(*keys, TASK).applyInPandas(run, schema)


def _priced(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    p, se = F.col("predicted_log"), F.col("se_log")
    return out.select(
        *keys, "model_order", "features", "month", F.exp("actual_log").alias("actual"), F.exp(p).alias("predicted"),
        F.exp(p - _Z95 * se).alias("lower"), F.exp(p + _Z95 * se).alias("upper"), "aic", "n_train")


def forecast_arx(df: DataFrame, s: Series, y: str, exog: Sequence[str], order: Order = Order(),
                 hold_out: int = HOLD_OUT, min_months: int = MIN_MONTHS) -> DataFrame:
    """Forecast of the last ``hold_out`` complete months of every series with 95 % bounds.

    ``y`` is a log price; the result is in prices. Series with fewer than ``min_months``
    complete months, or too short for the order, yield no rows.
    """
    sizes = Sizes(min_months, hold_out, hold_out)
    return _priced(_forecast_groups(df, s, y, [(order, tuple(exog))], sizes, None), s.keys)


def forecast_errors(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, R2 and the rest per series and model."""
    return fit_metrics(forecast, [*keys, "model_order", "features", "aic", "n_train"])


def feature_subsets(df: DataFrame, s: Series, y: str, candidates: Sequence[str], max_vars: int | None = None,
                    hold_out: int = HOLD_OUT) -> DataFrame:
    """All non-empty feature subsets in one job, ranked by R2 within each series.

    The test months are the last of the series whatever the subset; a subset counts with at
    least 50 complete rows, 6 of them in the test months.
    """
    subsets = [c for k in range(1, (max_vars or len(candidates)) + 1) for c in combinations(candidates, k)]
    marked = split_tail(df, s, hold_out)
    sizes = Sizes(SUBSET_MIN_ROWS, SUBSET_MIN_TEST, hold_out)
    out = _forecast_groups(marked, s, y, [(SUBSET_ORDER, c) for c in subsets], sizes, "split")
    errors = forecast_errors(_priced(out, s.keys), s.keys)
    rank = F.row_number().over(W.partitionBy(*s.keys).orderBy(F.desc_nulls_last("r2"), "features"))
    return errors.select(*s.keys, "features", F.size(F.split("features", ", ")).alias("num_vars"), "n", "rmse", "r2", "aic",
                         rank.alias("rank"))


def order_search(df: DataFrame, s: Series, y: str, exog: Sequence[str], orders: Sequence[Order] | None = None,
                 hold_out: int = HOLD_OUT, min_months: int = MIN_MONTHS) -> DataFrame:
    """Best order of each series by AIC over the grid, with its error on the test months."""
    specs = [(o, tuple(exog)) for o in (orders or order_grid())]
    out = _forecast_groups(df, s, y, specs, Sizes(min_months, hold_out, hold_out), None)
    errors = forecast_errors(_priced(out, s.keys), s.keys).select(
        *s.keys, "model_order", "aic", "rmse", "r2", "n_train")
    return best_row(errors, s.keys, F.col("aic"), ["model_order"], largest=False)
