"""Check-engine counterparts of the pipelines, as common table expressions.

Written on their own, without looking at Spark plans: cells find their country by key
rather than by geometry, the gamma law is summed as a Poisson series, and regressions are
solved by successive orthogonalisation rather than by normal equations.
"""

from __future__ import annotations

from granary.functions import names, tails
from granary.operators.index import ANALYSED_SCALES
from granary.plans.registry import cte


def any_of(column: str, targets) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in targets) + ")"


def family(column: str, targets, ignore_case: bool = False) -> str:
    text = f"lower({column})" if ignore_case else column
    whens = " ".join(f"WHEN contains({text}, '{t.lower() if ignore_case else t}') THEN '{t}'" for t in targets)
    return f"CASE {whens} ELSE {column} END"


WEIGHT_FIRST_NUMBER = r"coalesce(TRY_CAST(regexp_extract(unit, '(\d+(\.\d+)?)', 1) AS DOUBLE), 1.0)"
WEIGHT_FIRST_DIGITS = r"coalesce(TRY_CAST(regexp_extract(unit, '(\d+)', 1) AS INTEGER), 1)"
WEIGHT_KG_LITRE = (
    "CASE WHEN contains(lower(unit), 'kg') OR contains(lower(unit), 'l') THEN "
    "CASE WHEN regexp_replace(lower(unit), '[^0-9.]', '', 'g') = '' THEN 1.0 "
    "ELSE TRY_CAST(regexp_replace(lower(unit), '[^0-9.]', '', 'g') AS DOUBLE) END END")
MONTH = "CAST(date_trunc('month', {}) AS DATE)"


def polynomial(coefs, x: str) -> str:
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({c!r} + {x} * {out})"
    return out


def normal_quantile(p: str) -> str:
    """``p`` must be a column name."""
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    ratio = lambda a, b, x: f"{polynomial(a, x)} / {polynomial(b, x)}"
    c = ratio(tails.AS241_A, tails.AS241_B, f"(0.180625 - {q} * {q})")
    near = ratio(tails.AS241_C, tails.AS241_D, f"({r} - 1.6)")
    far = ratio(tails.AS241_E, tails.AS241_F, f"({r} - 5.0)")
    return (f"CASE WHEN {p} <= 0 THEN -1e9 WHEN {p} >= 1 THEN 1e9 WHEN abs({q}) <= 0.425 THEN {q} * {c} "
            f"ELSE sign({q}) * CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END END")


def gamma_cdf(a: str, x: str) -> str:
    """Sum of Poisson-like weights over ``n``."""
    return (f"list_sum(list_transform(range(0, CAST(2 * {x} + 120 AS BIGINT)), "
            f"lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))))")


def t_pvalue(t: str, df: str, terms: int = 6000) -> str:
    """Two-sided tail through the power series of the incomplete beta function."""
    def series(x: str, a: str, b: str) -> str:
        return (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))) * "
                f"(1 + list_sum(list_transform(range(0, {terms}), lambda n: exp(lgamma({a} + 1) + lgamma({a} + {b} + n + 1) "
                f"- lgamma({a} + {b}) - lgamma({a} + n + 2) + (n + 1) * ln({x})))))")
    x = f"(({df}) / (({df}) + ({t}) * ({t})))"
    a, b = f"(({df}) / 2.0)", "CAST(0.5 AS DOUBLE)"
    small = f"{x} <= ({a} + 1) / ({a} + {b} + 2)"
    return (f"CASE WHEN ({t}) = 0 THEN 1.0 WHEN {small} THEN {series(x, a, b)} "
            f"ELSE 1 - {series(f'(1 - {x})', b, a)} END")


def ols(table: str, keys: list[str], y: str, xs: list[str], prefix: str, effect: str | None = None,
        min_n: int = 20) -> dict[str, str]:
    """CTEs that end in ``{prefix}_fit``: keys, n, g, sst, sse, r2, aic and ``coef_``, ``se2_``.

    Each regressor is orthogonalised against the ones before it, last first for the
    standard errors: the fit is repeated with every regressor in last place.
    """
    kl = ", ".join(keys)
    by = f"PARTITION BY {', '.join([*keys, effect] if effect else keys)}"
    v = [y, *xs]
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*v, *keys, *([effect] if effect else [])])
    out = {f"{prefix}_rows": f"SELECT {', '.join([*keys, *([effect] if effect else []), *v])} FROM {table} WHERE {full}"}
    out[f"{prefix}_size"] = (
        f"SELECT {kl}, count(*) AS n, {'count(DISTINCT ' + effect + ')' if effect else '1'} AS g, "
        f"regr_syy({y}, {y}) AS sst FROM {prefix}_rows GROUP BY {kl} HAVING count(*) >= {min_n}")
    out[f"{prefix}_c"] = f"SELECT {kl}, " + ", ".join(f"{c} - avg({c}) OVER ({by}) AS {c}" for c in v) + f" FROM {prefix}_rows"
    for last in xs:
        order = [x for x in xs if x != last] + [last]
        src = f"{prefix}_c"
        for step, x in enumerate(order[:-1]):
            rest = [*order[step + 1:], y]
            name = f"{prefix}_{last}_{step}"
            part = f"OVER (PARTITION BY {kl})"
            out[name] = f"SELECT {kl}, " + ", ".join(
                f"{c} - {x} * (sum({c} * {x}) {part} / nullif(sum({x} * {x}) {part}, 0)) AS {c}" for c in rest) + f" FROM {src}"
            src = name
        out[f"{prefix}_{last}_z"] = (
            f"SELECT {kl}, sum({y} * {last}) / nullif(sum({last} * {last}), 0) AS coef, sum({last} * {last}) AS ss, "
            f"sum({y} * {y}) - sum({y} * {last}) * sum({y} * {last}) / nullif(sum({last} * {last}), 0) AS sse FROM {src} GROUP BY {kl}")
    k = len(xs)
    joins = " ".join(f"JOIN {prefix}_{x}_z z{i} USING ({kl})" for i, x in enumerate(xs))
    cols = ", ".join(
        f"z{i}.coef AS coef_{x}, sqrt(z{i}.sse / (n - {k} - g) / z{i}.ss) AS se_{x}" for i, x in enumerate(xs))
    out[f"{prefix}_fit"] = (
        f"SELECT {kl}, n, g, n - {k} - g AS df_resid, sst, z0.sse AS sse, 1 - z0.sse / sst AS r2, "
        f"n * (ln(2 * pi()) + ln(z0.sse / n) + 1) + 2 * ({k} + g) AS aic, {cols} "
        f"FROM {prefix}_size {joins}")
    return out


def add(ctes: dict[str, str]) -> None:
    for name, sql in ctes.items():
        cte(name, sql)


cte("monthly_price", f"""
SELECT countryiso3, {MONTH.format('date')} AS month, {family('commodity', names.STAPLES_AND_TEFF)} AS commodity_group,
       avg(usdprice / {WEIGHT_FIRST_NUMBER}) AS price_per_kg
FROM price_obs
WHERE {any_of('commodity', names.STAPLES_AND_TEFF)} AND NOT contains(lower(commodity), 'milling cost')
GROUP BY ALL""")

cte("monthly_usd_price", f"""
SELECT countryiso3, {MONTH.format('date')} AS month, {family('commodity', names.STAPLES)} AS commodity_group,
       avg(usdprice) AS usdprice
FROM price_obs WHERE {any_of('commodity', names.STAPLES)} GROUP BY ALL""")

cte("national_median", f"""
SELECT countryiso3, {MONTH.format('date')} AS month, {family('commodity', names.NATIONAL_STAPLES, True)} AS commodity_group,
       median(CASE WHEN unit = '100 KG' THEN usdprice / 100 ELSE usdprice END) AS usdprice
FROM price_obs GROUP BY ALL""")

cte("macro_month", f"""
SELECT {MONTH.format('date')} AS month, energy_index, food_index, fertilizer_index FROM macro_index""")


def accumulated(scales) -> str:
    """Sums over the last k months as rows, NULL unless all k months are there."""
    parts = []
    for k in scales:
        w = f"OVER (PARTITION BY iy, ix ORDER BY m RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"SELECT iy, ix, lat, lon, time, {k} AS scale, "
                     f"CASE WHEN count(precip) {w} = {k} THEN sum(precip) {w} END AS total FROM grid_months")
    return "\nUNION ALL ".join(parts)


cte("grid_months", "SELECT *, year(time) * 12 + month(time) AS m FROM grid_precip")
cte("rain_sums", accumulated(ANALYSED_SCALES))
cte("gamma_fit", """
SELECT iy, ix, scale, mo, zero_share, (1 + sqrt(1 + 4 * spread / 3)) / (4 * spread) AS alpha,
       mean / ((1 + sqrt(1 + 4 * spread / 3)) / (4 * spread)) AS beta
FROM (SELECT iy, ix, scale, month(time) AS mo,
             avg(total) FILTER (WHERE total > 0) AS mean,
             CASE WHEN count(total) FILTER (WHERE total > 0) > 0 THEN
               nullif(greatest(ln(avg(total) FILTER (WHERE total > 0))
                               - avg(ln(CASE WHEN total > 0 THEN total END)), 1e-12), 1e-12) END AS spread,
             count(*) FILTER (WHERE total = 0) / nullif(count(total), 0) AS zero_share
      FROM rain_sums GROUP BY ALL) m""")
cte("rain_probability", f"""
SELECT r.*, CASE WHEN alpha IS NULL OR total IS NULL THEN NULL WHEN total = 0 THEN zero_share
       ELSE zero_share + (1 - zero_share) * {gamma_cdf('alpha', '(total / beta)')} END AS p
FROM rain_sums r LEFT JOIN gamma_fit f ON f.iy = r.iy AND f.ix = r.ix AND f.scale = r.scale AND f.mo = month(r.time)""")
cte("spi_rows", f"""
SELECT iy, ix, lat, lon, time, scale,
       CASE WHEN p IS NOT NULL THEN greatest(-{tails.INDEX_LIMIT}, least({tails.INDEX_LIMIT}, {normal_quantile('p')})) END AS spi
FROM rain_probability""")
cte("country_spi", """
SELECT n_name AS countryiso3, n_nationkey, time AS month, scale, avg(spi) AS spi
FROM spi_rows JOIN nation ON n_nationkey = iy * 5 + ix GROUP BY ALL""")
cte("country_spi_wide", "SELECT countryiso3, month, " + ", ".join(
    f"max(CASE WHEN scale = {k} THEN spi END) AS spi_{k}" for k in ANALYSED_SCALES) + " FROM country_spi GROUP BY ALL")
cte("price_spi", """
SELECT countryiso3, month, commodity_group, price_per_kg, scale, spi
FROM monthly_price JOIN country_spi USING (countryiso3, month)""")


def guarded_corr(x: str, y: str, where: str = "TRUE", min_n: int = 2) -> str:
    """Correlation over complete pairs, NULL for constants."""
    ok = f"({where}) AND {x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"(CASE WHEN {ok} THEN {x} END)", f"(CASE WHEN {ok} THEN {y} END)"
    return (f"CASE WHEN count({a}) >= {min_n} AND min({a}) < max({a}) AND min({b}) < max({b}) "
            f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


def split_corr(keys: str, price: str, spi: str, table: str, min_n: int = 20, min_split: int = 10) -> str:
    both = f"{price} IS NOT NULL AND {spi} IS NOT NULL"
    return f"""SELECT {keys}, count(*) FILTER (WHERE {both}) AS n_total,
       count(*) FILTER (WHERE {both} AND {spi} < 0) AS n_drought,
       count(*) FILTER (WHERE {both} AND {spi} > 0) AS n_flood,
       {guarded_corr(price, spi)} AS corr_overall,
       {guarded_corr(price, spi, f'{spi} < 0', min_split)} AS corr_drought,
       {guarded_corr(price, spi, f'{spi} > 0', min_split)} AS corr_flood
FROM {table} GROUP BY {keys} HAVING count(*) FILTER (WHERE {both}) >= {min_n}"""


cte("split_corr", split_corr("commodity_group, scale", "price_per_kg", "spi", "price_spi"))


def impact_rows(prices: str) -> str:
    return f"""
SELECT p.countryiso3, p.month, commodity_group, usdprice, scale, spi, energy_index, food_index,
       CASE WHEN usdprice + 1e-6 > 0 THEN ln(usdprice + 1e-6) END AS log_price,
       ln(energy_index + 1e-6) AS log_energy, ln(food_index + 1e-6) AS log_food,
       CASE WHEN spi < -0.5 THEN spi ELSE 0.0 END AS spi_drought,
       CASE WHEN spi > 0.5 THEN spi ELSE 0.0 END AS spi_flood
FROM {prices} p JOIN country_spi USING (countryiso3, month) LEFT JOIN macro_month USING (month)"""


cte("pooled_rows", impact_rows("monthly_usd_price"))
cte("national_rows", impact_rows("national_median"))
cte("pooled_corr", f"""
SELECT commodity_group, scale, {guarded_corr('usdprice', 'spi')} AS corr FROM pooled_rows
GROUP BY ALL HAVING count(CASE WHEN usdprice IS NOT NULL THEN spi END) >= 20""")
cte("pooled_best", """
SELECT r.*, b.corr AS best_corr FROM pooled_rows r JOIN (
  SELECT * FROM pooled_corr WHERE corr IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY commodity_group ORDER BY corr, scale) = 1) b USING (commodity_group, scale)""")
cte("national_corr", f"""
SELECT countryiso3, commodity_group, scale, {guarded_corr('usdprice', 'spi')} AS corr FROM national_rows
GROUP BY ALL HAVING count(CASE WHEN usdprice IS NOT NULL THEN spi END) > 20""")
cte("national_best", """
SELECT r.*, b.corr AS best_corr FROM national_rows r JOIN (
  SELECT * FROM national_corr WHERE corr IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY countryiso3, commodity_group ORDER BY abs(corr) DESC, scale) = 1) b
  USING (countryiso3, commodity_group, scale)""")

cte("admin2_price", f"""
SELECT countryiso3 AS country_iso, admin2, date AS day, {MONTH.format('date')} AS date,
       {family('commodity', names.STAPLES_AND_TEFF)} AS commodity_group,
       avg(usdprice / weight) AS price_per_kg
FROM (SELECT *, {WEIGHT_KG_LITRE} AS weight FROM price_obs) p
WHERE weight > 0 AND admin2 IS NOT NULL AND {any_of('commodity', names.STAPLES_AND_TEFF)} GROUP BY ALL""")
cte("admin2_spi", """
SELECT countryiso3 AS country_iso, concat(countryiso3, '-B', CAST(n_nationkey % 5 AS VARCHAR)) AS admin2, month AS date,
       spi AS spi_6m FROM country_spi WHERE scale = 6""")
cte("admin2_panel", """
SELECT * FROM (
  SELECT country_iso, admin2, commodity_group, date, day, price_per_kg, spi_6m,
         lag(price_per_kg, 1) OVER w AS price_lag_1, lag(price_per_kg, 2) OVER w AS price_lag_2,
         lag(price_per_kg, 3) OVER w AS price_lag_3, lag(price_per_kg, 6) OVER w AS price_lag_6, month(date) AS month
  FROM admin2_price JOIN admin2_spi USING (country_iso, admin2, date)
  WHERE price_per_kg IS NOT NULL AND spi_6m IS NOT NULL
  WINDOW w AS (PARTITION BY country_iso, admin2, commodity_group ORDER BY day)) x
WHERE price_lag_6 IS NOT NULL AND price_lag_3 IS NOT NULL AND price_lag_2 IS NOT NULL AND price_lag_1 IS NOT NULL""")

cte("market_month", f"""
SELECT market_id, {MONTH.format('date')} AS month, avg(usdprice / {WEIGHT_FIRST_DIGITS}) AS per_unit_price
FROM price_obs WHERE contains(commodity, 'Sorghum') GROUP BY ALL""")
cte("market_inflation", """
SELECT market_id, month, per_unit_price, CASE WHEN lag(f) OVER w <> 0 THEN f / lag(f) OVER w - 1 END AS inflation_rate
FROM (SELECT *, last_value(per_unit_price IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM market_month) x
WINDOW w AS (PARTITION BY market_id ORDER BY month)""")

# A monthly grid per supplier series, and the interpolated value.
cte("series_dense", """
SELECT series_id, CAST(month AS DATE) AS month, price FROM (
  SELECT series_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month
  FROM regular_series GROUP BY series_id) g
LEFT JOIN (SELECT series_id, CAST(month AS TIMESTAMP) AS month, price FROM regular_series) r USING (series_id, month)""")
cte("series_filled", """
SELECT series_id, month, price,
       CASE WHEN price IS NOT NULL THEN price
            WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * ((i - pi) / CAST(ni - pi AS DOUBLE))
            ELSE pv END AS filled
FROM (SELECT *, last_value(price IGNORE NULLS) OVER up AS pv,
             last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER up AS pi,
             first_value(price IGNORE NULLS) OVER down AS nv,
             first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER down AS ni
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM series_dense) a
      WINDOW up AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             down AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) b""")


def filled(table: str, keys: str, time: str, value: str, others: str = "") -> dict[str, str]:
    """CTE bodies of a monthly grid per series and of the same with ``value`` interpolated, ``i`` its position."""
    rest = f", {others}" if others else ""
    dense = f"""
SELECT {keys}, CAST({time} AS DATE) AS {time}, {value}{rest} FROM (
  SELECT {keys}, unnest(generate_series(min({time}), max({time}), INTERVAL 1 MONTH)) AS {time} FROM {table} GROUP BY {keys}) g
LEFT JOIN (SELECT * REPLACE (CAST({time} AS TIMESTAMP) AS {time}) FROM {table}) r USING ({keys}, {time})"""
    by = f"PARTITION BY {keys} ORDER BY {time}"
    line = f"""
SELECT * EXCLUDE (pv, pi, nv, ni) REPLACE (CASE WHEN {value} IS NOT NULL THEN {value}
         WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * ((i - pi) / CAST(ni - pi AS DOUBLE)) ELSE pv END AS {value})
FROM (SELECT *, last_value({value} IGNORE NULLS) OVER up AS pv, last_value(CASE WHEN {value} IS NOT NULL THEN i END IGNORE NULLS) OVER up AS pi,
             first_value({value} IGNORE NULLS) OVER down AS nv, first_value(CASE WHEN {value} IS NOT NULL THEN i END IGNORE NULLS) OVER down AS ni
      FROM (SELECT *, row_number() OVER ({by}) AS i FROM ({dense}) d) a
      WINDOW up AS ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) b"""
    return {"dense": dense, "filled": line}


cte("forecast_rows", """
SELECT p.countryiso3, p.commodity_group, p.month, usdprice, """ + ", ".join(f"spi_{k}" for k in ANALYSED_SCALES) + """,
       energy_index, food_index, fertilizer_index
FROM national_median p JOIN country_spi_wide USING (countryiso3, month) LEFT JOIN macro_month USING (month)""")
cte("forecast_filled", filled("forecast_rows", "countryiso3, commodity_group", "month", "usdprice",
                              ", ".join(f"spi_{k}" for k in ANALYSED_SCALES) + ", energy_index, food_index, fertilizer_index")["filled"])
cte("forecast_lags", """
SELECT *, lag(log_price, 1) OVER w AS l1, lag(log_price, 3) OVER w AS l3, lag(log_price, 12) OVER w AS l12
FROM (SELECT *, CASE WHEN usdprice + 1e-6 > 0 THEN ln(usdprice + 1e-6) END AS log_price FROM forecast_filled) f
WINDOW w AS (PARTITION BY countryiso3, commodity_group ORDER BY month)""")
