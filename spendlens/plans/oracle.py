"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Everything is written from the definition of the operator: lags by row number,
carry-over by its power series, models by eliminating the normal equations (the lasso by
repeated coordinate steps) in chained subqueries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from spendlens.functions.promo_text import KEYWORD_CATEGORIES, PROMO_TYPE_PATTERNS
from spendlens.plans.trade_panel import CHANNEL_OF_PRIORITY, CHANNELS

SPEND = [f"cost_{c}" for c in CHANNELS]
SEEN = [f"impression_{c}" for c in CHANNELS]
SPEND_LOG = [f"{c}_log" for c in SPEND]
LASSO_SWEEPS = 400
# Weeks of the orders in the generated tables.
FIRST_MONDAY, N_WEEKS = dt.date(1994, 12, 26), 345


def _r(expression: str, name: str, digits: int = 4) -> str:
    """A rounded column. Spelled out, since engines round a tie each in their own way."""
    return f"{_round(expression, digits)} AS {name}"


def _round(expression: str, digits: int = 4) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def _shown(expression: str, name: str) -> str:
    """Two decimals, as the operator itself shows them."""
    return f"round({expression}, 2) + 0.0 AS {name}"


def _rs(names: Sequence[str], digits: int = 4) -> str:
    return ", ".join(_r(n, n, digits) for n in names)


def _sums() -> str:
    out = []
    for priority, channel in CHANNEL_OF_PRIORITY.items():
        out.append(
            f"coalesce(round(sum(p * d) FILTER (WHERE pr = '{priority}'), 4), 0.0) AS cost_{channel}"
        )
    for priority, channel in CHANNEL_OF_PRIORITY.items():
        total = f"sum(q) FILTER (WHERE pr = '{priority}')"
        if channel != "high":
            total = f"coalesce({total}, 0.0)"
        out.append(f"{total} AS impression_{channel}")
    return ",\n    ".join(out)


PANEL = f"""
lines AS (
  SELECT n_name AS geo, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderkey,
    o_orderpriority AS pr, l_partkey, l_quantity AS q, l_extendedprice AS p,
    l_discount + 0.0 AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
base AS (
  SELECT geo, week,
    {_sums()},
    coalesce(sum(q) FILTER (WHERE d < 0.005), 0.0) AS impression_organic,
    round(sum(p * (1.0 - d)), 4) AS revenue,
    count(DISTINCT o_orderkey) AS conversions,
    CAST(NULL AS DOUBLE) AS cost_void, CAST(NULL AS DOUBLE) AS impression_void
  FROM lines GROUP BY geo, week
),
people AS (
  SELECT n_name AS geo, count(*) AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
),
promos AS (
  SELECT DISTINCT week, geo, promo_description FROM (
    SELECT week, geo, CASE p_type
      WHEN 'PROMO' THEN 'Rabat -' || CAST(CAST(round(d * 100) AS INTEGER) AS VARCHAR)
        || '% na ' || p_name
      WHEN 'SMALL' THEN 'Darmowa dostawa'
      WHEN 'LARGE' THEN 'Druga sztuka GRATIS'
      WHEN 'MEDIUM' THEN 'Zamówień powyżej 100 zł'
      WHEN 'ECONOMY' THEN '2żółte za 1' END AS promo_description
    FROM lines JOIN part ON l_partkey = p_partkey WHERE d >= 0.085)
  WHERE promo_description IS NOT NULL
),
panel AS (
  SELECT base.*, population,
    revenue / round(sum(revenue) OVER (PARTITION BY base.week), 4) AS market_share,
    promo_description
  FROM base LEFT JOIN people ON base.geo = people.geo
  LEFT JOIN (SELECT week, geo, max(promo_description) AS promo_description
             FROM promos GROUP BY week, geo) t
    ON base.week = t.week AND base.geo = t.geo
)"""

PANEL_COLUMNS = [
    "geo", "week", *SPEND, *SEEN, "impression_organic", "revenue", "conversions",
    "cost_void", "impression_void", "population", "market_share", "promo_description",
]
DOUBLES = [
    *SPEND, *SEEN, "impression_organic", "revenue", "cost_void", "impression_void",
    "market_share",
]


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([PANEL.strip(), *more]) + "\n" + body


# The panel joined with all promotions: several rows per geo and week.
FAN = """
fan AS (
  SELECT panel.* EXCLUDE (promo_description), promos.promo_description
  FROM panel LEFT JOIN promos ON panel.week = promos.week AND panel.geo = promos.geo
)"""


def _fanned(body: str, *more: str) -> str:
    return _with(body, FAN.strip(), *more)


def _recursive(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([PANEL.strip(), *more]) + "\n" + body


def _panel(columns: str) -> str:
    return _with(f"SELECT geo, week, {columns} FROM panel")


def _whole_panel(without: Sequence[str] = ()) -> str:
    return ", ".join(
        _r(c, c) if c in DOUBLES else c for c in PANEL_COLUMNS if c not in without
    )


# --- promotion text -----------------------------------------------------------------


def _any_of(text: str, patterns: Sequence[str]) -> str:
    joined = "|".join(patterns).replace(r"[+\w]", r"[\p{L}\p{N}_+]")
    return f"regexp_matches(lower({text}), '{joined}')"


def _flag(name: str, text: str = "promo_description") -> str:
    test = _any_of(f"coalesce({text}, '')", PROMO_TYPE_PATTERNS[name])
    return f"CAST({test} AS BIGINT)"


def _discount(text: str = "promo_description") -> str:
    return f"coalesce(TRY_CAST(regexp_extract({text}, '-(\\d+)%', 1) AS BIGINT), 0)"


FLAGS = ", ".join(f"{_flag(n)} AS {n}" for n in PROMO_TYPE_PATTERNS)


# --- long reports ---------------------------------------------------------------------


def _stacked(selects: Sequence[str]) -> str:
    return " UNION ALL ".join(selects)


SPEND_ROWS = _stacked(
    [
        f"SELECT '{c[5:]}' AS channel, {_r(f'coalesce(sum({c}), 0.0)', 'total_spend')}, "
        f"{_r(f'avg({c})', 'avg_spend')}, {_r(f'min({c})', 'min_spend')}, "
        f"{_r(f'max({c})', 'max_spend')} FROM panel"
        for c in [*SPEND, "cost_void"]
    ]
)
SEEN_ROWS = _stacked(
    [
        f"SELECT '{c[11:]}' AS channel, "
        f"{_r(f'coalesce(sum({c}), 0.0)', 'total_impressions')}, "
        f"{_r(f'avg({c})', 'avg_impressions')} FROM panel"
        for c in [*SEEN, "impression_void"]
    ]
)
MISSING_ROWS = _stacked(
    [
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"{_r(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_pct', 2)} FROM panel"
        for c in PANEL_COLUMNS
    ]
)
KEYWORD_ROWS = _stacked(
    [
        f"SELECT '{name}' AS category, "
        f"count(*) FILTER (WHERE {_any_of('promo_description', patterns)}) AS n_promos, "
        f"count(promo_description) AS with_promo FROM fan"
        for name, patterns in KEYWORD_CATEGORIES.items()
    ]
)
FLAG_ROWS = _stacked(
    [
        f"SELECT '{name}' AS promo_type, CAST(sum({_flag(name)}) AS BIGINT) AS n_rows, "
        f"{_r(f'sum({_flag(name)}) * 100.0 / count(*)', 'row_pct')} FROM fan"
        for name in PROMO_TYPE_PATTERNS
    ]
)
DESCRIBE_ROWS = _stacked(
    [
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, {_shown(f'avg({c})', 'mean')}, "
        f"{_shown(f'stddev_samp({c})', 'std')}, {_shown(f'CAST(min({c}) AS DOUBLE)', 'min')}, "
        f"{_shown(f'quantile_cont({c}, 0.25)', 'p25')}, "
        f"{_shown(f'quantile_cont({c}, 0.5)', 'p50')}, "
        f"{_shown(f'quantile_cont({c}, 0.75)', 'p75')}, "
        f"{_shown(f'CAST(max({c}) AS DOUBLE)', 'max')} FROM panel"
        for c in [
            *SPEND, *SEEN, "impression_organic", "revenue", "conversions", "cost_void",
            "impression_void", "population", "market_share",
        ]
    ]
)
CHANNEL_ROWS = _stacked(
    [
        f"SELECT '{c}' AS channel, 'cost_{c}' AS cost_column, "
        f"'impression_{c}' AS impression_column, count(cost_{c}) AS cost_rows, "
        f"count(impression_{c}) AS impression_rows FROM panel"
        for c in [*CHANNELS, "void"]
    ]
)

# --- windows --------------------------------------------------------------------------

NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY week) AS rn FROM panel)"


def _lag(column: str, k: int, order: str = "week") -> str:
    return f"coalesce(lag({column}, {k}) OVER (PARTITION BY geo ORDER BY {order}), 0.0)"


def _promo_lag(column: str, k: int) -> str:
    """Where a week has several rows, in the order of their texts."""
    return _lag(column, k, "week, promo_description NULLS FIRST")


LAGS = ", ".join(_r(_lag(c, k), f"{c}_lag{k}") for c in SPEND for k in (1, 2))


def _forward(column: str) -> str:
    return (
        f"last_value({column} IGNORE NULLS) OVER (PARTITION BY geo ORDER BY week "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def _backward(column: str) -> str:
    return (
        f"first_value({column} IGNORE NULLS) OVER (PARTITION BY geo ORDER BY week "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


ORGANIC_LOGGED = "logged AS (SELECT geo, week, ln(impression_organic + 1) AS log_organic FROM panel)"
ORGANIC_LAG = _with(
    f"SELECT geo, week, {_r('log_organic', 'log_organic', 6)}, "
    f"{_r(_lag('log_organic', 1), 'log_organic_lag1', 6)} FROM logged",
    ORGANIC_LOGGED,
)
FORWARD_FILL = _panel(
    _r(f"coalesce({_forward('impression_high')}, {_backward('impression_high')})", "impression_high")
)
BACKWARD_FILL = _panel(
    _r(f"coalesce({_backward('impression_high')}, {_forward('impression_high')})", "impression_high")
)


def _adstocked(decay: dict[str, float]) -> str:
    levels = ", ".join(
        _r(f"sum(b.{c} * pow({d}, a.rn - b.rn))", f"{c}_adstocked") for c, d in decay.items()
    )
    return _with(
        f"SELECT a.geo, a.week, {levels} FROM numbered a JOIN numbered b "
        "ON a.geo = b.geo AND b.rn <= a.rn GROUP BY a.geo, a.week",
        NUMBERED,
    )


ADSTOCK_POISON = _with(
    "SELECT a.geo, a.week, CASE WHEN count(*) = count(b.impression_high) THEN "
    f"{_round('sum(b.impression_high * pow(0.4, a.rn - b.rn))')} END "
    "AS impression_high_adstocked FROM numbered a JOIN numbered b "
    "ON a.geo = b.geo AND b.rn <= a.rn GROUP BY a.geo, a.week",
    NUMBERED,
)

# --- encodings -------------------------------------------------------------------------


def _dummies(label: str, level: str, levels: Sequence[str]) -> str:
    """A 0/1 column for each of the levels: all that occur but the first."""
    columns = ", ".join(
        f"CAST(coalesce({level} = {value}, false) AS INTEGER) AS \"{label}_{value.strip(chr(39))}\""
        for value in levels
    )
    return _with(f"SELECT geo, week, {columns} FROM panel")


# The levels of the generated tables.
NATIONS = sorted(f"NATION_{i}" for i in range(25))
MONDAYS = [FIRST_MONDAY + dt.timedelta(weeks=i) for i in range(N_WEEKS)]

# --- models ----------------------------------------------------------------------------

LOGGED_PANEL = (
    "logpanel AS (SELECT geo, week, revenue, "
    + ", ".join(f"{c}, ln({c} + 1) AS {c}_log" for c in SPEND)
    + ", CAST(promo_description IS NOT NULL AS BIGINT) AS has_promotion, "
    + FLAGS
    + f", {_discount()} AS discount_percent FROM panel)"
)


# What each source of a model needs before it.
SOURCES = {
    "logpanel": [LOGGED_PANEL],
    "fan": [FAN.strip()],
    "logfan": [FAN.strip(), LOGGED_PANEL.replace("logpanel", "logfan").replace("FROM panel", "FROM fan")],
    "complete": ["complete AS (SELECT * FROM panel WHERE impression_high IS NOT NULL)"],
}


class Model:
    """Chained subqueries that end in ``weights``: one row w1..wk per standardised feature.

    ``stats`` has n, the means m1..mk and my, the deviations s1..sk and sy.
    """

    def __init__(
        self, names: Sequence[str], source: str = "panel", ridge: float = 0.0,
        lasso: float | None = None, scaled: bool = True,
    ) -> None:
        self.names, self.source, self.scaled = list(names), source, scaled
        self.k = len(self.names)
        parts = [f"count(*) AS n, avg(revenue) AS my, {'stddev_pop(revenue)' if scaled else '1.0'} AS sy"]
        for i, c in enumerate(self.names, 1):
            parts.append(
                f"avg({c}) AS m{i}, {f'stddev_pop({c})' if scaled else '1.0'} AS s{i}"
            )
        self.ctes = [f"stats AS (SELECT {', '.join(parts)} FROM {source})"]
        moments = []
        for i, a in enumerate(self.names, 1):
            moments.append(f"avg(({a} - m{i}) * (revenue - my)) / (any_value(s{i}) * any_value(sy)) AS a{i}_0")
            for j, b in enumerate(self.names, 1):
                extra = f" + {ridge} / any_value(n)" if i == j and ridge else ""
                moments.append(
                    f"avg(({a} - m{i}) * ({b} - m{j})) / (any_value(s{i}) * any_value(s{j})){extra} AS a{i}_{j}"
                )
        self.ctes.append(f"step0 AS (SELECT {', '.join(moments)} FROM {source}, stats)")
        if lasso is None:
            self._eliminate()
        else:
            self._descend(lasso)

    def _eliminate(self) -> None:
        """Gauss-Jordan, one subquery per pivot; column 0 is the right-hand side."""
        rows = range(1, self.k + 1)
        columns = range(0, self.k + 1)
        for p in rows:
            cells = []
            for i in rows:
                for j in columns:
                    if i == p:
                        cells.append(f"a{p}_{j} / a{p}_{p} AS a{i}_{j}")
                    else:
                        cells.append(f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}")
            self.ctes.append(f"step{p} AS (SELECT {', '.join(cells)} FROM step{p - 1})")
        solved = ", ".join(f"a{i}_0 AS w{i}" for i in rows)
        self.ctes.append(f"weights AS (SELECT {solved} FROM step{self.k})")

    def _descend(self, alpha: float) -> None:
        """Coordinate descent: each round updates the weights one after the other."""
        rows = range(1, self.k + 1)
        steps = []
        for i in rows:
            others = " - ".join(
                [f"a{i}_0"]
                + [f"a{i}_{j} * {'v' if j < i else 'w'}{j}" for j in rows if j != i]
            )
            steps.append(
                f"sign({others}) * greatest(abs({others}) - {alpha}, 0.0) / a{i}_{i} AS v{i}"
            )
        nested = "SELECT round_no, " + ", ".join(f"w{i}" for i in rows) + ", step0.* FROM descent, step0"
        for i, step in zip(rows, steps):
            nested = f"SELECT *, {step} FROM ({nested})"
        start = ", ".join(f"CAST(0.0 AS DOUBLE) AS w{i}" for i in rows)
        moved = ", ".join(f"v{i}" for i in rows)
        self.ctes.append(
            f"descent AS (SELECT 0 AS round_no, {start} UNION ALL "
            f"SELECT round_no + 1, {moved} FROM ({nested}) WHERE round_no < {LASSO_SWEEPS})"
        )
        self.ctes.append(
            f"weights AS (SELECT {', '.join(f'w{i}' for i in rows)} FROM descent "
            f"WHERE round_no = {LASSO_SWEEPS})"
        )

    def sql(self, body: str, *more: str) -> str:
        before = SOURCES.get(self.source, [])
        return _recursive(body, *before, *self.ctes, *more)

    @property
    def raw(self) -> list[str]:
        return [f"w{i} * sy / s{i}" for i in range(1, self.k + 1)]

    @property
    def raw_intercept(self) -> str:
        return " - ".join(["my"] + [f"{w} * m{i}" for i, w in enumerate(self.raw, 1)])

    @property
    def prediction(self) -> str:
        return " + ".join([f"({self.raw_intercept})"] + [f"{w} * {c}" for c, w in zip(self.names, self.raw)])

    @property
    def model_prediction(self) -> str:
        return " + ".join(f"w{i} * ({c} - m{i}) / s{i}" for i, c in enumerate(self.names, 1))

    def coefficients(self) -> str:
        selects = [
            f"SELECT {i - 1} AS position, '{c}' AS feature, {_r(f'w{i}', 'coef_std')}, "
            f"{_r(self.raw[i - 1], 'coef_raw')} FROM weights, stats"
            for i, c in enumerate(self.names, 1)
        ]
        own = "0.0" if self.scaled else self.raw_intercept
        selects.append(
            f"SELECT {self.k} AS position, 'intercept' AS feature, {_r(own, 'coef_std')}, "
            f"{_r(self.raw_intercept, 'coef_raw')} FROM weights, stats"
        )
        return self.sql(_stacked(selects))

    def predictions(self, digits: int = 3, scale: str = "original") -> str:
        value = self.prediction if scale == "original" else self.model_prediction
        return self.sql(
            f"SELECT geo, week, {_r(value, 'prediction', digits)} FROM {self.source}, weights, stats"
        )

    def metrics_cte(self, scale: str = "original") -> str:
        value = self.prediction if scale == "original" else self.model_prediction
        return (
            f"errors AS (SELECT revenue, revenue - ({value}) AS e FROM {self.source}, weights, stats), "
            "metrics AS (SELECT 1 - sum(e * e) / (count(*) * var_pop(revenue)) AS r2, "
            "sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e * e) AS mse, count(*) AS n FROM errors)"
        )

    def metrics(self, kind: str, scale: str = "original") -> str:
        return self.sql(
            f"SELECT '{kind}' AS model_type, {_r('r2', 'r2', 8)}, {_rs(['rmse', 'mae'])}, "
            f"{_r('mse', 'mse', 0)}, {self.k} AS rank, n FROM metrics",
            self.metrics_cte(scale),
        )

    def _selected(self, of: str) -> list[tuple[int, str]]:
        return [(i, c) for i, c in enumerate(self.names, 1)]

    def elasticity_rows(self, digits: int = 6, channel: bool = False) -> str:
        return _stacked(
            [
                "SELECT "
                + (f"'{c.replace('cost_', '').replace('_log', '')}' AS channel, " if channel else "")
                + f"'{c}' AS feature, {_r(f'w{i} * m{i} / my', 'elasticity', digits)}, "
                "'model' AS coef_scale FROM weights, stats"
                for i, c in enumerate(self.names, 1)
            ]
        )

    def contribution_rows(self, digits: int = 6, scale: str = "model") -> str:
        weight = [f"w{i}" for i in range(1, self.k + 1)] if scale == "model" else self.raw
        return _stacked(
            [
                f"SELECT '{c}' AS feature, {_r(f'{w} * m{i} / my * 100', 'contribution_pct', digits)}, "
                f"'{scale}' AS coef_scale FROM weights, stats"
                for i, (c, w) in enumerate(zip(self.names, weight), 1)
            ]
        )

    def mroas_rows(self, basis: str = "total") -> str:
        selects = []
        for i, c in enumerate(self.names, 1):
            column = c.removesuffix("_log")
            spend = f"(SELECT sum({column}) FROM panel)" if basis == "total" else f"(exp(m{i}) - 1)"
            selects.append(
                f"SELECT '{c}' AS feature, '{column[5:]}' AS channel, w{i} AS coefficient, "
                f"(SELECT sum(revenue) FROM panel) AS total_sales, {spend} AS total_spend, "
                f"'{basis}' AS spend_basis, 'model' AS coef_scale FROM weights, stats"
            )
        return (
            f"SELECT feature, channel, {_r('coefficient', 'coefficient')}, "
            f"{_rs(['total_sales', 'total_spend'], 2)}, "
            f"{_r('coefficient * total_sales / total_spend', 'mroas')}, spend_basis, coef_scale, "
            "printf('$%.2f revenue per $1 spend', coefficient * total_sales / total_spend) "
            f"AS mroas_interpretation FROM ({_stacked(selects)}) WHERE total_spend > 0"
        )


PLAIN = Model(SPEND)
ONE = Model(["cost_high"])
RIDGE = Model(SPEND, ridge=1.0)
LASSO = Model(SPEND, lasso=0.01)
LOGS = Model(SPEND_LOG, "logpanel")
WITH_ORGANIC = Model([*SPEND, "impression_organic"])
PROMO = Model(
    ["cost_high_log", "has_promotion", "free_shipping_promo", "discount_percent_promo",
     "bundle_multibuy_promo"],
    "logfan",
)
WITH_NULLS = Model(["cost_high", "impression_high"], "complete")


def _comparison() -> str:
    """Three models side by side: each in a subquery of its own."""
    models = {
        "ols": Model(SPEND),
        "ridge": Model(SPEND, ridge=1.0),
        "lasso": Model(SPEND, lasso=1.0),
    }
    selects = [f"SELECT * FROM ({m.metrics(kind)})" for kind, m in models.items()]
    return _stacked(selects)


# --- feature sets and matrices ------------------------------------------------------------

MONTH, QUARTER, ISO_WEEK = "month(week)", "quarter(week)", "weekofyear(week)"
LOG_ALL = [*SPEND, *SEEN, "impression_organic"]
PROMO_FEATURES = [*PROMO_TYPE_PATTERNS, "discount_percent", "promo_intensity"]
RAW_KEPT = [*SPEND, *SEEN, "impression_organic", "revenue", "conversions", "population", "market_share"]
LAG_NAMES = [f"{c}_lag{k}" for c in SPEND for k in (1, 2)]
ALL_FEATURES = [
    *[c for c in RAW_KEPT if c != "revenue"],
    *[f"cpm_{c}" for c in CHANNELS],
    *[f"{c}_log" for c in LOG_ALL],
    "has_promotion", *PROMO_FEATURES, *LAG_NAMES, "log_organic", "log_organic_lag1",
]


def _feature_set_sql() -> str:
    fixed = {
        "target": ["revenue"],
        "spend_features": SPEND,
        "spend_features_log": SPEND_LOG,
        "lagged_spend_features": [*LAG_NAMES, "log_organic_lag1"],
        "impression_features": [*SEEN, "impression_organic"],
        "control_vars": ["population", "market_share", "log_organic", "log_organic_lag1"],
        "promotional_features": PROMO_FEATURES,
        "all_features": ALL_FEATURES,
    }
    rows = [
        f"('{name}', {i}, '{f}')" for name, names in fixed.items() for i, f in enumerate(names)
    ]
    leveled = (
        "levels AS (SELECT 'geo_fixed_effects' AS set_name, 0 AS part, geo AS level, "
        "'geo_fe_' || geo AS feature FROM panel UNION "
        "SELECT 'week_fixed_effects', 0, CAST(week AS VARCHAR), 'week_fe_' || week FROM panel UNION "
        f"SELECT 'seasonal_features', 1, printf('%02d', {MONTH}), 'month_' || {MONTH} FROM panel UNION "
        f"SELECT 'seasonal_features', 2, printf('%02d', {QUARTER}), 'quarter_' || {QUARTER} FROM panel UNION "
        f"SELECT 'seasonal_features', 3, printf('%02d', {ISO_WEEK}), 'week_of_year_' || {ISO_WEEK} FROM panel), "
        "later AS (SELECT *, row_number() OVER (PARTITION BY set_name, part ORDER BY level) AS place "
        "FROM levels)"
    )
    return _with(
        f"SELECT * FROM (VALUES {', '.join(rows)}) v(set_name, position, feature) UNION ALL "
        "SELECT set_name, CAST(row_number() OVER (PARTITION BY set_name ORDER BY part, level) - 1 "
        "AS INTEGER), feature FROM later WHERE place > 1",
        leveled,
    )


FILLED = (
    FAN.strip()
    + ", filled AS (SELECT * REPLACE (coalesce(impression_high, "
    "(SELECT median(impression_high) FROM fan)) AS impression_high), "
    "count(promo_description) OVER (PARTITION BY week, geo) AS promo_intensity, "
    "ln(impression_organic + 1) AS log_organic FROM fan)"
)

MATRIX_SEASONS = [
    *[(f"month_{m}", f"{MONTH} = {m}") for m in range(2, 13)],
    *[(f"quarter_{q}", f"{QUARTER} = {q}") for q in range(2, 5)],
    *[(f"week_of_year_{w}", f"{ISO_WEEK} = {w}") for w in range(2, 54)],
]


MATRIX_NATIONS = sorted(f"NATION_{i}" for i in range(25))[1:]
MATRIX_MEASURES = {
    **{f"{c}_log": f"ln({c} + 1)" for c in SPEND},
    "population": "population",
    "market_share": "market_share",
    "log_organic": "log_organic",
    "log_organic_lag1": _promo_lag("log_organic", 1),
}
MATRIX_FLAGS = {
    **{n: _flag(n) for n in PROMO_TYPE_PATTERNS},
    "discount_percent": _discount(),
    "promo_intensity": "promo_intensity",
    **{f"geo_fe_{g}": f"CAST(geo = '{g}' AS INTEGER)" for g in MATRIX_NATIONS},
    **{name: f"CAST({test} AS INTEGER)" for name, test in MATRIX_SEASONS},
}


def _matrix_sql() -> str:
    columns = [
        *[e if n == "population" else _r(e, n) for n, e in MATRIX_MEASURES.items()],
        *[f"{e} AS {n}" for n, e in MATRIX_FLAGS.items()],
    ]
    return _with(f"SELECT geo, week, {', '.join(columns)} FROM filled", FILLED)


def _eliminated(
    body: str, expressions: Sequence[str], before: Sequence[str], source: str, ridge: float = 0.0
) -> str:
    """Least squares of revenue on the expressions by elimination, table rows as matrix rows.

    A pivot that vanishes belongs to a column the earlier ones already span; it is left
    out. That is a least-squares solution too: fitted values are the same for all of
    them, and so are the coefficients of columns outside the collinear groups.
    """
    k = len(expressions)
    cells = ", ".join(f"CAST({e} AS DOUBLE)" for e in [*expressions, "revenue"])
    shrunk = f" + CASE WHEN a.i = b.i THEN {ridge} / count(*) ELSE 0 END" if ridge else ""
    return _recursive(
        body,
        *before,
        f"matrix AS (SELECT row_number() OVER () AS id, [{cells}] AS v FROM {source})",
        "cells AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM matrix)",
        "stats AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY i)",
        "scaled AS (SELECT id, i, CASE WHEN s < 1e-12 THEN 0.0 ELSE (x - m) / s END AS z "
        "FROM cells JOIN stats USING (i))",
        f"gram AS (SELECT a.i, b.i AS j, avg(a.z * b.z){shrunk} AS g FROM scaled a JOIN scaled b "
        "USING (id) GROUP BY a.i, b.i)",
        f"elim AS (SELECT 0 AS p, i, list(g ORDER BY j) AS r, false AS used FROM gram "
        f"WHERE i <= {k} GROUP BY i UNION ALL "
        "SELECT e.p + 1, e.i, CASE WHEN pr.r[e.p + 1] < 1e-9 THEN e.r "
        "WHEN e.i = e.p + 1 THEN list_transform(e.r, lambda x: x / e.r[e.p + 1]) "
        "ELSE list_transform(list_zip(e.r, pr.r), "
        "lambda t: t[1] - t[2] * e.r[e.p + 1] / pr.r[e.p + 1]) END, "
        "e.used OR (e.i = e.p + 1 AND e.r[e.p + 1] >= 1e-9) "
        f"FROM elim e JOIN elim pr ON pr.i = e.p + 1 AND pr.p = e.p WHERE e.p < {k})",
        f"weights AS (SELECT i, CASE WHEN used THEN r[{k + 1}] ELSE 0.0 END AS w, used "
        f"FROM elim WHERE p = {k})",
        f"target AS (SELECT m, s FROM stats WHERE i = {k + 1})",
        f"errors AS (SELECT any_value(v[{k + 1}]) AS y, any_value(v[{k + 1}]) "
        "- (any_value(m) + any_value(s) * sum(w * z)) AS e "
        "FROM scaled JOIN weights USING (i) JOIN matrix USING (id), target GROUP BY id)",
    )


def _full_model(body: str) -> str:
    return _eliminated(body, [*MATRIX_MEASURES.values(), *MATRIX_FLAGS.values()], [FILLED], "filled")


def _geo_effects(value: str, digits: int, ridge: float = 0.0) -> str:
    """(term, value) of spend and geo dummies; ``value`` from w, and the deviations s and sy."""
    terms = [*SPEND, *[f"geo {n}" for n in NATIONS[1:]]]
    expressions = [*SPEND, *[f"CAST(geo = '{n}' AS INTEGER)" for n in NATIONS[1:]]]
    names = ", ".join(f"'{t}'" for t in terms)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*SPEND, "revenue"])
    return _eliminated(
        f"SELECT [{names}][i] AS term, {_r(value, 'value', digits)} FROM weights JOIN "
        "(SELECT i, s FROM stats) USING (i), (SELECT s AS sy FROM target)",
        expressions, [f"whole AS (SELECT * FROM panel WHERE {complete})"], "whole", ridge,
    )


FULL_MODEL_METRICS = _full_model(
    "SELECT 'ols' AS model_type, "
    f"{_r('1 - sum(e * e) / (count(*) * var_pop(y))', 'r2', 8)}, "
    f"{_r('sqrt(avg(e * e))', 'rmse')}, {_r('avg(abs(e))', 'mae')}, {_r('avg(e * e)', 'mse', 0)}, "
    "(SELECT CAST(count(*) AS INTEGER) FROM weights WHERE used) AS rank, count(*) AS n FROM errors"
)


def _full_model_mroas() -> str:
    selects = [
        f"SELECT '{c}_log' AS feature, '{c[5:]}' AS channel, w AS coefficient, "
        "(SELECT sum(revenue) FROM fan) AS total_sales, "
        f"(SELECT sum({c}) FROM fan) AS total_spend FROM weights WHERE i = {i}"
        for i, c in enumerate(SPEND, 1)
    ]
    return _full_model(
        f"SELECT feature, channel, {_r('coefficient', 'coefficient')}, "
        f"{_rs(['total_sales', 'total_spend'], 2)}, "
        f"{_r('coefficient * total_sales / total_spend', 'mroas')}, "
        "'total' AS spend_basis, 'model' AS coef_scale, "
        "printf('$%.2f revenue per $1 spend', coefficient * total_sales / total_spend) "
        f"AS mroas_interpretation FROM ({_stacked(selects)})"
    )


PREPROCESS = _with(
    "SELECT geo, week, "
    + ", ".join(
        [
            _r("impression_high", "impression_high", 6),
            _r("cost_high / (impression_high / 1000 + 1)", "cpm_high", 6),
            _r("ln(cost_high + 1)", "cost_high_log", 6),
            _r("ln(impression_organic + 1)", "impression_organic_log", 6),
            "CAST(promo_description IS NOT NULL AS BIGINT) AS has_promotion",
            f"{_flag('bundle_multibuy_promo')} AS bundle_multibuy_promo",
            f"{_discount()} AS discount_percent",
            "promo_intensity",
            _r(_promo_lag("cost_high", 1), "cost_high_lag1", 6),
            _r(_promo_lag("cost_low", 2), "cost_low_lag2", 6),
            f"CAST({MONTH} = 12 AS INTEGER) AS month_12",
            f"CAST({QUARTER} = 4 AS INTEGER) AS quarter_4",
            f"CAST({ISO_WEEK} = 30 AS INTEGER) AS week_of_year_30",
            _r("log_organic", "log_organic", 6),
            _r(_promo_lag("log_organic", 1), "log_organic_lag1", 6),
            _r("market_share", "market_share", 6),
            "population",
        ]
    )
    + " FROM filled",
    FILLED,
)

PREPROCESS_WIDE = _with(
    "SELECT geo, week, CAST(geo <> (SELECT min(geo) FROM panel) AS INTEGER) AS geo_dummies, "
    "CAST(week <> (SELECT min(week) FROM panel) AS INTEGER) AS week_dummies, "
    f"CAST({MONTH} > 1 AS INTEGER) + CAST({QUARTER} > 1 AS INTEGER) + "
    f"CAST({ISO_WEEK} > 1 AS INTEGER) AS seasonal_dummies, "
    + _r(" + ".join([*[_promo_lag(c, k) for c in SPEND for k in (1, 2)], _promo_lag("log_organic", 1)]), "lagged")
    + ", "
    + _r(" + ".join(f"ln({c} + 1)" for c in SPEND), "logged", 6)
    + ", CAST("
    + " + ".join([*[_flag(n) for n in PROMO_TYPE_PATTERNS], _discount(), "promo_intensity"])
    + " AS BIGINT) AS promo_sum FROM filled",
    FILLED,
)

PREPROCESS_SUMMARY = _fanned(
    "SELECT count(*) AS n_rows, CAST(54 + (count(DISTINCT geo) - 1) + (count(DISTINCT week) - 1) "
    f"+ (count(DISTINCT {MONTH}) - 1) + (count(DISTINCT {QUARTER}) - 1) "
    f"+ (count(DISTINCT {ISO_WEEK}) - 1) AS BIGINT) AS n_columns, "
    f"'{', '.join(CHANNELS)}' AS channels, CAST(5 AS BIGINT) AS n_channels, "
    "CAST(5 AS BIGINT) AS cost_columns, CAST(6 AS BIGINT) AS impression_columns, "
    "count(*) - count(promo_description) AS missing_values, "
    "round((1 - (count(*) - count(promo_description)) / (count(*) * (54 + (count(DISTINCT geo) - 1) "
    f"+ (count(DISTINCT week) - 1) + (count(DISTINCT {MONTH}) - 1) + (count(DISTINCT {QUARTER}) - 1) "
    f"+ (count(DISTINCT {ISO_WEEK}) - 1)))) * 100, 1) AS completeness_pct, "
    "CAST(9 AS BIGINT) AS n_steps FROM fan"
)


def _run_results() -> str:
    model = Model(SPEND, "fan", ridge=1.0)
    selects = [
        "SELECT 'data_import' AS section, 'shape.0' AS name, CAST(count(*) AS DOUBLE) AS number, "
        "CAST(NULL AS VARCHAR) AS text FROM fan",
        f"SELECT 'data_import', 'shape.1', {len(PANEL_COLUMNS)}, NULL",
        "SELECT 'data_import', 'date_range.start', NULL, CAST(min(week) AS VARCHAR) FROM panel",
        "SELECT 'data_import', 'date_range.end', NULL, CAST(max(week) AS VARCHAR) FROM panel",
        "SELECT 'run', 'status', NULL, 'SUCCESS'",
        "SELECT 'data_import', 'status', NULL, 'SUCCESS'",
        "SELECT 'model_training', 'status', NULL, 'SUCCESS'",
        "SELECT 'model_evaluation', 'status', NULL, 'SUCCESS'",
        "SELECT 'model_training', 'model_type', NULL, 'ridge'",
        "SELECT 'model_training', 'model_alpha', 1.0, NULL",
    ]
    for name, column in (("r2_score", "r2"), ("rmse", "rmse"), ("mae", "mae")):
        selects.append(
            f"SELECT 'model_evaluation', 'model_metrics.{name}', {_round(column)}, NULL FROM metrics"
        )
    for kind, factor in (("elasticity", ""), ("contribution", " * 100")):
        for i, c in enumerate(SPEND, 1):
            selects.append(
                f"SELECT 'model_evaluation', '{kind}.{c}', "
                f"{_round(f'w{i} * m{i} / my{factor}')}, NULL FROM weights, stats"
            )
    return model.sql(_stacked(selects), model.metrics_cte())


DECAY = dict(zip(SPEND, [0.5, 0.3, 0.7, 0.9, 0.0]))
COST_ROWS = (
    f"SELECT p.geo, p.week, {', '.join(_r(f'p.{c}', c) for c in [*SPEND, 'revenue'])}, "
    "conversions, promos.promo_description FROM panel p "
    "LEFT JOIN promos ON p.week = promos.week AND p.geo = promos.geo"
)
JOINED = _with(
    f"SELECT p.geo, p.week, {_r('p.revenue', 'revenue')}, promos.promo_description FROM panel p "
    "LEFT JOIN promos ON p.week = promos.week AND p.geo = promos.geo"
)
SCENARIO = {"cost_urgent": 1.2, "cost_high": 1.2, "cost_low": 0.8}


def _scenario() -> str:
    selects = []
    for c, factor in SCENARIO.items():
        i = SPEND.index(c) + 1
        selects.append(
            f"SELECT '{c}' AS spend_column, {factor} + 0e0 AS factor, "
            f"{_r(f'(SELECT sum({c}) FROM panel)', 'current_spend')}, "
            f"{_r(f'(SELECT sum({c}) FROM panel) * {factor}', 'scenario_spend')}, "
            f"{_r(f'w{i}', 'coefficient')}, {_r(f'w{i} * ln({factor})', 'lift')}, "
            f"{_r(f'w{i} * ln({factor}) * 100', 'lift_pct')} FROM weights"
        )
    return LOGS.sql(_stacked(selects))


def _promo_impact() -> str:
    selects = [
        f"SELECT '{c}' AS feature, {_r(f'w{i}', 'coefficient')}, "
        f"{_r(f'w{i} * my' if c == 'has_promotion' else f'w{i}', 'impact')} FROM weights, stats"
        for i, c in enumerate(PROMO.names, 1)
        if c != "cost_high_log"
    ]
    return PROMO.sql(_stacked(selects))


INTENSITY = _with(
        "SELECT p.geo, p.week, promos.promo_description, count(promos.promo_description) "
        "OVER (PARTITION BY p.week, p.geo) AS promo_intensity FROM panel p "
        "LEFT JOIN promos ON p.week = promos.week AND p.geo = promos.geo"
    )


def _report_rows() -> str:
    """Every report on the joined rows, one row per cell: (section, row_key, name, number, text)."""
    quality = (
        f"SELECT count(*) AS n_rows, {len(PANEL_COLUMNS)} AS n_columns, CAST(min(week) AS VARCHAR) "
        "AS week_start, CAST(max(week) AS VARCHAR) AS week_end, count(DISTINCT geo) AS n_geos FROM fan"
    )
    kpi = (
        f"SELECT {_r('sum(revenue)', 'total_revenue')}, {_r('avg(revenue)', 'avg_revenue')}, "
        f"{_r('min(revenue)', 'min_revenue')}, {_r('max(revenue)', 'max_revenue')}, "
        "sum(conversions) AS total_conversions, "
        f"{_r('avg(conversions)', 'avg_conversions')} FROM fan"
    )
    coverage = (
        "SELECT count(*) AS total_rows, count(promo_description) AS promo_rows, "
        "count(*) - count(promo_description) AS no_promo_rows, "
        f"{_r('count(promo_description) * 100.0 / count(*)', 'promo_pct')}, "
        "count(DISTINCT promo_description) AS distinct_promos FROM fan"
    )
    by_geo = (
        "SELECT geo, count(promo_description) AS promo_rows, count(*) AS total_rows, "
        f"{_r('count(promo_description) * 100.0 / count(*)', 'promo_pct')} FROM fan GROUP BY geo"
    )
    keywords = (
        f"SELECT category, n_promos, {_r('n_promos * 100.0 / with_promo', 'promo_pct')} "
        f"FROM ({KEYWORD_ROWS}) WHERE n_promos > 0"
    )
    parts = [
        ("missing", "column_name", f"SELECT * FROM ({MISSING_ROWS}) WHERE missing_count > 0",
         ["missing_count", "missing_pct"]),
        ("spend", "channel", SPEND_ROWS, ["total_spend", "avg_spend", "min_spend", "max_spend"]),
        ("impressions", "channel", SEEN_ROWS, ["total_impressions", "avg_impressions"]),
        ("kpi", "''", kpi, ["total_revenue", "avg_revenue", "min_revenue", "max_revenue",
                            "total_conversions", "avg_conversions"]),
        ("promo_keywords", "category", keywords, ["n_promos", "promo_pct"]),
        ("promo_flags", "promo_type", FLAG_ROWS, ["n_rows", "row_pct"]),
        ("data_quality", "''", quality, ["n_rows", "n_columns", "n_geos", "week_start", "week_end"]),
        ("promo_coverage", "''", coverage,
         ["total_rows", "promo_rows", "no_promo_rows", "promo_pct", "distinct_promos"]),
        ("promo_by_geo", "geo", by_geo, ["promo_rows", "total_rows", "promo_pct"]),
    ]
    cells = []
    for section, key, body, names in parts:
        rows = body.replace("FROM panel", "FROM fan")
        for name in names:
            text = name.startswith("week_")
            cells.append(
                f"SELECT '{section}' AS section, {key} AS row_key, '{name}' AS name, "
                f"{'CAST(NULL AS DOUBLE)' if text else f'CAST({name} AS DOUBLE)'} AS number, "
                f"{name if text else 'CAST(NULL AS VARCHAR)'} AS text FROM ({rows})"
            )
    return _fanned(_stacked(cells))


def _logistics() -> str:
    renamed = {"high": "logistics", "low": "low_cost_air"}
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in renamed.items())
    name = f"CASE channel {cases} ELSE channel END"
    return LOGS.sql(
        f"SELECT {name} AS channel, 'cost_' || {name} || '_log' AS feature, total_spend, mroas, "
        f"spend_basis, true AS has_cpm FROM ({LOGS.mroas_rows()})"
    )


def _summary() -> str:
    rows = [
        ("model", "type", "CAST(NULL AS DOUBLE)", "'ols'"),
        ("model", "features", str(float(len(SPEND))), "NULL"),
        ("model", "target", "NULL", "'revenue'"),
        *[("coefficient", c, _round(f"w{i}"), "NULL") for i, c in enumerate(SPEND, 1)],
        ("coefficient", "intercept", "0.0", "NULL"),
        *[("metric", m, _round(m, 0 if m == "mse" else 2), "NULL") for m in ("r2", "rmse", "mae", "mse")],
    ]
    selects = [
        f"SELECT '{section}' AS section, '{name}' AS name, {number} AS number, {text} AS text "
        "FROM weights, metrics"
        for section, name, number, text in rows
    ]
    return PLAIN.sql(_stacked(selects), PLAIN.metrics_cte())


def _feature_table() -> str:
    """Every column that the preparation makes, on the joined rows."""
    columns = [
        "geo", "week", "promo_description", "conversions", "population",
        *[_r(c, c, 6) for c in RAW_KEPT if c not in ("conversions", "population")],
        *[_r(f"cost_{c} / (impression_{c} / 1000 + 1)", f"cpm_{c}", 6) for c in CHANNELS],
        *[_r(f"ln({c} + 1)", f"{c}_log", 6) for c in LOG_ALL],
        "CAST(promo_description IS NOT NULL AS BIGINT) AS has_promotion",
        *[f"{_flag(n)} AS {n}" for n in PROMO_TYPE_PATTERNS],
        f"{_discount()} AS discount_percent",
        "promo_intensity",
        *[_r(_promo_lag(c, k), f"{c}_lag{k}", 6) for c in SPEND for k in (1, 2)],
        *[f"CAST(geo = '{n}' AS INTEGER) AS geo_fe_{n}" for n in NATIONS[1:]],
        *[f"CAST(week = DATE '{d}' AS INTEGER) AS \"week_fe_{d}\"" for d in MONDAYS[1:]],
        *[f"CAST({test} AS INTEGER) AS {name}" for name, test in MATRIX_SEASONS],
        _r("log_organic", "log_organic", 6),
        _r(_promo_lag("log_organic", 1), "log_organic_lag1", 6),
    ]
    return _with(f"SELECT {', '.join(columns)} FROM filled", FILLED)


LAGS_OF_PROMOTIONS = _fanned(
    "SELECT geo, week, promo_description, "
    + ", ".join(_r(_promo_lag(c, k), f"{c}_lag{k}") for c in SPEND for k in (1, 2))
    + " FROM fan"
)


ORACLE_SQL: dict[str, str] = {
    "build_panel": _with(f"SELECT {_whole_panel()} FROM panel"),
    "build_promotions": _with("SELECT week, geo, promo_description FROM promos"),
    "scan_csv": _with("SELECT week, geo, promo_description FROM promos"),
    "scan_table": "SELECT * FROM customer",
    "import_panel": _with(COST_ROWS),
    "import_without_promotions": _panel(f"{_rs([*SPEND, 'revenue'])}, conversions"),
    "coerce_numeric": _panel(
        f"CASE WHEN promo_description IS NULL THEN {_round('cost_high')} END AS cost_high, "
        f"{_r('revenue', 'revenue')}, CAST(conversions AS DOUBLE) AS conversions, "
        "CAST(CAST(impression_high AS BIGINT) AS VARCHAR) AS impression_high"
    ),
    "parse_week": _panel("conversions"),
    "import_metadata": _with(
        f"SELECT count(*) AS n_rows, CAST({len(PANEL_COLUMNS)} AS BIGINT) AS n_columns, "
        "CAST(min(week) AS VARCHAR) AS week_start, CAST(max(week) AS VARCHAR) AS week_end FROM panel"
    ),
    "sink_csv": _with(f"SELECT {_whole_panel()} FROM panel"),
    "sink_parquet": _with(f"SELECT {_whole_panel()} FROM panel"),
    "sink_results_json": _with(
        "SELECT 'missing' AS section, column_name AS name, CAST(missing_count AS VARCHAR) AS value "
        f"FROM ({MISSING_ROWS}) WHERE missing_count > 0"
    ),
    "model_table_roundtrip": PLAIN.predictions(),
    "export_results": RIDGE.sql(
        f"SELECT geo, week, 'ridge' AS model_type, {_r(RIDGE.prediction, 'prediction', 3)} "
        "FROM panel, weights, stats"
    ),
    "channel_list": _with(CHANNEL_ROWS),
    "drop_channel": _with(
        f"SELECT {_whole_panel(['cost_void', 'impression_void'])} FROM panel"
    ),
    "drop_empty_channels": _with(
        f"SELECT {_whole_panel(['cost_void', 'impression_void'])} FROM panel"
    ),
    "feature_sets": _feature_set_sql(),
    "feature_matrix": _matrix_sql(),
    "fill_zero": _panel(
        ", ".join(
            _r(f"coalesce({c}, 0.0)", c)
            for c in ["impression_high", "cost_void", "impression_void", "cost_high"]
        )
    ),
    "median_fill": _panel(
        _r("coalesce(impression_high, (SELECT median(impression_high) FROM panel))", "impression_high")
    ),
    "ffill_bfill": FORWARD_FILL,
    "ffill_bfill_segmented": FORWARD_FILL,
    "bfill_ffill": BACKWARD_FILL,
    "bfill_ffill_segmented": BACKWARD_FILL,
    "model_dataset": _with(
        f"SELECT {_rs([*SPEND, 'impression_high', 'revenue'])} FROM panel "
        "WHERE impression_high IS NOT NULL"
    ),
    "has_promotion": _panel("CAST(promo_description IS NOT NULL AS BIGINT) AS has_promotion"),
    "join_promotions": JOINED,
    "join_common_columns": _with(
        "SELECT p.geo, p.week, p.conversions, people.population AS customers "
        "FROM panel p LEFT JOIN people ON p.geo = people.geo"
    ),
    "spend_summary": _with(SPEND_ROWS),
    "impression_summary": _with(SEEN_ROWS),
    "kpi_summary": _with(
        f"SELECT {_r('sum(revenue)', 'total_revenue')}, {_r('avg(revenue)', 'avg_revenue')}, "
        f"{_r('min(revenue)', 'min_revenue')}, {_r('max(revenue)', 'max_revenue')}, "
        "CAST(sum(conversions) AS BIGINT) AS total_conversions, "
        f"{_r('avg(conversions)', 'avg_conversions')} FROM panel"
    ),
    "missing_report": _with(f"SELECT * FROM ({MISSING_ROWS}) WHERE missing_count > 0"),
    "data_quality": _with(
        f"SELECT count(*) AS n_rows, CAST({len(PANEL_COLUMNS)} AS BIGINT) AS n_columns, "
        "CAST(min(week) AS VARCHAR) AS week_start, CAST(max(week) AS VARCHAR) AS week_end, "
        "count(DISTINCT geo) AS n_geos FROM panel"
    ),
    "promo_coverage": _fanned(
        "SELECT count(*) AS total_rows, count(promo_description) AS promo_rows, "
        "count(*) - count(promo_description) AS no_promo_rows, "
        f"{_r('count(promo_description) * 100.0 / count(*)', 'promo_pct')}, "
        "count(DISTINCT promo_description) AS distinct_promos FROM fan"
    ),
    "promo_keywords": _fanned(
        f"SELECT category, n_promos, {_r('n_promos * 100.0 / with_promo', 'promo_pct')} "
        f"FROM ({KEYWORD_ROWS}) WHERE n_promos > 0"
    ),
    "promo_by_geo": _fanned(
        "SELECT geo, count(promo_description) AS promo_rows, count(*) AS total_rows, "
        f"{_r('count(promo_description) * 100.0 / count(*)', 'promo_pct')} FROM fan GROUP BY geo"
    ),
    "promo_samples_short": _fanned(
        "SELECT week, geo, CASE WHEN length(promo_description) > 12 "
        "THEN substr(promo_description, 1, 12) || '...' ELSE promo_description END AS sample "
        "FROM fan WHERE promo_description IS NOT NULL ORDER BY week, geo, promo_description LIMIT 20"
    ),
    "promo_samples": _fanned(
        "SELECT week, geo, CASE WHEN length(promo_description) > 65 "
        "THEN substr(promo_description, 1, 65) || '...' ELSE promo_description END AS sample "
        "FROM fan WHERE promo_description IS NOT NULL ORDER BY week, geo, promo_description LIMIT 5"
    ),
    "promo_flag_counts": _fanned(FLAG_ROWS),
    "describe_numeric": _with(DESCRIBE_ROWS),
    "preprocess_summary": PREPROCESS_SUMMARY,
    "spend_lags": _panel(LAGS),
    "spend_lags_segmented": _panel(LAGS),
    "spend_lags_stored": _panel(LAGS),
    "organic_lag": ORGANIC_LAG,
    "organic_lag_segmented": ORGANIC_LAG,
    "promo_intensity": INTENSITY,
    "promo_intensity_hot_key": INTENSITY,
    "adstock": _adstocked({"cost_high": 0.5}),
    "adstock_null_poison": ADSTOCK_POISON,
    "adstock_channels": _adstocked(DECAY),
    "adstock_channels_segmented": _adstocked(DECAY),
    "log_features": _panel(
        ", ".join(
            _r(f"ln({c} + 1)", f"{c}_log", 6)
            for c in [*SPEND, "cost_void", *SEEN, "impression_organic", "impression_void"]
        )
    ),
    "log_organic": _panel(_r("ln(impression_organic + 1)", "log_organic", 6)),
    "cpm": _panel(
        ", ".join(
            _r(f"cost_{c} / (impression_{c} / 1000 + 1)", f"cpm_{c}", 6)
            for c in [*CHANNELS, "void"]
        )
    ),
    "promo_flags": _with(f"SELECT geo, week, promo_description, {FLAGS} FROM promos"),
    "discount_percent": _with(
        f"SELECT geo, week, promo_description, {_discount()} AS discount_percent FROM promos"
    ),
    "calendar_parts": _panel(
        f"CAST({MONTH} AS INTEGER) AS month, CAST({QUARTER} AS INTEGER) AS quarter, "
        f"CAST({ISO_WEEK} AS INTEGER) AS iso_week"
    ),
    "geo_fixed_effects": _dummies("geo_fe", "geo", [f"'{n}'" for n in NATIONS[1:]]),
    "week_fixed_effects": _dummies(
        "week_fe", "CAST(week AS VARCHAR)", [f"'{d}'" for d in MONDAYS[1:]]
    ),
    "month_dummies": _dummies("month", MONTH, [str(i) for i in range(2, 13)]),
    "quarter_dummies": _dummies("quarter", QUARTER, [str(i) for i in range(2, 5)]),
    "week_of_year_dummies": _dummies("week_of_year", ISO_WEEK, [str(i) for i in range(2, 54)]),
    "sparse_fixed_effects": _with(
        "SELECT geo, week, sizes.size, concat_ws(',', CASE WHEN g > 1 THEN CAST(g - 2 AS VARCHAR) END, "
        "CASE WHEN w > 1 THEN CAST(w - 2 + n_geos - 1 AS VARCHAR) END) AS indices, "
        "CAST((g > 1)::INTEGER + (w > 1)::INTEGER AS DOUBLE) AS total FROM ranked, sizes",
        "ranked AS (SELECT geo, week, dense_rank() OVER (ORDER BY geo) AS g, "
        "dense_rank() OVER (ORDER BY week) AS w FROM panel)",
        "sizes AS (SELECT count(DISTINCT geo) AS n_geos, "
        "count(DISTINCT geo) + count(DISTINCT week) - 2 AS size FROM panel)",
    ),
    "standardize": _panel(
        ", ".join(
            _r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", f"{c}_std", 6)
            for c in ["cost_high", "impression_organic", "revenue"]
        )
    ),
    "fit_ols_1": _with(
        "SELECT 0 AS position, 'cost_high' AS feature, "
        f"{_r('corr(revenue, cost_high)', 'coef_std')}, "
        f"{_r('regr_slope(revenue, cost_high)', 'coef_raw')} FROM panel UNION ALL "
        f"SELECT 1, 'intercept', 0.0, {_r('regr_intercept(revenue, cost_high)', 'coef_raw')} FROM panel"
    ),
    "fit_ols": PLAIN.coefficients(),
    "fit_ols_unscaled": Model(SPEND, scaled=False).coefficients(),
    "fit_ridge_2": Model(["cost_high", "cost_low"], ridge=5.0).coefficients(),
    "fit_ridge": RIDGE.coefficients(),
    "fit_ridge_unscaled": Model(SPEND, ridge=1.0, scaled=False).coefficients(),
    "fit_lasso_1": _with(
        "SELECT 0 AS position, 'cost_high' AS feature, "
        f"{_r('sign(r) * greatest(abs(r) - 0.1, 0.0)', 'coef_std')}, "
        f"{_r('sign(r) * greatest(abs(r) - 0.1, 0.0) * sy / sx', 'coef_raw')} FROM one UNION ALL "
        "SELECT 1, 'intercept', 0.0, "
        f"{_r('my - mx * sign(r) * greatest(abs(r) - 0.1, 0.0) * sy / sx', 'coef_raw')} FROM one",
        "one AS (SELECT corr(revenue, cost_high) AS r, stddev_pop(revenue) AS sy, "
        "stddev_pop(cost_high) AS sx, avg(revenue) AS my, avg(cost_high) AS mx FROM panel)",
    ),
    "fit_lasso": LASSO.coefficients(),
    "fit_lasso_strong": Model(SPEND, lasso=0.3).coefficients(),
    "coefficients": LOGS.coefficients(),
    "predict_1": ONE.predictions(),
    "predict": PLAIN.predictions(),
    "predict_model_scale": PLAIN.predictions(6, "model"),
    "evaluate_1": ONE.metrics("ols"),
    "evaluate": PLAIN.metrics("ols"),
    "evaluate_model_scale": PLAIN.metrics("ols", "model"),
    "elasticity_1": ONE.sql(ONE.elasticity_rows()),
    "elasticity": RIDGE.sql(RIDGE.elasticity_rows()),
    "elasticity_log": LOGS.sql(LOGS.elasticity_rows(10, channel=True)),
    "contribution_1": ONE.sql(ONE.contribution_rows()),
    "contribution": RIDGE.sql(RIDGE.contribution_rows()),
    "contribution_original_scale": PLAIN.sql(PLAIN.contribution_rows(scale="original")),
    "top_elasticity": WITH_ORGANIC.sql(
        f"SELECT * FROM ({WITH_ORGANIC.elasticity_rows()}) ORDER BY abs(elasticity) DESC LIMIT 5"
    ),
    "top_contribution": WITH_ORGANIC.sql(
        f"SELECT * FROM ({WITH_ORGANIC.contribution_rows()}) ORDER BY contribution_pct DESC LIMIT 5"
    ),
    "mroas_1": ONE.sql(ONE.mroas_rows()),
    "mroas": LOGS.sql(LOGS.mroas_rows()),
    "mroas_fallback": LOGS.sql(LOGS.mroas_rows("mean")),
    "promo_impact": _promo_impact(),
    "scenario_lift": _scenario(),
    "model_comparison": _comparison(),
    "evaluate_null_features": WITH_NULLS.metrics("ols"),
    "logistics_channel": _logistics(),
    "model_summary": _summary(),
    "lags_of_promotions": LAGS_OF_PROMOTIONS,
    "data_report": _report_rows(),
    "feature_table": _feature_table(),
    "preprocess": PREPROCESS,
    "preprocess_wide": PREPROCESS_WIDE,
    "spend_model_job": RIDGE.coefficients(),
    "full_model_job": FULL_MODEL_METRICS,
    "full_model_mroas": _full_model_mroas(),
    "full_model_vector": FULL_MODEL_METRICS,
    "full_model_vector_mroas": _full_model_mroas(),
    "fit_geo_effects": _geo_effects("w * sy / s", 3),
    "fit_geo_effects_ridge": _geo_effects("w", 6, 50.0),
    "fit_sparse_effects": _geo_effects("w * sy / s", 3),
    "run_results": _run_results(),
}
