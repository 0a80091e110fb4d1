"""The same results in plain SQL.

The texts are written from the definitions of the operators, with whole-series windows instead of
parts, and share nothing with the DataFrame code except the fixed values and ``Params`` defaults.
"""

from __future__ import annotations

import re

from tidemark.operators.features import (
    DAILY_BASES,
    HOURLY_BASES,
    HOURLY_RAW_FEATURES,
)
from tidemark.params import (
    CAUSE_LABEL,
    CAUSE_PRIOR,
    CAUSE_RULE,
    DEFAULTS,
    HINT_SEPARATOR,
    HINTS,
    LOW_DELTA_T_HINT,
    UNKNOWN_LABEL,
)

P = DEFAULTS
CAUSES = tuple(CAUSE_PRIOR)
FLAGS = HOURLY_BASES[3:]


STATS = ("mean", "std", "min", "max")


# --------------------------------------------------------------------------- expressions


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rnd(x: str, digits: int) -> str:
    """Round half to even after scaling."""
    s = dbl(float(10**digits))
    return f"(round_even(({x}) * {s}, 0) / {s})"


def stable(x: str) -> str:
    """Six decimals for ordinary values, nine to ten significant digits for huge ones."""
    return (
        f"(CASE WHEN abs({x}) < 1e6 THEN round_even(({x}) * 1e6, 0) / 1e6 "
        f"ELSE round_even(({x}) / 1e3, 0) * 1e3 END + 0.0::DOUBLE)"
    )


def stable_cols(*names: str) -> str:
    return ", ".join(f"{stable(n)} AS {n}" for n in names)


def quantile(values: str, q: float) -> str:
    """Linear interpolation in an ascending list."""
    pos = f"((len({values}) - 1) * {dbl(q)})"
    lo, hi = f"floor({pos})", f"ceil({pos})"
    low = f"{values}[CAST({lo} AS BIGINT) + 1]"
    high = f"{values}[CAST({hi} AS BIGINT) + 1]"
    return (
        f"(CASE WHEN {lo} = {hi} THEN {low} "
        f"ELSE {low} * ({hi} - {pos}) + {high} * ({pos} - {lo}) END)"
    )


def lookup(code: str, texts: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items())
    return f"(CASE {code} {whens} ELSE {default} END)"


def clip0(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0.0::DOUBLE) END)"


def rel_diff(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL "
        f"THEN abs({a} - {b}) / greatest({a}, {b}, 1e-12) END)"
    )


# --------------------------------------------------------------------------- common tables

CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT user_id // 30 AS meter_id, ts, event_id, event_type, value, props,
       date_trunc('hour', ts) AS hour_ts,
       CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
       CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INTEGER) AS k
FROM events"""

_CHANNELS = """
CAST(sum(cents) FILTER (WHERE event_type IN ('view', 'click')) AS DOUBLE) / 8192 AS xvs_m3,
CAST(sum(cents) FILTER (WHERE event_type IN ('purchase', 'signup')) AS DOUBLE) / 8192 AS gvs_m3,
CAST(sum(cents) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0) AS DOUBLE) / 8192 AS supply_m3,
CAST(sum(cents) FILTER (WHERE event_type = 'error' AND event_id % 2 = 1) AS DOUBLE) / 8192 AS return_m3,
CAST(max(k) AS DOUBLE) AS t1, CAST(min(k) AS DOUBLE) AS t2, CAST(min(k) AS DOUBLE) AS weather"""

CTES["reads"] = f"""
SELECT meter_id, hour_ts AS ts, {_CHANNELS}, CAST(isodow(hour_ts) AS INTEGER) AS weekday
FROM ev GROUP BY meter_id, hour_ts"""

CTES["raw_text"] = """
SELECT meter_id, strftime(ts, '%d.%m.%Y') AS date_raw,
       CAST(hour(ts) AS VARCHAR) || '-' || CAST(hour(ts) + 1 AS VARCHAR) AS hour_raw,
       supply_m3, return_m3, gvs_m3, xvs_m3, t1, t2, weather, weekday
FROM reads"""

CTES["hours"] = """
SELECT meter_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
FROM reads GROUP BY meter_id"""

CTES["plain_grid"] = """
SELECT h.meter_id, h.ts, CAST(h.ts AS DATE) AS day, CAST(hour(h.ts) + 1 AS INTEGER) AS hour_idx,
       xvs_m3, gvs_m3, supply_m3, return_m3, t1, t2, weather, weekday,
       min(h.ts) OVER (PARTITION BY h.meter_id) AS series_start,
       max(h.ts) OVER (PARTITION BY h.meter_id) AS series_end,
       min(weekday) OVER (PARTITION BY h.meter_id) AS weekday_low,
       max(weekday) OVER (PARTITION BY h.meter_id) AS weekday_high
FROM hours h LEFT JOIN reads r ON r.meter_id = h.meter_id AND r.ts = h.ts"""

CTES["grid"] = """
SELECT * REPLACE (CASE
    WHEN meter_id % 4 = 3 AND date_diff('day', DATE '2024-01-01', day) + 1 BETWEEN 10 AND 11 THEN 0.5
    WHEN meter_id % 4 = 2 AND date_diff('day', DATE '2024-01-01', day) + 1 BETWEEN 20 AND 21 THEN 0.0
    ELSE gvs_m3 END AS gvs_m3),
    CAST(CASE WHEN weekday_low >= 0 AND weekday_high <= 6 THEN weekday
              WHEN weekday_low >= 1 AND weekday_high <= 7 THEN weekday - 1 END AS INTEGER) AS weekday_norm
FROM plain_grid"""

CTES["bal"] = f"""
SELECT *, {rel_diff(clip0('gvs_m3'), clip0('xvs_m3'))} AS rel_diff,
       {clip0('gvs_m3')} - {clip0('xvs_m3')} AS diff_m3,
       coalesce({rel_diff(clip0('gvs_m3'), clip0('xvs_m3'))} > 0.1, FALSE) AS flag_over10
FROM grid"""

_order = "(PARTITION BY meter_id ORDER BY ts)"
_near = "(PARTITION BY meter_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"
_channels = (("xvs_m3", "itp_xvs"), ("gvs_m3", "odpu_gvs"))

CTES["marks"] = "SELECT *, " + ", ".join(
    f"CAST(coalesce({c}, 0) = 0 AS INTEGER) AS {p}_zero, "
    f"CAST(coalesce({c} = lag({c}) OVER {_order}, FALSE) AS INTEGER) AS {p}_flat, "
    f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER {_near}) AS {p}_near"
    for c, p in _channels
) + " FROM bal"

CTES["islands"] = "SELECT *, " + ", ".join(
    f"sum(1 - {p}_{k}) OVER {_order} AS {p}_{k}_island"
    for _, p in _channels
    for k in ("zero", "flat")
) + " FROM marks"

CTES["runs"] = "SELECT *, " + ", ".join(
    f"CAST(sum({p}_{k}) OVER (PARTITION BY meter_id, {p}_{k}_island ORDER BY ts) AS INTEGER) AS {p}_{k}_run"
    for _, p in _channels
    for k in ("zero", "flat")
) + ", " + ", ".join(
    f"{quantile(f'{p}_near', 0.25)} AS {p}_q1, {quantile(f'{p}_near', 0.5)} AS {p}_q2, "
    f"{quantile(f'{p}_near', 0.75)} AS {p}_q3"
    for _, p in _channels
) + " FROM islands"

CTES["flagged"] = "SELECT *, " + ", ".join(
    f"{p}_zero_run >= 2 AS {p}_zero_anomaly, {p}_flat_run >= 6 AS {p}_flat_anomaly, "
    f"coalesce(len({p}_near) >= 8 AND {p}_q3 <> {p}_q1 AND "
    f"({c} > {p}_q2 + 3.0 * ({p}_q3 - {p}_q1) OR {c} < {p}_q2 - 3.0 * ({p}_q3 - {p}_q1)), FALSE) AS {p}_spike"
    for c, p in _channels
) + " FROM runs"

_hint = ", ".join(
    [f"CASE WHEN {c} THEN '{text}' END" for c, text in HINTS.items()]
    + [f"CASE WHEN t1 - t2 < 5 THEN '{LOW_DELTA_T_HINT}' END"]
)
QUALITY_COLUMNS = ", ".join(
    f"{p}_{s}"
    for _, p in _channels
    for s in ("zero", "zero_run", "zero_anomaly", "flat", "flat_run", "flat_anomaly", "spike")
)
CTES["proc"] = f"""
SELECT meter_id, ts, day, hour_idx, xvs_m3, gvs_m3, supply_m3, return_m3, t1, t2, weather, weekday,
       series_start, series_end, weekday_norm, rel_diff, diff_m3, flag_over10, {QUALITY_COLUMNS},
       CASE WHEN flag_over10 THEN concat_ws('{HINT_SEPARATOR}', {_hint}) ELSE '' END AS reason_hint
FROM flagged"""

CTES["tail"] = """
SELECT *, from_end <= least(total, 720) AND least(total, 720) - from_end < 696 AS is_train,
       from_end <= 24 AS is_test
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC) AS from_end,
             count(*) OVER (PARTITION BY meter_id) AS total FROM proc)"""

CTES["fit_in"] = """
SELECT meter_id, CAST(coalesce(weekday_norm, isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS how,
       itp, odpu, itp - odpu AS delta,
       CASE WHEN itp IS NOT NULL THEN odpu / greatest(itp, 1e-12) END AS ratio, weather
FROM (SELECT *, CASE WHEN xvs_m3 IS NOT NULL THEN greatest(xvs_m3, 0.0::DOUBLE) END AS itp,
             CASE WHEN gvs_m3 IS NOT NULL THEN greatest(gvs_m3, 0.0::DOUBLE) END AS odpu
      FROM tail WHERE is_train)"""


def _list(c: str) -> str:
    return f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))"


def _mad(values: str, center: str) -> str:
    deviations = f"list_sort(list_transform({values}, lambda dev: abs(dev - {center})))"
    return f"({quantile(deviations, 0.5)} * {dbl(1.4826)} + 1e-6)"


CTES["overall"] = f"""
SELECT meter_id, {_mad('delta', quantile('delta', 0.5))} AS global_sigma_delta,
       {_mad('ratio', quantile('ratio', 0.5))} AS global_sigma_ratio,
       {quantile('weather', 0.5)} AS w_center
FROM (SELECT meter_id, {_list('delta')} AS delta, {_list('ratio')} AS ratio,
             {_list('weather')} AS weather FROM fit_in GROUP BY meter_id)"""

_S = ("itp", "odpu", "delta", "ratio")
CTES["slot_lists"] = "SELECT meter_id, how, " + ", ".join(
    f"{_list(s)} AS l_{s}" for s in _S
) + f""", {_list('weather')} AS l_weather,
    count(weather - w_center) AS n_wc,
    count(*) FILTER (WHERE delta IS NOT NULL AND weather IS NOT NULL) AS n_delta_w,
    count(*) FILTER (WHERE ratio IS NOT NULL AND weather IS NOT NULL) AS n_ratio_w,
    sum((weather - w_center) * delta) AS num_delta,
    sum((weather - w_center) * (weather - w_center)) FILTER (WHERE delta IS NOT NULL) AS den_delta,
    sum((weather - w_center) * ratio) AS num_ratio,
    sum((weather - w_center) * (weather - w_center)) FILTER (WHERE ratio IS NOT NULL) AS den_ratio
FROM fit_in JOIN overall USING (meter_id) GROUP BY meter_id, how"""


def slots_sql(min_points: int) -> str:
    return (
        "SELECT meter_id, how, "
        + ", ".join(f"mu_{s}" for s in _S)
        + ", "
        + ", ".join(f"{_mad(f'l_{s}', f'mu_{s}')} AS sigma_{s}" for s in _S)
        + ", "
        + ", ".join(
            f"{quantile(f'l_{s}', q)} AS {n}_{s}"
            for s in ("delta", "ratio")
            for n, q in (("p_low", 0.05), ("p_high", 0.95))
        )
        + f", CASE WHEN n_wc > 0 THEN {quantile('l_weather', 0.5)} END AS w_med, "
        + ", ".join(
            f"CASE WHEN n_{s}_w >= {min_points} AND den_{s} > 0 THEN num_{s} / den_{s} "
            f"ELSE 0.0::DOUBLE END AS beta_{s}_w"
            for s in ("delta", "ratio")
        )
        + " FROM (SELECT *, "
        + ", ".join(f"{quantile(f'l_{s}', 0.5)} AS mu_{s}" for s in _S)
        + " FROM slot_lists)"
    )


CTES["slots"] = slots_sql(12)
CTES["slots_loose"] = slots_sql(3)

STAT_COLUMNS = (
    *[f"mu_{s}" for s in _S],
    *[f"sigma_{s}" for s in _S],
    "p_low_delta", "p_high_delta", "p_low_ratio", "p_high_ratio",
    "w_med", "beta_delta_w", "beta_ratio_w",
)
_back = "(PARTITION BY meter_id ORDER BY how ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ahead = "(PARTITION BY meter_id ORDER BY how ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
CTES["base168"] = (
    "SELECT meter_id, how, "
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {_back}, "
        f"first_value({c} IGNORE NULLS) OVER {_ahead}) AS {c}"
        for c in STAT_COLUMNS
    )
    + ", global_sigma_delta, global_sigma_ratio FROM "
    "(SELECT meter_id, global_sigma_delta, global_sigma_ratio, "
    "CAST(unnest(range(168)) AS INTEGER) AS how FROM overall) "
    "LEFT JOIN slots USING (meter_id, how)"
)

CTES["found"] = """
SELECT h.*, b.* EXCLUDE (meter_id)
FROM tail h JOIN base168 b ON b.meter_id = h.meter_id
 AND b.how = CAST(coalesce(h.weekday_norm, isodow(h.ts) - 1) * 24 + hour(h.ts) AS INTEGER)"""

CTES["z"] = """
SELECT *, (delta_m3 - (mu_delta + beta_delta_w * w_shift))
            / (CASE WHEN sigma_delta <= 0 THEN global_sigma_delta ELSE sigma_delta END + 1e-9) AS z_delta,
       CASE WHEN ratio IS NULL THEN 0.0::DOUBLE ELSE (ratio - (mu_ratio + beta_ratio_w * w_shift))
            / (CASE WHEN sigma_ratio <= 0 THEN global_sigma_ratio ELSE sigma_ratio END + 1e-9) END AS z_ratio
FROM (SELECT *, coalesce(xvs_m3, 0.0::DOUBLE) AS itp_xvs_m3, coalesce(gvs_m3, 0.0::DOUBLE) AS odpu_gvs_m3,
             coalesce(xvs_m3, 0.0::DOUBLE) - coalesce(gvs_m3, 0.0::DOUBLE) AS delta_m3,
             CASE WHEN coalesce(xvs_m3, 0) > 0
                  THEN coalesce(gvs_m3, 0.0::DOUBLE) / greatest(xvs_m3, 1e-12) END AS ratio,
             coalesce(weather - w_med, 0.0::DOUBLE) AS w_shift
      FROM found)"""

CTES["corridor"] = """
SELECT *, coalesce(delta_m3 < p_low_delta OR delta_m3 > p_high_delta, FALSE)
       OR coalesce(ratio < p_low_ratio OR ratio > p_high_ratio, FALSE) AS corridor_flag
FROM z"""

CTES["decided"] = """
SELECT *, raw_is_anomaly OR severe AS is_anomaly
FROM (SELECT *, ((abs(z_delta) >= 3 OR abs(z_ratio) >= 3.5) AND NOT greatest(itp_xvs_m3, odpu_gvs_m3) < 0.2
                 AND abs(delta_m3) >= 0.15) OR flag_over10 AS raw_is_anomaly,
             abs(z_delta) >= 5 OR abs(z_ratio) >= 5 AS severe,
             coalesce(supply_m3 - return_m3 > 0.1, FALSE) OR coalesce(t1 - t2 < 5, FALSE) AS tech_signal
      FROM corridor)"""


def _g(z: str) -> str:
    return f"(({z}) * ({z}) * -0.5::DOUBLE)"


def _b(flag: str, p: float) -> str:
    return f"(CASE WHEN {flag} THEN ln({dbl(p)}) ELSE ln(1 - {dbl(p)} + 1e-9) END)"


_LOGS = {
    "normal": [_g("abs(z_delta)"), _g("abs(z_ratio)")],
    "leak": [
        _g("greatest(0, z_delta) - 2"), _g("least(0, z_ratio) + 2"),
        _b("NOT itp_xvs_zero_anomaly", 0.9), _b("NOT odpu_gvs_zero_anomaly", 0.9),
    ],
    "odpu_fault": [
        _b("odpu_gvs_flat_anomaly OR odpu_gvs_zero_anomaly", 0.95), _g("greatest(0, z_delta) - 1.5"),
    ],
    "itp_fault": [
        _b("itp_xvs_flat_anomaly OR itp_xvs_zero_anomaly", 0.95), _g("greatest(0, -z_delta) - 1.5"),
    ],
    "tamper": [
        _g("greatest(0, z_ratio) - 2"), _b("NOT itp_xvs_flat_anomaly AND NOT odpu_gvs_flat_anomaly", 0.6),
    ],
    "tech": [_b("tech_signal", 0.8), _b("itp_xvs_spike AND NOT odpu_gvs_spike", 0.7)],
}
CTES["logs"] = "SELECT *, " + ", ".join(
    f"{' + '.join([f'ln({dbl(CAUSE_PRIOR[c])} + 1e-12)', *_LOGS[c]])} AS logp_{c}" for c in CAUSES
) + " FROM decided"

_top_log = "greatest(" + ", ".join(f"logp_{c}" for c in CAUSES) + ")"
_suspects = [c for c in CAUSES if c != "normal"]
CTES["weights"] = "SELECT *, " + ", ".join(
    f"exp(logp_{c} - {_top_log}) / ({' + '.join(f'exp(logp_{k} - {_top_log})' for k in CAUSES)}) AS w_{c}"
    for c in CAUSES
) + " FROM logs"
_mass = " + ".join(f"w_{c}" for c in _suspects)
CTES["posts"] = (
    "SELECT *, CASE WHEN is_anomaly THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p_normal, "
    + ", ".join(
        f"CASE WHEN is_anomaly THEN w_{c} / (CASE WHEN ({_mass}) = 0 THEN 1 ELSE {_mass} END) "
        f"ELSE 0.0::DOUBLE END AS p_{c}"
        for c in _suspects
    )
    + " FROM weights"
)


def top_cause(prefix: str = "p_") -> str:
    best = "greatest(" + ", ".join(f"{prefix}{c}" for c in CAUSES) + ")"
    whens = " ".join(f"WHEN {prefix}{c} = {best} THEN '{c}'" for c in CAUSES)
    return f"(CASE {whens} END)"


CTES["dec"] = (
    f"SELECT *, is_anomaly AS is_anomaly_final, {top_cause()} AS top_cause, "
    f"greatest({', '.join(f'p_{c}' for c in CAUSES)}) AS top_cause_prob FROM posts"
)


def post_sql(source: str, lasting: str) -> str:
    """Final flags, cleaned probabilities and texts of a decision table."""
    final = f"(SELECT * REPLACE ({lasting} AS is_anomaly) FROM {source})"
    cleaned = (
        "SELECT * REPLACE ("
        + ", ".join(
            f"CASE WHEN NOT is_anomaly THEN {1.0 if c == 'normal' else 0.0}::DOUBLE ELSE p_{c} END AS p_{c}"
            for c in CAUSES
        )
        + f") FROM {final}"
    )
    renamed = f"SELECT * REPLACE ({top_cause()} AS top_cause) FROM ({cleaned})"
    return (
        f"SELECT *, {lookup('top_cause', CAUSE_LABEL, repr(UNKNOWN_LABEL))} AS cause_label, "
        f"{lookup('top_cause', CAUSE_RULE, repr(UNKNOWN_LABEL))} AS cause_rule, "
        + ", ".join(f"{rnd(f'p_{c} * 100', 1)} AS pct_{c}" for c in CAUSES)
        + f", is_anomaly AS anomaly FROM ({renamed})"
    )


_last4 = "(PARTITION BY meter_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_last2 = "(PARTITION BY meter_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
LASTING = f"(sum(CAST(raw_is_anomaly AS INTEGER)) OVER {_last4} >= 4 OR severe)"
LASTING_BASIC = f"(sum(CAST(is_anomaly AS INTEGER)) OVER {_last2} >= 2)"
CTES["post_full"] = (
    f"SELECT * REPLACE (is_anomaly AS is_anomaly_final) FROM ({post_sql('dec', LASTING)})"
)
CTES["dec_test"] = "SELECT * FROM dec WHERE is_test"
CTES["post_test"] = (
    f"SELECT * REPLACE (is_anomaly AS is_anomaly_final) FROM ({post_sql('dec_test', LASTING)})"
)
CTES["post_basic"] = post_sql("dec_test", LASTING_BASIC)


def island_sql(source: str) -> str:
    return f"""
SELECT *, max(begun) OVER (PARTITION BY meter_id ORDER BY ts) AS island_start
FROM (SELECT *, CASE WHEN coalesce(is_anomaly = lag(is_anomaly) OVER {_order}
        AND top_cause = lag(top_cause) OVER {_order}
        AND ts - lag(ts) OVER {_order} <= INTERVAL 1 HOUR, FALSE) THEN NULL ELSE ts END AS begun
      FROM {source})"""


CTES["isl_full"] = island_sql("post_full")
CTES["isl_test"] = island_sql("post_test")


def incident_sql(source: str) -> str:
    return f"""
SELECT meter_id, start, "end", hours AS duration_h, cause_en,
       {lookup('cause_en', CAUSE_LABEL, 'cause_en')} AS cause_ru,
       {rnd(quantile('probs', 0.5), 3)} AS confidence, {rnd('total', 4)} AS delta_m3_sum,
       {rnd('total / hours', 4)} AS delta_m3_mean, {rnd('worst', 2)} AS worst_z, hours
FROM (SELECT meter_id, island_start, top_cause AS cause_en, min(ts) AS start, max(ts) AS "end",
             count(*) AS hours, list_sort(list(top_cause_prob)) AS probs, sum(delta_m3) AS total,
             max(abs(z_delta)) AS worst
      FROM {source} WHERE is_anomaly GROUP BY meter_id, island_start, top_cause)
WHERE hours >= 4"""


# Hourly base: unclipped flows, label, calendar.
CTES["base"] = f"""
SELECT p.* REPLACE ({rel_diff('p.gvs_m3', 'p.xvs_m3')} AS rel_diff), p.xvs_m3 - p.gvs_m3 AS delta_m3,
       CASE WHEN p.xvs_m3 IS NOT NULL THEN p.gvs_m3 / greatest(p.xvs_m3, 1e-12) END AS ratio,
       d.is_anomaly_final, coalesce(d.is_anomaly_final, FALSE) AS label,
       CAST(isodow(p.ts) - 1 AS INTEGER) AS dow, CAST(hour(p.ts) AS INTEGER) AS hour,
       CAST((isodow(p.ts) - 1) * 24 + hour(p.ts) AS INTEGER) AS how
FROM proc p LEFT JOIN (SELECT meter_id, ts, is_anomaly_final FROM post_full) d
  ON d.meter_id = p.meter_id AND d.ts = p.ts"""


def _num(c: str) -> str:
    return f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in FLAGS else c


def lag_sql(bases, lags, unit: str, order: str) -> list[str]:
    return [
        f"lag({_num(b)}, {n}) OVER (PARTITION BY meter_id ORDER BY {order}) AS {b}_lag{n}{unit}"
        for b in bases
        for n in lags
    ]


def roll_sql(bases, windows, unit: str, order: str) -> list[str]:
    calls = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    out = []
    for b in bases:
        for w in windows:
            frame = f"(PARTITION BY meter_id ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            for s in STATS:
                value = f"{calls[s]}({_num(b)}) OVER {frame}"
                out.append(
                    f"CASE WHEN count({b}) OVER {frame} >= {max(2, w // 2)} "
                    f"THEN {value} END AS {b}_roll{w}{unit}_{s}"
                )
    return out


LAGS_H = [f"{b}_lag{n}h" for b in HOURLY_BASES for n in P.lags_hours]
ROLLS_H = [f"{b}_roll{w}h_{s}" for b in HOURLY_BASES for w in P.roll_windows_h for s in STATS]
LAGS_D = [f"{b}_lag{n}d" for b in DAILY_BASES for n in P.lags_days]
ROLLS_D = [f"{b}_roll{w}d_{s}" for b in DAILY_BASES for w in P.roll_windows_d for s in STATS]
DIFFS_D = [f"{b}_diff1" for b in DAILY_BASES]

CTES["lagged"] = (
    "SELECT *, " + ", ".join(lag_sql(HOURLY_BASES, P.lags_hours, "h", "ts")) + " FROM base"
)
CTES["rolled"] = (
    "SELECT *, " + ", ".join(roll_sql(HOURLY_BASES, P.roll_windows_h, "h", "ts")) + " FROM base"
)
HORIZONS_H = ", ".join(
    f"lead(CAST(label AS INTEGER), {h}, 0) OVER {_order} AS y_{h}" for h in P.hour_horizons
)
CTES["labels_h"] = f"SELECT *, {HORIZONS_H} FROM base"

CTES["days"] = """
SELECT *, CAST(bad_hours AS DOUBLE) / hours AS bad_hours_share,
       CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(isodow(day) - 1 AS INTEGER) AS dow_cat,
       CAST(row_number() OVER (PARTITION BY meter_id ORDER BY day) - 1 AS INTEGER) AS day_idx,
       sin((isodow(day) - 1) / 7.0::DOUBLE * (2 * pi())) AS week_sin,
       cos((isodow(day) - 1) / 7.0::DOUBLE * (2 * pi())) AS week_cos
FROM (SELECT meter_id, day, coalesce(sum(xvs_m3), 0.0::DOUBLE) AS itp_xvs_m3,
             coalesce(sum(gvs_m3), 0.0::DOUBLE) AS odpu_gvs_m3,
             coalesce(sum(delta_m3), 0.0::DOUBLE) AS delta_m3_sum, avg(delta_m3) AS delta_m3_mean,
             avg(ratio) AS ratio_mean, avg(rel_diff) AS rel_diff_mean, count(*) AS hours,
             count(*) FILTER (WHERE label) AS bad_hours
      FROM base GROUP BY meter_id, day)"""
CTES["day_lab"] = """
SELECT meter_id, day, max(CAST(label AS INTEGER)) AS day_label FROM base GROUP BY meter_id, day"""
CTES["labels_d"] = "SELECT *, " + ", ".join(
    f"lead(day_label, {d}, 0) OVER (PARTITION BY meter_id ORDER BY day) AS y_{d}"
    for d in P.day_horizons
) + " FROM day_lab"


def splits_sql(source: str, order: str, per_day: int) -> str:
    """Two expanding folds by row number within a meter, renumbered after short ones."""
    return f"""
SELECT *, CAST(row_number - 1 AS INTEGER) AS fold FROM (
  SELECT *, dense_rank() OVER (PARTITION BY meter_id ORDER BY block_no) AS row_number FROM (
    SELECT *, CASE WHEN rn < first_test THEN 'train' WHEN rn < first_test + block THEN 'test' END AS role
    FROM (SELECT s.*, f.block_no, n // 3 AS block, n - (2 - f.block_no) * (n // 3) AS first_test
          FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY {order}) - 1 AS rn,
                       count(*) OVER (PARTITION BY meter_id) AS n FROM {source}) s,
               (SELECT unnest([0, 1]) AS block_no) f))
  WHERE role IS NOT NULL AND block > 0 AND (first_test - 1) // {per_day} + 1 >= 5)"""


CTES["splits_h"] = splits_sql("base", "ts", 24)
RAW_FEATURES = [c for c in HOURLY_RAW_FEATURES if c != "odpu_proxy_net"]


def with_ctes(query: str) -> str:
    """Prefix a query with the common tables it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed) + "\n" + query.strip()
