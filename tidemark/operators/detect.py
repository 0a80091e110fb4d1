"""Scoring hours against a baseline: z-scores, decisions, cause probabilities.

Scoring needs nothing but the row and its baseline slot, so the same expressions serve batch
frames and streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import scoring as S
from tidemark.functions import time as T
from tidemark.operators.baseline import STATISTICS
from tidemark.params import CAUSE_LABEL, CAUSE_PRIOR, CAUSE_RULE, DEFAULTS, UNKNOWN_LABEL, Params
from tidemark.plans.series import HOURLY, METER, Layout, over_series, window

QUALITY_FLAGS = (
    "itp_xvs_zero_anomaly",
    "odpu_gvs_zero_anomaly",
    "itp_xvs_flat_anomaly",
    "odpu_gvs_flat_anomaly",
    "itp_xvs_spike",
    "odpu_gvs_spike",
)
PROBABILITIES = tuple(f"p_{c}" for c in CAUSE_PRIOR)
DECISION_COLUMNS = (
    METER,
    "ts",
    "itp_xvs_m3",
    "odpu_gvs_m3",
    "delta_m3",
    "ratio",
    "z_delta",
    "z_ratio",
    "raw_is_anomaly",
    "severe",
    "is_anomaly",
    "is_anomaly_final",
    "top_cause",
    "top_cause_prob",
    *PROBABILITIES,
)


def _false_if_missing(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def baseline_lookup(hours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Attach the baseline slot of every hour.

    The baseline has 168 rows per meter and grows with the fleet, so there is no broadcast hint:
    Spark broadcasts it while its measured size is below the session's threshold and joins on the
    evenly distributed key (meter, hour of week) beyond. Of a baseline in versions (``valid_from``,
    ``valid_to``) an hour gets the one that is valid at that hour.
    """
    weekday = F.col("weekday_norm") if "weekday_norm" in hours.columns else F.lit(None)
    slots = baseline.select(METER, "how", *STATISTICS, "global_sigma_delta", "global_sigma_ratio")
    located = hours.withColumn("how", T.hour_of_week(weekday, F.col("ts")))
    if "valid_from" not in baseline.columns:
        return located.join(slots, [METER, "how"], "left")
    dated = baseline.select(
        F.col(METER).alias("_meter"), F.col("how").alias("_how"),
        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *slots.columns[2:],
    )
    valid = (F.col("ts") >= F.col("_from")) & F.coalesce(F.col("ts") < F.col("_to"), F.lit(True))
    same = (F.col(METER) == F.col("_meter")) & (F.col("how") == F.col("_how"))
    return located.join(dated, same & valid, "left").drop("_meter", "_how", "_from", "_to")


def zscores(looked_up: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Difference and ratio of an hour and their distance from the weather-adjusted medians.

    Missing flows count as 0 here and nothing is clipped; the ratio is missing without inflow.
    """
    xvs, gvs = (F.coalesce(c, F.lit(0.0)) for c in (F.col("xvs_m3"), F.col("gvs_m3")))
    weather = (F.col("weather") if "weather" in looked_up.columns else F.lit(None)).cast("double")
    flows = looked_up.withColumns(
        {
            "itp_xvs_m3": xvs,
            "odpu_gvs_m3": gvs,
            "delta_m3": xvs - gvs,
            "ratio": F.when(xvs > 0, gvs / F.greatest(xvs, F.lit(params.eps))),
            "_w_shift": F.coalesce(weather - F.col("w_med"), F.lit(0.0)),
        }
    )

    def sigma(name: str) -> Column:
        local = F.col(f"sigma_{name}")
        return F.when(local <= 0, F.col(f"global_sigma_{name}")).otherwise(local)

    def mu(name: str) -> Column:
        return F.col(f"mu_{name}") + F.col(f"beta_{name}_w") * F.col("_w_shift")

    z_ratio = (F.col("ratio") - mu("ratio")) / (sigma("ratio") + params.z_eps)
    return flows.withColumns(
        {
            "z_delta": (F.col("delta_m3") - mu("delta")) / (sigma("delta") + params.z_eps),
            "z_ratio": F.when(F.col("ratio").isNull(), F.lit(0.0)).otherwise(z_ratio),
        }
    ).drop("_w_shift")


def outside_corridor() -> Column:
    """True where difference or ratio leaves the quantile range of its baseline slot."""
    outside = [
        (F.col(v) < F.col(f"p_low_{s}")) | (F.col(v) > F.col(f"p_high_{s}"))
        for v, s in (("delta_m3", "delta"), ("ratio", "ratio"))
    ]
    complete = [
        F.col(f"p_low_{s}").isNotNull() & F.col(f"p_high_{s}").isNotNull()
        for s in ("delta", "ratio")
    ]
    return reduce(
        lambda a, b: a | b, [_false_if_missing(c & o) for c, o in zip(complete, outside)]
    )


def quantile_corridor(scored: DataFrame) -> DataFrame:
    return scored.withColumn("corridor_flag", outside_corridor())


def anomaly_decision(scored: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``raw_is_anomaly``, ``severe`` and their union.

    An hour over the balance limit is raw-anomalous by itself; z-scores need enough flow and
    enough difference. A severe z-score always counts.
    """
    z_delta, z_ratio = F.abs("z_delta"), F.abs("z_ratio")
    low_flow = F.greatest("itp_xvs_m3", "odpu_gvs_m3") < params.min_flow_m3h
    enter = (z_delta >= params.z_delta_enter) | (z_ratio >= params.z_ratio_enter)
    if params.use_quantile_corridor:
        enter = _false_if_missing(enter) | outside_corridor()
    large = F.abs("delta_m3") >= params.min_abs_delta_m3
    over = _false_if_missing(F.col("flag_over10")) if "flag_over10" in scored.columns else F.lit(False)
    severe = (z_delta >= params.z_severe) | (z_ratio >= params.z_severe)
    return scored.withColumns(
        {
            "raw_is_anomaly": _false_if_missing(enter & ~low_flow & large) | over,
            "severe": _false_if_missing(severe),
        }
    ).withColumn("is_anomaly", F.col("raw_is_anomaly") | F.col("severe"))


def tech_signal(columns: list[str], params: Params = DEFAULTS) -> Column:
    """Recirculation (supply above return) or a small temperature difference."""
    signals = [F.lit(False)]
    if {"supply_m3", "return_m3"} <= set(columns):
        signals.append(F.col("supply_m3") - F.col("return_m3") > params.recirculation_min_m3)
    if {"t1", "t2"} <= set(columns):
        signals.append(F.col("t1") - F.col("t2") < params.low_delta_t)
    return reduce(lambda a, b: a | b, [_false_if_missing(s) for s in signals])


def cause_log_scores(columns: list[str], params: Params = DEFAULTS) -> dict[str, Column]:
    """Unnormalised log-posterior of every hypothesis."""
    z1, z2, zero = F.col("z_delta"), F.col("z_ratio"), F.lit(0.0)
    flags = {
        f: _false_if_missing(F.col(f)) if f in columns else F.lit(False) for f in QUALITY_FLAGS
    }
    xvs_zero, gvs_zero, xvs_flat, gvs_flat, xvs_spike, gvs_spike = (
        flags[f] for f in QUALITY_FLAGS
    )
    g, b = S.gaussian_term, S.bernoulli_term
    terms = {
        "normal": [g(F.abs(z1)), g(F.abs(z2))],
        "leak": [
            g(F.greatest(zero, z1) - 2.0),
            g(F.least(zero, z2) + 2.0),
            b(~xvs_zero, 0.9),
            b(~gvs_zero, 0.9),
        ],
        "odpu_fault": [b(gvs_flat | gvs_zero, 0.95), g(F.greatest(zero, z1) - 1.5)],
        "itp_fault": [b(xvs_flat | xvs_zero, 0.95), g(F.greatest(zero, -z1) - 1.5)],
        "tamper": [g(F.greatest(zero, z2) - 2.0), b(~xvs_flat & ~gvs_flat, 0.6)],
        "tech": [b(tech_signal(columns, params), 0.8), b(xvs_spike & ~gvs_spike, 0.7)],
    }
    return {
        cause: reduce(lambda total, term: total + term, terms[cause], S.log_prior(prior))
        for cause, prior in CAUSE_PRIOR.items()
    }


def cause_scores(decided: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add one ``logp_*`` column per hypothesis."""
    logs = cause_log_scores(decided.columns, params)
    return decided.withColumns({f"logp_{c}": v for c, v in logs.items()})


def cause_posteriors(scored: DataFrame) -> DataFrame:
    """Probabilities from ``logp_*``: all weight on "normal" for a normal hour, none otherwise."""
    weights = S.softmax({c: F.col(f"logp_{c}") for c in CAUSE_PRIOR})
    soft = scored.withColumns({f"_w_{c}": w for c, w in weights.items()})
    suspects = [c for c in CAUSE_PRIOR if c != "normal"]
    mass = reduce(lambda a, b: a + b, [F.col(f"_w_{c}") for c in suspects])
    soft = soft.withColumn("_mass", F.when(mass == 0, F.lit(1.0)).otherwise(mass))
    anomalous = F.col("is_anomaly")
    out = soft.withColumns(
        {
            "p_normal": F.when(anomalous, 0.0).otherwise(1.0),
            **{
                f"p_{c}": F.when(anomalous, F.col(f"_w_{c}") / F.col("_mass")).otherwise(0.0)
                for c in suspects
            },
        }
    )
    return out.drop("_mass", *[f"_w_{c}" for c in CAUSE_PRIOR], *[f"logp_{c}" for c in CAUSE_PRIOR])


def top_cause() -> Column:
    return S.first_largest({c: F.col(f"p_{c}") for c in CAUSE_PRIOR})


def decide_hours(hours: DataFrame, baseline: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Score and decide; keeps the columns of ``hours`` next to the decision."""
    scored = zscores(baseline_lookup(hours, baseline), params)
    decided = cause_posteriors(cause_scores(anomaly_decision(scored, params), params))
    return decided.withColumns(
        {
            "is_anomaly_final": F.col("is_anomaly"),
            "top_cause": top_cause(),
            "top_cause_prob": F.greatest(*PROBABILITIES),
        }
    )


def detect_hours(hours: DataFrame, baseline: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The decision record of every hour."""
    return decide_hours(hours, baseline, params).select(*DECISION_COLUMNS)


def persistent(flag: Column, hours: int, order) -> Column:
    """True where the flag held for the last ``hours`` hours, this one included."""
    return F.sum(flag.cast("int")).over(order.rowsBetween(1 - hours, 0)) >= hours


def persistence_filter(
    decisions: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """Final flag: persistent raw anomalies and severe hours."""
    hours = max(params.min_duration_h, 1)
    layout = layout.needing(before=hours - 1)

    def body(parts: DataFrame) -> DataFrame:
        lasting = persistent(F.col("raw_is_anomaly"), hours, window(layout))
        return parts.withColumn("is_anomaly_final", lasting | F.col("severe")).withColumn(
            "is_anomaly", F.col("is_anomaly_final")
        )

    return over_series(decisions, layout, body)


def persistence_filter_basic(
    decisions: DataFrame, params: Params = DEFAULTS, layout: Layout = HOURLY
) -> DataFrame:
    """The plain variant: a shorter run of ``is_anomaly``, severe hours not exempt."""
    hours = params.basic_min_duration_h
    if hours <= 1:
        return decisions
    layout = layout.needing(before=hours - 1)

    def body(parts: DataFrame) -> DataFrame:
        return parts.withColumn(
            "is_anomaly", persistent(F.col("is_anomaly"), hours, window(layout))
        )

    return over_series(decisions, layout, body)


def lookup_text(code: Column, texts: dict[str, str], default: Column) -> Column:
    """Translate a code by a fixed table."""
    pairs = F.create_map(*[F.lit(x) for item in texts.items() for x in item])
    return F.coalesce(F.element_at(pairs, code), default)


def cause_texts(decisions: DataFrame) -> DataFrame:
    """Label and rule text of the top cause."""
    return decisions.withColumns(
        {
            "cause_label": lookup_text(F.col("top_cause"), CAUSE_LABEL, F.lit(UNKNOWN_LABEL)),
            "cause_rule": lookup_text(F.col("top_cause"), CAUSE_RULE, F.lit(UNKNOWN_LABEL)),
        }
    )


def reset_cleared(decisions: DataFrame) -> DataFrame:
    """Move all probability of cleared hours to "normal" and name the top cause again.

    ``top_cause_prob`` keeps the value of the scoring step.
    """
    cleared = ~F.col("is_anomaly")
    return decisions.withColumns(
        {
            p: F.when(cleared, 1.0 if p == "p_normal" else 0.0).otherwise(F.col(p))
            for p in PROBABILITIES
        }
    ).withColumn("top_cause", top_cause())


def decision_postprocess(
    decisions: DataFrame,
    params: Params = DEFAULTS,
    layout: Layout = HOURLY,
    *,
    basic: bool = False,
) -> DataFrame:
    """Persistence, cleaned probabilities, percentages and texts."""
    keep = persistence_filter_basic if basic else persistence_filter
    final = cause_texts(reset_cleared(keep(decisions, params, layout)))
    return final.withColumns(
        {
            **{
                f"pct_{c}": N.round_half_even(F.col(f"p_{c}") * 100, 1) for c in CAUSE_PRIOR
            },
            "anomaly": F.col("is_anomaly"),
        }
    )


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The newest decision of every meter, rounded for display."""
    newest = decisions.groupBy(METER).agg(
        F.max_by(
            F.struct(
                "ts", "is_anomaly", "top_cause", "top_cause_prob",
                "delta_m3", "ratio", "z_delta", "z_ratio",
            ),
            "ts",
        ).alias("d")
    )
    return newest.select(
        METER,
        F.col("d.ts").alias("ts"),
        F.col("d.is_anomaly").alias("is_anomaly"),
        lookup_text(F.col("d.top_cause"), CAUSE_LABEL, F.col("d.top_cause")).alias("top_cause"),
        N.round_half_even(F.col("d.top_cause_prob"), 3).alias("top_cause_prob"),
        N.round_half_even(F.col("d.delta_m3"), 4).alias("delta_m3"),
        N.round_half_even(F.col("d.ratio"), 4).alias("ratio"),
        N.round_half_even(F.col("d.z_delta"), 2).alias("z_delta"),
        N.round_half_even(F.col("d.z_ratio"), 2).alias("z_ratio"),
    )
