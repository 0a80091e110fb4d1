"""Parameters and fixed values shared by every operator.

``Params`` is immutable: derive a variant with ``dataclasses.replace`` instead of mutating a
shared configuration.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (they have to match the published rule set for equal results)
# ---------------------------------------------------------------------------

# Hypotheses about an hour, in the order that breaks ties, with their prior probabilities.
CAUSE_PRIOR = {
    "normal": 0.70,
    "leak": 0.10,
    "odpu_fault": 0.06,
    "itp_fault": 0.06,
    "tamper": 0.04,
    "tech": 0.04,
}

CAUSE_LABEL = {
    "normal": "Норма",
    "leak": "Утечка",
    "odpu_fault": "Неисправность ОДПУ",
    "itp_fault": "Неисправность ИТП",
    "tamper": "Вмешательство",
    "tech": "Техпроцесс",
}

CAUSE_RULE = {
    "normal": "Отклонения в пределах ожидаемых, z-оценки малы.",
    "leak": "XVS > GVS (положительный Δ), низкое GVS/XVS, без нулевых/плоских участков.",
    "odpu_fault": "Плоские/нулевые показания ГВС, большой положительный Δ.",
    "itp_fault": "Плоские/нулевые показания ХВС, отрицательный Δ.",
    "tamper": "Подозрительно высокий GVS/XVS без плоских участков.",
    "tech": "Рециркуляция (Подача>Обратка) или низкий ΔT + всплеск ХВС.",
}

# Explanations attached to an over-limit hour, in print order.
HINTS = {
    "itp_xvs_zero_anomaly": "ИТП-ХВС нули",
    "odpu_gvs_zero_anomaly": "ОДПУ-ГВС нули",
    "itp_xvs_spike": "ИТП-ХВС скачок",
    "odpu_gvs_spike": "ОДПУ-ГВС скачок",
    "itp_xvs_flat_anomaly": "ИТП-ХВС застой",
    "odpu_gvs_flat_anomaly": "ОДПУ-ГВС застой",
}
LOW_DELTA_T_HINT = "малый дельта T — возможна рециркуляция/подпитка"
HINT_SEPARATOR = "; "
UNKNOWN_LABEL = "—"

# Column headers of the delivered CSV files.
CSV_HEADERS = {
    "Дата": "date_raw",
    "Время суток, ч": "hour_raw",
    "Подача, м3": "supply_m3",
    "Обратка, м3": "return_m3",
    "Потребление за период, м3 ГВС": "gvs_m3",
    "Потребление за период, м3 ХВС": "xvs_m3",
    "T1 гвс, оС": "t1",
    "T2 гвс, оС": "t2",
    "Погода": "weather",
    "День недели": "weekday",
}


@dataclass(frozen=True)
class Params:
    """Every tunable of the engine with its default."""

    # Detection windows, in days.
    train_days: int = 29
    test_days: int = 1

    # Unit factors per channel.
    xvs_factor: float = 1.0
    gvs_factor: float = 1.0
    supply_factor: float = 1.0
    return_factor: float = 1.0

    # Balance and channel quality.
    rel_diff_limit: float = 0.10
    zero_anomaly_hours: int = 2
    flatline_hours: int = 6
    spike_iqr_k: float = 3.0
    spike_window_hours: int = 24
    spike_min_values: int = 8
    low_delta_t: float = 5.0
    eps: float = 1e-12

    # Baseline.
    mad_scale: float = 1.4826
    sigma_floor: float = 1e-6
    beta_min_points: int = 12
    q_low: float = 0.05
    q_high: float = 0.95

    # Detector.
    use_quantile_corridor: bool = False
    min_flow_m3h: float = 0.2
    min_abs_delta_m3: float = 0.15
    z_delta_enter: float = 3.0
    z_ratio_enter: float = 3.5
    z_severe: float = 5.0
    z_eps: float = 1e-9
    recirculation_min_m3: float = 0.1

    # Persistence and incidents.
    min_duration_h: int = 4
    basic_min_duration_h: int = 2
    incident_gap_h: int = 1

    # Labels, horizons and features.
    use_online_labels: bool = True
    hour_horizons: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    day_horizons: tuple[int, ...] = (1, 2, 3)
    lags_hours: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    roll_windows_h: tuple[int, ...] = (2, 3, 4, 6)
    lags_days: tuple[int, ...] = (1, 2)
    roll_windows_d: tuple[int, ...] = (2, 3)

    # Backtests and models.
    n_splits: int = 2
    min_train_days: int = 5
    min_train_days_daily: int = 5
    feature_shift: str = "horizon"  # "horizon" shifts features by h as well, "none" leaves them
    model_name: str = "gbt"
    weight_negative: float = 1.0
    weight_positive: float = 3.0
    threshold: float = 0.5
    max_depth: int = 6
    step_size: float = 0.05
    max_iter: int = 20
    validation_share: float = 0.2  # held-out tail of every series; 0 trains on all rows
    validation_tol: float = 0.01  # boosting stops when a round improves the held-out loss by less
    seed: int = 42


DEFAULTS = Params()
