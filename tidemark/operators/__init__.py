"""Table-level operators: DataFrame in, DataFrame out, one row key ``(meter_id, ts)``."""
