from cdcmart.functions.columns import (
    composite_key,
    epoch_day,
    json_bool,
    pct,
    template,
    typed,
    v_falsy,
    v_get,
    v_present,
    v_str,
    v_type,
)

__all__ = [
    "composite_key",
    "epoch_day",
    "json_bool",
    "pct",
    "template",
    "typed",
    "v_falsy",
    "v_get",
    "v_present",
    "v_str",
    "v_type",
]
