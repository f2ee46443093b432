from flowsentry.functions.scalar import (  # noqa: F401
    band, clean_numeric, coerce_zero, error_match, iso_label, map_values,
    percent, verdict, window_id,
)
