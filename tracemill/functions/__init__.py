from tracemill.functions.addresses import (
    ip_to_number,
    number_to_ip,
    prefix_length,
    prefix_start,
    slash24_number,
    slash24_text,
)
from tracemill.functions.dates import (
    day_start,
    day_text,
    month_start,
    month_text,
    utc_date,
    utc_start,
    utc_year,
)

__all__ = [
    "day_start",
    "day_text",
    "ip_to_number",
    "month_start",
    "month_text",
    "number_to_ip",
    "prefix_length",
    "prefix_start",
    "slash24_number",
    "slash24_text",
    "utc_date",
    "utc_start",
    "utc_year",
]
