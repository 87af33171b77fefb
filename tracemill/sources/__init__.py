from tracemill.sources.ipmap import normalise_cidr, parse_ip_map, read_ip_map
from tracemill.sources.parts import read_parts, write_part
from tracemill.sources.prefixes import flatten_prefixes, parse_prefix_map, read_prefix_map
from tracemill.sources.sinks import write_report
from tracemill.sources.traces import (
    DATASETS,
    account_lines,
    check_lines,
    clean_lines,
    line_counts,
    parse_lines,
    read_lines,
    read_traces,
    split_checked,
    trace_headers,
)

__all__ = [
    "DATASETS",
    "account_lines",
    "check_lines",
    "clean_lines",
    "flatten_prefixes",
    "line_counts",
    "normalise_cidr",
    "parse_ip_map",
    "parse_lines",
    "parse_prefix_map",
    "read_ip_map",
    "read_lines",
    "read_parts",
    "read_prefix_map",
    "read_traces",
    "split_checked",
    "trace_headers",
    "write_part",
    "write_report",
]
