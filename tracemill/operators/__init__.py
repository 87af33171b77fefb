from tracemill.operators.floor_join import floor_lookup, label_addresses
from tracemill.operators.labelling import (
    compress,
    explode_hops,
    label_coverage,
    label_hops,
    label_traces,
)
from tracemill.operators.path_store import read_prevalence, write_paths
from tracemill.operators.paths import (
    hop_efficiency,
    join_pieces,
    links,
    path_counts,
    path_cycles,
    path_efficiency,
    path_prevalence,
    path_strings,
    path_timeline,
)
from tracemill.operators.rollups import rollup_slash24, rollup_time
from tracemill.operators.stats import (
    cdf,
    correlation,
    moment_table,
    moments,
    percentiles,
    stat3,
    stat6,
    value_stats,
    wide_stats,
)
from tracemill.operators.value_counts import count_cdf, count_histogram, count_stats, merge_counts, value_counts

__all__ = [
    "cdf",
    "compress",
    "correlation",
    "count_cdf",
    "count_histogram",
    "count_stats",
    "explode_hops",
    "floor_lookup",
    "hop_efficiency",
    "join_pieces",
    "label_addresses",
    "label_coverage",
    "label_hops",
    "label_traces",
    "links",
    "merge_counts",
    "moment_table",
    "moments",
    "path_counts",
    "path_cycles",
    "path_efficiency",
    "path_prevalence",
    "path_strings",
    "path_timeline",
    "percentiles",
    "read_prevalence",
    "rollup_slash24",
    "rollup_time",
    "stat3",
    "stat6",
    "value_counts",
    "value_stats",
    "wide_stats",
    "write_paths",
]
