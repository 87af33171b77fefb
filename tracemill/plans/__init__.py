from tracemill.plans.analyses import ANALYSES, YEARS, label_dataset, reports, run_analysis
from tracemill.plans.layout import open_by_key, store_by_key
from tracemill.plans.reports import (
    YEARS_AND_ALL,
    degree_dist,
    distribution,
    edge_stats,
    endpoint_stats,
    latency_hist,
    link_stats,
    multihoming,
    overview,
    pair_stats,
    slice_years,
)

__all__ = [
    "ANALYSES",
    "YEARS",
    "YEARS_AND_ALL",
    "degree_dist",
    "distribution",
    "edge_stats",
    "endpoint_stats",
    "label_dataset",
    "latency_hist",
    "link_stats",
    "multihoming",
    "open_by_key",
    "overview",
    "pair_stats",
    "reports",
    "run_analysis",
    "slice_years",
    "store_by_key",
]
