"""SQL counterparts of the registered queries, written against the given tables only.

Shared building blocks: ``hops`` (one row per hop), ``found`` (hops with both labels, by ASOF join),
``lt`` (one row per trace), ``runs`` (one row per run of equal labels) and ``link`` (one row per border).
Percentiles count ranks by the definition: the smallest rank that reaches an added-up probability.
"""

from __future__ import annotations

SHIFT = "-25.0"
SCALE = "0.7071067811865476::DOUBLE"
SIX = (25, 50, 75, 90, 95, 99)


def _address(block: str, low: str = "0") -> str:
    return f"(16777216 + (({block}) * 65536 + {low}) % 4278190080)"


def _ip_text(ip: str) -> str:
    parts = [f"CAST(({ip} >> {bits}) & 255 AS VARCHAR)" for bits in (24, 16, 8, 0)]
    return "(" + " || '.' || ".join(parts) + ")"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def _hops(shift: str = "0.0") -> str:
    return f"""raw AS (
  SELECT l_orderkey, {_address('l_suppkey', 'l_partkey % 256')} AS ip,
    row_number() OVER w - 1 AS pos, sum(l_quantity) OVER w + ({shift}) AS lat
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hops AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, pos, ip, lat, o_orderdate AS day,
    CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y%m') AS month,
    CAST(o_custkey AS VARCHAR) AS region, o_orderstatus AS status, o_orderpriority AS priority,
    last_value(ip) OVER t AS last_ip, last_value(lat) OVER t AS e2e, count(*) OVER t AS raw_hops
  FROM raw JOIN orders ON l_orderkey = o_orderkey
  WINDOW t AS (PARTITION BY l_orderkey ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


SUPPLIERS = """suppliers AS (
  SELECT s_suppkey, s_acctbal, 'AS' || s_suppkey AS as_no, upper(n_name) || '@' || upper(r_name) AS geo,
    translate(n_name, ' ', '_') AS city, translate(r_name, ' ', '_') AS code
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _found(shift: str = "0.0", offset: int = 0) -> str:
    return f"""{_hops(shift)}, {SUPPLIERS},
ip_map AS (
  SELECT {_address(f's_suppkey * 4 + {offset}')} AS range_start,
    arg_max(as_no, s_suppkey) AS as_no, arg_max(geo, s_suppkey) AS geo
  FROM suppliers GROUP BY 1),
found AS (
  SELECT h.*, m.as_no, m.geo FROM hops h ASOF LEFT JOIN ip_map m ON h.ip >= m.range_start)"""


def _lt(level: str, endpoint: str | None = None, shift: str = "0.0") -> str:
    label = {"as": "as_no", "geo": "geo"}
    lbl, end = label[level], label[endpoint or level]
    return f"""{_found(shift)},
stepped AS (
  SELECT *, {lbl} AS lbl, lag({lbl}) OVER w AS lbl_before, lag(lat) OVER w AS lat_before
  FROM found WINDOW w AS (PARTITION BY trace_id ORDER BY pos)),
runs AS (
  SELECT *, row_number() OVER r AS k, lag(lbl) OVER r AS run_before,
    CASE WHEN lag(pos) OVER r = 0 THEN 0.0 ELSE lag(lat) OVER r END AS entered
  FROM stepped WHERE pos = 0 OR lbl <> lbl_before
  WINDOW r AS (PARTITION BY trace_id ORDER BY pos)),
seg AS (
  SELECT trace_id, 2 * (k - 2) AS idx, lat_before - entered AS lat FROM runs WHERE k > 1
  UNION ALL SELECT trace_id, 2 * (k - 2) + 1, lat - lat_before FROM runs WHERE k > 1
  UNION ALL SELECT trace_id, 2 * (max(k) - 1),
    any_value(e2e) - CASE WHEN max(k) = 1 THEN 0.0 ELSE arg_max(lat, k) END FROM runs GROUP BY trace_id),
seg_of AS (
  SELECT trace_id, list(lat ORDER BY idx) AS segs,
    coalesce(sum(lat) FILTER (idx % 2 = 0), 0.0) AS inside FROM seg GROUP BY trace_id),
path_of AS (
  SELECT trace_id, list(lbl ORDER BY k) AS labels, list(pos ORDER BY k) AS starts, max(k) AS num_hops
  FROM runs GROUP BY trace_id),
ends AS (
  SELECT trace_id, any_value(month) AS month, any_value(year) AS year, any_value(region) AS from_ip,
    arg_min({end}, pos) AS src, arg_max({end}, pos) AS dst, any_value(raw_hops) AS raw_hops,
    any_value(e2e) AS e2e, bool_or(lat < 0) AS has_negative FROM found GROUP BY trace_id),
lt AS (
  SELECT e.*, p.labels, p.starts, CAST(p.num_hops AS INTEGER) AS num_hops, s.segs,
    array_to_string(p.labels, '-') AS path, 100 * s.inside / nullif(e.e2e, 0) AS inside_pct
  FROM ends e JOIN path_of p USING (trace_id) JOIN seg_of s USING (trace_id)),
link AS (
  SELECT trace_id, year, run_before || ' ' || lbl AS link, run_before AS link_src, lbl AS link_dst,
    lat - lat_before AS lat FROM runs WHERE k > 1)"""


def _moments(value: str, prefix: str = "") -> str:
    cv = f"CASE WHEN avg({value}) <= 0 THEN 0.0 ELSE stddev_pop({value}) / avg({value}) END"
    return ", ".join(
        [
            _r(f"avg({value})", f"{prefix}avg"),
            _r(f"stddev_pop({value})", f"{prefix}stdev"),
            _r(cv, f"{prefix}cv"),
        ]
    )


# Probabilities of the distribution points, by adding the step up.
POINTS = """added AS (
  SELECT n, 1 AS k, 1.0::DOUBLE / n AS p, 1.0::DOUBLE / n AS step FROM range(1, 100) t(n)
  UNION ALL SELECT n, k + 1, p + step, step FROM added WHERE k < n),
small AS (
  SELECT n, k, floor(p * 100 + 0.5) / 100 AS prob FROM added
  UNION ALL SELECT n, 0, 0.0 FROM range(1, 100) t(n)),
hundred AS (
  SELECT 1 AS k, 0.01::DOUBLE AS p UNION ALL SELECT k + 1, p + 0.01::DOUBLE FROM hundred WHERE k < 100)"""


def _stats(source: str, keys: list[str], value: str, name: str) -> str:
    """CTE ``name``: keys, n and the six statistics of ``value``, percentiles included."""
    on = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    big = ", ".join(
        f"""min(v) FILTER (rn / n::DOUBLE >= (SELECT p FROM hundred WHERE k = {p})
      OR abs(rn / n::DOUBLE - (SELECT p FROM hundred WHERE k = {p})) < 1e-6) AS b{p}"""
        for p in SIX
    )
    few = ", ".join(
        f"""max(lo.v + (hi.v - lo.v) / (hi.prob - lo.prob) * ({p / 100} - lo.prob))
      FILTER (hi.prob >= {p / 100} AND lo.prob < {p / 100}) AS f{p}"""
        for p in SIX
    )
    picked = ", ".join(f"CASE WHEN n >= 100 THEN b{p} ELSE f{p} END AS p{p}" for p in SIX)
    return f"""{name}_v AS (
  SELECT {on}, CAST({value} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {on} ORDER BY {value}) AS rn,
    count(*) OVER (PARTITION BY {on}) AS n FROM {source} WHERE {value} IS NOT NULL),
{name}_m AS (
  SELECT {on}, any_value(n) AS n, min(v) AS min, max(v) AS max, avg(v) AS avg, stddev_pop(v) AS stdev,
    CASE WHEN avg(v) <= 0 THEN 0.0 ELSE stddev_pop(v) / avg(v) END AS cv, {big}
  FROM {name}_v GROUP BY {on}),
{name}_c AS (
  SELECT {', '.join('x.' + k for k in keys)}, s.k, s.prob, x.v
  FROM {name}_v x JOIN small s ON s.n = x.n AND s.k = x.rn
  UNION ALL SELECT {on}, 0, 0.0, 0.0 FROM {name}_m WHERE n < 100),
{name}_f AS (
  SELECT {', '.join('hi.' + k for k in keys)}, {few}
  FROM {name}_c hi JOIN {name}_c lo ON {same('hi', 'lo')} AND lo.k = hi.k - 1 GROUP BY ALL),
{name} AS (
  SELECT m.* EXCLUDE ({', '.join(f'b{p}' for p in SIX)}), {picked}
  FROM {name}_m m LEFT JOIN {name}_f f ON {same('m', 'f')})"""


STATS = ["min", "max", "avg", "stdev", "cv", *[f"p{p}" for p in SIX]]


def _stat_columns(table: str, prefix: str = "") -> str:
    return ", ".join(_r(f"{table}.{s}", f"{prefix}{s}") for s in STATS)


def _prevalence(keys: list[str]) -> str:
    """CTEs ``path_counts``, ``changed`` and ``prev``."""
    on = ", ".join(keys)
    return f"""path_counts AS (SELECT {on}, path, count(*) AS c FROM lt GROUP BY ALL),
main AS (
  SELECT {on}, max(c) / sum(c)::DOUBLE AS prevalence, count(*) AS num_paths,
    list(path ORDER BY c DESC, path)[1] AS dominant_path FROM path_counts GROUP BY {on}),
ordered AS (
  SELECT {on}, path, lag(path) OVER (PARTITION BY {on} ORDER BY month, trace_id) AS path_before FROM lt),
changed AS (
  SELECT {on}, count(*) FILTER (path <> path_before) AS num_changes FROM ordered GROUP BY {on}),
prev AS (SELECT * FROM main JOIN changed USING ({on}))"""


def _pairs(
    level: str, endpoint: str | None, keys: list[str], having: str = "TRUE", prevalence: bool = True
) -> str:
    metrics = {"latency": "e2e", "hops": "num_hops", "raw_hops": "raw_hops"}
    on = ", ".join(keys)
    tables = ", ".join(_stats("lt", keys, column, f"s_{m}") for m, column in metrics.items())
    extra = f", {_prevalence(keys)}" if prevalence else ""
    more = f", {_r('prevalence', 'prevalence')}, num_changes, num_paths, dominant_path" if prevalence else ""
    joined = f" JOIN prev USING ({on})" if prevalence else ""
    return f"""WITH RECURSIVE {POINTS}, {_lt(level, endpoint)}, {tables}{extra}
SELECT {on}, s_latency.n, {', '.join(_stat_columns(f's_{m}', f'{m}_') for m in metrics)}{more}
FROM s_latency JOIN s_hops USING ({on}) JOIN s_raw_hops USING ({on}){joined}
WHERE s_latency.n >= 1 AND {having}"""


def _edges() -> str:
    keys = ["year", "from_ip", "dst"]
    on = ", ".join(keys)
    share = lambda seg: f"{seg} / nullif(e2e, 0) * 100"
    metrics = {
        "latency": "e2e",
        "first_inside": share("segs[1]"),
        "first_link": share("segs[2]"),
        "last_link": share("segs[-2]"),
        "last_inside": share("segs[-1]"),
        "inside": "inside_pct",
    }
    cols = ", ".join(f"{expr} AS v_{m}" for m, expr in metrics.items())
    tables = ", ".join(_stats("crossing", keys, f"v_{m}", f"s_{m}") for m in metrics)
    joins = " ".join(f"LEFT JOIN s_{m} USING ({on})" for m in list(metrics)[1:])
    return f"""WITH RECURSIVE {POINTS}, {_lt('as', 'geo', SHIFT)},
eligible AS (SELECT {on} FROM lt GROUP BY {on} HAVING min(num_hops) > 1),
crossing AS (SELECT {on}, {cols} FROM lt SEMI JOIN eligible USING ({on})), {tables}
SELECT {on}, s_latency.n, {', '.join(_stat_columns(f's_{m}', f'{m}_') for m in metrics)}
FROM s_latency {joins}"""


def _link_stats(level: str) -> str:
    keys = ["year", "link_src", "link_dst"]
    return f"""WITH RECURSIVE {POINTS}, {_lt(level)}, {_stats('link', keys, 'lat', 's')}
SELECT year, link_src, link_dst, link_src || ' ' || link_dst AS link, n, {_stat_columns('s')} FROM s"""


def _compress(level: str) -> str:
    first = "[0] || " if level == "as" else ""
    return f"""WITH {_lt(level)}
SELECT trace_id, month, year, from_ip, src, dst, array_to_string(labels, ' ') AS hops,
  array_to_string(segs, ' ') AS segment_lats,
  array_to_string({first}starts[2:] || [raw_hops], ' ') AS hop_indices,
  num_hops, CAST(raw_hops AS INTEGER) AS raw_hops, {_r('e2e', 'e2e')}, has_negative,
  {_r('inside_pct', 'inside_pct')} FROM lt"""


def _endpoint_stats(level: str, endpoint: str | None, side: str) -> str:
    return f"""WITH {_lt(level, endpoint)}
SELECT year, {side}, count(*) AS n, {_moments('e2e', 'latency_')}, {_moments('num_hops', 'hops_')}
FROM lt GROUP BY year, {side}"""


def _overview(slices: str, where: str = "TRUE", level: str = "as") -> str:
    select = f"{slices}, " if slices else ""
    group = f" GROUP BY {slices}" if slices else ""
    return f"""WITH {_lt(level)}
SELECT {select}count(*) AS n, CAST(sum(num_hops) // count(*) AS BIGINT) AS avg_hops,
  CAST(sum(raw_hops) // count(*) AS BIGINT) AS avg_raw_hops, {_r('avg(e2e)', 'avg_latency')}
FROM lt WHERE {where}{group}"""


def _floor_join() -> str:
    return f"""WITH {_found(offset=8)}
SELECT trace_id, CAST(pos AS INTEGER) AS pos, ip, as_no, geo FROM found"""


def _entropy(source: str, keys: str, item: str, columns: str) -> str:
    return f"""counts AS (SELECT {keys}, {item} AS item, count(*) AS c FROM {source} GROUP BY ALL),
shares AS (SELECT *, c / sum(c) OVER (PARTITION BY {keys})::DOUBLE AS p FROM counts),
entropies AS (SELECT {keys}, -sum(p * ln(p)) AS h, count(*) AS k FROM shares GROUP BY {keys})
SELECT {keys}, {columns} FROM entropies"""


def _words(ip: str, tail: str = ".25") -> str:
    return f"string_agg({ip} || ' ' || CAST(CAST(lat AS BIGINT) AS VARCHAR) || '{tail}', ' ' ORDER BY pos)"


def _lines(shift: str = "0.0", ip: str | None = None) -> str:
    return f"""{_hops(shift)},
texts AS (
  SELECT trace_id, any_value(day) AS day, any_value(region) AS region, any_value(status) AS status,
    any_value(priority) AS priority, {_ip_text('any_value(last_ip)')} AS target,
    {_words(ip or _ip_text('ip'))} AS words FROM hops GROUP BY trace_id)"""


IPLANE = "strftime(day, '%Y%m') || ' ' || words"
ARK = """strftime(day, '%Y%m%d') || ' ' || region || ' ' || target || ' '
    || CASE WHEN status = 'P' THEN 'ERR' ELSE 'MOS' END || ' ' || words"""


def _parsed(at: str, region: str, target: str, lat: str, where: str = "TRUE") -> str:
    return f"""WITH {_hops()},
read AS (SELECT *, {lat} AS seen FROM hops WHERE {where})
SELECT {at} AS at, any_value(year) AS year, {region} AS region, {target} AS target,
  string_agg(CAST(ip AS VARCHAR), ' ' ORDER BY pos) AS hops,
  string_agg(CAST(seen AS VARCHAR), ' ' ORDER BY pos) AS lats,
  CAST(count(*) AS INTEGER) AS num_hops, {_r('arg_max(seen, pos)', 'e2e')}
FROM read GROUP BY trace_id"""


MONTH_AT = "any_value(month) || '01000000'"
FIRST_IP = _ip_text("arg_min(ip, pos)")
LAST_IP = _ip_text("arg_max(ip, pos)")

ORACLE: dict[str, str] = {
    "src_lines": f"WITH {_lines()} SELECT {IPLANE} AS value, 'IPLANE' AS dataset FROM texts",
    "src_ark": _parsed(MONTH_AT, "any_value(region)", LAST_IP, "lat + 0.25", "status <> 'P'"),
    "src_iplane": _parsed(MONTH_AT, FIRST_IP, LAST_IP, "lat + 0.25"),
    "src_cdn": _parsed(
        "any_value(strftime(day, '%Y%m%d%H%M%S'))",
        "any_value(region)",
        LAST_IP,
        "CASE WHEN pos % 2 = 0 THEN lat + 1 ELSE lat END",
    ),
    "src_headers": f"""WITH {_hops()}
SELECT any_value(month) AS month, any_value(year) AS year, any_value(region) AS region, {LAST_IP} AS target,
  CAST(count(*) AS INTEGER) AS num_hops, {_r('any_value(e2e) + 0.25', 'e2e')}
FROM hops WHERE status <> 'P' GROUP BY trace_id""",
    "src_ipmap": f"""WITH {SUPPLIERS},
lines AS (
  SELECT s_suppkey, {_address('s_suppkey // 2')} AS range_start, as_no,
    CASE WHEN s_acctbal > 0 THEN upper(city) || '@' || upper(code) ELSE upper(code) END AS geo
  FROM suppliers)
SELECT range_start, arg_max(as_no, s_suppkey) AS as_no, arg_max(geo, s_suppkey) AS geo
FROM lines GROUP BY range_start""",
    "bad_lines": f"""WITH {_lines()}, broken AS (
  SELECT CASE left(priority, 1)
    WHEN '1' THEN '200813 ' || words
    WHEN '2' THEN strftime(day, '%Y%m')
    WHEN '3' THEN strftime(day, '%Y%m') || ' 10.0.1 3.5 ' || words
    WHEN '4' THEN {IPLANE} || ' 10.0.0.1 fast'
    ELSE CASE WHEN status = 'P' THEN {IPLANE} || ' 10.0.0.1' END END AS value,
    CASE left(priority, 1) WHEN '1' THEN 'date' WHEN '2' THEN 'hops' WHEN '3' THEN 'address'
      WHEN '4' THEN 'latency' ELSE 'hops' END AS reason FROM texts)
SELECT value, reason FROM broken WHERE value IS NOT NULL""",
    "flt_clean": f"""WITH {_lines(SHIFT, f"CASE WHEN ip % 256 = 0 THEN '0.0.0.0' ELSE {_ip_text('ip')} END")},
lines AS (SELECT {ARK} AS value FROM texts)
SELECT value FROM lines
WHERE contains(value, 'MOS') AND NOT contains(value, '0.0.0.0') AND NOT contains(value, '-')""",
    "flt_year": _overview("year", "year IN (1996, 1997)"),
    "sink_report": f"SELECT *, 'ARK' AS dataset FROM ({_endpoint_stats('as', None, 'src')})",
    "ip_floor_join": _floor_join(),
    "ip_floor_join_shuffled": _floor_join(),
    "compress_as": _compress("as"),
    "compress_geo": _compress("geo"),
    "segments": f"""WITH {_lt('geo', shift=SHIFT)}
SELECT trace_id, CAST(idx AS INTEGER) AS idx, {_r('lat', 'lat')} FROM seg""",
    "hop_indices": " UNION ALL ".join(
        f"""(WITH {_lt(level)} SELECT trace_id, '{level}' AS level,
  array_to_string({"[0] || " if level == "as" else ""}starts[2:] || [raw_hops], ' ') AS hop_indices FROM lt)"""
        for level in ("as", "geo")
    ),
    "inside_share": f"""WITH {_lt('as', shift=SHIFT)}
SELECT trace_id, {_r('e2e', 'e2e')}, {_r('inside_pct', 'inside_pct')} FROM lt""",
    "endpoints": " UNION ALL ".join(
        f"""(WITH {_lt(level, end)}
SELECT trace_id, '{level}' AS level, '{end}' AS endpoint, src, dst, num_hops FROM lt)"""
        for level, end in (("as", "geo"), ("geo", "as"))
    ),
    "has_negative": f"WITH {_lt('as', shift=SHIFT)} SELECT trace_id, has_negative FROM lt",
    "label_coverage": f"""WITH {_found(offset=8)},
t AS (SELECT trace_id, any_value(year) AS year, bool_or(as_no IS NULL) AS missing FROM found GROUP BY 1)
SELECT year, count(*) AS n, count(*) FILTER (missing) AS unlabelled FROM t GROUP BY year""",
    "links": f"""WITH {_lt('as')}
SELECT trace_id, year, link, link_src, link_dst, {_r('lat', 'lat')} FROM link""",
    "path_strings": f"""WITH {_lt('as')}
SELECT trace_id, path, array_to_string(list_sort(list_distinct(labels)), '-') AS label_set FROM lt""",
    "path_cycles": f"""WITH {_lt('as')}
SELECT trace_id, len(labels) <> len(list_distinct(labels)) AS has_cycle FROM lt""",
    "label_coverage_geo": f"""WITH {_found(offset=8)},
t AS (SELECT trace_id, any_value(year) AS year,
    bool_or(as_no IS NULL OR CAST(substr(as_no, 3) AS BIGINT) % 3 = 0) AS missing FROM found GROUP BY 1)
SELECT year, count(*) AS n, count(*) FILTER (missing) AS unlabelled FROM t GROUP BY year""",
    "pair_stats_null_keys": f"""WITH {_lt('geo')},
known AS (SELECT CASE WHEN src <> dst THEN src END AS src, dst, e2e, path FROM lt),
paths AS (SELECT src, dst, path, count(*) AS c, sum(e2e) AS total FROM known GROUP BY ALL)
SELECT src, dst, CAST(sum(c) AS BIGINT) AS n, {_r('sum(total) / sum(c)', 'latency_avg')},
  {_r('max(c) / sum(c)', 'prevalence')}, count(*) AS num_paths FROM paths GROUP BY src, dst""",
    "floor_join_bounds": f"""WITH {_found(offset=8)},
far AS (SELECT trace_id, pos, ip * CASE ip % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 1000000 END AS ip FROM hops),
moved AS (SELECT CASE as_no WHEN 'AS1' THEN -1000000000000000 WHEN 'AS2' THEN 1000000000000000
    ELSE range_start END AS range_start, as_no FROM ip_map)
SELECT trace_id, CAST(pos AS INTEGER) AS pos, ip, as_no, way
FROM far ASOF LEFT JOIN moved ON far.ip >= moved.range_start, (VALUES ('broadcast'), ('shuffled')) ways(way)""",
    "overview_city": _overview("year", level="geo"),
    "hop_dist_label_city": f"WITH {_lt('geo')} SELECT year, num_hops, count(*) AS n FROM lt GROUP BY ALL",
    "hop_dist_raw_city": f"""WITH {_lt('geo')}
SELECT year, CAST(raw_hops AS INTEGER) AS raw_hops, count(*) AS n FROM lt GROUP BY ALL""",
    "latency_hist_city": f"""WITH {_lt('geo', shift='-25.5')}
SELECT year, CAST(trunc(e2e) AS INTEGER) AS latency, count(*) AS n FROM lt GROUP BY ALL""",
    "multihoming_city": f"""WITH {_lt('geo')},
up AS (SELECT year, dst, CASE WHEN num_hops >= 2 THEN labels[-2] END AS label FROM lt)
SELECT year, dst, count(DISTINCT label) AS n_upstream,
  coalesce(string_agg(DISTINCT label, ' ' ORDER BY label), '') AS upstream FROM up GROUP BY year, dst""",
    "degree_dist_city": f"""WITH {_lt('geo')}
SELECT year, link_src, CAST(count(DISTINCT link_dst) AS DOUBLE) AS degree FROM link GROUP BY ALL""",
    "degree_rank": f"""WITH {_lt('as')},
d AS (SELECT year, link_src, CAST(count(DISTINCT link_dst) AS DOUBLE) AS degree FROM link GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY degree DESC, link_src) AS INTEGER) AS place FROM d""",
    "pair_stats_as_yearly": _pairs("as", None, ["year", "src", "dst"], "s_latency.n >= 100").replace(
        "'AS' || s_suppkey AS as_no", "CASE WHEN s_suppkey % 50 = 49 THEN 'AS0' ELSE 'AS1' END AS as_no"
    ),
    "sink_text": f"""WITH {_lt('geo')}, d AS (SELECT year, num_hops, count(*) AS n FROM lt GROUP BY ALL)
SELECT '(' || num_hops || ',' || n || ')' AS value, 'ARK' AS dataset, year FROM d""",
    "overview": _overview("year"),
    "overview_all": _overview(""),
    "hop_dist_label": f"WITH {_lt('as')} SELECT year, num_hops, count(*) AS n FROM lt GROUP BY ALL",
    "hop_dist_raw": f"""WITH {_lt('as')}
SELECT year, CAST(raw_hops AS INTEGER) AS raw_hops, count(*) AS n FROM lt GROUP BY ALL""",
    "latency_hist": f"""WITH {_lt('as', shift='-25.5')}
SELECT year, CAST(trunc(e2e) AS INTEGER) AS latency, count(*) AS n FROM lt GROUP BY ALL""",
    "pair_stats_as": _pairs("as", None, ["src", "dst"], "s_latency.n >= 20"),
    "pair_stats_geo": _pairs("geo", None, ["year", "src", "dst"]),
    "pair_stats_geo_all": _pairs("geo", None, ["src", "dst"]),
    "pair_stats_geoas": _pairs("as", "geo", ["year", "from_ip", "dst"], prevalence=False),
    "src_stats": _endpoint_stats("as", None, "src"),
    "src_stats_geo": _endpoint_stats("geo", None, "src"),
    "src_stats_geoas": _endpoint_stats("as", "geo", "src"),
    "dst_stats": _endpoint_stats("as", None, "dst"),
    "dst_stats_geo": _endpoint_stats("geo", None, "dst"),
    "dst_stats_geoas": _endpoint_stats("as", "geo", "dst"),
    "multihoming": f"""WITH {_lt('as')},
up AS (SELECT year, dst, CASE WHEN num_hops >= 2 THEN labels[-2] END AS label FROM lt)
SELECT year, dst, count(DISTINCT label) AS n_upstream,
  coalesce(string_agg(DISTINCT label, ' ' ORDER BY label), '') AS upstream FROM up GROUP BY year, dst""",
    "link_stats": _link_stats("as"),
    "link_stats_geo": _link_stats("geo"),
    "degree_dist": f"""WITH {_lt('as')}
SELECT year, link_src, CAST(count(DISTINCT link_dst) AS DOUBLE) AS degree FROM link GROUP BY ALL""",
    "edge_stats": _edges(),
    "agg_moments": f"""WITH {_lt('as', shift=SHIFT)}, scaled AS (SELECT year, src, e2e * {SCALE} AS v FROM lt)
SELECT year, src, count(*) AS n, {_r('min(v)', 'min')}, {_r('max(v)', 'max')},
  {_r('var_pop(v)', 'variance')}, {_moments('v')} FROM scaled GROUP BY year, src""",
    "agg_percentiles": f"""WITH RECURSIVE {POINTS}, {_lt('geo')}, {_stats('lt', ['src', 'dst'], 'e2e', 's')}
SELECT src, dst, n, {', '.join(_r(f'p{p}', f'p{p}') for p in SIX)} FROM s""",
    "agg_cdf": f"""WITH RECURSIVE {POINTS}, {_lt('geo')}, {_stats('lt', ['src', 'dst'], 'e2e', 's')},
full_points AS (
  SELECT src, dst, floor(p * 100 + 0.5) / 100 AS prob, min(v) AS value
  FROM s_v JOIN hundred ON rn / n::DOUBLE >= p OR abs(rn / n::DOUBLE - p) < 1e-6
  WHERE n >= 100 GROUP BY src, dst, p)
SELECT src, dst, {_r('prob', 'prob')}, {_r('value', 'value')} FROM full_points
UNION ALL SELECT src, dst, 0.0, 0.0 FROM s_m WHERE n >= 100
UNION ALL SELECT src, dst, {_r('prob', 'prob')}, {_r('v', 'value')} FROM s_c""",
    "agg_corr": f"""WITH {_lt('as')}
SELECT year, src, count(*) AS n, {_r('covar_pop(num_hops, inside_pct)', 'covariance')},
  {_r('covar_pop(num_hops, inside_pct) / nullif(stddev_pop(num_hops) * stddev_pop(inside_pct), 0)', 'pearson')}
FROM lt GROUP BY year, src""",
    "hop_efficiency": f"""WITH {_lt('as')},
hop AS (SELECT src, dst, unnest(labels) AS hop FROM lt),
{_entropy('hop', 'src, dst', 'hop', _r('h / nullif(ln(k), 0)', 'efficiency'))}""",
    "path_efficiency": f"""WITH {_lt('geo')},
{_entropy('lt', 'src, dst', 'path', ', '.join([
    _r('h / nullif(ln(k), 0)', 'efficiency'), _r('h', 'entropy'), 'CAST(k AS INTEGER) AS num_paths']))}""",
    "path_count": f"""WITH {_lt('geo')}
SELECT src, dst, 0.0::DOUBLE AS efficiency, 0.0::DOUBLE AS entropy,
  CAST(count(DISTINCT path) AS INTEGER) AS num_paths FROM lt GROUP BY src, dst""",
    "path_prevalence": f"""WITH {_lt('geo')}, {_prevalence(['src', 'dst'])}
SELECT src, dst, {_r('prevalence', 'prevalence')}, num_changes, num_paths, dominant_path FROM prev""",
    "cidr_floor_join": f"""WITH {_hops()}, {SUPPLIERS},
kinds AS (
  SELECT *, {_address('s_suppkey', '12345')} AS ip, 12 + s_suppkey % 3 AS len, '' AS tail, 0 AS kind FROM suppliers
  UNION ALL SELECT *, {_address('s_suppkey')}, 16, 'B', 1 FROM suppliers WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT *, {_address('s_suppkey', 's_suppkey * 37 % 256')}, 24 + s_suppkey % 9, 'C', 2 FROM suppliers
  UNION ALL SELECT *, {_address('s_suppkey', '64 * (s_suppkey % 4)')}, 26, 'D', 3 FROM suppliers
  UNION ALL SELECT *, {_address('s_suppkey', '64 * ((s_suppkey + 1) % 4)')}, 26, 'E', 4 FROM suppliers
  UNION ALL SELECT *, {_address('s_suppkey', '64 * (s_suppkey % 4)')}, 26, 'F', 5 FROM suppliers WHERE s_suppkey % 5 = 0),
prefixes AS (
  SELECT ip - ip % CAST(2 ** (32 - len) AS BIGINT) AS low, CAST(2 ** (32 - len) AS BIGINT) AS size,
    len * 10000000000 + s_suppkey * 10 + kind AS place, as_no || tail AS as_no,
    CASE WHEN s_acctbal > 0 THEN upper(city) || '@' || upper(code) ELSE upper(code) END AS geo FROM kinds),
addresses AS (SELECT DISTINCT ip FROM hops),
longest AS (
  SELECT ip, arg_max(as_no, place) AS as_no, arg_max(geo, place) AS geo
  FROM addresses JOIN prefixes ON ip >= low AND ip < low + size GROUP BY ip)
SELECT trace_id, CAST(pos AS INTEGER) AS pos, ip, as_no, geo FROM hops LEFT JOIN longest USING (ip)""",
    "cidr_normalise": f"""WITH {SUPPLIERS},
p AS (SELECT *, {_address('s_suppkey', '12345')} AS ip, 16 + s_suppkey % 9 AS len FROM suppliers)
SELECT {_ip_text('ip')} || '/' || len AS prefix, as_no, geo,
  ip - ip % CAST(2 ** (32 - len) AS BIGINT) AS range_start FROM p""",
    "rollup_slash24": f"""WITH {_hops()}
SELECT ip - ip % 256 AS prefix, count(*) AS n, {_moments('lat')} FROM hops GROUP BY 1""",
    "rollup_slash24_text": f"""WITH {_hops()},
t AS (SELECT trace_id, any_value(last_ip) >> 8 AS p, any_value(e2e) AS e2e FROM hops GROUP BY trace_id)
SELECT (p >> 16) || '.' || ((p >> 8) & 255) || '.' || (p & 255) AS prefix, count(*) AS n, {_moments('e2e')}
FROM t GROUP BY 1""",
    "rollup_month": f"""WITH {_hops()},
t AS (SELECT trace_id, any_value(day) AS day, any_value(e2e) AS e2e FROM hops GROUP BY trace_id)
SELECT strftime(day, '%Y%m') AS month, count(*) AS n, {_moments('e2e')} FROM t GROUP BY 1""",
    "rollup_day": f"""WITH {_hops()},
t AS (SELECT trace_id, any_value(day) AS day, any_value(e2e) AS e2e FROM hops GROUP BY trace_id)
SELECT strftime(day, '%Y%m%d') AS day, count(*) AS n, {_moments('e2e')} FROM t GROUP BY 1""",
}

ORACLE["agg_percentiles_hot"] = ORACLE["agg_percentiles"]
ORACLE["agg_cdf_hot"] = ORACLE["agg_cdf"]
ORACLE["path_prevalence_hot"] = ORACLE["path_prevalence"]
ORACLE["counts_percentiles"] = ORACLE["agg_percentiles"]
ORACLE["counts_cdf"] = ORACLE["agg_cdf"]
ORACLE["counts_latency_hist"] = ORACLE["latency_hist_city"]
ORACLE["counts_moments"] = ORACLE["agg_moments"]
ORACLE["path_prevalence_appended"] = ORACLE["path_prevalence"]

SLICED = "sliced AS (SELECT *, unnest([CAST(year AS VARCHAR), 'ALL']) AS slice FROM lt)"
ORACLE["overview_years_all"] = f"""WITH {_lt('as')}, {SLICED}
SELECT slice, count(*) AS n, CAST(sum(num_hops) // count(*) AS BIGINT) AS avg_hops,
  CAST(sum(raw_hops) // count(*) AS BIGINT) AS avg_raw_hops, {_r('avg(e2e)', 'avg_latency')}
FROM sliced GROUP BY slice"""
ORACLE["hop_dist_years_all"] = f"""WITH {_lt('as')}, {SLICED}
SELECT slice, num_hops, count(*) AS n FROM sliced GROUP BY ALL"""
ORACLE["latency_hist_years_all"] = f"""WITH {_lt('as')}, {SLICED}
SELECT slice, CAST(trunc(e2e) AS INTEGER) AS latency, count(*) AS n FROM sliced GROUP BY ALL"""
ORACLE["src_stats_years_all"] = f"""WITH {_lt('as')}, {SLICED}
SELECT slice, src, count(*) AS n, {_moments('e2e', 'latency_')}, {_moments('num_hops', 'hops_')}
FROM sliced GROUP BY slice, src"""
ORACLE["multihoming_years_all"] = f"""WITH {_lt('as')}, {SLICED},
up AS (SELECT slice, dst, CASE WHEN num_hops >= 2 THEN labels[-2] END AS label FROM sliced)
SELECT slice, dst, count(DISTINCT label) AS n_upstream,
  coalesce(string_agg(DISTINCT label, ' ' ORDER BY label), '') AS upstream FROM up GROUP BY slice, dst"""
ORACLE["link_stats_years_all"] = f"""WITH RECURSIVE {POINTS}, {_lt('geo')},
slink AS (SELECT *, unnest([CAST(year AS VARCHAR), 'ALL']) AS slice FROM link),
{_stats('slink', ['slice', 'link_src', 'link_dst'], 'lat', 's')}
SELECT slice, link_src, link_dst, link_src || ' ' || link_dst AS link, n, {_stat_columns('s')} FROM s"""
ORACLE["sink_rerun"] = f"""SELECT *, 'ARK' AS dataset FROM ({_endpoint_stats('as', None, 'src')}) WHERE year <> 1996
UNION ALL BY NAME
SELECT *, 'ARK' AS dataset FROM ({_endpoint_stats('as', None, 'src').replace('FROM lt GROUP', 'FROM lt WHERE num_hops > 1 GROUP')})
WHERE year = 1996"""
ORACLE["line_accounting"] = f"""WITH {_lines(SHIFT)}, broken AS (
  SELECT CASE left(priority, 1)
    WHEN '1' THEN '200813 ' || words
    WHEN '2' THEN strftime(day, '%Y%m')
    WHEN '3' THEN strftime(day, '%Y%m') || ' 10.0.1 3.5 ' || words
    WHEN '4' THEN {IPLANE} || ' 10.0.0.1 fast'
    ELSE CASE WHEN status = 'P' THEN {IPLANE} || ' 10.0.0.1' ELSE {IPLANE} || '  ' END END AS value,
    CASE left(priority, 1) WHEN '1' THEN 'date' WHEN '2' THEN 'hops' WHEN '3' THEN 'address'
      WHEN '4' THEN 'latency' ELSE CASE WHEN status = 'P' THEN 'hops' END END AS reason FROM texts),
marked AS (
  SELECT reason, CASE WHEN contains(value, '0.0.0.0') THEN 'sentinel' WHEN contains(value, '-') THEN 'hyphen' END AS dropped
  FROM broken)
SELECT step, name, n FROM (
  SELECT 'read' AS step, 'lines' AS name, count(*) AS n FROM marked
  UNION ALL SELECT 'kept', 'traces', count(*) FILTER (dropped IS NULL AND reason IS NULL) FROM marked
  UNION ALL SELECT 'dropped', f, (SELECT count(*) FROM marked WHERE dropped = f) FROM (VALUES ('sentinel'), ('hyphen')) t(f)
  UNION ALL SELECT 'bad', f, (SELECT count(*) FROM marked WHERE dropped IS NULL AND reason = f)
  FROM (VALUES ('date'), ('hops'), ('address'), ('latency'), ('endpoint')) t(f))"""
ORACLE["sql_slash24"] = ORACLE["rollup_slash24"]
ORACLE["sql_reports"] = ORACLE["flt_year"]
