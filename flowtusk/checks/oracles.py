"""SQL for DuckDB that computes the same results from the base tables."""

from __future__ import annotations

from flowtusk.checks.queries import BATCHES, COUNT_WINDOW, HIGH_THRESHOLD, LONG_COUNT_WINDOW, PREVIEW, SINKS, SPARSE_HOSTS

LENGTH, SLIDE, THRESHOLD = 2_000_000, 100_000, 1500


def _packets(hosts: int = 16) -> str:
    return f"""packets AS (
  SELECT event_id AS pkt_id,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 43200 AS ts_us,
         '10.0.0.' || (user_id % {hosts}) AS src_ip,
         '192.168.1.' || (CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                          WHEN 'signup' THEN 4 ELSE 5 END) AS dst_ip,
         CAST(CASE WHEN event_id % 10 = 0 THEN 17 ELSE 6 END AS SMALLINT) AS protocol,
         CAST(58 + least(1442, CAST(round(value * 100) AS BIGINT) // 10) AS INTEGER) AS pkt_len,
         CAST(1024 + event_id % 50000 AS INTEGER) AS src_port, CAST(80 AS INTEGER) AS dst_port,
         event_id AS seq, CAST(0 AS BIGINT) AS ack, CAST(512 AS INTEGER) AS win, CAST(0 AS SMALLINT) AS syn
  FROM events),
lengths AS (
  SELECT *, pkt_len - 18 AS ip_len, CAST(20 AS INTEGER) AS ip_hdr_len, pkt_len - 38 AS ip_payload_len,
         CAST(20 AS INTEGER) AS tr_hdr_len, pkt_len - 58 AS tr_payload_len
  FROM packets)"""


_ALL = ("ts_us, src_ip, dst_ip, protocol, pkt_len, ip_len, ip_hdr_len, ip_payload_len, tr_hdr_len, "
        "tr_payload_len, src_port, dst_port, seq, ack, win, syn")


def _hash(text: str) -> str:
    return (f"list_reduce(list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT), "
            "lambda a, x: (a * 31 + x) % 4294967296, 0::BIGINT)")


def _num(address: str) -> str:
    return ("list_reduce(list_transform(string_split(" + address + ", '.'), lambda z: z::BIGINT), "
            "lambda a, x: a * 256 + x)")


def _raw(address: str) -> str:
    return ("list_reduce(list_transform(list_reverse(string_split(" + address + ", '.')), lambda z: z::BIGINT), "
            "lambda a, x: a * 256 + x)")


def _signed(value: str) -> str:
    return f"(({value}) % 4294967296) - CASE WHEN ({value}) % 4294967296 >= 2147483648 THEN 4294967296 ELSE 0 END"


_KEY = {
    "poly17": _signed(f"(({_hash('src_ip')} + 289) * 17 + {_hash('dst_ip')})"),
    "objects31": _signed(f"(({_hash('src_ip')} + 31) * 31 + {_hash('dst_ip')})"),
    "xor": f"xor({_num('src_ip')}, {_num('dst_ip')})",
    "five_tuple_xor": f"xor(xor(xor(xor({_num('src_ip')}, {_num('dst_ip')}), src_port), dst_port), protocol)",
    "destination": _num("dst_ip"),
    "pair": f"({_num('src_ip')} << 32) | {_num('dst_ip')}",
}


def _flows(key: str = "poly17", hosts: int = 16) -> str:
    return (f"WITH {_packets(hosts)},\nflows AS (SELECT *, {_KEY[key]} AS flow_id FROM packets WHERE protocol = 6)")


def _windows(key: str = "poly17", carry: str = "first", length: int = LENGTH, slide: int = SLIDE,
             hosts: int = 16) -> str:
    many = -(-length // slide)
    pick = "ORDER BY ts_us, pkt_id" if carry == "first" else "ORDER BY ts_us DESC, pkt_id DESC"
    edge = "min" if carry == "first" else "max"
    return f"""{_flows(key, hosts)},
expanded AS (
  SELECT *, (ts_us // {slide} - k) * {slide} AS ws FROM flows, range({many}) t(k)
  WHERE ts_us < (ts_us // {slide} - k) * {slide} + {length}),
windows AS (
  SELECT flow_id, ws AS window_start_us, ws + {length} AS window_end_us,
         first(src_ip {pick}) AS src_ip, first(dst_ip {pick}) AS dst_ip,
         CAST(sum(pkt_len) AS BIGINT) AS acc_bytes, {edge}(ts_us) AS ts_us, count(*) AS packets
  FROM expanded GROUP BY flow_id, ws)"""


def _hits(threshold: int = THRESHOLD, **options) -> str:
    return f"{_windows(**options)},\nhits AS (SELECT * FROM windows WHERE acc_bytes > {threshold})"


def _crossings(threshold: int = THRESHOLD, slide: int = SLIDE, **options) -> str:
    return f"""{_windows(slide=slide, **options)},
running AS (
  SELECT flow_id, ws, src_ip, dst_ip, pkt_id, ts_us,
         sum(pkt_len) OVER (PARTITION BY flow_id, ws ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS acc FROM expanded)
SELECT flow_id, ws AS window_start_us, ws + {LENGTH} AS window_end_us, src_ip, dst_ip, pkt_id, ts_us, CAST(acc AS BIGINT) AS acc_bytes
FROM running WHERE acc > {threshold} QUALIFY row_number() OVER (PARTITION BY flow_id, ws ORDER BY ts_us, pkt_id) = 1"""


_BASE = "flow_id, window_start_us, window_end_us, dst_ip, acc_bytes, ts_us"
_BASE_SRC = "flow_id, window_start_us, window_end_us, src_ip, dst_ip, acc_bytes, ts_us"
_FULL = _BASE_SRC + ", packets"

def _counts(n: int) -> str:
    return f"""SELECT flow_id, pkt_id, dst_ip,
  CAST(sum(pkt_len) OVER (PARTITION BY flow_id ORDER BY ts_us, pkt_id
       ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS acc_bytes, ts_us FROM flows"""


_COUNTED = _counts(COUNT_WINDOW)


def _sample(source: str, every: int = 1, cap: int | None = None) -> str:
    return f"""ranked AS (
  SELECT CAST(((flow_id % {SINKS}) + {SINKS}) % {SINKS} AS INTEGER) AS sink_id, window_end_us, flow_id,
         (window_end_us - ts_us) / 1000.0 AS latency_ms,
         row_number() OVER (PARTITION BY ((flow_id % {SINKS}) + {SINKS}) % {SINKS}
                            ORDER BY window_end_us, flow_id) AS rn
  FROM {source}),
samples AS (SELECT sink_id, window_end_us, flow_id, latency_ms::DOUBLE AS latency_ms FROM ranked
            WHERE (rn - 1) % {every} = 0{f" AND rn <= {every} * {cap}" if cap else ""})"""


_LATENCY_HITS = f"{_hits(carry='last')},\n{_sample('hits')}"

_STATS = """SELECT sink_id, {r}avg(latency_ms){e} AS mean_ms, {r}min(latency_ms){e} AS min_ms,
  {r}quantile_cont(latency_ms, 0.05){e} AS p5_ms, {r}quantile_cont(latency_ms, 0.25){e} AS p25_ms,
  {r}quantile_cont(latency_ms, 0.5){e} AS p50_ms, {r}quantile_cont(latency_ms, 0.75){e} AS p75_ms,
  {r}quantile_cont(latency_ms, 0.95){e} AS p95_ms, {r}max(latency_ms){e} AS max_ms
FROM samples GROUP BY sink_id"""

_PEAKS = """SELECT flow_id, first(src_ip ORDER BY window_end_us, src_ip, dst_ip) AS src_ip,
  first(dst_ip ORDER BY window_end_us, src_ip, dst_ip) AS dst_ip,
  max(acc_bytes) AS peak_bytes, min(window_end_us) AS first_seen_us FROM {source} GROUP BY flow_id"""

_SPREAD_PEAKS = f"""spread AS (SELECT *, CAST((window_start_us // 100000) % {SINKS} AS INTEGER) AS sink_id FROM hits),
sink_peaks AS (
  SELECT sink_id, flow_id, first(src_ip ORDER BY window_end_us) AS src_ip,
         first(dst_ip ORDER BY window_end_us) AS dst_ip, max(acc_bytes) AS peak_bytes,
         min(window_end_us) AS first_seen_us
  FROM spread GROUP BY sink_id, flow_id)"""

_LINE_PARTS = [f"{c}::VARCHAR" for c in _ALL.split(", ")]
_WHOLE = " || ',' || ".join(_LINE_PARTS)
_SHORT = " || ',' || ".join(_LINE_PARTS[:11])
_NO_TAIL = " || ',' || ".join(_LINE_PARTS[:12])


def _parsed_lines() -> str:
    cut = "pkt_id % 5 = 0"
    tail = ", ".join(f"CASE WHEN {cut} THEN -1 ELSE {c} END AS {c}" for c in _ALL.split(", ")[12:])
    return (f"WITH {_packets()} SELECT {', '.join(_ALL.split(', ')[:12])}, {tail} FROM lengths WHERE pkt_id % 7 <> 0")


def _source(suffix: str) -> str:
    return f"WITH {_packets()} {suffix}"


_THROUGHPUT = f"""sent AS (SELECT count(*) AS n, min(ts_us) AS a, max(ts_us) AS b FROM flows),
groups AS (SELECT flow_id & {SINKS - 1} AS s, count(*) AS c, max(window_end_us) - min(window_end_us) AS span,
                  max(window_end_us) AS z FROM hits GROUP BY 1),
received AS (SELECT sum(c) AS c, avg(span) AS span, max(z) AS z FROM groups)"""
_THROUGHPUT_COLUMNS = """n AS sent, CAST(c AS BIGINT) AS received,
  round(n / ((greatest(z, b) - a) / 1000000.0), 6) AS overall_tps, round(n / ((b - a) / 1000000.0), 6) AS source_tps,
  round(c / (span / 1000000.0), 6) AS sink_tps"""

_X, _Y, _Z = "l_quantity", "l_extendedprice", "l_discount"


def _shape(x: str, table: str, by: str | None = None) -> str:
    group = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    tail = f"GROUP BY {by}" if by else ""
    return f"""WITH base AS (SELECT {group}avg({x}) AS m, var_samp({x}) AS v, var_pop({x}) AS p FROM {table} {tail})
SELECT {group}round(any_value(m), 6) AS mean, round(any_value(v), 6) AS variance,
  round(avg(pow({x} - m, 3)) / pow(any_value(p), 1.5), 6) AS skewness,
  round(avg(pow({x} - m, 4)) / pow(any_value(p), 2) - 3, 6) AS kurtosis
FROM {table} JOIN base {on} {tail}"""


def _ranks(*columns: str) -> str:
    parts = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                      for c in columns)
    return f"(SELECT {parts} FROM lineitem)"


def _matrix(measure: str, xs: list[str], ys: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS i, '{j}' AS j, round({measure}({i}, {j}), 6) AS v FROM {table}" for i in xs for j in ys)


def _row_rank(shift: str) -> str:
    features = ["l_quantity", "l_linenumber", "l_suppkey", "l_partkey"]
    row = "[" + ", ".join(f"{c}::DOUBLE" for c in features) + "]"
    ranks = ", ".join(
        f"len(list_filter(r, lambda y: y < {c})) + (len(list_filter(r, lambda y: y = {c})) - 1) / 2.0::DOUBLE{shift} AS {c}"
        for c in features)
    return (f"WITH t AS (SELECT *, l_linenumber AS line, {row} AS r FROM lineitem) "
            f"SELECT l_orderkey, line, {ranks} FROM t")


_LATENCY_LINE = " || ".join(
    ["'[Sink' || sink_id || '] latency (ms): '"]
    + [f"format('{{:g}}', {c}) || ' ({label})'" + (" || ' '" if label != "max" else " || '.'") for c, label in [
        ("mean_ms", "mean"), ("min_ms", "min"), ("p5_ms", "5th"), ("p25_ms", "25th"), ("p50_ms", "50th"),
        ("p75_ms", "75th"), ("p95_ms", "95th"), ("max_ms", "max")]])

_XS = [_X, _Y, _Z]

ORACLES: dict[str, str] = {
    "s1_read_packets_csv": _parsed_lines(),
    "s1_rejected_lines": f"""WITH {_packets()}, lines AS (
  SELECT pkt_id, CASE WHEN pkt_id % 7 = 0 THEN {_SHORT} || ',,,,' WHEN pkt_id % 5 = 0 THEN {_NO_TAIL} || ',,,,'
         ELSE {_WHOLE} END AS line, ts_us FROM lengths),
spoiled AS (SELECT pkt_id, CASE WHEN pkt_id % 3 = 0 THEN 'x' || line[length(ts_us::VARCHAR) + 1:] ELSE line END AS value
            FROM lines)
SELECT value, CASE WHEN pkt_id % 7 = 0 THEN 'too few fields' ELSE 'bad time' END AS reason
FROM spoiled WHERE pkt_id % 7 = 0 OR pkt_id % 3 = 0""",
    "s1_read_packets_csv_raw_addresses": _source(f"SELECT {_ALL} FROM lengths WHERE protocol = 6"),
    "s1_rejected_numbers": f"""WITH {_packets()}, spoiled AS (
  SELECT pkt_id, {", ".join(f"{c}::VARCHAR AS {c}" if c != "dst_port" else
                            "CASE WHEN pkt_id % 3 = 0 THEN 'port' ELSE dst_port::VARCHAR END AS dst_port"
                            for c in _ALL.split(", "))} FROM lengths)
SELECT CASE WHEN pkt_id % 7 = 0 THEN {_SHORT} || ',,,,' WHEN pkt_id % 5 = 0 THEN {_NO_TAIL} || ',,,,' ELSE {_WHOLE} END AS value,
  CASE WHEN pkt_id % 7 = 0 THEN 'too few fields' ELSE 'bad dst_port' END AS reason
FROM spoiled WHERE pkt_id % 7 = 0 OR pkt_id % 3 = 0""",
    "s2_stream_packets_csv": _parsed_lines(),
    **dict.fromkeys(["s3_read_packets_pcap", "s3_packets_from_captures"], f"""WITH {_packets()}
SELECT ts_us, src_ip, dst_ip, protocol, pkt_len, ip_len, ip_hdr_len, ip_payload_len, tr_hdr_len, tr_payload_len,
  src_port, dst_port, seq, CASE WHEN pkt_id % 2 = 0 THEN seq + 7 ELSE 0 END AS ack, win,
  CAST(CASE WHEN pkt_id % 2 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS syn
FROM lengths WHERE protocol = 6 AND pkt_id % 11 <> 0"""),
    "s4_to_tuple_dataset": _source(f"SELECT pkt_id, ts_us, src_ip, dst_ip, pkt_len FROM packets WHERE protocol = 6 "
                                   f"ORDER BY ts_us, pkt_id LIMIT {PREVIEW}"),
    "s4_to_tuple_dataset_all": _source("SELECT pkt_id, ts_us, src_ip, dst_ip, pkt_len FROM packets WHERE protocol = 6"),
    "s5_replay": f"""WITH {_packets()}, tcp AS (SELECT * FROM packets WHERE protocol = 6),
span AS (SELECT max(ts_us) - min(ts_us) + 1 AS span FROM tcp)
SELECT pkt_id, CAST(g AS INTEGER) AS gen, CAST(r AS INTEGER) AS replica, ts_us + g * span AS ts_us, pkt_len
FROM tcp, span, range(3) a(g), range(2) b(r)""",
    "s5_replay_stream": f"""WITH {_packets()}, tcp AS (SELECT * FROM packets WHERE protocol = 6),
span AS (SELECT max(ts_us) - min(ts_us) + 1 AS span FROM tcp)
SELECT pkt_id, g AS gen, ts_us + g * span AS ts_us, pkt_len FROM tcp, span, range(3) a(g)""",
    "s2_stream_ids": f"""WITH {_packets()} SELECT protocol, count(*) AS lines, count(*) AS ids, true AS in_order
FROM packets GROUP BY protocol""",
    "s6_with_ingress_time": "SELECT event_id AS pkt_id, true AS stamped FROM events",
    "events_as_packets": _source(f"SELECT pkt_id, {_ALL} FROM lengths"),
    "p1_reorder": _source("SELECT ts_us, src_ip, dst_ip, src_port, dst_port, protocol, pkt_len FROM packets"),
    "p2_select_emitted": _source("SELECT src_ip, dst_ip, pkt_len, ts_us FROM packets"),
    **{name: f"WITH {_packets(SPARSE_HOSTS)} SELECT pkt_id, {_KEY[key]} AS flow_id FROM packets" for name, key in [
        ("p3_flow_id_poly17", "poly17"), ("p4_flow_id_objects31", "objects31"), ("p5_flow_id_xor", "xor"),
        ("p6_flow_id_5tuple_xor", "five_tuple_xor"), ("p3_flow_id_pair", "pair")]},
    "p7_tag_flow": f"{_flows()} SELECT pkt_id, flow_id, src_ip, dst_ip, CAST(pkt_len AS BIGINT) AS pkt_len, ts_us FROM flows",
    "p8_wire_len": _source("SELECT pkt_id, ip_len + 18 AS wire, (ip_len + 65018) % 65536 AS wrapped FROM lengths"),
    "p9_payload_lengths": _source("SELECT pkt_id, ip_payload_len, tr_payload_len FROM lengths"),
    "p10_ip_to_string": """WITH n AS (SELECT event_id, (event_id * 2654435761 + user_id) % 4294967296 AS n FROM events),
o AS (SELECT event_id, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM n)
SELECT event_id, a || '.' || b || '.' || c || '.' || d AS ip, d || '.' || c || '.' || b || '.' || a AS raw_ip FROM o""",
    "p11_ip_to_long": _source(f"SELECT pkt_id, {_num('src_ip')} AS src, {_num('dst_ip')} AS dst, "
                              f"{_raw('src_ip')} AS src_raw FROM packets"),
    "p12_ts_from_pcap": _source("SELECT pkt_id, ts_us FROM packets"),
    "p13_tcp_fields": _source("""SELECT pkt_id, tr_hdr_len, src_port, dst_port, seq,
  CASE WHEN pkt_id % 2 = 0 THEN seq + 7 ELSE 0 END AS ack, win,
  CAST(CASE WHEN pkt_id % 2 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS syn
FROM lengths WHERE protocol = 6"""),
    "f1_valid_row": _source("SELECT count(*) AS valid, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM packets WHERE pkt_id % 7 <> 0"),
    "f2_tcp_only": _source("SELECT pkt_id, protocol FROM packets WHERE protocol = 6"),
    "f3_heavy_hitters": f"{_hits()} SELECT {_BASE}, packets FROM hits",
    "f3_heavy_hitters_high": f"{_hits(HIGH_THRESHOLD)} SELECT {_BASE}, packets FROM hits",
    "f4_non_empty_window": f"{_windows()} SELECT {_BASE} FROM windows WHERE acc_bytes % 3 <> 0",
    "f5_latency_sample": f"{_windows(carry='last')},\n{_sample('windows', 16)} SELECT * FROM samples",
    "f5_latency_sample_capped": f"{_windows(carry='last')},\n{_sample('windows', 16, 200)} SELECT * FROM samples",
    "a1_sliding_bytes_reduce": f"{_windows()} SELECT {_BASE} FROM windows",
    "a1_sliding_bytes_sparse": f"{_windows(hosts=SPARSE_HOSTS)} SELECT {_BASE} FROM windows",
    "a1_sliding_bytes_uneven": f"{_windows(slide=300_000)} SELECT {_BASE} FROM windows",
    "a1_sliding_bytes_direct": f"{_windows()} SELECT {_BASE} FROM windows",
    "a1_sliding_bytes_destination": f"{_windows('destination', hosts=SPARSE_HOSTS)} SELECT flow_id, window_start_us, src_ip, "
                                    "dst_ip, acc_bytes, ts_us, packets FROM windows",
    "a1_sliding_bytes_pair": f"{_windows('pair')} SELECT {_BASE} FROM windows",
    "a2_sliding_bytes_window": f"{_windows()} SELECT {_BASE}, packets FROM windows",
    "a3_sliding_bytes_microbatch": f"{_windows()} SELECT {_BASE} FROM windows",
    "a4_sliding_bytes_last": f"{_windows('xor', 'last')} SELECT {_BASE_SRC} FROM windows",
    "a4_sliding_bytes_five_tuple": f"{_windows('five_tuple_xor', 'last')} SELECT {_BASE_SRC} FROM windows",
    "a5_count_window_bytes": f"{_flows()} {_COUNTED}",
    "a5_count_window_bytes_split": f"{_flows()} {_COUNTED}",
    "a5_count_window_bytes_long": f"{_flows()} {_counts(LONG_COUNT_WINDOW)}",
    "a5_count_window_bytes_long_split": f"{_flows()} {_counts(LONG_COUNT_WINDOW)}",
    "a6_tumbling_bytes": f"{_windows(slide=LENGTH)} SELECT {_BASE} FROM windows",
    "a7_flow_peaks": f"{_hits(key='xor', carry='last')} {_PEAKS.format(source='hits')}",
    "a8_merge_sink_peaks": f"{_hits()} {_PEAKS.format(source='hits')}",
    "a9_heavy_hitter_hosts": f"{_hits(HIGH_THRESHOLD)} SELECT DISTINCT dst_ip FROM hits ORDER BY dst_ip",
    "a10_heavy_hitter_host_count": f"{_hits()} SELECT count(DISTINCT dst_ip) AS hosts FROM hits",
    "a11_hits_per_host": f"{_hits()} SELECT dst_ip, count(*) AS hits FROM hits GROUP BY dst_ip",
    "a11_total_hits": f"{_hits()} SELECT count(*) AS hits FROM hits",
    "a12_latency_stats": f"{_LATENCY_HITS} {_STATS.format(r='round(', e=', 6)')}",
    "a13_mean_of_sink_means": f"""{_LATENCY_HITS}, means AS (SELECT avg(latency_ms) AS m FROM samples GROUP BY sink_id)
SELECT round((SELECT avg(m) FROM means), 6) AS mean_of_means_ms,
       round((SELECT avg(latency_ms) FROM samples), 6) AS weighted_mean_ms, (SELECT count(*) FROM means) AS active_sinks""",
    "a14_throughput": f"{_hits()}, {_THROUGHPUT} SELECT {_THROUGHPUT_COLUMNS} FROM sent, received",
    "a15_detector_counts": f"{_windows()} SELECT count(*) AS processed, count(*) FILTER (acc_bytes > {THRESHOLD}) AS detected FROM windows",
    "a16_generation_counts": _source("SELECT count(*) * 4 AS generated, CAST(4 AS BIGINT) AS generations FROM packets WHERE protocol = 6"),
    "d1_sample_mean": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "d2_sample_percentile": "SELECT " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{i}" for i, p in enumerate([0.0, 0.05, 0.25, 0.75, 0.95, 1.0]))
        + " FROM lineitem",
    "d2_sample_percentile_grouped": """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p0,
  round(quantile_cont(value, 0.5), 6) AS p1, round(quantile_cont(value, 0.9), 6) AS p2 FROM events GROUP BY event_type""",
    "d3_sample_moments": _shape("value", "events", "event_type"),
    "d4_sample_variance": "SELECT round(var_samp(l_quantity), 6) AS variance FROM lineitem",
    "d5_sample_skewness": f"SELECT skewness FROM ({_shape('l_extendedprice', 'lineitem')})",
    "d5_sample_kurtosis": f"SELECT kurtosis FROM ({_shape('l_extendedprice', 'lineitem')})",
    "d6_sample_adev": "WITH b AS (SELECT avg(l_quantity) AS m FROM lineitem) SELECT round(avg(abs(l_quantity - m)), 6) AS adev FROM lineitem, b",
    "d6_sample_adev_grouped": """WITH b AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS adev FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""",
    "d7_sample_median": "SELECT l_linestatus, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1",
    "d8_cov2": "SELECT round(covar_samp(l_quantity, l_extendedprice), 6) AS cov FROM lineitem",
    "d8_pearson_corr2": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem",
    "d9_spearman_corr2": f"SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM {_ranks(_X, _Y)}",
    "d10_cov_matrix": _matrix("covar_samp", _XS, _XS, "lineitem"),
    "d10_pearson_matrix": _matrix("corr", _XS, _XS, "lineitem"),
    "d10_spearman_matrix": _matrix("corr", _XS, _XS, _ranks(*_XS)),
    "d10_cov_cross_matrix": _matrix("covar_samp", _XS[:1], _XS[1:], "lineitem"),
    "d10_pearson_cross_matrix": _matrix("corr", _XS[:1], _XS[1:], "lineitem"),
    "d10_spearman_cross_matrix": _matrix("corr", _XS[:1], _XS[1:], _ranks(*_XS)),
    "d11_rank_data": _row_rank(""),
    "d11_rank_data_centered": _row_rank(" - 1.5"),
    "d11_rank_array": """WITH t AS (SELECT vec_id, embedding AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS feature,
  len(list_filter(e, lambda y: y < e[pos])) + (len(list_filter(e, lambda y: y = e[pos])) - 1) / 2.0::DOUBLE AS rank FROM t""",
    "t1_stream_sliding_bytes": f"{_windows()} SELECT {_FULL} FROM windows",
    "t2_stream_pane_bytes": f"{_windows(carry='last')} SELECT {_FULL} FROM windows",
    "t6_micro_batches": f"{_flows()} SELECT pkt_id, flow_id, CAST(pkt_len AS BIGINT) AS pkt_len FROM flows",
    "t3_alert_early": f"{_hits()} SELECT flow_id, window_start_us FROM hits",
    "t4_stream_count_window_bytes": f"{_flows()} {_COUNTED}",
    "t4_count_window_batches": f"{_flows()} {_COUNTED}",
    "t5_keep_flow_peaks": f"{_hits()} {_PEAKS.format(source='hits')}",
    "t7_result_sets": f"{_hits()} SELECT {_FULL} FROM hits",
    "t8_stream_latency": f"{_windows(carry='last')} SELECT flow_id, window_end_us, ((window_end_us - ts_us) / 1000.0)::DOUBLE AS latency_ms FROM windows",
    "k1_packets_csv_numeric": f"WITH {_packets()} SELECT " + _WHOLE.replace(
        "src_ip::VARCHAR", f"({_raw('src_ip')})::VARCHAR").replace("dst_ip::VARCHAR", f"({_raw('dst_ip')})::VARCHAR")
        + " AS line FROM lengths WHERE protocol = 6",
    "k2_packets_csv_dotted": f"WITH {_packets()} SELECT {_WHOLE} AS line FROM lengths WHERE protocol = 6",
    "k3_result_sets_per_slide": f"{_hits()} SELECT window_end_us AS slide, flow_id, dst_ip, acc_bytes, ts_us FROM hits",
    "k4_peak_reports": f"""{_hits()}, {_SPREAD_PEAKS}
SELECT sink_id, '[Sink' || sink_id || '-REPORT]' AS line FROM sink_peaks GROUP BY sink_id
UNION ALL SELECT sink_id, dst_ip || ' from ' || src_ip || ' : max peak ' || peak_bytes || ' exchanged bytes' FROM sink_peaks""",
    "k5_host_report": f"""{_hits()} SELECT DISTINCT dst_ip AS line FROM hits
UNION ALL SELECT '[Heavy Hitters - GLOBAL REPORT]' UNION ALL SELECT 'List of destination hosts targeted:'""",
    "k6_latency_reports": f"{_LATENCY_HITS}, stats AS ({_STATS.format(r='round(', e=', 9)')}) SELECT sink_id, {_LATENCY_LINE} AS line FROM stats",
    "k7_run_metrics": f"""{_LATENCY_HITS}, {_THROUGHPUT}, means AS (SELECT avg(latency_ms) AS m FROM samples GROUP BY sink_id)
SELECT {_THROUGHPUT_COLUMNS}, (SELECT count(*) FROM windows) AS processed, (SELECT count(*) FROM hits) AS detected,
  round((SELECT avg(m) FROM means), 6) AS average_latency_ms, (SELECT count(DISTINCT dst_ip) FROM hits) AS hosts
FROM sent, received""",
    "window_extra_aggregates": f"""{_windows()}, extra AS (
  SELECT flow_id, ws AS window_start_us, max(pkt_len) AS largest, count(DISTINCT dst_ip) AS hosts FROM expanded GROUP BY 1, 2)
SELECT flow_id, window_start_us, acc_bytes, largest, hosts FROM windows JOIN extra USING (flow_id, window_start_us)""",
    "window_extra_aggregates_last": f"""{_windows('destination', 'last', hosts=SPARSE_HOSTS)}, extra AS (
  SELECT flow_id, ws AS window_start_us, max(pkt_len) AS largest, count(DISTINCT dst_ip) AS hosts, min(pkt_len) AS smallest,
         CAST(sum(pkt_len - 38) AS BIGINT) AS payload, count(DISTINCT src_port) AS ports FROM expanded GROUP BY 1, 2)
SELECT flow_id, window_start_us, src_ip, acc_bytes, packets, largest, hosts, smallest, payload, ports
FROM windows JOIN extra USING (flow_id, window_start_us)""",
    "s6_ingress_windows": f"""{_flows()} SELECT flow_id, CAST(sum(pkt_len) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS windows_that_differ
FROM flows GROUP BY flow_id""",
    "t8_live_latency_stats": f"""{_flows()}, tagged AS (
  SELECT CAST(((flow_id % {SINKS}) + {SINKS}) % {SINKS} AS INTEGER) AS sink_id, pkt_len / 8.0 AS ms FROM flows)
SELECT sink_id, count(*) AS samples, round(avg(ms), 6) AS mean_ms, CAST(min(ms) AS DOUBLE) AS min_ms, CAST(max(ms) AS DOUBLE) AS max_ms,
  true AS percentiles_within_bound FROM tagged GROUP BY sink_id""",
    "k7_live_run_metrics": f"""{_windows()} SELECT count(*) AS processed, CAST(count_if(acc_bytes > {THRESHOLD}) AS BIGINT) AS detected,
  (SELECT count(*) FROM flows) AS packets, CAST({BATCHES} AS BIGINT) AS batches FROM windows""",
    "t3_first_crossings": _crossings(),
    "t3_first_crossings_sparse": _crossings(HIGH_THRESHOLD, 300_000, key="five_tuple_xor", hosts=SPARSE_HOSTS),
    "t3_alert_crossings": _crossings(HIGH_THRESHOLD),
    "detect_stream": f"{_hits(HIGH_THRESHOLD)} SELECT {_FULL} FROM hits",
    **dict.fromkeys(["detect_count_window", "detect_stream_count_window"],
                    f"{_flows()}, sums AS ({_COUNTED}) SELECT * FROM sums WHERE acc_bytes > 25000"),
    "detect_objects31_sparse": f"{_hits(key='objects31', hosts=SPARSE_HOSTS)} SELECT {_BASE_SRC} FROM hits",
    "hits_by_sink": f"""{_hits()} SELECT CAST(((flow_id % {SINKS}) + {SINKS}) % {SINKS} AS INTEGER) AS sink_id, count(*) AS hits,
  CAST(sum(acc_bytes) AS BIGINT) AS bytes FROM hits GROUP BY 1""",
}
