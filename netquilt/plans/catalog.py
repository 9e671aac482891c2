"""The registered queries over traffic tables, each with its SQL oracle.

The tables stand for traffic: ``lineitem`` rows are packets from supplier to
part, ``events`` a stream of packets from user to the key in ``props``, and
``orders`` with ``lineitem`` bidirectional flows between supplier and customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquilt.functions import ip, naming
from netquilt.operators import anonymize, display, drill, filters, markers, matrix, stats, timeseries, windows, zones
from netquilt.plans.traffic import READERS, TrafficMatrix, process_files
from netquilt.sources import anon_table, datasource, readers, sinks, stats_table
from netquilt.sources.stored import fresh, stored
from netquilt.streaming import sources as streams
from netquilt.streaming import windows as stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SUBWINDOW, PER_FILE = 500, 4  # packets in a window of the small test tables
ZONES = [(1, 0, 19), (2, 20, 59)]
KEY = "netquilt"


def query(sql: str) -> Callable:
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs ---------------------------------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_packets(packets(spark, sf_dir))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return matrix.build(rows.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("packets")))


def flagged(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return matrix.from_packets(rows.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, ts, src, dst, packets`` of the event stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("src"), k.alias("dst"), k.alias("packets"), "event_type")


def zone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone int, lo long, hi long")


def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_packets(stream(spark, sf_dir))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.count_windows(stream(spark, sf_dir), "seq", SUBWINDOW, PER_FILE)


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long statistics table: the nine quantities of each pair of zones in each window."""
    links = matrix.from_packets(windowed(spark, sf_dir), ("subwindow",))
    found = zones.pair_quantities(links, zone_table(spark), by=("subwindow",))
    return stored(stats.unpivot(found.withColumnRenamed("subwindow", "window"), ("window", "zone_src", "zone_dst")), "window-stats")  # read several times


# SQL of the same inputs
E_SQL = "e AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS packets FROM lineitem GROUP BY ALL)"
W_SQL = "e AS (SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS packets FROM lineitem GROUP BY ALL)"
S_SQL = "s AS (SELECT event_id AS seq, ts, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, CAST(json_extract_string(props, '$.k') AS BIGINT) AS packets, event_type FROM events)"
SE_SQL = f"{S_SQL}, e AS (SELECT src, dst, count(*) AS packets FROM s GROUP BY ALL)"
WIN_SQL = f"{S_SQL}, w AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {SUBWINDOW} AS subwindow FROM s)"


def _zone(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN 0 AND 19 THEN 1 WHEN {c} BETWEEN 20 AND 59 THEN 2 ELSE 3 END"


def _nine(source: str, by: str = "") -> str:
    """The nine quantities of ``source(src, dst, packets)``, for each group of ``by``."""
    g, sel = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""SELECT {sel}CAST(n_packets AS BIGINT) AS n_packets, n_links, n_sources, n_destinations, CAST(max_packets AS BIGINT) AS max_packets,
  CAST(max_source_packets AS BIGINT) AS max_source_packets, CAST(max_destination_packets AS BIGINT) AS max_destination_packets, max_fan_out, max_fan_in
FROM (SELECT {sel}sum(packets) AS n_packets, count(*) AS n_links, max(packets) AS max_packets FROM {source} {g}) a
JOIN (SELECT {sel}count(*) AS n_sources, max(v) AS max_source_packets, max(n) AS max_fan_out FROM (SELECT {sel}src, sum(packets) AS v, count(*) AS n FROM {source} GROUP BY {sel}src) {g}) b {on}
JOIN (SELECT {sel}count(*) AS n_destinations, max(v) AS max_destination_packets, max(n) AS max_fan_in FROM (SELECT {sel}dst, sum(packets) AS v, count(*) AS n FROM {source} GROUP BY {sel}dst) {g}) c {on}"""


_NINE = ", ".join(stats.QUANTITIES)
L_SQL = f"""{WIN_SQL}, z AS (SELECT subwindow AS "window", {_zone("src")} AS zone_src, {_zone("dst")} AS zone_dst, src, dst, count(*) AS packets FROM w GROUP BY ALL),
q AS ({_nine("z", '"window", zone_src, zone_dst')}),
l AS (UNPIVOT q ON {_NINE} INTO NAME metric VALUE value),
d AS (SELECT g.zone_src, g.zone_dst, g.metric, ws."window", coalesce(l.value, 0) AS value FROM (SELECT DISTINCT zone_src, zone_dst, metric FROM l) g CROSS JOIN (SELECT DISTINCT "window" FROM l) ws LEFT JOIN l USING (zone_src, zone_dst, metric, "window"))"""
U_SQL = f"""{L_SQL}, u AS (SELECT zone_src, zone_dst, metric, arg_max(value, "window") AS "current", median(value) AS median, max(value) AS max FROM d GROUP BY ALL),
a AS (SELECT zone_src, zone_dst, metric, min("window") AS argmax_window FROM d JOIN u USING (zone_src, zone_dst, metric) WHERE value = max GROUP BY ALL)"""


# ---- matrices -------------------------------------------------------------


@query(f"WITH {E_SQL} SELECT * FROM e")
def matrix_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"WITH {E_SQL} {_nine('e')}")
def network_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantities(edges(spark, sf_dir))


@query(f"WITH {W_SQL} {_nine('e')}")
def network_quantities_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantities(weighted(spark, sf_dir))


@query(f"""WITH {W_SQL}, r AS (SELECT src, sum(packets) AS v, count(*) AS n FROM e GROUP BY 1), c AS (SELECT dst, sum(packets) AS v, count(*) AS n FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM e WHERE packets = (SELECT max(packets) FROM e)) AS max_packets_links,
(SELECT count(*) FROM r WHERE v = (SELECT max(v) FROM r)) AS max_source_packets_sources,
(SELECT count(*) FROM c WHERE v = (SELECT max(v) FROM c)) AS max_destination_packets_destinations,
(SELECT count(*) FROM r WHERE n = (SELECT max(n) FROM r)) AS max_fan_out_sources,
(SELECT count(*) FROM c WHERE n = (SELECT max(n) FROM c)) AS max_fan_in_destinations""")
def multiplicities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.multiplicities(weighted(spark, sf_dir))


def _reduce(name: str, axis: str, op: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matrix.reduce(weighted(spark, sf_dir), axis, op)

    f.__name__ = name
    query(f"WITH {W_SQL} SELECT {axis}, CAST({op}(packets) AS BIGINT) AS v FROM e GROUP BY 1")(f)


for _axis, _side in (("src", "row"), ("dst", "col")):
    for _op in ("sum", "count", "max", "min"):
        _reduce(f"{_side}_reduce_{_op}", _axis, _op)


@query("""WITH f AS (SELECT l_suppkey AS src, o_custkey AS dst, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) - 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
l AS (SELECT src, dst, a AS packets FROM f UNION ALL SELECT dst, src, b FROM f)
SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets FROM l WHERE packets > 0 GROUP BY ALL""")
def flow_to_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = flows.select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("l_quantity").cast("long").alias("to_server"), (F.col("l_linenumber").cast("long") - 1).alias("to_client"))
    return matrix.build(filters.flows_to_links(flows))


_AB = "a AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS packets FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS packets FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)"


@query(f"WITH {_AB} SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def matrix_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.add(flagged(spark, sf_dir, "A"), flagged(spark, sf_dir, "N"))


@query(f"WITH {_AB} SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets FROM (SELECT * FROM a UNION ALL SELECT src, dst, -packets FROM b) GROUP BY ALL HAVING sum(packets) <> 0")
def matrix_subtract_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.subtract(flagged(spark, sf_dir, "A"), flagged(spark, sf_dir, "N"))


@query(f"WITH {_AB} SELECT * FROM a ANTI JOIN b USING (src, dst)")
def matrix_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.difference(flagged(spark, sf_dir, "A"), flagged(spark, sf_dir, "N"))


@query(f"WITH {_AB} SELECT src, dst, a.packets, b.packets AS other_packets FROM a JOIN b USING (src, dst)")
def matrix_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.intersect(flagged(spark, sf_dir, "A"), flagged(spark, sf_dir, "N"))


@query(f"WITH {_AB} SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) = 0 AS equal")
def matrix_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.equal(flagged(spark, sf_dir, "A"), flagged(spark, sf_dir, "N"))


@query(f"WITH {E_SQL} SELECT dst AS src, src AS dst, packets FROM e")
def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transpose(edges(spark, sf_dir))


@query(f"WITH {W_SQL} SELECT src, dst, CAST(1 AS BIGINT) AS packets FROM e")
def matrix_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.pattern(weighted(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT * FROM e WHERE packets = 2")
def select_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.select_value(edges(spark, sf_dir), 2)


@query("SELECT DISTINCT l_suppkey AS src FROM lineitem")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.labels(packets(spark, sf_dir), "src")


# ---- zones ----------------------------------------------------------------

_Z = f"{SE_SQL}, z AS (SELECT {_zone('src')} AS zone_src, {_zone('dst')} AS zone_dst, src, dst, packets FROM e)"


def _grid(n: int) -> str:
    """All pairs of ``n`` zones, with zeros where there are no links."""
    cells = ", ".join(f"coalesce({q}, 0) AS {q}" for q in stats.QUANTITIES)
    pairs = ", ".join(f"({i}, {j})" for i in range(1, n + 1) for j in range(1, n + 1))
    return f"WITH {_Z}, q AS ({_nine('z', 'zone_src, zone_dst')}) SELECT zone_src, zone_dst, {cells} FROM (VALUES {pairs}) g(zone_src, zone_dst) LEFT JOIN q USING (zone_src, zone_dst)"


@query(_grid(2))
def zone_pairs_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.pair_quantities(stream_edges(spark, sf_dir), zone_table(spark), complement=False)


@query(_grid(3))
def zone_pairs_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.pair_quantities(stream_edges(spark, sf_dir), zone_table(spark))


@query(f"SELECT zone_src, max(n_packets) FILTER (zone_dst = 1) AS z1, max(n_packets) FILTER (zone_dst = 2) AS z2, max(n_packets) FILTER (zone_dst = 3) AS z3 FROM ({_grid(3)}) GROUP BY 1")
def zone_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.zone_matrix(zones.pair_quantities(stream_edges(spark, sf_dir), zone_table(spark)), "n_packets", 3)


_TEN = 10 << 24


@query(f"WITH {E_SQL} SELECT src + {_TEN} AS src, dst + {_TEN} AS dst, packets, CASE WHEN src < 32 THEN 1 WHEN src BETWEEN 64 AND 90 THEN 2 ELSE 3 END AS zone_src, CASE WHEN dst < 32 THEN 1 WHEN dst BETWEEN 64 AND 90 THEN 2 ELSE 3 END AS zone_dst FROM e")
def zone_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(1, "10.0.0.0/27"), (2, "10.0.0.64:10.0.0.90")], "zone int, line string")
    lo, hi = ip.bounds(F.col("line"))
    named = lines.select("zone", lo.alias("lo"), hi.alias("hi"))
    links = edges(spark, sf_dir).select((F.col("src") + _TEN).alias("src"), (F.col("dst") + _TEN).alias("dst"), "packets")
    return zones.label(links, named)


@query(f"WITH {E_SQL} SELECT src, dst, packets, CASE WHEN dst % 2 = 0 AND dst < 400 THEN CAST(dst // 40 + 1 AS INTEGER) ELSE 11 END AS zone_dst FROM e")
def zone_many_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred intervals, labelled by a scan over addresses and intervals."""
    many = spark.createDataFrame([(i // 20 + 1, 2 * i, 2 * i) for i in range(200)], "zone int, lo long, hi long")
    return zones.label(edges(spark, sf_dir), many).select("src", "dst", "packets", "zone_dst")


@query(f"WITH {E_SQL} SELECT * FROM e WHERE src BETWEEN 0 AND 19 OR src BETWEEN 20 AND 59")
def range_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.inside(edges(spark, sf_dir), zone_table(spark), "src")


@query(f"WITH {E_SQL} SELECT * FROM e WHERE NOT (dst BETWEEN 0 AND 19 OR dst BETWEEN 20 AND 59)")
def range_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.outside(edges(spark, sf_dir), zone_table(spark), "dst")


@query("SELECT l_suppkey % 7 AS zone, min(l_suppkey) AS lo, max(l_suppkey) + 7 AS hi FROM lineitem GROUP BY 1")
def zone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("zone"), F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + 7).alias("hi"))
    return zones.merge(one.distinct())


# ---- anonymization --------------------------------------------------------

_MAP = "m AS (SELECT ip, (ip * 7919 + 13) % 1000003 AS anon_ip FROM (SELECT DISTINCT l_suppkey AS ip FROM lineitem UNION SELECT DISTINCT l_partkey FROM lineitem))"


@query(f"WITH {E_SQL}, {_MAP} SELECT a.anon_ip AS src, b.anon_ip AS dst, packets FROM e JOIN m a ON a.ip = src JOIN m b ON b.ip = dst")
def anon_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = edges(spark, sf_dir)
    ids = links.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()
    return anonymize.apply_table(links, ids.withColumn("anon_ip", (F.col("ip") * 7919 + 13) % 1000003))


_FLIPS = " + ".join(f"((CAST(instr('0123456789abcdef', substr(sha256('{KEY}:{b}:' || CAST(ip >> {32 - b} AS VARCHAR)), 1, 1)) - 1 AS BIGINT) & 1) << {31 - b})" for b in range(16, 32))


@query(f"WITH i AS (SELECT DISTINCT l_partkey AS ip FROM lineitem UNION SELECT DISTINCT l_suppkey FROM lineitem) SELECT ip, xor(ip, {_FLIPS}) AS anon_ip FROM i")
def anonymize_scramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.table_for(packets(spark, sf_dir), KEY)


@query(f"WITH {E_SQL}, i AS (SELECT DISTINCT l_partkey AS ip FROM lineitem UNION SELECT DISTINCT l_suppkey FROM lineitem), m AS (SELECT ip, xor(ip, {_FLIPS}) AS anon_ip FROM i) SELECT a.anon_ip AS src, b.anon_ip AS dst, packets FROM e JOIN m a ON a.ip = src JOIN m b ON b.ip = dst")
def anon_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links mapped by a binary table of all addresses up to the greatest, written in blocks and looked up by place."""
    links, path = edges(spark, sf_dir), fresh(spark, "anon-table")
    ids = links.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()
    anon_table.write_table(spark, path, KEY, 0, ids.agg(F.max("ip")).first()[0], block=1 << 12)
    return anonymize.apply_table(links, stored(anon_table.look_up(ids, path, block=1 << 12), "looked-up"))


# ---- windows --------------------------------------------------------------


@query(f"WITH {WIN_SQL} SELECT seq, subwindow FROM w")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).select("seq", "subwindow")


@query(f'WITH {WIN_SQL} SELECT subwindow // {PER_FILE} AS "window", count(DISTINCT subwindow) AS subwindows, count(*) AS packets FROM w GROUP BY 1')
def count_windows_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).groupBy("window").agg(F.count_distinct("subwindow").alias("subwindows"), F.count("*").alias("packets"))


@query(f"WITH {S_SQL}, w AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 300 AS subwindow FROM s) SELECT seq, subwindow FROM w WHERE subwindow IN (SELECT subwindow FROM w GROUP BY 1 HAVING count(*) >= 300)")
def count_windows_drop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.count_windows(stream(spark, sf_dir), "seq", 300)
    return windows.drop_tail(cut, 300).select("seq", "subwindow")


@query(f"WITH {S_SQL} SELECT event_type, seq, (row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1) // {SUBWINDOW} AS subwindow FROM s")
def per_queue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.count_windows(stream(spark, sf_dir), "seq", SUBWINDOW, by=("event_type",)).select("event_type", "seq", "subwindow")


@query(f"""WITH {S_SQL}, r AS (SELECT *, CAST(sum(packets) OVER (ORDER BY seq) AS BIGINT) AS hi FROM s WHERE packets > 0),
x AS (SELECT *, unnest(range((hi - packets) // 1000, (hi - 1) // 1000 + 1)) AS subwindow FROM r)
SELECT seq, src, dst, subwindow, least(hi, (subwindow + 1) * 1000) - greatest(hi - packets, subwindow * 1000) AS packets FROM x""")
def weighted_window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.weighted_windows(stream(spark, sf_dir), "seq", 1000).select("seq", "src", "dst", "subwindow", "packets")


@query(f"WITH {S_SQL} SELECT seq, CAST(sum(packets) OVER (ORDER BY seq) AS BIGINT) AS total FROM s")
def running_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_total(stream(spark, sf_dir), "seq", F.col("packets"), "total").select("seq", "total")


@query(f"WITH {WIN_SQL}, z AS (SELECT subwindow, src, dst, count(*) AS packets FROM w GROUP BY ALL) {_nine('z', 'subwindow')}")
def window_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantities(matrix.from_packets(windowed(spark, sf_dir), ("subwindow",)), ("subwindow",))


@query(f"WITH {WIN_SQL} SELECT subwindow, arg_min(ts, seq) AS start_ts FROM w GROUP BY 1")
def window_start_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.starts(windowed(spark, sf_dir), "ts", "seq")


@query(f"WITH {WIN_SQL} SELECT subwindow, strftime(arg_min(ts, seq), '%Y%m%d-%H%M%S') || '-' || CAST(epoch_us(arg_min(ts, seq)) % 1000000 AS VARCHAR) || '.' || CAST(count(*) AS VARCHAR) AS name FROM w GROUP BY 1")
def window_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = windowed(spark, sf_dir).groupBy("subwindow").agg(F.min_by("ts", "seq").alias("t"), F.count("*").alias("n"))
    return named.select("subwindow", naming.window_name(F.col("t"), F.col("n")).alias("name"))


# ---- time series ----------------------------------------------------------


@query(f"WITH {L_SQL} SELECT * FROM l")
def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_stats(spark, sf_dir)


@query(f'WITH {U_SQL} SELECT zone_src, zone_dst, metric, "current", median, max, argmax_window FROM u JOIN a USING (zone_src, zone_dst, metric)')
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.summary(window_stats(spark, sf_dir))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


@query(f"WITH {U_SQL}, p AS (SELECT zone_src, zone_dst, max(max) FILTER (metric = 'n_packets') AS x, max(max) FILTER (metric = 'n_links') AS y FROM u GROUP BY ALL) SELECT zone_src, zone_dst, {_ratio('x', 'y')} AS ratio FROM p")
def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.metric_ratio(timeseries.summary(window_stats(spark, sf_dir)), "max", "n_packets", "n_links")


@query(f"""WITH {L_SQL}, p AS (SELECT zone_src, zone_dst, coalesce(max(value) FILTER ("window" = 1), 0) AS x, coalesce(max(value) FILTER ("window" = 0), 0) AS y FROM l WHERE metric = 'max_fan_out' GROUP BY ALL) SELECT zone_src, zone_dst, {_ratio("x", "y")} AS ratio FROM p""")
def ratio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.window_ratio(window_stats(spark, sf_dir), "max_fan_out", 1, 0)


@query(f"""WITH {U_SQL} SELECT zone_src, zone_dst, {_ratio('"current"', "median")} AS ratio FROM u WHERE metric = 'n_sources'""")
def ratio_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.context_ratio(timeseries.summary(window_stats(spark, sf_dir)), "n_sources", "current", "median")


_ZS = f"""{L_SQL}, m AS (SELECT zone_src, zone_dst, metric, median(value) AS m FROM d GROUP BY ALL), v AS (SELECT d.*, m, abs(value - m) AS dev FROM d JOIN m USING (zone_src, zone_dst, metric)),
k AS (SELECT zone_src, zone_dst, metric, median(dev) AS mad FROM v GROUP BY ALL),
zs AS (SELECT zone_src, zone_dst, metric, "window", CASE WHEN mad = 0 THEN 0.0 ELSE CAST(0.6745 AS DOUBLE) * (value - m) / mad END AS z FROM v JOIN k USING (zone_src, zone_dst, metric))"""


@query(f'WITH {_ZS} SELECT zone_src, zone_dst, metric, round(CAST(arg_max(z, "window") AS DOUBLE), 9) AS z FROM zs GROUP BY ALL')
def zscore_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.last_z_scores(window_stats(spark, sf_dir)).withColumn("z", F.round("z", 9))


@query(f"""WITH {_ZS} SELECT zone_src, zone_dst, "window", CASE WHEN abs(z) >= 3 THEN 'alert' WHEN abs(z) >= 1.5 THEN 'warning' ELSE 'normal' END AS severity FROM zs WHERE metric = 'n_packets'""")
def anomaly_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = timeseries.z_scores(window_stats(spark, sf_dir).where("metric = 'n_packets'"))
    return z.select("zone_src", "zone_dst", "window", naming.severity(F.col("z")).alias("severity"))


@query(f"""WITH {L_SQL} SELECT "window", value FROM l WHERE metric = 'n_links' AND zone_src = 1 AND zone_dst = 2""")
def time_series_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.series(window_stats(spark, sf_dir), "n_links", 1, 2)


@query(f"""WITH {L_SQL}, n AS (SELECT DISTINCT "window" FROM l) SELECT "window", CAST(row_number() OVER (ORDER BY "window") AS INTEGER) AS position FROM n""")
def window_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.windows(window_stats(spark, sf_dir))


@query(f"""WITH {L_SQL}, n AS (SELECT 'sub_' || metric || '_' || zone_src || '_' || zone_dst AS name, value, "window" FROM l)
SELECT regexp_extract(name, '^sub_(.+)_([0-9]+)_([0-9]+)$', 1) AS metric, CAST(regexp_extract(name, '_([0-9]+)_([0-9]+)$', 1) AS INTEGER) AS zone_src, CAST(regexp_extract(name, '_([0-9]+)_([0-9]+)$', 2) AS INTEGER) AS zone_dst, name, "window", value FROM n""")
def stats_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = window_stats(spark, sf_dir).select(naming.zone_column(F.col("metric"), F.col("zone_src"), F.col("zone_dst")).alias("name"), "window", "value")
    metric, i, j = naming.parse_zone_column(F.col("name"))
    return named.select(metric.alias("metric"), i.alias("zone_src"), j.alias("zone_dst"), "name", "window", "value")


# ---- drill-down -----------------------------------------------------------


def _drill(metric: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return drill.behind(weighted(spark, sf_dir), metric)

    f.__name__ = "drill_" + metric
    query(f"WITH {W_SQL} {sql}")(f)


_drill("max_packets", "SELECT * FROM e WHERE packets = (SELECT max(packets) FROM e)")
for _metric, (_axis, _op) in drill.SOURCES.items():
    _drill(_metric, f", r AS (SELECT {_axis}, {_op}(packets) AS v FROM e GROUP BY 1) SELECT e.* FROM e SEMI JOIN (SELECT {_axis} FROM r WHERE v = (SELECT max(v) FROM r)) h USING ({_axis})")


@query(f"""WITH {WIN_SQL}, z AS (SELECT subwindow, {_zone("src")} AS zone_src, {_zone("dst")} AS zone_dst, src, dst, count(*) AS packets FROM w GROUP BY ALL),
t AS (SELECT subwindow, sum(packets) AS v FROM z WHERE zone_src = 1 AND zone_dst = 2 GROUP BY 1), b AS (SELECT subwindow FROM t ORDER BY v DESC, subwindow LIMIT 1)
SELECT src, dst, packets FROM z WHERE zone_src = 1 AND zone_dst = 2 AND subwindow = (SELECT subwindow FROM b)""")
def drill_argmax_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a cell in the window where it had the most packets."""
    cell = zones.label(matrix.from_packets(windowed(spark, sf_dir), ("subwindow",)), zone_table(spark)).where("zone_src = 1 and zone_dst = 2")
    best = cell.groupBy("subwindow").agg(F.sum("packets").alias("v")).orderBy(F.desc("v"), "subwindow").limit(1)
    return cell.join(best, "subwindow", "left_semi").select("src", "dst", "packets")


# ---- scalar functions -----------------------------------------------------

_IP = "concat_ws('.', (ip >> 24) & 255, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255)"
_IDS = "i AS (SELECT DISTINCT (l_partkey * 2147483 + l_suppkey) % 4294967296 AS ip FROM lineitem)"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 2147483 + F.col("l_suppkey")) % 4294967296).alias("ip")).distinct()


@query(f"WITH {_IDS} SELECT ip, {_IP} AS dotted, ip AS back FROM i")
def ip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).withColumn("dotted", ip.int_to_ip(F.col("ip"))).withColumn("back", ip.ip_to_int(F.col("dotted")))


@query(f"WITH {_IDS} SELECT ip, concat_ws('.', lpad(CAST((ip >> 24) & 255 AS VARCHAR), 3, '0'), lpad(CAST((ip >> 16) & 255 AS VARCHAR), 3, '0'), lpad(CAST((ip >> 8) & 255 AS VARCHAR), 3, '0'), lpad(CAST(ip & 255 AS VARCHAR), 3, '0')) AS padded, {_IP} AS unpadded FROM i")
def ip_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).withColumn("padded", ip.pad_ip(ip.int_to_ip(F.col("ip")))).withColumn("unpadded", ip.unpad_ip(F.col("padded")))


@query(f"WITH {_IDS} SELECT ip, (ip & 255) * 16777216 + ((ip >> 8) & 255) * 65536 + ((ip >> 16) & 255) * 256 + ((ip >> 24) & 255) AS swapped FROM i")
def byteswap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).withColumn("swapped", ip.byteswap32(F.col("ip")))


@query(f"WITH {_IDS} SELECT ip, xor(ip, CAST(2863311530 AS BIGINT)) AS masked FROM i")
def xor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).withColumn("masked", ip.xor_mask(F.col("ip")))


@query(f"WITH {_IDS} SELECT ip, ip % 33 AS bits, CASE WHEN ip % 33 = 0 THEN 0 ELSE (ip >> (32 - ip % 33)) << (32 - ip % 33) END AS lo, CASE WHEN ip % 33 = 0 THEN 4294967295 ELSE ((ip >> (32 - ip % 33)) << (32 - ip % 33)) + (CAST(1 AS BIGINT) << (32 - ip % 33)) - 1 END AS hi FROM i")
def cidr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ids(spark, sf_dir).withColumn("bits", F.col("ip") % 33)
    lo, hi = ip.bounds(F.concat(ip.int_to_ip(F.col("ip")), F.lit("/"), F.col("bits").cast("string")))
    return named.select("ip", "bits", lo.alias("lo"), hi.alias("hi"))


# ---- sources, sinks and the rest ------------------------------------------


@query(f"""WITH {E_SQL}, t AS (SELECT src, dst, packets, coalesce(CAST(sum(packets) OVER (ORDER BY src, dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM e),
x AS (SELECT src, dst, before + unnest(range(0, packets)) AS seq FROM t) SELECT src, dst, seq, 1000000 + (2000000 - 1000000) * seq // (SELECT sum(packets) FROM t)::BIGINT AS ts FROM x""")
def export_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each packet of each link, in matrix order, with times spread evenly."""
    return sinks.expand_packets(edges(spark, sf_dir), 1_000_000, 2_000_000).select("src", "dst", "seq", "ts")


@query("SELECT DISTINCT 'part-' || p_partkey || '.grb' AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string"), F.lit(".grb")).alias("path")
    return filters.not_processed(table(spark, sf_dir, "part").select(name("p_partkey")), table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(name("l_partkey")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 = 1")
def task_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.task_slice(table(spark, sf_dir, "nation"), "n_nationkey", 1, 4).select("n_nationkey", "n_name")


@query(f"WITH {S_SQL} SELECT count(*) AS total, count(*) FILTER (packets % 10 = 0) AS invalid FROM s")
def packet_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stream(spark, sf_dir).select(F.lit(2048).alias("ethertype"), F.when(F.col("packets") % 10 == 0, 6).otherwise(4).alias("ip_version"))
    return filters.counters(marked)


@query(f"WITH {S_SQL} SELECT seq, src, dst FROM s WHERE event_type = 'click' AND packets > 50")
def user_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.matching(stream(spark, sf_dir), "event_type = 'click' AND packets > 50").select("seq", "src", "dst")


@query(f"WITH {E_SQL} SELECT src * 43383508 AS src, dst, packets FROM e WHERE src * 43383508 < 4294967295")
def broadcast_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.no_broadcast(edges(spark, sf_dir).withColumn("src", F.col("src") * 43383508))


@query("WITH i AS (SELECT DISTINCT l_partkey AS dst FROM lineitem), r AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS n, count(*) OVER () AS c FROM i) SELECT dst FROM r WHERE n % greatest(1, (c + 49) // 50) = 0")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.every(packets(spark, sf_dir).select("dst").distinct(), "dst", 50)


@query("""WITH RECURSIVE i AS (SELECT DISTINCT l_partkey AS dst FROM lineitem), g AS (SELECT 40 * (max(dst) - min(dst)) / 480 AS gap FROM i),
t AS (SELECT min(dst) AS dst FROM i UNION ALL SELECT (SELECT min(i.dst) FROM i, g WHERE i.dst - t.dst >= g.gap) FROM t WHERE t.dst IS NOT NULL) SELECT dst FROM t WHERE dst IS NOT NULL""")
def axis_ticks_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.spaced(packets(spark, sf_dir).select("dst").distinct(), "dst")


@query(f"""WITH {L_SQL}, n AS (SELECT DISTINCT "window" FROM l) SELECT "window" FROM n ORDER BY "window" LIMIT 7 OFFSET 7""")
def window_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.page(window_stats(spark, sf_dir).select("window").distinct(), "window", 1, 7)


_SHOWN = " ".join(f"WHEN '{m}' THEN '{' '.join(w.capitalize() for w in m.split('_'))}'" for m in stats.QUANTITIES)


@query(f"""WITH {L_SQL} SELECT "window", CASE metric {_SHOWN} END AS shown, CASE zone_src WHEN 1 THEN 'suppliers' WHEN 2 THEN 'customers' ELSE 'elsewhere' END AS zone, value FROM l WHERE zone_dst = 3""")
def named_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_stats(spark, sf_dir).where("zone_dst = 3")
    names = ("suppliers", "customers", "elsewhere")
    return rows.select("window", display.metric_name(F.col("metric")).alias("shown"), display.zone_name(F.col("zone_src"), names).alias("zone"), "value")


@query(f"""WITH {WIN_SQL} SELECT subwindow AS "window", src, dst, count(*) AS packets FROM w WHERE subwindow = 1 AND {_zone("src")} = 1 AND {_zone("dst")} = 3 GROUP BY ALL""")
def cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a cell of the statistics to its links, by window and zones."""
    links = matrix.from_packets(windowed(spark, sf_dir), ("subwindow",)).withColumnRenamed("subwindow", "window")
    return display.links_of_cell(zones.label(links, zone_table(spark)), 1, 1, 3).select("window", "src", "dst", "packets")


#: The same under the name of an earlier version.
QUERIES["export_all_packets"], ORACLES["export_all_packets"] = export_packets, ORACLES["export_packets"]


# ---- files: written from the tables to the shared folder and read back ------


def _files(df: DataFrame, name: str, kind: str = "parquet", **options: str) -> str:
    """Write ``df`` to a fresh folder; its path."""
    path = fresh(df.sparkSession, name)
    df.write.format(kind).options(**options).save(path)
    return path


@query(f"WITH {E_SQL} SELECT * FROM e")
def capture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as a capture record, and the matrix of the captures."""
    path = fresh(spark, "captures")
    sinks.write_pcap(sinks.expand_packets(edges(spark, sf_dir), 1_000_000, 2_000_000), path, 8)
    return matrix.from_packets(streams.valid_links(readers.read_pcap(spark, path)).select("src", "dst"))


CAPTURED = "tcp and (net 0.0.0.0/26 or dst host 0.0.1.44) and not src host 0.0.0.5 and portrange 80-90 and less 40"


@query(f"WITH {E_SQL} SELECT * FROM e WHERE (src < 64 OR dst < 64 OR dst = 300) AND src <> 5")
def capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of captures, read in parts, that a capture filter lets through."""
    path = fresh(spark, "captures")
    sinks.write_pcap(sinks.expand_packets(edges(spark, sf_dir), 1_000_000, 2_000_000), path, 4, dport=80)
    return matrix.from_packets(filters.captured(readers.read_pcap(spark, path, part=1 << 18), CAPTURED).select("src", "dst"))


@query("SELECT l_suppkey AS src, count(*) AS packets, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem WHERE l_partkey BETWEEN 100 AND 900 AND l_suppkey < 50 GROUP BY 1")
def capture_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as a data source that tests what is asked on the records themselves."""
    path = fresh(spark, "captures")
    sinks.write_pcap(sinks.expand_packets(edges(spark, sf_dir), 1_000_000, 2_000_000), path, 4)
    datasource.register(spark)
    found = spark.read.format(datasource.NAME).option("part", 1 << 18).load(path)
    found = filters.captured(found, "src net 0.0.0.0/8").where("src < 50 and dst >= 100 and dst <= 900")
    return found.groupBy("src").agg(F.count("*").alias("packets"), F.min("dst").alias("least"), F.max("dst").alias("most"))


_FLOW_SQL = "f AS (SELECT l_suppkey AS src, o_custkey AS dst, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) - 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), l AS (SELECT src, dst, a AS packets FROM f UNION ALL SELECT dst, src, b FROM f)"


def flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: flow records of orders and their lines as JSON."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flow = F.struct(F.col("l_quantity").cast("long").alias("pkts_toserver"), (F.col("l_linenumber").cast("long") - 1).alias("pkts_toclient"))
    return rows.select(F.to_json(F.struct(ip.int_to_ip(F.col("l_suppkey")).alias("src_ip"), ip.int_to_ip(F.col("o_custkey")).alias("dest_ip"), flow.alias("flow"))).alias("value"))


@query(f"WITH {_FLOW_SQL} SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets FROM l WHERE packets > 0 GROUP BY ALL")
def json_flow_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.build(filters.flows_to_links(readers.read_flows(spark, _files(flow_lines(spark, sf_dir), "flows", "text"))))


@query(f"WITH {_FLOW_SQL} SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets FROM l WHERE packets > 0 GROUP BY ALL")
def flow_stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows as a stream of files, added to a stored matrix batch by batch."""
    folder, out = _files(flow_lines(spark, sf_dir).repartition(4), "flows", "text"), fresh(spark, "running")
    streams.accumulate(filters.flows_to_links(streams.flows_from_files(spark, folder, 2)), out, fresh(spark, "progress")).awaitTermination()
    return streams.accumulated(spark, out)


@query(f"WITH {W_SQL} SELECT * FROM e")
def tsv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("a"), F.lit("y").alias("b"), ip.int_to_ip(F.col("l_suppkey")).alias("src"), ip.int_to_ip(F.col("l_partkey")).alias("dst"), F.col("l_quantity").cast("long").alias("n"))
    return matrix.build(readers.read_tsv_links(spark, _files(rows, "tsv", "csv", sep="\t", header="true"), with_value=True))


@query(f"WITH {W_SQL} SELECT * FROM e")
def coo_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.links_of_coo(stored(sinks.dump_coo(weighted(spark, sf_dir)), "dumps"))


_FLAG = "f AS (SELECT l_returnflag AS flag, l_suppkey AS src, l_partkey AS dst, count(*) AS packets FROM lineitem GROUP BY ALL)"


def archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives with binary dumps, their members named after the return flag."""
    flags = ("A", "N", "R")
    parts = [sinks.dump_coo(flagged(spark, sf_dir, f)).select(F.concat(F.lit(f"{f}-"), F.uuid(), F.lit(".coo")).alias("member"), "content") for f in flags]
    path = fresh(spark, "archives")
    sinks.write_tar(stored(parts[0].unionAll(parts[1]).unionAll(parts[2]), "members").repartition(3, "member"), path)
    return path


@query(f"WITH {_FLAG} SELECT flag AS member, CAST(sum(packets) AS BIGINT) AS total, count(*) AS links FROM f GROUP BY 1")
def member_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the members of archives, without unpacking them."""
    found = readers.read_tar(spark, archives(spark, sf_dir))
    return found.groupBy(F.substring("member", 1, 1).alias("member")).agg(F.sum("packets").alias("total"), F.count("*").alias("links"))


@query(f"WITH {E_SQL} SELECT src, dst, 2 * packets AS packets FROM e")
def matrix_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and links, each given twice and in other spellings: every file counts once."""
    tars, links = archives(spark, sf_dir), _files(edges(spark, sf_dir), "links")
    m = TrafficMatrix(spark)
    m.update(tars)
    m.update(tars + "/", links)
    m.update(links.replace("/links-", "//links-"), tars.rsplit("/", 1)[0] + "/./" + tars.rsplit("/", 1)[1])
    return m.edges


def _long(n: int, cast: str) -> str:
    whole = f"WITH {_Z}, w AS ({_nine('e')}) SELECT CAST(NULL AS INTEGER) AS zone_src, CAST(NULL AS INTEGER) AS zone_dst, {_NINE} FROM w"
    return f"SELECT zone_src, zone_dst, metric, CAST(value AS {cast}) AS value FROM (UNPIVOT (({whole}) UNION ALL ({_grid(n)})) ON {_NINE} INTO NAME metric VALUE value)"


@query(_long(3, "BIGINT"))
def analyze_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quantities of a matrix of files, whole and for each pair of zones."""
    m = TrafficMatrix(spark, zone_table(spark))
    m.update(_files(stream_edges(spark, sf_dir), "links"))
    return m.analyze()


@query(f"SELECT 'w1' AS \"window\", * FROM ({_long(3, 'DOUBLE')})")
def process_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of window files summed and analyzed, without the times taken."""
    e = stream_edges(spark, sf_dir)
    files = [_files(e.where(F.pmod(F.hash("src", "dst"), F.lit(2)) == i), "window") for i in (0, 1)]
    listed = _files(spark.range(1).select(F.explode(F.array(*map(F.lit, [*files, files[0]]))).alias("value")), "list", "text")
    found = process_files(spark, "w1", readers.file_list(spark, listed), zone_table(spark))
    return found.where(F.col("metric").isin(*stats.QUANTITIES))


@query("SELECT l_suppkey % 3 + 1 AS zone, min(l_suppkey) AS lo, max(l_suppkey) + 2 AS hi FROM lineitem GROUP BY 1")
def address_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of overlapping ranges, a file a zone, read and merged."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("z"), F.concat_ws(":", ip.int_to_ip(F.col("l_suppkey")), ip.int_to_ip(F.col("l_suppkey") + 2)).alias("value"))
    lists = [_files(rows.where(F.col("z") == z).select("value"), "list", "text") for z in (0, 1, 2)]
    return zones.merge(readers.read_address_lists(spark, lists)).select(F.col("zone").cast("long").alias("zone"), "lo", "hi")


@query("SELECT CAST(zone AS BIGINT) AS zone, count(DISTINCT s) AS addresses FROM (SELECT l_suppkey % 3 + 1 AS zone, l_suppkey AS s FROM lineitem UNION ALL SELECT 4, l_suppkey FROM lineitem) GROUP BY 1")
def zone_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists inside an archive, with all ranges once more as the last zone."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("z"), ip.int_to_ip(F.col("l_suppkey")).alias("a")).distinct()
    members = rows.groupBy("z").agg(F.concat_ws("\n", F.collect_list(F.concat("a", F.lit("/32")))).cast("binary").alias("content")).select(F.concat(F.col("z").cast("string"), F.lit(".txt")).alias("member"), "content")
    path = fresh(spark, "zones")
    sinks.write_tar(members.coalesce(1), path)
    found = readers.read_zone_archive(spark, path, with_sum=True)
    return found.groupBy(F.col("zone").cast("long").alias("zone")).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("addresses"))


@query(f"""WITH {L_SQL} SELECT CAST("window" AS VARCHAR) AS "window", zone_src, zone_dst, metric, CAST(value AS DOUBLE) AS value FROM l""")
def stats_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "stats")
    sinks.write_stats(window_stats(spark, sf_dir), path)
    return readers.read_stats(spark, path)


@query(f"""WITH {L_SQL} SELECT CAST("window" AS VARCHAR) AS "window", zone_src, zone_dst, metric, CAST(CASE WHEN "window" % 3 = 0 THEN value + 1 ELSE value END AS DOUBLE) AS value FROM l
UNION ALL SELECT 'w' || l_suppkey, CAST(l_suppkey % 10 + 1 AS INTEGER), CAST(l_suppkey // 10 + 1 AS INTEGER), 'n_packets', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_suppkey""")
def stats_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes to a stored table: the second replaces a third of the cells, the last adds windows of other zones."""
    table_, found = fresh(spark, "stats"), window_stats(spark, sf_dir)
    stats_table.upsert_stats(found, table_)
    stats_table.upsert_stats(found.where(F.col("window") % 3 == 0).withColumn("value", F.col("value") + 1), table_)
    more = packets(spark, sf_dir).groupBy("src").count()
    named = more.select(F.concat(F.lit("w"), F.col("src").cast("string")).alias("window"), (F.col("src") % 10 + 1).alias("zone_src"), F.expr("src div 10 + 1").alias("zone_dst"), F.lit("n_packets").alias("metric"), F.col("count").alias("value"))
    stats_table.upsert_stats(named, table_)
    return stats_table.stored_stats(spark, table_)


@query(f"WITH {_FLAG} SELECT src, dst, CAST(sum(packets) AS BIGINT) AS packets, (SELECT count(DISTINCT flag) FROM f) AS files FROM f GROUP BY src, dst")
def matrix_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored sum that others go on with: each round opens it anew and is given all files so far, one of a kind of its own."""
    where, files = fresh(spark, "matrix"), []
    own = {".json": lambda spark, files: matrix.from_packets(spark.read.schema("src long, dst long").json(files))}
    for flag in ("A", "N", "R"):
        rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
        rows = rows.coalesce(1) if flag == "N" else matrix.from_packets(rows).coalesce(1)
        files.append(readers.paths(spark, _files(rows, f"round-{flag}", "json" if flag == "N" else "parquet")).first()[0])
        TrafficMatrix(spark, folder=where, readers=READERS | own).update(*files)
    again = TrafficMatrix(spark, folder=where)
    return again.edges.withColumn("files", F.lit(again.processed().count()))


@query(f"WITH {E_SQL} SELECT concat_ws('.', (src >> 24) & 255, (src >> 16) & 255, (src >> 8) & 255, src & 255) || ' ' || concat_ws('.', (dst >> 24) & 255, (dst >> 16) & 255, (dst >> 8) & 255, dst & 255) || ' ' || packets AS value FROM e")
def text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(_files(sinks.dump_text(edges(spark, sf_dir)), "text", "text"))


@query(f"WITH {E_SQL} SELECT count(*) AS links, count(DISTINCT src) AS \"rows\", count(DISTINCT dst) AS columns, CAST(sum(packets) AS BIGINT) AS packets FROM e")
def matrix_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.describe(edges(spark, sf_dir))


# ---- streams over the event table -------------------------------------------

_PACKED = 1000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("long")
    return raw.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("src"), k.alias("dst"), k.alias("packets"), "event_type")


_CUT = f"""{S_SQL}, r AS (SELECT *, CAST(sum(packets) OVER (PARTITION BY event_type ORDER BY seq) AS BIGINT) AS hi, CAST(sum(packets) OVER (PARTITION BY event_type) AS BIGINT) AS total FROM s WHERE packets > 0),
x AS (SELECT *, unnest(range((hi - packets) // {_PACKED}, (hi - 1) // {_PACKED} + 1)) AS subwindow FROM r),
c AS (SELECT event_type AS shard, subwindow, src, dst, CAST(sum(least(hi, (subwindow + 1) * {_PACKED}) - greatest(hi - packets, subwindow * {_PACKED})) AS BIGINT) AS packets, max(total) // {_PACKED} AS complete FROM x GROUP BY ALL)"""


@query(f"WITH {_CUT} SELECT shard, subwindow, src, dst, packets FROM c WHERE subwindow < complete")
def count_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete windows of each event type, cut by a stream with state."""
    out = fresh(spark, "windows")
    cut = stream_windows.count_windows(event_stream(spark, sf_dir), "event_type", "seq", _PACKED)
    stream_windows.append_windows(cut, out, fresh(spark, "progress")).awaitTermination()
    return spark.read.schema(stream_windows.LINKS).parquet(out)


@query(f"WITH {_CUT} SELECT shard, subwindow, src, dst, packets FROM c WHERE subwindow >= complete")
def count_window_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such a stream keeps back at its end."""
    return stream_windows.unfinished(stream(spark, sf_dir), "event_type", "seq", _PACKED)


_ENDS = "('flush', true), ('drop', false)"


def replayed(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Tables as a stream, one a micro-batch, in this order."""
    folder = fresh(spark, "replay")
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def after_all(rows: DataFrame, days: int) -> DataFrame:
    """One row of a shard ``end`` whose time lies far behind all others, which moves the watermark on."""
    last = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), F.lit("end").alias("event_type"))
    return last.select(*(F.col(f.name) if f.name in ("ts", "event_type") else F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema))


@query(f"WITH {_CUT} SELECT policy, shard, subwindow, src, dst, packets FROM c, (VALUES {_ENDS}) p(policy, flushed) WHERE flushed OR subwindow < complete")
def count_window_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each event type by a stream that flushes, and by one that drops, what is open at the end."""
    rows = stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [rows, after_all(rows, 30), after_all(rows, 60)]
    out = None
    for policy in ("flush", "drop"):
        path = fresh(spark, "windows")
        live = replayed(spark, parts).withWatermark("ts", "1 day")
        cut = stream_windows.count_windows(live, "event_type", "seq", _PACKED, at_end=policy, idle="1 day")
        stream_windows.append_windows(cut, path, fresh(spark, "progress")).awaitTermination()
        found = spark.read.schema(stream_windows.LINKS).parquet(path).where("shard <> 'end'").withColumn("policy", F.lit(policy))
        out = found if out is None else out.unionAll(found)
    return out


@query(f"""WITH {S_SQL}, r AS (SELECT *, CAST(sum(packets) OVER (ORDER BY seq) AS BIGINT) AS hi, CAST(sum(packets) OVER () AS BIGINT) AS total FROM s WHERE packets > 0),
x AS (SELECT *, unnest(range((hi - packets) // {_PACKED}, (hi - 1) // {_PACKED} + 1)) AS subwindow FROM r)
SELECT subwindow, src, dst, CAST(sum(least(hi, (subwindow + 1) * {_PACKED}) - greatest(hi - packets, subwindow * {_PACKED})) AS BIGINT) AS packets FROM x WHERE subwindow < total // {_PACKED} GROUP BY ALL""")
def global_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all event types together, by a stream of several micro-batches."""
    rows, out = stream(spark, sf_dir), fresh(spark, "windows")
    n = rows.agg(F.max("seq")).first()[0] + 1
    parts = [rows.where((F.col("seq") >= n * i // 4) & (F.col("seq") < n * (i + 1) // 4)) for i in range(4)]
    stream_windows.global_windows(replayed(spark, parts), "seq", _PACKED, out, fresh(spark, "progress")).awaitTermination()
    return stream_windows.windows_so_far(spark, out)


# Events come in four parts by time. Some of the first part come three parts late, which is past the watermark; some
# of the ends of the others come one part late, which isn't.
_PART = "(epoch_us(ts) - lo) * 4 // (hi - lo + 1)"
_LATE = f"{S_SQL}, b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM s), o AS (SELECT s.* FROM s, b WHERE NOT ({_PART} = 0 AND seq % 50 = 7))"


def late_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as such a stream with a watermark."""
    rows = stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.unix_micros("ts") - lo
    part = F.floor(at * 4 / (hi - lo + 1))
    fraction = at * 4 % (hi - lo + 1) / (hi - lo + 1)
    come = F.when((part == 0) & (F.col("seq") % 50 == 7), 3).when((part < 3) & (fraction >= 0.6) & (F.col("seq") % 50 == 9), part + 1).otherwise(part)
    placed = rows.withColumn("come", come)
    days = (hi - lo) // 86_400_000_000 + 2
    parts = [placed.where(F.col("come") == i).drop("come") for i in range(4)] + [after_all(rows, 10 * days), after_all(rows, 20 * days)]
    return replayed(spark, parts), f"{(hi - lo) // 8_000_000} seconds"


def _appended(spark: SparkSession, found: DataFrame, last: str) -> DataFrame:
    out = fresh(spark, "windows")
    stream_windows.append_windows(found, out, fresh(spark, "progress")).awaitTermination()
    kept = spark.read.schema(found.schema).parquet(out).where(F.col("w.start") <= F.lit(last).cast("timestamp"))
    return kept.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "src", "dst", "packets")


def _last(spark: SparkSession, sf_dir: str) -> str:
    return str(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])


@query(f"WITH {_LATE} SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", src, dst, count(*) AS packets FROM o GROUP BY ALL")
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by time over several micro-batches: the watermark closes them, and rows past it are left out."""
    live, late = late_parts(spark, sf_dir)
    return _appended(spark, stream_windows.time_windows(live, "1 hour", late), _last(spark, sf_dir))


@query(f"WITH {_LATE}, h AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM o) SELECT start, start + INTERVAL 2 HOUR AS \"end\", src, dst, count(*) AS packets FROM h GROUP BY ALL")
def late_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, late = late_parts(spark, sf_dir)
    return _appended(spark, stream_windows.sliding_windows(live, "2 hours", "1 hour", late), _last(spark, sf_dir))


@query(f"""WITH {_LATE}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY src, dst ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM o),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY src, dst ORDER BY ts) AS nth FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", src, dst, count(*) AS packets FROM n GROUP BY src, dst, nth""")
def late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, late = late_parts(spark, sf_dir)
    return _appended(spark, stream_windows.sessions(live, "6 hours", late), _last(spark, sf_dir))


@query(f"WITH {S_SQL} SELECT date_trunc('hour', ts) AS start, src, dst, count(*) AS packets FROM s GROUP BY ALL")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_windows.time_windows(stream(spark, sf_dir), "1 hour", "1 hour")
    return found.select(F.col("w.start").alias("start"), "src", "dst", "packets")


@query(f"WITH {S_SQL} SELECT event_type, date_trunc('second', ts) AS second, count(*) AS total, count(*) FILTER (packets % 10 = 0) AS invalid FROM s GROUP BY ALL")
def packet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stream(spark, sf_dir).select("event_type", "ts", F.lit(2048).alias("ethertype"), F.when(F.col("packets") % 10 == 0, 6).otherwise(4).alias("ip_version"))
    return filters.rates(marked, ("event_type",))


@query(f"""WITH {S_SQL}, r AS (SELECT event_type AS ring, ts, packets AS dropped, lag(packets) OVER (PARTITION BY event_type ORDER BY ts, seq) AS b FROM (SELECT DISTINCT ON (event_type, ts) * FROM s ORDER BY event_type, ts, seq))
SELECT ring, date_trunc('second', ts) AS second, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN dropped < b THEN dropped ELSE dropped - b END) AS BIGINT) AS dropped FROM r GROUP BY ALL""")
def drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a counter for each ring; of equal times the first."""
    first = stream(spark, sf_dir).groupBy(F.col("event_type").alias("ring"), "ts").agg(F.min_by("packets", "seq").alias("dropped"))
    return filters.drops(first)


@query(f"""WITH {S_SQL}, m AS (SELECT ts, seq, event_type, CASE WHEN dst % 10 = 0 THEN 'START ' || seq WHEN dst % 10 = 1 THEN 'END ' || seq ELSE 'noise' END AS text FROM s),
k AS (SELECT *, CASE WHEN text LIKE '%START%' THEN 'START' WHEN text LIKE '%END%' THEN 'END' END AS mark FROM m WHERE text <> 'noise'),
b AS (SELECT *, last_value(CASE WHEN mark = 'START' THEN ts END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts) AS started FROM k)
SELECT ts, event_type, text, mark, started, CASE WHEN mark = 'END' THEN CAST(epoch_us(ts) - epoch_us(started) AS DOUBLE) / 1000000 END AS elapsed FROM b""")
def event_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and ends in the log of each event type, and the seconds between them."""
    text = F.when(F.col("dst") % 10 == 0, F.concat(F.lit("START "), F.col("seq").cast("string"))).when(F.col("dst") % 10 == 1, F.concat(F.lit("END "), F.col("seq").cast("string"))).otherwise("noise")
    return markers.spans(stream(spark, sf_dir).select("ts", "event_type", text.alias("text")), ("event_type",))


# ---- the rest ------------------------------------------------------------------


@query(f"WITH {E_SQL} SELECT src, dst, packets, CASE WHEN dst % 4 < 3 AND dst < 800 THEN CAST(dst % 800 // 400 + 1 AS INTEGER) ELSE 3 END AS zone_dst FROM e")
def zone_overlapping_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zones of two hundred ranges that repeat and overlap within their zone, most of them in one block."""
    i = spark.range(400).select((F.col("id") % 200).alias("i"), (F.col("id") >= 200).cast("long").alias("turn"))
    many = i.select(F.expr("cast(i div 100 + 1 as int)").alias("zone"), F.expr("4 * i + turn").alias("lo"), F.expr("4 * i + 1 + turn").alias("hi"))
    return zones.label(edges(spark, sf_dir), many).select("src", "dst", "packets", "zone_dst")


@query(f"""WITH {L_SQL}, p AS (SELECT zone_src, zone_dst, max(value) FILTER (metric = 'n_packets' AND "window" = 1) AS x, max(value) FILTER (metric = 'n_sources' AND "window" = 1) AS y FROM l GROUP BY ALL) SELECT zone_src, zone_dst, {_ratio("x", "y")} AS ratio FROM p""")
def ratio_one_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.metric_ratio(window_stats(spark, sf_dir), "value", "n_packets", "n_sources", 1)


@query(f"""WITH {_ZS}, g AS (SELECT zone_src, zone_dst, round(CAST(z AS DOUBLE), 9) AS z FROM zs WHERE metric = 'n_packets' AND "window" = 1) SELECT zone_src, max(z) FILTER (zone_dst = 1) AS z1, max(z) FILTER (zone_dst = 2) AS z2, max(z) FILTER (zone_dst = 3) AS z3 FROM g GROUP BY 1""")
def zscore_window_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeseries.window_z_scores(window_stats(spark, sf_dir), "n_packets", 1, 3)
    return found.select("zone_src", *(F.round(f"z{j}", 9).alias(f"z{j}") for j in (1, 2, 3)))


@query(f"WITH {_IDS} SELECT ip, ip AS whole, ip AS two, ip AS hexed FROM i")
def ip_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the looser forms that C libraries read."""
    at = F.col("ip")
    two = F.concat(F.shiftright(at, 24).cast("string"), F.lit("."), at.bitwiseAND(F.lit(0xFFFFFF)).cast("string"))
    return ids(spark, sf_dir).select("ip", ip.lenient_ip_to_int(at.cast("string")).alias("whole"), ip.lenient_ip_to_int(two).alias("two"), ip.lenient_ip_to_int(F.concat(F.lit("0x"), F.hex(at))).alias("hexed"))


_WIDE = "(10 + l_suppkey % 2 * 2) * 16777216"


@query(f"""WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem), a AS (SELECT 1 AS zone, unnest(range(l_suppkey * 256, l_suppkey * 256 + 301)) AS ip FROM s UNION SELECT 2, unnest(range({_WIDE} + 16777216, {_WIDE} + 16777417)) FROM s),
i AS (SELECT zone, xor(ip, {_FLIPS}) AS lo, xor(ip, {_FLIPS}) AS hi FROM a UNION SELECT 2, {_WIDE}, {_WIDE} + 16777215 FROM s),
r AS (SELECT *, max(hi) OVER (PARTITION BY zone ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT zone, CAST(sum(hi - lo + 1) AS BIGINT) AS addresses, count(*) FILTER (reach IS NULL OR lo > reach + 1) AS intervals, min(lo) AS lowest, max(hi) AS highest FROM r GROUP BY 1""")
def keyed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lists, two ranges of 2**24 addresses and more among them, mapped with the key of the matrix that they shall fit."""
    supp = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    one = supp.select(F.lit(1).alias("zone"), (F.col("l_suppkey") * 256).alias("lo"), (F.col("l_suppkey") * 256 + 300).alias("hi"))
    wide = supp.select(F.lit(2).alias("zone"), F.expr(_WIDE).alias("lo"), F.expr(f"{_WIDE} + 16777416").alias("hi"))
    mapped = anonymize.zone_table(one.unionAll(wide), KEY)
    return mapped.groupBy("zone").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("addresses"), F.count("*").alias("intervals"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
