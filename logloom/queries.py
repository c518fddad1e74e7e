"""The registered queries over plain tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, names
from .functions import time as t
from .functions import vectors as v
from .operators import align, density, exports, manifests, numbering, search, sequences, spatial, topics
from .sources import views
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WINDOWS = {"bag_0": [(0, 4), (7, 8)], "bag_1": [(2, 6)]}
TOPICS = [f"/camera_{i}" for i in range(6)]
POLYGON = [(51.01, 12.01), (51.09, 12.02), (51.06, 12.08), (51.10, 12.14), (51.02, 12.12), (51.04, 12.06)]
SQUARE = [(51.11, 12.11), (51.12, 12.11), (51.12, 12.12), (51.11, 12.12)]
IN_WINDOWS = "(bag NOT IN ('bag_0', 'bag_1') OR (bag = 'bag_0' AND (CAST(mcap_identifier AS int) BETWEEN 0 AND 4 OR CAST(mcap_identifier AS int) BETWEEN 7 AND 8)) OR (bag = 'bag_1' AND CAST(mcap_identifier AS int) BETWEEN 2 AND 6))"
IN_TOPICS = "topic IN (" + ", ".join(f"'{x}'" for x in TOPICS) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (views.SQL + ("," if sql.lstrip()[0] == "+" else "") + sql.lstrip().lstrip("+")) if "v_" in sql else sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def timeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = views.messages(spark, d)
    return m, m.select("bag", "mcap_id", F.col("log_time_ns").alias("ref_ts"), "sequence")


# ---- search ----

ASKED = "q AS (SELECT id AS query_id, embedding AS qv FROM v_manifest WHERE id % 100 = 0)"
FOUND = f"""+ {ASKED}, f AS (SELECT * FROM v_manifest WHERE minute_of_day BETWEEN 60 AND 1300 AND {IN_WINDOWS} AND {IN_TOPICS}),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, bag, topic ORDER BY timestamp_ns, id) - 1 AS nth FROM f) WHERE nth % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, model, bag ORDER BY d, id) AS local_rank FROM (SELECT s.*, query_id, list_distance(embedding, qv) ^ 2 AS d, list_cosine_similarity(embedding, qv) AS c FROM s, q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, model, bag, local_rank) AS rank FROM k WHERE local_rank <= 100)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100 asks all rows behind the filters."""
    m = views.manifest(spark, d)
    return search.search(m, search.query_rows(m), (60, 1300), WINDOWS, TOPICS, 2)


@query(FOUND + " SELECT query_id, CAST(rank AS int) AS rank, bag, topic, id, CAST(local_rank AS int) AS local_rank, round(d, 6) AS distance, round(c, 6) AS cosine FROM r")
def search_global_rank(spark, d):
    """FLT-1..3, WIN-1, WIN-3, WIN-4, TOP-1, TOP-2, SRC-12, SRC-19, JN-7, JN-8, SET-2, SET-3."""
    return rounded(found(spark, d).select("query_id", "rank", "bag", "topic", "id", "local_rank", "distance", "cosine"), 6, "distance", "cosine")


@query(FOUND + " SELECT query_id, CAST(rank AS int) AS rank, model, bag, topic, mcap_identifier AS mcap, CAST(timestamp_ns AS varchar) AS ts, strftime(make_timestamp(timestamp_ns // 1000) + interval 1 hour, '%H:%M') AS minute_local, round(d, 6) AS score FROM r")
def search_result_rows(spark, d):
    """PRJ-1, FN-2."""
    return rounded(search.result_rows(found(spark, d)), 6, "score")


@query(FOUND + " SELECT query_id, CAST(rank AS int) AS rank, bag, topic, id FROM r WHERE rank <= 12")
def search_first_page(spark, d):
    """TOP-3."""
    return manifests.page(found(spark, d), by=("query_id",)).select("query_id", "rank", "bag", "topic", "id")


@query(FOUND + " SELECT query_id, model, bag, topic, id // 10 AS value, CAST(min(rank) AS int) AS rank FROM r GROUP BY ALL")
def search_marks_best_rank(spark, d):
    """AGG-12, JN-13."""
    return search.marks(found(spark, d), t.div(F.col("id"), 10))


@query(FOUND + ", m AS (SELECT query_id, model, bag, topic, id // 10 AS value, min(rank) AS rank FROM r GROUP BY ALL) SELECT query_id, model, bag, topic, string_agg(value || ':' || rank, ',' ORDER BY value) AS marks FROM m GROUP BY ALL")
def search_marks_nested(spark, d):
    """AGG-13, FN-28."""
    nested = search.nested_marks(search.marks(found(spark, d), t.div(F.col("id"), 10)))
    flat = nested.select("query_id", "model", "bag", F.explode("topics").alias("topic", "m"))
    return flat.select("query_id", "model", "bag", "topic", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["value"].cast("string"), x["rank"].cast("string"))), ",").alias("marks"))


@query(f"+ {ASKED}, k AS (SELECT query_id, id, list_distance(embedding, qv) ^ 2 AS dd FROM v_manifest, q) SELECT query_id, id, round(dd, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dd, id) AS n FROM k) WHERE n <= 100")
def vector_topk_l2(spark, d):
    """TOP-1 over one group, FN-14."""
    m = views.manifest(spark, d)
    return rounded(search.nearest_to(m, search.query_rows(m), 100, ("model",)).select("query_id", "id", "distance"), 6, "distance")


@query(f"+ {ASKED}, k AS (SELECT query_id, bag, id, list_distance(embedding, qv) ^ 2 AS dd FROM v_manifest, q) SELECT query_id, bag, id, CAST(n AS int) AS local_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bag ORDER BY dd, id) AS n FROM k) WHERE n <= 20")
def vector_topk_per_bag(spark, d):
    m = views.manifest(spark, d)
    return search.nearest_to(m, search.query_rows(m), 20).select("query_id", "bag", "id", "local_rank")


@query("+ f AS (SELECT *, row_number() OVER (PARTITION BY bag, mcap_id, topic ORDER BY log_time_ns, sequence) - 1 AS nth FROM v_messages) SELECT bag, mcap_id, topic, sequence FROM f WHERE nth % 10 = 0")
def stride_sample_per_topic(spark, d):
    """WIN-1."""
    return search.stride(views.messages(spark, d), 10, ["bag", "mcap_id", "topic"], ["log_time_ns", "sequence"]).select("bag", "mcap_id", "topic", "sequence")


@query(f"+ g AS (SELECT model, bag, topic, count(*) AS total, count_if({IN_WINDOWS}) AS m, count_if({IN_WINDOWS} AND {IN_TOPICS}) AS tp, count_if({IN_WINDOWS} AND {IN_TOPICS} AND minute_of_day BETWEEN 60 AND 1300) AS ti FROM v_manifest GROUP BY ALL) SELECT CAST(sum(total) AS bigint) AS total, CAST(sum(m) AS bigint) AS after_mcap, CAST(sum(tp) AS bigint) AS after_topic, CAST(sum(ti) AS bigint) AS after_time, CAST(sum(ceil(ti / 3.0)) AS bigint) AS after_sample FROM g")
def pipeline_funnel_counts(spark, d):
    """AGG-6."""
    return search.funnel(views.manifest(spark, d), WINDOWS, TOPICS, (60, 1300), 3)


@query(f"+ x AS (SELECT 1) SELECT id, minute_of_day FROM v_manifest WHERE minute_of_day BETWEEN 100 AND 200 AND {IN_WINDOWS}")
def minute_and_window_filter(spark, d):
    """FLT-1, FLT-2 by a table of windows, FN-1."""
    w = spark.createDataFrame([(b, lo, hi) for b, rs in WINDOWS.items() for lo, hi in rs], "bag string, lo int, hi int")
    return search.in_windows_table(search.in_minutes(views.manifest(spark, d), 100, 200), w).select("id", "minute_of_day")


@query("+ w AS (SELECT *, lead(embedding) OVER z AS n, lead(timestamp_ns) OVER z AS nt, row_number() OVER z - 1 AS seq FROM v_manifest WINDOW z AS (PARTITION BY model, bag, topic ORDER BY timestamp_ns, id)) SELECT bag, topic, CAST(seq AS bigint) AS seq, timestamp_ns AS ts, nt AS next_ts, round(list_cosine_similarity(embedding, n), 5) AS similarity FROM w WHERE n IS NOT NULL")
def adjacent_similarity(spark, d):
    """WIN-2."""
    out = density.adjacent_similarity(views.manifest(spark, d)).withColumn("seq", F.col("seq").cast("long"))
    return rounded(out.drop("model"), 5, "similarity")


SERIES = "+ w AS (SELECT *, lead(embedding) OVER z AS n, row_number() OVER z - 1 AS seq FROM v_manifest WINDOW z AS (PARTITION BY model, bag, topic ORDER BY timestamp_ns, id)), a AS (SELECT bag, topic, seq, list_cosine_similarity(embedding, n) AS s FROM w WHERE n IS NOT NULL), c AS (SELECT bag, topic, count(*) AS n, greatest(5, count(*) // 200) AS w FROM a GROUP BY ALL)"


@query(SERIES + " SELECT bag, topic, CAST(seq - w + 1 AS bigint) AS seq, round(mean, 5) AS mean FROM (SELECT a.bag, a.topic, a.seq, c.w, (SELECT avg(b.s) FROM a b WHERE b.bag = a.bag AND b.topic = a.topic AND b.seq > a.seq - c.w AND b.seq <= a.seq) AS mean FROM a JOIN c USING (bag, topic)) WHERE seq >= w - 1")
def similarity_moving_average(spark, d):
    """WIN-9."""
    out = density.moving_average(density.adjacent_similarity(views.manifest(spark, d)), ["model", "bag", "topic"])
    return rounded(out.select("bag", "topic", F.col("seq").cast("long").alias("seq"), "mean"), 5, "mean")


@query(SERIES + ", x AS (SELECT bag, topic, c.n, k, k * (c.n - 1) / 99.0::double AS p FROM c, range(100) r(k)) SELECT x.bag, x.topic, CAST(k AS int) AS k, round(lo.s + (hi.s - lo.s) * (p - floor(p)), 5) AS value FROM x JOIN a lo ON lo.bag = x.bag AND lo.topic = x.topic AND lo.seq = floor(p) JOIN a hi ON hi.bag = x.bag AND hi.topic = x.topic AND hi.seq = least(floor(p) + 1, x.n - 1)")
def similarity_resample(spark, d):
    """WIN-10."""
    out = density.resampled(density.adjacent_similarity(views.manifest(spark, d)), ["model", "bag", "topic"], "seq", "similarity", 100)
    return rounded(out.select("bag", "topic", "k", "value"), 5, "value")


LONG = ", l AS (SELECT a.bag, a.topic, a.seq - c.w + 1 AS seq, (SELECT avg(b.s) FROM a b WHERE b.bag = a.bag AND b.topic = a.topic AND b.seq > a.seq - c.w AND b.seq <= a.seq) AS s FROM a JOIN c USING (bag, topic) WHERE c.n >= 1000 AND a.seq >= c.w - 1), u AS (SELECT bag, topic, seq, s FROM a JOIN c USING (bag, topic) WHERE c.n < 1000 UNION ALL SELECT * FROM l), z AS (SELECT bag, topic, max(seq) + 1 AS n FROM u GROUP BY ALL), x AS (SELECT bag, topic, n, k, k * (n - 1) / 999.0::double AS p FROM z, range(1000) r(k))"


@query(SERIES + LONG + " SELECT x.bag, x.topic, CAST(k AS int) AS k, round(1 - (lo.s + (hi.s - lo.s) * (p - floor(p))), 5) AS value FROM x JOIN u lo ON lo.bag = x.bag AND lo.topic = x.topic AND lo.seq = floor(p) JOIN u hi ON hi.bag = x.bag AND hi.topic = x.topic AND hi.seq = least(floor(p) + 1, x.n - 1)")
def similarity_strip(spark, d):
    """SNK-8: 1000 values for each series."""
    strip = density.heat_strip(density.adjacent_similarity(views.manifest(spark, d)))
    return strip.select("bag", "topic", F.posexplode("strip").alias("k", "value")).withColumn("value", F.round("value", 5))


MARKS = FOUND + ", m AS (SELECT query_id, bag, CAST(id AS double) / 2000 AS pos, CAST(rank AS int) AS rank FROM r), w AS (SELECT query_id, bag, pos, 1 - 0.8::double * least(rank - 1, 99) / 99.0 AS wt FROM m)"


def marked(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("query_id", "bag", (F.col("id") / 2000.0).alias("pos"), "rank")


@query(MARKS + " SELECT query_id, bag, CAST(bin AS int) AS bin, round(sum(wt * (1 - abs(bin - pos * 1000) / 50)), 7) AS score FROM w, range(1000) b(bin) WHERE abs(bin - pos * 1000) < 50 GROUP BY ALL")
def mark_density_bins(spark, d):
    """AGG-22, FN-15."""
    return rounded(density.mark_density(marked(spark, d), ["query_id", "bag"]), 7, "score")


@query(MARKS + ", c AS (SELECT DISTINCT query_id, bag, pos FROM m), sm AS (SELECT c.query_id, c.bag, c.pos, sum(wt * (1 - abs(w.pos - c.pos) / 0.05::double)) AS s FROM c JOIN w ON w.query_id = c.query_id AND w.bag = c.bag AND abs(w.pos - c.pos) < 0.05::double GROUP BY ALL) SELECT query_id, bag, round(greatest(max(s), 1), 6) AS peak FROM sm GROUP BY ALL")
def density_global_maximum(spark, d):
    """AGG-23."""
    return rounded(density.density_maximum(marked(spark, d), ["query_id", "bag"]), 6, "peak")


# ---- timelines ----

REF = "+ c AS (SELECT bag, mcap_id, topic, count(*) AS n, min(log_time_ns) AS a, max(log_time_ns) AS b FROM v_messages GROUP BY ALL), ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag, mcap_id ORDER BY n DESC, a) AS z FROM c) WHERE z = 1)"
TICKS = REF + ", st AS (SELECT *, CASE WHEN n > 1 THEN (b - a)::double / (n - 1) / 2.0 END AS h FROM ref), sp AS (SELECT *, (a::double + h) - a::double AS eff FROM st), ticks AS (SELECT bag, mcap_id, i AS ref_idx, CAST(trunc(a::double + i * eff) AS bigint) AS ref_ts FROM (SELECT *, unnest(range(0, CAST(ceil((b::double - a::double) / h) AS bigint))) AS i FROM sp WHERE n > 1 AND h > 0) UNION ALL SELECT bag, mcap_id, 0, a FROM sp WHERE n <= 1 OR h = 0)"
WIDE = 500_000_000_000


def aligned(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages(spark, d)
    return align.nearest_messages(align.uniform_timeline(m), m, WIDE)


NEAR = TICKS + f", tp AS (SELECT DISTINCT bag, mcap_id, topic FROM v_messages), pr AS (SELECT k.bag, k.mcap_id, k.ref_idx, k.ref_ts, tp.topic FROM ticks k JOIN tp USING (bag, mcap_id)), al AS (SELECT p.bag, p.mcap_id, p.ref_idx, p.ref_ts, p.topic, CASE WHEN abs(v - p.ref_ts) < {WIDE} THEN v END AS topic_ts FROM (SELECT p.*, CASE WHEN lo.log_time_ns IS NULL THEN hi.log_time_ns WHEN hi.log_time_ns IS NULL THEN lo.log_time_ns WHEN p.ref_ts - lo.log_time_ns <= hi.log_time_ns - p.ref_ts THEN lo.log_time_ns ELSE hi.log_time_ns END AS v FROM pr p ASOF LEFT JOIN v_messages lo ON p.bag = lo.bag AND p.mcap_id = lo.mcap_id AND p.topic = lo.topic AND p.ref_ts >= lo.log_time_ns ASOF LEFT JOIN v_messages hi ON p.bag = hi.bag AND p.mcap_id = hi.mcap_id AND p.topic = hi.topic AND p.ref_ts <= hi.log_time_ns) p)"


@query(REF + " SELECT bag, mcap_id, topic, n FROM ref")
def reference_topic_argmax(spark, d):
    """AGG-8."""
    return align.reference_topics(views.messages(spark, d)).select("bag", "mcap_id", "topic", "n")


@query(REF + " SELECT bag, mcap_id, CAST(floor((b - a)::double / (n - 1) / 2.0) AS bigint) AS half_interval FROM ref WHERE n > 1")
def mean_interval(spark, d):
    """AGG-9."""
    return align.reference_topics(views.messages(spark, d)).where("n > 1").select("bag", "mcap_id", F.floor("half_interval").alias("half_interval"))


@query(TICKS + " SELECT bag, mcap_id, ref_idx, ref_ts FROM ticks")
def uniform_timeline(spark, d):
    """WIN-12."""
    return align.uniform_timeline(views.messages(spark, d))


@query(NEAR + " SELECT bag, mcap_id, ref_idx, ref_ts, topic, topic_ts FROM al")
def nearest_alignment(spark, d):
    """JN-1, FLT-11, SNK-1 in long form."""
    return aligned(spark, d)


@query(NEAR + " SELECT bag, mcap_id, ref_idx, ref_ts, max(abs(topic_ts - ref_ts)) AS max_distance FROM al GROUP BY ALL")
def alignment_max_distance(spark, d):
    """AGG-10."""
    return align.max_distances(aligned(spark, d))


@query(NEAR + " SELECT bag, topic, count(topic_ts) AS n_aligned, count(*) AS n_ticks, round(count(topic_ts) / count(*), 6) AS share FROM al GROUP BY ALL")
def alignment_stats(spark, d):
    """AGG-11."""
    return rounded(align.alignment_stats(aligned(spark, d)), 6, "share")


@query(NEAR + " SELECT bag, mcap_id, ref_idx, string_agg(topic || '=' || coalesce(CAST(topic_ts AS varchar), ''), ';' ORDER BY topic) AS topics FROM al GROUP BY ALL")
def reference_row_maps(spark, d):
    """PRJ-5, FLT-9."""
    m = align.topic_map(aligned(spark, d))
    pair = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    return m.select("bag", "mcap_id", "ref_idx", F.array_join(F.transform(F.array_sort(F.map_entries("topics")), pair), ";").alias("topics"))


@query("+ s AS (SELECT bag, mcap_id, count(*) AS count, min(log_time_ns) AS first_ts, max(log_time_ns) AS last_ts FROM v_messages GROUP BY ALL) SELECT bag, mcap_id, count, first_ts, last_ts, CAST(coalesce(sum(count) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_index FROM s")
def timeline_summary(spark, d):
    """AGG-7, WIN-5, SNK-2."""
    return align.summaries(timeline(spark, d)[1])


@query("+ s AS (SELECT bag, mcap_id, count(*) AS c, min(log_time_ns) AS a, max(log_time_ns) AS b FROM v_messages GROUP BY ALL) SELECT bag, CAST(sum(c) AS bigint) AS total_count, min(a) AS first_ts, max(b) AS last_ts, count(*) AS segments FROM s GROUP BY bag")
def bag_totals(spark, d):
    """AGG-7 totals."""
    return align.bag_totals(align.summaries(timeline(spark, d)[1])).select("bag", "total_count", "first_ts", "last_ts", F.size("mcap_ranges").cast("long").alias("segments"))


@query("+ i AS (SELECT bag, mcap_id, row_number() OVER (PARTITION BY bag ORDER BY log_time_ns, CAST(mcap_id AS int)) - 1 AS idx FROM v_messages), s AS (SELECT bag, mcap_id, n, coalesce(sum(n) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT bag, mcap_id, count(*) AS n FROM v_messages GROUP BY ALL)) SELECT i.bag, idx, s.mcap_id, CAST(idx - a AS bigint) AS \"offset\" FROM i JOIN s ON i.bag = s.bag AND idx >= a AND idx < a + n")
def index_to_segment(spark, d):
    """JN-4, WIN-6."""
    rows = timeline(spark, d)[1]
    idx = align.global_index(rows).select("bag", F.col("idx").cast("long").alias("idx"))
    return align.segment_of_index(idx, align.summaries(rows))


@query("+ r AS (SELECT bag, row_number() OVER (PARTITION BY bag ORDER BY log_time_ns, sequence) - 1 AS idx, CASE WHEN sequence % 7 = 0 THEN sequence END AS val FROM v_messages) SELECT r.bag, r.idx, (SELECT arg_min(q.val, (abs(q.idx - r.idx), q.idx)) FROM r q WHERE q.bag = r.bag AND q.val IS NOT NULL AND abs(q.idx - r.idx) <= 5) AS found FROM r")
def nearest_non_null_probe(spark, d):
    """JN-9."""
    m = numbering.numbered(views.messages(spark, d), ["bag"], ["log_time_ns", "sequence"])
    m = m.withColumn("val", F.when(F.col("sequence") % 7 == 0, F.col("sequence")))
    return align.nearest_non_null(m, ["bag"], "idx", "val", 5).select("bag", F.col("idx").cast("long").alias("idx"), "found")


@query(NEAR + ", g AS (SELECT bag, ref_ts, row_number() OVER (PARTITION BY bag ORDER BY ref_ts, CAST(mcap_id AS int)) - 1 AS idx FROM (SELECT DISTINCT bag, mcap_id, ref_ts FROM al)), u AS (SELECT bag, ref_ts AS ts, ref_ts, idx, '' AS c FROM g UNION ALL SELECT al.bag, topic_ts, al.ref_ts, idx, topic FROM al JOIN g ON g.bag = al.bag AND g.ref_ts = al.ref_ts WHERE topic_ts IS NOT NULL), f AS (SELECT bag, ts, arg_min(ref_ts, (idx, c)) AS ref_ts, min(idx) AS ref_idx FROM u GROUP BY ALL) SELECT m.bag, m.topic, m.log_time_ns AS ts, f.ref_ts, f.ref_idx FROM v_messages m LEFT JOIN f ON f.bag = m.bag AND f.ts = m.log_time_ns")
def first_hit_reference_index(spark, d):
    """JN-3."""
    return align.reference_index_of(aligned(spark, d), views.messages(spark, d).select("bag", "topic", F.col("log_time_ns").alias("ts")))


@query("+ x AS (SELECT 1) SELECT bag, topic, sequence, log_time_ns - lag(log_time_ns) OVER (PARTITION BY bag, topic ORDER BY log_time_ns) AS step FROM v_messages")
def successive_difference(spark, d):
    """WIN-11."""
    return align.successive_differences(views.messages(spark, d), ["bag", "topic"], "log_time_ns").select("bag", "topic", "sequence", "step")


# ---- space ----

CELLS = "+ cells AS (SELECT bag, coalesce(mcap_id, 'unknown') AS mcap_id, CAST(round_even(lat / 0.0001::double, 0) AS bigint) AS lat_idx, CAST(round_even(lon / 0.0001::double, 0) AS bigint) AS lon_idx, count(*) AS cnt FROM v_positions GROUP BY ALL)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return spatial.grid(spatial.valid_positions(views.positions(spark, d)))


@query(CELLS + " SELECT * FROM cells")
def grid_heat_by_mcap(spark, d):
    """AGG-1, FN-12, FLT-8, SNK-3."""
    return cells(spark, d)


@query(CELLS + " SELECT bag, lat_idx, lon_idx, mcap_id, CAST(sum(cnt) AS bigint) AS cnt FROM cells GROUP BY GROUPING SETS ((bag, lat_idx, lon_idx, mcap_id), (bag, lat_idx, lon_idx), (bag, mcap_id), (lat_idx, lon_idx))")
def grid_totals_grouping_sets(spark, d):
    """AGG-2..4."""
    return spatial.grid_totals(cells(spark, d)).drop("level")


@query(CELLS + " SELECT bag, format('{:.6f},{:.6f}', lat_idx * 0.0001::double, lon_idx * 0.0001::double) AS key, CAST(sum(cnt) AS bigint) AS total FROM cells GROUP BY bag, lat_idx, lon_idx")
def grid_cell_keys(spark, d):
    """AGG-5, FN-13, PRJ-4."""
    nested = spatial.nested_grid(cells(spark, d))
    flat = spatial.exploded_grid(nested)
    return flat.select("bag", geo.cell_key(F.col("lat"), F.col("lon")).alias("key"), F.col("count").alias("total"))


@query(CELLS + " SELECT bag, mcap_id, CAST(sum(cnt) AS bigint) AS cnt FROM cells GROUP BY ALL")
def segment_position_totals(spark, d):
    """AGG-3, TOP-7."""
    return spatial.segment_totals(cells(spark, d))


@query(CELLS + " SELECT lat_idx, lon_idx, CAST(sum(cnt) AS bigint) AS cnt FROM cells GROUP BY ALL")
def heat_map_all_bags(spark, d):
    """AGG-4."""
    return spatial.heat_points(cells(spark, d), ()).orderBy(F.desc("cnt"), "lat_idx", "lon_idx")


@query(CELLS + ", p AS (SELECT bag, lat_idx, lon_idx, CAST(sum(cnt) AS bigint) AS cnt FROM cells GROUP BY ALL) SELECT bag, lat_idx, lon_idx, cnt, round(greatest(cnt / max(cnt) OVER (PARTITION BY bag), 0.05), 9) AS intensity FROM p")
def heat_intensity(spark, d):
    """AGG-21."""
    return rounded(spatial.intensity(spatial.heat_points(cells(spark, d))), 9, "intensity")


@query("+ x AS (SELECT 1) SELECT bag, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM v_positions GROUP BY bag")
def bbox_per_bag(spark, d):
    """AGG-15, SNK-4."""
    return spatial.boxes(views.positions(spark, d))


@query("+ x AS (SELECT 1) SELECT bag, mcap_id, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM v_positions GROUP BY ALL")
def centroid_per_mcap(spark, d):
    """AGG-19."""
    return rounded(spatial.centroids(views.positions(spark, d)), 8, "lat", "lon")


def _edge_values(polygons: dict[str, list]) -> str:
    rows = [(n, r[i], r[i - 1]) for n, r in polygons.items() for i in range(len(r))]
    return ", ".join(f"('{n}', {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for n, a, b in rows)


POLYGONS = {"concave": POLYGON, "square": SQUARE}
INSIDE = CELLS + f", e(poly_id, yi, xi, yj, xj) AS (VALUES {_edge_values(POLYGONS)}), pts AS (SELECT DISTINCT lat_idx, lon_idx, lat_idx * 0.0001::double AS lat, lon_idx * 0.0001::double AS lon FROM cells), hits AS (SELECT lat_idx, lon_idx, poly_id FROM pts, e WHERE (yi > lat) <> (yj > lat) AND lon < (xj - xi) * (lat - yi) / (yj - yi) + xi GROUP BY ALL HAVING count(*) % 2 = 1)"


@query(INSIDE + " SELECT poly_id, c.bag, c.mcap_id, c.lat_idx, c.lon_idx, c.cnt FROM cells c JOIN hits USING (lat_idx, lon_idx)")
def point_in_polygon_cells(spark, d):
    """FLT-12, JN-5."""
    found = spatial.points_in_polygons(spatial.with_degrees(cells(spark, d)), spatial.polygon_edges(spark, POLYGONS))
    return found.select("poly_id", "bag", "mcap_id", "lat_idx", "lon_idx", "cnt")


@query(INSIDE + " SELECT DISTINCT bag FROM cells JOIN hits USING (lat_idx, lon_idx)")
def bags_overlapping_polygon(spark, d):
    """AGG-24, JN-6, FLT-13."""
    return spatial.bags_in_polygons(cells(spark, d), spatial.polygon_edges(spark, POLYGONS), spatial.boxes(views.positions(spark, d)))


@query(INSIDE + " SELECT DISTINCT bag, mcap_id FROM cells JOIN hits USING (lat_idx, lon_idx) WHERE poly_id = 'square'")
def segments_inside_polygon(spark, d):
    """JN-5."""
    return spatial.segments_in_polygons(cells(spark, d), spatial.polygon_edges(spark, {"square": SQUARE}))


@query(INSIDE + ", i AS (SELECT DISTINCT bag, mcap_id, true AS h FROM cells JOIN hits USING (lat_idx, lon_idx) WHERE poly_id = 'square') SELECT c.bag, c.mcap_id, coalesce(h, false) AS highlighted FROM (SELECT DISTINCT bag, mcap_id FROM cells) c LEFT JOIN i USING (bag, mcap_id)")
def highlight_mask(spark, d):
    """JN-14."""
    c = cells(spark, d)
    return spatial.highlight(c.select("bag", "mcap_id").distinct(), spatial.segments_in_polygons(c, spatial.polygon_edges(spark, {"square": SQUARE})))


@query("+ o AS (SELECT min(lat) + 0.00003::double AS y, min_by(lon, (lat, lon)) + 0.00002::double AS x FROM v_positions), q AS (SELECT sqrt((lat - y) * (lat - y) + (lon - x) * (lon - x)) AS d FROM v_positions, o) SELECT round(min(d), 9) AS distance FROM q WHERE d < 0.0001::double HAVING count(*) > 0")
def nearest_point_hover(spark, d):
    """JN-10, beside the southernmost position."""
    p = views.positions(spark, d)
    at = p.agg(F.min(F.struct("lat", "lon")).alias("s")).first()["s"]
    return rounded(spatial.nearest_point(p, at["lat"] + 0.00003, at["lon"] + 0.00002).select("distance"), 9, "distance")


def ring_corners(hulls: DataFrame) -> DataFrame:
    """(bag, ring, corner, lat, lon)."""
    rings = hulls.select("bag", F.posexplode("rings").alias("ring", "r")).select("bag", "ring", F.posexplode("r").alias("corner", "p"))
    return rings.select("bag", "ring", "corner", F.round(F.col("p")[0], 6).alias("lat"), F.round(F.col("p")[1], 6).alias("lon"))


@query()
def convex_hull_per_bag(spark, d):
    """AGG-18."""
    return ring_corners(spatial.convex_hulls(cells(spark, d)))


@query()
def concave_hull_per_bag(spark, d):
    """AGG-16, AGG-17."""
    return ring_corners(spatial.boundaries(views.positions(spark, d)).withColumnRenamed("hull", "rings"))


@query()
def hulls_overlapping_polygon(spark, d):
    """FLT-14, FLT-15, FN-19."""
    grown = {f"{n}/{i}": r for n, ring in POLYGONS.items() for i, r in enumerate(spatial.offset_rings(ring, 50.0))}
    return spatial.hulls_overlapping(spatial.convex_hulls(cells(spark, d)), grown)


# ---- topics, segments, exports ----


#: Segments that hold such a message have gaps between them.
DEAR = "topic = '/purchase' AND value > 150"
RUNS = f"+ r AS (SELECT bag, CAST(mcap_id AS int) AS i FROM v_messages GROUP BY ALL HAVING count_if({DEAR}) > 0), g AS"


def dear_segments(spark: SparkSession, d: str) -> DataFrame:
    per = views.messages(spark, d).groupBy("bag", "mcap_id").agg(F.count_if(F.expr(DEAR)).alias("n"))
    return per.where("n > 0").select("bag", "mcap_id")


@query(RUNS + " (SELECT bag, i, i - row_number() OVER (PARTITION BY bag ORDER BY i) AS k FROM r) SELECT bag, min(i) AS lo, max(i) AS hi, count(*) AS n FROM g GROUP BY bag, k")
def mcap_islands(spark, d):
    """AGG-20."""
    return spatial.islands(dear_segments(spark, d).select("bag", F.col("mcap_id").try_cast("int").alias("i")), ["bag"], "i")


@query(RUNS + " (SELECT bag, i, i - row_number() OVER (PARTITION BY bag ORDER BY i) AS k FROM r), s AS (SELECT bag, min(i) AS lo, max(i) AS hi FROM g GROUP BY bag, k) SELECT bag, bag || ': ' || string_agg(CASE WHEN lo = hi THEN CAST(lo AS varchar) ELSE lo || ' - ' || hi END, ', ' ORDER BY lo) AS text FROM s GROUP BY bag")
def area_list_text(spark, d):
    """SNK-17."""
    return spatial.area_text(spatial.islands(dear_segments(spark, d).select("bag", F.col("mcap_id").try_cast("int").alias("i")), ["bag"], "i"))


@query("+ s AS (SELECT bag, mcap_id, row_number() OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - 1 AS pos, count(*) OVER (PARTITION BY bag) AS n FROM (SELECT DISTINCT bag, mcap_id FROM v_messages)), p AS (SELECT s.bag, q AS p, s.mcap_id, n * q / 8.0 - floor(n * q / 8.0) AS frac FROM s, range(1, 8) r(q) WHERE pos = floor(n * q / 8.0)), c AS (SELECT bag, mcap_id, topic, count(*) AS c FROM v_messages GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY bag, mcap_id, topic ORDER BY log_time_ns, sequence) - 1 AS nth FROM v_messages) SELECT p.bag, c.topic, CAST(p.p AS int) AS p, p.mcap_id, CAST(o.nth AS int) AS nth, o.log_time_ns FROM p JOIN c USING (bag, mcap_id) JOIN o ON o.bag = p.bag AND o.mcap_id = p.mcap_id AND o.topic = c.topic AND o.nth = floor(c.c * p.frac)")
def fencepost_samples(spark, d):
    """WIN-7, WIN-8."""
    return sequences.fenceposts(views.messages(spark, d))


@query("+ x AS (SELECT 1), n AS (SELECT bag, topic, row_number() OVER (PARTITION BY model, bag ORDER BY timestamp_ns, id) - 1 AS id FROM v_manifest) SELECT bag, topic, CAST(id AS bigint) AS id, format('shard-{:05d}', CAST(id // 40 AS int)) AS shard_id, CAST(id % 40 AS int) AS row_in_shard FROM n")
def shard_assignment(spark, d):
    """WIN-13, SNK-5."""
    m = views.manifest(spark, d).withColumnRenamed("id", "vec")
    return sequences.shards(m, ["model", "bag"], ["timestamp_ns", "vec"], 40).select("bag", "topic", "id", "shard_id", "row_in_shard")


@query("+ x AS (SELECT 1) SELECT topic, mcap_id, count(*) AS n FROM v_messages GROUP BY ROLLUP (topic, mcap_id)")
def messages_per_topic(spark, d):
    """AGG-14."""
    return topics.messages_per_topic(views.messages(spark, d)).drop("level")


@query("+ x AS (SELECT 1) SELECT bag, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, count(DISTINCT topic) AS n FROM v_messages GROUP BY bag")
def distinct_topics(spark, d):
    """AGG-25."""
    return topics.distinct_values(views.messages(spark, d), ["bag"], "topic").select("bag", F.array_join("values", ",").alias("topics"), "n")


@query("+ t AS (SELECT bag, topic FROM v_manifest UNION SELECT bag, topic FROM v_messages), p AS (SELECT *, CASE WHEN topic LIKE '%image%' OR topic LIKE '%camera%' OR topic LIKE '%rgb%' OR topic LIKE '%color%' THEN CASE WHEN topic LIKE '%zed%' THEN 0 ELSE 1 END WHEN topic LIKE '%pointcloud%' OR topic LIKE '%point_cloud%' OR topic LIKE '%lidar%' OR topic LIKE '%pcl%' THEN 2 WHEN regexp_matches(topic, 'gps|gnss|navsat|tf|odom|pose|position') THEN 3 ELSE 4 END AS priority FROM t) SELECT bag, topic, priority, CAST(row_number() OVER (PARTITION BY bag ORDER BY priority, topic) AS int) AS position FROM p")
def topic_priority_sort(spark, d):
    """TOP-5; no topic here names a side."""
    return topics.sorted_topics(views.manifest(spark, d).select("bag", "topic").unionByName(views.messages(spark, d).select("bag", "topic")).distinct())


@query("+ x AS (SELECT 1) SELECT bag, mcap_id, row_number() OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) AS position FROM (SELECT DISTINCT bag, mcap_id FROM v_messages)")
def numeric_id_sort(spark, d):
    """TOP-7."""
    return topics.numeric_first(views.messages(spark, d).select("bag", "mcap_id").distinct(), ["bag"]).withColumn("position", F.col("position").cast("long"))


@query("+ e AS (SELECT DISTINCT bag, topic FROM v_messages), p AS (SELECT bag, mcap_id, topic FROM v_messages GROUP BY ALL HAVING max(value) > 60) SELECT s.bag, s.mcap_id, e.topic FROM (SELECT DISTINCT bag, mcap_id FROM p) s JOIN e ON e.bag = s.bag WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.bag = s.bag AND p.mcap_id = s.mcap_id AND p.topic = e.topic)")
def missing_topics_anti(spark, d):
    """FLT-19, SET-7: topics of a bag that have no value over 60 in a segment that has some such topic."""
    m = views.messages(spark, d)
    lively = m.groupBy("bag", "mcap_id", "topic").agg(F.max("value").alias("most")).where("most > 60")
    return topics.missing_topics(lively, m)


@query("+ x AS (SELECT 1) SELECT DISTINCT bag FROM v_messages WHERE topic IN ('/click', '/purchase')")
def topic_semi_filter(spark, d):
    """FLT-16, FLT-17."""
    m = views.messages(spark, d)
    return topics.bags_named(m.select("bag").distinct(), topics.bags_with_topics(m, ["/click", "/purchase"]))


@query("+ t AS (SELECT DISTINCT bag, topic, CASE WHEN topic LIKE '%c%' THEN 'sensor_msgs/msg/CompressedImage' WHEN topic LIKE '%v%' THEN 'novatel_oem7_msgs/msg/BESTPOS' ELSE 'sensor_msgs/msg/Imu' END || bag AS ty FROM v_messages) SELECT topic, arg_max(ty, bag) AS msg_type FROM t GROUP BY topic")
def topic_dictionary(spark, d):
    """JN-11."""
    tp = views.topics(views.messages(spark, d)).withColumn("msg_type", F.concat("msg_type", "bag"))
    return topics.topic_dictionary(tp)


@query("+ b AS (SELECT DISTINCT bag FROM v_messages UNION SELECT 'bag_9'), s AS (SELECT bag, count(*) AS c, min(log_time_ns) AS a FROM v_messages GROUP BY bag) SELECT b.bag, coalesce(c, 0) AS total_count, a AS first_ts FROM b LEFT JOIN s USING (bag)")
def bags_with_summaries(spark, d):
    """JN-12; bag_9 has no messages."""
    m = views.messages(spark, d)
    bags = m.select("bag").distinct().unionByName(spark.createDataFrame([("bag_9",)], "bag string"))
    totals = align.bag_totals(align.summaries(timeline(spark, d)[1]))
    return topics.with_summaries(bags, totals).select("bag", "total_count", "first_ts")


A, B = 1_704_500_000_000_000_000, 1_705_500_000_000_000_000


@query(f"+ x AS (SELECT 1) SELECT bag, topic, sequence FROM v_messages WHERE topic IN ('/click', '/view') AND log_time_ns >= {A} AND log_time_ns < {B}")
def export_range_scan(spark, d):
    """SRC-6."""
    return exports.range_scan(views.messages(spark, d), ["/click", "/view"], A, B).select("bag", "topic", "sequence")


@query(f"+ d AS (SELECT bag, mcap_id FROM v_messages GROUP BY ALL HAVING count_if({DEAR}) > 0), s AS (SELECT bag, mcap_id, count(*) AS c FROM v_messages GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - 1 AS pos, sum(c) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - c AS a FROM s), h AS (SELECT *, pos - row_number() OVER (PARTITION BY bag ORDER BY pos) AS k FROM o JOIN d USING (bag, mcap_id)) SELECT bag, min(pos) AS lo, max(pos) AS hi, CAST(min(a) AS bigint) AS start_index, CAST(max(a + c) - 1 AS bigint) AS end_index FROM h GROUP BY bag, k")
def export_windows(spark, d):
    """AGG-20 by position."""
    rows = timeline(spark, d)[1]
    s = align.summaries(rows)
    out = exports.windows_of_segments(dear_segments(spark, d), s)
    return out.select("bag", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "start_index", "end_index")


@query("""+ i AS (SELECT bag, mcap_id, log_time_ns, row_number() OVER (PARTITION BY bag ORDER BY log_time_ns, CAST(mcap_id AS int)) - 1 AS idx FROM v_messages),
s AS (SELECT bag, mcap_id, n, sum(n) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - n AS a FROM (SELECT bag, mcap_id, count(*) AS n FROM v_messages GROUP BY ALL)),
g AS (SELECT i.bag, i.idx, i.log_time_ns AS ts, CAST(s.mcap_id AS int) AS m FROM i JOIN s ON s.bag = i.bag AND i.idx >= a AND i.idx < a + n),
p AS (SELECT x.bag, x.name, lo.ts AS ts_a, hi.ts AS ts_b, lo.m AS m_a, hi.m AS m_b FROM (VALUES ('bag_0', 'first', 10, 400), ('bag_1', 'second', 5, 900)) x(bag, name, i_a, i_b) JOIN g lo ON lo.bag = x.bag AND lo.idx = i_a JOIN g hi ON hi.bag = x.bag AND hi.idx = i_b),
h AS (SELECT name, CAST(v.mcap_id AS int) AS m FROM v_messages v JOIN p ON p.bag = v.bag AND CAST(v.mcap_id AS int) BETWEEN m_a AND m_b WHERE (CAST(v.mcap_id AS int) <> m_a OR log_time_ns >= ts_a) AND (CAST(v.mcap_id AS int) <> m_b OR log_time_ns < ts_b))
SELECT name, CAST(dense_rank() OVER (PARTITION BY name ORDER BY m) - 1 AS int) AS part_mcap, n FROM (SELECT name, m, count(*) AS n FROM h GROUP BY ALL)""")
def export_plan_messages(spark, d):
    """FLT-22, WIN-14."""
    m, rows = timeline(spark, d)
    parts = spark.createDataFrame([("bag_0", "first", 10, 400), ("bag_1", "second", 5, 900), ("bag_1", "bad", -1, 5)], "bag string, name string, start_index long, end_index long")
    return exports.export_messages(m, exports.planned(parts, rows, align.summaries(rows))).groupBy("name", "part_mcap").agg(F.count("*").alias("n"))


@query("+ x AS (SELECT DISTINCT topic FROM v_messages) SELECT topic, replace(topic, '/', '__') AS folder, ltrim(replace(topic, '/', '_'), '_') AS file FROM x")
def topic_names(spark, d):
    """FN-6."""
    c = F.col("topic")
    return views.messages(spark, d).select("topic").distinct().select("topic", names.topic_folder(c).alias("folder"), names.topic_file(c).alias("file"))


@query("+ x AS (SELECT 1) SELECT sequence, log_time_ns // 1000000 AS ms, CAST((log_time_ns // 60000000000) % 1440 AS int) AS minute, CASE WHEN o >= 3600 THEN printf('%d:%02d:%02d', o // 3600, o % 3600 // 60, o % 60) ELSE printf('%d:%02d', o // 60, o % 60) END AS duration FROM (SELECT *, (log_time_ns - min(log_time_ns) OVER (PARTITION BY bag, mcap_id)) // 1000000000 AS o FROM v_messages)")
def time_functions(spark, d):
    """FN-1, FN-3, FN-4: a duration is the time since its segment began."""
    from pyspark.sql import Window as W

    ns = F.col("log_time_ns")
    since = ns - F.min(ns).over(W.partitionBy("bag", "mcap_id"))
    return views.messages(spark, d).select("sequence", t.millis(ns).alias("ms"), t.minute_of_day(ns).alias("minute"), t.duration(t.millis(since)).alias("duration"))


@query("+ x AS (SELECT 1) SELECT id, round(list_dot_product(embedding, embedding), 6) AS dot, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, round(1 - 0.8::double * least(id, 99) / 99.0, 6) AS weight FROM v_manifest")
def vector_functions(spark, d):
    """FN-14, FN-15."""
    e = F.col("embedding")
    return rounded(views.manifest(spark, d).select("id", v.dot(e, e).alias("dot"), v.norm(e).alias("norm"), v.rank_weight(F.col("id") + 1).alias("weight")), 6, "dot", "norm", "weight")


@query("""+ s AS (SELECT bag, min(log_time_ns) // 1000000 AS a, max(log_time_ns) // 1000000 AS b FROM v_messages GROUP BY bag HAVING max(log_time_ns) // 1000000 > min(log_time_ns) // 1000000),
z AS (SELECT *, CASE WHEN (b - a) / 1000.0 / 10 < 55 THEN 10 WHEN (b - a) / 1000.0 / 20 < 55 THEN 20 WHEN (b - a) / 1000.0 / 30 < 55 THEN 30 ELSE 60 END AS step FROM s),
k AS (SELECT bag, a, b, step, unnest(range((a + step * 1000 - 1) // (step * 1000) * step, b // 1000 + 1, step)) AS sec FROM z),
l AS (SELECT bag, coalesce(min(nice) FILTER (WHERE held <= 54), 3600) AS label FROM (SELECT bag, nice, count_if(sec % nice = 0) AS held FROM k, (SELECT unnest([10, 20, 30, 60, 120, 180, 300, 600, 900, 1800, 3600]) AS nice) WHERE nice >= step GROUP BY ALL) GROUP BY bag)
SELECT bag, CAST(sec AS bigint) AS tick_s, round((sec * 1000 - a) / (b - a)::double, 9) AS share, sec % label = 0 AS labelled FROM k JOIN l USING (bag)""")
def time_ticks(spark, d):
    """WIN-15."""
    return rounded(sequences.time_ticks(align.summaries(timeline(spark, d)[1])), 9, "share")


@query("+ x AS (SELECT 1) SELECT DISTINCT bag FROM v_manifest WHERE bag IN (SELECT bag FROM v_messages)")
def bag_index(spark, d):
    """SNK-15."""
    return exports.bag_index(views.messages(spark, d), views.manifest(spark, d)).select("bag")


def sharded(spark: SparkSession, d: str) -> DataFrame:
    return sequences.shards(views.manifest(spark, d).withColumnRenamed("id", "vec"), ["model", "bag"], ["timestamp_ns", "vec"], 40)


SHARDED = "+ n AS (SELECT *, row_number() OVER (PARTITION BY model, bag ORDER BY timestamp_ns, id) - 1 AS nth FROM v_manifest)"


@query(SHARDED + " SELECT bag, CAST(nth AS bigint) AS id, topic, round(list_dot_product(embedding, embedding), 6) AS dot FROM n")
def manifest_with_vectors(spark, d):
    """JN-2, PRJ-2: a manifest without vectors meets the shards that hold them."""
    s = sharded(spark, d)
    joined = manifests.with_vectors(manifests.ordered_columns(s.drop("embedding")), s)
    return rounded(joined.select("bag", "id", "topic", v.dot(F.col("embedding"), F.col("embedding")).alias("dot")), 6, "dot")


@query("+ x AS (SELECT 1) SELECT model, bag, CAST(max(len(embedding)) AS int) AS D, 'float32' AS dtype, count(*) AS total_count FROM v_manifest GROUP BY ALL")
def embedding_metadata(spark, d):
    """SNK-6."""
    return manifests.metadata(views.manifest(spark, d))


@query(SHARDED + ", h AS (SELECT model, bag, max(nth) + 1 AS held FROM n WHERE timestamp_ns < 1704100000000000000 GROUP BY ALL), a AS (SELECT n.model, n.bag, n.id AS vec, row_number() OVER (PARTITION BY n.model, n.bag ORDER BY timestamp_ns, id) - 1 + coalesce(held, 0) AS id FROM n LEFT JOIN h USING (model, bag) WHERE timestamp_ns >= 1704100000000000000) SELECT bag, vec, CAST(id AS bigint) AS id, format('shard-{:05d}', CAST(id // 40 AS int)) AS shard_id, CAST(id % 40 AS int) AS row_in_shard FROM a")
def shard_append(spark, d):
    """SNK-5, WIN-13: later frames go on behind what each bag holds already."""
    m, at = views.manifest(spark, d).withColumnRenamed("id", "vec"), 1_704_100_000_000_000_000
    by, order = ["model", "bag"], ["timestamp_ns", "vec"]
    held = sequences.shards(m.where(F.col("timestamp_ns") < at), by, order, 40)
    return sequences.shards(m.where(F.col("timestamp_ns") >= at), by, order, 40, held).select("bag", "vec", "id", "shard_id", "row_in_shard")


@query("+ s AS (SELECT bag, mcap_id, count(*) AS n, min(log_time_ns) AS a, max(log_time_ns) AS b FROM v_messages GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - n AS start FROM s) SELECT bag, CAST(sum(n) AS bigint) AS count, CAST(min(a) AS varchar) AS firstTimestampNs, CAST(max(b) AS varchar) AS lastTimestampNs, string_agg(CAST(start AS bigint) || ':' || mcap_id || ':' || n || ':' || a || ':' || b, ',' ORDER BY start) AS ranges, false AS needsBackfill FROM o GROUP BY bag")
def client_summaries(spark, d):
    """PRJ-3."""
    out = manifests.client_summary(align.bag_totals(align.summaries(timeline(spark, d)[1])))
    one = lambda r: F.concat_ws(":", *(r[c].cast("string") for c in ("startIndex", "mcapIdentifier", "count", "firstTimestampNs", "lastTimestampNs")))
    return out.select("bag", "count", "firstTimestampNs", "lastTimestampNs", F.array_join(F.transform("mcapRanges", one), ",").alias("ranges"), F.col("_needsBackfill").alias("needsBackfill"))


@query(f"+ d AS (SELECT bag, mcap_id FROM v_messages GROUP BY ALL HAVING count_if({DEAR}) > 0) SELECT '/data/' || bag AS path, mcap_id FROM d WHERE bag <> 'bag_3'")
def pending_to_bags(spark, d):
    """JN-15: segments chosen by a bag's name meet the selected paths; bag_3 is not selected."""
    selected = spark.createDataFrame([("/data/bag_0",), ("/data/bag_1",), ("/data/bag_2",)], "path string")
    return manifests.pending_segments(dear_segments(spark, d).withColumnRenamed("bag", "key"), selected)


@query("+ x AS (SELECT bag, topic, sequence, row_number() OVER (PARTITION BY bag, topic ORDER BY sequence) AS n FROM v_messages) SELECT bag, string_agg(topic, ',' ORDER BY sequence) AS topics FROM x WHERE n = 1 GROUP BY bag")
def ordered_distinct_topics(spark, d):
    """SET-6: a bag's topics in the order of their first messages."""
    m = views.messages(spark, d).groupBy("bag", "topic").agg(F.min("sequence").alias("at")).groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("at", "topic"))).alias("m"))
    return m.select("bag", F.array_join(manifests.ordered_distinct(F.transform("m", lambda x: x["topic"])), ",").alias("topics"))


@query("+ s AS (SELECT DISTINCT bag, mcap_id FROM v_messages), d AS (SELECT bag, mcap_id, topic FROM v_messages GROUP BY ALL HAVING max(value) > 60) SELECT DISTINCT v.bag, v.mcap_id, v.topic FROM v_messages v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.bag = v.bag AND d.mcap_id = v.mcap_id AND d.topic = v.topic)")
def incremental_ledger(spark, d):
    """FLT-20 at the level of topics: what a ledger leaves to do; the latest row of a key counts."""
    m = views.messages(spark, d)
    done = m.groupBy("bag", "mcap_id", "topic").agg(F.max("value").alias("most")).where("most > 60")
    rows = ingest.ledger_rows(done, "embed").unionByName(ingest.ledger_rows(m.select("bag", "mcap_id", "topic").distinct(), "embed", "started", at=0))
    return ingest.unprocessed(m.select("bag", "mcap_id", "topic").distinct(), rows, "embed")


from . import small_queries  # noqa: E402, F401  registers more


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

