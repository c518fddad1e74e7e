"""Queries of the smaller functions and of what is written and read back, each over whole tables; queries.py registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables
from .functions import geo, names, payloads
from .functions import time as t
from .functions import vectors as v
from .operators import align, exports, manifests, previews, search, sequences, spatial, topics
from .queries import NEAR, POLYGON, POLYGONS, REF, SHARDED, TICKS, cells, dear_segments, query, rounded, sharded, timeline, INSIDE, RUNS
from .sources import bags, snapshots, views
from .streaming import ingest


def folder(spark: SparkSession, name: str) -> str:
    """A new folder among the tables of queries."""
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- topics and names ----


@query("""+ u AS (SELECT DISTINCT topic FROM v_manifest UNION SELECT DISTINCT topic FROM v_messages UNION SELECT DISTINCT '/BestPos' || topic FROM v_messages),
k AS (SELECT topic, CASE WHEN topic LIKE '%c%' THEN 'sensor_msgs/msg/CompressedImage' ELSE 'novatel_oem7_msgs/msg/BESTPOS' END AS msg_type FROM u)
SELECT topic, topic LIKE '%image%' OR topic LIKE '%camera%' AS by_name, msg_type = 'sensor_msgs/msg/CompressedImage' AS by_type, topic LIKE '/BestPos%' AS is_position FROM k""")
def topic_classes(spark, d):
    """FLT-5, FLT-6, FLT-7."""
    m = views.messages(spark, d).select("topic")
    every = views.manifest(spark, d).select("topic").unionByName(m).unionByName(m.select(F.concat(F.lit("/BestPos"), "topic").alias("topic"))).distinct()
    kind = F.when(F.col("topic").contains("c"), "sensor_msgs/msg/CompressedImage").otherwise("novatel_oem7_msgs/msg/BESTPOS")
    c = F.col("topic")
    return every.select(c, topics.is_image_name(c).alias("by_name"), topics.is_image_type(kind).alias("by_type"), topics.is_position(c).alias("is_position"))


@query("+ x AS (SELECT DISTINCT bag, topic FROM v_messages) SELECT bag, topic, bag || ' é/' || topic AS raw, false AS valid, true AS own_valid, topic AS back, bag || '____' || replace(topic, '/', '') AS safe, CAST(regexp_extract(bag, '(\\d+)$', 1) AS int) AS number FROM x")
def name_functions(spark, d):
    """FN-6 and its inverse, FN-10, FN-21."""
    raw = F.concat_ws(" é/", "bag", "topic")
    return views.messages(spark, d).select("bag", "topic").distinct().select(
        "bag", "topic", raw.alias("raw"), names.is_valid_name(raw).alias("valid"), names.is_valid_name(F.col("bag")).alias("own_valid"), names.folder_topic(names.topic_folder(F.col("topic"))).alias("back"),
        names.sanitised(raw).alias("safe"), names.id_number(F.regexp_extract("bag", r"(\d+)$", 1)).alias("number"),
    )


BAG_PATHS = """WITH p AS (SELECT DISTINCT ts, user_id % 4 AS k, event_id % 7 AS part FROM events), n AS (SELECT *, 'rosbag2_' || strftime(ts, '%Y_%m_%d-%H_%M_%S') || CASE k WHEN 1 THEN '_short_multi_parts/Part_' || part WHEN 2 THEN '_long' WHEN 3 THEN '_short' ELSE '' END AS key FROM p),
b AS (SELECT DISTINCT '/data/x/' || key AS path, key, split_part(key, '_multi_parts', 1) AS base, CASE WHEN k <> 2 THEN CAST(date_trunc('second', ts) AS timestamp) END AS taken, CASE WHEN k = 1 THEN CAST(part AS int) END AS part FROM n)"""


def bag_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of bags whose names tell the times of events."""
    e = views.table(spark, d, "events")
    name, k = F.concat(F.lit("/data/x/rosbag2_"), F.date_format("ts", "yyyy_MM_dd-HH_mm_ss")), F.col("user_id") % 4
    end = F.when(k == 1, F.concat(F.lit("_short_multi_parts/Part_"), (F.col("event_id") % 7).cast("string"))).when(k == 2, "_long").when(k == 3, "_short").otherwise("")
    return e.select(F.concat(name, end).alias("path")).distinct()


@query(BAG_PATHS + " SELECT path, key, taken, base, part FROM b")
def bag_name_parse(spark, d):
    """FN-5, FN-9."""
    key = names.bag_key(F.col("path"))
    return bag_paths(spark, d).select("path", key.alias("key"), names.bag_time(key).alias("taken"), names.base_bag(key).alias("base"), names.part_number(key).alias("part"))


@query(BAG_PATHS + " SELECT key AS bag, row_number() OVER (ORDER BY taken NULLS LAST, encode(key)) - 1 AS place FROM (SELECT DISTINCT key, taken FROM b)")
def bags_by_time(spark, d):
    """TOP-6: a range sort over all tasks; places are numbered from what it gave."""
    ordered = topics.sorted_bags(bag_paths(spark, d).select(names.bag_key(F.col("path")).alias("bag")).distinct())
    held = tables.written(ordered.withColumn("row", F.monotonically_increasing_id()), "sorted-bags").withColumn("part", F.shiftright("row", 33))
    per = held.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    return held.join(per.select("part", "first", before.alias("before")), "part").select("bag", (F.col("before") + F.col("row") - F.col("first")).alias("place"))


# ---- ranges and exports ----


@query("+ x AS (SELECT bag, mcap_identifier, unnest(range(id, id + id % 4)) AS id FROM v_manifest WHERE id % 3 = 0) SELECT DISTINCT bag, mcap_identifier, CAST(id AS int) AS id FROM x")
def range_union_ids(spark, d):
    """SET-4, FN-29: overlapping, touching and reversed ranges of each segment."""
    m = views.manifest(spark, d).where("id % 3 = 0").withColumn("id", F.col("id").cast("int"))
    r = F.collect_list(F.struct(F.col("id").alias("lo"), (F.col("id") + F.col("id") % 4 - 1).alias("hi")))  # at most the rows of a segment
    return m.groupBy("bag", "mcap_identifier").agg(r.alias("r")).select("bag", "mcap_identifier", F.explode(sequences.range_ids(F.col("r"))).alias("id"))


EXPORTS = RUNS.replace(" AS i FROM v_messages", " AS i, mcap_id FROM v_messages").removesuffix(", g AS") + """, s AS (SELECT bag, mcap_id, row_number() OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - 1 AS pos FROM (SELECT DISTINCT bag, mcap_id FROM v_messages)),
h AS (SELECT s.bag, pos, pos - row_number() OVER (PARTITION BY s.bag ORDER BY pos) AS k FROM s JOIN r ON r.bag = s.bag AND r.mcap_id = s.mcap_id), z AS (SELECT bag, min(pos) AS lo, max(pos) AS hi FROM h GROUP BY bag, k),
y AS (SELECT bag, lo, hi, min(lo) OVER w AS a, max(hi) OVER w AS b, count(*) OVER w AS n, row_number() OVER (PARTITION BY bag ORDER BY lo) AS i FROM z WINDOW w AS (PARTITION BY bag))"""


@query(EXPORTS + " SELECT bag, CAST(lo AS bigint) AS lo, bag || '__' || CASE WHEN a = b THEN '_id_' || a ELSE '_ids_' || a || '_to_' || b END || CASE WHEN n > 1 THEN '_part' || i ELSE '' END AS name, CASE WHEN n > 1 THEN i END AS part FROM y")
def export_names(spark, d):
    """AGG-26, WIN-14, FN-10."""
    rows = timeline(spark, d)[1]
    w = exports.windows_of_segments(dear_segments(spark, d), align.summaries(rows))
    named = exports.export_names(w.withColumn("bag", F.concat("bag", F.lit("ü "))))
    named = sequences.part_numbers(named.withColumn("bag", F.expr("left(bag, length(bag) - 2)")))
    return named.select("bag", F.col("lo").cast("long").alias("lo"), "name", F.col("part").cast("long").alias("part"))


NAMED = "+ n AS (SELECT bag, mcap_id, CASE WHEN CAST(mcap_id AS int) % 5 = 0 THEN '  ' ELSE repeat(' ', CAST(right(bag, 1) AS int)) || CASE WHEN bag = 'bag_3' THEN bag ELSE '' END || mcap_id END AS name FROM (SELECT DISTINCT bag, mcap_id FROM v_messages))"


@query(NAMED + ", c AS (SELECT trim(name) AS k FROM n GROUP BY ALL HAVING count(*) > 1) SELECT bag, mcap_id, name FROM n WHERE trim(name) <> '' AND trim(name) IN (SELECT k FROM c)")
def duplicate_export_names(spark, d):
    """FLT-18: of all bags' segments as exports."""
    own = F.concat(F.repeat(F.lit(" "), F.expr("int(right(bag, 1))")), F.when(F.col("bag") == "bag_3", F.col("bag")).otherwise(""), F.col("mcap_id"))
    items = views.messages(spark, d).select("bag", "mcap_id").distinct().withColumn("name", F.when(F.col("mcap_id").cast("int") % 5 == 0, "  ").otherwise(own))
    return exports.duplicate_names(items)


@query("+ i AS (SELECT id AS place, topic AS name, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE bag END AS src FROM v_manifest), f AS (SELECT min_by(src, place) AS src FROM i WHERE src <> '') SELECT place, name, CASE WHEN coalesce(i.src, '') = '' THEN f.src ELSE i.src END AS source_rosbag, 'export_1' AS output_parent FROM i, f")
def export_batch_items(spark, d):
    """SNK-18."""
    source = F.when(F.col("id") % 3 == 1, "").when(F.col("id") % 3 == 2, F.col("bag"))
    items = views.manifest(spark, d).select(F.col("id").alias("place"), F.col("topic").alias("name"), source.alias("source_rosbag"))
    return manifests.export_batch(items, F.lit("export_1"))


@query("+ x AS (SELECT DISTINCT bag, mcap_id, topic, log_time_ns FROM v_messages) SELECT bag, topic, log_time_ns, bag || '/' || mcap_id || '/' || replace(topic, '/', '') || '/' || log_time_ns || CASE WHEN topic LIKE '%c%' THEN '.png' WHEN topic LIKE '%v%' THEN '.json' ELSE '.pcd' END AS path FROM x")
def raw_file_paths(spark, d):
    """SNK-13: where a message's own file goes."""
    m = views.messages(spark, d)
    kind = F.when(F.col("topic").contains("c"), "sensor_msgs/msg/CompressedImage").when(F.col("topic").contains("v"), "novatel_oem7_msgs/msg/BESTPOS").otherwise("sensor_msgs/msg/PointCloud2")
    path = exports.raw_file_path(F.col("bag"), F.col("mcap_id"), F.col("topic"), F.col("log_time_ns"), kind, F.lit("PNG"))
    return m.select("bag", "topic", "log_time_ns", path.alias("path")).distinct()


@query("+ f AS (SELECT bag, min(log_time_ns) AS at FROM v_messages GROUP BY bag HAVING bag = 'bag_1'), o AS (SELECT m.* FROM v_messages m JOIN f ON m.bag = f.bag AND m.log_time_ns = f.at ORDER BY sequence LIMIT 1) SELECT m.bag, m.topic, m.sequence FROM v_messages m JOIN o USING (bag, topic, log_time_ns) ORDER BY m.sequence LIMIT 1")
def point_message_lookup(spark, d):
    """SRC-5, TOP-4, FLT-4: one message of a bag, topic and time, the reference's single-message request."""
    m = views.messages(spark, d)
    one = m.where("bag = 'bag_1'").agg(F.min_by(F.struct("topic", "log_time_ns"), F.struct("log_time_ns", "sequence")).alias("m")).first()["m"]
    return exports.message_at(m, "bag_1", one["topic"], one["log_time_ns"]).select("bag", "topic", "sequence")


# ---- geometry, numbers, text ----

EDGES = [(*POLYGON[i], *POLYGON[i - 1]) for i in range(len(POLYGON))]
EDGE_VALUES = ", ".join(f"({i}, {a}::double, {b}::double, {c}::double, {e}::double)" for i, (a, b, c, e) in enumerate(EDGES))
STEPS = f"+ e(i, ay, ax, by_, bx) AS (VALUES {EDGE_VALUES}), p AS (SELECT DISTINCT lat, lon FROM v_positions)"


def with_edges(p: DataFrame) -> DataFrame:
    """Every position with the six edges of the polygon."""
    edge = lambda i, e: F.struct(F.lit(i).alias("i"), *(F.lit(float(x)).alias(n) for n, x in zip(("ay", "ax", "by_", "bx"), e, strict=True)))
    return p.select("lat", "lon").distinct().select("lat", "lon", F.inline(F.array(*(edge(i, e) for i, e in enumerate(EDGES)))))


@query(STEPS + ", d AS (SELECT lat, lon, i, 0.02::double * (bx - ax) - 0.01::double * (by_ - ay) AS d, (ay - lat) * (bx - ax) - (ax - lon) * (by_ - ay) AS tn, (ay - lat) * 0.01::double - (ax - lon) * 0.02::double AS un FROM p, e) SELECT lat, lon, count_if(abs(d) >= 1e-12 AND tn / d BETWEEN 0 AND 1 AND un / d BETWEEN 0 AND 1) AS crossed FROM d GROUP BY ALL")
def edges_crossed_by_steps(spark, d):
    """FN-18, FLT-14: how many edges of the polygon a step from each position crosses."""
    c = F.col
    p = with_edges(views.positions(spark, d)).withColumns({"y": c("lat") + (c("lat") * 0 + 0.02), "x": c("lon") + (c("lon") * 0 + 0.01)})
    hit = geo.segments_cross((F.lit(0.0), F.lit(0.0)), (F.lit(0.02), F.lit(0.01)), (c("ay") - c("lat"), c("ax") - c("lon")), (c("by_") - c("lat"), c("bx") - c("lon")))
    return p.groupBy("lat", "lon").agg(F.count_if(hit).alias("crossed"))


@query(STEPS + ", n AS (SELECT lat, lon, ay, ax, by_ - ay AS dy, bx - ax AS dx, greatest(0.0::double, least(1.0::double, ((lat - ay) * (by_ - ay) + (lon - ax) * (bx - ax)) / ((by_ - ay) * (by_ - ay) + (bx - ax) * (bx - ax)))) AS t FROM p, e), m AS (SELECT lat, lon, (ay + t * dy - lat) * 111000::double AS north, (ax + t * dx - lon) * 111000::double * cos(radians(51::double)) AS east FROM n) SELECT lat, lon, round(min(sqrt(north * north + east * east)), 3) AS metres FROM m GROUP BY ALL")
def metres_to_polygon(spark, d):
    """FN-17, FN-20: from each position to the nearest place on the polygon's edges."""
    c = F.col
    y, x = geo.nearest_on_segment(c("lat"), c("lon"), c("ay"), c("ax"), c("by_"), c("bx"))
    north, east = geo.to_metres(y - c("lat"), x - c("lon"), F.lit(51.0))
    near = with_edges(views.positions(spark, d)).groupBy("lat", "lon").agg(F.min(F.sqrt(north * north + east * east)).alias("metres"))
    return rounded(near, 3, "metres")


@query("+ p AS (SELECT DISTINCT lat, lon FROM v_positions) SELECT lat, lon, 4 AS given, 3 AS kept, round(lat + lat + 0.5 + lat + 0.25, 9) AS sum_lat FROM p")
def cleaned_rings(spark, d):
    """FN-20: rings without closing and repeated points."""
    c = F.col
    at = lambda up: F.array(c("lat") + up, c("lon") - up)
    ring = geo.clean_ring(F.array(at(F.lit(0.0)), at(F.lit(0.5)), at(F.lit(0.5)), at(F.lit(0.25)), at(F.lit(0.0))))
    p = views.positions(spark, d).select("lat", "lon").distinct().withColumn("r", ring)
    return p.select("lat", "lon", F.lit(4).alias("given"), F.size("r").alias("kept"), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x[0]), 9).alias("sum_lat"))


@query(INSIDE + " SELECT poly_id, c.bag, c.mcap_id, c.lat_idx, c.lon_idx, c.cnt FROM cells c JOIN hits USING (lat_idx, lon_idx)")
def cells_in_geojson(spark, d):
    """FN-27, SRC-13: the polygons come as a GeoJSON document."""
    ring = lambda r: ", ".join(f"[{x}, {y}]" for y, x in [*r, r[0]])
    one = ", ".join(f'{{"type": "Feature", "properties": {{"name": "{n}"}}, "geometry": {{"type": "Polygon", "coordinates": [[{ring(r)}]]}}}}' for n, r in POLYGONS.items())
    rings = spatial.geojson_rings(f'{{"type": "FeatureCollection", "features": [{one}]}}')
    found = spatial.points_in_polygons(spatial.with_degrees(cells(spark, d)), spatial.polygon_edges(spark, rings))
    return found.select("poly_id", "bag", "mcap_id", "lat_idx", "lon_idx", "cnt")


@query("+ x AS (SELECT 1) SELECT id, CAST(floor(-id / 2.0 + 0.5) AS bigint) AS js, greatest(10.0::double, least(90.0::double, id / 3.0::double)) AS clamped, round(id + (2.0::double * id - id) * 0.25, 6) AS between_, id % 60 >= 0 AND id % 60 < 50 AS inside FROM v_manifest")
def number_functions(spark, d):
    """FN-16, and bounds of indexes."""
    i = F.col("id")
    return views.manifest(spark, d).select("id", geo.js_round(-i / 2).cast("long").alias("js"), geo.clamp(i / 3, 10.0, 90.0).alias("clamped"), F.round(geo.lerp(i.cast("double"), i * 2.0, F.lit(0.25)), 6).alias("between_"), align.in_bounds(i % 60, F.lit(50)).alias("inside"))


@query("+ x AS (SELECT 1) SELECT id, round(sqrt(list_dot_product(embedding, embedding)) / sqrt(list_dot_product(embedding, embedding)), 4) AS length FROM v_manifest")
def normalised_vectors(spark, d):
    """FN-14."""
    return rounded(views.manifest(spark, d).select("id", v.norm(v.normalised(F.col("embedding"))).alias("length")), 4, "length")


@query("+ x AS (SELECT 1) SELECT sequence, CASE WHEN topic LIKE '%c%' THEN '{\"sequence\":' || sequence || ',\"bag\":\"' || bag || '\"}' ELSE '{' || sequence || ', ' || bag || '}' END AS text, bag AS first, base64(encode(topic)) AS image FROM v_messages")
def payload_texts(spark, d):
    """FN-22: the text form by type, the first of a list of transforms, bytes in base 64."""
    kind = F.when(F.col("topic").contains("c"), "sensor_msgs/msg/Imu").otherwise("std_msgs/msg/String")
    m = views.messages(spark, d)
    return m.select("sequence", payloads.message_text(kind, F.struct("sequence", "bag")).alias("text"), payloads.first_transform(F.array("bag", "topic")).alias("first"), payloads.image_base64(F.encode("topic", "UTF-8")).alias("image"))


@query("+ x AS (SELECT 1) SELECT sequence, strftime(make_timestamp(log_time_ns // 1000) + interval 182 days + interval 2 hours, '%H:%M') AS local FROM v_messages")
def local_time_in_summer(spark, d):
    """FN-2 in July."""
    return views.messages(spark, d).select("sequence", t.local_hhmm(F.col("log_time_ns") + 182 * 86_400_000_000_000).alias("local"))


# ---- alignment ----


@query(NEAR.replace("500000000000", "100000000") + " SELECT bag, mcap_id, ref_idx, ref_ts, topic, topic_ts FROM al")
def nearest_alignment_100ms(spark, d):
    """JN-1, FLT-11 at the usual tolerance."""
    m = views.messages(spark, d)
    return align.nearest_messages(align.uniform_timeline(m), m)


EVENTS = ["click", "error", "purchase", "signup", "view"]


@query(NEAR + " SELECT bag, mcap_id, ref_idx, ref_ts, " + ", ".join(f"max(CASE WHEN topic = '/{e}' THEN topic_ts END) AS \"{e}\"" for e in EVENTS) + " FROM al GROUP BY ALL")
def alignment_wide(spark, d):
    """SNK-1 in wide form: a column for each topic."""
    m = views.messages(spark, d)
    out = align.wide(align.nearest_messages(align.uniform_timeline(m), m, 500_000_000_000), [f"/{e}" for e in EVENTS])
    return out.withColumnsRenamed({f"/{e}": e for e in EVENTS})


@query("+ x AS (SELECT bag, topic, CASE sequence % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE CAST(log_time_ns AS varchar) END AS v FROM v_messages) SELECT bag, topic, count_if(v NOT IN ('nan', 'None', '')) AS held, max(CASE WHEN v NOT IN ('nan', 'None', '') THEN CAST(v AS bigint) END) AS latest FROM x GROUP BY ALL")
def sparse_topic_times(spark, d):
    """FLT-9: times as text of which some are none."""
    text = F.when(F.col("sequence") % 5 == 0, "nan").when(F.col("sequence") % 5 == 1, "None").when(F.col("sequence") % 5 == 2, "").when(F.col("sequence") % 5 == 4, F.col("log_time_ns").cast("string"))
    held = views.messages(spark, d).withColumn("v", align.present(text))
    return held.groupBy("bag", "topic").agg(F.count("v").alias("held"), F.max(F.col("v").cast("long")).alias("latest"))


# ---- what is written and read back ----


@query("+ c AS (SELECT bag, mcap_id, topic, count_if(log_time_ns % 2000000000 < 1000000000) AS a, count_if(log_time_ns % 2000000000 >= 1000000000) AS b FROM v_messages GROUP BY ALL) SELECT bag, mcap_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM c GROUP BY ALL")
def merged_topic_outputs(spark, d):
    """SET-5: what two runs found in a segment, merged."""
    m = views.messages(spark, d)
    early = F.col("log_time_ns") % 2_000_000_000 < 1_000_000_000
    of = lambda c: F.collect_set(F.when(c, F.col("topic")))
    both = m.groupBy("bag", "mcap_id").agg(of(early).alias("old"), of(~early).alias("new"))
    return both.select("bag", "mcap_id", F.array_join(F.array_sort(ingest.merged_outputs(F.col("old"), F.col("new"))), ",").alias("topics"))


@query(SHARDED + " SELECT bag, count(*) AS n, CAST(sum(nth) AS bigint) AS ids, round(sum(list_dot_product(embedding, embedding)), 3) AS squares FROM n GROUP BY bag")
def appended_vectors(spark, d):
    """SNK-5: two appends of sharded vectors, read back."""
    path, s = folder(spark, "vectors"), sharded(spark, d)
    for part in (s.where("id % 2 = 0"), s.where("id % 2 = 1")):
        exports.append_vectors(part, path, 1000)
    e = F.col("embedding")
    return rounded(spark.read.parquet(path).groupBy("bag").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(v.dot(e, e)).alias("squares")), 3, "squares")


@query("+ x AS (SELECT DISTINCT bag, topic FROM v_messages) SELECT bag, topic, CASE WHEN topic LIKE '%c%' THEN 'sensor_msgs/msg/CompressedImage' WHEN topic LIKE '%v%' THEN 'novatel_oem7_msgs/msg/BESTPOS' ELSE 'sensor_msgs/msg/Imu' END AS msg_type FROM x")
def topics_documents(spark, d):
    """SNK-9, SRC-15: a topics document beside each bag, written as JSON and read back."""
    path = folder(spark, "topics")
    exports.write_topics(views.topics(views.messages(spark, d)), path)
    docs = bags.json_documents(spark, path, "bag string, topics map<string,string>")
    return docs.select("bag", F.explode("topics").alias("topic", "msg_type"))


@query("+ x AS (SELECT bag, mcap_id, topic, count(*) AS n, max(log_time_ns) AS latest FROM v_messages GROUP BY ALL) SELECT bag AS name, CAST(mcap_id AS int) AS part_mcap, topic, CASE WHEN CAST(mcap_id AS int) % 2 = 0 THEN n * 2 ELSE n END AS n FROM x")
def written_messages(spark, d):
    """SNK-11 as a table: a second write replaces the segments that it has, and only those."""
    path = folder(spark, "messages")
    m = views.messages(spark, d).select(F.col("bag").alias("name"), F.col("mcap_id").cast("int").alias("part_mcap"), "topic", "log_time_ns")
    exports.write_messages(m, path)
    twice = m.where("part_mcap % 2 = 0")
    exports.write_messages(twice.unionByName(twice), path)
    return spark.read.parquet(path).groupBy("name", "part_mcap", "topic").agg(F.count("*").alias("n"))


@query("+ x AS (SELECT 1) SELECT DISTINCT bag FROM v_messages WHERE bag IN (SELECT bag FROM v_manifest)")
def serving_bags(spark, d):
    """SRC-2."""
    return bags.serving_bags(views.messages(spark, d).select("bag", "mcap_id"), views.manifest(spark, d))


@query("+ x AS (SELECT DISTINCT model FROM v_manifest) SELECT model, 'clip' AS arch, 'b__' || model AS pretrained FROM x")
def model_names(spark, d):
    """SRC-17, FN-7: models without the files beside their folders, and the parts of their names."""
    m = views.manifest(spark, d)
    found = bags.models(m.select("model").unionByName(m.select(F.lit("README.md").alias("model"))))
    arch, pretrained = names.model_parts(F.concat(F.lit("clip__b__"), "model"))
    return found.select("model", arch.alias("arch"), pretrained.alias("pretrained"))


@query("+ x AS (SELECT bag, count(*) AS n FROM v_manifest GROUP BY bag) SELECT bag, n, 'reference_timestamp_index,shard_id,row_in_shard' AS missing FROM x")
def manifest_columns(spark, d):
    """SRC-13: which required columns a manifest lacks."""
    m = views.manifest(spark, d)
    return m.groupBy("bag").agg(F.count("*").alias("n"), F.lit(",".join(search.missing_columns(m))).alias("missing"))


FENCE = "+ s AS (SELECT bag, mcap_id, row_number() OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int)) - 1 AS pos, count(*) OVER (PARTITION BY bag) AS n FROM (SELECT DISTINCT bag, mcap_id FROM v_messages)), p AS (SELECT s.bag, q AS p, s.mcap_id, n * q / 8.0 - floor(n * q / 8.0) AS frac FROM s, range(1, 8) r(q) WHERE pos = floor(n * q / 8.0)), c AS (SELECT bag, mcap_id, topic, count(*) AS c FROM v_messages GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY bag, mcap_id, topic ORDER BY log_time_ns, sequence) - 1 AS nth FROM v_messages), f AS (SELECT p.bag, c.topic, p.p, o.log_time_ns AS t FROM p JOIN c USING (bag, mcap_id) JOIN o ON o.bag = p.bag AND o.mcap_id = p.mcap_id AND o.topic = c.topic AND o.nth = floor(c.c * p.frac))"


@query(FENCE + ", w AS (SELECT *, (t // 1000) % 251 AS v, max(1 + (t // 1000) % 2) OVER (PARTITION BY bag, topic) AS most FROM f) SELECT bag, topic, count(*) AS frames, CAST(count(*) * max(most) AS bigint) AS width, string_agg(repeat(printf('%02X', v), CAST(3 * most AS int)), '' ORDER BY p) AS pixels FROM w GROUP BY bag, topic")
def preview_strips(spark, d):
    """SNK-7: a grey frame of one or two pixels from each fencepost sample, side by side."""
    s = sequences.fenceposts(views.messages(spark, d)).withColumn("us", F.expr("log_time_ns div 1000"))
    grey, width = F.unhex(F.lpad(F.hex(F.col("us") % 251), 2, "0")), (F.col("us") % 2 + 1).cast("int")
    frames = previews.frames_of(s, F.when(width == 2, F.concat(grey, grey)).otherwise(grey), F.lit("mono8"), width, F.lit(1))
    return previews.strips(frames).select("bag", "topic", F.col("frames").cast("long").alias("frames"), F.col("width").cast("long").alias("width"), F.hex("pixels").alias("pixels"))


@query("+ s AS (SELECT bag, mcap_id, count(*) AS count, min(log_time_ns) AS first_ts, max(log_time_ns) AS last_ts FROM v_messages GROUP BY ALL) SELECT bag, mcap_id, count, first_ts, last_ts, CAST(coalesce(sum(count) OVER (PARTITION BY bag ORDER BY CAST(mcap_id AS int) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_index FROM s")
def upserted_summaries(spark, d):
    """SNK-2, SNK-10: summaries that two writes put down, the second for some bags once more."""
    path = folder(spark, "summaries")
    s = align.summaries(timeline(spark, d)[1])
    snapshots.upsert(s.withColumn("count", F.when(F.col("bag") == "bag_1", F.lit(-1)).otherwise(F.col("count")).cast("long")), path, ["bag"])
    snapshots.upsert(s.where("bag in ('bag_1', 'bag_2')"), path, ["bag"])
    return snapshots.read(spark, path)
