import datetime
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import geo, names
from logloom.functions import payloads as pl
from logloom.functions import time as t
from logloom.operators import align, density, exports, search, sequences, spatial, topics

MESSAGES = "bag string, mcap_id string, topic string, log_time_ns long, sequence long"


def messages(spark, rows):
    return spark.createDataFrame([("b", "0", topic, ts, i) for i, (topic, ts) in enumerate(rows)], MESSAGES)


def test_nearest_ties_go_to_the_earlier_and_tolerance_is_strict(spark):
    ticks = spark.createDataFrame([("b", "0", 0, 50), ("b", "0", 1, 1_000_000_000)], "bag string, mcap_id string, ref_idx long, ref_ts long")
    m = messages(spark, [("a", 0), ("a", 100), ("c", 1_100_000_000), ("d", 1_099_999_999)])
    got = {(r.topic, r.ref_idx): r.topic_ts for r in align.nearest_messages(ticks, m).collect()}
    assert got[("a", 0)] == 0
    assert got[("c", 1)] is None and got[("d", 1)] == 1_099_999_999


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 400)), min_size=1, max_size=30), st.lists(st.integers(0, 400), min_size=1, max_size=10, unique=True))
def test_nearest_is_the_best_within_tolerance(spark, rows, ticks):
    m = messages(spark, rows)
    k = spark.createDataFrame([("b", "0", i, x) for i, x in enumerate(ticks)], "bag string, mcap_id string, ref_idx long, ref_ts long")
    for r in align.nearest_messages(k, m, 60).collect():
        best = min((abs(ts - r.ref_ts), ts) for topic, ts in rows if topic == r.topic)
        assert r.topic_ts == (best[1] if best[0] < 60 else None)


def test_timeline_of_one_message_and_of_equal_times(spark):
    assert [r.ref_ts for r in align.uniform_timeline(messages(spark, [("a", 7)])).collect()] == [7]
    assert [r.ref_ts for r in align.uniform_timeline(messages(spark, [("a", 7), ("a", 7)])).collect()] == [7]
    assert align.uniform_timeline(messages(spark, [("a", 7)]).limit(0)).count() == 0


def test_missing_topics_get_rows_of_nulls(spark):
    m = messages(spark, [("a", 0), ("a", 100)])
    full = align.with_missing_topics(align.nearest_messages(align.uniform_timeline(m), m), spark.createDataFrame([("b", "a"), ("b", "z")], "bag string, topic string"))
    assert {r.topic for r in full.where("topic_ts is null").collect()} == {"z"}


def test_nearest_non_null_prefers_the_left(spark):
    values = [None, 5, None, None, 8, None, None, None]
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate(values)], "bag string, idx long, v long")
    got = [r.found for r in align.nearest_non_null(df, ["bag"], "idx", "v", 2).orderBy("idx").collect()]
    assert got == [5, 5, 5, 8, 8, 8, 8, None]


def test_segment_of_index_leaves_indexes_outside_null(spark):
    s = spark.createDataFrame([("b", "4", 0, 3), ("b", "5", 3, 2)], "bag string, mcap_id string, start_index long, count long")
    idx = spark.createDataFrame([("b", i) for i in (-1, 0, 2, 3, 4, 5)], "bag string, idx long")
    got = {r.idx: (r.mcap_id, r.offset) for r in align.segment_of_index(idx, s).collect()}
    assert got == {-1: (None, None), 0: ("4", 0), 2: ("4", 2), 3: ("5", 0), 4: ("5", 1), 5: (None, None)}


@pytest.mark.parametrize("n, every", [(0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (5, 1), (5, 0)])
def test_stride_keeps_a_ceiling_of_rows(spark, n, every):
    df = spark.createDataFrame([("t", i) for i in range(n)], "topic string, id long")
    assert search.stride(df, every, ["topic"], ["id"]).count() == math.ceil(n / max(1, every))


def test_windows_skip_ids_that_are_no_numbers_and_unnamed_bags(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "10"), ("a", "abc"), ("a", None), ("z", "abc")], "bag string, mcap_identifier string")
    assert [tuple(r) for r in search.in_windows(df, {"a": [(0, 5)]}).collect()] == [("a", "2"), ("z", "abc")]
    w = spark.createDataFrame([("a", 0, 5), ("a", 1, 3)], "bag string, lo int, hi int")
    assert sorted(tuple(r) for r in search.in_windows_table(df, w).collect()) == [("a", "2"), ("z", "abc")]


def test_similarity_of_zero_and_equal_vectors(spark):
    df = spark.createDataFrame([("m", "b", "t", i, i * 10, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])], "model string, bag string, topic string, id long, timestamp_ns long, embedding array<float>")
    assert [r.similarity for r in density.adjacent_similarity(df).orderBy("seq").collect()] == [0.0, 1.0]
    assert density.adjacent_similarity(df.limit(1)).count() == 0


def test_moving_average_and_resample_against_plain_python(spark):
    r = random.Random(3)
    values = [r.random() for _ in range(40)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(values)], "g string, seq long, similarity double")
    means = [x.mean for x in density.moving_average(df, ["g"]).orderBy("seq").collect()]
    assert means == pytest.approx([sum(values[i : i + 5]) / 5 for i in range(36)])
    got = [x.value for x in density.resampled(df, ["g"], value="similarity", points=11).orderBy("k").collect()]
    at = [k * 39 / 10 for k in range(11)]
    assert got == pytest.approx([values[int(x)] + (values[min(39, int(x) + 1)] - values[int(x)]) * (x - int(x)) for x in at])


def test_cells_round_halves_to_even_and_below_zero(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.3,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(geo.cell(F.col("x"), 1.0)).collect()] == [0, 2, 0, 0]
    p = spark.createDataFrame([("b", None, 0.0, 5.0), ("b", None, 5.0, 0.0), ("b", None, 1.0, 1.0)], "bag string, mcap_id string, lat double, lon double")
    assert [tuple(r) for r in spatial.grid(spatial.valid_positions(p), 1.0).collect()] == [("b", "unknown", 1, 1, 1)]


def test_polygons_against_the_even_odd_rule(spark):
    ring = [(0.0, 0.0), (0.0, 0.04), (0.03, 0.04), (0.03, 0.02), (0.01, 0.02), (0.01, 0.01), (0.04, 0.01), (0.04, 0.0)]
    r = random.Random(1)
    pts = [(r.uniform(-0.01, 0.05), r.uniform(-0.01, 0.05)) for _ in range(300)] + [(0.0, 0.0), (0.01, 0.02), (0.03, 0.03)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {(x.lat, x.lon) for x in spatial.points_in_polygons(df, spatial.polygon_edges(spark, {"p": ring, "two": ring[:2]})).collect()}
    assert got == {p for p in pts if spatial.inside(p, ring)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_hulls_hold_all_points(points):
    hull = spatial.convex_hull([(float(a), float(b)) for a, b in points])
    for p in points:
        assert len(hull) < 3 or all(spatial.cross(a, b, p) >= 0 for a, b in zip(hull, hull[1:] + hull[:1], strict=True))


def test_islands_keep_every_id_once(spark):
    ids = [1, 2, 3, 7, 9, 10, 10, None]
    runs = spatial.islands(spark.createDataFrame([("b", i) for i in ids], "bag string, i int"), ["bag"], "i").orderBy("lo")
    assert [(r.lo, r.hi, r.n) for r in runs.collect()] == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]
    assert spatial.area_text(runs).first().text == "b: 1 - 3, 7, 9 - 10"


def test_offset_grows_a_square():
    ring = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)]
    (out,) = spatial.offset_rings(ring, 111.0)
    assert min(p[0] for p in out) == pytest.approx(-0.001, abs=1e-5) and max(p[1] for p in out) == pytest.approx(0.011, abs=1e-5)
    assert spatial.offset_rings(ring, -5000.0) == [ring] and spatial.rings_overlap(ring, out) and not spatial.rings_overlap(ring, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)])


def test_names(spark):
    df = spark.createDataFrame([("x/A_multi_parts/Part_2",), ("/r/B",), ("B",)], "p string")
    assert [r[0] for r in df.select(names.bag_key(F.col("p"))).collect()] == ["A_multi_parts/Part_2", "B", "B"]
    one = spark.range(1).select(names.csv_list(F.lit(" a, ,b,")).alias("l"), names.mcap_id(F.lit("x_12.mcap")).alias("i"), names.mcap_id(F.lit("x.mcap"), "0").alias("d"), names.model_parts(F.lit("v__a__b"))[1].alias("m"), t.duration(F.lit(-61_000)).alias("t"), names.bag_time(F.lit("rosbag2_2024_13_01-00_00_00")).alias("none")).first()
    assert (one.l, one.i, one.d, one.m, one.t, one.none) == (["a", "b"], "12", "0", "a__b", "-1:01", datetime.datetime(2025, 1, 1))


def test_fenceposts_go_by_place_and_not_by_id(spark):
    rows = [("b", str(48 + s), "t", s * 1000 + i, i) for s in range(4) for i in range(8)]
    got = sequences.fenceposts(spark.createDataFrame(rows, MESSAGES)).orderBy("p").collect()
    assert [(r.mcap_id, r.nth) for r in got] == [("48", 4), ("49", 0), ("49", 4), ("50", 0), ("50", 4), ("51", 0), ("51", 4)]


def test_topics_documents_of_both_forms(spark):
    df = spark.createDataFrame([('{"topics": {"/a": "T"}}',), ('{"topics": ["/b"]}',)], "d string")
    assert [r[0] for r in df.select(topics.topics_as_map(F.col("d"))).collect()] == [{"/a": "T"}, {"/b": ""}]


def test_export_ends_are_half_open_and_inner_segments_whole(spark):
    m = spark.createDataFrame([("b", str(s), "t", s * 10 + i, i) for s in range(3) for i in range(10)], MESSAGES)
    plan = spark.createDataFrame([("b", "x", 5, 25, "0", "2")], "bag string, name string, start_ts long, end_ts long, start_mcap string, end_mcap string")
    assert sorted(r.log_time_ns for r in exports.export_messages(m, plan).collect()) == list(range(5, 25))
    assert exports.export_messages(m, plan, inclusive_end=True).count() == 21


def test_pcd_and_points(spark):
    import struct

    data = b"".join(struct.pack("<fffI", *p) for p in [(1.0, 2.0, 3.0, 0x010203), (0.0, 0.0, 0.0, 0), (float("nan"), 0.0, 1.0, 0)])
    fields = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("rgb", 12, 6)]
    assert pl.unpack_points(data, 16, fields) == [(1.0, 2.0, 3.0, 1, 2, 3)]
    assert len(pl.unpack_points(data, 16, fields, drop_zero=False)) == 2 and pl.unpack_points(b"", 16, fields) == []
    assert pl.unpack_points(struct.pack(">fff", 1.0, 2.0, 3.0), 12, fields[:3], big=True)[0][:3] == (1.0, 2.0, 3.0)
    df = spark.createDataFrame([(bytearray(data), 16, [(n, o, k) for n, o, k in fields], False), (None, 16, [], False)], "d binary, s int, f array<struct<name:string,offset:int,datatype:int>>, b boolean")
    text = df.select(exports.pcd_text(pl.points(F.col("d"), F.col("s"), F.col("f"), F.col("b")), True).alias("t")).collect()
    assert text[0].t.endswith("POINTS 1\nDATA ascii\n1.0 2.0 3.0 66051\n") and "POINTS 0" in text[1].t
    assert pl.to_rgb(bytes([1, 2, 3]), "bgr8", 1, 1) == bytes([3, 2, 1]) and pl.to_rgb(b"\x00\x02", "mono16", 1, 1) == bytes([2, 2, 2]) and pl.to_rgb(b"", "jpeg", 1, 1) is None


def grid_sides(cells):
    """Border sides of the squares around cells, by sets."""
    filled = {(a + i, b + j) for a, b in cells for i in (0, 1) for j in (0, 1)}
    return {(p, q) for a, b in filled for (x, y), p, q in [((a + o[0], b + o[1]), (a + p[0], b + p[1]), (a + q[0], b + q[1])) for o, p, q in spatial.SIDES] if (x, y) not in filled}


def test_concave_hulls_against_sets_of_cells(spark):
    """Every side of the border is in a ring once, holes among them, and the rings of most corners come first."""
    r = random.Random(6)
    bags = {f"b{k}": {(r.randint(0, n), r.randint(0, n)) for _ in range(n * 2)} for k, n in enumerate((1, 4, 8, 12))}
    bags["ring"] = {(a, b) for a in range(8) for b in range(8) if not (2 <= a <= 5 and 2 <= b <= 5)}
    rows = [(k, a, b) for k, cs in bags.items() for a, b in cs]
    for x in spatial.concave_hulls(spark.createDataFrame(rows, "bag string, lat_idx long, lon_idx long"), 1.0).collect():
        whole = [[(int(p[0] + 0.5), int(p[1] + 0.5)) for p in ring] for ring in x.rings]
        got = [(p, q) for ring in whole for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
        if all(len(ring) <= 40 for ring in whole):
            assert sorted(got) == sorted(grid_sides(bags[x.bag]))
        assert len(whole[0]) >= len(whole[-1]) and (x.bag != "ring" or len(whole) == 2)
    assert spatial.concave_hulls(spark.createDataFrame([], "bag string, lat_idx long, lon_idx long")).count() == 0


def test_convex_hulls_against_all_pairs(spark):
    """A corner is a point from which some line leaves all others on one side."""
    r = random.Random(7)
    bags = {f"b{k}": {(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)} for k, n in enumerate((1, 2, 5, 30, 60))}
    rows = [(k, a, b) for k, cs in bags.items() for a, b in cs]
    for x in spatial.convex_hulls(spark.createDataFrame(rows, "bag string, lat_idx long, lon_idx long"), 1.0).collect():
        pts = bags[x.bag]
        outer = {p for p in pts for q in pts if p != q and all(spatial.cross(p, q, o) >= 0 and (spatial.cross(p, q, o) > 0 or math.dist(p, o) <= math.dist(p, q)) and not (spatial.cross(p, q, o) == 0 and math.dist(q, o) > math.dist(p, q)) for o in pts)}
        assert {(int(a), int(b)) for a, b in x.rings[0]} == (outer if len(pts) > 2 else pts)


def test_wide_polygons_have_few_tiles(spark):
    world = {"all": [(-90.0, -180.0), (-90.0, 180.0), (90.0, 180.0), (90.0, -180.0)], "small": [(0.0, 0.0), (0.0, 0.001), (0.001, 0.001), (0.001, 0.0)]}
    df = spark.createDataFrame([(0.0005, 0.0005), (45.0, -100.0)], "lat double, lon double")
    got = sorted((r.poly_id, r.lat) for r in spatial.points_in_polygons(df, spatial.polygon_edges(spark, world)).collect())
    assert got == [("all", 0.0005), ("all", 45.0), ("small", 0.0005)]


def test_names_of_bags_with_times(spark):
    when = datetime.datetime
    want = {
        "rosbag2_2024_03_05-07_08_09": when(2024, 3, 5, 7, 8, 9), " rosbag2_2024_03_05-07_08_09_short ": when(2024, 3, 5, 7, 8, 9), "/a/rosbag2_2024_03_05-07_08_09": when(2024, 3, 5, 7, 8, 9),
        "rosbag2_2024_03_05-07_08_09_multi_parts/Part_2": when(2024, 3, 5, 7, 8, 9), "rosbag2_2024_03_05-07_08_09/Part_1": when(2024, 3, 5, 7, 8, 9), "rosbag2_2024_02_30-00_00_00": when(2024, 3, 1), "rosbag2_2024_1_05-07_08_09": None,
        "xrosbag2_2024_03_05-07_08_09": None, "rosbag2_2024_03_05-07_08_09_x": None, "/a/rosbag2_2024_03_05-07_08_09_multi_parts/Part_2": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "n string").select("n", names.bag_time(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == want


def test_hue_of_a_name(spark):
    def brute(text):
        h = 0
        for k in range(0, len(raw := text.encode("utf-16-be")), 2):
            low = (int(h) << 5) & 0xFFFFFFFF
            h = int.from_bytes(raw[k : k + 2], "big") + (low - (1 << 32) if low >> 31 else low) - h
        return abs(h) % 360

    texts = ["", "0", "7", "12", "149", "abc", "é😀", "a" * 50, "rosbag2_2024_03_05-07_08_09", "zzzzzzzzzzzzzzzzzzzzzzzz"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(names.hue(F.col("t"))).collect()] == [brute(x) for x in texts]
    assert brute("0") == 48 and brute("12") == (50 + 49 * 31) % 360


def test_summary_of_a_transform(spark):
    want = {"Compose(Resize(size=224), CenterCrop(size=(224, 224)), ToTensor(), Normalize(mean=(0.4)))": "resize224_crop224_tensor_norm", "CenterCrop(size=336)": "crop336", "Resize(size=(224, 224))": "default", "ToTensor()": "tensor", "resize(size=1)": "default", "": "default"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", names.transform_summary(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == want


def test_durations(spark):
    want = {0: "0:00", 61_999: "1:01", 3_599_999: "59:59", 3_600_000: "1:00:00", 36_061_000: "10:01:01", -61_000: "-1:01", -3_661_000: "-1:01:01"}
    assert {r.m: r.d for r in spark.createDataFrame([(k,) for k in want], "m long").select("m", t.duration(F.col("m")).alias("d")).collect()} == want


def test_topics_by_priority_and_camera(spark):
    order = ["/zed/color", "/cam/image_side_left", "/Camera_Side_Right", "/rgb_rear_left", "/image_rear_mid", "/camera_rear_right", "/a_camera", "/color_front", "/pcl", "/velodyne_lidar", "/gnss", "/odom", "/tf", "/zed/imu"]
    shuffled = random.Random(2).sample(order, len(order))
    rows = topics.sorted_topics(spark.createDataFrame([("b", x) for x in shuffled], "bag string, topic string")).orderBy("position").collect()
    assert [r.topic for r in rows] == order
    typed = [("/zed/x", "sensor_msgs/msg/Image", 0), ("/x", "sensor_msgs/msg/CompressedImage", 1), ("/image", "sensor_msgs/msg/PointCloud2", 2), ("/camera", "sensor_msgs/msg/NavSatFix", 3), ("/image", "std_msgs/msg/String", 4), ("/image", "", 1), ("/lidar", None, 2)]
    got = spark.createDataFrame(typed, "topic string, msg_type string, want int").select("want", topics.priority(F.col("topic"), F.col("msg_type")).alias("p")).collect()
    assert all(r.want == r.p for r in got)


def test_export_names_of_one_and_several_segments(spark):
    w = spark.createDataFrame([("a b", 3, 3), ("c", 3, 4), ("c", 7, 9)], "bag string, lo int, hi int")
    assert sorted(r.name for r in exports.export_names(w).collect()) == ["a_b_id_3", "c_ids_3_to_9_part1", "c_ids_3_to_9_part2"]


@pytest.mark.parametrize("seconds", [0, 5, 540, 549, 550, 1100, 1650, 5000, 100_000])
def test_ticks_of_spans(spark, seconds):
    a, b = 1_704_067_203_400, 1_704_067_203_400 + seconds * 1000
    got = sequences.time_ticks(spark.createDataFrame([("b", a * 1_000_000, b * 1_000_000 + 7)], "bag string, first_ts long, last_ts long")).orderBy("tick_s").collect()
    step = next((s for s in (10, 20, 30) if int(seconds / s) <= 54), 60)
    want = [s for s in range(a // 1000 - 60, b // 1000 + 1) if s % step == 0 and a <= s * 1000 <= b] if seconds else []
    label = next((n for n in sequences.LABEL_STEPS if n >= step and sum(s % n == 0 for s in want) <= 54), 3600)
    assert [(r.tick_s, r.labelled) for r in got] == [(s, s % label == 0) for s in want]
    assert all(r.share == pytest.approx((r.tick_s * 1000 - a) / (b - a)) for r in got)


def test_big_endian_colours():
    import struct

    fields = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("rgb", 12, 6)]
    assert pl.unpack_points(struct.pack(">fffI", 1.0, 2.0, 3.0, 0x01020304), 16, fields, big=True)[0][3:] == (1, 2, 3)
    assert pl.unpack_points(struct.pack("<fffI", 1.0, 2.0, 3.0, 0x01020304), 16, fields)[0][3:] == (2, 3, 4)


def test_nearest_rows_of_many_queries(spark):
    """With clusters and shells of any size, with ties, zero vectors and rows without a vector, as all pairs give."""
    import numpy as np

    r = np.random.default_rng(3)
    e = [(f"m{i % 2}", f"b{i % 3}", i, [float(x) for x in (r.integers(0, 3, 4) if i % 5 else np.zeros(4))] if i % 11 else None) for i in range(240)]
    df = spark.createDataFrame(e, "model string, bag string, id long, embedding array<float>")
    asked = search.query_rows(df, 20)
    want = set()
    for q in (x for x in e if x[2] % 20 == 0 and x[3]):
        for group in {x[:2] for x in e}:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x[3], q[3], strict=True)), x[2]) for x in e if x[:2] == group and x[3])[:7]
            want |= {(q[2], i, d, n + 1) for n, (d, i) in enumerate(near)}
    for clusters, slot in ((1, 1000), (5, 17), (40, 3)):
        got = search.nearest_to(df, asked, 7, clusters=clusters, slot=slot)
        assert {(x.query_id, x.id, x.distance, x.local_rank) for x in got.collect()} == want and set(df.columns) < set(got.columns)
    assert search.nearest_to(df, asked.limit(0)).count() == 0 and search.nearest_to(df.limit(0), asked).count() == 0


def test_shards_go_on_behind_each_group(spark):
    schema = "model string, bag string, vec int"
    old = sequences.shards(spark.createDataFrame([("m", "a", i) for i in range(5)] + [("m", "b", i) for i in range(2)], schema), ["model", "bag"], ["vec"], 4)
    new = sequences.shards(spark.createDataFrame([("m", b, 10 + i) for b in "abc" for i in range(3)], schema), ["model", "bag"], ["vec"], 4, old)
    assert {b: [(x.id, x.shard_id[-1], x.row_in_shard) for x in new.where(F.col("bag") == b).orderBy("id").collect()] for b in "abc"} == {"a": [(5, "1", 1), (6, "1", 2), (7, "1", 3)], "b": [(2, "0", 2), (3, "0", 3), (4, "1", 0)], "c": [(0, "0", 0), (1, "0", 1), (2, "0", 2)]}


def test_batches_of_exports_and_pending_segments(spark):
    from logloom.operators import manifests

    schema = "place int, name string, source_rosbag string"
    one = manifests.export_batch(spark.createDataFrame([(1, "a", None)], schema), F.lit("p")).first()
    assert (one.source_rosbag, one.output_parent) == (None, None)
    pending = spark.createDataFrame([("B", "1"), ("/x/B", "1"), ("/x/B", "2"), ("C", "3")], "key string, mcap_id string")
    got = manifests.pending_segments(pending, spark.createDataFrame([("/x/B",), ("/y/D",)], "path string"))
    assert sorted(tuple(r) for r in got.collect()) == [("/x/B", "1"), ("/x/B", "2")]
    assert manifests.ordered_columns(spark.createDataFrame([(1, 2, 3)], "x int, topic int, id int")).columns == ["id", "topic", "x"]


def test_vector_index_visits_few_rows_of_clustered_vectors(spark):
    """Under a tenth of all pairs, and every result as all pairs give it, with half of all rows in one place."""
    import numpy as np

    from logloom.operators import vectorindex

    r = np.random.default_rng(5)
    middles = r.normal(0, 10, (60, 16))
    e = [middles[i % 60] + r.normal(0, 0.3, 16) if i % 2 == 0 else np.full(16, 40.0) + 0.3 * (i % 7 == 0) for i in range(6000)]
    df = spark.createDataFrame([("m", "b", i, [float(np.float32(x)) for x in v]) for i, v in enumerate(e)], "model string, bag string, id long, embedding array<float>")
    asked = search.query_rows(df, 100)
    index = vectorindex.build(df, ("model", "bag"), "id", 60, 100)
    near, visits = vectorindex.nearest(index, asked, 10)
    e = np.array(e, np.float32).astype(float)
    for q, rows in near.toPandas().groupby("query_id"):
        d = np.square(e - e[q]).sum(axis=1)
        assert rows.sort_values("local_rank")["id"].tolist() == sorted(range(6000), key=lambda i: (d[i], i))[:10]
    pairs = visits.agg(F.sum("rows")).first()[0]
    assert near.select("query_id").distinct().count() == 60 and pairs < 60 * 6000 / 10
    assert visits.where("rows > 100").isEmpty()


def test_numbers_and_sums_of_one_large_group(spark):
    """A group with nine tenths of all rows is spread: no task of the numbering holds more than a quarter of it."""
    from logloom.operators import numbering

    rows = [("big" if i % 10 else None, (i * 7919) % 4000, i) for i in range(8000)]
    df = spark.createDataFrame(rows, "g string, t long, id long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        held = numbering.ranged(df, ["g"], ["t", "id"]).groupBy("g", numbering.PART).count().where("g = 'big'")
        assert held.count() >= 5 and held.agg(F.max("count")).first()[0] < 7200 / 4
        got = {r.id: (r.idx, r.s) for r in numbering.running_sum(numbering.numbered(df, ["g"], ["t", "id"]), ["g"], ["t", "id"], "t", "s").collect()}
        near = {r.id: (r.before, r.after) for r in numbering.with_neighbours(df.withColumn("v", F.when(F.col("id") % 997 == 1, F.col("t"))), ["g"], ["t", "id"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in ("big", None):
        own, s = sorted(r[1:] for r in rows if r[0] == g), 0
        given = [(t, i) for t, i in own if i % 997 == 1]
        for n, (t, i) in enumerate(own):
            assert got[i] == (n, s)
            s += t
            assert near[i] == (max((x for x in given if x <= (t, i)), default=(None,))[0], min((x for x in given if x >= (t, i)), default=(None,))[0])


def test_preview_strips_by_pixel(spark):
    """Against plain means of areas; the PNG holds the same pixels; nine frames are rows of four on white."""
    import struct
    import zlib

    import numpy as np

    from logloom.operators import previews

    r = np.random.default_rng(2)
    wide, small = r.integers(0, 256, (4, 6, 3)).astype(np.uint8), r.integers(0, 256, (2, 3, 3)).astype(np.uint8)
    assert np.array_equal(previews.resampled(small, 4, 6), small.repeat(2, 0).repeat(2, 1))
    half = wide.reshape(2, 2, 3, 2, 3).astype(float).mean(axis=(1, 3))
    assert np.array_equal(previews.resampled(wide, 2, 3), np.floor(half + 0.5).astype(np.uint8))
    big = wide.repeat(5, 0).repeat(5, 1).astype(float)  # 4 x 6 to 5 x 5: areas of a common grid
    want = np.floor(big.reshape(5, 4, 5, 6, 3).mean(axis=(1, 3)) + 0.5)
    assert np.array_equal(previews.resampled(wide, 5, 5), want)
    rows = [("b", "t", i, 6 if i % 2 else 3, 4 if i % 2 else 2, bytearray((wide if i % 2 else small).tobytes())) for i in range(9)]
    (one,) = previews.strips(spark.createDataFrame(rows, "bag string, topic string, p int, width int, height int, rgb binary")).collect()
    px = np.frombuffer(bytes(one.pixels), np.uint8).reshape(one.height, one.width, 3)
    assert (one.frames, one.width, one.height) == (9, 24, 12) and np.array_equal(px[:4, 6:12], wide) and np.array_equal(px[4:8, :6], small.repeat(2, 0).repeat(2, 1)) and (px[8:, 6:] == 255).all()
    data = bytes(one.png)
    at = data.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(one.height, 1 + 3 * one.width)
    assert np.array_equal(lines[:, 1:].reshape(px.shape), px)
    bad = spark.createDataFrame([("b", "t", 1, bytearray(b"1234"))], "bag string, topic string, p int, data binary")
    assert previews.frames_of(bad, F.col("data"), F.lit("rgb8"), F.lit(2), F.lit(1)).count() == 0


def metric(points):
    """Corners in metres as a ring of degrees on the equator."""
    return [(y / geo.METRES, x / geo.METRES) for x, y in points]


OFFSETS = {
    "U": [(0, 0), (300, 0), (300, 300), (185, 300), (185, 100), (115, 100), (115, 300), (0, 300)],  # a gap of 70 m
    "dumbbell": [(0, 0), (200, 0), (200, 80), (300, 80), (300, 0), (500, 0), (500, 200), (300, 200), (300, 120), (200, 120), (200, 200), (0, 200)],
    "C": [(0, 0), (300, 0), (300, 130), (250, 130), (250, 50), (50, 50), (50, 250), (250, 250), (250, 170), (300, 170), (300, 300), (0, 300)],  # closes around a hole
    "comb": [(0, 0), (400, 0), (400, 200), (350, 200), (350, 60), (250, 60), (250, 200), (200, 200), (200, 60), (100, 60), (100, 200), (0, 200)],
}


@pytest.mark.parametrize("name", sorted(OFFSETS))
@pytest.mark.parametrize("metres", [60.0, 20.0, -20.0, -30.0, 38.0])
def test_offset_against_a_raster_of_distances(name, metres):
    """Rings of right angles: what is nearer than the distance belongs to it, what is farther than a mitre's end doesn't, both
    counted by the rings' even-odd rule; clockwise rings give the same."""
    import numpy as np

    corners = np.array(OFFSETS[name], float)
    rings = spatial.offset_rings(metric(corners), metres)
    turned = spatial.offset_rings(metric(corners[::-1]), metres)
    assert len(rings) == len(turned)
    a, b = corners, np.roll(corners, -1, axis=0)
    r = np.random.default_rng(7)
    pts = np.stack([r.uniform(-120, 620, 6000), r.uniform(-120, 420, 6000)], axis=1)
    t = np.clip((((pts[:, None] - a) * (b - a)).sum(-1) / ((b - a) ** 2).sum(-1)), 0, 1)
    far = np.hypot(*np.moveaxis(pts[:, None] - (a + t[..., None] * (b - a)), -1, 0)).min(axis=1)
    odd = lambda p, rs: sum(spatial.inside((p[1] / geo.METRES, p[0] / geo.METRES), ring) for ring in rs) % 2 == 1
    within = np.array([odd(p, [metric(corners)]) for p in pts])
    signed = np.where(within, -far, far)  # below zero inside
    if rings == [metric(corners)]:
        assert metres < 0 and signed.min() > metres * 2**0.5  # nothing is left
        return
    for p, s in zip(pts, signed, strict=True):
        low, high = (metres, metres * 2**0.5) if metres > 0 else (metres * 2**0.5, metres)
        if s < low - 0.01:
            assert odd(p, rings) and odd(p, turned), (p, s)
        elif s > high + 0.01:
            assert not odd(p, rings) and not odd(p, turned), (p, s)


def test_offset_pieces_holes_and_crossing_rings():
    count = lambda name, by: len(spatial.offset_rings(metric(OFFSETS[name]), by))
    assert count("dumbbell", -30.0) == 2 and count("dumbbell", -10.0) == 1 and count("C", 30.0) == 2 and count("U", 60.0) == 1
    bow = metric([(0, 0), (100, 100), (100, 0), (0, 100)])  # crosses itself: both halves are there or the ring comes back
    assert all(len(r) >= 3 for r in spatial.offset_rings(bow, 5.0))
    spike = metric([(0, 0), (1000, 1), (0, 2)])
    assert max(p[1] for p in spatial.offset_rings(spike, 10.0)[0]) * geo.METRES <= 1000 + 10 * 10 + 1
    assert spatial.offset_rings(metric([(0, 0), (1, 1)]), 5.0) == [metric([(0, 0), (1, 1)])]
