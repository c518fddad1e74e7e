import io

import numpy as np
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import align
from logloom.sources import bags, mcap, npy
from logloom.streaming import ingest


def test_mcap_files_are_read_with_filters(spark, tmp_path):
    rows = [("/a", "T", i, i, i, bytes([i])) for i in range(20)] + [("/b", "U", 5, 5, 0, b"x")]
    for bag, n in (("bag1", 0), ("bag1", 1), ("X_multi_parts/Part_2", 0)):
        folder = tmp_path / bag
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"log_{n}.mcap").write_bytes(mcap.encode(rows))
    spark.dataSource.register(mcap.McapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("mcap").load(str(tmp_path))
    assert df.count() == 63 and df.schema == schemas.MESSAGES
    got = df.where((F.col("topic") == "/a") & (F.col("log_time_ns") >= 5) & (F.col("log_time_ns") < 8))
    assert {(r.bag, r.mcap_id, r.log_time_ns, bytes(r.data)) for r in got.collect()} == {(b, n, t, bytes([t])) for b, n in (("bag1", "0"), ("bag1", "1"), ("X_multi_parts/Part_2", "0")) for t in (5, 6, 7)}
    assert list(mcap.messages(io.BytesIO(mcap.encode([])))) == []
    listed = bags.segments(bags.files(spark, str(tmp_path)))
    assert [r.bag for r in bags.bags(listed).collect()] == ["X_multi_parts/Part_2", "bag1"]


def test_vector_shards(spark, tmp_path):
    np.save(tmp_path / "shard-00000.npy", np.arange(12, dtype=np.float64).reshape(4, 3))
    spark.dataSource.register(npy.NpySource)
    df = spark.read.format("npy").option("rows", "3").load(str(tmp_path))
    assert [(r.shard, r.row_in_shard, r.embedding) for r in df.orderBy("row_in_shard").collect()][3] == ("shard-00000", 3, [9.0, 10.0, 11.0])


def test_documents_beside_bags(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "metadata.yaml").write_text("rosbag2_bagfile_information:\n  topics_with_message_count:\n    - topic_metadata:\n        name: /a\n        type: T\n      message_count: 3\n    - topic_metadata:\n        name: /b\n      message_count: 1\n")
    assert sorted(tuple(r) for r in bags.topics_of_metadata(spark, str(tmp_path)).collect()) == [("b1", "/a", "T"), ("b1", "/b", "unknown")]
    text = spark.createDataFrame([("Topic: /x/y | Type\n /z /z",), (None,)], "value string")
    assert sorted(r.topic for r in bags.topics_of_text(text).collect()) == ["/x/y", "/z"]
    wide = spark.createDataFrame([(1, 5, None), (2, None, 7)], "`Reference Timestamp` long, `/a` long, `Max Distance` long")
    wide.coalesce(1).write.parquet(str(tmp_path / "lookup"))
    long = bags.aligned(bags.lookup_tables(spark, str(tmp_path / "lookup")))
    assert sorted((r.ref_ts, r.topic, r.topic_ts) for r in long.collect()) == [(1, "/a", 5), (2, "/a", None)]
    stats = bags.parquet_stats(spark, str(tmp_path / "lookup"), "`Reference Timestamp`").first()
    assert (stats.n, stats.least, stats.largest) == (2, 1, 2)


def test_ingestion_again_changes_nothing(spark, tmp_path):
    schema = "bag string, mcap_id string, topic string, log_time_ns long, sequence long"
    rows = [("b", str(s), "t", s * 100 + i, i) for s in range(2) for i in range(4)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    summary = lambda: sorted(tuple(r) for r in ingest.with_start_index(spark.read.parquet(str(tmp_path / "out/summary"))).select("bag", F.col("mcap_id").cast("string"), "count", "start_index").collect())
    assert summary() == [("b", "0", 4, 0), ("b", "1", 4, 4)]
    run()
    assert summary() == [("b", "0", 4, 0), ("b", "1", 4, 4)]
    spark.createDataFrame([("b", "2", "t", 500, 0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert summary()[-1] == ("b", "2", 1, 8)
    ledger = spark.read.parquet(str(tmp_path / "out/ledger"))
    segments = spark.createDataFrame([("b", str(i)) for i in range(4)], "bag string, mcap_id string")
    assert [r.mcap_id for r in ingest.unprocessed(segments, ledger, "ingest").collect()] == ["3"]
    assert align.summaries(spark.createDataFrame(rows, schema), "log_time_ns").count() == 2


def test_plans_end_to_end(spark, tmp_path):
    from logloom.plans import area_export, preprocess

    m = spark.createDataFrame([("b", str(s), "t", s * 1000 + i * 10, i) for s in range(4) for i in range(20)], "bag string, mcap_id string, topic string, log_time_ns long, sequence long")
    p = spark.createDataFrame([("b", str(s), 50.0 + s * 0.001, 10.0 + i * 0.0001) for s in range(4) for i in range(5)], "bag string, mcap_id string, lat double, lon double")
    made = preprocess.tables(m, p)
    preprocess.write({k: v for k, v in made.items() if k != "boundary"}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/summary")).count() == 4
    rows = m.withColumnRenamed("log_time_ns", "ref_ts").select("bag", "mcap_id", "ref_ts")
    plan = area_export.plan(p, rows, {"q": [(50.0005, 9.9), (50.0025, 9.9), (50.0025, 10.1), (50.0005, 10.1)]})
    assert [(r.name, r.start_mcap, r.end_mcap) for r in plan.collect()] == [("b_ids_1_to_2", "1", "2")]
    assert {r.mcap_id for r in area_export.messages(plan, m).collect()} == {"1", "2"}


def test_a_segment_in_several_batches(spark, tmp_path):
    schema = "bag string, mcap_id string, topic string, log_time_ns long, sequence long"
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    for rows in ([("b", "0", "t", i, i) for i in range(4)] + [("b", "1", "t", 9, 0)], [("b", "0", "t", 10 + i, i) for i in range(3)] + [("b", "2", "t", 50, 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = spark.read.parquet(str(tmp_path / "out/summary")).select("bag", F.col("mcap_id").cast("string"), "count", "first_ts", "last_ts")
    assert sorted(tuple(r) for r in got.collect()) == [("b", "0", 7, 0, 12), ("b", "1", 1, 9, 9), ("b", "2", 1, 50, 50)]


def test_live_counts_of_a_stream(spark, tmp_path):
    schema = "topic string, log_time_ns long"
    minute = 60_000_000_000
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", minute + 5)], schema).write.parquet(str(tmp_path / "in"))
    q = ingest.live_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.topic, r.n) for r in spark.table("live").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_ledger_levels(spark):
    topics = spark.createDataFrame([("b", "0", "x"), ("b", "0", "y")], "bag string, mcap_id string, topic string")
    models = spark.createDataFrame([("m", "b"), ("n", "b")], "model string, bag string")
    ledger = ingest.ledger_rows(topics.limit(1), "p", at=5).unionByName(ingest.ledger_rows(models.limit(1), "p", at=5)).unionByName(ingest.ledger_rows(topics.select("bag", "mcap_id").distinct(), "p", "failed", at=9))
    assert ingest.unprocessed(topics, ledger, "p").count() == 1 and ingest.unprocessed(models, ledger, "p").count() == 1
    assert ingest.unprocessed(topics.select("bag", "mcap_id").distinct(), ledger, "p").count() == 1
    again = ledger.unionByName(ingest.ledger_rows(topics, "p", "started", at=7))
    assert ingest.unprocessed(topics, again, "p").count() == 2 and ingest.unprocessed(topics, ledger, "q").count() == 2


def test_mcap_chunks_codecs_and_summaries(tmp_path, spark):
    rows = [(f"/t{i % 3}", "T" if i % 3 else "U", 100 + i, 100 + i, i, bytes([i % 256]) * 50) for i in range(400)]
    for codec in ("", "lz4", "zstd"):
        data = mcap.encode(rows, {"T": "int32 x", "U": "int8 y"}, {"m": {"a": "b"}}, codec, 2000)
        read = []

        class Seen(io.BytesIO):
            def read(self, *n):
                out = super().read(*n)
                read.append(len(out))
                return out

        assert list(mcap.messages(io.BytesIO(data))) == rows and list(mcap.messages(io.BytesIO(data[: len(data) - 60]))) == rows
        some = list(mcap.messages(Seen(data), 200, 230, {"/t1"}))
        assert some == [r for r in rows if 200 <= r[2] < 230 and r[0] == "/t1"] and (codec or sum(read) < len(data) / 2)
        assert mcap.counts_in(io.BytesIO(data)) == [("/t0", "U", 134), ("/t1", "T", 133), ("/t2", "T", 133)] and mcap.definitions_in(io.BytesIO(data)) == {"T": "int32 x", "U": "int8 y"}
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / f"x_{len(codec)}.mcap").write_bytes(data)
    assert mcap.definitions(spark, str(tmp_path)) == {"T": "int32 x", "U": "int8 y"}
    assert sorted((r.mcap_id, r.topic, r.n) for r in mcap.topic_counts(spark, str(tmp_path)).collect() if r.topic == "/t0") == [("0", "/t0", 134), ("3", "/t0", 134), ("4", "/t0", 134)]
    got = mcap.read_any(spark, str(tmp_path), 100, 103, ["/t0", "/t2"])
    assert sorted((r.bag, r.mcap_id, r.topic) for r in got.collect()) == [("b", n, t) for n in "034" for t in ("/t0", "/t2")]
    spark.dataSource.register(mcap.McapSource)
    df = spark.read.format("mcap").load(str(tmp_path))
    assert df.where("mcap_id = '3' and bag = 'b'").count() == 400 and df.where("mcap_id = '9'").count() == 0


HEADER = "std_msgs/Header header\n"
RULE = "\n" + "=" * 80 + "\n"
COMMON = RULE + "MSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id" + RULE + "MSG: builtin_interfaces/Time\nint32 sec\nuint32 nanosec"
GEOMETRY = COMMON + RULE + "MSG: geometry_msgs/Vector3\nfloat64 x\nfloat64 y\nfloat64 z" + RULE + "MSG: geometry_msgs/Point\nfloat64 x\nfloat64 y\nfloat64 z" + RULE + "MSG: geometry_msgs/Quaternion\nfloat64 x 0\nfloat64 y 0\nfloat64 z 0\nfloat64 w 1"
TYPES = {
    "sensor_msgs/msg/CompressedImage": HEADER + "string format # how\nuint8[] data" + COMMON,
    "sensor_msgs/msg/Image": HEADER + "uint32 height\nuint32 width\nstring encoding\nuint8 is_bigendian\nuint32 step\nuint8[] data" + COMMON,
    "sensor_msgs/msg/PointCloud2": HEADER + "uint32 height\nuint32 width\nPointField[] fields\nbool is_bigendian\nuint32 point_step\nuint32 row_step\nuint8[] data\nbool is_dense" + COMMON + RULE + "MSG: sensor_msgs/PointField\nuint8 INT8 = 1\nuint8 FLOAT32=7\nstring name\nuint32 offset\nuint8 datatype\nuint32 count",
    "sensor_msgs/msg/NavSatFix": HEADER + "NavSatStatus status\nfloat64 latitude\nfloat64 longitude\nfloat64 altitude\nfloat64[9] position_covariance\nuint8 position_covariance_type" + COMMON + RULE + "MSG: sensor_msgs/NavSatStatus\nint8 STATUS_FIX = 0\nint8 status\nuint16 service",
    "sensor_msgs/msg/Imu": HEADER + "geometry_msgs/Quaternion orientation\nfloat64[9] orientation_covariance\ngeometry_msgs/Vector3 angular_velocity\nfloat64[9] c2\ngeometry_msgs/Vector3 linear_acceleration\nfloat64[9] c3" + GEOMETRY,
    "nav_msgs/msg/Odometry": HEADER + "string child_frame_id\ngeometry_msgs/PoseWithCovariance pose\ngeometry_msgs/TwistWithCovariance twist" + GEOMETRY + RULE + "MSG: geometry_msgs/PoseWithCovariance\nPose pose\nfloat64[36] covariance" + RULE + "MSG: geometry_msgs/Pose\nPoint position\nQuaternion orientation" + RULE + "MSG: geometry_msgs/TwistWithCovariance\nTwist twist\nfloat64[36] covariance" + RULE + "MSG: geometry_msgs/Twist\nVector3 linear\nVector3 angular",
    "tf2_msgs/msg/TFMessage": "geometry_msgs/TransformStamped[] transforms" + GEOMETRY + RULE + "MSG: geometry_msgs/TransformStamped\n" + HEADER + "string child_frame_id\nTransform transform" + RULE + "MSG: geometry_msgs/Transform\nVector3 translation\nQuaternion rotation",
    "novatel_oem7_msgs/msg/BESTPOS": HEADER + "float64 lat\nfloat64 lon\nfloat64 hgt\nuint8[4] stn_id" + COMMON,
    "a_msgs/msg/Odd": "string<=10 name\nint16[] v\nstring[<=3] words\nbool yes\nbuiltin_interfaces/Duration d" + COMMON,
}


def written(order, values):
    """Bytes of (format, value) pairs, aligned from the fourth byte on; s: text, *B: bytes with their number."""
    import struct

    out = b"\0" + (b"\1" if order == "<" else b"\0") + b"\0\0"
    for f, v in values:
        size = 4 if f in ("s", "*B") else struct.calcsize(f)
        out += b"\0" * (-(len(out) - 4) % size) if f != "B" else b""
        if f == "s":
            out += struct.pack(order + "I", len(v.encode()) + 1) + v.encode() + b"\0"
        elif f == "*B":
            out += struct.pack(order + "I", len(v)) + v
        else:
            out += struct.pack(order + f, v)
    return out


def test_messages_are_decoded_by_their_definitions(spark, tmp_path):
    import base64
    import json
    import struct
    import zlib

    from logloom.functions import messages as m
    from logloom.operators import exports

    d = lambda *xs: [("d", float(x)) for x in xs]
    head = [("i", 7), ("I", 8), ("s", "map")]
    points = struct.pack("<fffI", 1, 2, 3, 0x010203) + struct.pack("<fffI", 0, 0, 0, 9)
    field = lambda n, o, t: [("s", n), ("I", o), ("B", t), ("I", 1)]
    cases = {
        "sensor_msgs/msg/CompressedImage": ([*head, ("s", "bgr8; png compressed"), ("*B", b"abc")], {"type": "image", "image": base64.b64encode(b"abc").decode(), "format": "png"}, ("png", b"abc")),
        "sensor_msgs/msg/Image": ([*head, ("I", 1), ("I", 2), ("s", "bgr8"), ("B", 0), ("I", 6), ("*B", bytes(range(6)))], {"type": "image", "image": base64.b64encode(bytes(range(6))).decode(), "format": "jpeg"}, None),
        "sensor_msgs/msg/PointCloud2": ([*head, ("I", 1), ("I", 2), ("I", 4), *field("x", 0, 7), *field("y", 4, 7), *field("z", 8, 7), *field("rgb", 12, 6), ("?", False), ("I", 16), ("I", 32), ("*B", points), ("?", True)], {"type": "pointCloud", "pointCloud": {"positions": [1.0, 2.0, 3.0], "colors": [1, 2, 3]}}, None),
        "sensor_msgs/msg/NavSatFix": ([*head, ("b", -1), ("H", 1), *d(51.5, 12.25, 100, *range(9)), ("B", 2)], {"type": "position", "position": {"latitude": 51.5, "longitude": 12.25, "altitude": 100.0}}, None),
        "sensor_msgs/msg/Imu": ([*head, *d(1, 2, 3, 4, *range(9), 5, 6, 7, *range(9), 8, 9, 10, *range(9))], {"type": "imu", "imu": {"orientation": {"x": 1.0, "y": 2.0, "z": 3.0, "w": 4.0}, "angular_velocity": {"x": 5.0, "y": 6.0, "z": 7.0}, "linear_acceleration": {"x": 8.0, "y": 9.0, "z": 10.0}}}, None),
        "nav_msgs/msg/Odometry": ([*head, ("s", "base"), *d(1, 2, 3, 4, 5, 6, 7, *range(36), 1, 2, 3, 4, 5, 6, *range(36))], None, None),
        "tf2_msgs/msg/TFMessage": ([("I", 1), *head, ("s", "kid"), *d(1, 2, 3, 4, 5, 6, 7)], {"type": "tf", "tf": {"translation": {"x": 1.0, "y": 2.0, "z": 3.0}, "rotation": {"x": 4.0, "y": 5.0, "z": 6.0, "w": 7.0}}}, None),
        "novatel_oem7_msgs/msg/BESTPOS": ([*head, *d(1, 2, 3), ("B", 1), ("B", 2), ("B", 3), ("B", 4)], {"type": "position", "position": {"latitude": 1.0, "longitude": 2.0, "altitude": 3.0}}, None),
        "a_msgs/msg/Odd": ([("s", "n"), ("I", 2), ("h", -1), ("h", 5), ("I", 1), ("s", "w"), ("?", True), ("i", 1), ("I", 2)], {"type": "text", "text": json.dumps({"name": "n", "v": [-1, 5], "words": ["w"], "yes": True, "d": {"sec": 1, "nanosec": 2}})}, None),
    }
    little = [(k, written("<", v[0])) for k, v in cases.items()]
    big = [(k, written(">", v[0])) for k, v in cases.items() if k != "sensor_msgs/msg/PointCloud2"]
    bad = [("sensor_msgs/msg/Imu", little[4][1][:50]), ("sensor_msgs/msg/Imu", None), ("unknown/msg/X", b"\0\1\0\0"), ("tf2_msgs/msg/TFMessage", written("<", [("I", 0)]))]
    rows = [("p", 0, f"/t{i}", k, i, i, i, None if x is None else bytearray(x)) for i, (k, x) in enumerate(little + big + bad)]
    df = spark.createDataFrame(rows, "name string, part_mcap int, topic string, msg_type string, log_time_ns long, publish_time_ns long, sequence long, data binary")
    got = df.select("log_time_ns", "msg_type", m.documents(F.col("data"), F.col("msg_type"), F.col("log_time_ns"), TYPES).alias("d")).orderBy("log_time_ns").collect()
    for r in got[: len(little) + len(big)]:
        want = cases[r.msg_type][1]
        assert want is None or json.loads(r.d) == want | {"timestamp": str(r.log_time_ns)}
        assert r.msg_type != "nav_msgs/msg/Odometry" or (json.loads(r.d)["odometry"]["twist"]["angular"], json.loads(r.d)["odometry"]["pose"]["covariance"][-1], json.loads(r.d)["odometry"]["header"]) == ({"x": 4.0, "y": 5.0, "z": 6.0}, 35.0, {"frame_id": "map", "stamp": {"sec": 7, "nanosec": 8}})
    assert [r.d for r in got[len(little) + len(big) :]] == [None] * 4

    files = exports.raw_files(df, TYPES)
    assert exports.write_files(files, str(tmp_path / "raw")) == len(little) + len(big)
    at = {p.stem: p for p in (tmp_path / "raw/p/0").glob("*/*")}
    assert at["0"].suffix == ".png" and at["0"].read_bytes() == b"abc" and at["2"].read_text().endswith("DATA ascii\n1.0 2.0 3.0 66051\n") and at["8"].suffix == ".txt"
    image = at["1"].read_bytes()
    assert image.startswith(b"\x89PNG") and zlib.decompress(image[image.index(b"IDAT") + 4 : -16]) == bytes([0, 2, 1, 0, 5, 4, 3])
    assert json.loads(at["7"].read_text()) == {"lat": 1.0, "lon": 2.0, "hgt": 3.0} and m.raw_file({"data": b"abc", "height": 2, "width": 2, "encoding": "rgb8"}, "sensor_msgs/msg/Image") == ("raw", b"abc")

    whole = df.where("data is not null")
    assert exports.write_files(exports.mcap_files(whole, TYPES), str(tmp_path / "bags")) == 1
    back = mcap.read_any(spark, str(tmp_path / "bags"))
    assert sorted((r.topic, r.log_time_ns, bytes(r.data)) for r in back.collect()) == sorted((r.topic, r.log_time_ns, bytes(r.data)) for r in whole.collect())
    assert {r.bag for r in back.collect()} == {"p"} and mcap.definitions(spark, str(tmp_path / "bags"))["sensor_msgs/msg/Imu"] == TYPES["sensor_msgs/msg/Imu"]


def test_polygon_files(tmp_path):
    import pytest

    from logloom.sources import polygons

    folder, doc = str(tmp_path / "p"), {"type": "FeatureCollection", "features": []}
    assert polygons.save(folder, "../My area (1)!", doc) == "My area 1.json" and polygons.names(folder) == ["My area 1.json"]
    for bad in ("", "../", "!?"):
        with pytest.raises(ValueError):
            polygons.save(folder, bad, doc)
    with pytest.raises(ValueError):
        polygons.save(folder, "x", {"type": "Feature"})
    for bad in ("../x.json", "x", "a/b.json"):
        with pytest.raises(ValueError):
            polygons.delete(folder, bad)
    polygons.delete(folder, "My area 1.json")
    assert polygons.names(folder) == []


def test_progress_and_cancellation(spark):
    import threading
    import time

    from logloom.plans import jobs

    df, seen = jobs.counted(spark.range(100).where("id % 2 = 0"), "even")
    assert len(df.collect()) == 50 and seen.get == {"rows": 50}
    ended = []

    def work():
        with jobs.tagged(spark, "slow"):
            try:
                spark.range(10**13).selectExpr("sum(hash(id))").collect()
                ended.append("done")
            except Exception:  # noqa: BLE001
                ended.append("cancelled")

    t = threading.Thread(target=work)
    t.start()
    for _ in range(60):
        time.sleep(0.5)
        jobs.cancel(spark, "slow")  # again, as a job may begin after the first time
        if not t.is_alive():
            break
    t.join(1)
    assert ended == ["cancelled"]


def long_recording(folder, name, chunks=40, rows=50, overlap=0):
    """Chunks of rows messages each; with overlap, every fourth chunk also has times of the one before."""
    from logloom.sources import mcap

    folder.mkdir(parents=True, exist_ok=True)
    every = [(f"/t{i % 3}", "pkg/msg/T", (i - (overlap if i // rows % 4 == 1 else 0)) * 10, i, i, bytes(100)) for i in range(chunks * rows)]
    (folder / name).write_bytes(mcap.encode(every, codec="", chunk_size=rows * (9 + 22 + 100)))
    return every


def test_one_recording_gives_many_tasks(spark, tmp_path):
    from logloom.sources import mcap

    spark.dataSource.register(mcap.McapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    every = long_recording(tmp_path / "bag", "bag_7.mcap", overlap=30)
    size = (tmp_path / "bag" / "bag_7.mcap").stat().st_size
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/bag/bag_7.mcap"):
        df = spark.read.format("mcap").option("partitionBytes", size // 8).load(path)
        assert 7 <= df.rdd.getNumPartitions() <= 12
        assert sorted((r.topic, r.log_time_ns, r.sequence) for r in df.collect()) == sorted((t, ts, n) for t, _, ts, _, n, _ in every)
    some = spark.read.format("mcap").option("partitionBytes", size // 8).load(str(tmp_path)).where("log_time_ns >= 5000 and log_time_ns < 5300 and topic = '/t1'")
    assert some.rdd.getNumPartitions() <= 2 and sorted(r.sequence for r in some.collect()) == sorted(n for t, _, ts, _, n, _ in every if 5000 <= ts < 5300 and t == "/t1")
    ordered = spark.read.format("mcap").option("partitionBytes", size // 8).option("order", "time").load(str(tmp_path))
    parts = [[r.log_time_ns for r in p] for p in ordered.select("log_time_ns").rdd.glom().collect()]
    assert len(parts) > 3 and all(p == sorted(p) for p in parts) and [x for p in parts for x in p] == sorted(ts for _, _, ts, *_ in every)


def test_counts_read_only_the_end_of_a_file(spark, tmp_path):
    from logloom.sources import mcap

    long_recording(tmp_path / "bag", "bag_7.mcap", chunks=400)

    class Counted(io.BytesIO):
        taken = 0

        def read(self, *n):
            out = super().read(*n)
            self.taken += len(out)
            return out

    data = (tmp_path / "bag" / "bag_7.mcap").read_bytes()
    f = Counted(data)
    assert sum(n for *_, n in mcap.counts_in(f)) == 20_000 and f.taken < 200_000 < 2_000_000 < len(data)
    got = {(r.bag, r.mcap_id, r.topic): r.n for r in mcap.topic_counts(spark, str(tmp_path)).collect()}
    assert got == {("bag", "7", f"/t{i}"): n for i, n in enumerate((6667, 6667, 6666))}


def test_stream_of_recordings_with_restarts(spark, tmp_path):
    """Each message once, over restarts, new files, and a file that is still being written."""
    from logloom.sources import mcap

    spark.dataSource.register(mcap.McapSource)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        q = spark.readStream.format("mcap").option("partitionBytes", 20_000).load(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.bag, r.mcap_id, r.sequence) for r in spark.read.parquet(out).collect())

    first = [("a", "0", r[4]) for r in long_recording(tmp_path / "in" / "a", "a_0.mcap", chunks=6)]
    assert run() == first
    assert run() == first
    long_recording(tmp_path / "b", "b_1.mcap", chunks=6)
    whole = (tmp_path / "b" / "b_1.mcap").read_bytes()
    chunks = mcap.written_chunks(io.BytesIO(whole))
    assert len(chunks) == 6
    (tmp_path / "in" / "b").mkdir()
    cut = chunks[3][0] + 20  # three whole chunks and a piece of the fourth
    (tmp_path / "in" / "b" / "b_1.mcap").write_bytes(whole[:cut])
    part = run()
    assert part == sorted(first + [("b", "1", n) for n in range(150)])
    (tmp_path / "in" / "b" / "b_1.mcap").write_bytes(whole)
    assert run() == sorted(first + [("b", "1", n) for n in range(300)])


def test_a_late_file_reads_its_own_segment_alone(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "bag string, mcap_id string, topic string, log_time_ns long, sequence long"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        ingest.ingest(spark, source, schema, target, state).awaitTermination(120)
        return {(r.bag, str(r.mcap_id)): r["count"] for r in spark.read.parquet(f"{target}/summary").collect()}

    add([("a", "0", "x", i, i) for i in range(5)])
    add([("a", "1", "x", i, i) for i in range(7)])
    assert run() == {("a", "0"): 5, ("a", "1"): 7}
    import os

    (other,) = {r.file for r in spark.read.parquet(f"{target}/files").where("mcap_id = '1'").collect()} - {r.file for r in spark.read.parquet(f"{target}/files").where("mcap_id = '0'").collect()}
    os.truncate("/" + other.removeprefix("file:").lstrip("/"), 3)  # reading it again would fail
    add([("a", "0", "x", 9, 9)])
    assert run() == {("a", "0"): 6, ("a", "1"): 7}


def test_live_segments_close_after_a_pause(spark, tmp_path):
    source = str(tmp_path / "in")
    second = 1_000_000_000
    for rows in ([("a", "x", t * second) for t in (0, 10, 20, 100, 110)] + [("b", "x", 5 * second)], [("a", "y", 30 * second), ("a", "x", 130 * second)], [("c", "x", 1000 * second)]):
        spark.createDataFrame(rows, "bag string, topic string, log_time_ns long").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.live_segments(spark.readStream.schema("bag string, topic string, log_time_ns long").parquet(source), late="2 minutes")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.bag, r["count"], r.first_ts // second, r.last_ts // second, r.topics) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 3, 100, 130, 1), ("a", 4, 0, 30, 2), ("b", 1, 5, 5, 1)]


def test_bad_messages_stop_nothing(spark):
    """Point clouds with fields beyond a point, of unknown kinds, cut off; a good one beside them."""
    import struct

    from logloom.functions import messages as decoding

    text = "std_msgs/Header header\nuint32 height\nuint32 width\nsensor_msgs/PointField[] fields\nbool is_bigendian\nuint32 point_step\nuint32 row_step\nuint8[] data\nbool is_dense\n" + "=" * 80 + "\nMSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n" + "=" * 80 + "\nMSG: sensor_msgs/PointField\nstring name\nuint32 offset\nuint8 datatype\nuint32 count\n"

    def cloud(offset, kind):
        out = bytearray(struct.pack("<iI", 1, 2))
        pad = lambda n: out.extend(bytes(-len(out) % n))

        def string(s):
            pad(4)
            out.extend(struct.pack("<I", len(s) + 1) + s.encode() + b"\0")

        string("map")
        pad(4)
        out.extend(struct.pack("<III", 1, 1, 3))
        for name, at, k in (("x", 0, 7), ("y", 4, 7), ("z", offset, kind)):
            string(name)
            pad(4)
            out.extend(struct.pack("<IB", at, k))
            pad(4)
            out.extend(struct.pack("<I", 1))
        out.extend(b"\0")
        pad(4)
        out.extend(struct.pack("<III", 12, 12, 12) + struct.pack("<fff", 1, 2, 3) + b"\1")
        return b"\0\1\0\0" + bytes(out)

    kind = "sensor_msgs/msg/PointCloud2"
    rows = [(0, cloud(8, 7)), (1, cloud(10, 7)), (2, cloud(8, 9)), (3, cloud(8, 7)[:60]), (4, b""), (5, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, kind) for i, b in rows], "i int, data binary, msg_type string")
    defs = {kind: text}
    got = df.select("i", decoding.documents(F.col("data"), F.col("msg_type"), F.lit(7), defs).alias("d"), decoding.raw_files(F.col("data"), F.col("msg_type"), defs)["content"].alias("c"), decoding.is_bad(F.col("data"), F.col("msg_type"), defs).alias("bad")).collect()
    assert [(r.i, r.d is not None, r.c is not None, r.bad) for r in sorted(got)] == [(0, True, True, False)] + [(i, False, False, i < 5) for i in range(1, 6)]


def test_several_writers_of_one_table(spark, tmp_path):
    """Writers at once lose nothing; one that dies before its last step changes nothing, and what it left goes."""
    from concurrent.futures import ThreadPoolExecutor

    from logloom.sources import snapshots

    root = str(tmp_path / "table")
    rows = lambda bag, n: spark.createDataFrame([(bag, str(i % 2), n) for i in range(4)], "bag string, mcap_id string, n int")
    state = lambda: {(r.bag, r.mcap_id): (r.n, r.c) for r in snapshots.read(spark, root).groupBy("bag", "mcap_id", "n").agg(F.count("*").alias("c")).collect()}
    snapshots.upsert(rows("a b/ü", 0), root, ["bag", "mcap_id"])
    assert state() == {("a b/ü", "0"): (0, 2), ("a b/ü", "1"): (0, 2)}
    staged = [snapshots.stage(rows(f"b{k}", k), root, ["bag", "mcap_id"]) for k in range(6)]
    schema = rows("x", 0).schema
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda m: snapshots.commit(spark, root, schema, m), staged))
    assert sorted(numbers) == list(range(2, 8)) and len(state()) == 14
    before, reader = state(), snapshots.read(spark, root)
    snapshots.stage(rows("b1", 99), root, ["bag", "mcap_id"])  # dies here
    assert state() == before
    snapshots.upsert(rows("b1", 7).where("mcap_id = '0'"), root, ["bag", "mcap_id"])
    assert state() == before | {("b1", "0"): (7, 2)}
    assert {r.n for r in reader.where("bag = 'b1'").collect()} == {1}  # a reader goes on in the state that it began with
    kept = len(list((tmp_path / "table" / "data").iterdir()))
    assert snapshots.clean(spark, root, 3600) == 0 and snapshots.clean(spark, root, -1) >= 8
    assert len(list((tmp_path / "table" / "data").iterdir())) == kept - 1 and state() == before | {("b1", "0"): (7, 2)}
