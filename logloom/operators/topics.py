"""Topics, bags and segments: classes, priorities, availability, dictionaries and joins on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

IMAGE_TYPES = ["sensor_msgs/msg/CompressedImage", "sensor_msgs/msg/Image"]
# The order of cameras, by two words in a topic's name; words of image, point cloud and position topics and types.
CAMERAS = [("side", "left"), ("side", "right"), ("rear", "left"), ("rear", "mid"), ("rear", "right")]
IMAGE_WORDS = ["image", "camera", "rgb", "color"]
CLOUD_WORDS = ["pointcloud", "point_cloud", "lidar", "pcl"]
POSITION_WORDS = ["gps", "gnss", "navsat", "tf", "odom", "pose", "position"]
CLOUD_TYPE_WORDS = ["pointcloud", "point_cloud"]
POSITION_TYPE_WORDS = ["navsatfix", "gps", "gnss", "tf", "odom", "pose"]


def is_image_name(topic: Column) -> Column:
    return F.lower(topic).contains("image") | F.lower(topic).contains("camera")


def is_image_type(msg_type: Column) -> Column:
    return msg_type.isin(IMAGE_TYPES)


def is_position(topic: Column) -> Column:
    return F.lower(topic).contains("bestpos")


def has_word(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def priority(topic: Column, msg_type: Column | None = None) -> Column:
    """Stereo images 0, images 1, point clouds 2, positions 3, the rest 4: by the type where there is one, else by the name."""
    name = F.lower(topic)
    image, cloud, place = has_word(name, IMAGE_WORDS), has_word(name, CLOUD_WORDS), has_word(name, POSITION_WORDS)
    if msg_type is not None:
        kind = F.lower(msg_type)
        typed = F.coalesce(kind, F.lit("")) != ""
        image = F.when(typed, kind.contains("sensor_msgs") & kind.contains("image")).otherwise(image)
        cloud = F.when(typed, has_word(kind, CLOUD_TYPE_WORDS)).otherwise(cloud)
        place = F.when(typed, has_word(kind, POSITION_TYPE_WORDS)).otherwise(place)
    return F.when(image & name.contains("zed"), 0).when(image, 1).when(cloud, 2).when(place, 3).otherwise(4)


def camera_place(topic: Column) -> Column:
    """The first pair of CAMERAS whose words the name has, else their number."""
    name, out = F.lower(topic), F.lit(len(CAMERAS))
    for i, (a, b) in reversed(list(enumerate(CAMERAS))):
        out = F.when(name.contains(a) & name.contains(b), i).otherwise(out)
    return out


def sorted_topics(topics: DataFrame) -> DataFrame:
    """With `priority` and `position`, from 1, by priority, by camera for images, and by name within a bag, as a language's
    alphabet has it; topics have the types of a column msg_type if there is one."""
    rank = priority(F.col("topic"), F.col("msg_type") if "msg_type" in topics.columns else None)
    camera = F.when(F.col("priority") <= 1, camera_place(F.col("topic"))).otherwise(0)
    w = W.partitionBy("bag").orderBy("priority", camera, F.collate(F.lower("topic"), "UNICODE"), "topic")
    return topics.withColumn("priority", rank).withColumn("position", F.row_number().over(w))


def sorted_bags(bags: DataFrame, name: str = "bag") -> DataFrame:
    """By the time in the name; names without one last, by name."""
    return bags.orderBy(names.bag_time(F.col(name)).asc_nulls_last(), name)


def numeric_first(df: DataFrame, by: list[str], name: str = "mcap_id") -> DataFrame:
    """position: from 1, numbers in their order before other ids."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(F.col(name).try_cast("int").asc_nulls_last(), F.col(name))))


def bags_with_topics(topics: DataFrame, chosen: list[str]) -> DataFrame:
    """(bag) that have at least one of the chosen topics; all if none is chosen."""
    held = topics.where(F.col("topic").isin(chosen)) if chosen else topics
    return held.select("bag").distinct()


def bags_named(bags: DataFrame, wanted: DataFrame) -> DataFrame:
    """bags whose normalised name is among the wanted ones'."""
    own = bags.withColumn("_k", names.bag_key(F.col("bag")))
    return own.join(wanted.select(names.bag_key(F.col("bag")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def missing_topics(present: DataFrame, expected: DataFrame) -> DataFrame:
    """(bag, mcap_id, topic) that a segment of the bag lacks."""
    return present.select("bag", "mcap_id").distinct().join(expected.select("bag", "topic").distinct(), "bag").join(present.select("bag", "mcap_id", "topic").distinct(), ["bag", "mcap_id", "topic"], "left_anti").select("bag", "mcap_id", "topic")


def topic_dictionary(topics: DataFrame, last_wins: bool = True) -> DataFrame:
    """(topic, msg_type) over all bags in their order."""
    pick = F.max_by if last_wins else F.min_by
    return topics.groupBy("topic").agg(pick("msg_type", "bag").alias("msg_type"))


def with_summaries(bags: DataFrame, totals: DataFrame) -> DataFrame:
    """Every bag with total_count (0 if unknown) and its first and last times (null)."""
    return bags.join(totals.select("bag", "total_count", "first_ts", "last_ts"), "bag", "left").withColumn("total_count", F.coalesce("total_count", F.lit(0)).cast("long"))


def messages_per_topic(messages: DataFrame) -> DataFrame:
    """Counts by segment and topic, by topic, and of all: one pass with level 0, 2 and 3."""
    return messages.rollup("topic", "mcap_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def distinct_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values"), F.countDistinct(value).alias("n"))


def topics_as_map(document: Column) -> Column:
    """A topics document's map of types; the older form, a list of names, has empty types."""
    as_map = F.from_json(F.get_json_object(document, "$.topics"), "map<string,string>")
    as_list = F.map_from_entries(F.transform(F.from_json(F.get_json_object(document, "$.topics"), "array<string>"), lambda t: F.struct(t, F.lit(""))))
    return F.when(F.get_json_object(document, "$.topics").startswith("["), as_list).otherwise(as_map)
