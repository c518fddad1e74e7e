"""Names of bags, topics, models, files and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bag_key(path: Column) -> Column:
    """`X_multi_parts/Part_N` of a path to a part of a bag, else the last part of the path."""
    part = F.regexp_extract(path, r"([^/]*_multi_parts/[^/]+)/?$", 1)
    return F.when(part != "", part).otherwise(F.regexp_extract(path, r"([^/]*)/?$", 1))


def base_bag(name: Column) -> Column:
    """A bag's name without `_multi_parts` and what follows."""
    return F.substring_index(name, "_multi_parts", 1)


def part_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"Part_(\d+)", 1), F.lit("")).try_cast("int")


#: Fixed value: what a bag with a time in its name is called.
BAG_TIME = r"^rosbag2_(\d{4})_(\d{2})_(\d{2})-(\d{2})_(\d{2})_(\d{2})(?:_short)?$"


def bag_time(name: Column) -> Column:
    """The time in `rosbag2_YYYY_MM_DD-hh_mm_ss`, with `_short` behind it or not, of a bag's base name or else the last part of
    a path; null for any other name. Months, days and times past their ends count on from there."""
    text = F.trim(name)
    leaf = F.when(text.contains("_multi_parts"), F.substring_index(text, "_multi_parts", 1)).when(text.contains("/Part_"), F.substring_index(text, "/Part_", 1)).otherwise(F.substring_index(text, "/", -1))
    y, mo, d, h, mi, s = (F.nullif(F.regexp_extract(leaf, BAG_TIME, i), F.lit("")).try_cast("int") for i in range(1, 7))
    zero = F.lit(0)
    begin = F.make_timestamp_ntz(F.when(y < 100, y + 1900).otherwise(y), F.lit(1), F.lit(1), zero, zero, zero)
    return begin + F.make_ym_interval(zero, mo - 1) + F.make_dt_interval(d - 1, h, mi, s.cast("decimal(18,6)"))


def topic_folder(topic: Column) -> Column:
    return F.replace(topic, F.lit("/"), F.lit("__"))


def folder_topic(folder: Column) -> Column:
    return F.replace(folder, F.lit("__"), F.lit("/"))


def topic_file(topic: Column) -> Column:
    """As raw exports name a topic's folder."""
    return F.ltrim(F.replace(topic, F.lit("/"), F.lit("_")), F.lit("_"))


def mcap_id(file: Column, default: str | None = None) -> Column:
    """The number behind the last underscore of `..._N.mcap`."""
    found = F.nullif(F.regexp_extract(file, r"_(\d+)\.mcap$", 1), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def id_number(value: Column) -> Column:
    """An id as a number, null if it is none: sorts numeric ids first with asc_nulls_last()."""
    return value.try_cast("int")


def model_parts(model: Column) -> tuple[Column, Column]:
    """`arch__pretrained`, split at the first `__`."""
    parts = F.split(model, "__", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def sanitised(name: Column, spaces: bool = False) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\- ]" if spaces else r"[^a-zA-Z0-9_\-]", "_")


def is_valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_\-]+$"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    return F.coalesce(~path.contains("..") & ~path.startswith("/") & (path != ""), F.lit(False))


def csv_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def image_extension(fmt: Column) -> Column:
    low = F.lower(F.coalesce(fmt, F.lit("")))
    return F.when(low.contains("png"), "png").otherwise("jpg")


def hue(text: Column) -> Column:
    """A stable hue of 0 to 359 for a name, from a hash of its UTF-16 units: 32 times the last value, wrapped to 32 bits,
    less that value, plus the unit."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    wrapped = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    value = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: u + wrapped(h * 32) - h)
    return (F.abs(value) % 360).cast("int")


def transform_summary(text: Column) -> Column:
    """`resize{N}_crop{N}_tensor_norm` of a printed image transform, with what it lacks left out; `default` for nothing."""
    size = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    parts = [F.concat(F.lit("resize"), size(r"Resize\(size=(\d+)")), F.concat(F.lit("crop"), size(r"CenterCrop\(size=\(?(\d+)"))]
    parts += [F.when(text.contains(word), short) for word, short in (("ToTensor", "tensor"), ("Normalize", "norm"))]
    return F.coalesce(F.nullif(F.concat_ws("_", *parts), F.lit("")), F.lit("default"))
