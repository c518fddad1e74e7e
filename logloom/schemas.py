"""Schemas of the tables that the operators pass on."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    names = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType(), "floats": T.ArrayType(T.FloatType()), "rings": T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))}
    return T.StructType([T.StructField(n, names[t]) for n, t in (f.split(":") for f in text.split())])


MESSAGES = _schema("bag:string mcap_id:string topic:string msg_type:string log_time_ns:long publish_time_ns:long sequence:long data:binary")
MANIFEST = _schema("model:string bag:string id:long topic:string timestamp_ns:long minute_of_day:int mcap_identifier:string reference_timestamp:string reference_timestamp_index:long shard_id:string row_in_shard:int embedding:floats")
ALIGNED = _schema("bag:string mcap_id:string ref_idx:long ref_ts:long topic:string topic_ts:long")
SUMMARY = _schema("bag:string mcap_id:string start_index:long count:long first_ts:long last_ts:long")
GRID = _schema("bag:string mcap_id:string lat_idx:long lon_idx:long cnt:long")
BOUNDARY = _schema("bag:string hull:rings min_lat:double min_lon:double max_lat:double max_lon:double")
TOPICS = _schema("bag:string topic:string msg_type:string")
ADJACENT = _schema("model:string bag:string topic:string seq:long ts:long next_ts:long similarity:double")
LEDGER = _schema("processor:string model:string bag:string mcap:string topic:string status:string completed_at:long")
