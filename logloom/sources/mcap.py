"""MCAP files as a Spark data source, batch and stream; times, topics, bags and segments are filtered while reading.

Follows the public MCAP specification. Chunks may be plain or compressed with zstd or lz4. Where a file ends in an index of
its chunks, only those are read that overlap the times asked for and hold a topic asked for, and they are dealt to input partitions of
about `partitionBytes`, so one large file gives many tasks; without an index, or in a file that was cut off, one task reads all
records up to the cut. Only byte ranges are read: the last part of a file for planning, counts and definitions, and then its
chunks. Records of unknown kinds are skipped. Messages come in the order of the file; with option("order", "time"), a
partition's messages come in the order of time, partitions of a file don't overlap in time, and chunks that do are merged.

Paths may be local or name a store that pyarrow opens (file:, hdfs:, s3: and s3a:, gs:, abfs:); read_any() takes whole files from any
other store that Spark lists.

The stream, spark.readStream.format("mcap"), has offsets of (file, chunk): each trigger gives the chunks that came since,
also those of a file that is still being written, each once. A file whose last change lies more than `maxFileAge` seconds before the newest one's
counts as done, which bounds the offsets.
"""

from __future__ import annotations

import heapq
import io
import re
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, METADATA, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15
COLUMNS = "bag string, mcap_id string, topic string, msg_type string, log_time_ns long, publish_time_ns long, sequence long, data binary"
FOREVER = 2**63


#: Bytes of chunks in one input partition; the end of a file that is read first; seconds after which a file counts as done; footers read at once.
PART, TAIL, AGE, THREADS = 1 << 26, 1 << 12, 7 * 86_400, 16


def store_of(path: str) -> tuple[object, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if not re.match(r"[a-z0-9]+:/", path):
        return fs.LocalFileSystem(), path
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> io.BufferedIOBase:
    """A file for reads of byte ranges."""
    store, at = store_of(path)
    return store.open_input_file(at)


def listed(path: str) -> list[tuple[str, int, float]]:
    """(path, bytes, seconds of the last change) of the recordings below a folder, or of one file, in the order of names."""
    from pyarrow import fs

    store, at = store_of(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    return sorted((prefix + f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.is_file and (f is info or f.path.endswith(".mcap")))


def records(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    while len(head := f.read(9)) == 9:
        size = struct.unpack_from("<Q", head, 1)[0]
        body = f.read(size)
        if len(body) < size:
            return
        yield head[0], body


def text(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


def unpacked(chunk: bytes) -> bytes:
    """The records of a chunk's body."""
    size = struct.unpack_from("<Q", chunk, 16)[0]
    codec, at = text(chunk, 28)
    data = chunk[at + 8 : at + 8 + struct.unpack_from("<Q", chunk, at)[0]]
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if codec == "lz4":
        return pa.decompress(data, decompressed_size=size, codec="lz4").to_pybytes() if size else b""
    if codec:
        raise ValueError(f"chunks compressed with {codec} can't be read")
    return data


def summary(f: io.BufferedIOBase) -> list[tuple[int, bytes]] | None:
    """The records behind a file's messages; None where it has none or was cut off. Reads the file's end, once if that
    holds all of them."""
    f.seek(0, 2)
    end = f.tell()
    if end < 8 + 9 + 20 + 8:
        return None
    f.seek(max(0, end - TAIL))
    tail = f.read()
    foot = tail[-37:]
    if foot[29:] != MAGIC or foot[0] != FOOTER or not (start := struct.unpack_from("<Q", foot, 9)[0]):
        return None
    if start < end - len(tail):
        f.seek(start)
        tail = f.read(end - start)
    return list(records(io.BytesIO(tail[start - end : -8])))


class Names:
    """Schemas and channels as they come."""

    def __init__(self) -> None:
        self.schemas: dict[int, tuple[str, str, str]] = {0: ("", "", "")}
        self.channels: dict[int, tuple[str, str]] = {}

    def take(self, kind: int, body: bytes) -> None:
        if kind == SCHEMA:
            name, at = text(body, 2)
            encoding, at = text(body, at)
            self.schemas[struct.unpack_from("<H", body)[0]] = (name, encoding, text(body, at)[0])
        elif kind == CHANNEL:
            number, schema = struct.unpack_from("<HH", body)
            self.channels[number] = (text(body, 4)[0], self.schemas.get(schema, ("", "", ""))[0])


def wanted_chunks(ends: list[tuple[int, bytes]], names: Names, start: int, end: int, topics: set[str] | None) -> list[tuple[int, int, int, int]] | None:
    """(offset, length, first time, last time) of the chunks to read; None if the summary has no index of chunks or names no
    channels."""
    index = [b for k, b in ends if k == CHUNK_INDEX]
    if not index or not names.channels:
        return None
    out = []
    for body in index:
        first, last, offset, length, width = struct.unpack_from("<QQQQI", body)
        held = {struct.unpack_from("<H", body, 36 + i)[0] for i in range(0, width, 10)}
        if first < end and last >= start and (topics is None or not held or any(names.channels.get(c, ("",))[0] in topics for c in held)):
            out.append((offset, length, first, last))
    return sorted(out)


def written_chunks(f: io.BufferedIOBase) -> list[tuple[int, int]]:
    """(offset, length) of the whole chunks of a file without an index, by stepping from record to record."""
    out, at = [], 8
    f.seek(0, 2)
    end = f.tell()
    while at + 9 <= end:
        f.seek(at)
        kind, size = struct.unpack("<BQ", f.read(9))
        if at + 9 + size > end or kind == DATA_END:
            break
        if kind == CHUNK:
            out.append((at, 9 + size))
        at += 9 + size
    return out


def in_chunks(f: io.BufferedIOBase, names: Names, chunks: list[tuple[int, ...]], start: int, end: int, topics: set[str] | None, by_time: bool = False) -> Iterator[tuple]:
    """The messages of some chunks, in their order or merged by time."""

    def one(offset: int, length: int) -> Iterator[tuple]:
        f.seek(offset)
        yield from decoded_records(records(io.BytesIO(f.read(length))), names, start, end, topics)

    if not by_time:
        for c in chunks:
            yield from one(*c[:2])
        return
    for group in overlapping(chunks):
        yield from heapq.merge(*(sorted(one(*c[:2]), key=lambda m: m[2]) for c in group), key=lambda m: m[2])


def overlapping(chunks: list[tuple[int, ...]]) -> Iterator[list[tuple[int, ...]]]:
    """Chunks (offset, length, first, last) in the order of time, in groups that don't overlap."""
    group: list[tuple[int, ...]] = []
    for c in sorted(chunks, key=lambda c: (c[2], c[0])):
        if group and c[2] > max(g[3] for g in group):
            yield group
            group = []
        group.append(c)
    if group:
        yield group


def decoded_records(source: Iterable[tuple[int, bytes]], names: Names, start: int, end: int, topics: set[str] | None) -> Iterator[tuple]:
    for kind, body in source:
        if kind == MESSAGE:
            number, sequence, log, publish = struct.unpack_from("<HIQQ", body)
            topic, msg_type = names.channels.get(number, ("", ""))
            if start <= log < end and (topics is None or topic in topics):
                yield topic, msg_type, log, publish, sequence, body[22:]
        elif kind == CHUNK:
            yield from decoded_records(records(io.BytesIO(unpacked(body))), names, start, end, topics)
        elif kind in (FOOTER, DATA_END):
            return
        else:
            names.take(kind, body)


def messages(f: io.BufferedIOBase, start: int = 0, end: int = FOREVER, topics: set[str] | None = None) -> Iterator[tuple]:
    """(topic, msg_type, log_time, publish_time, sequence, data) with start <= log_time < end."""
    if f.read(8) != MAGIC:
        raise ValueError("not an MCAP file")
    names = Names()
    if f.seekable() and (start > 0 or end < FOREVER or topics is not None) and (ends := summary(f)):
        for kind, body in ends:
            names.take(kind, body)
        if (chunks := wanted_chunks(ends, names, start, end, topics)) is not None:
            yield from in_chunks(f, names, chunks, start, end, topics)
            return
    if f.seekable():
        f.seek(8)
    yield from decoded_records(records(f), names, start, end, topics)


def definitions_in(f: io.BufferedIOBase) -> dict[str, str]:
    """The text of every message type of a file, from its summary or else from all of it."""
    names = Names()
    for kind, body in summary(f) or ():
        names.take(kind, body)
    if len(names.schemas) == 1:
        f.seek(8)
        for kind, body in records(f):
            for k, b in records(io.BytesIO(unpacked(body))) if kind == CHUNK else [(kind, body)]:
                names.take(k, b)
    return {name: definition for name, _, definition in names.schemas.values() if name}


def counts_in(f: io.BufferedIOBase) -> list[tuple[str, str, int]] | None:
    """(topic, msg_type, messages) from a file's statistics, without its messages; None where it has none."""
    names, counts = Names(), None
    for kind, body in summary(f) or ():
        names.take(kind, body)
        if kind == STATISTICS:
            width = struct.unpack_from("<I", body, 42)[0]
            counts = dict(struct.unpack_from("<HQ", body, 46 + i) for i in range(0, width, 10))
    return None if counts is None else [(*names.channels[c], n) for c, n in sorted(counts.items()) if c in names.channels]


def encode(rows: Iterable[tuple], definitions: dict[str, str] | None = None, metadata: dict[str, dict[str, str]] | None = None, codec: str = "zstd", chunk_size: int = 1 << 22) -> bytes:
    """A file of (topic, msg_type, log_time, publish_time, sequence, data): chunks of about chunk_size bytes, metadata, and a
    summary of schemas, channels, statistics and the index of chunks. codec: zstd, lz4 or none, an empty text."""
    import zstandard

    pack = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    record = lambda kind, body: struct.pack("<BQ", kind, len(body)) + body
    pairs = lambda d: (lambda b: struct.pack("<I", len(b)) + b)(b"".join(pack(k) + pack(str(v)) for k, v in d.items()))
    out = io.BytesIO(MAGIC + record(HEADER, pack("ros2") + pack("")))
    out.seek(0, 2)
    names, channels, schemas, chunks, counts, span = [], {}, {}, [], {}, []
    part, held, times = [], set(), []

    def close() -> None:
        if not part:
            return
        raw = b"".join(part)
        packed = zstandard.ZstdCompressor().compress(raw) if codec == "zstd" else pa.compress(raw, codec="lz4", asbytes=True) if codec == "lz4" else raw
        body = struct.pack("<QQQI", min(times, default=0), max(times, default=0), len(raw), 0) + pack(codec) + struct.pack("<Q", len(packed)) + packed
        at = out.tell()
        out.write(record(CHUNK, body))
        offsets = b"".join(struct.pack("<HQ", c, 0) for c in sorted(held))
        chunks.append(struct.pack("<QQQQI", min(times, default=0), max(times, default=0), at, out.tell() - at, len(offsets)) + offsets + struct.pack("<Q", 0) + pack(codec) + struct.pack("<QQ", len(packed), len(raw)))
        span.extend((min(times, default=0), max(times, default=0)))
        part.clear(), held.clear(), times.clear()

    size = 0
    for topic, msg_type, log, publish, sequence, data in rows:
        if (topic, msg_type) not in channels:
            if msg_type not in schemas:
                schemas[msg_type] = len(schemas) + 1
                names.append(record(SCHEMA, struct.pack("<H", schemas[msg_type]) + pack(msg_type) + pack("ros2msg") + pack((definitions or {}).get(msg_type, ""))))
                part.append(names[-1])
            channels[topic, msg_type] = n = len(channels) + 1
            names.append(record(CHANNEL, struct.pack("<HH", n, schemas[msg_type]) + pack(topic) + pack("cdr") + struct.pack("<I", 0)))
            part.append(names[-1])
        number = channels[topic, msg_type]
        part.append(record(MESSAGE, struct.pack("<HIQQ", number, int(sequence), int(log), int(publish)) + bytes(data)))
        counts[number] = counts.get(number, 0) + 1
        held.add(number), times.append(int(log))
        size += len(part[-1])
        if size >= chunk_size:
            close()
            size = 0
    close()
    for name, values in (metadata or {}).items():
        out.write(record(METADATA, pack(name) + pairs(values)))
    out.write(record(DATA_END, bytes(4)))
    start = out.tell()
    total = b"".join(struct.pack("<HQ", c, n) for c, n in sorted(counts.items()))
    statistics = struct.pack("<QHIIIIQQ", sum(counts.values()), len(schemas), len(channels), 0, len(metadata or {}), len(chunks), min(span, default=0), max(span, default=0)) + struct.pack("<I", len(total)) + total
    out.write(b"".join(names) + record(STATISTICS, statistics) + b"".join(record(CHUNK_INDEX, c) for c in chunks))
    out.write(record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC)
    return out.getvalue()


def named(path: str) -> tuple[str, str | None]:
    """The bag and segment that a file's path names."""
    folder, _, name = path.rpartition("/")
    parts = folder.rsplit("/", 2)
    found = re.search(r"_(\d+)\.mcap$", name)
    return "/".join(parts[-2:]) if len(parts) > 1 and parts[-2].endswith("_multi_parts") else parts[-1], found[1] if found else None


def _found(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mcap").load(root).select("path", *columns)


def read_any(spark: SparkSession, root: str, start: int = 0, end: int = FOREVER, topics: list[str] | None = None) -> DataFrame:
    """The source's rows from any store that Spark reads; each file comes whole into memory."""
    wanted = set(topics) if topics else None

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(*named(path), *m) for m in messages(io.BytesIO(content), start, end, wanted)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return _found(spark, root, "content").mapInPandas(read, COLUMNS)


def topic_counts(spark: SparkSession, root: str) -> DataFrame:
    """(bag, mcap_id, topic, msg_type, n) from the statistics at the files' ends, and from the messages of files without."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path in pdf["path"]:
                with opened(path) as f:
                    found = counts_in(f)
                    if found is None:
                        f.seek(0)
                        every = pd.DataFrame([m[:2] for m in messages(f)], columns=["topic", "msg_type"])
                        found = [(*k, n) for k, n in every.value_counts().items()]
                yield pd.DataFrame([(*named(path), *x) for x in found], columns=["bag", "mcap_id", "topic", "msg_type", "n"])

    return _found(spark, root).mapInPandas(read, "bag string, mcap_id string, topic string, msg_type string, n long")


def definitions(spark: SparkSession, root: str) -> dict[str, str]:
    """The text of every message type below root, one for each name: as many as there are types, for the driver."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found: dict[str, str] = {}
            for path in pdf["path"]:
                with opened(path) as f:
                    found |= definitions_in(f)
            yield pd.DataFrame(found.items(), columns=["msg_type", "definition"])

    rows = _found(spark, root).mapInPandas(read, "msg_type string, definition string").groupBy("msg_type").agg({"definition": "max"})
    return dict(tuple(r) for r in rows.collect())


def parts_of(chunks: list[tuple[int, ...]], size: int, by_time: bool) -> list[list[tuple[int, ...]]]:
    """Chunks in parts of about `size` bytes; by time, chunks that overlap stay together."""
    out: list[list[tuple[int, ...]]] = []
    held = 0
    for group in overlapping(chunks) if by_time else ([c] for c in chunks):
        own = sum(c[1] for c in group)
        if not out or held + own > size:
            out.append([])
            held = 0
        out[-1] += group
        held += own
    return out


TYPES = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.binary()]


def batches(path: str, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Messages of one file with its bag and segment."""
    bag, segment = named(path)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], names=names)
    held, size = [], 0
    for m in rows:
        held.append((bag, segment, *m))
        size += len(m[-1])
        if len(held) == 5000 or size > 1 << 24:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


class McapSource(DataSource):
    """spark.read.format("mcap").load(folder or file)."""

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return McapReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return McapStream(self.options)


class Part(InputPartition):
    """What one task reads of a file: chunks with the channels that the file's end names, or all of it."""

    def __init__(self, path: str | None, channels: dict | None = None, chunks: list[tuple[int, ...]] | None = None, earlier: int = 0) -> None:
        self.path, self.channels, self.chunks, self.earlier = path, channels, chunks, earlier


class McapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.size, self.by_time = int(options.get("partitionbytes", PART)), options.get("order") == "time"
        self.start, self.end = 0, FOREVER
        self.only: dict[str, set[str] | None] = {"topic": None, "bag": None, "mcap_id": None}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("log_time_ns",) and isinstance(f, GreaterThanOrEqual):
                self.start = max(self.start, f.value)
            elif column == ("log_time_ns",) and isinstance(f, GreaterThan):
                self.start = max(self.start, f.value + 1)
            elif column == ("log_time_ns",) and isinstance(f, LessThan):
                self.end = min(self.end, f.value)
            elif column == ("log_time_ns",) and isinstance(f, LessThanOrEqual):
                self.end = min(self.end, f.value + 1)
            elif column and column[0] in self.only and len(column) == 1 and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                old = self.only[column[0]]
                self.only[column[0]] = wanted if old is None else old & wanted
            else:
                yield f

    def planned(self, path: str) -> list[Part]:
        """A file's parts from the index at its end."""
        with opened(path) as f:
            ends = summary(f)
        names = Names()
        for kind, body in ends or ():
            names.take(kind, body)
        chunks = wanted_chunks(ends, names, self.start, self.end, self.only["topic"]) if ends else None
        if chunks is None:
            return [Part(path)]
        return [Part(path, names.channels, c) for c in parts_of(chunks, self.size, self.by_time)]

    def partitions(self) -> list[InputPartition]:
        fits = lambda f: all(self.only[k] is None or v in self.only[k] for k, v in zip(("bag", "mcap_id"), named(f), strict=True))
        files = [path for path, _, _ in listed(self.path) if fits(path)]
        with ThreadPoolExecutor(THREADS) as pool:
            return [p for own in pool.map(self.planned, files) for p in own] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with opened(partition.path) as f:
                yield from batches(partition.path, self.rows(f, partition))

    def rows(self, f: io.BufferedIOBase, partition: Part) -> Iterator[tuple]:
        if partition.chunks is None:
            found = messages(f, self.start, self.end, self.only["topic"])
            yield from sorted(found, key=lambda m: m[2]) if self.by_time else found
            return
        names = Names()
        names.channels = partition.channels
        yield from in_chunks(f, names, partition.chunks, self.start, self.end, self.only["topic"], self.by_time)


class McapStream(DataSourceStreamReader):
    """Offsets: {"files": {path: chunks taken}, "done": seconds}; files that changed last before `done` are taken whole."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.age = options["path"], int(options.get("partitionbytes", PART)), float(options.get("maxfileage", AGE))
        self.seen: dict[str, tuple[tuple[int, float], list[tuple[int, ...]] | None]] = {}

    def chunks_of(self, path: str, state: tuple[int, float]) -> list[tuple[int, ...]] | None:
        """The chunks that a file has so far; a finished file without chunks is one piece, None."""
        if path not in self.seen or self.seen[path][0] != state:
            with opened(path) as f:
                ends = summary(f)
                chunks = [struct.unpack_from("<QQ", b, 16) for k, b in ends or () if k == CHUNK_INDEX]
                self.seen[path] = state, sorted(chunks) or (None if ends else written_chunks(f))
        return self.seen[path][1]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}, "done": 0.0}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.path)
        done = max(0.0, max((changed for _, _, changed in found), default=0.0) - self.age)
        count = lambda chunks: 1 if chunks is None else len(chunks)
        return {"files": {path: count(self.chunks_of(path, (size, changed))) for path, size, changed in found if changed >= done}, "done": done}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        sizes = {path: (size, changed) for path, size, changed in listed(self.path)}
        if not start["files"] and not start["done"]:  # the first trigger takes files of any age
            out += [Part(path) for path, (_, changed) in sizes.items() if changed < end["done"]]
        for path, many in sorted(end["files"].items()):
            had = start["files"].get(path, 0)
            if path not in sizes or many <= had or path not in start["files"] and sizes[path][1] < start["done"]:
                continue
            chunks = self.chunks_of(path, sizes[path])
            out += [Part(path)] if chunks is None else [Part(path, None, c, had) for c in parts_of(chunks[had:many], self.size, False)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            yield from batches(partition.path, self.rows(f, partition))

    def rows(self, f: io.BufferedIOBase, partition: Part) -> Iterator[tuple]:
        if partition.chunks is None:
            yield from messages(f)
            return
        names = Names()
        for kind, body in summary(f) or ():
            names.take(kind, body)
        if not names.channels:  # no end yet: channels come in the records and chunks before
            first = partition.chunks[0][0]
            f.seek(8)
            while f.tell() < first and len(head := f.read(9)) == 9:
                kind, size = struct.unpack("<BQ", head)
                body = f.read(size)
                for _ in decoded_records([(kind, body)], names, 0, 0, set()):
                    pass
        yield from in_chunks(f, names, partition.chunks, 0, FOREVER, None)

    def commit(self, end: dict) -> None:
        pass
