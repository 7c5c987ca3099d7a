"""Frozen archives: Zstd files of many frames that many tasks read and write.

A frame can be decompressed alone. Archives written here end with a seek table in the
public seekable format (a skippable frame that lists the frames' sizes); of others the
block headers tell where frames begin. A task reads some frames of a file: it leaves the
line that it starts within to the task before it and reads the last line that begins in
its frames to its end, as Spark does with text. Nothing holds an archive whole.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import struct
import tarfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fixed values: magic numbers of the format
FRAME, SKIPPABLE, TABLE, SEEKABLE = 0xFD2FB528, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FROZEN = re.compile(r"\.raw\.zst$|(^|/)raw-import-[^/]*\.tar\.zst$")
DAY = re.compile(r"(?:19|20)[0-9]{2}-?[01][0-9]-?[0-3][0-9]")
ROWS, CHUNK = 5000, 1 << 20
#: lines of a frame, and compressed bytes of the frames that one task reads
FRAME_LINES, TASK_BYTES = 65_536, 32 << 20
SCHEMA = "path string, member string, line_no long, raw string"


def located(path: str):
    """(file system, path within it) of a uri or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def table_of(sizes: list[tuple[int, int]]) -> bytes:
    """A seek table of frames' (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", TABLE, len(body)) + body


def _listed(file, size: int) -> list[tuple[int, int]] | None:
    """(offset, length) of the frames, by a seek table at the end, if there is one."""
    if size < 17:
        return None
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    entry = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or (whole := 17 + entry * n) > size:
        return None
    file.seek(size - whole)
    data = file.read(whole)
    if struct.unpack_from("<I", data)[0] != TABLE:
        return None
    out, at = [], 0
    for i in range(n):
        length = struct.unpack_from("<I", data, 8 + entry * i)[0]
        out.append((at, length))
        at += length
    return out if at == size - whole else None


def _scanned(file, size: int) -> list[tuple[int, int]]:
    """(offset, length) of the frames, by their block headers; contents are skipped."""
    out, at = [], 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(min(18, size - at))
        magic = struct.unpack_from("<I", head)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", head, 4)[0]
            continue
        if magic != FRAME:
            raise ValueError("this is no Zstd frame")
        flags = head[4]
        single = flags >> 5 & 1
        begin, at = at, at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        last = False
        while not last:
            file.seek(at)
            block = int.from_bytes(file.read(3), "little")
            last = bool(block & 1)
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 * (flags >> 2 & 1)
        out.append((begin, at - begin))
    return out


def frames_of(path: str) -> list[tuple[int, int]]:
    system, name = located(path)
    with system.open_input_file(name) as file:
        size = file.size()
        return _listed(file, size) or _scanned(file, size)


class Frames(InputPartition):
    def __init__(self, path: str, start: int, stop: int, first: int, day: str | None):
        self.path, self.start, self.stop, self.first, self.day = path, start, stop, first, day


class _Plain:
    """Decompressed bytes from an offset of a file on; ``bound`` is how many of them came
    from before ``stop``."""

    def __init__(self, path: str, start: int, stop: int):
        import zstandard

        system, name = located(path)
        self.file = system.open_input_file(name)
        self.file.seek(start)
        self.left, self.done, self.ended = stop - start, 0, False
        self.new = zstandard.ZstdDecompressor().decompressobj
        self.decoder, self.held, self.bound = self.new(), b"", None

    def chunk(self) -> bytes:
        """The next bytes, empty at the end of the file."""
        while True:
            if self.left == 0 and not self.held and self.bound is None:
                self.bound = self.done
            data = self.held or self.file.read(min(CHUNK, self.left) if self.left > 0 else CHUNK // 16)
            if not data:
                self.file.close()
                if self.bound is None:
                    self.bound = self.done
                return b""
            if not self.held:
                self.left -= min(len(data), self.left)
            out = self.decoder.decompress(data)
            self.held = b""
            if self.decoder.eof:
                self.held, self.decoder = self.decoder.unused_data, self.new()
                while len(self.held) >= 8 and struct.unpack_from("<I", self.held)[0] & 0xFFFFFFF0 == SKIPPABLE:
                    self.held = self.held[8 + struct.unpack_from("<I", self.held, 4)[0] :]
            self.done += len(out)
            if out:
                return out


def lines_of(chunks, bound=None, skip: bool = False):
    """Lines of a stream of chunks. ``skip`` leaves out the first, which began before;
    lines that begin after ``bound()`` (None: not reached yet) belong to what follows."""
    rest, at = [], 0  # pieces of an unfinished line, and where it begins
    for chunk in chunks:
        *whole, tail = chunk.split(b"\n")
        for piece in whole:
            line = b"".join(rest) + piece if rest else piece
            rest = []
            if skip:
                skip = False
            else:
                yield line
            at += len(line) + 1
            if bound is not None and bound() is not None and at > bound():
                return
        if tail:
            rest.append(tail)
    if rest and not skip:
        yield b"".join(rest)


def _batches(path: str, member: str, first: int, lines):
    names = ["path", "member", "line_no", "raw"]
    out, number = [], first

    def rows():
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(number - n, number), pa.int64()), pa.array(out, pa.string())], names)

    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text:
            out.append(text)
            number += 1
        if len(out) >= ROWS:
            yield rows()
            out = []
    if out:
        yield rows()


def read_frames(part: Frames):
    """Record batches of the lines that begin in some frames of a raw archive. The line
    numbers of a task begin with 2**32 times its first frame's number."""
    plain = _Plain(part.path, part.start, part.stop)
    chunks = iter(plain.chunk, b"")
    # a line that begins just where the frames end belongs to this task, too
    lines = lines_of(chunks, lambda: plain.bound, part.first > 0)
    yield from _batches(part.path, part.path.rpartition("/")[2], part.first << 32, lines)


def read_members(path: str, day: str | None):
    """Record batches of the lines of a tar archive's members, streamed."""
    import zstandard

    system, name = located(path)
    number = 0
    with system.open_input_stream(name, compression=None) as file, zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as plain:
        with tarfile.open(fileobj=plain, mode="r|") as tar:
            for member in tar:
                if not member.isfile() or not on_day(member.name, day) and not on_day(path.rpartition("/")[2], day, False):
                    continue
                inner = tar.extractfile(member)
                inner = gzip.open(inner) if member.name.endswith(".gz") else inner
                for batch in _batches(path, member.name, number, lines_of(iter(lambda: inner.read(CHUNK), b""))):
                    number += batch.num_rows
                    yield batch


def on_day(name: str, day: str | None, unknown: bool = True) -> bool:
    """Whether a name holds a day, or ``unknown`` if it holds none."""
    found = {d.replace("-", "") for d in DAY.findall(name)}
    return day is None or (day.replace("-", "") in found if found else unknown)


def parts_of(path: str, day: str | None = None, most: int = TASK_BYTES) -> list[Frames]:
    """What the tasks of one archive read: frames of ``most`` bytes together; of a tar
    archive all. One frame is never cut."""
    if path.endswith(".tar.zst"):
        return [Frames(path, 0, 0, -1, day)]
    out, begin, size, first = [], None, 0, 0
    for number, (at, length) in enumerate(frames_of(path)):
        if begin is not None and size + length > most:
            out.append(Frames(path, begin, begin + size, first, day))
            begin = None
        if begin is None:
            begin, size, first = at, 0, number
        size = at + length - begin
    return out + ([Frames(path, begin, begin + size, first, day)] if begin is not None else [])


def read_part(part: Frames):
    return read_members(part.path, part.day) if part.first < 0 else read_frames(part)


def listing(path: str, day: str | None = None) -> list[str]:
    """Frozen archives below a path, in order, without those whose names hold another day."""
    system, root = located(path)
    uri = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and FROZEN.search(f.path))
    return [uri + n for n in names if on_day(n.rpartition("/")[2], day) or n.endswith(".tar.zst")]


class FrozenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.day, self.most = options["path"], options.get("day"), int(options.get("taskbytes", TASK_BYTES))
        self.glob = options.get("pathglob")

    def partitions(self):
        paths = [p for p in listing(self.path, self.day) if self.glob is None or fnmatch.fnmatch(p, self.glob)]
        return [part for p in paths for part in parts_of(p, self.day, self.most)] or [Frames("", 0, 0, 0, None)]

    def read(self, partition):
        if partition.path:
            yield from read_part(partition)


class FrozenArchives(DataSource):
    """spark.read.format("frozen").load(path): the lines of the archives below a path.
    Options: day, taskBytes (frames that a task reads together)."""

    @classmethod
    def name(cls):
        return "frozen"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FrozenReader(self.options)


def frozen_scan(spark: SparkSession, path: str, day: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    spark.dataSource.register(FrozenArchives)
    reader = spark.read.format("frozen").option("taskBytes", task_bytes)
    return (reader if day is None else reader.option("day", day)).load(path)


def frame_index(paths: DataFrame) -> DataFrame:
    """(path, first, start, stop) of what tasks read of archives (path), found by Spark;
    part of an index, so that a scan restricted by a join lists no file on the driver."""

    def run(batches):
        for batch in batches:
            parts = [p for path in batch.column(0).to_pylist() for p in parts_of(path)]
            values = [[p.path for p in parts], [p.first for p in parts], [p.start for p in parts], [p.stop for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "first", "start", "stop"])

    return paths.select("path").mapInArrow(run, "path string, first long, start long, stop long")


def indexed_lines(parts: DataFrame, day: str | None = None) -> DataFrame:
    """The lines of some parts of archives (path, first, start, stop): what an index left."""

    def run(batches):
        for batch in batches:
            for path, first, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
                yield from read_part(Frames(path, start, stop, first, day))

    return parts.select("path", "first", "start", "stop").repartition("path", "first").mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- writing


def _compressed(header: bytes | None, level: int, lines: int):
    """Rows (line) in order to (content, lines, bytes) of whole frames; the first task's
    first frame begins with the header."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        names, kinds = ["task", "n", "content", "lines", "plain"], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        task, n, held = TaskContext.get().partitionId(), 0, []

        def row():
            data = b"".join(held)
            content = zstandard.ZstdCompressor(level=level).compress(data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((task, n, content, len(held), len(data)), kinds)], names)

        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append(line.encode() + b"\n")
                if len(held) >= lines:
                    yield row()
                    n, held = n + 1, []
        if held:
            yield row()

    return run


def _joined(target: str, header: bytes, level: int):
    """Frames in order to one file with a seek table, streamed by one task."""

    def run(batches):
        import zstandard

        system, name = located(target)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        sizes, rows = [], 0
        with system.open_output_stream(name) as out:
            if header:
                first = zstandard.ZstdCompressor(level=level).compress(header)
                out.write(first)
                sizes.append((len(first), len(header)))
            for batch in batches:
                for content, n, plain in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    out.write(content.as_buffer())
                    sizes.append((len(content.as_buffer()), plain))
                    rows += n
            out.write(table_of(sizes))
        size = system.get_file_info(name).size
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([size], pa.int64()), pa.array([len(sizes)], pa.int64())], ["rows", "bytes", "frames"])

    return run


def write_zst(rows: DataFrame, order: list, line, target: str, header: str = "", level: int = 19, lines: int = FRAME_LINES):
    """Lines of ``rows`` in an order as one Zstd file of many frames: tasks compress the
    frames, one task puts them together under a temporary name, and the file gets its name
    last. No row goes through the driver. Returns (rows, bytes, frames)."""
    from siftline.sources.tables import scratch

    spark = rows.sparkSession
    sorted_rows = rows.withColumn("_line", line).repartitionByRange(*order).sortWithinPartitions(*order).select("_line")
    frames = scratch(spark, "frames")
    sorted_rows.mapInArrow(_compressed(None, level, lines), "task long, n long, content binary, lines long, plain long").write.parquet(frames)
    staged = f"{target}.{uuid.uuid4().hex}.tmp"
    parts = spark.read.parquet(frames).repartition(1).sortWithinPartitions("task", "n").select("content", "lines", "plain")
    found = parts.mapInArrow(_joined(staged, header.encode(), level), "rows long, bytes long, frames long").collect()
    jvm = spark._jvm.org.apache.hadoop.fs
    old, new = jvm.Path(target), jvm.Path(staged)
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(jvm.Path(frames), True)
    if system.exists(old):
        system.delete(old, False)
    if not system.rename(new, old):
        raise OSError(f"{staged} can't be moved to {target}")
    row = found[0]
    return row["rows"], row["bytes"], row["frames"]


def _by_key(target: str, lines: int, level: int):
    """Rows (key, raw) in order to one file for each key, frame by frame. A file gets its
    name when it is complete; a task that runs again writes the same."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        system, root = located(target)
        system.create_dir(root, recursive=True)
        attempt, packer = TaskContext.get().taskAttemptId(), zstandard.ZstdCompressor(level=level)
        key, out, held, sizes, total = None, None, [], [], 0

        def frame():
            data = b"".join(held)
            packed = packer.compress(data)
            out.write(packed)
            sizes.append((len(packed), len(data)))

        def close():
            if held:
                frame()
            out.write(table_of(sizes))
            out.close()
            name = f"{root}/raw-{key}.raw.zst"
            system.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_arrays([pa.array([f"{target.rstrip('/')}/raw-{key}.raw.zst"]), pa.array([total], pa.int64())], ["path", "lines"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is not None and k != key:
                    yield close()
                    out = None
                if out is None:
                    key, held, sizes, total = k, [], [], 0
                    out = system.open_output_stream(f"{root}/raw-{key}.raw.zst.{attempt}")
                held.append((raw or "").encode() + b"\n")
                total += 1
                if len(held) >= lines:
                    frame()
                    held = []
        if out is not None:
            yield close()

    return run


def freeze(events: DataFrame, target: str, key, lines: int = FRAME_LINES, level: int = 3) -> DataFrame:
    """Raw lines as one archive ``raw-<key>.raw.zst`` for each key, by time and id, written
    by the tasks; rows (path, lines). Keys should hold some million lines at most: add a
    bucket of the event_id to the day."""
    from siftline.sources.tables import scratch

    order = ["key", "ingest_time", "event_id"]
    rows = events.select(key.alias("key"), "ingest_time", "event_id", "raw").repartition("key").sortWithinPartitions(*order).select("key", "raw")
    written = scratch(events.sparkSession, "frozen-files")
    rows.mapInArrow(_by_key(target, lines, level), "path string, lines long").write.parquet(written)
    return events.sparkSession.read.parquet(written)
