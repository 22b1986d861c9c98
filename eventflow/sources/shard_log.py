"""A stream over shard logs: folders of Parquet files by topic and shard, read by offset.

``path/topic=<topic>/shard_id=<shard>/*.parquet`` is the log; every row has a long `offset`, unique in its shard and rising from file to
file.  A position is the offset that is read next.  The source keeps one position per shard, starts from committed positions, a seek
position, the earliest or the latest one, reads only the shards it is given, and writes the positions it has passed.

The driver looks at file names and Parquet footers only, and keeps what it knows of a file; rows are read by the tasks, a range of a
shard's offsets each.  Files are reached through Arrow's file systems (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "shard_log"
RANGE_ROWS = 1_000_000  # rows of a shard that one task reads
READ_ROWS = 50_000
FILE = re.compile(r"topic=([^/]*)/shard_id=(\d+)/[^/_.][^/]*\.parquet$")
POSITIONS = r"/\d{20}\.json$"


def file_place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path as a file system and a path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pyarrow.fs.LocalFileSystem(), path


def key_of(topic: str, shard: int) -> str:
    return json.dumps([topic, shard])


def _found(path: str, pattern: str) -> list[str]:
    files, root = file_place(path)
    infos = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(i.path for i in infos if i.type == pyarrow.fs.FileType.File and re.search(pattern, i.path))


def _positions(path: str) -> list[str]:
    """The files of positions in a folder (not below it), oldest first."""
    depth = file_place(path)[1].rstrip("/").count("/") + 1
    return [n for n in _found(path, POSITIONS) if n.count("/") == depth]


def write_log(df: DataFrame, path: str) -> None:
    """Append rows (topic, shard_id, offset, ...) to the log, in offset order within a file."""
    df.repartition("topic", "shard_id").sortWithinPartitions("topic", "shard_id", "offset").write.partitionBy("topic", "shard_id").mode(
        "append").parquet(path)


def write_positions(positions: Mapping[str, int], path: str) -> None:
    """Add a file with the position of each shard; readers see it whole or not at all."""
    files, root = file_place(path)
    files.create_dir(root, recursive=True)
    last = max((int(n.rsplit("/", 1)[-1].split(".")[0]) for n in _positions(path)), default=-1)
    part = f"{root}/.{uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(json.dumps(dict(sorted(positions.items()))).encode())
    files.move(part, f"{root}/{last + 1:020d}.json")
    for old in _positions(path)[:-2]:  # the last two stay, for readers that are at it
        files.delete_file(old)


def read_positions(path: str) -> dict[str, int]:
    """The newest positions written below `path`; none if there are none."""
    names = _positions(path)
    if not names:
        return {}
    with file_place(path)[0].open_input_stream(names[-1]) as f:
        return json.loads(f.read())


def commit_positions(commits: DataFrame, path: str) -> None:
    """Write a table of commits (topic, shard_id, committed), one row per shard, as start positions."""
    write_positions({key_of(r.topic, r.shard_id): r.committed for r in commits.select("topic", "shard_id", "committed").toLocalIterator()}, path)


@dataclass
class Range(InputPartition):
    """Offsets `low` up to `high` (not included) of a shard, and the files that hold them."""

    topic: str
    shard: int
    low: int
    high: int
    files: tuple[str, ...]


class ShardLogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.start = options.get("start") or "latest"
        if self.start.lower() not in ("earliest", "latest") and not re.fullmatch(r"\d+", self.start):
            raise ValueError(f"unknown start position: {self.start}")
        self.commits, self.progress = options.get("commits"), options.get("progress")
        self.topics = set(json.loads(options["topics"])) if options.get("topics") else None
        self.shards = set(json.loads(options["shards"])) if options.get("shards") else None
        self.part, self.parts = (int(x) for x in (options.get("part") or "0/1").split("/"))
        if not 0 <= self.part < self.parts:
            raise ValueError("a part is i/n with i from 0 to n - 1")
        self.most = int(options.get("maxOffsetsPerTrigger") or 0)
        self.range_rows = int(options.get("rangeRows") or RANGE_ROWS)
        if self.most and not self.progress:
            raise ValueError("a bound per micro-batch needs a folder for the progress")
        self.spans: dict[str, tuple[int, int]] = {}  # by file: first offset, and the one after its last
        # with a bound, the positions given out last are kept, so that a stream that starts again never goes back
        self.asked: dict[str, int] = read_positions(f"{self.progress}/asked") if self.most else {}

    def _mine(self, topic: str, shard: int) -> bool:
        return ((self.topics is None or topic in self.topics) and (self.shards is None or shard in self.shards)
                and shard % self.parts == self.part)

    def _files(self) -> dict[str, list[str]]:
        """Files by shard, of the shards that are read; new ones have their footer looked at once."""
        files, _ = file_place(self.path)
        found: dict[str, list[str]] = {}
        for name in _found(self.path, FILE.pattern):
            topic, shard = FILE.search(name).groups()
            topic, shard = unquote(topic), int(shard)
            if not self._mine(topic, shard):
                continue
            if name not in self.spans:
                with files.open_input_file(name) as f:
                    footer = pq.ParquetFile(f).metadata
                at = footer.schema.names.index("offset")
                stats = [footer.row_group(i).column(at).statistics for i in range(footer.num_row_groups) if footer.row_group(i).num_rows]
                self.spans[name] = (min(s.min for s in stats), max(s.max for s in stats) + 1) if stats else (0, 0)
            if self.spans[name][0] < self.spans[name][1]:
                found.setdefault(key_of(topic, shard), []).append(name)
        return {k: sorted(v, key=self.spans.get) for k, v in found.items()}

    def _ends(self) -> dict[str, int]:
        return {k: max(self.spans[f][1] for f in v) for k, v in self._files().items()}

    def initialOffset(self) -> dict:
        """A commit wins over the configured start.  Shards that appear later are read from their first offset."""
        files = self._files()
        committed = read_positions(self.commits) if self.commits else {}
        earliest = {k: min(self.spans[f][0] for f in v) for k, v in files.items()}
        latest = {k: max(self.spans[f][1] for f in v) for k, v in files.items()}
        chosen = {"earliest": earliest, "latest": latest}.get(self.start.lower()) or dict.fromkeys(files, int(self.start) if self.start.isdigit() else 0)
        return {k: committed.get(k, chosen[k]) for k in files}

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self.most:  # each shard goes on by at most its share from what was given out last
            share = max(1, self.most // max(1, len(ends)))
            begun = {**self.initialOffset(), **self.asked}
            ends = {k: max(begun[k], min(v, begun[k] + share)) for k, v in ends.items()}
        before, self.asked = self.asked, {**self.asked, **{k: max(v, self.asked.get(k, 0)) for k, v in ends.items()}}
        if self.most and self.asked != before:
            write_positions(self.asked, f"{self.progress}/asked")
        return dict(self.asked)

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        out = []
        files = self._files()
        for key, high in sorted(end.items()):
            names = files.get(key, [])
            topic, shard = json.loads(key)
            low = start.get(key, min((self.spans[f][0] for f in names), default=high))
            while low < high:
                top = min(high, low + self.range_rows)
                inside = tuple(f for f in names if self.spans[f][0] < top and self.spans[f][1] > low)
                if inside:
                    out.append(Range(topic, shard, low, top, inside))
                    low = top
                else:  # a gap: on to the next file
                    low = max(top, min((self.spans[f][0] for f in names if self.spans[f][0] >= top), default=high))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        files, _ = file_place(self.path)
        for name in partition.files:
            with files.open_input_file(name) as f:
                parquet = pq.ParquetFile(f)
                names = [c for c in target.names if c in parquet.schema_arrow.names]
                for rows in parquet.iter_batches(READ_ROWS, columns=list(dict.fromkeys([*names, "offset"]))):
                    at = rows.column("offset")
                    rows = rows.filter(pc.and_(pc.greater_equal(at, partition.low), pc.less(at, partition.high)))
                    if not len(rows):
                        continue
                    known = {"topic": pa.array([partition.topic] * len(rows)), "shard_id": pa.array([partition.shard] * len(rows))}
                    columns = [known[f.name] if f.name in known else rows.column(f.name) if f.name in names else pa.nulls(len(rows)) for f in target]
                    yield pa.RecordBatch.from_arrays([pc.cast(c, f.type) for c, f in zip(columns, target)], schema=target)

    def commit(self, end: dict) -> None:
        """What lies before these positions will not be asked for again."""
        if self.progress:
            write_positions(end, self.progress)


class ShardLog(DataSource):
    """``spark.readStream.format("shard_log")`` with a schema and the options of `open_log`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> ShardLogReader:
        return ShardLogReader(schema, self.options)


def open_log(spark: SparkSession, path: str, schema: StructType | str, start: str = "latest", commits: str | None = None,
             progress: str | None = None, topics: Sequence[str] | None = None, shards: Sequence[int] | None = None,
             part: tuple[int, int] | None = None, max_offsets: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The log as a stream.

    `start` is earliest, latest or an offset to seek to, for shards without a position among the `commits` (a folder of
    `commit_positions`, or the `progress` folder of an earlier stream); it only counts for a new checkpoint, as a stream that starts again goes
    on where its checkpoint is.  `shards` is a list of partitions, `part` (i, n) takes every n-th shard.  After each
    micro-batch the positions passed are written to `progress`.  `max_offsets` bounds a micro-batch over all shards (triggers
    that take all there is in one go stop after one such micro-batch); a busy shard is read by several tasks, `range_rows` offsets each.
    """
    spark.dataSource.register(ShardLog)
    reader = spark.readStream.format(FORMAT).schema(schema).option("path", path).option("start", start).option("rangeRows", range_rows)
    for name, value in (("commits", commits), ("progress", progress), ("topics", json.dumps(list(topics)) if topics is not None else None),
                        ("shards", json.dumps(list(shards)) if shards is not None else None), ("part", f"{part[0]}/{part[1]}" if part else None),
                        ("maxOffsetsPerTrigger", max_offsets)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()
