"""Web archives: WARC files with revisit records, and their capture index in global order by external merging.

Writing: pages with equal payloads of some length are found by digest; one is stored as response, the others as revisits of it.
Every task writes one file of gzip members, one per record.

Reading: every archive is read record by record, responses are checked against their digest, and its captures are sorted by
URL key and timestamp and written as a *run*. Runs are merged by loser trees of ``FAN_IN`` runs, in as many levels as that
takes. A merge is split into key ranges (from up to ``RUN_KEYS`` keys per run file) that different tasks take; a task streams
its part of each run in small batches, so neither a large index nor one very common host is a single task's work. The last
level yields the capture histories in global order.

Files of lost task attempts have names of their own and are never read. The driver sees one entry per file.

Defined results: a null payload is an empty one; of equal payloads the largest id (then the last row) is the response, null
ids are the smallest; rows of the same id are records of their own; a missing URL is ``urn:unknown``; the capture time is
that of ``time_column`` (seconds since 1970, moved into the years 1 to 9999), else ``FIRST_CAPTURE`` plus the id in seconds; an
empty table yields no rows. A very long payload is held whole by one task, about three times over.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.llm.common import only, open_folder, slices
from sidewise.plans.storage import cut

REVISIT_BYTES = 1000
FIRST_CAPTURE = 1_700_000_000
# The first second of the year 1 and the last one of the year 9999, which is all that a record's date can name.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799
FAN_IN, RUN_KEYS, RANGE_ROWS, STREAM_ROWS = 32, 16, 16_384, 512
BATCH_BYTES = 8 << 20
_SALTS = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("row", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
_CAPTURE_DDL = (
    "url_key string, timestamp string, page_id long, row long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, offset long, length long"
)
_FILES = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("keys", pa.string())])
_FILES_DDL = "name string, rows long, keys string"


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the top domain down, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return (labels + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    time_column: str | None = None,
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` as WARC files to ``folder``; returns ``name, rows, keys`` of the files."""
    columns = {"id": id_column, "url": url_column, "payload": payload_column} | ({"time": time_column} if time_column else {})
    rows = only(pages, **columns).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")))
    # Records carry SHA-1; what is equal is told by SHA-256, for which no collisions are known.
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1("payload"), "content": F.unhex(F.sha2("payload", 256))})
    if not time_column:
        rows = rows.withColumn("time", F.lit(FIRST_CAPTURE) + F.coalesce(F.col("id"), F.lit(0)) % (10 * 365 * 86_400))
    # Stored, so that both uses see the same row numbers.
    rows = cut(rows, "pages")
    # Only the digests are grouped; few are shared. One digest may be a third of all rows, so the rows that meet it are salted.
    shared = (
        rows.filter(F.col("bytes") >= revisit_bytes).select("content", "id", "row")
        .groupBy(F.col("content").alias("same_content"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("response"))
        .filter("n > 1")
        .select(
            "same_content", F.col("response.id").alias("response_id"), F.col("response.row").alias("response_row"),
            F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("same_salt"),
        )
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_SALTS)).cast("int"))
    same = (F.col("content") == F.col("same_content")) & (F.col("salt") == F.col("same_salt"))
    decided = salted.join(shared, same, "left").select("id", "row", "url", "payload", "bytes", "digest", "time", "response_id", "response_row")
    return cut(decided.mapInArrow(_archive_writer(folder), _FILES_DDL), "archives")


def _archive_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name, out, rows = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in slices(batches, "payload", BATCH_BYTES):
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            for row in batch.to_pylist():
                out.write(_member(_record(row)))
                rows += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "rows": rows, "keys": "[]"}], _FILES)

    return run


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _name(key: int | None, row: int) -> str:
    return f"<urn:page:{'' if key is None else key}:{row}>"


def _record(row: dict) -> bytes:
    revisit = row["response_row"] is not None and row["response_row"] != row["row"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    body = http if revisit else http + row["payload"]
    seconds = min(max(int(row["time"] or 0), _FIRST_SECOND), _LAST_SECOND)
    date = datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=seconds)
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", row["url"] or "urn:unknown")
    header = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(row["id"], row["row"]),
        "WARC-Date": date.isoformat(timespec="seconds").replace("+00:00", "Z"),
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        header |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _name(row["response_id"], row["response_row"])}
    header["Content-Length"] = str(len(body))
    lines = "".join(f"{name}: {value}\r\n" for name, value in header.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[int, int, bytes]]:
    """``offset, length, record`` of every gzip member of an archive, read in small steps."""
    start = position = 0
    waiting = b""
    while True:
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            if not waiting:
                waiting = stream.read(1 << 20)
                if not waiting:
                    if parts:
                        raise ValueError("The archive ends inside a record")
                    return
            parts.append(packer.decompress(waiting))
            position += len(waiting) - len(packer.unused_data)
            waiting = packer.unused_data
        yield start, position - start, b"".join(parts)
        start = position


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header and the payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


def _capture(archive: str, offset: int, length: int, record: bytes) -> dict:
    warc, http, payload = parse(record)
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = warc["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"The payload of {warc['warc-record-id']} in {archive} is damaged")
    key, row = _ids(warc["warc-record-id"])
    return {
        "url_key": url_key(warc["warc-target-uri"]), "timestamp": re.sub("[^0-9]", "", warc["warc-date"]),
        "page_id": key, "row": row, "payload_bytes": int(http["content-length"]), "payload_digest": digest,
        "record_type": warc["warc-type"], "refers_to": _ids(warc["warc-refers-to"])[0] if revisit else None,
        "archive": archive, "offset": offset, "length": length,
    }


def _ids(name: str) -> tuple[int | None, int]:
    key, row = name.removeprefix("<urn:page:").removesuffix(">").split(":")
    return int(key) if key else None, int(row)


def _key(row: dict) -> tuple:
    return row["url_key"], row["timestamp"], row["page_id"] is not None, row["page_id"] or 0, row["row"]


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """All captures in global order: ``range`` and ``place`` number them, the other columns are those of ``CAPTURE``."""
    names = [row["name"] for row in archives.orderBy("name").collect()]
    files = spark.createDataFrame([(name, 0, "[]") for name in names], _FILES_DDL)
    if names:
        files = files.repartition(len(names), "name")
    runs = cut(files.mapInArrow(_run_writer(folder), _FILES_DDL), "runs")
    level = [[row.asDict()] for row in runs.orderBy("name").collect()]  # a run is a list of files in order
    while len(level) > FAN_IN:
        groups = [level[i : i + FAN_IN] for i in range(0, len(level), FAN_IN)]
        tasks = [(i, j, plan) for i, group in enumerate(groups) for j, plan in enumerate(_plans(group))]
        merged = cut(_tasks(spark, tasks).mapInArrow(_merger(folder, write=True), f"run int, part int, {_FILES_DDL}"), "runs")
        level = [[] for _ in groups]
        for row in merged.orderBy("run", "part").collect():
            level[row["run"]].append(row.asDict())
        level = [run for run in level if run]
    tasks = [(0, j, plan) for j, plan in enumerate(_plans(level))]
    return _tasks(spark, tasks).mapInArrow(_merger(folder, write=False), f"range int, place long, {_CAPTURE_DDL}")


def _tasks(spark: SparkSession, tasks: list[tuple[int, int, str]]) -> DataFrame:
    rows = spark.createDataFrame(tasks, "run int, part int, plan string")
    return rows.repartition(len(tasks)) if tasks else rows


def _plans(runs: list[list[dict]]) -> list[str]:
    """One merge of runs as several, by key range. A plan names for every run the files that may hold keys of its range."""
    parsed = [[[tuple(key) for key in json.loads(file["keys"])] for file in run] for run in runs]
    keys = sorted(key for run in parsed for file in run for key in file)
    total = sum(file["rows"] for run in runs for file in run)
    if not total:
        return []
    count = min(max(1, -(-total // RANGE_ROWS)), len(keys))
    bounds = sorted({keys[len(keys) * i // count] for i in range(1, count)})
    firsts = [[file[0] for file in run] for run in parsed]
    plans = []
    # Ranges ascend, so the files of each run are walked once.
    begin = [0] * len(runs)
    for low, high in zip([None, *bounds], [*bounds, None]):
        chosen = []
        for r, (run, first) in enumerate(zip(runs, firsts)):
            while low and begin[r] + 1 < len(run) and first[begin[r] + 1] <= low:
                begin[r] += 1
            end = begin[r]
            while end < len(run) and (high is None or first[end] < high):
                end += 1
            if end > begin[r]:
                chosen.append([file["name"] for file in run[begin[r] : end]])
        plans.append(json.dumps({"low": low, "high": high, "runs": chosen}))
    return plans


def _run_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{path}/{row['name']}", compression=None) as stream:
                    captures = [_capture(row["name"], *found) for found in records(stream)]
                captures.sort(key=_key)
                yield pa.RecordBatch.from_pylist([_written(system, path, iter(captures))], _FILES)

    return run


def _written(system, path: str, captures: Iterator[dict]) -> dict:
    """Write captures that come in order as one run file of small batches, with a few of its keys for planning."""
    name, rows, keys, every = f"{uuid.uuid4().hex}.run", 0, [], 1
    with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, CAPTURE) as writer:
        held: list[dict] = []
        for capture in captures:
            if rows % every == 0:
                keys.append(_key(capture))
                if len(keys) == 2 * RUN_KEYS:
                    keys, every = keys[::2], 2 * every
            held.append(capture)
            rows += 1
            if len(held) == STREAM_ROWS:
                writer.write_batch(pa.RecordBatch.from_pylist(held, CAPTURE))
                held = []
        if held:
            writer.write_batch(pa.RecordBatch.from_pylist(held, CAPTURE))
    return {"name": name, "rows": rows, "keys": json.dumps(keys)}


def _stream(system, path: str, names: list[str], low: tuple | None, high: tuple | None) -> Iterator[dict]:
    """Captures of a run from ``low`` to below ``high``, one small batch in memory at a time."""
    for name in names:
        with system.open_input_file(f"{path}/{name}") as file:
            reader = pa.ipc.open_file(file)
            first = 0
            if low:
                # The last batch that starts at or below the range.
                below, above = 0, reader.num_record_batches
                while above - below > 1:
                    middle = (below + above) // 2
                    head = _key(reader.get_batch(middle).slice(0, 1).to_pylist()[0])
                    below, above = (middle, above) if head <= low else (below, middle)
                first = below
            for i in range(first, reader.num_record_batches):
                for capture in reader.get_batch(i).to_pylist():
                    key = _key(capture)
                    if high and key >= high:
                        return
                    if not low or key >= low:
                        yield capture


class LoserTree:
    """Merges sorted streams. Inner nodes keep the loser of their match, so each step replays one path to the root."""

    def __init__(self, streams: list[Iterator[dict]]):
        self._streams = streams
        self._heads = [next(stream, None) for stream in streams]
        self._keys = [None if head is None else _key(head) for head in self._heads]
        size = max(1, len(streams))
        self._losers = [-1] * size
        winners = [-1] * size + list(range(len(streams)))
        for node in range(size - 1, 0, -1):
            winners[node], self._losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self._winner = winners[1] if len(streams) > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; an ended stream loses."""
        if self._keys[b] is None or (self._keys[a] is not None and self._keys[a] <= self._keys[b]):
            return a, b
        return b, a

    def __iter__(self) -> Iterator[dict]:
        if not self._streams:
            return
        while (head := self._heads[self._winner]) is not None:
            yield head
            winner = self._winner
            self._heads[winner] = next(self._streams[winner], None)
            self._keys[winner] = None if self._heads[winner] is None else _key(self._heads[winner])
            node = (winner + len(self._streams)) // 2
            while node:
                winner, self._losers[node] = self._match(winner, self._losers[node])
                node //= 2
            self._winner = winner


def _merger(folder: str, write: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for task in batch.to_pylist():
                plan = json.loads(task["plan"])
                low, high = (tuple(plan[end]) if plan[end] else None for end in ("low", "high"))
                tree = LoserTree([_stream(system, path, names, low, high) for names in plan["runs"]])
                if write:
                    file = _written(system, path, iter(tree))
                    if file["rows"]:
                        schema = pa.schema([("run", pa.int32()), ("part", pa.int32()), *_FILES])
                        yield pa.RecordBatch.from_pylist([{"run": task["run"], "part": task["part"]} | file], schema)
                    continue
                held: list[dict] = []
                schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), *CAPTURE])
                for place, capture in enumerate(tree):
                    held.append({"range": task["part"], "place": place} | capture)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run
