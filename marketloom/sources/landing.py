"""The landing zone of provider payloads as a data source: spark.read.format("marketloom_payloads"), and readStream.

Payloads land as files of JSON lines under <path>/provider_code=<code>/day=<yyyy-mm-dd>/, one request with its payload a line. Files don't change once they are there; their names
say nothing of when they came. Folders and files that begin with "_" or "." are passed over. Stores are those that pyarrow reaches by URI."""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "marketloom_payloads"
SCHEMA = "provider_code string, day date, request_id string, raw_symbol string, asset_class string, timeframe string, row_limit int, since timestamp, payload string, file string, at long"
EVER, FAR = dt.date(1, 1, 1), dt.date(9999, 12, 31)


@dataclass(frozen=True)
class Piece(InputPartition):
    """Ranges of bytes (file, start, end) of files of one provider and day; a line belongs to the range in which it begins."""

    provider: str
    day: dt.date
    ranges: tuple[tuple[str, int, int], ...]


class Zone:
    """Lists and reads a landing zone. What is asked for by provider and day is listed, and nothing else."""

    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError(f"{NAME} needs a path")
        self.path = options["path"]
        self.piece_bytes = int(options.get("pieceBytes", 64 << 20))
        self.providers = {options["provider"]} if options.get("provider") else None
        self.first = dt.date.fromisoformat(options["since"][:10]) if options.get("since") else EVER
        self.last = dt.date.fromisoformat(options["until"][:10]) if options.get("until") else FAR
        self.since = dt.datetime.fromisoformat(options["since"]) if options.get("since") else None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or ":/" in self.path else f"file://{self.path}")

    def _under(self, store, folder: str, kind) -> list:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if f.type == kind and f.base_name[0] not in "_."), key=lambda f: f.base_name)

    def folders(self, first: dt.date | None = None) -> Iterator[tuple[str, dt.date, str]]:
        """(provider, day, folder) of the days wanted; folders of other names are passed over."""
        from pyarrow import fs

        store, root = self._store()
        for p in self._under(store, root, fs.FileType.Directory):
            key, _, code = p.base_name.partition("=")
            if key != "provider_code" or self.providers is not None and code not in self.providers:
                continue
            for d in self._under(store, p.path, fs.FileType.Directory):
                key, _, day = d.base_name.partition("=")
                try:
                    at = dt.date.fromisoformat(day)
                except ValueError:
                    continue
                if key == "day" and max(self.first, first or EVER) <= at <= self.last:
                    yield code, at, d.path

    def files(self, folder: str) -> list[tuple[str, int, str]]:
        """(name, bytes, path) in order of names."""
        from pyarrow import fs

        store, _ = self._store()
        return [(f.base_name, f.size, f.path) for f in self._under(store, folder, fs.FileType.File)]

    def pieces(self, provider: str, day: dt.date, files: list[tuple[str, int, str]]) -> Iterator[Piece]:
        """Large files are cut in ranges, small ones of a folder are read together."""
        held, size = [], 0
        for _, n, path in files:
            for start in range(0, max(n, 1), self.piece_bytes):
                end = min(n, start + self.piece_bytes)
                held.append((path, start, end))
                size += end - start
                if size >= self.piece_bytes:
                    yield Piece(provider, day, tuple(held))
                    held, size = [], 0
        if held:
            yield Piece(provider, day, tuple(held))

    def read(self, piece: Piece | None) -> Iterator[tuple]:
        store, _ = self._store()
        for path, start, end in piece.ranges if piece else ():
            with io.BufferedReader(store.open_input_file(path), 1 << 20) as f:
                f.seek(max(0, start - 1))
                if start:
                    f.readline()  # the line that begins before; if the byte before ends one, only that byte
                while (at := f.tell()) < end:
                    line = f.readline()
                    if not line.strip():
                        continue
                    *row, since, payload = self._row(line)
                    if self.since is None or since is None or since.replace(tzinfo=None) >= self.since:
                        yield (piece.provider, piece.day, *row, since, payload, path.rsplit("/", 1)[-1], at)

    @staticmethod
    def _row(line: bytes) -> tuple:
        """The fields of a line. One that is no object gives nulls and itself as payload, so that it is refused later and seen; a payload that is no text is kept as JSON."""
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        try:
            x = json.loads(text)
        except ValueError:
            x = None
        if not isinstance(x, dict):
            return None, None, None, None, None, None, text
        said = lambda k: None if x.get(k) is None else str(x[k])
        payload, limit, since = x.get("payload"), x.get("row_limit"), x.get("since")
        try:
            since = None if since is None else dt.datetime.fromisoformat(since)
        except (TypeError, ValueError):
            since = None
        if since is not None:  # without a zone it is UTC
            since = since.astimezone(dt.timezone.utc) if since.tzinfo else since.replace(tzinfo=dt.timezone.utc)
        limit = limit if isinstance(limit, int) and not isinstance(limit, bool) and abs(limit) < 2**31 else None
        return said("request_id"), said("raw_symbol"), said("asset_class"), said("timeframe"), limit, since, payload if payload is None or isinstance(payload, str) else json.dumps(payload)


class PayloadReader(DataSourceReader):
    """A batch. What it reads is chosen by options and not by pushed filters: Spark 4.1 keeps one reader for all uses of a loaded DataFrame, so that filters pushed by one use would hold for the others."""

    def __init__(self, options: dict) -> None:
        self.zone = Zone(options)

    def partitions(self) -> list[Piece]:
        return [p for provider, day, folder in self.zone.folders() for p in self.zone.pieces(provider, day, self.zone.files(folder))]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.zone.read(partition)


class PayloadStreamReader(DataSourceStreamReader):
    """A stream. An offset has the names of the files in the folders of the newest ``openDays`` days, and the first of these days.

    A folder that leaves the window is read to its end in the batch in which it does, as are days that came and went between two offsets; files that land in a
    folder after it has left are not seen. So an offset is as large as the listing of the open days, however long the stream runs."""

    def __init__(self, options: dict) -> None:
        self.zone, self.open_days = Zone(options), int(options.get("openDays", 7))

    def initialOffset(self) -> dict:
        return {"from": self.zone.first.isoformat(), "files": {}}

    def latestOffset(self) -> dict:
        days = list(self.zone.folders())
        newest = max((d for _, d, _ in days), default=self.zone.first)
        first = max(self.zone.first, newest - dt.timedelta(days=min(self.open_days - 1, (newest - EVER).days)))
        names = {f"{p}/{d}": [f[0] for f in self.zone.files(folder)] for p, d, folder in days if d >= first}
        return {"from": first.isoformat(), "files": names}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        opened, out = dt.date.fromisoformat(end["from"]), []
        for provider, day, folder in self.zone.folders(dt.date.fromisoformat(start["from"])):
            key = f"{provider}/{day}"
            before, listed = set(start["files"].get(key, ())), set(end["files"].get(key, ()))
            files = [f for f in self.zone.files(folder) if f[0] not in before and (day < opened or f[0] in listed)]
            out += self.zone.pieces(provider, day, files)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.zone.read(partition)


class PayloadSource(DataSource):
    """Options: path; provider (one); since (a date or time: days before aren't listed, and lines whose since is before are left out); until (the last day); pieceBytes; openDays (streams)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)

    def streamReader(self, schema) -> PayloadStreamReader:
        return PayloadStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PayloadSource)


def payloads(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A batch of what has landed, of the providers and days that options choose."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def land(requests: DataFrame, path: str, mode: str = "append") -> None:
    """Write requests (provider_code, day and the rest of the schema but file and at) as the zone keeps them."""
    fields = [c for c in requests.columns if c not in ("file", "at")]
    if "since" in fields:
        requests = requests.withColumn("since", F.date_format("since", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    requests.select(*fields).write.mode(mode).partitionBy("provider_code", "day").json(path)
