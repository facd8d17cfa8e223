"""The landing zone as a data source, in batches and as a stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.plans import ingest as G
from marketloom.sources import landing, schemas

REQUEST = "provider_code string, day date, request_id string, raw_symbol string, asset_class string, timeframe string, row_limit int, payload string"


def requests(spark, days, providers=("ccxt", "alpha_vantage"), per=3):
    rows = [(p, dt.date(2025, 1, d), f"{p} {d} {k}", "BTCUSDT", None, "1h", 10, f"[[{(d * 24 + k) * 3600000},1,2,1,2,5]]") for p in providers for d in days for k in range(per)]
    return spark.createDataFrame(rows, REQUEST)


def ids(df):
    return sorted(r.request_id for r in df.select("request_id").collect())


@pytest.fixture
def zone(spark, tmp_path):
    landing.register(spark)
    path = str(tmp_path / "zone")
    landing.land(requests(spark, (1, 2, 3)), path)
    return path


def read(spark, path, **options):
    return spark.read.format(landing.NAME).options(**options).load(path)


def test_batch(spark, zone):
    every = ids(requests(spark, (1, 2, 3)))
    assert ids(read(spark, zone)) == every and ids(read(spark, "file://" + zone)) == every
    for size in (150, 100_000):
        df = read(spark, zone, pieceBytes=size)
        assert ids(df) == every and df.select("file", "at", "provider_code", "day").distinct().count() == len(every)
    assert read(spark, zone).count() == len(every) and read(spark, zone, pieceBytes=150).rdd.getNumPartitions() > read(spark, zone).rdd.getNumPartitions() == 6
    assert ids(read(spark, zone, provider="ccxt", since="2025-01-02")) == ids(requests(spark, (2, 3), ("ccxt",)))
    with pytest.raises(Exception, match="path"):
        spark.read.format(landing.NAME).load().count()


def test_options_choose_folders(spark, zone):
    one = read(spark, zone, provider="ccxt", since="2025-01-02", until="2025-01-02")
    assert ids(one.where("request_id <> 'ccxt 2 1'")) == ["ccxt 2 0", "ccxt 2 2"] and one.rdd.getNumPartitions() == 1
    assert read(spark, zone, until="2025-01-02").rdd.getNumPartitions() == 4 and read(spark, zone, until="2024-01-02").count() == 0


def test_filters_of_one_use_leave_the_others_alone(spark, zone):
    df = landing.payloads(spark, zone)
    both = df.where("provider_code = 'ccxt' and day = date'2025-01-02'").union(df.where("provider_code = 'alpha_vantage' and day > date'2025-01-02'"))
    assert ids(both) == [f"alpha_vantage 3 {k}" for k in range(3)] + [f"ccxt 2 {k}" for k in range(3)]


def test_odd_lines(spark, tmp_path, zone):
    folder = tmp_path / "zone" / "provider_code=ccxt" / "day=2025-01-09"
    folder.mkdir()
    long = "x" * 300_000
    lines = ['{"request_id": 7, "payload": {"a": [1, null]}, "row_limit": "9", "since": "2025-01-01T00:00:00+01:00"}', "no JSON", "", "[1]", json.dumps({"request_id": "é", "payload": long, "since": "never"}), '{"request_id": null, "since": "2025-01-03"}']
    (folder / "a.json").write_bytes("\r\n".join(lines).encode() + b"\n\xff\xfe")
    (folder / "empty.json").write_bytes(b"")
    (folder / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "zone" / "provider_code=ccxt" / "day=never").mkdir()
    zone_of = lambda size: landing.Zone({"path": zone, "since": "2025-01-01", "pieceBytes": str(size)})
    cut = lambda z: sorted(r[10] for p, d, folder in z.folders(dt.date(2025, 1, 9)) for piece in z.pieces(p, d, z.files(folder)) for r in z.read(piece))
    assert all(len(cut(zone_of(size))) == len(set(cut(zone_of(size)))) == 5 for size in (997, 4096, 65_536))
    for size in (100_000, 1 << 20):
        got = sorted((r.at, r.request_id, r.payload, r.row_limit, r.since) for r in read(spark, zone, pieceBytes=size).where("day = date'2025-01-09'").collect())
        assert [x[1] for x in got] == ["7", None, None, "é", None, None] and [x[2] for x in got] == ['{"a": [1, null]}', "no JSON", "[1]", long, None, "��"]
        assert [x[3] for x in got] == [None] * 6 and got[0][4] == dt.datetime(2024, 12, 31, 23) and got[3][4] is None
    assert read(spark, zone, since="2025-01-02").where("day = date'2025-01-09'").count() == 5  # the first line's since is before
    assert read(spark, str(tmp_path / "nowhere")).count() == 0


def test_every_cut(tmp_path):
    """Wherever a file is cut, each line is read once."""
    folder = tmp_path / "provider_code=p" / "day=2025-01-01"
    folder.mkdir(parents=True)
    lines = [json.dumps({"request_id": "é" * k, "payload": "x" * (k % 5)}, ensure_ascii=False) for k in range(12)]
    (folder / "a.json").write_bytes("\n".join(lines).encode())
    (folder / "b.json").write_bytes(("\r\n".join(lines) + "\n\n").encode())
    for size in range(1, 200):
        z = landing.Zone({"path": str(tmp_path), "pieceBytes": str(size)})
        (p, d, at), = z.folders()
        assert [r[2] for piece in z.pieces(p, d, z.files(at)) for r in z.read(piece)] == ["é" * k for k in range(12)] * 2


def start(spark, zone, tmp_path, sink=None, **options):
    df = spark.readStream.format(landing.NAME).options(**options).load(zone)
    out = df.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    return (out.foreachBatch(sink) if sink else out.format("parquet").option("path", str(tmp_path / "out"))).start()


def test_stream_resumes(spark, zone, tmp_path):
    """A killed stream goes on without loss or repeats, files of an open day and of a new one are found, and so are days that came and went between two runs."""
    kept = []

    def fails(df, batch):
        kept.append(ids(df))
        raise RuntimeError("lost")

    q = start(spark, zone, tmp_path, fails, openDays=2)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(60)
    landing.land(requests(spark, (3, 4), per=1).withColumn("request_id", F.concat("request_id", F.lit(" late"))), zone)
    done = {}

    def keeps(df, batch):
        done[batch] = ids(df)

    def run():
        before = set(done)
        start(spark, zone, tmp_path, keeps, openDays=2).awaitTermination(60)
        return sorted(x for b in set(done) - before for x in done[b])

    assert run() == ids(requests(spark, (1, 2, 3)))  # what the killed batch had planned
    assert run() == sorted(f"{p} {d} 0 late" for p in ("ccxt", "alpha_vantage") for d in (3, 4))
    assert run() == []
    landing.land(requests(spark, (5, 20, 30), ("ccxt",), 1), zone)  # 5 and 20 are behind the window of the newest day
    assert run() == ["ccxt 20 0", "ccxt 30 0", "ccxt 5 0"]
    landing.land(requests(spark, (30, 31), ("new",), 1), zone)
    assert run() == ["new 30 0", "new 31 0"] and run() == []


def test_stream_offsets_stay_small(spark, zone):
    for d in range(1, 29):
        landing.land(requests(spark, (d,), ("ccxt",), 1), zone)
    reader = landing.PayloadStreamReader({"path": zone, "openDays": "3"})
    end = reader.latestOffset()
    assert end["from"] == "2025-01-26" and len(end["files"]) == 3
    assert len(reader.partitions(reader.initialOffset(), end)) == 28 + 3 and reader.partitions(end, end) == []


def test_stream_feeds_ingestion(spark, zone, tmp_path):
    stored = {t: spark.createDataFrame([], schemas.SCHEMAS[t]) for t in ("asset_provider_symbols", "candles")} | {"providers": schemas.providers(spark), "assets": schemas.assets(spark)}
    seen = []
    q = start(spark, zone, tmp_path, lambda df, _: seen.append([(r.request_id, r.action) for r in G.ohlcv(df, stored, F.lit("2025-01-01 00:00:00").cast("timestamp"))["candles"].collect()]), provider="ccxt")
    q.awaitTermination(60)
    assert sorted(seen[0]) == [(f"ccxt {d} {k}", "insert") for d in (1, 2, 3) for k in range(3)] and len(seen) == 1
