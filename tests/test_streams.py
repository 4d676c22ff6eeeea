"""Ingestion that is stopped and resumed, deliveries read by connectors, gaps and sessions as streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallywright.operators import ingest
from tallywright.plans import streams
from tallywright.sources import deliveries, files, paged
from tallywright.streaming import evolving, ingestion, sessions

SF = "/root/testdata/sf0.001"


def job(tmp_path) -> ingestion.Job:
    return ingestion.Job(f"file://{tmp_path}/ingest", streams.FIELDS, streams.checks, streams.KNOWN)


def everything(spark, j):
    staged = sorted(map(str, ingestion.staging(spark, j).drop("raw_ref").collect()))
    refused = sorted(str((r.record_id, r.why, sorted(r.payload.items()))) for r in ingestion.quarantine(spark, j).collect())
    return staged, refused, ingestion.summary(spark, j).first()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return streams.deliver(spark, SF, f"file://{tmp_path_factory.mktemp('delivered')}/csv")


@pytest.fixture(scope="module")
def whole(spark, folder, tmp_path_factory):
    j = job(tmp_path_factory.mktemp("whole"))
    ingestion.start(streams.delivered_stream(spark, folder), j).awaitTermination()
    return everything(spark, j)


@pytest.mark.parametrize("moment", ["rows written", "run written"])
def test_a_stopped_run_goes_on_without_loss_or_copies(spark, folder, whole, tmp_path, moment):
    j, failed = job(tmp_path), set()

    def fail_at(step, number):
        if step == moment and number % 2 and number not in failed:
            failed.add(number)
            raise RuntimeError("stopped")

    for _ in range(9):
        try:
            ingestion.start(streams.delivered_stream(spark, folder), j, fail_at).awaitTermination()
            break
        except Exception as e:
            assert "stopped" in str(e)
    assert len(failed) >= 2
    assert everything(spark, j) == whole
    read = whole[2].records_read
    assert read == 1000 and read == len(whole[0]) + len(whole[1])


def test_what_comes_later_is_read_later(spark, folder, whole, tmp_path):
    j = job(tmp_path)
    more = f"file://{tmp_path}/more"
    one = spark.createDataFrame([("7001", "2024-01-02T00:00:00Z", "3", " A ", "4", 1)], "check_id string, occurred_at string, location_id string, sku string, observed_quantity string, delivery int")
    deliveries.write_csv(one, more, "delivery")
    ingestion.start(streams.delivered_stream(spark, more), j).awaitTermination()
    assert ingestion.runs(spark, j).count() == 1 and ingestion.quarantine(spark, j) is None
    assert ingestion.summary(spark, j).first().outcome == "succeeded"
    deliveries.write_csv(one.withColumn("check_id", F.lit("")), more, "delivery", ";")
    ingestion.start(streams.delivered_stream(spark, more), j).awaitTermination()
    ingestion.start(streams.delivered_stream(spark, more), j).awaitTermination()
    runs = sorted(map(tuple, ingestion.runs(spark, j).collect()))
    assert [r[1:4] for r in runs] == [(1, 1, 0), (1, 0, 1)]
    assert ingestion.staging(spark, j).select("id", "product", "place", "quantity", "mapping_version").first()[:] == ("7001", "a", "3", 4, 1)
    (bad,) = ingestion.quarantine(spark, j).collect()
    assert bad.why == ["missing_required:check_id"] and bad.record_id == runs[1][4] and bad.raw_ref


def test_one_pass_writes_both(spark, folder, tmp_path):
    """A batch's rows are read once, and its counts come from the same job."""
    batch = files.csv_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    j = job(tmp_path)
    ingestion.write_batch(batch.mapInPandas(counted, batch.schema), 0, j)
    assert seen.value == 1000 == ingestion.runs(spark, j).first().records_read


def test_mapping_versions_are_kept_with_rejections(spark, folder, tmp_path):
    mapping = ingest.Mapping(streams.KNOWN.columns, streams.KNOWN.transforms, streams.KNOWN.required, 7)
    j = ingestion.Job(f"file://{tmp_path}/ingest", streams.FIELDS, streams.checks, mapping)
    ingestion.start(streams.delivered_stream(spark, folder), j).awaitTermination()
    assert {r[0] for r in ingestion.quarantine(spark, j).select("mapping_version").distinct().collect()} == {7}


# -- pages


def recorded(path, pages: dict) -> str:
    for key, document in pages.items():
        (path / f"page={key}").mkdir(parents=True)
        (path / f"page={key}" / "part-0").write_text(document if isinstance(document, str) else json.dumps(document))
        (path / f"page={key}" / "_SUCCESS").write_text("")
    return str(path)


def read(spark, path, **options):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("tallywright_pages").options(path=path, **options).load()


def numbered(n, start=0):
    return {"data": [{"id": f"r{start + i}"} for i in range(n)]}


def test_numbered_pages_end_with_the_first_empty_one(spark, tmp_path):
    pages = {i: numbered(3, 3 * i) for i in range(1, 24)} | {24: {"data": []}}
    df = read(spark, recorded(tmp_path / "a", pages), pages_per_task=5)
    assert df.rdd.getNumPartitions() == 5
    assert sorted(int(r.record_id[1:]) for r in df.collect()) == list(range(3, 72))
    assert read(spark, recorded(tmp_path / "b", {1: {"data": []}})).count() == 0
    assert read(spark, str(tmp_path / "nowhere")).count() == 0
    assert [paged.Pages(recorded(tmp_path / f"n{n}", {i + 1: numbered(1) for i in range(n)})).last_number() for n in (0, 1, 2, 3, 4, 7, 8, 9)] == [0, 1, 2, 3, 4, 7, 8, 9]


def test_cursors_are_followed_until_one_comes_again(spark, tmp_path):
    pages = {"first": {"out": {"rows": [{"k": {"n": 1}}], "next": "b"}}, "b": {"out": {"rows": [{"k": {"n": 2}}, 5, "x"], "next": 7}}, "7": {"out": {"rows": [{"k": {}}], "next": "b"}}, "lost": {"out": {"rows": [{"k": {"n": 9}}]}}}
    options = {"style": "cursor", "records_path": "out.rows", "cursor_path": "out.next", "id_field": "k.n"}
    rows = read(spark, recorded(tmp_path / "a", pages), **options).collect()
    nameless = f"sha256:{hashlib.sha256(b'{"k":{}}').hexdigest()}"
    assert sorted((r.page, r.place, r.record_id) for r in rows) == [("7", 0, nameless), ("b", 0, "2"), ("first", 0, "1")]


def test_identity_doesnt_depend_on_the_order_of_keys(spark, tmp_path):
    pages = {"1": '{"data":[{"b":{"y":1,"x":"ü"},"a":[1,{"d":2,"c":3}]},{"a":[1,{"c":3,"d":2}],"b":{"x":"ü","y":1}},{"a":[{"c":3,"d":2},1],"b":{"x":"ü","y":1}}]}'}
    got = [r.record_id for r in sorted(read(spark, recorded(tmp_path / "a", pages), style="single").collect(), key=lambda r: r.place)]
    assert got[0] == got[1] != got[2]


def test_a_stream_of_pages_resumes_by_its_offset(spark, tmp_path):
    top = tmp_path / "pages"
    recorded(top, {i: numbered(2, 2 * i) for i in range(1, 4)})
    spark.dataSource.register(paged.PagedSource)

    def run():
        stream = spark.readStream.format("tallywright_pages").options(path=str(top)).load()
        out = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.record_id[1:]) for r in spark.read.schema(paged.SCHEMA).parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(2, 8))
    assert run() == list(range(2, 8))
    recorded(top, {i: numbered(2, 2 * i) for i in range(4, 9)} | {9: {"data": []}})
    assert run() == list(range(2, 18))


def test_wrong_options(spark, tmp_path):
    with pytest.raises(Exception, match="style"):
        read(spark, str(tmp_path), style="guess").count()
    with pytest.raises(Exception, match="path"):
        spark.read.format("tallywright_pages").load().count()


def test_ranks_dont_depend_on_how_partitions_are_joined(spark):
    """The counts alone fit into one partition, the rows don't."""
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        wide = F.concat(*[F.sha2(F.concat(F.lit(f"{i}-"), "id"), 512) for i in range(16)])
        rows = spark.range(400).select((F.col("id") * 7919 % 400).alias("k"), wide.alias("item"))
        got = deliveries.ranked(rows, ["k"]).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert sorted((r.k, r.rank) for r in got) == [(k, k) for k in range(400)]


@pytest.mark.parametrize("style", ["page_number", "cursor"])
def test_all_pages_are_found_however_many(style, monkeypatch):
    n = 12_345
    name = lambda k: "first" if style == "cursor" and k == 1 else str(k)
    documents = {name(k): {"data": [{"id": k}], "next": k + 1 if k < n else None} for k in range(1, n + 1)}
    monkeypatch.setattr(paged.Pages, "document", lambda self, key: documents.get(key))
    assert paged.Pages("nowhere", style).keys() == list(documents)


# -- gaps as state


def findings(spark, rows):
    return spark.createDataFrame(rows, "dedupe_key string, at string, ordinal long, observed double").select("dedupe_key", F.col("at").cast("timestamp").alias("run_at"), "ordinal", "observed")


def deliver_findings(spark, tmp_path, rows):
    findings(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")


def follow(spark, tmp_path, stale=3 * 86400):
    stream = spark.readStream.schema(streams.FINDING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/runs")
    evolving.keep_up(evolving.changes(stream, stale, "1 day"), str(tmp_path))
    told = spark.read.schema(evolving.CHANGE).parquet(f"{tmp_path}/changes").collect()
    now = {r.dedupe_key: (r.first_seen.day, r.last_seen.day, r.updates, r.observed, r.stale) for r in evolving.gaps(spark, str(tmp_path)).collect()}
    return now, {k: [r.change for r in sorted(told, key=lambda r: r.sequence) if r.dedupe_key == k] for k in now}


def test_a_gap_evolves_over_batches_and_a_restart(spark, tmp_path):
    deliver_findings(spark, tmp_path, [("a", "2024-01-02", 1, 0.1), ("a", "2024-01-02", 2, 0.2), ("b", "2024-01-02", 1, 0.5), ("c", "2024-01-02", 1, None)])
    deliver_findings(spark, tmp_path, [("a", "2024-01-03", 1, 0.3), ("b", "2024-01-03", 1, 0.6)])
    now, told = follow(spark, tmp_path)
    assert now == {"a": (2, 3, 2, 0.3, False), "b": (2, 3, 1, 0.6, False), "c": (2, 2, 0, None, False)}
    assert told["a"] == ["created", "updated"] and told["c"] == ["created"]
    # after a restart: the state is there, and a finding of an earlier run doesn't take the measurement back
    deliver_findings(spark, tmp_path, [("a", "2024-01-02 12:00:00", 1, 0.9), ("b", "2024-01-03", 1, 0.7)])
    now, told = follow(spark, tmp_path)
    assert now["a"] == (2, 3, 3, 0.3, False) and now["b"] == (2, 3, 2, 0.7, False)
    assert follow(spark, tmp_path)[0] == now


def test_silence_makes_a_gap_stale_and_a_finding_revives_it(spark, tmp_path):
    for day, keys in ((2, "ab"), (4, "a"), (8, "a"), (9, "a"), (10, "ab")):
        deliver_findings(spark, tmp_path, [(k, f"2024-01-{day:02d}", 1, day / 10) for k in keys])
    now, told = follow(spark, tmp_path)
    assert now == {"a": (2, 10, 4, 1.0, False), "b": (2, 10, 1, 1.0, False)}
    assert told["b"] == ["created", "stale", "updated"]
    deliver_findings(spark, tmp_path, [("a", "2024-01-20", 1, 2.0)])
    now, told = follow(spark, tmp_path)
    assert now["b"] == (2, 10, 1, 1.0, True) and not now["a"][4]
    assert told["b"] == ["created", "stale", "updated", "stale"]


# -- late rows and sessions


def test_late_rows_and_sessions_over_restarts(spark, tmp_path):
    top, delay, gap = str(tmp_path), "2 hours", "1 hour"

    def come(*rows):
        data = spark.createDataFrame([(i, u, t) for i, u, t in rows], "event_id long, user_id long, t string")
        data.select("event_id", "user_id", F.col("t").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(f"{top}/events")

    def go():
        stream = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{top}/events")
        sessions.split(stream, top, "at", delay)
        sessions.sessions(spark, top, streams.EVENT, "user_id", "at", delay, gap)
        found = [(r.user_id, r.started_at.hour, r.ended_at.hour, r.n) for r in spark.read.parquet(f"{top}/sessions").collect()] if (tmp_path / "sessions").exists() and any((tmp_path / "sessions").glob("*.parquet")) else []
        return sorted(found), sorted(r.event_id for r in sessions.rows(spark, top, streams.EVENT, True).collect())

    day = "2024-01-01 "
    come((1, 1, day + "01:00:00"), (2, 1, day + "01:30:00"), (3, 2, day + "02:00:00"))
    come((4, 1, day + "05:00:00"), (5, 1, day + "02:20:00"), (6, 3, None))
    assert go() == ([], [6]) or go()[1] == [6]
    come((7, 2, day + "02:30:00"), (8, 2, day + "09:00:00"), (9, 1, day + "03:00:00"))
    found, late = go()
    assert late == [6, 7]  # 03:00 is no more than two hours behind 05:00
    assert go() == (found, late)
    sessions.close(spark, top, streams.EVENT, "user_id", "at", delay, gap)
    found, late = go()
    assert found == [(1, 1, 3, 4), (1, 5, 5, 1), (2, 2, 2, 1), (2, 9, 9, 1)]
    assert sum(n for *_, n in found) + len(late) == 9


def test_a_batch_is_many_tasks_work_and_its_sessions_are_whole(spark, tmp_path):
    """The parts of a batch lie further apart than the delay; none is late for another."""
    top, n = str(tmp_path), 300
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("at"))
    rows.repartitionByRange(3, F.col("event_id").desc()).write.parquet(f"{top}/events")
    sessions.split(spark.readStream.schema(streams.EVENT).parquet(f"{top}/events"), top, "at", "2 hours")
    assert len(list((tmp_path / "rows" / "batch=0" / "late=false").glob("*.parquet"))) == 3
    sessions.sessions(spark, top, streams.EVENT, "user_id", "at", "2 hours", "1 hour")
    sessions.close(spark, top, streams.EVENT, "user_id", "at", "2 hours", "1 hour")
    sessions.sessions(spark, top, streams.EVENT, "user_id", "at", "2 hours", "1 hour")
    found = spark.read.parquet(f"{top}/sessions").collect()
    assert len(found) == n and sum(r.n for r in found) == n  # seven hours between a user's events


def test_a_gap_asks_the_store_once_a_batch():
    """Each call to the store is a message to another process; a key's findings need one to read and one to write."""
    from pyspark.sql import Row

    class Store:
        def __init__(self):
            self.value, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    gap, timers = evolving.EvolvingGap(10), []
    gap.gap = store = Store()
    gap.handle = type("Handle", (), {"registerTimer": lambda self, t: timers.append(t), "deleteTimer": lambda self, t: timers.remove(t)})()
    (made,) = gap.handleInputRows(("k",), iter([Row(at=1000, ordinal=1, observed=0.5), Row(at=3000, ordinal=1, observed=float("nan"))]), None)
    (moved,) = gap.handleInputRows(("k",), iter([Row(at=2000, ordinal=1, observed=0.7)]), None)
    assert (made.change, made.updates, made.observed, moved.change, moved.last_seen, moved.updates, moved.observed) == ("created", 1, None, "updated", 3000, 2, None)
    assert store.calls == ["get", "update"] * 2 and len(timers) == 1
