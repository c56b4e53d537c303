"""Keyed state and the keyed log: what a restart, a replay or a cut-off compaction leaves is what a batch query gives."""

import random
import time

import pytest

from pageline.sources.log import KeyedLog
from pageline.streaming import progress

SCHEMA = "run_id bigint, page_num bigint, id bigint, stage string"


def made(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice((1, 1, 1, 2, None)), rng.randrange(6), i, rng.choice(("call", "assembly", "error", None))) for i in rng.sample(range(n), n)]


def latest(rows):
    out = {}
    for run, page, i, stage in rows:
        if run is not None and i >= out.get((run, page), (-1,))[0]:
            out[run, page] = (i, stage or "")
    return out


def put(spark, rows, path, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def table(spark, path):
    return {(r.run_id, r.page_num): (r.id, r.stage) for r in progress.progress_log(spark, path).current().collect()}


def test_a_restart_in_the_middle_gives_what_batch_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "COMPACT", 2)
    rows = made(120)
    for k in range(5):
        put(spark, rows[k * 24 : (k + 1) * 24], tmp_path / "in", f"part{k}")
    events = stream(spark, str(tmp_path / "in"))
    at = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    with pytest.raises(Exception, match="stopped between batches"):
        # the third batch is written, but its end is not noted: it comes again
        progress.follow(events, **at, batches=2).awaitTermination()
    assert table(spark, at["path"]) != latest(rows)
    progress.follow(stream(spark, str(tmp_path / "in")), **at).awaitTermination()
    assert table(spark, at["path"]) == latest(rows)
    # later events, one of them older than what stands
    more = [(1, 0, 10_000, "call"), (2, 5, -4, "call"), (7, 7, 3, "error")]
    put(spark, more, tmp_path / "in", "part9")
    progress.follow(stream(spark, str(tmp_path / "in")), **at).awaitTermination()
    assert table(spark, at["path"]) == latest(rows + more)


def test_replays_and_compaction_change_nothing(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), SCHEMA, ["run_id", "page_num"], "id")
    assert log.current().count() == 0
    log.compact()
    rows = [r for r in made(90, 2) if r[0]]
    parts = [spark.createDataFrame(rows[k::3], SCHEMA) for k in range(3)]
    want = {(r[0], r[1]): r for r in sorted(rows, key=lambda r: r[2])}

    def now():
        return {(r.run_id, r.page_num): tuple(r) for r in log.current().collect()}

    log.write(parts[0], 0)
    log.write(parts[1], 1)
    half = now()
    log.write(parts[1], 1)
    assert now() == half
    log.compact()
    assert now() == half and log.upto() == 1
    log.write(parts[0], 0)  # a replay of what the snapshot holds
    assert now() == half and not (tmp_path / "log/log/batch=0").exists()
    # a batch that was cut off is not seen, nor a snapshot that was
    log.write(parts[2], 2)
    (tmp_path / "log/log/batch=2/_SUCCESS").unlink()
    assert now() == half
    log.write(parts[2], 2)
    assert now() == want
    log.compact()
    (tmp_path / "log/snapshots/upto=2/_SUCCESS").unlink()
    log.write(parts[0].limit(0), 3)
    log.write(parts[2], 2)
    log.compact()
    assert log.upto() == 3 and sorted(p.name for p in (tmp_path / "log/snapshots").iterdir() if p.name.startswith("upto=3")) == ["upto=3"]


def test_equal_orders_have_one_winner(spark, tmp_path):
    rows = [(1, 1, 5, "a"), (1, 1, 5, "b"), (1, 1, 4, "z"), (1, 2, None, "n"), (1, 2, 0, None)]
    found = []
    for k, cut in enumerate(([rows], [rows[:1], rows[1:]], [rows[1:2], rows[2:], rows[:1]])):
        log = KeyedLog(spark, str(tmp_path / f"log{k}"), SCHEMA, ["run_id", "page_num"], "id")
        for n, part in enumerate(cut):
            log.write(spark.createDataFrame(part, SCHEMA), n)
        found.append(sorted(map(tuple, log.current().collect())))
    assert found[0] == found[1] == found[2] == [(1, 1, 5, "b"), (1, 2, 0, None)]


def test_a_page_that_hears_nothing_is_stalled(spark, tmp_path):
    put(spark, [(1, 1, 1, "call"), (1, 2, 2, "error")], tmp_path / "in", "a")
    at = {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    query = progress.follow(stream(spark, str(tmp_path / "in")), **at, processor=progress.PageState(stall_ms=500))
    got, until = {}, time.monotonic() + 60
    try:
        while time.monotonic() < until and not got.get((1, 1)):
            time.sleep(1)
            got = {(r.run_id, r.page_num): r.stalled for r in progress.progress_log(spark, at["path"]).current().collect()}
    finally:
        query.stop()
    assert got == {(1, 1): True, (1, 2): False}
