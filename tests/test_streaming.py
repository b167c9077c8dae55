"""Streamed sightings against a plain replay: growing parts, batches run again, cost that follows the batch."""

import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from resight.streaming.sightings import read_state, start_ingest

KIND = "job_id int, run_id string, observed_at timestamp_ntz, arrival bigint, title string"


class Ingest:
    def __init__(self, spark, folder: Path, part_rows: int):
        self.spark, self.folder, self.part_rows = spark, folder, part_rows
        self.root = f"file://{folder}/out"

    def put(self, rows):
        self.spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"file://{self.folder}/in")

    def run(self):
        stream = self.spark.readStream.schema(KIND).parquet(f"file://{self.folder}/in")
        start_ingest(stream, self.root, ["title"], f"file://{self.folder}/check", part_rows=self.part_rows).awaitTermination()

    def state(self):
        return {r.job_id: (r.title, r.first_seen, r.last_seen, r.seen_count) for r in read_state(self.spark, self.root).collect()}

    def parts(self, table, batch):
        return {tuple(p.relative_to(self.folder / "out" / table / f"batch-{batch}").parts) for p in (self.folder / "out" / table / f"batch-{batch}").glob("depth=*/part=*")}


def plain(batches):
    """The same in a loop over rows: what was seen by run or time doesn't count again."""
    runs, times, state = set(), set(), {}
    for rows in batches:
        rows = [r for r in sorted(rows, key=lambda r: r[3]) if r[0] is not None]
        one, two = {}, {}
        for r in rows:
            one.setdefault((r[0], r[1]), r)
        for r in one.values():
            two.setdefault((r[0], r[2]), r)
        fresh = [r for r in two.values() if (r[0], r[1]) not in runs and (r[0], r[2]) not in times]
        for r in rows:
            title, low, high, n = state.get(r[0], (None, r[2], None, 0))
            state[r[0]] = (r[4], min(low, r[2]), high, n)
        for r in fresh:
            title, low, high, n = state[r[0]]
            state[r[0]] = (title, low, r[2] if high is None else max(high, r[2]), n + 1)
            runs.add((r[0], r[1]))
            times.add((r[0], r[2]))
    return state


def drawn(rng, n, ids, at):
    """Rows of which a third are of one id."""
    start = datetime(2024, 1, 1)
    return [(1 if rng.random() < 0.33 else rng.randrange(ids), f"r{rng.randrange(40)}", start + timedelta(hours=rng.randrange(200)), at + i, f"t{rng.randrange(9)}") for i in range(n)]


def test_ingest_splits_its_parts_and_gives_the_plain_state(spark, tmp_path):
    rng = random.Random(4)
    ingest, batches = Ingest(spark, tmp_path, 16), []
    for k, n in enumerate((30, 200, 5, 120)):
        rows = drawn(rng, n, 90, 1000 * k)
        if k == 1:
            rows.append((None, "r1", datetime(2024, 1, 1), 1999, "no id"))
        ingest.put(rows)
        ingest.run()
        batches.append(rows)
        assert ingest.state() == plain(batches)
    depths = [max(int(p[0].split("=")[1]) for p in ingest.parts("runs", k)) for k in (0, 1)]
    assert depths[1] > depths[0]  # as the table grew
    assert len(ingest.parts("runs", 2)) < len(ingest.parts("runs", 1))
    # the last batch once more, as after a loss before its commit
    (tmp_path / "check" / "commits" / "3").unlink()
    (tmp_path / "check" / "commits" / ".3.crc").unlink(missing_ok=True)
    ingest.run()
    assert ingest.state() == plain(batches)
    kept = spark.read.parquet(f"{ingest.root}/sightings")
    assert kept.count() == sum(s[3] for s in plain(batches).values())


def test_lists_of_parts_are_written_whole_now_and_then(spark, tmp_path, monkeypatch):
    from resight.streaming import parts

    monkeypatch.setattr(parts, "FULL_EVERY", 2)
    rng = random.Random(5)
    ingest, batches = Ingest(spark, tmp_path, 16), []
    for k in range(3):
        batches.append(drawn(rng, 25, 60, 1000 * k))
        ingest.put(batches[-1])
        ingest.run()
    assert ingest.state() == plain(batches)


@pytest.mark.parametrize("first", [2_000, 20_000])
def test_a_batch_reads_and_writes_the_parts_of_its_keys(spark, tmp_path, first):
    """What a batch of twenty rows touches doesn't depend on the tenfold history."""
    ingest = Ingest(spark, tmp_path, 250)
    start = datetime(2020, 1, 1)
    ingest.put([(i, "r0", start + timedelta(minutes=i), i, "t") for i in range(first)])
    ingest.run()
    ingest.put([(i * 97, "r1", start - timedelta(minutes=i + 1), first + i, "u") for i in range(20)])
    began = time.perf_counter()
    ingest.run()
    print(first, round(time.perf_counter() - began, 2), "s")
    assert len(ingest.parts("state", 0)) >= first // 500
    for table in ("state", "runs", "times"):
        # a part that is split is written as two
        assert 1 <= len(ingest.parts(table, 1)) <= 40
    written = spark.read.parquet(f"{ingest.root}/state/batch-1").count()
    assert written <= 20 * 2 * 250
    state = ingest.state()
    assert len(state) == first and state[97][3] == 2 and state[97][0] == "u"
