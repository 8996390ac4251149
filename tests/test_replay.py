import random
from pathlib import Path

import pytest

from fenceline.operators.leases import PROFILES, Lock, transition
from fenceline.operators.replay import COMMANDS, command, outcome, replay
from fenceline.streaming.replay import replay_stream

OPS = ["ACQUIRE", "RENEW", "RELEASE", "SAVE", "NOOP", "PAUSE", "RESUME", "ORPHAN", "CLEAR_LOCK"]


def log(seed, n=600, jobs=7):
    r = random.Random(seed)
    weights = [6, 5, 4, 3, 1, 0.2, 0.5, 0.3, 0.1]
    return [
        (f"j{r.randrange(jobs)}", i, i * 1_000_000 + r.randrange(3) * 500_000, r.choices(OPS, weights)[0], f"p{i % 3}", r.choice([1, 5, 60]) * 1_000_000, r.choice([None, None, r.randrange(4)]), r.choice([0, 0, 1]), f"c{i}")
        for i in range(n)
    ]


def plain(rows, profile):
    locks, out = {}, []
    for job, seq, at, op, pod, ttl, token, stale, candidate in sorted(rows, key=lambda r: (r[2], r[1])):
        before = locks.get(job, Lock())
        cmd = command(at, op, pod, ttl, token, stale, candidate)
        after, ok = transition(before, cmd, profile)
        out.append(outcome(job, seq, before, after, cmd, ok))
        locks[job] = after
    return sorted(out, key=repr)


@pytest.mark.parametrize("profile", PROFILES)
def test_batch_equals_a_plain_loop(spark, rows, profile):
    commands = log(1)
    assert rows(replay(spark.createDataFrame(commands, COMMANDS), profile)) == plain(commands, profile)


def test_nulls_and_empty(spark):
    broken = [(None, 1, 1, "ACQUIRE", "p", 1, None, 0, "c"), ("j", 2, None, "ACQUIRE", "p", 1, None, 0, "c"), ("j", 3, 1, None, "p", 1, None, 0, "c")]
    assert replay(spark.createDataFrame(broken, COMMANDS)).count() == 0
    bare = [("j", 3, 1, "ACQUIRE", None, None, None, None, None)]
    assert replay(spark.createDataFrame(bare, COMMANDS)).first()["token"] == 1


def test_no_zombie_write_is_accepted(spark):
    """A holder pauses for longer than its lease; another takes over; the first one's write is refused."""
    commands = []
    for i in range(100):
        t = i * 100_000_000
        commands += [
            (f"j{i}", 1, t, "ACQUIRE", "a", 5_000_000, None, 0, "x"),
            (f"j{i}", 2, t + 7_000_000, "ACQUIRE", "b", 30_000_000, None, 0, "y"),
            (f"j{i}", 3, t + 8_000_000, "SAVE", "a", None, 1, 0, None),
            (f"j{i}", 4, t + 9_000_000, "SAVE", "b", None, 2, 0, None),
        ]
    saves = replay(spark.createDataFrame(commands, COMMANDS)).filter("op = 'SAVE'").collect()
    assert sum(r["ok"] for r in saves) == 100 and all(r["ok"] == (r["given"] == 2) for r in saves)


def test_stream_equals_batch_over_a_restart(spark, tmp_path: Path):
    commands = sorted(log(3, 300), key=lambda r: (r[2], r[1]))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in (commands[:140], commands[140:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(COMMANDS).parquet(source)
        query = replay_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=repr) == plain(commands, "as_built")
