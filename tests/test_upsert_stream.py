import random

from fenceline.streaming.checkpoints import EVENTS, upsert_stream


def plain(events):
    current, rows, out = {}, {}, []
    for job, seq, at, token, run, stage, *_ in sorted(events, key=lambda e: (e[2], e[1])):
        if stage is None:
            current[job] = max(token, current.get(job, token))
            continue
        key = (job, run, stage)
        verdict = "fenced" if job in current and token != current[job] else "kept" if rows.get(key, token) > token else "stored"
        if verdict == "stored":
            rows[key] = token
        out.append((seq, verdict))
    return sorted(out)


def test_writes_are_judged_over_a_restart(spark, tmp_path):
    r = random.Random(7)
    tokens = {"a": 1, "b": 1, "c": 1}
    events = []
    for n in range(240):
        job = r.choice("abc")
        if r.random() < 0.2 and job != "c":  # of c no token of the lock is ever seen
            tokens[job] += 1
            events.append((job, n, n, tokens[job], None, None, None, None))
        else:
            events.append((job, n, n, max(1, tokens[job] - r.choice([0, 0, 0, 1, 2]) + (r.choice([0, 2]) if job == "c" else 0)), r.choice("xy"), r.choice(["s", "t"]), "COMPLETE", str(n)))
    events += [(None, 900, 1, 1, "x", "s", None, None), ("a", 901, None, 1, "x", "s", None, None), ("a", 902, 1, None, "x", "s", None, None)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in (events[:100], events[100:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = upsert_stream(spark.readStream.schema(EVENTS).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted((r["seq"], r["verdict"]) for r in spark.read.parquet(out).collect())
    assert got == plain(events[:240]) and {v for _, v in got} == {"stored", "fenced", "kept"}
