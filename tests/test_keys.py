from uuid import UUID

from pyspark.sql import functions as F

from fenceline.functions import keys


def one(spark, schema, values, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_clean_name(spark):
    got = one(spark, "a string", [(" \tJob-A \t",), ("  ",), (None,), ("",)], keys.clean_name("a"))
    assert got == [("job-a",), (None,), (None,), (None,)]


def test_run_key_is_the_uuid_however_written(spark):
    u = "00003844-e304-4033-a05c-c68c49b31d5c"
    forms = [u, u.upper(), "{" + u + "}", u.replace("-", ""), f" {u}\t"]
    got = one(spark, "a string", [(x,) for x in forms], keys.run_key("a"), keys.run_text("a"))
    assert {bytes(k) for k, _ in got} == {UUID(u).bytes}
    assert {t for _, t in got} == {u.replace("-", "")}


def test_run_key_of_other_text(spark):
    got = one(spark, "a string", [("n/a",), ("N/A ",), ("",), (None,), ("zz" * 16,)], keys.run_key("a"), keys.run_text("a"))
    assert got[0] == got[1] and got[0][1] == "t:n/a"
    assert got[2] == got[3] == (None, None)
    assert got[4][1] == "t:" + "zz" * 16 and len(got[4][0]) > 16


def test_idempotency_key_survives_a_takeover(spark):
    values = [("run-1", 5, "cust-003"), ("run-1", 6, "cust-003"), (None, 6, "cust-003")]
    key = keys.idempotency_key(keys.stable_id(F.col("r"), F.col("t")), F.col("i"))
    got = one(spark, "r string, t long, i string", values, key)
    assert got == [("fl_run-1_cust-003",), ("fl_run-1_cust-003",), ("fl_6_cust-003",)]
    with_method = one(spark, "r string, t long, i string", values[:1], keys.idempotency_key(F.col("r"), F.col("i"), F.lit("C.m"), "x"))
    assert with_method == [("x_run-1_cust-003_C.m",)]


def test_headers_and_composed_keys(spark):
    got = one(spark, "a string, b string", [("k", "s"), (None, "s")], keys.key_headers(F.col("a")), keys.stage_key("a", "b"), keys.run_stage_key("a", "b"))
    assert got[0] == ({"Idempotency-Key": "k", "X-Idempotency-Key": "k"}, "k.s", "k#s")
    assert got[1][0] is None


def test_progress_documents(spark):
    texts = ['{"lastId":"b"}', '{"lastId":"b","state":2,"stateType":"long"}', '{"lastId":null,"state":10}', '{"lastId":"b","st', '"batch"', None, ""]
    got = one(spark, "a string", [(t,) for t in texts], keys.parse_progress("a"))
    assert [tuple(g[0]) if g[0] else None for g in got] == [("b", None, None), ("b", "2", "long"), (None, "10", None), None, None, None, None]
    written = one(spark, "a string, b long", [("x", 3), (None, None)], keys.progress_json(F.col("a"), F.col("b"), F.lit("long")), keys.progress_json(F.col("a")))
    assert written == [('{"lastId":"x","state":3,"stateType":"long"}', '{"lastId":"x"}'), ('{"lastId":null,"state":null,"stateType":"long"}', '{"lastId":null}')]


def test_blocks_and_times(spark):
    got = spark.sql("select timestamp_ntz'2025-01-08 00:00:00.123' a, timestamp_ntz'1969-12-31 23:59:59' b").select(keys.time_text("a"), keys.block_of("a", 1), keys.block_of("b", 1)).first()
    assert tuple(got) == ("2025-01-08 00:00:00.123", 20096, -1)
