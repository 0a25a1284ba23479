import json

import pytest
from pyspark.sql import functions as F

from dialoom.operators import inference as inf
from dialoom.operators import reports, rounds
from dialoom.schema import with_result_columns


def test_messages_leave_out_an_empty_system(spark):
    df = spark.createDataFrame([("t", "s"), ("t", ""), ("t", None)], "text string, sys string")
    shots = [{"role": "assistant", "content": "a"}]
    got = [[(m.role, m.content) for m in r[0]] for r in df.select(inf.build_messages("text", F.col("sys"), shots)).collect()]
    assert got == [[("system", "s"), ("assistant", "a"), ("user", "t")]] + [[("assistant", "a"), ("user", "t")]] * 2


@pytest.mark.parametrize(
    ("status", "message", "expected"),
    [
        (429, "x", "backpressure"), (503, "x", "backpressure"), (500, "x", "other"),
        (400, "INVALID parameter x", "stop"), (400, "other", "other"), (None, "reset", "none"), (400, None, "other"),
    ],
)
def test_retry_classes(spark, status, message, expected):
    df = spark.createDataFrame([(status, message)], "s int, m string")
    assert df.select(inf.retry_class("s", "m")).first()[0] == expected
    error = inf.CallError(status, "e", json.dumps({"message": message})) if status else ValueError(message)
    assert inf.RetryPolicy().kind(error) == expected


def test_retries_stop_at_their_limits():
    for status, limit in ((429, 4), (500, 2)):
        calls, waits = [], []

        def predict(messages, status=status, calls=calls):
            calls.append(1)
            raise inf.CallError(status, "no")

        with pytest.raises(inf.CallError):
            inf.call_with_retries([], predict, inf.RetryPolicy(4, 2), waits.append)
        assert len(calls) == limit and len(waits) == limit - 1 and all(0 <= w <= 60 for w in waits)


def test_other_errors_are_not_retried():
    calls = []

    def predict(messages):
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        inf.call_with_retries([], predict, inf.RetryPolicy(), pytest.fail)
    assert calls == [1]


def test_continuations_are_joined_and_summed():
    seen = []

    def predict(messages):
        seen.append([m["content"] for m in messages])
        return inf.Reply("x" * 60 if len(seen) < 3 else "end", "length" if len(seen) < 3 else "stop", 1, 2, 3)

    reply = inf.answer([{"role": "user", "content": "go"}], predict)
    assert reply.content == "x" * 120 + "end" and (reply.prompt_tokens, reply.total_tokens) == (3, 9)
    assert seen[2][-1].startswith("The previous response ended with: '" + "x" * 50 + "'") and len(seen[2]) == 5


def test_batch_infer_gives_a_row_for_every_request(spark):
    def predict(messages):
        text = messages[-1]["content"]
        if text == "fail":
            raise inf.CallError(500, "Server Error", "x" * 600)
        if text == "bad":
            return inf.Reply({"not": "text"})
        return inf.Reply([{"type": "text", "text": text.upper()}, {"type": "reasoning", "text": "no"}], "stop", 1, 1, 2)

    rows = [(1, "a"), (2, "fail"), (3, "bad"), (4, "b")]
    requests = spark.createDataFrame(rows, "input_file_number int, t string").select("input_file_number", inf.build_messages("t").alias("messages"))
    policy = inf.RetryPolicy(1, 1)
    got = {r.input_file_number: r for r in inf.batch_infer(requests, predict, partitions=2, policy=policy).collect()}
    assert got[1].result_content == "A" and got[4].result_total_tokens == 2 and got[1].result_processing_time_seconds >= 0
    assert got[2].result_error == "Server Error\nResponse details: " + "x" * 500 and got[2].result_content is None
    assert got[3].result_error == "Unexpected content format: dict"
    none = inf.batch_infer(requests.limit(0), predict)
    assert none.collect() == []


def test_distinct_requests_are_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    def predict(messages):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return messages[-1]["content"] + "!"

    from dialoom.session import materialize

    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "input_file_number int, t string")
    requests = df.select("input_file_number", inf.build_messages("t").alias("messages"))
    out = inf.infer_distinct(requests, lambda r, key: materialize(inf.batch_infer(r, predict, key=key)))
    got = {r.input_file_number: r.result_content for r in out.collect()}
    assert got == {i: ("same!" if i % 3 else f"t{i}!") for i in range(30)}
    assert len(list(tmp_path.iterdir())) == 11


def test_distinct_requests_are_dealt_by_rows(spark):
    """Short requests went into one task, whatever the time that their calls take."""
    df = spark.range(40).selectExpr("cast(id AS int) AS input_file_number", "'t' || id AS t")
    tasks = []

    def infer(unique, key):
        tasks.append(unique.rdd.getNumPartitions())
        return inf.batch_infer(unique, lambda m: m[-1]["content"], key=key).localCheckpoint()

    out = inf.infer_distinct(df.select("input_file_number", inf.build_messages("t").alias("messages")), infer)
    assert tasks == [4] and {r.input_file_number: r.result_content for r in out.collect()} == {i: f"t{i}" for i in range(40)}


def test_parse_content(spark):
    texts = ["plain", '[{"type":"text","text":"a"},{"type":"x","text":"b"},{"type":"text","text":"c"}]', "[]", "[not json", None, "[1] note"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", inf.parse_content("t")).orderBy("i").collect()] == ["plain", "ac", "", "[not json", None, "[1] note"]


def test_render_prompt(spark):
    common = spark.createDataFrame([("rules", "be {tone} in {comment_lang}"), ("few", "common")], "key string, text string")
    custom = spark.createDataFrame([("few", "custom"), ("system_message", "Do:\n${rules}")], "key string, text string")
    got = {r.key: r.text for r in inf.render_prompt(custom, common, {"comment_lang": "French"}).collect()}
    assert got == {"rules": "be {tone} in French", "few": "custom", "system_message": "Do:\nbe {tone} in French"}


def test_rounds_keep_the_last_attempt(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.7), (3, 0.0)], "id int, base double").withColumn("overall_score", F.lit(0.0))
    out = rounds.rounds(df, lambda rows, n: rows.withColumn("overall_score", F.col("base") + 0.3 * (n - 1)), max_rounds=2)
    got = {r.id: (r.attempts, r.accepted, round(r.overall_score, 1)) for r in out.collect()}
    assert got == {1: (1, True, 0.9), 2: (2, True, 1.0), 3: (2, False, 0.3)}


def scripts(spark, codes):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "input_file_number int, result_content string")
    return with_result_columns(rows)


def test_check_and_fix_repairs_only_failing_rows(spark):
    def predict(messages):
        assert "error" in messages[0]["content"].lower()
        return "x = 1" if messages[-1]["content"] == "def (" else "def ("

    df = scripts(spark, ["def (", "y = 2", "spark.sql('SELEC')"])
    got = {r.input_file_number: r for r in rounds.check_and_fix(df, predict).collect()}
    assert got[0].result_content == "x = 1" and got[0].result_python_parse_error is None
    assert got[1].result_content == "y = 2" and got[1].result_sql_parse_errors == []
    assert got[2].result_content == "def (" and got[2].result_python_parse_error is not None
    twice = {r.input_file_number: r for r in rounds.check_and_fix(df, predict, max_attempts=2).collect()}
    assert twice[2].result_content == "x = 1" and twice[2].result_python_parse_error is None
    assert rounds.check_and_fix(df, predict, max_attempts=0) is df


def test_check_and_fix_stops_when_clean(spark):
    def predict(messages):
        raise AssertionError("not asked")

    out = rounds.check_and_fix(scripts(spark, ["x = 1"]), predict, max_attempts=3)
    assert reports.error_count(out) == 0 and out.first().result_error is None


def test_a_hanging_call_becomes_an_error_row(spark):
    import time

    def predict(messages):
        if messages[-1]["content"] == "hang":
            time.sleep(30)
        return "fine"

    rows = spark.createDataFrame([(1, "hang"), (2, "go")], "input_file_number int, text string")
    requests = rows.select("input_file_number", inf.build_messages("text").alias("messages"))
    began = time.monotonic()
    got = {r.input_file_number: r for r in inf.batch_infer(requests, predict, policy=inf.RetryPolicy(call_seconds=0.5)).collect()}
    assert time.monotonic() - began < 25
    assert got[1].result_error == "no answer within 0.5 seconds" and got[2].result_content == "fine"


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    """The worker dies after half its calls; the run started again asks for the other half only."""
    import os

    log, folder = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    rows = [(i, [{"role": "user", "content": f"text {i}"}]) for i in range(40)]
    requests = spark.createDataFrame(rows, "input_file_number long, messages array<struct<role:string,content:string>>")

    def predict(messages, dies):
        if dies and len(list(log.iterdir())) >= 20:
            os._exit(1)
        (log / f"{messages[-1]['content']} {os.urandom(4).hex()}").write_text("")
        if messages[-1]["content"] == "text 7":
            raise inf.CallError(400, "Bad Request", '{"message": "invalid format"}')
        return messages[-1]["content"].upper()

    ask = lambda dies: inf.batch_infer(requests, lambda m: predict(m, dies), 1, 1, answers=folder, buckets=4)
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        ask(True).collect()
    assert len(list(log.iterdir())) == 20
    for path in (tmp_path / "answers").iterdir():
        (path / "torn.part").write_text("{")
    got = {r.input_file_number: (r.result_content, r.result_error) for r in ask(False).collect()}
    assert got == {i: (f"TEXT {i}", None) for i in range(40) if i != 7} | {7: (None, got[7][1])} and "Bad Request" in got[7][1]
    asked = [p.name.rsplit(" ", 1)[0] for p in log.iterdir()]
    assert sorted(asked) == sorted(f"text {i}" for i in range(40))
    # Once more: nothing is asked; a changed request is.
    assert ask(True).count() == 40 and len(list(log.iterdir())) == 40


def test_answers_of_a_bucket_are_one_local_file(spark, tmp_path):
    rows = [(i, [{"role": "user", "content": f"text\u2028{i}"}]) for i in range(300)]
    requests = spark.createDataFrame(rows, "input_file_number long, messages array<struct<role:string,content:string>>")
    ask = lambda call: inf.batch_infer(requests, call, 1, 4, answers=str(tmp_path), buckets=2).collect()
    first = ask(lambda m: m[-1]["content"] + "\n")
    assert sorted(len(list(d.iterdir())) for d in tmp_path.iterdir()) == [1, 1]
    # A last line without its end is torn.
    for folder in tmp_path.iterdir():
        (folder / "torn.json").write_text('["a", [')
    assert ask(lambda m: "asked again") == first


def test_judge_stand_in_travels_without_the_operators_modules():
    """It took whole modules along, and with them functions that hold a session."""
    from dialoom.plans import q_inference

    assert not {"rounds", "inf"} & set(q_inference._verdict.__code__.co_names)
