"""Model-call queries with a deterministic stand-in for the model."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from dialoom.operators import inference as inf
from dialoom.operators import rounds
from dialoom.operators.inference import CallError
from dialoom.operators.relational import rank_within
from dialoom.operators.rounds import CONVERTED, ORIGINAL
from dialoom.plans.derived import PY_SQL, RESULT_SQL, python_scripts, result_table
from dialoom.plans.registry import query, table
from dialoom.schema import with_result_columns
from dialoom.session import materialize, scratch_dir


def stand_in(messages):
    """Answers with a digest of the last message; some texts fail or need a second part."""
    text = messages[-1]["content"]
    asked = [m for m in messages if m["role"] == "user" and not m["content"].startswith("The previous response")]
    subject = asked[-1]["content"]
    digest = hashlib.md5(subject.encode()).hexdigest()
    size = len(subject)
    if size % 10 == 3:
        raise inf.CallError(400, "Bad Request", json.dumps({"message": "Invalid parameter x"}))
    if size % 10 == 4:
        raise inf.CallError(500, "Server Error", "oops")
    if size % 10 == 5 and text == subject:
        return inf.Reply("part one ", "length", size % 100, 1, size % 100 + 1)
    return inf.Reply([{"type": "reasoning"}, {"type": "text", "text": digest}], "stop", size % 100, 2, size % 100 + 2)


ANSWERED = """CASE WHEN n_chars % 10 IN (3, 4) THEN 'none' WHEN n_chars % 10 = 5 THEN 'part one ' || md5(text)
  ELSE md5(text) END"""
FAILED = """CASE n_chars % 10 WHEN 3 THEN 'Bad Request' || chr(10) || 'Response details: {"message": "Invalid parameter x"}'
  WHEN 4 THEN 'Server Error' || chr(10) || 'Response details: oops' ELSE 'none' END"""
TOKENS = "CASE WHEN n_chars % 10 IN (3, 4) THEN -1 WHEN n_chars % 10 = 5 THEN 2 * (n_chars % 100) + 3 ELSE n_chars % 100 + 2 END"
QUICK = inf.RetryPolicy(max_backpressure=2, max_other=2, multiplier=0)


def _requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("input_file_number"), inf.build_messages("text", "Convert.").alias("messages")
    )


def _responses(df):
    return df.select(
        F.col("input_file_number").alias("doc_id"),
        F.coalesce("result_content", F.lit("none")).alias("content"),
        F.coalesce("result_error", F.lit("none")).alias("error"),
        F.coalesce("result_total_tokens", F.lit(-1)).cast("long").alias("tokens"),
    )


@query(
    "INF-1",
    """SELECT doc_id, md5(CASE WHEN lang = 'en' THEN '' ELSE 'system=Convert ' || lang || '|' END
      || 'user=a|assistant=b|user=' || text) AS messages FROM documents""",
)
def build_messages(spark, sf_dir):
    system = F.when(F.col("lang") != "en", F.concat(F.lit("Convert "), "lang")).otherwise("")
    shots = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    docs = table(spark, sf_dir, "documents").select("doc_id", inf.build_messages("text", system, shots).alias("m"))
    joined = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return docs.select("doc_id", F.md5(joined).alias("messages"))


@query(
    "INF-2",
    """SELECT 'system_message' AS key, 'Use English. AFRICA, AMERICA rules: be brief in English' AS text
    UNION ALL SELECT 'rules', 'rules: be brief in English' UNION ALL SELECT r_name, 'region ' || r_name FROM region""",
)
def render_prompts(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("key"), F.concat(F.lit("common "), "r_name").alias("text")
    )
    fixed = spark.range(1).select(F.lit("rules").alias("key"), F.lit("rules: be brief in {comment_lang}").alias("text"))
    custom = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("key"), F.concat(F.lit("region "), "r_name").alias("text")
    )
    system = spark.range(1).select(
        F.lit("system_message").alias("key"), F.lit("Use {comment_lang}. AFRICA, AMERICA ${rules}").alias("text")
    )
    return inf.render_prompt(custom.unionByName(system), regions.unionByName(fixed), {"comment_lang": "English"})


@query(
    "INF-3 INF-7",
    f"SELECT doc_id, {ANSWERED} AS content, {FAILED} AS error, {TOKENS} AS tokens FROM documents",
)
def batch_responses(spark, sf_dir):
    return _responses(inf.batch_infer(_requests(spark, sf_dir), stand_in, threads=4, policy=QUICK))


@query(
    "INF-3",
    f"SELECT doc_id, {ANSWERED} AS content, {FAILED} AS error, {TOKENS} AS tokens FROM documents",
)
def batch_responses_distinct(spark, sf_dir):
    """Equal requests are asked once."""
    def ask(requests, key):
        return materialize(inf.batch_infer(requests, stand_in, policy=QUICK, key=key))

    return _responses(inf.infer_distinct(_requests(spark, sf_dir), ask))


@query(
    "INF-3",
    f"SELECT doc_id, {ANSWERED} AS content, {FAILED} AS error, {TOKENS} AS tokens FROM documents",
)
def batch_responses_restarted(spark, sf_dir):
    """A run that breaks off at the longest text, started again: the answers kept, and calls for the rest."""
    folder = f"{scratch_dir(spark)}/answers"
    requests = _requests(spark, sf_dir)
    longest = table(spark, sf_dir, "documents").agg(F.max("n_chars")).first()[0]

    def breaks_off(messages):
        if len(messages[-1]["content"]) == longest:
            raise KeyboardInterrupt("stop")
        return stand_in(messages)

    try:
        materialize(inf.batch_infer(requests, breaks_off, threads=4, policy=QUICK, answers=folder))
    except Exception as error:  # noqa: BLE001 - the break is the point
        if "stop" not in str(error):
            raise
    return _responses(inf.batch_infer(requests, stand_in, threads=4, policy=QUICK, answers=folder))


@query(
    "INF-4",
    """SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content, cast(sum(length(text)) AS bigint) AS tokens
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
)
def join_continuations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", "text", F.length("text").alias("tokens")
    )
    out = inf.join_continuations(turns, ["conv_id"], "turn", "text", ["tokens"])
    return out.withColumn("content", F.md5("content"))


RAW_ANSWER = """CASE turn % 3 WHEN 0 THEN to_json(array(named_struct('type', 'reasoning', 'text', 'hm'),
    named_struct('type', 'text', 'text', text), named_struct('type', 'text', 'text', '!')))
  WHEN 1 THEN text ELSE '[]' END"""


@query(
    "INF-5",
    "SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN text || '!' WHEN 1 THEN text ELSE '' END) AS content FROM conversations",
)
def parse_contents(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{RAW_ANSWER} AS raw")
    return rows.select("conv_id", "turn", F.md5(inf.parse_content("raw")).alias("content"))


ATTEMPT_STATUS = """CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN 400 WHEN 'error' THEN 500 WHEN 'signup' THEN 503
  ELSE NULL END"""
ATTEMPT_MESSAGE = "CASE WHEN event_id % 2 = 0 THEN 'Missing Parameter ' || props ELSE 'busy ' || props END"


# A log of attempts: each user's events in a row are the attempts of one request.
ATTEMPTS = """SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, {status} AS status,
  {message} AS message FROM events"""


@query(
    "INF-6",
    f"""WITH a AS ({ATTEMPTS.format(status=ATTEMPT_STATUS, message=ATTEMPT_MESSAGE)}),
      last AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) AS k FROM a),
      k AS (SELECT request_id, attempt AS attempts, CASE WHEN status IS NULL THEN 'none'
        WHEN status = 400 AND message LIKE 'Missing%' THEN 'stop' WHEN status IN (429, 503) THEN 'backpressure'
        ELSE 'other' END AS retry_class FROM last WHERE k = 1)
    SELECT request_id, attempts, retry_class,
      attempts < CASE retry_class WHEN 'backpressure' THEN 20 WHEN 'other' THEN 5 ELSE 1 END AS retry FROM k""",
)
def retry_decisions(spark, sf_dir):
    """The usual limits: 20 attempts under back-pressure, 5 otherwise."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    rows = rank_within(events, ["user_id"], ["event_id"], "attempt")
    attempts = rows.selectExpr("user_id AS request_id", "attempt", f"{ATTEMPT_STATUS} AS status", f"{ATTEMPT_MESSAGE} AS message")
    return inf.retry_decision(attempts)


@query(
    "INF-7",
    """SELECT doc_id, md5('failed' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Response details: ' || left(text, 500)
      ELSE chr(10) || 'Response details: {"n": ' || n_chars || ', "lang": "' || lang || repeat('x', 600) || '"}' END) AS detail
    FROM documents""",
)
def error_details(spark, sf_dir):
    body = """CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN text
      ELSE '{"n": ' || cast(n_chars AS string) || ', "lang": "' || lang || repeat('x', 600) || '"}' END"""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{body} AS body")
    return rows.select("doc_id", F.md5(inf.error_detail(F.lit("failed"), "body")).alias("detail"))


@query(
    "INF-8",
    f"""WITH {RESULT_SQL} SELECT input_file_number, md5('Fix:' || chr(10) || coalesce(result_python_parse_error || chr(10), '')
      || coalesce(array_to_string(result_sql_parse_errors, chr(10))
        || CASE WHEN len(result_sql_parse_errors) > 0 THEN chr(10) ELSE '' END, '')) AS system_message,
      md5(coalesce(result_content, 'none')) AS user_message
    FROM result WHERE result_python_parse_error IS NOT NULL OR coalesce(len(result_sql_parse_errors), 0) > 0""",
)
def fix_requests(spark, sf_dir):
    asked = inf.fix_requests(result_table(spark, sf_dir), "Fix:\n")
    return asked.select(
        "input_file_number",
        F.md5(F.col("messages")[0]["content"]).alias("system_message"),
        F.md5(F.coalesce(F.col("messages")[1]["content"], F.lit("none"))).alias("user_message"),
    )


@query(
    "INF-9",
    f"""WITH {RESULT_SQL} SELECT lang, count(*) AS files, cast(sum(result_prompt_tokens) AS bigint) AS prompt_tokens,
      cast(sum(result_completion_tokens) AS bigint) AS completion_tokens, cast(sum(result_total_tokens) AS bigint) AS total_tokens
    FROM result GROUP BY lang""",
)
def token_usage(spark, sf_dir):
    return inf.usage(result_table(spark, sf_dir), ["lang"]).drop("seconds")


def _converted(messages):
    """Answers with a statement named after the script; told what to improve, it names its column."""
    digest = hashlib.md5(messages[1]["content"].encode()).hexdigest()
    return f"```sql\nSELECT '{digest}'{' AS fixed' if len(messages) > 2 else ''}\n```"


def _verdict(messages):
    """Scores an answer by the length of its script and by whether it was mended; some calls and answers are broken."""
    original, converted = messages[-1]["content"].removeprefix(ORIGINAL).rsplit(CONVERTED, 1)
    n = len(original) % 10
    if n == 7:
        raise CallError(400, "Bad Request", json.dumps({"message": "Invalid parameter x"}))
    if n == 8:
        return "no verdict"
    score = 0.95 if n < 3 else 0.9 if n < 6 and converted.endswith("AS fixed") else 0.5
    told = {"overall_score": score, "summary_reasoning": f"rest {n}", "critical_errors": [], "improvements_required": ["name the column"]}
    return "Verdict: " + json.dumps(told)


@query(
    "JDG-2 JDG-1 TXT-9 TXT-13 SCR-1",
    """WITH d AS (SELECT doc_id, text, length(text) % 10 AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 3 THEN 1 ELSE 2 END AS attempts, n < 6 AS accepted,
      cast(CASE WHEN n < 3 THEN 0.95 WHEN n < 6 THEN 0.9 WHEN n IN (7, 8) THEN 0.0 ELSE 0.5 END AS double) AS overall_score,
      CASE n WHEN 7 THEN 'Endpoint Error: judge' WHEN 8 THEN 'Model returned invalid format.' ELSE 'rest ' || n END AS summary_reasoning,
      'SELECT ' || chr(39) || md5(text) || chr(39) || CASE WHEN n < 3 OR n IN (7, 8) THEN '' ELSE ' AS fixed' END AS converted FROM d""",
)
def judge_rounds(spark, sf_dir):
    """Convert all documents, let a judge answer, read its score; those below the mark are tried once more."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), F.col("text").alias("script"))
    done = rounds.judged_conversion(
        docs, _converted, _verdict, {"TABLE": "Convert."}, {"TABLE": "Judge.", "VIEW": "Judge a view."}, model="judge",
        feedback=True, policy=QUICK, answers=f"{scratch_dir(spark)}/answers",
    )
    return done.select(F.col("script_id").alias("doc_id"), "attempts", "accepted", "overall_score", "summary_reasoning", "converted")


def repair(messages):
    """Drops the broken last line of a script, or closes its bracket."""
    code = messages[-1]["content"]
    return code[: -len("def (\n")] if code.endswith("def (\n") else code.replace("SELEC (1", "SELECT (1)")


@query(
    "CTL-1",
    f"""WITH {PY_SQL} SELECT doc_id, md5(CASE doc_id % 6 WHEN 1 THEN left(code, length(code) - 6)
        WHEN 3 THEN replace(code, 'SELEC (1', 'SELECT (1)') ELSE code END) AS code,
      CASE WHEN doc_id % 6 = 3 THEN 3 ELSE 2 END AS statements, 0 AS errors FROM pys""",
)
def check_and_fix(spark, sf_dir):
    """Check every script, repair the failing ones once, check again."""
    rows = python_scripts(spark, sf_dir).select(
        F.col("doc_id").cast("int").alias("input_file_number"), F.col("code").alias("result_content")
    )
    out = rounds.check_and_fix(with_result_columns(rows), repair, max_attempts=2)
    return out.select(
        F.col("input_file_number").cast("long").alias("doc_id"),
        F.md5("result_content").alias("code"),
        F.size("result_extracted_sqls").alias("statements"),
        F.size("result_sql_parse_errors").alias("errors"),
    )
