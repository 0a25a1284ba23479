"""Loops of table rounds: judge until accepted, check and repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.rules import has_syntax_error
from dialoom.functions.scripts import classify_object
from dialoom.functions.text import post_clean_sql
from dialoom.operators.inference import batch_infer, build_messages, fix_requests
from dialoom.operators.merges import merge_responses
from dialoom.operators.reports import ENDPOINT_ERROR_START
from dialoom.operators.reports import judge as read_verdict
from dialoom.operators.scripts import attach_sql_checks, syntax_check_python
from dialoom.session import materialize

# Accepted score and number of rounds.
ACCEPT_SCORE = 0.9
MAX_ROUNDS = 2


def rounds(
    df: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    accept: Column | None = None,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Apply ``step`` to the open rows until each is accepted or ``max_rounds`` are over.

    ``step(rows, attempt)`` returns those rows with their new values. A row keeps its last
    attempt, with ``attempts`` and ``accepted``. Each round is written before the next reads it,
    so a model is asked once per row and round.
    """
    accept = F.col("overall_score") >= ACCEPT_SCORE if accept is None else accept
    finished, open_rows = [], df
    for attempt in range(1, max_rounds + 1):
        ok = F.coalesce(accept, F.lit(False))
        tried = step(open_rows, attempt).withColumns({"attempts": F.lit(attempt), "accepted": ok})
        tried = materialize(tried)
        if attempt == max_rounds:
            finished.append(tried)
            break
        finished.append(tried.filter("accepted"))
        open_rows = tried.filter("NOT accepted").drop("attempts", "accepted")
        if open_rows.isEmpty():
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


#: Object kind whose prompt serves kinds without one, and the parts of a judge's message.
DEFAULT_KIND = "TABLE"
ORIGINAL, CONVERTED = "ORIGINAL:\n", "\n\nCONVERTED:\n"
REMARKS = "Improve the answer on these points:\n"


def _prompt(prompts: dict[str, str], default: str) -> Column:
    """The prompt of a row's ``object_type``."""
    chosen = F.lit(prompts.get(default, ""))
    for kind, text in prompts.items():
        chosen = F.when(F.col("object_type") == kind, F.lit(text)).otherwise(chosen)
    return chosen


def judged_conversion(
    scripts: DataFrame,
    convert: Callable,
    judge: Callable,
    prompts: dict[str, str],
    judge_prompts: dict[str, str],
    key: str = "script_id",
    script: str = "script",
    model: str = "",
    max_rounds: int = MAX_ROUNDS,
    accept_score: float = ACCEPT_SCORE,
    feedback: bool = False,
    answers: str | None = None,
    **infer_settings,
) -> DataFrame:
    """Classify, convert, clean, judge, and again what the judge does not accept: one plan over all scripts.

    ``prompts`` and ``judge_prompts`` hold the system text per object kind; a kind without one takes
    that of ``TABLE``. ``convert`` and ``judge`` answer messages in tasks. A failed call is an answer
    too: a script whose conversion fails is judged as it failed, one whose judge fails scores 0.
    ``feedback`` sends the judge's improvements along in the next round. With ``answers``, a folder
    that keeps the answers of every round, a run that breaks off asks nothing twice.

    Returns ``key, script, object_type, converted, overall_score, summary_reasoning,
    critical_errors, improvements_required, attempts, accepted``; every round works on the rows that
    are still open, and the last one's answer stays.
    """
    base = scripts.select(key, script, classify_object(script).alias("object_type"))
    blank = {
        "converted": "string", "overall_score": "double", "summary_reasoning": "string",
        "critical_errors": "array<string>", "improvements_required": "array<string>",
    }
    # Written, as are the answers below: every step reads the rows twice, for its messages and to join the answers.
    base = materialize(base.withColumns({name: F.lit(None).cast(kind) for name, kind in blank.items()}))

    def ask(rows: DataFrame, messages: Column, model_call: Callable, step: str) -> DataFrame:
        folder = f"{answers}/{step}" if answers else None
        asked = batch_infer(rows.select(key, messages.alias("messages")), model_call, key=key, answers=folder, **infer_settings)
        failed = F.concat(F.lit(f"{ENDPOINT_ERROR_START}: "), F.coalesce("result_error", F.lit("no answer")))
        told = materialize(asked.select(F.col("input_file_number").alias(key), F.coalesce("result_content", failed).alias(step)))
        return rows.join(told, key)

    def attempt(rows: DataFrame, number: int) -> DataFrame:
        messages = build_messages(script, _prompt(prompts, DEFAULT_KIND))
        if feedback and number > 1:
            remarks = F.concat(F.lit(REMARKS), F.array_join("improvements_required", "\n"))
            more = F.array(F.struct(F.lit("user").alias("role"), remarks.alias("content")))
            messages = F.when(F.size("improvements_required") > 0, F.concat(messages, more)).otherwise(messages)
        made = ask(rows.drop("converted"), messages, convert, f"convert_{number}")
        made = materialize(made.withColumn("converted", post_clean_sql(f"convert_{number}")).drop(f"convert_{number}"))
        payload = F.concat(F.lit(ORIGINAL), F.coalesce(script, F.lit("")), F.lit(CONVERTED), F.coalesce("converted", F.lit("")))
        judged = ask(made, build_messages(payload, _prompt(judge_prompts, DEFAULT_KIND)), judge, f"judge_{number}")
        return read_verdict(judged, f"judge_{number}", script, model).select(*base.columns)

    return rounds(base, attempt, F.col("overall_score") >= accept_score, max_rounds)


def check(df: DataFrame, check_fn: Callable | None = None) -> DataFrame:
    """Python check, statement extraction and statement checks."""
    return attach_sql_checks(syntax_check_python(df), check_fn)


def check_and_fix(
    df: DataFrame,
    predict: Callable,
    check_fn: Callable | None = None,
    max_attempts: int = 1,
    labels: dict[str, str] | None = None,
    **infer_settings,
) -> DataFrame:
    """Check; while errors remain, ask for repairs of the failing rows only and check those again.

    Sound rows are checked once and not carried through the rounds. ``labels`` are noted on the
    rows asked. No attempts allowed means no check at all.
    """
    if max_attempts == 0:
        return df
    current = materialize(check(df, check_fn))
    done = []
    for _ in range(max_attempts):
        failing = has_syntax_error("result_python_parse_error", "result_sql_parse_errors")
        faulty = current.filter(failing)
        if faulty.isEmpty():
            break
        done.append(current.filter(~failing))
        responses = materialize(batch_infer(fix_requests(faulty), predict, **infer_settings))
        current = materialize(check(merge_responses(faulty, responses, labels), check_fn))
    out = current
    for part in done:
        out = out.unionByName(part)
    return out
