"""Outcomes of review transcripts and of whole requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.functions.jsonio import with_strict_json
from loomwright.functions.names import strip_blank
from loomwright.functions.text import EDITED_JSON, EDITED_SCRIPT, group_or_null

# Speakers, review types, statuses and the words that decide a review.
HUMAN = "Human_Reviewer"
TASK_REVIEW = "task_definition_review"
SCRIPT_REVIEW = "script_execution_review"
APPROVE, DENIED, DENY, QUIT = "APPROVE", "DENIED", "DENY", "QUIT"
NO_CHANGES = "NO MODIFICATIONS NEEDED"
APPROVED_STATUS, DENIED_STATUS, QUIT_STATUS, ERROR_STATUS = "approved", "denied", "quit", "error"
MODIFIED_JSON, MODIFIED_CODE = "modified_json", "modified_code"
OUTCOMES = ("approved", "approved_no_execution", "denied", "quit_session", "error")
OPEN_OUTCOME = "in_review"


def last_message(
    messages: DataFrame, keys: Sequence[str] = ("review_id", "review_type"), speaker: str = HUMAN
) -> DataFrame:
    """The latest text of a speaker per review; a review without one keeps a null.

    ``max_by`` is combined on the map side, so one endless review is no hot spot.
    """
    theirs = F.col("name") == speaker
    return messages.groupBy(*keys).agg(
        F.max_by(F.when(theirs, F.col("content")), F.when(theirs, F.col("turn"))).alias("content")
    )


def classify_reviews(last: DataFrame, literal: bool = False, whole_words: bool = False) -> DataFrame:
    """Add status, modified_content, execute_approved and quit_session.

    Words are looked for anywhere in the message, so "not approved" approves; with
    ``whole_words`` a negated approval does not count. The literal rule looks for the
    fence of an edit in the upper-cased message and therefore never finds one.
    """
    message = F.coalesce("content", F.lit(""))
    upper = F.upper(strip_blank(message))

    def says(word: str) -> Column:
        return F.contains(upper, F.lit(word))

    approves = says(APPROVE)
    if whole_words:
        approves = upper.rlike(r"\bAPPROVED?\b") & ~upper.rlike(
            r"\b(NOT|NEVER|CANNOT|CAN'T|DON'T|DO NOT|WON'T)\s+(BE\s+)?APPROVED?\b"
        )
    task_review, script_review = (F.col("review_type") == t for t in (TASK_REVIEW, SCRIPT_REVIEW))
    edit = F.when(task_review, group_or_null(message, EDITED_JSON)).when(
        script_review, group_or_null(message, EDITED_SCRIPT)
    )
    if literal:
        edit = F.lit(None).cast("string")
    decided = F.when(approves, APPROVED_STATUS).when(
        says(DENIED) | says(DENY), DENIED_STATUS
    ).when(says(QUIT), QUIT_STATUS).when(says(NO_CHANGES), APPROVED_STATUS)
    staged = last.withColumns({"_decided": decided, "_by_word": approves}).withColumn(
        "_edit", F.when(F.col("_decided").isNull(), edit)
    )
    # Only edits of task reviews need the JSON test; other rows pass null.
    tested = with_strict_json(staged, F.when(task_review, F.col("_edit")), "_valid")
    proposed = F.when(task_review & F.col("_valid"), MODIFIED_JSON).when(
        script_review & F.col("_edit").isNotNull(), MODIFIED_CODE
    )
    return (
        tested.withColumn("status", F.coalesce("_decided", proposed, F.lit(ERROR_STATUS)))
        .withColumns(
            {
                "modified_content": F.when(
                    F.col("status").isin(MODIFIED_JSON, MODIFIED_CODE), F.col("_edit")
                ),
                "execute_approved": script_review & F.col("_by_word"),
                "quit_session": F.col("status") == QUIT_STATUS,
            }
        )
        .drop("_decided", "_by_word", "_edit", "_valid")
    )


def run_outcomes(requests: DataFrame, decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Final status per request.

    ``requests``: (request_id, parse_ok, plan_ok, script_ok); ``decisions``: (request_id,
    review_type, round, status, execute_approved, quit_session); ``runs``: (request_id,
    round, succeeded). The last round of each counts. A request whose last review asks
    for a change, or whose last run failed and waits for another review, is still open.
    """

    def latest(review_type: str, prefix: str) -> DataFrame:
        row = F.struct("status", "execute_approved", "quit_session")
        return (
            decisions.where(F.col("review_type") == review_type)
            .groupBy("request_id")
            .agg(F.max_by(row, F.col("round")).alias(prefix))
        )

    last_run = runs.groupBy("request_id").agg(F.max_by("succeeded", "round").alias("succeeded"))
    joined = (
        requests.join(latest(TASK_REVIEW, "task"), "request_id", "left")
        .join(latest(SCRIPT_REVIEW, "script"), "request_id", "left")
        .join(last_run, "request_id", "left")
    )
    task, script = F.col("task.status"), F.col("script.status")
    approved, no_run, denied, quit_session, error = (F.lit(o) for o in OUTCOMES)
    still_open = F.lit(OPEN_OUTCOME)
    outcome = (
        F.when(~F.col("parse_ok") | ~F.col("plan_ok"), error)
        .when(task.isNull(), still_open)
        .when(F.col("task.quit_session"), quit_session)
        .when(task == DENIED_STATUS, denied)
        .when(task == MODIFIED_JSON, still_open)
        .when(task != APPROVED_STATUS, error)
        .when(~F.coalesce("script_ok", F.lit(False)), error)
        .when(script.isNull(), still_open)
        .when(F.col("script.quit_session"), quit_session)
        .when(script == DENIED_STATUS, denied)
        .when(script == MODIFIED_CODE, still_open)
        .when((script == APPROVED_STATUS) & ~F.col("script.execute_approved"), no_run)
        .when(script != APPROVED_STATUS, error)
        .when(F.coalesce("succeeded", F.lit(False)), approved)
        .otherwise(still_open)
    )
    return joined.select("request_id", outcome.alias("outcome"))
