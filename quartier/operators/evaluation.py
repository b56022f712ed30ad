"""Evaluation of retrieval and answers, run history, and chat logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import eval_summary

#: Least mean of each metric, and the phrases that decline to answer.
THRESHOLDS = {"citation_accuracy": 0.60, "recall_at_k": 0.70, "refusal_calibration": 0.80, "faithfulness": 0.70}
REFUSAL = r"(?i)not\s+(answered|in\s+the|covered|specified|supported|provided|found)"


def _share(expected: Column, hit) -> Column:
    n = F.size(expected)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.size(F.filter(expected, hit)) / n)


def recall_at_k(items: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Adds recall_at_k: share of expected citations that are part of a citation among the first k hits; 1 where none is expected."""
    top = hits.where(F.col("rank") <= k).groupBy(F.col("query_id").alias("id")).agg(F.collect_set("citation").alias("_top"))  # k a query
    out = items.join(top, "id", "left")
    found = F.coalesce("_top", F.array().cast("array<string>"))
    return out.withColumn("recall_at_k", _share(F.col("expected_citations"), lambda e: F.exists(found, lambda c: c.contains(e)))).drop("_top")


def citation_accuracy(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds citation_accuracy: share of expected citations that the answer names, whatever the case and the space after the sign."""
    out = items.join(answers.select("id", "answer"), "id", "left")
    flat = F.regexp_replace(F.lower(F.coalesce("answer", F.lit(""))), r"§\s*", "§")
    named = lambda e: flat.contains(F.concat(F.lit("§"), F.lower(F.trim(F.regexp_replace(e, r"^§+", "")))))
    return out.withColumn("citation_accuracy", _share(F.col("expected_citations"), named)).drop("answer")


def refusal_calibration(items: DataFrame, answers: DataFrame, mode: str = "refusal_calibration") -> DataFrame:
    """Adds refusal_calibration: for unanswerable items 1 if the answer declines and says nothing that it must not, else 0; -1 for others."""
    out = items.join(answers.select("id", "answer"), "id", "left")
    answer = F.coalesce("answer", F.lit(""))
    bad = F.exists(F.coalesce("must_not_say", F.array().cast("array<string>")), lambda b: F.lower(answer).contains(F.lower(b)))
    good = (answer.rlike(REFUSAL) & ~bad).cast("double")
    return out.withColumn("refusal_calibration", F.when(F.col("failure_mode") == mode, good).otherwise(F.lit(-1.0))).drop("answer")


def run_eval(items: DataFrame, answers: DataFrame, hits: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The metrics of every item, and their summary by failure mode with pass flags."""
    table = refusal_calibration(citation_accuracy(recall_at_k(items, hits, k), answers), answers)
    return table, eval_summary(table, {m: t for m, t in thresholds.items() if m in table.columns})


def regressions(history: DataFrame, pct: float = 5.0, metric: str = "metric", value: str = "value", ts: str = "ts") -> DataFrame:
    """Runs with the median of the seven days before, flagged where they fall more than pct percent below it."""
    day = 24 * 3600
    w = Window.partitionBy(metric).orderBy(F.unix_timestamp(F.col(ts))).rangeBetween(-7 * day, -1)
    out = history.withColumn("baseline", F.percentile(value, F.lit(0.5)).over(w))
    return out.withColumn("regressed", F.coalesce(F.col(value) < F.col("baseline") * (1 - pct / 100), F.lit(False)))


def session_rollup(messages: DataFrame, session: str = "session_id", order: str = "turn", role: str = "role") -> DataFrame:
    """(session, turns, user_turns, last_role), and mean latency and summed cost where the messages have them."""
    cols = [F.count(F.lit(1)).alias("turns"), F.count_if(F.col(role) == "user").alias("user_turns"), F.max_by(role, order).alias("last_role")]
    if "latency_ms" in messages.columns:
        cols.append(F.avg("latency_ms").alias("mean_latency_ms"))
    if "cost_usd" in messages.columns:
        cols.append(F.sum("cost_usd").cast("decimal(10,6)").alias("cost_usd"))
    return messages.groupBy(session).agg(*cols)


def get_or_create_sessions(sessions: DataFrame, wanted: DataFrame, session: str = "session_id") -> DataFrame:
    """All sessions, with those of the wanted ids that are new."""
    new = wanted.select(session).where(F.col(session).isNotNull()).distinct().join(sessions.select(session), session, "left_anti")
    return sessions.unionByName(new, allowMissingColumns=True)
