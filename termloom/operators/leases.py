"""Processing stages of nodes with leases: every operation takes a table of nodes and gives the changed table.

A node has, for each stage, <stage>_status (pending, processing, completed, failed or
skipped), <stage>_attempts, <stage>_started_at, <stage>_lease_until, <stage>_error (JSON
with code, message, retriable, details) and <stage>_run. Workers' requests come as tables
too, so a claim or an answer of many workers is one join; a request that does not hold
(a lost lease, a stage that is not ready) changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order; each needs the one before to be completed.
STAGES = ("parse", "classification", "enrichment")



def _c(stage: str, field: str) -> Column:
    return F.col(f"{stage}_{field}")


def retriable(stage: str) -> Column:
    return F.coalesce(F.get_json_object(f"{stage}_error", "$.retriable") == "true", F.lit(False))


def ready(stage: str, now: Column, most_attempts: int, failed_too: bool = True) -> Column:
    """Whether a stage may be claimed: pending, or its lease has run out, or (failed_too) it failed and may be tried again; not too often, and only after the stage before."""
    lapsed = (_c(stage, "status") == "processing") & (_c(stage, "lease_until").isNull() | (_c(stage, "lease_until") < now))
    again = (_c(stage, "status") == "failed") & retriable(stage) & F.lit(failed_too)
    before = STAGES[STAGES.index(stage) - 1] if stage != STAGES[0] else None
    after_previous = F.lit(True) if before is None else _c(before, "status") == "completed"
    return ((_c(stage, "status") == "pending") | lapsed | again) & (_c(stage, "attempts") < most_attempts) & after_previous


def candidates(nodes: DataFrame, stage: str, now: Column, most_attempts: int, most: int, failed_too: bool = False) -> DataFrame:
    """The oldest nodes whose stage may be claimed."""
    return nodes.where(ready(stage, now, most_attempts, failed_too)).orderBy("created_at", "id").limit(most)


def _set(nodes: DataFrame, stage: str, when: Column, **values: Column) -> DataFrame:
    return nodes.withColumns({f"{stage}_{k}": F.when(when, v.cast(nodes.schema[f"{stage}_{k}"].dataType)).otherwise(_c(stage, k)) for k, v in values.items()})


def claim(nodes: DataFrame, requests: DataFrame, stage: str, now: Column, seconds: int, most_attempts: int) -> DataFrame:
    """Requests (id, run) take stages that are ready; of several for a node the smallest run wins."""
    wanted = requests.groupBy("id").agg(F.min("run").alias("_run"))
    rows = nodes.join(wanted, "id", "left")
    won = F.col("_run").isNotNull() & ready(stage, now, most_attempts)
    return _set(rows, stage, won, status=F.lit("processing"), attempts=_c(stage, "attempts") + 1, started_at=now, lease_until=now + F.make_interval(secs=F.lit(seconds)), error=F.lit(None), run=F.col("_run")).drop("_run")


def _answers(nodes: DataFrame, answers: DataFrame, stage: str) -> tuple[DataFrame, Column]:
    """nodes with the answer of the run that holds each stage's lease, and whether there is one."""
    own = answers.groupBy("id", "run").agg(*[F.min(c).alias(f"_{c}") for c in answers.columns if c not in ("id", "run")], F.lit(True).alias("_held")).withColumnsRenamed({"id": "_id", "run": "_run"})
    rows = nodes.join(own, (F.col("id") == F.col("_id")) & (_c(stage, "run") == F.col("_run")), "left")
    return rows, F.coalesce(F.col("_held") & (_c(stage, "status") == "processing"), F.lit(False))


def _plain(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.select(*nodes.columns)


def complete(nodes: DataFrame, answers: DataFrame, stage: str) -> DataFrame:
    """Answers (id, run) of runs that hold the lease complete the stage."""
    rows, held = _answers(nodes, answers, stage)
    return _plain(_set(rows, stage, held, status=F.lit("completed"), lease_until=F.lit(None), error=F.lit(None)), nodes)


def fail(nodes: DataFrame, answers: DataFrame, stage: str) -> DataFrame:
    """Answers (id, run, error) fail the stage with their error."""
    rows, held = _answers(nodes, answers, stage)
    return _plain(_set(rows, stage, held, status=F.lit("failed"), lease_until=F.lit(None), error=F.col("_error")), nodes)


def skip(nodes: DataFrame, answers: DataFrame, stage: str) -> DataFrame:
    """Answers (id, run, reason) mark the stage as skipped, for good."""
    rows, held = _answers(nodes, answers, stage)
    error = F.to_json(F.struct(F.lit("SKIPPED").alias("code"), F.col("_reason").alias("message"), F.lit(False).alias("retriable")))
    return _plain(_set(rows, stage, held, status=F.lit("skipped"), lease_until=F.lit(None), error=error), nodes)


def release(nodes: DataFrame, answers: DataFrame, stage: str) -> DataFrame:
    """Answers (id, run) give their lease back: the stage is pending again and the attempt doesn't count."""
    rows, held = _answers(nodes, answers, stage)
    return _plain(_set(rows, stage, held, status=F.lit("pending"), attempts=F.greatest(_c(stage, "attempts") - 1, F.lit(0)), started_at=F.lit(None), lease_until=F.lit(None), run=F.lit(None)), nodes)


def renew(nodes: DataFrame, answers: DataFrame, stage: str, now: Column, seconds: int) -> DataFrame:
    """Answers (id, run) extend leases that have not run out."""
    rows, held = _answers(nodes, answers, stage)
    return _plain(_set(rows, stage, held & (_c(stage, "lease_until") >= now), lease_until=now + F.make_interval(secs=F.lit(seconds))), nodes)


def reap(nodes: DataFrame, stage: str, now: Column, most_attempts: int) -> DataFrame:
    """Stages whose lease has run out and that may not be tried again fail for good."""
    lapsed = (_c(stage, "status") == "processing") & (_c(stage, "lease_until") < now) & (_c(stage, "attempts") >= most_attempts)
    error = F.to_json(F.struct(F.lit("MAX_ATTEMPTS_EXCEEDED").alias("code"), F.lit("lease expired").alias("message"), F.lit(False).alias("retriable"), F.struct(F.lit(most_attempts).alias("maxAttempts")).alias("details")))
    return _set(nodes, stage, lapsed, status=F.lit("failed"), lease_until=F.lit(None), error=error)


def _renewed(nodes: DataFrame, stage: str, when: Column) -> DataFrame:
    return _set(nodes, stage, when, status=F.lit("pending"), attempts=F.lit(0), started_at=F.lit(None), lease_until=F.lit(None), error=F.lit(None), run=F.lit(None))


def requeue(nodes: DataFrame, ids: DataFrame, stage: str, now: Column, downstream: bool = True, force: bool = False) -> DataFrame:
    """The stage of some nodes (id), and with downstream those after it, start anew; not if one of them is being worked on under a lease, unless forced."""
    stages = STAGES[STAGES.index(stage) :] if downstream else (stage,)
    busy = F.lit(False)
    for s in stages:
        busy = busy | ((_c(s, "status") == "processing") & _c(s, "lease_until").isNotNull() & (_c(s, "lease_until") >= now))
    rows = nodes.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    rows = rows.withColumn("_asked", F.coalesce("_asked", F.lit(False)) & (F.lit(force) | ~F.coalesce(busy, F.lit(False))))
    for s in stages:
        rows = _renewed(rows, s, F.col("_asked"))
    return _plain(rows, nodes)


def reset(nodes: DataFrame, stage: str, statuses: tuple[str, ...] = ("failed", "skipped")) -> DataFrame:
    """All stages of some statuses start anew; stages that are being worked on can't be asked for."""
    if not statuses or "processing" in statuses:
        raise ValueError("statuses to reset must be given, and not be processing")
    return _renewed(nodes, stage, _c(stage, "status").isin(*statuses))


def dead_letters(nodes: DataFrame, stage: str) -> DataFrame:
    """Failed stages that were tried as often as allowed."""
    error = f"{stage}_error"
    most = F.get_json_object(error, "$.details.maxAttempts").try_cast("int")
    return nodes.where((_c(stage, "status") == "failed") & ((F.get_json_object(error, "$.code") == "MAX_ATTEMPTS_EXCEEDED") | (_c(stage, "attempts") >= most)))
