"""Models that answer in JSON: a vectorised hook with failures per row, a breaker per agent, and rules to fall back to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .scratch import settled
from .stats import join_back

#: What a classifier may answer, and what stands for an answer that it can't give.
FILM_TYPES = ("negative_35mm", "negative_120", "positive_35mm", "positive_120")
DEFAULT_TYPE = "negative_35mm"

Model = Callable[[list[str]], list[str | None]]


def ask(df: DataFrame, model: Model, request: Column, agent: Column, order: Column, usable: Callable[[str], bool], breaker: bool = True, batch: int = 64) -> DataFrame:
    """df with _answer and _error: the model's answers to JSON requests, or why there is none.

    model takes a list of requests and gives as many answers; what it raises for several is asked again one by one,
    so only the row at fault fails. usable tells whether an answer counts.

    breaker: an agent's first failure in order turns its model off, so later rows have no answer. Rows are dealt out
    by ranges of (agent, order); a range stops asking for an agent after a failure of its own, and answers that other
    ranges got beyond the agent's first failure are dropped.
    """
    asked = df.withColumns({"_request": request, "_agent": agent.cast("string"), "_order": order.cast("long")})
    dealt = asked.repartitionByRange("_agent", "_order").sortWithinPartitions("_agent", "_order")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + ", _answer string, _error string"

    def one(request: str) -> tuple[str | None, str | None]:
        try:
            return told(model([request])[0])
        except Exception as e:  # the row's own failure
            return None, f"{type(e).__name__}: {e}"

    def told(answer: str | None) -> tuple[str | None, str | None]:
        return (answer, None) if answer is not None and usable(answer) else (None, f"unusable answer: {answer}")

    def several(requests: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = model(requests)
            if len(answers) != len(requests):
                raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            return [told(a) for a in answers]
        except Exception:
            return [one(r) for r in requests]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        off: str | None = None  # the agent whose model this range has turned off
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                agents, requests = part.column("_agent").to_pylist(), part.column("_request").to_pylist()
                open_ = [i for i, a in enumerate(agents) if not (breaker and a == off)]
                got: list[tuple[str | None, str | None]] = [(None, None)] * len(agents)
                for i, answer in zip(open_, several([requests[i] for i in open_]) if open_ else [], strict=True):
                    if breaker and agents[i] == off:
                        continue
                    got[i] = answer
                    if breaker and answer[1] is not None:
                        off = agents[i]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], [*part.schema.names, "_answer", "_error"])

    answered = settled(dealt.mapInArrow(run, schema))
    if breaker:
        first = answered.where("_error is not null").groupBy("_agent").agg(F.min("_order").alias("_first"))
        first = first.withColumnRenamed("_agent", "_k")
        answered = answered.join(first, F.col("_agent").eqNullSafe(F.col("_k")), "left")
        on = F.col("_first").isNull() | (F.col("_order") <= F.col("_first"))
        answered = answered.withColumns({c: F.when(on, F.col(c)) for c in ("_answer", "_error")}).drop("_k", "_first")
    return answered.drop("_request", "_agent", "_order")


def _json(answer: str) -> dict | None:
    """The object in an answer, from its first brace to its last."""
    import json

    try:
        got = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def names_a_type(answer: str) -> bool:
    got = _json(answer)
    return got is not None and str(got.get("film_type", "")).strip().lower() in FILM_TYPES


def has_a_score(answer: str) -> bool:
    got = _json(answer)
    try:
        return got is not None and float(got["score"]) == float(got["score"])
    except (KeyError, TypeError, ValueError):
        return False


def _mode(fallback: bool) -> Column:
    return F.when(F.col("_answer").isNotNull(), "model").when(F.lit(fallback), "heuristic").otherwise("default")


def classify(df: DataFrame, model: Model | None, request: Column, agent: Column, order: Column, rule: Column, fallback: bool = True) -> DataFrame:
    """df with film_type and mode: the model's type if it names one that there is, else the rule's (fallback) or the default.

    Without a model all rows go by the rule. With fallback an agent's first failure turns its model off.
    """
    if model is None:
        return df.withColumns({"film_type": rule, "mode": F.lit("heuristic")})
    df = ask(df, model, request, agent, order, names_a_type, breaker=fallback)
    said = F.lower(F.trim(F.get_json_object(X.json_in_text(F.col("_answer")), "$.film_type")))
    return df.withColumns({"film_type": F.coalesce(said, rule if fallback else F.lit(DEFAULT_TYPE)), "mode": _mode(fallback)}).drop("_answer", "_error")


def evaluate(df: DataFrame, model: Model | None, request: Column, agent: Column, order: Column, rule: dict[str, Column], threshold: float = 0.75, fallback: bool = True, names=("gamma", "clahe_clip", "vibrance")) -> DataFrame:
    """df with score, feedback, passed, mode and the suggested parameters: the model's, clamped to their ranges, or the rule's.

    rule: score, feedback and the parameters by name. Without fallback a row without a usable answer scores 0, with
    what went wrong as feedback and default parameters.
    """
    if model is None:
        df = df.withColumns({"_answer": F.lit(None).cast("string"), "_error": F.lit(None).cast("string")})
        fallback = True
    else:
        df = ask(df, model, request, agent, order, has_a_score, breaker=fallback)
    answer = X.json_in_text(F.col("_answer"))
    there = answer.isNotNull()
    suggested = X.params(F.get_json_object(answer, "$.suggested_params"), names)
    other = rule if fallback else {"score": F.lit(0.0), "feedback": F.concat(F.lit("Parse error: "), "_error")} | {n: F.lit(X.PARAMS[n][0]) for n in names}
    score = F.when(there, F.get_json_object(answer, "$.score").try_cast("double")).otherwise(other["score"])
    feedback = F.when(there, F.trim(F.coalesce(F.get_json_object(answer, "$.feedback"), F.lit("")))).otherwise(other["feedback"])
    df = df.withColumns({"score": score, "feedback": feedback, "mode": _mode(fallback)} | {n: F.when(there, suggested[n]).otherwise(other[n]) for n in names})
    return df.withColumn("passed", F.col("score") >= threshold).drop("_answer", "_error")


def with_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Images (image_id, ...) with their metrics, as a settled table that a model can be asked about."""
    return settled(join_back(df, metrics))
