"""Calls to a decision provider: prompts, cache, budget, answers, log.

What is sent is settled first: cases are capped and gated on the driver's parameters, and only what
passes the gate becomes a call. Answers are written once (lineage is cut), so neither a second action
on the plan nor a retried task pays twice for a case that was answered.
"""

from __future__ import annotations

import copy
import json
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.operators import decisions, routing
from knitwork.session import cut_lineage

Provider = Callable[[str, str], str]


@dataclass(frozen=True)
class Model:
    provider: str = "stand_in"
    name: str = "deterministic"
    temperature: float = 0.0
    max_output_tokens: int = 512
    prompt_version: str = "1"
    template: str = "{{payload}}"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def render(template: str | Column, values: dict[str, Column]) -> Column:
    """The template with every {{name}} replaced; structs, arrays and maps as JSON."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def strict(schema: dict) -> dict:
    """A copy of a JSON schema in which every object takes all of its properties and no others."""

    def visit(node):
        if isinstance(node, dict):
            out = {k: visit(v) for k, v in node.items()}
            if out.get("type") == "object" and isinstance(out.get("properties"), dict):
                out |= {"required": sorted(out["properties"]), "additionalProperties": False}
            return out
        return [visit(x) for x in node] if isinstance(node, list) else copy.copy(node)

    return visit(schema)


@dataclass(frozen=True)
class HttpProvider:
    """Posts {model, input, ...} as JSON and reads output_text, or the first text of output's contents.
    ``retries`` more attempts follow a failure at once; ``post`` can stand in for the network."""

    url: str
    key: str
    model: Model
    retries: int = 2
    timeout: float = 60.0
    post: Callable[[str, bytes, dict[str, str], float], bytes] | None = None

    def __call__(self, stage: str, payload: str) -> str:
        body = json.dumps({"model": self.model.name, "input": self.model.template.replace("{{payload}}", payload), "temperature": self.model.temperature, "max_output_tokens": self.model.max_output_tokens}).encode()
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        last: Exception | None = None
        for _ in range(self.retries + 1):
            try:
                return answer_text(json.loads((self.post or _post)(self.url, body, headers, self.timeout)))
            except Exception as error:  # noqa: BLE001 - any failure is tried again, then reported
                last = error
        raise RuntimeError(f"no answer after {self.retries + 1} attempts") from last


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.read()


def answer_text(answer: dict) -> str:
    if isinstance(answer.get("output_text"), str):
        return answer["output_text"]
    texts = (c["text"] for o in answer.get("output", []) if isinstance(o, dict) for c in o.get("content", []) if isinstance(c, dict) and isinstance(c.get("text"), str))
    return next(texts, "")


def dispatch(model: Model, **settings) -> Provider | None:
    """The provider by name: None stands for the deterministic stand-in, which needs no call."""
    if model.provider == "stand_in":
        return None
    if model.provider == "http":
        return HttpProvider(model=model, **settings)
    raise ValueError(f"unknown provider: {model.provider}")


def input_hash(stage: Column, payload: Column, model: Model = Model()) -> Column:
    """SHA-256 of all that decides an answer: stage, model and its settings, prompt version, payload."""
    return F.sha2(F.concat_ws("\n", stage, F.lit(canonical(asdict(model))), payload), 256)


@dataclass(frozen=True)
class Budget:
    """Caps, None for no limit; daily ones count what was used on the day before this run too."""

    stage_cases: int | None = None
    run_calls: int | None = None
    daily_calls: int | None = None
    run_cost: float | None = None
    daily_cost: float | None = None


@dataclass(frozen=True)
class Used:
    run_calls: int = 0
    run_cost: float = 0.0
    daily_calls: int = 0
    daily_cost: float = 0.0
    by_stage: tuple[tuple[str, int], ...] = ()

    def plus(self, calls: int, cost: float, stage: str) -> Used:
        counts = dict(self.by_stage)
        counts[stage] = counts.get(stage, 0) + calls
        return Used(self.run_calls + calls, self.run_cost + cost, self.daily_calls, self.daily_cost, tuple(sorted(counts.items())))


#: Cases that the run-wide caps are counted over at most; the caps of stages bring them below it.
MOST_GATED = 1_000_000


def gate(cases: DataFrame, budget: Budget, used: Used = Used()) -> DataFrame:
    """``cases`` (stage, route_ord, estimated_cost, ...) with selected and reason, in route order: the
    first limit that a case would break of stage, run calls, daily calls, run cost and daily cost.

    Stages are capped first, each by a rank of its own; the run-wide counts then go over what is left,
    whose number the stage caps bound. Costs are held on the running sum of estimates."""
    before = dict(used.by_stage)
    table = F.create_map(*[F.lit(x) for s, n in before.items() for x in (s, n)]) if before else None
    already = F.coalesce(F.try_element_at(table, F.col("stage")), F.lit(0)) if table is not None else F.lit(0)
    ranked = cases.withColumn("stage_at", F.row_number().over(Window.partitionBy("stage").orderBy("route_ord")))
    fits = F.lit(True) if budget.stage_cases is None else F.col("stage_at") + already <= budget.stage_cases
    over = ranked.filter(~fits).select(*cases.columns, F.lit("stage_case_limit").alias("reason"))
    if budget == Budget(budget.stage_cases):
        inside = ranked.filter(fits).select(*cases.columns, F.lit(None).cast("string").alias("reason"))
    else:
        running = Window.orderBy("route_ord").rowsBetween(Window.unboundedPreceding, 0)
        # beyond this many the first of the run-wide caps is reached in any case
        room = [max(x - n, 0) + 1 for x, n in ((budget.run_calls, used.run_calls), (budget.daily_calls, used.run_calls + used.daily_calls)) if x is not None]
        most = min(MOST_GATED, room[0]) if room else MOST_GATED
        kept = ranked.filter(fits)
        head = kept.orderBy("route_ord").limit(most)
        counted = head.withColumn("at", F.count("*").over(running)).withColumn("spent", F.sum("estimated_cost").over(running))
        call = lambda cap, start, name: F.when(F.col("at") + start > cap, name) if cap is not None else F.lit(None).cast("string")
        cost = lambda cap, start, name: F.when((F.col("estimated_cost") > 0) & (F.col("spent") + start > cap), name) if cap is not None else F.lit(None).cast("string")
        reason = F.coalesce(
            call(budget.run_calls, used.run_calls, "per_run_call_budget"), call(budget.daily_calls, used.run_calls + used.daily_calls, "daily_call_budget"),
            cost(budget.run_cost, used.run_cost, "per_run_cost_budget"), cost(budget.daily_cost, used.run_cost + used.daily_cost, "daily_cost_budget"),
        )
        first = "per_run_call_budget" if budget.run_calls is not None else "daily_call_budget" if budget.daily_calls is not None else "per_run_cost_budget" if budget.run_cost is not None else "daily_cost_budget"
        rest = kept.join(head.select("route_ord"), "route_ord", "left_anti").select(*cases.columns, F.lit(first).alias("reason"))
        inside = counted.select(*cases.columns, reason.alias("reason")).unionByName(rest)
    return inside.unionByName(over).withColumn("selected", F.col("reason").isNull()).withColumn("reason", F.coalesce("reason", F.lit("selected")))


def replay(routes: DataFrame, used: Used = Used()) -> Used:
    """What earlier route rows were charged for, added to ``used``: one row a stage comes back."""
    rows = routes.filter("call_count_charge > 0").groupBy("stage").agg(F.sum("call_count_charge").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).collect()
    for r in rows:
        used = used.plus(r.calls, r.cost, r.stage)
    return used


LOG = "stage string, case_id string, input_hash string, request_id string, cache_status string, validation_status string, failure_type string, input_tokens long, output_tokens long, cost double, prompt string, request_payload string, response string, provider string, model string, settings string, created_at timestamp"


def structured_calls(cases: DataFrame, provider: Provider | None, model: Model = Model(), cache: DataFrame | None = None, log: str | None = None, prices: tuple[float, float] = (0.4, 1.6)) -> DataFrame:
    """Answers of gated ``cases`` (case_id, stage, payload, and response where the stand-in answers):
    cache, else provider, then parsed by the stage's contract, and logged.

    Each distinct input is asked once. validation_status is valid or invalid; a provider that fails
    gives failure_type provider_error and no response. ``cache``: input_hash, response. The log gets
    the misses, as JSON lines appended under a folder of their own stage."""
    keyed = cases.withColumn("input_hash", input_hash(F.col("stage"), F.col("payload"), model)).withColumn("prompt", render(model.template, {"payload": F.col("payload")}))
    known = None if cache is None else cache.groupBy("input_hash").agg(F.min("response").alias("known"))
    keyed = keyed.withColumn("known", F.lit(None).cast("string")) if known is None else keyed.join(known, "input_hash", "left")
    asked = keyed.filter("known is null")
    once = asked.groupBy("input_hash").agg(F.min("stage").alias("stage"), F.min("payload").alias("payload"), *([F.min("response").alias("response")] if provider is None else []))
    if provider is None:
        answers = once.select("input_hash", F.col("response").alias("answer"))
    else:
        told = cut_lineage(once.withColumnRenamed("input_hash", "case_id"))
        answers = cut_lineage(routing.call_provider(told, provider)).select(F.col("case_id").alias("input_hash"), F.col("response").alias("answer"))
    met = keyed.drop("response").join(answers, "input_hash", "left")
    response = F.coalesce("known", "answer")
    valid = F.lit(False)
    for stage in decisions.CONTRACTS:
        valid = F.when(F.col("stage") == stage, decisions.parse(response, stage).isNotNull()).otherwise(valid)
    tokens = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    hit = F.col("known").isNotNull()
    out = met.select(
        "stage", "case_id", "input_hash", F.concat(F.lit("request_"), F.substring("input_hash", 1, 20)).alias("request_id"), F.when(hit, "hit").otherwise("miss").alias("cache_status"),
        F.when(valid, "valid").otherwise("invalid").alias("validation_status"), F.when(response.isNull(), "provider_error").when(~valid, "invalid_output").alias("failure_type"),
        tokens(F.col("prompt")).alias("input_tokens"), tokens(response).alias("output_tokens"),
        F.when(hit, 0.0).otherwise((tokens(F.col("prompt")) * prices[0] + tokens(response) * prices[1]) / 1e6).alias("cost"), "prompt", F.col("payload").alias("request_payload"), response.alias("response"),
    )
    if log is not None:
        out = cut_lineage(out)
        append_log(out.filter("cache_status = 'miss'"), model, log)
    return out


def append_log(calls: DataFrame, model: Model, path: str) -> None:
    """Calls as JSON lines, by stage, added to what is there."""
    rows = calls.withColumn("provider", F.lit(model.provider)).withColumn("model", F.lit(model.name)).withColumn("settings", F.lit(canonical(asdict(model)))).withColumn("created_at", F.current_timestamp())
    rows.select(*[x.split()[0] for x in LOG.split(", ")]).write.mode("append").partitionBy("stage").json(path)
