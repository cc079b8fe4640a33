"""A thin planner that composes DataFrames: retrieve, federate, widen, normalise, answer."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from ..operators import toolcalls
from .federation import Federation, relaxations
from .relax import widen


#: Calls worked on at once.
THREADS = 10


class TextModel(Protocol):
    def complete(self, role: str, prompt: str) -> str: ...


@dataclass
class TemplateModel:
    """A stand-in without a network: a template for each role, filled with the prompt."""

    templates: dict[str, str] = field(default_factory=dict)

    def complete(self, role: str, prompt: str) -> str:
        return self.templates.get(role, "{prompt}").format(prompt=prompt)


@dataclass
class Tool:
    """A remote action's place: parameters with their types, and what runs for them."""

    params: dict[str, type]
    run: Callable[..., DataFrame]

    def call(self, given: dict) -> DataFrame:
        missing = [p for p in self.params if p not in given]
        wrong = [p for p, t in self.params.items() if p in given and not isinstance(given[p], t)]
        if missing or wrong:
            raise TypeError(f"missing: {missing}, of a wrong type: {wrong}")
        return self.run(**{p: given[p] for p in self.params})


@dataclass
class Agent:
    """Runs planned calls against registered tools. Each call is a lazy DataFrame, so one job runs per result read."""

    tools: dict[str, Tool] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    retries: int = 10

    def allowed(self, service: str) -> bool:
        low = service.lower()
        for kind, words in toolcalls.KINDS:
            if any(w in low for w in words):
                return self.flags.get(kind, True)
        return True

    def run(self, calls: list[dict], read: Callable[[DataFrame], object] = lambda df: df) -> list[dict]:
        """Results in the order of calls; a failing call gives an error, not an end. Up to THREADS calls are worked on at once, with
        what read does to their DataFrames: jobs of different calls share the cluster."""

        def one(call: dict) -> dict:
            service = call.get("service_id") or call.get("service") or ""
            try:
                if service not in self.tools:
                    raise LookupError(f"Service {service} not found")
                found = self.tools[service].call(call.get("params") or call.get("parameters") or {})
                return {"service_id": service, "status": "success", "result": read(found)}
            except Exception as e:  # whatever a tool raises is its result
                return {"service_id": service, "status": "error", "error": str(e).strip().split("\n")[0]}

        wanted = [c for c in calls if self.allowed(c.get("service_id") or c.get("service") or "")]
        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(one, wanted))

    def plan(self, question: str, model: TextModel) -> list[dict]:
        """The calls in a planner's reply, whichever shape it has; no calls where it is no JSON."""
        try:
            said = json.loads(model.complete("plan", question))
        except ValueError:
            return []
        said = said.get("tool_calls", said.get("tool_call", said)) if isinstance(said, dict) else said
        return [c for c in (said if isinstance(said, list) else [said]) if isinstance(c, dict)]

    def answer(self, question: str, model: TextModel, rows: int = 20) -> dict:
        """Plan, filter, execute, collect and answer: calls, results (at most `rows` rows of each), errors and the model's reply."""
        calls = self.plan(question, model)
        ordered = sorted(calls, key=lambda c: self._place(c.get("service_id") or c.get("service") or ""))
        done = self.run(ordered, lambda df: [r.asDict(True) for r in df.limit(rows).collect()])
        good = [r for r in done if r["status"] == "success" and r["result"]]
        errors = [r["error"] for r in done if r["status"] == "error"]
        found = "\n".join(f"[{r['service_id']}] {json.dumps(r['result'], default=str)}" for r in good)
        reply = model.complete("response", f"{found}\n\n{question}".strip()) if good or not errors else model.complete("failure", "; ".join(errors))
        return {"calls": calls, "results": good, "errors": errors, "answered": bool(good), "response": reply}

    @staticmethod
    def _place(service: str) -> int:
        low = service.lower()
        return next((i for i, words in enumerate(toolcalls.ORDER.values()) if any(w in low for w in words)), len(toolcalls.ORDER))


def wider_search(federation: Federation, sql: str, attempts: int = 100) -> tuple[str, DataFrame] | None:
    """The statement, or where it gives no rows the nearest of its wider forms (see relax.widen; attempts of them at most) that gives some; with what it gives.
    Where all conjuncts together let nothing through, the statement without them is the last form."""
    df = federation.query(sql)
    if not df.isEmpty():
        return sql, df
    if found := widen(federation, sql, attempts):
        return found[0].sql, found[1]
    for form in relaxations(sql)[-1:]:
        if not (df := federation.query(form)).isEmpty():
            return form, df
    return None


def wider_everywhere(federation: Federation, sql: str, attempts: int = 100) -> list[dict]:
    """The same on each database by itself: for each, the form that gave rows and what it gave, or why there is none."""

    def one(db: str) -> dict:
        alone = Federation(federation.spark, {db: federation.databases[db]}, {k: v for k, v in federation.aliases.items() if k == db}, federation.blocking)
        try:
            found = wider_search(alone, sql, attempts)
        except Exception as e:  # one database's failure ends nothing
            return {"database": db, "status": "error", "error": str(e).strip().split("\n")[0]}
        return {"database": db, "status": "success", "statement": found[0], "result": found[1]} if found else {"database": db, "status": "empty"}

    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(one, federation.databases))
