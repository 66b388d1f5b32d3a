"""Asking a model for a JSON object: what is tried, in which order, and what it cost."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


class ReplayMiss(Exception):
    """A recording has no answer to this; asking again won't give one."""


@dataclass(frozen=True)
class Attempt:
    json_mode: bool
    temperature: float


#: Takes (system, user, attempt) and gives (content, prompt tokens, cached tokens, completion tokens).
Client = Callable[[str, str, Attempt], tuple[str, int, int, int]]


def plan(attempts: int) -> list[Attempt]:
    """JSON mode first, then plain, then plain and warmer each time: by 0.2, to 0.6."""
    return [Attempt(k == 0, min(0.2 * max(k - 1, 0), 0.6)) for k in range(attempts)]


def object_of(content: str) -> dict | None:
    """The JSON object in an answer: the whole, a fenced one, or what the first brace begins."""
    fenced = re.search(r"(?is)```(?:json)?\s*(\{.*?\})\s*```", content)
    for text in (content.strip(), fenced[1] if fenced else "", content[content.find("{") :] if "{" in content else ""):
        try:
            found, _ = json.JSONDecoder().raw_decode(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def ask(client: Client, system: str, user: str, attempts: int = 4) -> dict:
    """content (JSON text or None), attempts, prompt_tokens, cached_tokens, completion_tokens, error."""
    out = {"content": None, "attempts": 0, "prompt_tokens": 0, "cached_tokens": 0, "completion_tokens": 0, "error": None}
    for a in plan(attempts):
        out["attempts"] += 1
        try:
            content, *tokens = client(system, user, a)
        except ReplayMiss:
            return out | {"error": "ReplayMiss"}
        except Exception as e:  # noqa: BLE001  a backend is somebody else's program
            out["error"] = type(e).__name__
            continue
        for name, n in zip(("prompt_tokens", "cached_tokens", "completion_tokens"), tokens):
            out[name] += n
        found = object_of(content)
        if found is not None:
            return out | {"content": json.dumps(found), "error": None}
        out["error"] = "NoObject"
    return out


ANSWER = "content string, attempts int, prompt_tokens long, cached_tokens long, completion_tokens long, error string"


def asked(prompts: DataFrame, client: Callable[[], Client], system: str, attempts: int = 4) -> DataFrame:
    """Prompts (key, user) with their answers; the client is built once in a task. Callers ask for what no store has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for b in batches:
            rows = [{"key": k, **ask(c, system, u, attempts)} for k, u in zip(b["key"], b["user"])]
            yield pd.DataFrame(rows, columns=["key", *[f.split()[0] for f in ANSWER.split(", ")]])

    ship(prompts.sparkSession)
    return prompts.select(F.col("key").cast("string").alias("key"), "user").mapInPandas(run, f"key string, {ANSWER}")


def accounts(answers: DataFrame, by: list[str]) -> DataFrame:
    """What answers cost by group: calls, attempts, tokens, the share of cached ones, failures."""
    return answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("attempts").alias("attempts"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.coalesce(F.try_divide(F.sum("cached_tokens").cast("double"), F.sum("prompt_tokens")), F.lit(0.0)), 6).alias("cached_share"), F.count("error").alias("failed"),
    )
