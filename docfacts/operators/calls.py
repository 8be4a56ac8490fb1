"""Asking a model from the executors: one call for each prompt, repeated on passing faults, failing by row and never by stage."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: HTTP statuses that pass.
PASSING_STATUS = frozenset({408, 409, 425, 429, 500, 502, 503, 504, 522, 524})


class Fault(Exception):
    """A failed call: code, and whether another try may help."""

    def __init__(self, code: str, retryable: bool, message: str = ""):
        super().__init__(message or code)
        self.code, self.retryable = code, retryable

    @classmethod
    def of_status(cls, status: int) -> Fault:
        return cls(f"http_{status}", status in PASSING_STATUS)


class Client(Protocol):
    """What a model's client must do; made once for each partition."""

    def complete(self, prompt: str) -> str: ...


def with_retry(call: Callable[[], str], attempts: int, base: float, most: float, sleep: Callable[[float], None], rng: random.Random) -> tuple[str | None, str | None, int]:
    """(reply, error code, calls): tries again after passing faults, after a time drawn from 0 to the doubled base, most at most."""
    for n in range(1, attempts + 1):
        try:
            return call(), None, n
        except Fault as fault:
            if not fault.retryable or n == attempts:
                return None, fault.code, n
            sleep(rng.uniform(0, min(most, base * 2 ** (n - 1))))
        except Exception as problem:  # noqa: BLE001
            return None, type(problem).__name__, n
    return None, "no_attempt", 0


def ask(prompts: DataFrame, client: Callable[[], Client], attempt: int = 1, attempts: int = 3, base: float = 0.5, most: float = 8.0, seed: int = 0) -> DataFrame:
    """prompts (doc_id, block_id, prompt) -> (doc_id, block_id, attempt, reply, error, calls): the replies table.

    A prompt that can't be answered has a null reply and its error; null prompts are not asked (error no_prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rng = client(), random.Random(seed)
        for pdf in batches:
            got = [(None, "no_prompt", 0) if p is None else with_retry(lambda p=p: model.complete(p), attempts, base, most, time.sleep, rng) for p in pdf["prompt"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "block_id": pdf["block_id"], "attempt": attempt, "reply": [g[0] for g in got], "error": [g[1] for g in got], "calls": [g[2] for g in got]})

    return prompts.select("doc_id", "block_id", "prompt").mapInPandas(run, "doc_id bigint, block_id string, attempt int, reply string, error string, calls int")


def repair_prompts(prompts: DataFrame, parsed: DataFrame, replies: DataFrame) -> DataFrame:
    """Prompts for the next attempt of the blocks whose reply broke the contract: the old prompt, the reply and what was wrong with it."""
    from pyspark.sql import functions as F

    bad = parsed.where(F.size("errors") > 0).select("doc_id", "block_id", "errors")
    told = prompts.join(bad, ["doc_id", "block_id"]).join(replies.select("doc_id", "block_id", "reply"), ["doc_id", "block_id"], "left")
    return told.select("doc_id", "block_id", F.concat("prompt", F.lit("\n<previous_reply>\n"), F.coalesce("reply", F.lit("")), F.lit("\n</previous_reply>\n<errors>\n"), F.array_join("errors", "\n"), F.lit("\n</errors>")).alias("prompt"))
