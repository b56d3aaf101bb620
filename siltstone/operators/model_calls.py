"""Calls of a model from the tasks: each distinct prompt once, in batches, failures kept apart by kind."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans import store

#: Attempts, the first wait in seconds (doubled each time), prompts of a batch, calls at a time, characters of an error that are kept.
ATTEMPTS, WAIT, BATCH, THREADS, SHOWN = 5, 2.0, 64, 8, 300


class Passing(Exception):
    """A failure that may pass: no connection, too many requests, the server's own errors."""


class Refused(Exception):
    """A failure of this prompt, which asking again doesn't mend (for instance one that is too long)."""


class BackendDown(RuntimeError):
    """Every call of a batch failed."""


def of_status(status: int, text: str = "") -> Exception | None:
    """The failure that an HTTP status stands for; none for 200."""
    if status == 200:
        return None
    return (Passing if status == 429 or status >= 500 else Refused)(f"{status}: {text[:SHOWN]}")


def retried(call: Callable[[str], str | None], prompt: str, attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call(prompt)``, again after a growing wait while it fails in passing; a null reply is empty.  Connection errors and timeouts pass too."""
    for attempt in range(attempts):
        try:
            return call(prompt) or ""
        except (Passing, ConnectionError, TimeoutError) as e:
            if attempt == attempts - 1:
                raise Passing(f"{attempts} attempts failed, the last with {type(e).__name__}: {e}") from e
            sleep(wait * 2**attempt)
    raise ValueError("no attempts")


def batch_replies(call: Callable[[str], str | None], prompts: list[str], pool: ThreadPoolExecutor, attempts: int, wait: float) -> list[tuple[str, str | None]]:
    """(reply, error) of each prompt, in order.  A prompt that fails has an empty reply and its error; where all fail the backend is down."""

    def one(prompt: str) -> tuple[str, str | None]:
        try:
            return retried(call, prompt, attempts, wait), None
        except Exception as e:  # kept with the prompt, unless all fail
            return "", f"{type(e).__name__}: {e}"[:SHOWN]

    found = list(pool.map(one, prompts))
    if found and all(error for _, error in found):
        raise BackendDown(f"all {len(found)} calls of a batch failed; first: {found[0][1]}")
    return found


def replies(prompts: DataFrame, call: Callable[[str], str | None], batch: int = BATCH, threads: int = THREADS, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """prompt, reply, error of each distinct prompt of ``prompts`` (prompt), as a table: whatever reads it asks nothing again.

    ``call`` is unpickled in the tasks and must be safe in threads.  Null and blank prompts aren't asked; they are in no row.
    """

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    part = rows.column("prompt").slice(at, batch)
                    found = batch_replies(call, part.to_pylist(), pool, attempts, wait)
                    yield pa.RecordBatch.from_arrays([part, pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["prompt", "reply", "error"])

    asked = prompts.select("prompt").where(F.trim("prompt") != "").distinct()
    return store.written(asked.mapInArrow(run, "prompt string, reply string, error string"), "replies")


def answered(rows: DataFrame, prompt: str, call: Callable[[str], str | None], reply: str = "reply", error: str = "error", **policy) -> DataFrame:
    """``rows`` with the reply to their ``prompt`` (a column) and its error: each distinct prompt is asked once; "" for a prompt that failed, null and null for none.

    A step whose model is a column function reads the reply: ``model=lambda _: F.col("reply")``.
    """
    found = replies(rows.select(F.col(prompt).alias("prompt")), call, **policy)
    found = found.select(F.col("prompt").alias("__prompt"), F.col("reply").alias(reply), F.col("error").alias(error))
    return rows.drop(reply, error).join(found, F.col(prompt) == F.col("__prompt"), "left").drop("__prompt")
