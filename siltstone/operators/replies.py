"""Reading what a routing model replies: JSON among prose, cut off, or outside of its candidates."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a reason that are kept, and the reason of a reply that ends early.
REASON, TRUNCATED = 300, "(reply truncated)"
SALVAGED = re.compile(r'"categories"\s*:\s*\[([^\]]*)\]')


def routing(text: str, at: int) -> dict | None:
    """The JSON object that starts at ``at``, whatever follows it, if it has a list of categories."""
    try:
        read = json.JSONDecoder().raw_decode(text, at)[0]
    except (ValueError, RecursionError):
        return None
    return read if isinstance(read.get("categories"), list) else None


def chosen(values: list, candidates: list[str]) -> list[str] | None:
    """Candidates that ``values`` names, in the candidates' order; none where it names anything else."""
    named = [str(v).lower().strip() for v in values]
    return [c for c in candidates if c in named] if set(named) <= set(candidates) else None


def parse(reply: str | None, candidates: list[str] | None) -> tuple[list[str] | None, str | None]:
    """(categories, reason); an empty list abstains, none is a reply without use.

    1. The last object that is JSON with a list of categories counts, whether or not its categories are candidates;
       braces in its strings are text, and prose may stand around it.
    2. Without one: what follows the first brace, if one more brace at its end makes it such an object.
    3. Else the first list of categories that is whole; its reason is lost.
    """
    text, known = reply or "", candidates or []
    starts = [at for at, c in enumerate(text) if c == "{"]
    for at in reversed(starts):
        if (read := routing(text, at)) is not None:
            return with_reason(read, known)
    if starts and (read := routing(text[starts[0] :].strip() + "}", 0)) is not None:
        return with_reason(read, known)
    if m := SALVAGED.search(text):
        try:
            values = json.loads(f"[{m.group(1)}]")
        except (ValueError, RecursionError):
            return None, None
        picked = chosen(values, known)
        return picked, None if picked is None else TRUNCATED
    return None, None


def with_reason(read: dict, candidates: list[str]) -> tuple[list[str] | None, str | None]:
    picked = chosen(read["categories"], candidates)
    return picked, None if picked is None else str(read.get("reason", ""))[:REASON]


def parsed(reply: Column, candidates: Column) -> Column:
    """struct<categories, reason> of each reply; both null for one without use."""

    def run(replies: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = [parse(r, None if k is None else list(k)) for r, k in zip(replies, known, strict=True)]
        return pd.DataFrame({"categories": [c for c, _ in rows], "reason": [r for _, r in rows]})

    return F.pandas_udf(run, "categories array<string>, reason string")(reply, candidates)
