"""Splitting text by a ladder of separators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators from the coarsest, budget and overlap.
LADDER = ("\n\n", "\n", " ", "​", "，", "、", "．", "。", "")
BUDGET, OVERLAP = 200, 40


def cut(text: str, separator: str) -> list[str]:
    """Pieces of ``text``, each but the first beginning with the separator; single characters for an empty one."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def merge(pieces: list[tuple[str, int]], budget: int, overlap: int) -> list[str]:
    """Runs of pieces (text, length) as chunks within the budget, each beginning with what ends the one before, as far as overlap and budget allow."""
    done, open_, used = [], deque(), 0
    for piece, size in pieces:
        if used + size > budget and open_:
            done.append("".join(p for p, _ in open_))
            while open_ and (used > overlap or used + size > budget):
                used -= open_.popleft()[1]
        open_.append((piece, size))
        used += size
    if open_:
        done.append("".join(p for p, _ in open_))
    return done


def split(text: str | None, budget: int = BUDGET, overlap: int = OVERLAP, ladder: tuple[str, ...] = LADDER, count: Callable[[str], int] = len) -> list[str]:
    """Chunks of a text.

    1. The separator is the first of the ladder that occurs in the text; the last of the ladder where none does.
    2. Pieces begin with their separator.  Neighbours that are each shorter than the budget are merged into chunks
       within it; a chunk repeats the last pieces of the one before, at most ``overlap`` long.
    3. A piece of the budget or more is split alone, by the part of the ladder below its separator; with nothing
       below it stays whole.
    4. White space at the ends of chunks goes, and so do empty chunks.  Null is an empty text.
    """
    done: list[str] = []
    todo: list = [(text or "", ladder)]  # texts to split, and runs of pieces to merge, last first
    while todo:
        what, rungs = todo.pop()
        if rungs is None:
            done += merge(what, budget, overlap)
            continue
        at = next((k for k, s in enumerate(rungs) if s == "" or s in what), len(rungs) - 1)
        below, steps, run = rungs[at + 1 :], [], []
        for piece in cut(what, rungs[at]):
            size = count(piece)
            if size < budget:
                run.append((piece, size))
                continue
            if run:
                steps.append((run, None))
                run = []
            steps.append((piece, below) if below else ([(piece, 0)], None))
        if run:
            steps.append((run, None))
        todo += reversed(steps)
    return [c for c in map(str.strip, done) if c]


def chunks(text: Column, budget: int = BUDGET, overlap: int = OVERLAP, ladder: tuple[str, ...] = LADDER, count: Callable[[str], int] = len) -> Column:
    """array<string>: the chunks of each text, by ``split``; ``count`` measures a piece (characters, words, tokens)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([split(t, budget, overlap, ladder, count) for t in texts])

    return F.pandas_udf(run, "array<string>")(text)
