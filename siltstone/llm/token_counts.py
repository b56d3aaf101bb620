"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one flat array of symbol ids with an offset for each.  In a round every pre-token applies
its own lowest-rank pair, wherever it stands, in one set of array operations over the whole batch; finished pre-tokens
leave.  The surviving symbols are the count, and ids are never listed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.pretokens import chunk_lines, pre_tokens

#: Entries of a worker's caches of counts before they are emptied.
CACHE = 800_000
#: Rank of symbols that don't merge.
NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Merges:
    """Merge table of a tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.single = np.zeros(256, dtype=np.int64)
        for letter, byte in byte_letters().items():
            self.single[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each piece (none is empty)."""
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        left, symbols = length.copy(), self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        alive = np.arange(len(pieces))
        rank = np.full(len(symbols), NEVER, dtype=np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[np.cumsum(length) - 1] = NEVER
        while len(alive):
            start = np.cumsum(length) - length
            lowest = np.minimum.reduceat(rank, start)
            going = lowest != NEVER
            if not going.all():  # finished pieces leave
                left[alive[~going]] = length[~going]
                stays = np.repeat(going, length)
                symbols, rank, alive, length, lowest = symbols[stays], rank[stays], alive[going], length[going], lowest[going]
                if not len(alive):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, length))
            # In a run of overlapping pairs every second one merges, from the left.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[place % 2 == 0]
            piece = np.searchsorted(np.cumsum(length), hit, side="right")
            symbols[hit] = self.into[rank[hit]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hit + 1] = False
            length = length - np.bincount(piece, minlength=len(length))
            symbols, rank = symbols[stays], rank[stays]
            # Only pairs beside a merged symbol change.
            at = np.flatnonzero(stays)
            where = np.searchsorted(at, hit)
            ends = np.zeros(len(symbols), dtype=bool)
            ends[np.cumsum(length) - 1] = True
            near = np.unique(np.concatenate([where, where[where > 0] - 1]))
            rank[near] = NEVER
            near = near[~ends[near]]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return left


class Counter:
    """Counts of texts, with caches of bounded size."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.find = Merges(path), pre_tokens(pattern)
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def pieces(self, chunks: list[str]) -> list[int]:
        """Counts of whole chunks."""
        split = [self.find(c) for c in chunks]
        known = dict.fromkeys(p for s in split for p in s)
        order = sorted(known, key=len)  # alike lengths finish in alike numbers of rounds
        for k in range(0, len(order), 50_000):
            some = order[k : k + 50_000]
            known.update(zip(some, self.merges.count([p.encode("utf-8", "replace") for p in some]).tolist(), strict=True))
        return [sum(map(known.__getitem__, s)) for s in split]

    def learn(self, cache: dict[str, int], chunks: set[str], before: str) -> None:
        new = [c for c in chunks if c not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(chunks)
        cache.update(zip(new, self.pieces([before + c for c in new]), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        totals, whole, cut = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            parts = [text or ""]
            for special in self.merges.special:  # each stands for one token, and splits the text
                parts = [x for p in parts for x in ([p] if special not in p else [y for q in p.split(special) for y in (q, None)][:-1])]
            for part in parts:
                if part is None:
                    totals[k] += 1
                elif part:
                    lines = chunk_lines(part)
                    if lines is None:
                        whole.append((k, part))
                    else:
                        cut.append((k, lines))
        self.learn(self.first, {line[0] for _, lines in cut for line in lines} | {"\n"}, "")
        spaced: set[str] = set()
        for _, lines in cut:
            for line in lines:
                spaced.update(line[1:])
        self.learn(self.spaced, spaced, " ")
        newline, first, inner = self.first["\n"], self.first.__getitem__, self.spaced.__getitem__
        for k, lines in cut:
            totals[k] += newline * (len(lines) - 1) + sum(first(line[0]) + sum(map(inner, line[1:])) for line in lines)
        for (k, _), n in zip(whole, self.pieces([p for _, p in whole]), strict=True):
            totals[k] += n
        return totals


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, batch: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Null texts are empty: 0 bytes, 0 tokens.  Special tokens' strings inside a text count as the one token that they name.
    Whole texts; repeated rows each give a row.  ``batch``: texts whose pre-tokens are merged together.
    """

    def run(batches):
        one = counter(path, pattern)
        for arrow in batches:
            for at in range(0, arrow.num_rows, batch):
                part = arrow.slice(at, batch)
                texts = part.column("text").to_pylist()
                n_bytes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(one.count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
