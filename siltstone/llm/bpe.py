"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols.  The queue has a bucket per merge rank that holds list positions, and a bitmap
tree of 512-bit words over the ranks: find-first-set from the top gives the lowest rank that waits, in as many steps for
a pre-token of a million bytes as for one of ten.  Entries whose symbols have changed since are skipped when they come up.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.pretokens import TwoGenerations, chunk_lines, pre_tokens

#: Entries of one generation of a worker's two caches, about 250 bytes each.
CACHE = 450_000
#: Rows encoded or decoded at a time.
ROWS = 1000


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file (lines of base64 token and rank) by rank."""
    with open(path, "rb") as lines:
        ranks = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    tokens = [b""] * (max(ranks)[0] + 1)
    for rank, token in ranks:
        tokens[rank] = token
    return tokens


#: Bits of a word of the bitmap tree: two levels of 512-bit words serve 2**18 ranks.
BITS = [1 << k for k in range(512)]


class RankQueue:
    """Buckets of list positions by merge rank, under a bitmap tree of two levels of 512-bit words.

    ``Codec.merge`` works on the levels directly; a queue is empty again after each pre-token.
    """

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * 512


class Codec:
    """Encoder of one rank file."""

    def __init__(self, path: str, pattern: str, most: int = CACHE):
        self.tokens = vocabulary(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        if len(self.tokens) > 1 << 18:
            raise ValueError(f"{path}: {len(self.tokens)} ranks, at most {1 << 18} are supported")
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        # Rank of each pair of bytes, and of none.
        self.byte_pairs = [self.ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.queue = RankQueue()
        self.find = pre_tokens(pattern)
        self.first = TwoGenerations(self.encode_chunk, most)
        self.spaced = TwoGenerations(lambda chunk: self.encode_chunk(" " + chunk), most)

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self.first, self.spaced):
            cache.clear()
            cache.old = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging."""
        n, pair, byte_pairs, bits = len(piece), self.pairs.get, self.byte_pairs, BITS
        symbols = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets, low, top = self.queue.buckets, self.queue.low, 0
        # The rank of the pair that starts at a position now: an entry of another rank is stale.
        waits = [byte_pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        for at, rank in enumerate(waits):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(at)  # ascending, so a heap
                continue
            buckets[rank] = [at]
            high = rank >> 9
            low[high] |= bits[rank & 511]
            top |= bits[high]
        waits.append(None)
        while top:
            # Find-first-set, from the top: the lowest rank that waits, and its leftmost position.
            high = (top & -top).bit_length() - 1
            word = low[high]
            bit = word & -word
            rank = high << 9 | bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                word = low[high] = word ^ bit
                if not word:
                    top &= top - 1
            if waits[at] != rank:
                continue
            right, left = after[at], before[at]
            symbols[at], symbols[right], waits[right] = rank, -1, None
            then = after[at] = after[right]
            if then < n:
                before[then] = at
                fresh = waits[at] = pair(rank << 20 | symbols[then])
                if fresh is not None:
                    if fresh in buckets:
                        heappush(buckets[fresh], at)
                    else:
                        buckets[fresh] = [at]
                        high = fresh >> 9
                        low[high] |= bits[fresh & 511]
                        top |= bits[high]
            else:
                waits[at] = None
            if left >= 0:
                fresh = waits[left] = pair(symbols[left] << 20 | rank)
                if fresh is not None:
                    if fresh in buckets:
                        heappush(buckets[fresh], left)
                    else:
                        buckets[fresh] = [left]
                        high = fresh >> 9
                        low[high] |= bits[fresh & 511]
                        top |= bits[high]
        return [s for s in symbols if s >= 0]

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        return array("i", (whole,) if whole is not None else self.merge(raw)).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        pieces = self.find(chunk)
        if len(pieces) == 1:
            return self.encode_piece(chunk)
        first, spaced = self.first, self.spaced
        return b"".join([spaced[p[1:]] if p[0] == " " and len(p) > 1 else first[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids as bytes of int32."""
        if not text:
            return b""
        lines = chunk_lines(text)
        if lines is None:
            return self.encode_chunk(text)
        newline, spaced, out = self.first["\n"], self.spaced.__getitem__, []
        for k, line in enumerate(lines):
            if k:
                out.append(newline)
            out.append(self.first[line[0]])
            out.extend(map(spaced, line[1:]))
        return b"".join(out)


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, most: int = CACHE) -> Codec:
    """The codec of a file with caches of ``most`` entries, built once in each Python worker."""
    if (path, pattern, most) not in _codecs:
        _codecs[path, pattern, most] = Codec(path, pattern, most)
    return _codecs[path, pattern, most]


def pieces(batches):
    """Arrow batches of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", most: int = CACHE) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of ``text``; other columns stay, one named ``ids`` is replaced.

    Null texts are empty.  Whole texts of any length; ties between equal ranks go to the left, as in the library.
    ``path`` must be readable on every executor (it is part of the installed tokenizers, not of the data).
    """
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        one = codec(path, pattern, most)
        for batch in pieces(batches):
            found = [one.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, ids])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out`` (binary) in place of ``ids``; null ids give empty bytes.  An id outside the vocabulary is an error."""
    keep = [c for c in docs.columns if c not in (ids, out)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in keep), T.StructField(out, T.BinaryType())])

    def run(batches):
        token = vocabulary(path).__getitem__
        for batch in pieces(batches):
            column = batch.column(ids)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # offsets of a slice count from the values' start
            found = [b"".join(map(token, values[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def ids_digest(ids):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text): encode, then decode the ids."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "ids")
    return decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded_documents(docs: DataFrame, path: str, pattern: str, most: int = 100_000) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and intact (the ids decode to the text again) of each row of ``docs``.

    One pass through Python encodes and decodes.  Workers go on to other stages, so a task empties its caches (of
    ``most`` entries) when it ends.
    """
    rows = docs.select("doc_id", "lang", "source", "text")
    keep = ["doc_id", "lang", "source"]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("intact", T.BooleanType())]

    def run(batches):
        one = codec(path, pattern, most)
        token = one.tokens.__getitem__
        try:
            for batch in pieces(batches):
                texts = batch.column("text").to_pylist()
                found = [np.frombuffer(one.encode(t), dtype=np.int32) for t in texts]
                intact = [b"".join(map(token, ids.tolist())) == (t or "").encode("utf-8", "replace") for ids, t in zip(found, texts, strict=True)]
                sizes = np.array([len(ids) for ids in found], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes), lists, pa.array(intact)], names=[*keep, *(f.name for f in added)])
        finally:
            one.forget()

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name in keep), *added]))
