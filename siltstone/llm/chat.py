"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are "begins a turn of role r" and "goes on in a turn of role r".  A line emits features: the speaker marker it
starts with, whether it asks, its length, its layout; features are independent given the state.  Parameters are smoothed
counts over transcripts whose roles are known (a table of a few hundred counts), as whole numbers, so that scores are the
same however lines are cut into parts.

Lines are sorted by ranges over the whole table and cut into parts of at most ``PART`` lines.  Each part gives the best
score between any first and last state; up to 256 parts are combined to one such matrix, a transcript's matrices are
chained, and the states at the ends are passed down again, until each part is decoded between its two fixed states.  No
task holds a transcript's lines: what one task holds of a transcript is a matrix for each 65,536 lines.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import drop, table

#: "other" is any speaker of another name.
ROLES = ("system", "user", "assistant", "tool", "other")
#: Even: begins a turn of role k // 2; odd: goes on in it.
STATES = 2 * len(ROLES)
#: Bits of a line number inside a part, and of a part inside a group of parts.
BITS = 8
PART = 1 << BITS
#: Words that mark a speaker.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "prompter", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "response"),
    "tool": ("tool", "function", "observation"),
}
MARKER = r"(?i)^[\s#*>\[<|]*(" + "|".join(w for words in MARKERS.values() for w in words) + r")(?:\s*[\]>|*]*\s*[:>\]]+\**\x20?|\s*\|>\x20?)"
#: A name and a colon, where no known word marks the speaker.
NAME = r"^[#*\[<|]*([A-Za-z][A-Za-z0-9 _-]{0,31})[\]>|*]*:(?:\x20|$)"
#: Features and the number of values of each.
FEATURES = {"marker": 8, "asks": 2, "length": 8, "layout": 4}
#: Score of what can't be.
NEVER = -(2**50)


def with_features(lines: DataFrame) -> DataFrame:
    """``lines`` with marker (0 none, then by role, last any other name), asks, length, layout, and all of them in ``code``."""
    word = F.lower(F.regexp_extract("line", MARKER, 1))
    marker = F.when(F.col("line").rlike(NAME), len(ROLES)).otherwise(0)
    for k, words in enumerate(MARKERS.values()):
        marker = F.when(word.isin(*words), k + 1).otherwise(marker)
    found = lines.withColumns({
        "marker": marker.cast("int"), "asks": F.rtrim("line").endswith("?").cast("int"),
        "length": F.least(F.floor(F.log2(F.length("line") + 1) / 2), F.lit(6)).cast("int"),
        "layout": F.when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), 1).when(F.col("line").rlike(r"^(?:    |\t|```)"), 2).when(F.trim("line") == "", 3).otherwise(0).cast("int"),
    })
    code = F.lit(0)
    for f, n in FEATURES.items():
        code = code * n + F.col(f)
    return found.withColumn("code", code.cast("int"))


class Model:
    """Scores (scaled logarithms of probabilities): first state, transitions, and states by code of a line's features."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        first, moves = np.ones(STATES), np.full((STATES, STATES), 0.1)
        moves[:, 0::2] = 1.0
        values = {f: np.full((STATES, n), 0.5) for f, n in FEATURES.items()}
        # Before any count: a turn begins with its own marker or, less often, none, and goes on without one.
        values["marker"][:] = 0.02
        values["marker"][:, 0] = np.where(np.arange(STATES) % 2 == 0, 2.0, 10.0)
        for k in range(len(ROLES)):
            values["marker"][2 * k, k + 1] = 10.0
        for (what, a, b), n in counts.items():
            if what == "first":
                first[b] += n
            elif what == "move":
                moves[a, b] += n
            else:
                values[what][a, b] += n
        scaled = lambda v: np.rint(np.log(v / v.sum(axis=-1, keepdims=True)) * 2**16).astype(np.int64)
        self.first, self.moves = scaled(first), scaled(moves)
        self.first[1::2] = NEVER  # a transcript begins with a beginning
        goes_on = np.arange(1, STATES, 2)
        other = np.arange(STATES)[:, None] // 2 != goes_on[None, :] // 2
        self.moves[:, goes_on] = np.where(other, NEVER, self.moves[:, goes_on])  # a turn goes on in its own role only
        by_code = np.zeros((1, STATES), dtype=np.int64)
        for v in values.values():
            by_code = (by_code[:, None, :] + scaled(v).T[None]).reshape(-1, STATES)
        self.emitted = by_code

    def between(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best score from each first to each last state of parts, whose lines follow each other in ``codes``."""
        order = np.argsort(-sizes, kind="stable")
        at, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        best = np.full((len(sizes), STATES, STATES), 2 * NEVER)
        best[:, np.arange(STATES), np.arange(STATES)] = self.emitted[codes[at]]
        for step in range(1, sizes.max(initial=0)):
            live = np.searchsorted(-sizes, -step)
            best[:live] = np.maximum((best[:live, :, :, None] + self.moves).max(axis=2) + self.emitted[codes[at[:live] + step]][:, None, :], 2 * NEVER)
        out = np.empty_like(best)
        out[order] = best
        return out

    def decode(self, codes: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best states of parts whose first and last states are given."""
        order = np.argsort(-sizes, kind="stable")
        at, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        score = np.full((len(sizes), STATES), 2 * NEVER)
        score[np.arange(len(sizes)), first[order]] = 0
        back = np.zeros((len(codes), STATES), dtype=np.int8)
        longest = sizes.max(initial=0)
        lives = [np.searchsorted(-sizes, -step) for step in range(longest)]
        for step in range(1, longest):
            live = lives[step]
            through = score[:live, :, None] + self.moves
            back[at[:live] + step] = through.argmax(axis=1)
            score[:live] = np.maximum(through.max(axis=1) + self.emitted[codes[at[:live] + step]], 2 * NEVER)
        states = np.zeros(len(codes), dtype=np.int64)
        states[at + sizes - 1] = last[order]
        for step in range(longest - 1, 0, -1):
            here = at[: lives[step]] + step
            states[here - 1] = back[here, states[here]]
        return states

    def combined(self, parts: np.ndarray) -> np.ndarray:
        """One matrix for consecutive parts."""
        best = parts[0]
        for m in parts[1:]:
            into = (best[:, :, None] + self.moves).max(axis=1)
            best = np.maximum((into[:, :, None] + m).max(axis=1), 2 * NEVER)
        return best

    def chain(self, parts: np.ndarray, first: int | None = None, last: int | None = None) -> tuple[list[int], list[int]]:
        """First and last states of consecutive parts on the best path, which begins and ends where ``first`` and ``last`` say."""
        score = self.first if first is None else np.where(np.arange(STATES) == first, 0, NEVER)
        steps = []
        for k, m in enumerate(parts):
            came, into = None, score
            if k:
                through = score[:, None] + self.moves
                came, into = through.argmax(axis=0), through.max(axis=0)
            through = into[:, None] + m
            steps.append((came, through.argmax(axis=0)))
            score = through.max(axis=0)
        z = int(score.argmax()) if last is None else last
        a, ends = [], []
        for came, start in reversed(steps):
            begin = int(start[z])
            a.append(begin)
            ends.append(z)
            z = int(came[begin]) if came is not None else -1
        return a[::-1], ends[::-1]


def learn(lines: DataFrame) -> Model:
    """Model from ``lines`` (transcript, part, line_no, features, role, opens): smoothed counts, some hundred rows at most."""
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    rows = lines.withColumn("state", role * 2 + F.when(F.col("opens"), 0).otherwise(1))
    first = rows.groupBy("transcript").agg(F.min_by("state", "line_no").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    first = first.select(F.lit("first").alias("what"), F.lit(0).alias("a"), "b", "n")
    rows = rows.withColumn("before", F.lag("state").over(W.partitionBy("transcript", "part").orderBy("line_no")))
    items = F.array(
        F.struct(F.lit("move").alias("what"), F.col("before").alias("a"), F.col("state").alias("b")),
        *[F.struct(F.lit(f).alias("what"), F.col("state").alias("a"), F.col(f).alias("b")) for f in FEATURES],
    )
    counts = rows.select(F.explode(items).alias("i")).where("i.a IS NOT NULL").groupBy("i.what", "i.a", "i.b").agg(F.count("*").alias("n"))
    return Model({(r["what"], r["a"], r["b"]): float(r["n"]) for r in first.union(counts).collect()})


def runs(batches, keys: list[str]):
    """Tables of whole groups of equal ``keys`` from sorted Arrow batches, with the place where each group starts and its size."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
        if held is None or not held.num_rows:
            continue
        changes = np.zeros(held.num_rows - 1, dtype=bool)
        for k in keys:
            c = held.column(k).combine_chunks()
            changes |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(changes) + 1, [held.num_rows]])
        if batch is not None:  # the last group may go on
            edges = edges[:-1]
        if edges[-1]:
            yield held.slice(0, edges[-1]).combine_chunks(), edges[:-1], np.diff(edges)
            held = held.slice(edges[-1])


def matrices(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.int64).reshape(STATES, STATES) for b in column.to_pylist()])


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """transcript, part, start, states, turns, n of each part of ``lines`` (transcript, part, line_no, code).

    A part's lines have consecutive numbers from ``start``; states and turns (turns begun in the part so far) hold one
    number for each, n counts the turns that the part begins.
    """
    packed = lines.groupBy("transcript", "part").agg(F.min("line_no").alias("start"), F.array_sort(F.collect_list(F.struct("line_no", "code"))).alias("c"))
    packed = packed.select("transcript", "part", "start", F.transform("c", lambda s: s["code"]).alias("codes"))

    def flat(batch):
        lists = batch.column("codes")
        return lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def scores(batches):
        for batch in batches:
            if batch.num_rows:
                best = model.between(*flat(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() for m in best], pa.binary())], names=[*batch.schema.names, "best"])

    parts = table(packed.mapInArrow(scores, "transcript string, part bigint, start bigint, codes array<int>, best binary"), "chat-parts")
    thin = parts.select("transcript", F.shiftright("part", BITS).alias("group"), "part", "best")
    order = lambda df, *on: df.repartition(*on[:-1]).sortWithinPartitions(*on)

    def combine(batches):
        for t, starts, sizes in runs(batches, ["transcript", "group"]):
            whole = [model.combined(matrices(t.column("best").slice(a, n))).tobytes() for a, n in zip(starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("transcript").take(starts).combine_chunks(), t.column("group").take(starts).combine_chunks(), pa.array(whole, pa.binary())], names=["transcript", "group", "best"])

    def top(batches):
        for t, starts, sizes in runs(batches, ["transcript"]):
            found = [model.chain(matrices(t.column("best").slice(a, n))) for a, n in zip(starts, sizes, strict=True)]
            a, z = [x for f in found for x in f[0]], [x for f in found for x in f[1]]
            yield pa.RecordBatch.from_arrays([t.column("transcript").combine_chunks(), t.column("group").combine_chunks(), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["transcript", "group", "a", "z"])

    def down(batches):
        for t, starts, sizes in runs(batches, ["transcript", "group"]):
            first, last = t.column("a").to_numpy(), t.column("z").to_numpy()
            found = [model.chain(matrices(t.column("best").slice(k, n)), int(first[k]), int(last[k])) for k, n in zip(starts, sizes, strict=True)]
            a, z = [x for f in found for x in f[0]], [x for f in found for x in f[1]]
            yield pa.RecordBatch.from_arrays([t.column("transcript").combine_chunks(), t.column("part").combine_chunks(), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["transcript", "part", "a", "z"])

    groups = order(thin, "transcript", "group", "part").mapInArrow(combine, "transcript string, group bigint, best binary")
    ends = order(groups, "transcript", "group").mapInArrow(top, "transcript string, group bigint, a int, z int")
    fixed = order(thin.join(ends, ["transcript", "group"]), "transcript", "group", "part").mapInArrow(down, "transcript string, part bigint, a int, z int")

    def states(batches):
        for batch in batches:
            if batch.num_rows:
                codes, sizes = flat(batch)
                found = model.decode(codes, sizes, batch.column("a").to_numpy(), batch.column("z").to_numpy())
                begun, at = np.cumsum(found % 2 == 0), np.concatenate([[0], np.cumsum(sizes)])
                before = np.concatenate([[0], begun])[at]
                own = begun - np.repeat(before[:-1], sizes)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (found, own)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("transcript", "part", "start")), *lists, pa.array(np.diff(before), pa.int64())], names=["transcript", "part", "start", "states", "turns", "n"])

    decoded = parts.drop("best").join(fixed, ["transcript", "part"]).mapInArrow(states, "transcript string, part bigint, start bigint, states array<int>, turns array<int>, n bigint")
    decoded = table(decoded, "chat-states")
    drop(parts)
    return decoded


def turns(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id, copies, turn (from 0), role, n_lines, text, rendered of each turn of parsed lines: <|role|>, the text, <|end|>.

    A speaker marker is taken off only where its line begins a turn of the marker's role.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy("transcript").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = (F.col("line_no") - F.col("start")).cast("int")
    rows = lines.join(parsed.withColumn("before", before), ["transcript", "part"]).withColumns({"state": F.get("states", at), "turn": F.col("before") + F.get("turns", at) - 1})
    named = F.when((F.col("state") == STATES - 2) & (F.col("marker") == len(ROLES)), F.lower(F.trim(F.regexp_extract("line", NAME, 1))))
    own = (F.col("state") % 2 == 0) & (F.col("marker") == F.shiftright("state", 1) + 1)
    body = F.when(named.isNotNull(), F.regexp_replace("line", NAME, "")).when(own, F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    rows = rows.select("transcript", "conv_id", "copies", "turn", "state", "line_no", body.alias("body"), named.alias("named"))
    found = rows.groupBy("transcript", "turn").agg(
        F.first("conv_id").alias("conv_id"), F.first("copies").alias("copies"), F.min("state").alias("state"), F.max("named").alias("named"),
        F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("l"),
    )
    text = F.array_join(F.transform("l", lambda s: s["body"]), "\n")
    role = F.coalesce("named", F.get(F.array(*[F.lit(r) for r in ROLES]), F.shiftright("state", 1)))
    found = found.select("conv_id", "copies", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.size("l").cast("long").alias("n_lines"), text.alias("text"))
    return found.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def canonical(role):
    """The role that a word names: itself, or that of the marker it is; "other" for anything else."""
    word = F.lower(F.trim(role))
    out = F.lit("other")
    for known, words in MARKERS.items():
        out = F.when(word.isin(*words), known).otherwise(out)
    return out


def transcript_lines(conversations: DataFrame, unmarked: int = 4) -> DataFrame:
    """Lines of plain transcripts of ``conversations`` (conv_id, turn, role, text), as a forum or log shows them.

    Turns follow each other; one in ``unmarked`` of a known role lacks its speaker marker (never one whose own text
    begins like a marker), and the markers' words and punctuation vary by conversation.  role and opens are what a parser
    has to recover.  Null texts are empty lines, null turns come first, rows of one turn follow by a hash of role and
    text, repeated rows follow each other whole.  A row whose conv_id is null is a transcript of its own; ``copies`` says
    how often it occurs (1 elsewhere).
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    lone = F.concat(F.lit("null/"), F.md5(F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("?")), F.coalesce("role", F.lit("?")), "text")))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3)).cast("int")
    names = {"system": ("System", "### Instruction", "[system]"), "user": ("User", "### Human", "[user]"), "assistant": ("Assistant", "### Assistant", "[bot]"), "tool": ("Tool", "### Observation", "[tool]")}
    marker = F.when(F.trim("role").rlike("^[A-Za-z][A-Za-z0-9 _-]{0,31}$"), F.concat(F.trim("role"), F.lit(": "))).otherwise("Other: ")
    for role, words in names.items():
        marker = F.when(F.col("known") == role, F.concat(F.get(F.array(*[F.lit(w) for w in words]), style), F.lit(": "))).otherwise(marker)
    silent = (F.pmod(F.xxhash64("conv_id", "turn", F.lit("m")), F.lit(unmarked)) == 0) & (F.col("known") != "other") & ~F.col("text").rlike(MARKER)
    rows = rows.withColumn("known", canonical(F.col("role"))).select(
        F.coalesce(F.col("conv_id").cast("string"), lone).alias("transcript"), "conv_id", "turn", F.xxhash64("text", "role").alias("h"), F.col("known").alias("role"),
        F.when(F.col("conv_id").isNull(), F.col("n")).otherwise(1).alias("copies"), F.explode(F.sequence(F.lit(1), F.when(F.col("conv_id").isNull(), 1).otherwise(F.col("n")))).alias("copy"),
        F.concat(F.when(silent, "").otherwise(marker), "text").alias("text"),
    )
    rows = rows.select("transcript", "conv_id", "turn", "h", "role", "copies", "copy", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = ["transcript", "turn", "h", "copy", "pos"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("line_no", F.monotonically_increasing_id())
    return numbered.select("transcript", "conv_id", "copies", F.shiftright("line_no", BITS).alias("part"), "line_no", "role", (F.col("pos") == 0).alias("opens"), "line")


def format_chats(conversations: DataFrame, fold: int = 5) -> DataFrame:
    """conv_id, turn, role, n_lines, text, rendered: turns recovered from the plain transcripts of ``conversations``.

    The model learns from transcripts whose hash is not a multiple of ``fold``.  Roles are system, user, assistant, tool,
    or another speaker's name in lower case ("other" where a name isn't plain letters); a role that is a marker's word is
    the marker's.  See ``transcript_lines`` for nulls and repeated rows.  Other columns are ignored.
    """
    lines = table(with_features(transcript_lines(conversations)), "transcript-lines")
    model = learn(lines.where(F.pmod(F.xxhash64("transcript"), F.lit(fold)) != 0))
    found = turns(lines, parse(lines, model))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("conv_id", "turn", "role", "n_lines", "text", "rendered")
