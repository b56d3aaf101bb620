"""Calls with retries, runs that go on, replies in every state, streams that start again."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from siltstone.operators import model_calls, replies, resume
from siltstone.sources.tables import latest
from siltstone.streaming import ingest


def failing(kinds):
    """A call that fails in the given ways, one after the other, and then answers."""
    left = list(kinds)

    def call(prompt):
        if left:
            raise left.pop(0)
        return f"<{prompt}>"

    return call


def test_only_what_may_pass_is_asked_again():
    waits = []
    passing = [model_calls.Passing("429"), ConnectionError("gone"), TimeoutError()]
    assert model_calls.retried(failing(passing), "p", sleep=waits.append) == "<p>" and waits == [2.0, 4.0, 8.0]
    for error in (model_calls.Refused("400"), ValueError("bug")):
        waits.clear()
        with pytest.raises(type(error)):
            model_calls.retried(failing([error]), "p", sleep=waits.append)
        assert waits == []
    with pytest.raises(model_calls.Passing, match="5 attempts failed"):
        model_calls.retried(failing([model_calls.Passing("503")] * 9), "p", sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0] and model_calls.retried(lambda p: None, "p") == ""
    assert [type(model_calls.of_status(s)) for s in (200, 400, 404, 429, 500, 503)] == [type(None), model_calls.Refused, model_calls.Refused, *[model_calls.Passing] * 3]


def test_a_batch_keeps_its_order_and_its_failures():
    def call(p):
        if p == "bad":
            raise model_calls.Refused("400: too long")
        return p.upper()

    with ThreadPoolExecutor(3) as pool:
        assert model_calls.batch_replies(call, ["a", "bad", "b"], pool, 2, 0) == [("A", None), ("", "Refused: 400: too long"), ("B", None)]
        with pytest.raises(model_calls.BackendDown):
            model_calls.batch_replies(call, ["bad", "bad"], pool, 2, 0)
        assert model_calls.batch_replies(call, [], pool, 2, 0) == []


def test_each_prompt_is_asked_once(spark, tmp_path):
    where = str(tmp_path)

    def call(p):
        import os
        import uuid

        with open(os.path.join(where, uuid.uuid4().hex), "w") as f:
            f.write(p)
        return p[::-1]

    rows = spark.createDataFrame([(k, f"p{k % 7}", "x") for k in range(50)] + [(90, None, "x"), (91, "  ", "x")], "id int, prompt string, reply string").repartition(4)
    got = model_calls.answered(rows, "prompt", call, batch=3)
    for _ in range(2):  # read twice, asked once
        assert {r["id"]: r["reply"] for r in got.collect()} == {**{k: f"{k % 7}p" for k in range(50)}, 90: None, 91: None}
    assert sorted(open(f).read() for f in tmp_path.iterdir()) == [f"p{k}" for k in range(7)]
    with pytest.raises(Exception, match="BackendDown"):
        model_calls.answered(rows, "prompt", failing([model_calls.Refused("x")] * 99), threads=1).collect()


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"g{k % 6}", f"t{k}") for k in range(30)] + [(99, None, "none")], "id int, part string, prompt string")
    asked, down = [], {"g1", "g2", "g3", "g4"}

    def work(some):
        name = some.first()["part"] if some.limit(1).count() else None
        asked.append(name)
        if name in down:
            raise model_calls.BackendDown("no server")
        return some.withColumn("answer", F.upper("prompt"))

    path = str(tmp_path / "run")
    with pytest.raises(resume.Stopped):
        resume.run_groups(rows, "part", work, path)
    assert asked == ["g0", "g1", "g2", "g3"] and {r["group"]: r["done"] for r in resume.progress(spark, path).collect()} == {"g0": True, "g1": False, "g2": False, "g3": False}
    down.clear()
    asked.clear()
    got = resume.run_groups(rows, "part", work, path)
    whole = resume.run_groups(rows, "part", work, str(tmp_path / "other"))
    assert asked[:5] == ["g1", "g2", "g3", "g4", "g5"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 30
    asked.clear()
    assert resume.run_groups(rows, "part", work, path).count() == 30 and asked == []


def test_a_run_killed_between_results_and_progress_does_that_group_again(spark, tmp_path):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(8)], "id int, part string")
    path = str(tmp_path)

    def killed(some):
        if some.first()["part"] == "b":
            raise KeyError("killed")
        return some

    with pytest.raises(KeyError):
        resume.run_groups(rows, "part", killed, path)
    spark.range(3).selectExpr("cast(id as int) id", "'b' part").write.parquet(f"{path}/results/{resume.folder('b')}")  # what it had begun
    assert sorted(r["id"] for r in resume.run_groups(rows, "part", lambda some: some, path).collect()) == list(range(8))


CANDIDATES = ["risk", "business", "legal"]
REPLIES = [
    ('{"categories": ["Risk"], "reason": "why"}', (["risk"], "why")),
    ('x {"categories": ["legal", " RISK "], "reason": "a {b} c"} y {z}', (["risk", "legal"], "a {b} c")),
    ('{"categories": ["risk"]} no, {"categories": ["legal"]}', (["legal"], "")),
    ('{"categories": ["risk"], "reason": "r"} {"categories": "x"} {"a": 1}', (["risk"], "r")),
    ('{"categories": ["risk"]} {"categories": ["other"]}', (None, None)),
    ('{"out": {"categories": ["risk"], "reason": "in"}}', (["risk"], "in")),
    ('{"categories": ["risk"], "reason": "}{\\" }"}', (["risk"], '}{" }')),
    ('said {"categories": ["risk"], "reason": "cut"', (["risk"], "cut")),
    ('{"categories": ["risk", "legal"], "reason": "cut of', (["risk", "legal"], "(reply truncated)")),
    ('{"categories": ["risk", "le', (None, None)),
    ('{"categories": [], "reason": "none fits"}', ([], "none fits")),
    ('{"categories": [1]}', (None, None)),
    ('{"categories": ["risk"], "reason": ' + json.dumps("r" * 999) + "}", (["risk"], "r" * 300)),
    ('{"categories": ["risk"], "reason": null}', (["risk"], "None")),
    ("{" * 3000 + "}" * 3000, (None, None)),
    ('"quoted { text" {"categories": ["risk"]}', (["risk"], "")),
    ("", (None, None)),
    (None, (None, None)),
]


def test_replies_by_hand(spark):
    for reply, want in REPLIES:
        assert replies.parse(reply, CANDIDATES) == want, reply
    df = spark.createDataFrame([(k, r, CANDIDATES) for k, (r, _) in enumerate(REPLIES)] + [(99, '{"categories": ["risk"]}', None)], "k int, reply string, c array<string>")
    got = {r["k"]: r["p"] for r in df.select("k", replies.parsed(F.col("reply"), F.col("c")).alias("p")).collect()}
    assert {k: (p["categories"], p["reason"]) for k, p in got.items()} == {k: w for k, (_, w) in enumerate(REPLIES)} | {99: (None, None)}


def test_objects_among_prose_are_found():
    rng = random.Random(1)
    for _ in range(300):
        read = {"categories": rng.sample(CANDIDATES, rng.randint(0, 3)), "reason": "".join(rng.choice('ab{}"\\ é') for _ in range(9))}
        text = "".join(rng.choice("word } . ,") for _ in range(9)) + json.dumps(read) + rng.choice(["", " }", " done.", " {", " {}"])
        assert replies.parse(text, CANDIDATES) == ([c for c in CANDIDATES if c in read["categories"]], read["reason"])


def test_streams_start_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    files = [[(k % 9, k, f"k{k}") for k in range(n, n + 20)] for n in (0, 20, 40)]
    schema = "user int, at int, k string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        return sorted(map(tuple, ingest.upserted(ingest.arriving(spark, source), path, ["user"], ["at"], buckets=4).collect()))

    seen = []
    for rows in files:
        arrive(rows)
        seen += rows
        want = sorted(map(tuple, latest(spark.createDataFrame(seen, schema), ["user"], ["at"]).collect()))
        assert run() == want == run()  # once more with nothing new
    arrive([(3, 999, "only one bucket")])
    assert (3, 999, "only one bucket") in run() and len(run()) == 9
    held = [(b, v) for v in ingest.versions(spark, f"{path}/data") for b in ingest._names(spark, f"{path}/data/v{v}") if b.startswith("__bucket")]
    assert max(sum(b == x for x, _ in held) for b, _ in held) <= 3


def test_windows_start_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: {(str(r["start"]), r["kind"]): r["n"] for r in ingest.windowed(ingest.arriving(spark, source), path, "at", ["kind"], late="30 days").collect()}
    add = lambda days: spark.createDataFrame([(d, "x") for d in days], "d string, kind string").select(F.to_timestamp("d").alias("at"), "kind").coalesce(1).write.mode("append").parquet(source)
    add(["2024-01-01", "2024-01-01", "2024-01-02"])
    first = run()
    assert sorted(first.values()) == [1, 2] and run() == first
    add(["2024-01-02", "2024-01-05"])
    assert sorted(run().values()) == [1, 2, 2] and sum(run().values()) == 5
