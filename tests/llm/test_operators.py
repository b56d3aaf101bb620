"""Training-data operators on small tables: odd rows, brute force, library results."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, embeddings, licenses, minhash, mixing, pii, quality, spotsigs, token_counts

TIK, PAT, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of green and gold for the old king of the hill"
TEXTS = [
    (0, BASE, "a"), (1, BASE, "a"), (2, BASE + " today", None), (3, None, "b"), (4, "", "b"), (5, "one two", "a"), (6, "one two", None), (7, LONG, "a"), (7, LONG, "a"), (8, "x" * 30_000, "b"),
    (9, "Licensed under the Apache License, Version 2.0.\nmit license mit license", "a"), (10, "write to a.b@c.example or +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.300 10.0.0.1", "b"),
    (11, 'token = "abcdef0123456789abcdef0123456789abcdef01" é😀 <|endoftext|>  \n\n end', "b"), (None, "no id here", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), 1) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words5(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def closure(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_bpe_is_the_library(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIK, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PAT, mergeable_ranks=ranks, special_tokens={})
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, TIK, PAT).collect()}
    want = set()
    for i, t, _ in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want and bpe.round_trip(empty, TIK, PAT).count() == 0


def test_token_counts_are_the_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, JSON, PAT).collect())
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in TEXTS]
    assert got == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(TEXTS, counts))
    assert token_counts.count_tokens(empty, JSON, PAT).count() == 0


def test_minhash_components(spark, docs, empty):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    sets = {i: words5(t) for i, t, _ in TEXTS if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closure(sets, links)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(docs).count() == len(TEXTS) and minhash.near_duplicates(empty).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(i for i in sets if root[i] == i)


def test_minhash_edited_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(160)]
    for i in range(150):
        w = list(base) if i % 3 else [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    sets = {i: words5(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == closure(sets, links)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 16))
    rows = [(i, int(i % 2), (centre[i % 4] + 0.25 * rng.normal(size=16)).tolist()) for i in range(120)]
    rows += [(200, 0, None), (201, 0, [0.0] * 16), (202, 0, [float("nan")] * 16), (203, None, rows[0][2]), (204, 0, rows[0][2]), (205, 0, [None] * 16), (206, 0, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("raw", F.lit(1))
    good = {i: np.array(v) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, l, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.93]
    root = closure(label, links)
    for tile in (1024, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df, tile=tile).collect()}
        assert got == {i: (sum(i in p for p in links), root[i], root[i] == i) for i in label}
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert (got[9]["n_base"], got[9]["first_word"], got[9]["last_word"], got[9]["base_labels"]) == (3, 3, 10, "apache,mit") and got[9]["score"] == 1.0
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == "" and got[3]["score"] == 0
    assert licenses.license_scan(docs).count() == len(TEXTS) and licenses.license_scan(empty).count() == 0


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert (got[10]["n_email"], got[10]["n_ip"], got[10]["n_card"], got[10]["n_phone"]) == (1, 1, 1, 1)
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["spans"] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "a.b@c.example" not in text[10] and "4111" not in text[10] and "[EMAIL]" in text[10] and text[0] == BASE and text[3] is None
    assert pii.report(empty).count() == 0 and pii.redact(docs).columns == docs.columns


def test_spotsigs(docs, empty):
    rows = spotsigs.fingerprint_report(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) and got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    tail = len(BASE) // 4
    assert got[0]["edited_sha256"] == hashlib.sha256((BASE[: len(BASE) - tail] + BASE[:tail]).encode()).hexdigest()
    assert got[4]["fingerprint"] == "" and got[3]["near_next"] == 1.0 and spotsigs.fingerprint_report(empty).count() == 0
    one = spotsigs.fingerprint_report(docs.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0


def test_pii_beyond_the_base(spark):
    rng = random.Random(5)
    ten = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"fine words +1 {ten()} and anna.{k}@mail.example here" for k in range(60)] + [f"the part {k % 9 + 1}11111111111111{k % 10} is in stock" for k in range(60) if not luhn(f"{k % 9 + 1}11111111111111{k % 10}")]
    texts += [f'token = "{k:02d}abcdef0123456789abcdef0123456789"' for k in range(20)]
    n = len(texts)
    texts += ["write bob.b [at] host [dot] example soon", "we met at (301) 555-0142 today", "SSN: 123-45-6789", "ship 4111-2222-333 4", "the part 4111111111111112 is in stock", "value = \"90abcdef0123456789abcdef0123456789\" there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[n] == "write [CONTACT] soon" and text[n + 1] == "we met at [NUMBER] today" and text[n + 2] == "SSN: [NUMBER]"
    assert text[n + 4] == texts[n + 4] and text[n + 5] == "value = \"[SECRET]\" there" and all(text[k] == texts[k] for k in range(n) if texts[k].startswith("the part"))
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert spans[n] == f"contact:6:{texts[n].index(' soon')}" and spans[n + 1] == f"number:10:{texts[n + 1].index(' today')}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_threshold_is_calibrated():
    assert pii.lowest_score([(0.9, 100, 99), (0.5, 10, 5), (0.1, 3, 0)], 0.9) == 0.9  # the good cells don't carry the bad ones
    assert pii.lowest_score([(0.9, 10, 8), (0.8, 10, 10), (0.7, 0, 0), (0.1, 3, 0)], 0.9) == 0.8 and pii.lowest_score([(0.9, 2, 0)], 0.9) == float("inf")


def chains_of(text):
    """Fingerprint in plain Python: every common word that some text holds starts a chain."""
    common = "and at for with he it on to by as from dans sur pour mit im auf zu para del como the of a is las".split()
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.lower())
    found = {(a, *[x for x in w[i + 1 : i + 9] if x not in common][:2]) for i, a in enumerate(w) if a in common}
    return "".join(sorted({hashlib.md5(" ".join(c).encode()).hexdigest()[:8] for c in found if len(c) == 3} or {hashlib.md5(" ".join(w).encode()).hexdigest()[:8]}))


def test_spotsigs_every_common_word_is_an_anchor(spark):
    texts = [
        "send letters to Berlin today for Anna with love", "he sat on chairs near it quietly by lamps tonight", "wir gehen mit Hunden spazieren im Wald heute auf Bergen oben",
        "marcher dans Paris toujours sur ponts vieux pour Marie demain", "comprar pan para Juan hoy del horno como siempre antes", "plain words alone",
    ]
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: chains_of(t) for i, t in enumerate(texts)}
    assert all(got[i]["near_edited"] > 0 for i in range(5))  # each keeps three quarters of its text


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    words = mixing.realise(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(taken.values()) and mixing.mix(empty).count() == 0 and mixing.realise(empty).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + ("!!" if i % 2 else "") for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(df, labels).collect()
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in out if r["held_out"])
    assert quality.classify(docs, labels.where("false")).count() == len(TEXTS) and quality.classify(empty, labels).count() == 0
    assert quality.filter_good(df, labels).count() == 100


def test_chat(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("what is it?" if t % 2 == 0 else "it is a long answer\nwith two lines of text")) for c in range(30) for t in range(6)]
    df = spark.createDataFrame(rows + [(None, 0, "user", "hi"), (99, None, "user", None)], "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1))
    out = chat.format_chats(df)
    truth = {(c, t): r for c, t, r, _ in rows}
    got = {(r["conv_id"], r["turn"]): r["role"] for r in out.collect()}
    assert sum(truth[k] == got.get(k) for k in truth) / len(truth) > 0.9
    assert chat.format_chats(df.where("false")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    where = str(tmp_path)
    docs.drop("score").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    got = docs.drop("score")
    for name, stage in corpus_pipeline.STAGES:
        before, got = got, stage(spark, got, where)
        if name != "bpe":
            assert got.columns == docs.drop("score").columns
        if name in ("quality", "pii"):
            assert got.count() == before.count()
    out = corpus_pipeline.run(spark, where)
    assert out.count() > 0 and out.where("NOT intact").count() == 0


def test_mix_keeps_columns_with_clashing_names(spark):
    """Whatever the columns of a corpus are called, the mix gives them back."""
    from siltstone.llm import mixing

    rows = [(i, f"w{i} x y z", "ab"[i % 2], i, f"h{i}", i * 2, f"n{i}", "r") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, text_hash string, taken long, __n string, __row string")
    out = mixing.realise(docs).collect()
    assert out and set(out[0].asDict()) == set(docs.columns)
    for r in out:
        assert (r["size"], r["text_hash"], r["taken"], r["__n"], r["__row"]) == (r["doc_id"], f"h{r['doc_id']}", r["doc_id"] * 2, f"n{r['doc_id']}", "r")
    assert {r["doc_id"] for r in out if r["text"].startswith(f"w{r['doc_id']}")} == {r["doc_id"] for r in out}


def test_links_of_repeated_ids_and_large_hubs(spark):
    """Copies of one text with small edits, more of them than one hub's share, and an id with two texts."""
    from siltstone.llm import minhash

    base = [f"t{k}" for k in range(60)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base, f"e{i}"])) for i in range(1, minhash.HUB_LINKS * 2 + 9)]
    rows += [(9000, "some quite different words that stand alone here"), (9000, " ".join([*base, "more", "words"]))]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == minhash.HUB_LINKS * 2 + 9 + 2


def test_mix_of_repeated_rows(spark):
    """Rows that are equal in id and text are matched one by one: the words that the mix takes all come."""
    from siltstone.llm import mixing

    rows = [(i % 7 if i % 3 else None, f"a b c d {i % 2}", "ab"[i % 2]) for i in range(90)] + [(100 + i, "one two three four five six", "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r["source"]: r["n"] for r in mixing.realise(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert got == want and sum(want.values()) > 0
