"""Operators that SQL can't express, and odd inputs, against brute force in plain Python."""

import base64
import hashlib
import itertools
import random
import re
import unicodedata

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, embeddings, licenses, minhash, pii, quality, token_counts

TIK, PAT, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")


def fuzzed(seed, n, alphabet, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


WILD = [*"aAbz 09", " ", "  ", "\n", "\t", "\r\n", "é", "😀", " ", "　", "'s", "'LL", "ß", "the", " of", "123", "<|endoftext|>", "日本", "́", "_", "--", "\x00"]


def library(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PAT, mergeable_ranks=ranks, special_tokens={})


def test_tokenizers_on_fuzzed_text(spark):
    from tokenizers import Tokenizer

    texts = fuzzed(1, 3000, WILD)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc, tok = library(TIK), Tokenizer.from_file(JSON)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, TIK, PAT).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), repr(t)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, JSON, PAT).collect()}
    assert counts == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    """The contract's patterns with Python's own engine."""
    found = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for rank, (kind, pattern, ok) in enumerate(rules):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(found)


def test_base_spans_of_fuzzed_text(spark):
    parts = [*"0123456789", *"0123456789", ".", ".", "-", " ", "+", "@", "(", ")", "a", "Z", "%", "_", "é", "😀", "\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "a.b@c.de", "256"]
    texts = fuzzed(2, 4000, parts, 40) + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert not spans or set(joined.split(",")) <= set(got[i]["spans"].split(","))


def redacted(text, spans):
    """Spans (kind, start, end) by kind in brackets; those that overlap by the first."""
    out, at = "", 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redacted_text_follows_the_spans(spark):
    rng = random.Random(4)
    pieces = ["word", "😀é", "anna@mail.example", "+1 (555) 010-9999", "10.0.0.1", "4111 1111 1111 1111", "phone (301) 555-0142", "bob [at] host [dot] example", 'key="90abcdef0123456789abcdef0123"', "x" * 4095, "123-45-6789"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts.append(" ".join(f"+1 (555) {k % 900 + 100}-9{k % 1000:03d} m{k}@mail.example" for k in range(6000)))  # a long contact list
    df = spark.createDataFrame([(i, t, len(t), i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, proposed int")
    spans = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.report(df).collect()}
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    ranks = ["email", "ip", "card", "phone", "number", "secret", "contact"]
    for i, t in enumerate(texts):
        assert out[i]["text"] == redacted(t, spans[i]) and out[i]["n_chars"] == len(out[i]["text"]) and out[i]["proposed"] == i
        assert spans[i] == sorted(spans[i], key=lambda s: (s[1], ranks.index(s[0]), s[2]))
    assert out[300]["text"].count("[EMAIL]") == 6000 == out[300]["text"].count("[PHONE]")


def test_candidates_that_overlap_base_spans(spark):
    """``flagged`` against every pair."""
    rng = random.Random(9)
    span = lambda: (lambda a: (a, a + rng.randint(1, 9)))(rng.randint(0, 60))
    rows = [(i, sorted((a, 0, b) for a, b in (span() for _ in range(rng.randint(0, 8)))), [(a, "number", b, "c", False) for a, b in (span() for _ in range(rng.randint(0, 90)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, base array<struct<start:bigint,kind:int,end:bigint>>, p array<struct<start:bigint,kind:string,end:bigint,cell:string,open:boolean>>")
    for r in df.select("base", "p", pii.flagged(F.col("base"), F.col("p")).alias("f")).collect():
        want = sorted((s.start, s.end, any(b.start < s.end and s.start < b.end for b in r["base"])) for s in r["p"])
        assert sorted((s.start, s.end, s.hit) for s in r["f"]) == want


def test_scores_choose_what_is_added(spark, monkeypatch):
    """Labelled spans of every kind: the trees find those without a base format, leave the rest, and nothing is added without them."""
    rng = random.Random(11)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "7e"
    cap = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    personal = [
        ("number", lambda: f"({d(3)}) {d(3)}-{d(4)}", "they met "), ("number", lambda: f"{d(3)}-{d(2)}-{d(4)}", "SSN: "), ("number", lambda: d(10), "my phone "), ("secret", lambda: h(40), 'token = "'),
        ("secret", lambda: h(18), "a password="), ("secret", lambda: "AKIA" + cap(16), "then "), ("contact", lambda: f"bob.b{d(1)} [at] host [dot] example", "write "),
    ]
    plain = [lambda: f"they met {d(10)} there", lambda: f"commit {h(40)} there", lambda: "he saw us [at] noon. Then", lambda: f"in {d(4)}-{d(2)}-{d(2)} 10 there", lambda: f"see chapter-{d(2)}-of-the-long-story there"]
    texts, want = [], []
    for _ in range(25):
        for kind, span, before in personal:
            s = span()
            texts.append(f"{before}{s} there")
            want.append(f"{kind}:{len(before)}:{len(before) + len(s)}")
        for one in plain:
            texts.append(one())
            want.append("")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = lambda: {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    got = spans()
    hits, false = sum(got[i] == w for i, w in enumerate(want) if w), sum(got[i] != "" for i, w in enumerate(want) if not w)
    assert hits >= 0.95 * sum(map(bool, want)) and false == 0, (hits, false, [(texts[i], got[i], w) for i, w in enumerate(want) if got[i] != w][:9])
    monkeypatch.setattr(pii, "accepted_cells", lambda *a: [])
    assert set(spans().values()) == {""}


def test_labels_of_one_class(spark):
    """Plain and spelled-out addresses alone: the examples made by rule give the other class; without any, nothing is added."""
    texts = [f"mail anna.{k}@mail.example now" for k in range(50)] + [f"write bob.{k} [at] host [dot] example" for k in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all(got[k] == "mail [EMAIL] now" for k in range(50)) and all(got[k] == "write [CONTACT]" for k in range(50, 100))
    bare = {r["doc_id"]: r["text"] for r in pii.redact(df, labelled=pii.examples(spark).where("false")).collect()}
    assert all(bare[k] == "mail [EMAIL] now" for k in range(50)) and all(bare[k] == texts[k] for k in range(50, 100))


# --- quality


def test_discriminant_is_the_formula(spark):
    """Scores against a quadratic discriminant in plain numpy, calibration included."""
    rng = random.Random(6)
    good = ["plain", "words", "of", "a", "text", "that", "reads", "well", "and", "goes", "on"]
    bad = ["$$$", "###", "BUY", "now!!", "{x}", "a|b", "NOW!!", "99"]
    texts = [" ".join(rng.choice(good if rng.random() < (0.95 if i % 2 else 0.3) else bad) for _ in range(rng.randint(20, 120))) for i in range(400)]
    labels = [(i, i % 2 if rng.random() < 0.9 else 1 - i % 2) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}
    x, y = np.array([quality.statistics(t) for t in texts]), np.array([v for _, v in labels])
    fit = np.array([not held[i] for i in range(400)])
    pooled = x[fit].var(axis=0)
    diff = np.zeros(400)
    for k in (0, 1):
        own = x[fit & (y == k)]
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.02 * np.diag(np.maximum(pooled, 1e-6))
        c = x - own.mean(axis=0)
        density = -0.5 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own) / fit.sum())
        diff += density if k else -density
    diff = np.arcsinh(diff)
    scores = np.array([got[i]["score"] for i in range(400)])
    assert all(got[i]["held_out"] == held[i] and got[i]["predicted"] == int(scores[i] >= 0.3) for i in range(400))
    inside = (scores > 1e-9) & (scores < 1 - 1e-9)  # the calibration is a line in log-odds
    assert inside.sum() > 30
    slope, offset = np.polyfit(diff[inside], np.log(scores[inside] / (1 - scores[inside])), 1)
    assert slope > 0 and np.abs(np.log(scores[inside] / (1 - scores[inside])) - slope * diff[inside] - offset).max() < 1e-4
    out = [got[i]["predicted"] == y[i] for i in range(400) if held[i]]
    assert sum(out) / len(out) > 0.8


# --- chat


def conversation(rng, c):
    rows = [(c, 0, "system", "You help.")] if c % 3 == 0 else []
    for t in range(1, rng.randint(2, 9)):
        ask = t % 2 == 1
        lines = [f"{'what' if ask else 'it'} is {rng.randint(0, 999)} {'then?' if ask else 'and goes on for a good while here'}"] + ["  - an item of a list"] * (0 if ask else rng.randint(0, 3))
        if not ask and rng.random() < 0.2:
            lines.append("Answer: as before")
        rows.append((c, t, "user" if ask else "assistant", "\n".join(lines)))
    return rows


def test_chat_turns_are_recovered(spark):
    rng = random.Random(8)
    rows = [r for c in range(300) for r in conversation(rng, c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"line": F.lit(1), "state": F.lit("x")})
    got = {(r["conv_id"], r["role"], r["text"]) for r in chat.format_chats(df).collect()}
    held = {c for c, h in spark.range(300).select("id", (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(5)) == 0)).collect() if h}
    want = [(c, role, text) for c, _, role, text in rows if c in held]
    assert len(want) > 150 and sum(w in got for w in want) / len(want) > 0.9
    # No word of a text is lost: the words of a conversation are those of its turns.
    words = lambda items: {c: sorted(" ".join(t for d, t in items if d == c).split()) for c in range(300)}
    markers = {"###", "[system]:", "[user]:", "[bot]:", "System:", "User:", "Assistant:", "Human:", "Instruction:"}
    mine, theirs = words([(c, x) for c, _, x in got]), words([(c, t) for c, _, _, t in rows])
    lost = sum(len([w for w in set(theirs[c]) if w not in mine[c] and w != "Answer:"]) for c in range(300))
    assert lost == 0 and sum(any(w not in theirs[c] and w not in markers for w in mine[c]) for c in range(300)) == 0


def test_chat_odd_rows(spark):
    rng = random.Random(3)
    base = [r for c in range(100, 200) for r in conversation(rng, c)]
    long = "\n".join(f"line {k} of a very long answer" for k in range(3000))
    odd = [
        (1, 1, "user", "what is q1?\nand more of it"), (1, 1, "user", "what is q1?\nand more of it"), (1, 2, "assistant", "one"), (1, 3, "tool", "x = 1"), (1, 4, "Moderator", "stop it"), (1, 5, "assistant", "fine"),
        (None, 0, "user", "hi there?"), (None, 0, "user", "hi there?"), (None, 5, None, None), (2, None, "user", None), (3, 1, "user", "say it?"), (3, 2, "assistant", long),
    ]
    df = spark.createDataFrame(base + odd, "conv_id long, turn long, role string, text string")
    rows = [r for r in chat.format_chats(df).collect() if r["conv_id"] is None or r["conv_id"] < 100]
    by = lambda c: [(r["role"], r["text"]) for r in sorted(rows, key=lambda r: r["turn"]) if r["conv_id"] == c]
    assert sorted(by(None)) == [("other", ""), ("user", "hi there?"), ("user", "hi there?")]
    assert " ".join(t for _, t in by(1)).replace("\n", " ").count("what is q1? and more of it") == 2 and [r for r, _ in by(1)][-3:] == ["tool", "moderator", "assistant"]
    assert len(by(2)) == 1 and long in [t for _, t in by(3)][-1]
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>" and r["n_lines"] == r["text"].count("\n") + 1 for r in rows)


def test_markers_keep_the_text_behind_them():
    strip = lambda line: re.sub(chat.MARKER, "", line)
    assert [strip(x) for x in ("User: > quote", "### Human:   indented", "<|assistant|> * item", "[bot]: - x", "**User:** bold", "Question and more")] == ["> quote", "  indented", "* item", "- x", "bold", "Question and more"]


def test_parts_combine_to_the_whole_path():
    rng = np.random.default_rng(1)
    model = chat.Model({("first", 0, 2): 5.0, ("move", 2, 4): 3.0, ("marker", 2, 2): 9.0})
    for n in (1, 2, 5, 9):
        codes = rng.integers(0, 512, n)
        whole = model.between(codes, np.array([n]))
        a, z = model.chain(whole)
        want = model.decode(codes, np.array([n]), np.array(a), np.array(z))
        score = lambda s: model.first[s[0]] + model.emitted[codes[0], s[0]] + sum(model.moves[p, q] + model.emitted[codes[k + 1], q] for k, (p, q) in enumerate(zip(s, s[1:])))
        if n <= 5:
            assert score(want) == max(score(s) for s in itertools.product(range(chat.STATES), repeat=n) if s[0] % 2 == 0)
        sizes = np.array([1, n - 1]) if n > 1 else np.array([1])
        parts = model.between(codes, sizes)
        assert (model.combined(parts) == whole[0]).all()
        a, z = model.chain(parts)
        assert score(model.decode(codes, sizes, np.array(a), np.array(z))) == score(want)
        inner = model.chain(parts, a[0], z[-1])
        assert score(model.decode(codes, sizes, np.array(inner[0]), np.array(inner[1]))) == score(want)


# --- licenses, vectors


def test_license_blocks(spark):
    filler = " ".join(f"filler{k}" for k in range(90))
    gpl = "it under the terms\nof the GNU General Public\nLicense as published by\n   the Free Software Foundation"
    cases = [
        (filler + "\n" + gpl + "\n" + filler, "gpl"), ("licensed under the GNU Lesser\nGeneral Public License", "lgpl"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY 4.0", "cc-by"),
        ("All rights\nreserved.", "reserved"), ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), (filler, ""), ("license software public", ""), (None, ""),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl"), ("it is licensed under the GNU Affero General Public License", "agpl"),
        ("the general public may use software from the foundation; gnu animals, a license to hunt was published under terms", ""),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"), (filler + " " + gpl + " and licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ]
    texts = [t for t, _ in cases]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(cases))] == [labels for _, labels in cases]
    sets = [(label, set(tokens), need, must) for _, label, tokens, need, must in licenses.template_sets(licenses.TEMPLATES, 0.8)]
    span = licenses.span_of(licenses.TEMPLATES)
    for i, t in enumerate(texts):
        words = licenses.words_of(t or "")
        blocks = [set(words[k : k + span]) for k in range(0, max(1, len(words)), span // 2)]
        want = {label for label, tokens, need, must in sets for b in blocks if len(b & tokens) >= need and f" {must} " in f" {' '.join(words)} "} | set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == want


def test_long_license_templates_are_found_anywhere(spark):
    """The window follows the longest template, wherever the notice begins."""
    words = [f"clause{k}" for k in range(40)]
    templates = [("own", " ".join(words), "clause3 clause4"), ("short", "some short notice of terms", "short notice")]
    texts = [" ".join([*[f"x{k}" for k in range(at)], *words, *[f"y{k}" for k in range(70)]]) for at in range(0, 90, 7)] + ["a some short notice of terms", " ".join(words[:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs, templates=templates, containment=1.0).collect()}
    assert [got[i] for i in range(len(texts))] == ["own"] * (len(texts) - 2) + ["short", ""]


def test_vectors_of_every_size(spark):
    v = [0.1 * k + 0.05 for k in range(16)]
    rows = [(i, 0, [x * f for x in v]) for i, f in enumerate((1.0, 1e-200, 1.0001, 3e-200, 1e200, 1e-306))] + [(1, 0, v), (9, 0, [-x for x in v]), (None, 0, v)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert all((r["n_links"], r["component_id"]) == (6, 0) for r in out if r["vec_id"] is not None and r["vec_id"] < 9) and len(out) == len(rows)
    assert [(r["n_links"], r["kept"]) for r in out if r["vec_id"] == 9] == [(0, True)]


# --- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(80)
    texts = [text(rng.randint(10, 150)) for _ in range(60)] + [base, base, base + " end", base + " here at the end"] + ["$$$ ### !!! BUY {NOW} " * 20 + text(3) for _ in range(30)]
    texts += [f"call +1 (555) 010-9{k:03d} or write m{k}@mail.example about {text(20)}" for k in range(10)] + ["", None]
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path)
    docs.write.parquet(f"{where}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not (t or "").startswith("$"))) for i, t in enumerate(texts) if t], "doc_id long, quality int")
    labels.write.parquet(f"{where}/labels.parquet")
    out = corpus_pipeline.run(spark, where).collect()

    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    kept = {i: t for i, t, *_ in rows if score[i] >= 0.3}
    assert all(i in kept for i in range(60)) and not any(i in kept for i in range(64, 94))
    words = lambda t: (t or "").lower().split()
    shingles = {i: ({tuple(words(t))} if 0 < len(words(t)) < 5 else {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}) for i, t in kept.items()}
    root = {i: i for i in kept}
    for _ in kept:
        for a, b in itertools.combinations(sorted(kept), 2):
            if shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
                root[a] = root[b] = min(root[a], root[b])
    kept = {i: t for i, t in kept.items() if root[i] == i}
    one = spark.createDataFrame([(i, t) for i, t in kept.items()], "doc_id long, text string")
    spans = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.report(one).collect()}
    kept = {i: None if t is None else redacted(t, spans[i]) for i, t in kept.items()}
    # Targets: weights 1, 2, 3, at most three times a source's size; then hash order, whole epochs and a cut.
    size = {i: len(words(t)) for i, t in kept.items()}
    own = {s: sum(n for i, n in size.items() if "abc"[i % 3] == s) for s in "abc"}
    target, left, free = {}, float(sum(own.values())), {"a": 1, "b": 2, "c": 3}
    while True:
        over = [s for s in free if left * free[s] / sum(free.values()) >= 3 * own[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        level = left / sum(free.values())
        s = min(over, key=lambda s: 3 * own[s] / free[s])
        assert level * free[s] >= 3 * own[s]
        target[s] = 3.0 * own[s]
        left -= target[s]
        del free[s]
    expected = []
    for s in "abc":
        budget = int(np.floor(target[s] + 0.5))
        epochs, rest = divmod(budget, own[s])
        for i in sorted((i for i in kept if "abc"[i % 3] == s), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest()[:12], i)):
            cut = min(rest, size[i])
            rest -= cut
            if size[i]:
                expected += [(i, kept[i])] * (epochs + (cut == size[i] and cut > 0))
                if 0 < cut < size[i]:
                    expected.append((i, " ".join(words_as_they_are(kept[i])[:cut])))
    enc = library(TIK)
    want = sorted((i, enc.encode_ordinary(t)) for i, t in expected)
    assert sorted((r["doc_id"], list(r["ids"])) for r in out) == want and all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in out)


def words_as_they_are(t):
    return t.split(" ")


def test_hubs_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_LINKS", 7)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([*base[: 50 + i % 3], f"x{i}", *base[50 + i % 3 :]])) for i in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 120


def test_repeated_ids_keep_distinct_texts(spark):
    rows = [(1, "one two three four five six", 1), (1, "one two three four five six", 1), (1, "quite another text of its own kind", 2), (2, "a third text that stands alone here", 3)]
    out = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted((r["doc_id"], r["n"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 3)]


def test_control_characters_and_accents(spark):
    """Texts that differ in form only stay apart, and nothing breaks on control characters."""
    texts = [unicodedata.normalize("NFC", "é" * 30), unicodedata.normalize("NFD", "é" * 30), "\x00\x01 \x7f", "  \u0085"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0, 1, 2, 3}
    assert pii.report(df).where("spans <> ''").count() == 0 and licenses.license_scan(df).where("labels <> ''").count() == 0
