"""Operators against the plain-Python versions in brute.py."""

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, packing, pii, quality, secrets, simhash, suffix, topk, toxicity, warc

from . import brute

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu", "po") for b in ("ra", "se", "ti", "vo") for c in ("n", "x", "da", "gel", "st")]
BIG = 1 << 60
COLUMNS = "doc_id bigint, text string, source string"


def prose(g, n):
    return " ".join(g.choices(WORDS, k=n))


def corpus(seed=5, n=70):
    """Documents with copies, near copies, identifiers, junk, nulls and repeated rows."""
    g, rows = random.Random(seed), []
    for i in range(n):
        words = prose(g, g.randint(40, 160)).split()
        for k in range(g.randint(0, 2)):
            card = [4, *g.choices(range(10), k=15)]
            words[g.randrange(len(words))] = g.choice([f"{g.choice(WORDS)}@mail.org", f"10.0.{g.randrange(99)}.{k}", "visa " + "".join(map(str, card)), "id 123-45-6789", "+1 (555) 010-1234"])
        rows.append((BIG + 2 * i + 1, " ".join(words), "abc"[i % 3]))
        if i % 7 == 0:
            words[3] = "changed"
            rows.append((BIG + 2 * i + 2, " ".join(words), "abc"[i % 3]))
    rows += [(None, prose(g, 30), "a"), (7, None, "b"), (8, "", "b"), (9, "### " * 40, "a"), (10, prose(g, 900), None)]
    return rows + [rows[4], rows[4], rows[10]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_quality_rules(spark, rows):
    got = sorted(map(tuple, quality.keep_good(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute.good(rows), key=str) and 0 < len(got) < len(rows)


def test_near_dedup(spark, rows):
    got = sorted(map(tuple, simhash.keep_one(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute.one_each(rows), key=str) and len(got) < len(rows) - 8


def test_identifiers(spark, rows):
    texts = [t for _, t, _ in rows]
    texts += [f"visa {c} please" for c in ("4111111111111111", "4012888888881881", "4222222222222220", "4111 1111 1111 1111")]
    texts += [f"mein konto {x} heute" for x in ("4111111111111111", "5500000000000004", "4012888888881881", "30569309025904", "378282246310005", "6011000000000004", "AB-77")] * 2
    texts += ["x10.0.0.12345abc and 10.0.0.1 or 10.0.0.12"]
    df = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    known = brute.identifiers([t or "" for t in texts])
    want = sorted((k, m, known[v][0], v, known[v][1], known[v][2]) for k, t in enumerate(texts) for m, v, *_ in brute.mentions(t) if v in known)
    got = sorted((r["doc_id"], r["mention"], r["pii_type"], r["value"], r["score"], r["seeded"]) for r in pii.extract(df).collect())
    assert got == want and {x[2] for x in got} == {"card", "email", "ip", "phone", "ssn"} and any(not x[5] for x in got)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert [clean[k] for k in range(len(texts))] == [None if t is None else x for t, x in zip(texts, brute.redacted([t or "" for t in texts]))]
    assert clean[len(texts) - 1] == "x10.0.0.12345abc and [IP] or [IP]"


@pytest.mark.parametrize("how", [{}, {"weights": {"a": 1.0, "b": 2.0, None: 0.5}, "budget": 33}, {"budget": 500}])
def test_mixing(spark, rows, how):
    twin = [(5, "same text", "c")] * 40
    many = rows + twin
    times = brute.copies(many, **how)
    got = sorted(map(tuple, mixing.mix(frame(spark, many).repartition(5), **how).collect()), key=str)
    assert got == sorted((r for r, n in zip(many, times) for _ in range(n)), key=str)
    assert len(got) == how.get("budget", len(many)) and sum(r["copies"] for r in mixing.allocate(frame(spark, many), **how).collect()) == len(got)


def test_packing(spark, rows):
    caps, rows = (64, 128, 512, 1024), [*rows, *[(20 + k, "few words", "a") for k in range(9)]]
    how = {"capacities": caps, "cost": lambda c: c + c * c / 150 + 9}
    got = packing.pack(frame(spark, rows), **how)
    key = ("doc_id", "copy", "piece", "n_tokens", "bin", "bin_offset", "capacity")
    want = sorted(brute.packed([r[:2] for r in rows], **how), key=str)
    assert sorted((tuple(r[k] for k in key) for r in got.collect()), key=str) == want
    assert len({w[6] for w in want}) >= 2 and any(w[2] > 0 for w in want)
    # pieces put together are the texts
    texts = {}
    for r in sorted(packing.pack_texts(frame(spark, rows), **how).collect(), key=lambda r: r["piece"]):
        texts[r["doc_id"], r["copy"], r["capacity"] and 0] = texts.get((r["doc_id"], r["copy"], 0), "") + r["text"]
    assert sorted((i or 0, t) for (i, *_), t in texts.items()) == sorted((i or 0, t) for i, t, _ in rows if t)


def test_packed_copies_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    got = packing.pack_texts(frame(spark, [(BIG + 1, "wider é text " * 9, "s")] * 40 + [(None, "b", "s")]), capacities=(8, 16)).collect()
    assert {r["copy"] for r in got if r["doc_id"]} == set(range(40)) and {r["doc_id"] for r in got} == {BIG + 1, None}
    for n in range(40):
        assert "".join(r["text"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] and r["copy"] == n) == "wider é text " * 9


def test_joint_sizes_against_the_best_possible():
    """Every way to lay few pieces into bins; and single sizes on many."""
    g, caps, cost = random.Random(2), (8, 16, 32, 64), lambda c: c + c * c / 100 + 2

    def best(rest):
        if not rest:
            return 0.0
        head, rest = rest[0], rest[1:]
        least = float("inf")
        for n in range(len(rest) + 1):
            for take in itertools.combinations(range(len(rest)), n):
                used = head + sum(rest[k] for k in take)
                if used <= caps[-1]:
                    least = min(least, cost(next(c for c in caps if c >= used)) + best([x for k, x in enumerate(rest) if k not in take]))
        return least

    ratio = []
    for _ in range(60):
        lengths = sorted((g.randint(1, 64) for _ in range(g.randint(1, 7))), reverse=True)
        ratio.append(sum(map(cost, packing.pack_shard(lengths, caps, cost)[2])) / best(lengths))
    assert max(ratio) < 1.3 and sum(ratio) / 60 < 1.02
    mixed = sorted((min(8192, max(1, int(g.lognormvariate(5.5, 1.2)))) for _ in range(20_000)), reverse=True)
    spent = lambda x: sum(map(packing.cost, x[2]))
    joint = packing.pack_shard(mixed)
    single = [spent(packing.best_fit(mixed, opened=c)) for c in packing.CAPACITIES]
    assert spent(joint) <= min(single) and spent(joint) < 0.95 * single[-1] and len(set(joint[2])) >= 4
    flat = sorted(map(int, np.random.default_rng(1).integers(20, 8193, 5000)), reverse=True)
    assert sum(packing.best_fit(flat)[2]) < sum(packing.best_fit(flat, opened=8192)[2])


def test_pipeline(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute.one_each(brute.good(rows))
    kept = [(i, x if t else t, s) for (i, t, s), x in zip(kept, brute.redacted([t or "" for _, t, _ in kept]))]
    mixed = [r for r, n in zip(kept, brute.copies(kept)) for _ in range(n)]
    key = ("doc_id", "copy", "piece", "n_tokens", "bin", "bin_offset", "capacity")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[k] for k in key) for r in got), key=str) == sorted(brute.packed([r[:2] for r in mixed]), key=str)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t) for i, t, _ in mixed if t)
    docs.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("hot", "seed"), [(2, 1), (10**6, 1), (2, 2), (10**6, 3)])
def test_repeated_passages(spark, hot, seed):
    g = random.Random(seed)
    blocks = [[g.choice("abcdefgh") for _ in range(g.randint(5, 30))] for _ in range(12)]
    rows = [(g.randrange(25), " ".join(w for _ in range(g.randint(0, 4)) for w in (g.choice(blocks) if g.random() < 0.7 else g.choices("abcdefgh", k=9))), "s") for _ in range(60)]
    rows += [(None, " ".join(blocks[0]), "s"), (90, None, "s"), rows[3]]
    df, how = frame(spark, rows), {"length": 8, "k": 4, "hot": hot}
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["drop"]) for r in suffix.repeated_passages(df, **how).collect()}
    assert got == brute.passages([r[:2] for r in rows], 8) and len(got) > 20
    left = [(r["doc_id"], r["text"]) for r in suffix.drop_repeats(df, **how).collect()]
    runs = lambda t, i: [x[1:3] for x in brute.passages([r[:2] for r in rows if r[0] != i] + [(i, t)], 8) if x[0] == i and x[3]] if i is not None and t else []
    want = [(i, t and suffix.cut(t, [x[1:3] for x in got if x[0] == i and x[3] and x[1:3] in runs(t, i)])) for i, t, _ in rows]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_search_blocks_and_pruning(spark):
    g = np.random.default_rng(4)
    m = np.round(g.normal(size=(400, 6)) * np.exp(2 * g.normal(size=(400, 1))), 3)
    df = spark.createDataFrame([(BIG + i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_k(df, 3, queries=F.col("id") % 4 == 0, bucket_rows=50, query_rows=30).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"]))
    assert set(got) == {BIG + i for i in range(400) if (BIG + i) % 4 == 0}
    for i in (i for i in range(400) if (BIG + i) % 4 == 0):
        best = sorted(((-round(float(m[i] @ m[j]), 6) + 0.0, j) for j in range(400) if j != i))[:3]
        assert [x - BIG for _, x in sorted(got[BIG + i])] == [j for _, j in best]
    # short buckets are sent to few blocks, and both ways of pruning find the same
    norm = np.linalg.norm(m, axis=1)
    order = np.argsort(-norm)
    theta = np.array([np.sort(np.delete(m @ m[i], i))[-3] for i in range(100)])
    assert (norm[order[350]] < theta / norm[:100]).mean() > 0.5
    p = (order[:200], m[order[:200]], norm[order[:200]])
    q = (np.arange(100), m[:100], norm[:100])
    flat = lambda limit: sorted((int(r), int(j)) for r, i, _ in topk.search_cell(q, p, theta, 3, limit) for j in i)
    assert flat(0.0) == flat(2.0) != []


def naive_score(net, words):
    """One window, one word and one character at a time."""
    sigmoid, p = lambda x: 1 / (1 + np.exp(-x)), {k: v.astype(np.float64) for k, v in net.p.items()}

    def run(xs, x, u, b):
        n = u.shape[0]
        h, out = np.zeros(n), []
        for v in xs:
            g, a = v @ x + b, h @ u
            z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
            c = np.tanh(g[2 * n :] + r * a[2 * n :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    both = lambda xs, k: [np.concatenate(x) for x in zip(run(xs, p[f"{k}fx"], p[f"{k}fu"], p[f"{k}fb"]), run(xs[::-1], p[f"{k}bx"], p[f"{k}bu"], p[f"{k}bb"])[::-1])]
    inputs = []
    for w in words:
        chars = [p["chars"][1 + ord(c) % (toxicity.CHARS - 1)] for c in w]
        ends = both(chars, "c")
        n = toxicity.CHAR_HIDDEN
        inputs.append(np.concatenate([p["words"][net.ids.get(w, 0)], ends[-1][:n], ends[0][n:]]))
    states = both(inputs, "w")
    weight = np.exp([np.tanh(s @ p["aw"] + p["ab"]) @ p["av"] for s in states])
    return float(sigmoid(sum(a * s for a, s in zip(weight / weight.sum(), states)) @ p["ow"] + p["ob"][0]))


def test_scorer_against_a_naive_one():
    g = random.Random(9)
    net = toxicity.Network(WORDS[:20])
    texts = [prose(g, n) for n in (1, 5, 47, 48, 49, 60, 130)] + ["", None, "ÄÖ é"]
    count, score = toxicity.Scorer(net)(texts)
    for t, n, s in zip(texts, count, score):
        words = (t or "").lower().split()
        starts = sorted({*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}) if words else []
        assert n == len(starts)
        assert s == pytest.approx(max((naive_score(net, words[a : a + toxicity.WINDOW]) for a in starts), default=0.0), abs=1e-4)


def test_warc_gzip_members_and_reports(spark, tmp_path):
    record = lambda i, body: f"WARC/1.0\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [b"", b"plain", record(9, b"inside"), bytes(range(256)) * 40, gzip.compress(record(8, b"packed inside")), b"z" * 5000]
    with (tmp_path / "a.warc.gz").open("wb") as f:
        for i, b in enumerate(bodies):
            f.write(gzip.compress(record(i, b), compresslevel=0 if i == 2 else 6))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies))))
    (tmp_path / "plain.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    (tmp_path / "broken.warc").write_bytes(record(0, b"ok") + b"garbage" + record(1, b"lost"))
    (tmp_path / "long.warc").write_bytes(b"WARC/1.0\r\nX: " + b"x" * 3000 + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    (tmp_path / "empty.warc").write_bytes(b"")
    for size in (97, 1 << 20):
        got, files = warc.read(spark, str(tmp_path), range_bytes=size, max_header=1000)
        by = {}
        for r in got.collect():
            by.setdefault(r["file"].rsplit("/", 1)[1], {})[r["record"]] = bytes(r["payload"])
        want = {f"<urn:{i}>": b for i, b in enumerate(bodies)}
        assert by == {"a.warc.gz": want, "one.warc.gz": want, "plain.warc": want, "broken.warc": {"<urn:0>": b"ok"}}
        told = {r["file"].rsplit("/", 1)[1]: (r["records"], r["complete"]) for r in files.collect()}
        assert told == {"a.warc.gz": (6, True), "one.warc.gz": (6, True), "plain.warc": (6, True), "broken.warc": (1, False), "long.warc": (0, False)}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ledger_over_a_history(spark, limit):
    """Versions of a path, copies, a raised rule; with broadcasts and without."""
    key, token = "AKIA" + "B" * 16, "token=" + "q" * 18
    old = [("p", 1, f"{key} one"), ("p", 2, "clean"), ("q", 1, f"{key} one"), (None, None, token), ("e", 1, ""), ("n", 1, None), ("p", 1, f"{key} one")]
    new = [*old, ("p", 3, f"{token} {key}"), ("r", 1, "clean")]
    schema = "path string, version int, content string, `content.x` int, blob int"
    make = lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    _, findings, ledger = secrets.scan(make(old), rules=secrets.FIRST_RULES, limit=limit)
    assert ledger.count() == 4 and {r["rule_id"] for r in findings.collect()} == {"aws_access_key"}
    hits, findings, ledger = secrets.scan(make(new), ledger, findings, limit=limit)
    alone, _, _ = secrets.scan(make(new), limit=limit)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(hits) == rows(alone) and sorted((r["path"] or "", r["rule_id"]) for r in hits.collect()) == [("", "assigned_token"), *[("p", "assigned_token")], *[("p", "aws_access_key")] * 3, ("q", "aws_access_key")]
    assert {len(r["scanned"]) for r in ledger.collect()} == {len(secrets.RULES), len({*map(secrets._name, [*secrets.RULES, *secrets.FIRST_RULES])})}
    # what the ledger lists isn't scanned again
    assert secrets.scan(make(new), ledger, findings.limit(0), limit=limit)[0].count() == 0
    assert [x.count() for x in secrets.scan(make([]), limit=limit)] == [0, 0, 0]


def test_dense_buckets_and_slices(spark, monkeypatch):
    """Buckets cut into slices, and buckets full of near fingerprints, connect what is near."""
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "WHOLE", 8)
    g, base, rows = random.Random(3), None, []
    for i in range(90):
        base = prose(g, 150).split() if i % 30 == 0 else base
        words = list(base)
        for k in g.sample(range(150), 4):
            words[k] = f"new{i}x{k}"
        rows.append((i, " ".join(words), "s"))
    make = simhash.Fingerprinter()
    of = brute.groups([make.lanes(t) for _, t, _ in rows])
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(frame(spark, rows)).collect()}
    assert got == {i: r for i, r in enumerate(of) if of.count(r) > 1} and len(got) > 60
