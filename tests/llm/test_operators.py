import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, packing, pii, quality, secrets, simhash, suffix, topk, toxicity, warc
from quarry.llm.common import components

rng = random.Random(3)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, value string, bucket double"


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", None) for i, t, s in rows], SCHEMA)


LONG = prose(20_000, 1)
SHARED = prose(60, 2)
NASTY = [(1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, "", "a"), (4, None, None), (None, prose(50, 5), "b"), (5, " ", "b"),
         (6, prose(80, 6) + " " + SHARED + " " + prose(9, 7), "b"), (7, SHARED + " " + prose(70, 8), None), (8, "mail ann@site.org or +1 (555) 010-1234 now", "c"), (9, "token=abcdefghijklmnop1234", "c")]
OPS = {
    "quality": quality.assess, "secrets": secrets.scan_documents, "pii": pii.extract, "suffix": suffix.repeated_passages,
    "simhash": simhash.groups, "packing": packing.pack, "mixing": mixing.allocate, "keep_good": quality.keep_good,
    "keep_one": simhash.keep_one, "redact": pii.redact, "mix": mixing.mix,
}


@pytest.mark.parametrize("name", OPS)
def test_nasty_and_empty_tables(spark, name):
    """Nulls, empty and very long texts, repeated rows and clashing columns give a result; an
    empty table an empty one of the same columns."""
    docs = table(spark, NASTY)
    got = OPS[name](docs)
    rows = got.collect()
    assert OPS[name](docs.limit(0)).select(got.columns).count() == 0
    ids = sorted(str(r[0]) for r in rows)
    if name == "quality":
        assert ids == sorted(str(i) for i, _, _ in NASTY)
    if name == "secrets":
        assert ids == ["9"]
    if name == "pii":
        assert {(r["doc_id"], r["pii_type"]) for r in rows} == {(8, "email"), (8, "phone")}
    if name == "suffix":
        found = {(r["doc_id"], r["drop"]): (r["start_word"], r["end_word"]) for r in rows}
        assert found == {(1, False): (0, 20_000), (2, False): (0, 20_000), (2, True): (0, 20_000), (6, False): (80, 140), (7, False): (0, 60), (7, True): (0, 60)}
    if name == "simhash":
        assert {(r["doc_id"], r["group_id"], r["group_size"]) for r in rows} == {(1, 1, 2), (2, 1, 2)}
    if name == "keep_one":
        assert ids == sorted(["1", "3", "4", "None", "5", "6", "7", "8", "9"])
    if name == "redact":
        assert len(rows) == len(NASTY) and next(r["text"] for r in rows if r["doc_id"] == 8) == "mail [EMAIL] or [PHONE] now"
    if name in ("keep_good", "keep_one", "redact", "mix"):
        assert got.columns == docs.columns
    if name == "mixing":
        assert sum(r["copies"] for r in rows) >= len(NASTY)


def test_topk_against_brute_force(spark):
    g = np.random.default_rng(1)
    m = np.round(g.normal(size=(300, 8)) * g.exponential(size=(300, 1)), 3)
    m[7], m[8] = m[9], 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(m)] + [(None, [1.0] * 8, "x"), (900, None, "x"), (901, [], "x"), (902, [float("nan")] * 8, "x"), (903, [1.0], "x"), (5, m[5].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, norm string")
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in topk.top_k(df, 5, bucket_rows=64).collect()}
    assert len(got) == 1500
    for i in range(300):
        best = sorted(((-round(float(m[i] @ m[j]), 6) + 0.0, j) for j in range(300) if j != i))[:5]
        assert [got[i, r][0] for r in range(1, 6)] == [j for _, j in best]
    assert topk.top_k(df.limit(0)).count() == 0


def test_simhash_pairs_against_brute_force():
    g = np.random.default_rng(2)
    hi = g.integers(0, 2**63, 120, dtype=np.uint64)
    hi[60:] = hi[:60] ^ (np.uint64(1) << g.integers(0, 63, 60, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 63, 60, dtype=np.uint64))
    found = {(int(i), int(j)) for a, b in simhash.near_pairs(hi, hi, np.array([120])) for i, j in zip(a, b)}
    want = {(i, j) for i, j in itertools.combinations(range(120), 2) if (d := bin(int(hi[i] ^ hi[j])).count("1")) <= simhash.NEAR and 2 * d <= simhash.TOTAL}
    assert found == want and len(want) >= 60


def test_simhash_groups_against_brute_force(spark):
    docs, base = [], prose(200, 11).split()
    for i in range(60):
        words = list(base) if i < 20 else prose(120, 100 + i).split()
        if i < 20:
            words[i * 3] = "changed"
        docs.append((i, " ".join(words), "s"))
    make = simhash.Fingerprinter()
    lanes = [make.lanes(t) for _, t, _ in docs]
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    root = list(range(60))
    for _ in range(60):
        for i, j in itertools.combinations(range(60), 2):
            d = bits(lanes[i][0], lanes[j][0])
            if d <= simhash.NEAR and d + bits(lanes[i][1], lanes[j][1]) <= simhash.TOTAL:
                root[i] = root[j] = min(root[i], root[j])
    want = {(i, root[i]) for i in range(60) if root.count(root[i]) > 1}
    assert {(r["doc_id"], r["group_id"]) for r in simhash.groups(table(spark, docs)).collect()} == want


def test_simhash_recall_on_edited_documents(spark):
    """Copies with a few words replaced are grouped with what they copy, whichever lane
    their differing bits fall in, and nothing else is."""
    g, docs = random.Random(17), []
    for i in range(150):
        words = prose(150, 3000 + i).split()
        docs.append((2 * i, " ".join(words), "s"))
        for k in g.sample(range(150), 5):
            words[k] = f"edited{i}x{k}"
        docs.append((2 * i + 1, " ".join(words), "s"))
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(table(spark, docs)).collect()}
    make = simhash.Fingerprinter()
    lanes = [make.lanes(t) for _, t, _ in docs]
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    near = {i for i in range(0, 300, 2) if bits(lanes[i][0], lanes[i + 1][0]) + bits(lanes[i][1], lanes[i + 1][1]) <= simhash.TOTAL}
    assert len(near) >= 140 and {i for i in range(0, 300, 2) if got.get(i) == got.get(i + 1) == i} == near
    assert all(got[i] // 2 == i // 2 for i in got)


def test_simhash_buckets_hold_every_near_pair():
    g = np.random.default_rng(8)
    for k in range(simhash.AGREE[0], simhash.AGREE[1] + 1):
        for _ in range(50):
            flips = sum(1 << int(b) for b in g.choice(128, simhash.TOTAL, replace=False))
            assert any(not (flips >> 64 & x or flips & (1 << 64) - 1 & y) for x, y in simhash.masks(k))
    assert simhash.agreeing(10) == simhash.AGREE[0] < simhash.agreeing(10**8) < simhash.agreeing(10**11)


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(path).collect()} == {0}


def test_cover_sort_against_plain_sort():
    text = np.array([1, 2] * 40 + [3] + [1, 2] * 30 + [0], dtype=np.int64)
    sorter = suffix.CoverSorter(text, len(text))
    got = np.concatenate(list(sorter.buckets(np.arange(len(text)))))
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_warc_magic_in_payload_and_ranges(spark, tmp_path):
    inner = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u\r\nx", inner * 4), (2, None, None), (None, "v", "é" * 500), (3, "w", ""), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/w")
    for size in (64, 700, 1 << 20):
        got = warc.records(spark, f"{tmp_path}/w", range_bytes=size).collect()
        assert sorted(r["length"] for r in got) == sorted(len((h or "").encode()) for _, _, h in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ledger_scans_only_unseen(spark):
    one = spark.createDataFrame([("p", 1, "AKIA" + "A" * 16), ("q", 1, "AKIA" + "A" * 16), ("r", 1, "")], "path string, version int, content string")
    hits, findings, ledger = secrets.scan(one)
    assert {(r["path"], r["rule_id"]) for r in hits.collect()} == {("p", "aws_access_key"), ("q", "aws_access_key")} and findings.count() == 1
    # a ledger that lists everything leaves nothing to scan; old findings still reach new paths
    two = one.unionByName(spark.createDataFrame([("s", 2, "AKIA" + "A" * 16)], one.schema))
    again, total, book = secrets.scan(two, ledger, findings)
    assert total.count() == 1 and book.count() == ledger.count() and again.count() == 3
    assert secrets.scan(two, ledger, findings.limit(0))[0].count() == 0


def test_bootstrapping_finds_what_no_validator_knows(spark):
    seeds = "4111111111111111 5500000000000004 340000000000009 6011000000000004".split()
    docs = [(i, f"my card {c} please", "s") for i, c in enumerate(s for s in seeds if len(s) == 16)]
    docs += [(10 + i, f"my card 41111111111111{i}2 please", "s") for i in range(10, 11)]
    got = {r["value"]: (r["pii_type"], r["seeded"]) for r in pii.extract(table(spark, docs), accept=0.5).collect()}
    assert got["4111111111111111"] == ("card", True) and got["4111111111111110"[:14] + "102"[:2] if False else docs[-1][1].split()[2]] == ("card", False)


def test_look_alikes_of_a_seeds_shape_stay(spark):
    """Half the numbers of a shape are seeds: that isn't evidence for the others, however
    many rounds; words that go with seeds alone still are."""
    g, valid, other = random.Random(4), [], []
    while min(len(valid), len(other)) < 40:
        digits = [4] + [g.randrange(10) for _ in range(15)]
        luhn = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
        (valid if luhn else other).append("".join(map(str, digits)))
    valid, other = valid[:40], other[:40]
    docs = [(i, f"{WORDS[2 * i]} {v} {WORDS[2 * i + 1]}", "s") for i, v in enumerate(valid + other)]
    got = {r["value"] for r in pii.extract(table(spark, docs)).collect()}
    assert got == set(valid)
    docs += [(100 + i, f"visa {v} {WORDS[200 + i]}", "s") for i, v in enumerate(valid[:20] + other[:1])]
    got = {r["value"] for r in pii.extract(table(spark, docs)).collect()}
    assert got == {*valid, other[0]}


def test_packing_keeps_every_token(spark):
    docs = [(i, prose(n, i), "s") for i, n in enumerate([5, 700, 3000, 9000, 9000, 40, 1])]
    rows = packing.pack(table(spark, docs)).collect()
    with open(packing.VOCABULARY, "rb") as f:
        count = packing.Tokens(f.read())
    for i, t, _ in docs:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in own) == count(t) and [r["start_token"] for r in own] == list(np.cumsum([0] + [r["n_tokens"] for r in own[:-1]]))
    for _, b in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["bin"], r["bin_offset"])), key=lambda r: (r["shard"], r["bin"])):
        b = list(b)
        used = sum(r["n_tokens"] for r in b)
        assert [r["bin_offset"] for r in b] == list(np.cumsum([0] + [r["n_tokens"] for r in b[:-1]]))
        assert b[0]["capacity"] == min(c for c in packing.CAPACITIES if c >= used)
    bins, _, caps = packing.pack_shard([500, 400, 112, 100], (512, 1024))
    assert len(set(bins)) <= 3 and sum(caps) <= 1536


def test_mixing_is_exact_and_stable(spark):
    docs = table(spark, [(i, prose(1 + i % 50, i), "ab"[i % 3 == 0]) for i in range(300)])
    got = mixing.allocate(docs, weights={"a": 1.0, "b": 3.0}, budget=400).groupBy("source").agg(F.sum("copies")).collect()
    assert dict(got) == {"a": 100, "b": 300}
    one, two = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 300


def test_gradients_of_the_network():
    g = np.random.default_rng(5)
    net = toxicity.Network(["aa", "bb"])
    windows, y = [["aa", "ccc", "bb"], ["d"]], np.array([1, 0], dtype=np.float32)

    class Shown:
        def random(self, n):
            return np.ones(n)

    grads, _ = net.gradients(windows, y, Shown())

    def loss():
        p = np.clip(net.gradients(windows, y, Shown())[1].astype(np.float64), 1e-9, 1)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for name in ("wfx", "cbu", "aw", "words", "chars"):
        k = tuple(int(x) for x in np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape))
        net.p[name][k] += 1e-2
        up = loss()
        net.p[name][k] -= 2e-2
        down = loss()
        net.p[name][k] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name][k]), rel=0.1, abs=2e-3), name
    assert g is not None


def test_toxicity_on_held_out_documents(spark):
    texts = [prose(60, i) + (" vileword" + "xyz"[i % 3] + " ") * (i % 2) + prose(40, 900 + i) for i in range(240)]
    net, threshold = toxicity.fit(texts[:160], [i % 2 for i in range(160)])
    docs = table(spark, [(i, texts[i], "s") for i in range(160, 240)] + [(None, None, "s"), (500, "", "s")])
    rows = toxicity.score_documents(docs, net, threshold).collect()
    right = [r["toxic"] == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] is not None and r["doc_id"] < 500]
    assert sum(right) >= 0.9 * len(right) and len(rows) == 82
    assert [(r["n_windows"], r["score"]) for r in rows if r["doc_id"] in (None, 500)] == [(0, 0.0)] * 2
    with pytest.raises(ValueError, match="needs toxic"):
        toxicity.train(["a"], [0])


def test_toxicity_learns_of_every_labelled_document(spark, monkeypatch):
    """no sample trains the model, counts its words or sets the threshold."""
    monkeypatch.setattr(toxicity, "PART_CHARS", 300_000)
    texts = [prose(30, i) + (" vileword " if i % 2 else " ") + f"only{i // 20}x" for i in range(3300)]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(9000, None, "s"), (9001, "--", "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3300)] + [(9000, 1), (9001, 1), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    marks = toxicity.marks_of(labels)
    rows = toxicity.labelled(docs, marks)
    assert rows.count() == 3301 and 1 < rows.select("part").distinct().count() <= 3
    n = {r["word"]: r["n"] for r in toxicity.counts(rows).collect()}
    assert (n[toxicity.TOXIC], n[toxicity.CLEAN], n["vileword"]) == (1650, 1650, 1650)
    assert all(n[f"only{k}x"] == 20 for k in range(165))
    net = toxicity.train_spread(rows)
    assert {f"only{k}x" for k in range(165)} <= set(net.ids)
    got = toxicity.classify(docs, labels).collect()
    assert sum(r["toxic"] == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] < 9000) >= 3200 and len(got) == 3302


def test_toxicity_takes_every_document_in_an_epoch():
    for clean, toxic in ((100, 3), (70, 30), (50, 50), (3, 100)):
        repeats, weight = toxicity.balance(clean, toxic)
        for label in (0, 1):
            for slot in range(toxicity.EPOCHS * toxicity.ROUNDS):
                taken = [e for e in range(toxicity.EPOCHS) for t in range(toxicity.ROUNDS) if toxicity.in_round(label, slot, e, t, repeats)]
                assert len(taken) == len(set(taken)) == (toxicity.EPOCHS if label else repeats) >= 1
        assert (weight * [clean * repeats / toxicity.EPOCHS, toxic]).sum() == pytest.approx(clean * repeats / toxicity.EPOCHS + toxic)


def test_toxicity_rounds_give_the_driver_one_state(spark, monkeypatch):
    """However many parts there are."""
    monkeypatch.setattr(toxicity, "PART_CHARS", 10_000)
    docs = table(spark, [(i, prose(30, i) + " vileword" * (i % 2), "s") for i in range(240)])
    rows = toxicity.labelled(docs, toxicity.marks_of(spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id bigint, toxic int")))
    assert rows.select("part").distinct().count() >= 3
    given, collect = [], type(docs).collect

    def seen(df):
        got = collect(df)
        given.append(sum(len(x) for r in got for x in r if isinstance(x, (bytes, bytearray))))
        return got

    monkeypatch.setattr(type(docs), "collect", seen)
    net = toxicity.train_spread(rows)
    assert max(given) == toxicity.Learner(net).state().nbytes


def test_average_of_a_round(spark):
    cells = [(0, 3, [2, 5], [1.0, 8.0]), (1, 1, [4, 1], [5.0, 0.0]), (2, 0, [0, 0], [99.0, 99.0])]
    states = spark.createDataFrame([(k, n, s, bytearray(np.array(x, dtype=np.float32).tobytes())) for k, n, s, x in cells], "part bigint, windows bigint, steps array<bigint>, state binary")
    (got,) = toxicity.averaged(states.repartition(3)).collect()
    assert (got["windows"], got["steps"], np.frombuffer(got["state"], dtype=np.float32).tolist()) == (4, [4, 5], [2.0, 6.0])
    assert toxicity.averaged(states.where("windows = 0")).collect() == []


def test_threshold_of_all_scores(spark):
    scores = spark.createDataFrame([(k, 1, s) for k, s in enumerate([0.9, 0.9, 0.8, 0.8, 0.7, 0.2, 0.1])] + [(8, 0, 0.0), (9, 1, 0.99)], "doc_id bigint, n_windows bigint, score double")
    marks = spark.createDataFrame([(k, int(k in (0, 1, 2, 3, 5))) for k in range(9)], "l_id bigint, l_toxic int")
    each = toxicity.best_threshold(np.array([0.9, 0.9, 0.8, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 1, 1, 0, 1, 0]))
    assert toxicity.threshold_of(scores, marks) == pytest.approx(each) and 0.1 < each < 0.2


def test_pipeline_stages_take_effect(spark, tmp_path):
    clean = [(i, prose(100 + i, 50 + i), "good") for i in range(40)]
    rows = [*clean, (100, clean[0][1], "good"), (101, "### " * 50, "good"), (102, prose(90, 7) + " mail bob@site.org", "good")]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r["doc_id"] for r in docs.collect()})
    everything = {i for i, _, _ in rows}
    assert kept == [everything - {101}, everything - {101, 100}, everything - {101, 100}]
    assert next(r["text"] for r in docs.collect() if r["doc_id"] == 102).endswith("mail [EMAIL]")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= kept[-1]
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
