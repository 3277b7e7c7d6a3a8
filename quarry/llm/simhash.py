"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint is two 64-bit SimHash lanes over its set of lower-cased words.
Two fingerprints are near when both lanes together differ in at most ``total`` bits;
documents are grouped by the connected components of that relation.

Pairs are found exactly. The 128 bits are cut into seven stretches; 21 differing bits would
be needed to put three into each, so near fingerprints differ in at most two bits of some
stretch, and of its ``agree + 2`` blocks they share at least ``agree``. Each distinct
fingerprint goes to one bucket for every choice of ``agree`` blocks of every stretch
(:func:`masks`); ``agree`` is what makes rows shipped and pairs compared cheapest for the
size of the corpus. A pivot table alone would compare all pairs of the corpus; here it
prunes inside large buckets: the distances of their members to ``PIVOTS`` reference
fingerprints are computed once, the members are sorted by the most spread of them, and
pairs whose distances differ by more than ``total`` (triangle inequality) are left out.
What stays is verified bit by bit. Where many members lie within ``total`` of one of them
they are joined to it and not compared with each other. A bucket sends on a spanning star
of each of its groups instead of all pairs, so large groups of copies cost no quadratic
output. A bucket of more than ``HOT`` members is cut into slices, and pairs of slices are
compared apart, so no task holds more than two slices.

Defined cases: null texts, and texts without a word, have no fingerprint and are in no
group; rows with a null doc_id are in no group; repeated rows count once in
:func:`groups`; :func:`keep_one` keeps, of each group, the row of least doc_id (of rows
with that doc_id, one of the least text hash); extra columns are ignored or kept as they
are, under any names; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, plain, saved, small_side

TOTAL = 20
#: Most bits of one lane: no limit beyond that on both.
NEAR = TOTAL
STRETCHES, SPARE = 7, 2  # STRETCHES * (SPARE + 1) > TOTAL
AGREE = (3, 16)
#: Microseconds that a row sent to a bucket and a compared pair take, as measured.
ROW_COST, PAIR_COST = 3.0, 0.005
PIVOTS = 16
#: Buckets up to this size are compared whole.
WHOLE = 256
#: Pairs compared at a time.
PAIRS = 1 << 17
#: Members of a bucket, or of a slice of it, that one task holds.
HOT = 1 << 20
#: Found pairs held before they are reduced to stars.
HELD = 1 << 20
WORD = re.compile(r"[^\W_]+")
#: Words remembered by a Python worker; a bound on memory, not on what is hashed.
MEMO = 2_000_000

_REFERENCES = np.array([[xxhash.xxh64_intdigest(f"reference {k} {i}") for i in range(PIVOTS)] for k in range(2)], dtype=np.uint64)


def masks(agree: int) -> list[tuple[int, int]]:
    """(mask of hi, mask of lo) of every choice of ``agree`` blocks of a stretch."""
    out = []
    for k in range(STRETCHES):
        a, b = round(128 * k / STRETCHES), round(128 * (k + 1) / STRETCHES)
        n = agree + SPARE
        edges = [a + round((b - a) * i / n) for i in range(n + 1)]
        blocks = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:])]
        out += [(m >> 64, m & (1 << 64) - 1) for m in map(sum, combinations(blocks, agree))]
    return out


def agreeing(rows: int) -> int:
    """The number of blocks to agree on for least work, were rows spread evenly."""

    def work(k: int) -> float:
        n = k + SPARE
        choices = STRETCHES * n * (n - 1) / 2
        return choices * (ROW_COST + rows / 2 ** (128 / STRETCHES * k / n) / 2 * PAIR_COST)

    return min(range(AGREE[0], AGREE[1] + 1), key=work)


class Fingerprinter:
    def __init__(self) -> None:
        self.memo: dict[str, bytes] = {}

    def lanes(self, text: str | None) -> tuple[int, int] | None:
        words = set(WORD.findall(text.lower())) if text else None
        if not words:
            return None
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_128_digest(w)
        bits = np.unpackbits(np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype=np.uint8).reshape(-1, 16), axis=1)
        votes = bits.sum(axis=0, dtype=np.int32)
        a, b = np.packbits(votes * 2 > len(bits)).view(">i8")
        return int(a), int(b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hi, lo, mark) of every row with an id and a word; mark is a text hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprinter()
        for pdf in batches:
            got = [(i, x, m) for i, m, x in zip(pdf["doc_id"], pdf["mark"], map(make.lanes, pdf["text"])) if x]
            yield pd.DataFrame({"doc_id": [i for i, _, _ in got], "hi": [x[0] for _, x, _ in got], "lo": [x[1] for _, x, _ in got], "mark": [m for _, _, m in got]})

    rows, (i, t) = plain(docs, id_col, text)
    # no id is null here, so pandas leaves bigints as they are
    rows = rows.select(F.col(i).cast("bigint").alias("doc_id"), F.col(t).alias("text"), F.xxhash64(t).alias("mark")).where("doc_id is not null")
    return rows.mapInPandas(run, "doc_id bigint, hi bigint, lo bigint, mark bigint")


def _close(h: np.ndarray, w: np.ndarray, total: int, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places, in ``a`` and in ``b``, of the pairs within ``total`` bits."""
    d = np.bitwise_count(h[a, None] ^ h[None, b])
    d += np.bitwise_count(w[a, None] ^ w[None, b])
    x, y = np.divmod(np.flatnonzero(d <= total), d.shape[1])
    return a.start + x, b.start + y


def near_pairs(hi: np.ndarray, lo: np.ndarray, sizes: np.ndarray, total: int = TOTAL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (i, j), i < j, among rows that lie bucket after bucket, ``sizes`` rows
    each: all pairs of buckets of up to ``WHOLE`` rows, enough to connect what is near in
    larger ones."""
    starts = np.cumsum(sizes) - sizes
    for start, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        order, far = np.arange(start, start + n), np.zeros(n, dtype=np.int64)
        if n > WHOLE:
            tables = np.bitwise_count(hi[order] ^ _REFERENCES[0][:, None]) + np.bitwise_count(lo[order] ^ _REFERENCES[1][:, None])
            far = tables[tables.var(axis=1).argmax()].astype(np.int64)
            by = far.argsort(kind="stable")
            order, far = order[by], far[by]
        outer = n
        while outer > 1:
            # a dense ball: its members are connected to its centre; those outside it come
            # first, and meet each other and what is in it
            inner, before = np.array([], dtype=np.int64), outer
            if outer > WHOLE:
                c = order[outer // 2]
                near = np.bitwise_count(hi[order[:outer]] ^ hi[c]) + np.bitwise_count(lo[order[:outer]] ^ lo[c]) <= total
                if near.sum() * 8 >= outer:
                    inner = order[:outer][near]
                    yield np.minimum(inner, c)[inner != c], np.maximum(inner, c)[inner != c]
                    by = np.concatenate([np.flatnonzero(~near), np.flatnonzero(near)])
                    order[:outer], far[:outer] = order[:outer][by], far[:outer][by]
                    outer -= len(inner)
            h, w = hi[order[:before]], lo[order[:before]]
            step = max(1, min(128, PAIRS // n))
            for a in range(0, outer, step):
                b = min(outer, a + step)
                if len(inner):
                    from_, to = outer + np.searchsorted(far[outer:before], [far[a] - total, far[b - 1] + total + 1])
                else:
                    from_, to = a, a + np.searchsorted(far[a:outer], far[b - 1] + total, "right")
                x, y = _close(h, w, total, slice(a, b), slice(int(from_), int(to)))
                x, y = order[x[x < y]], order[y[x < y]]
                if len(x):
                    yield np.minimum(x, y), np.maximum(x, y)
            if not len(inner):
                break


def _stars(pairs: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a component to its least node, instead of all pairs."""
    i, j = (np.concatenate(x) for x in zip(*pairs))
    label = node.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    touched = np.flatnonzero(label != node)
    return label[touched], node[touched]


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, part, i, j) -> star edges; a bucket may span batches."""
    cell = ["mask", "part", "i", "j"]
    held: list[pd.DataFrame] = []

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [pdf[c].to_numpy() for c in cell]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        bounds = np.concatenate([[0], cut, [len(pdf)]])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held_pairs = 0
        for pair in near_pairs(pdf["hi"].to_numpy().view(np.uint64), pdf["lo"].to_numpy().view(np.uint64), np.diff(bounds)):
            pairs.append(pair)
            held_pairs += len(pair[0])
            if held_pairs > HELD:
                pairs, held_pairs = [_stars(pairs, np.arange(len(pdf)))], 0
        if not pairs:
            return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
        a, b = _stars(pairs, pdf["node"].to_numpy())
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) < 50_000:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = np.logical_and.reduce([pdf[c] == pdf[c].iloc[-1] for c in cell])
        held = [pdf[last]]
        if not last.all():
            yield flush(pdf[~last])
    if held and sum(map(len, held)):
        yield flush(pd.concat(held, ignore_index=True))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size) of the documents that have a near or exact copy;
    group_id is the least doc_id of the group. An id counts once in its group."""
    prints = saved(fingerprints(docs, id_col, text), "fingerprints")
    members = saved(_members(prints), "members")
    per = members.groupBy("root").agg(F.count_distinct("doc_id").alias("group_size")).where("group_size > 1")
    return members.join(per, "root").select("doc_id", F.col("root").alias("group_id"), "group_size").distinct()


def _members(prints: DataFrame) -> DataFrame:
    """(doc_id, mark, root) of every fingerprinted row."""
    distinct = saved(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "prints")
    rows = distinct.count()
    signed = lambda m: F.lit(m if m < 1 << 63 else m - (1 << 64))
    # a stretch lies in one lane, or at the end of one and the start of the other: no bits clash
    parts = [F.col("hi").bitwiseAND(signed(x)).bitwiseOR(F.col("lo").bitwiseAND(signed(y))) for x, y in masks(agreeing(rows))]
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), part.alias("part")) for k, part in enumerate(parts)])
    spread = distinct.select("hi", "lo", "node", F.explode(keys).alias("k")).select("k.mask", "k.part", "hi", "lo", "node")
    if rows > HOT:
        # a bucket has at most all rows; map tasks add up, as buckets are few next to rows
        sizes = spread.groupBy(F.col("mask").alias("h_mask"), F.col("part").alias("h_part")).count().where(F.col("count") > HOT)
        hot = small_side(sizes.select("h_mask", "h_part", F.ceil(F.col("count") / HOT).alias("slices")), "hot")
        slices = F.coalesce("slices", F.lit(1).cast("long"))
        own = F.pmod(F.xxhash64("node"), slices)
        cells = F.transform(F.sequence(F.lit(0).cast("long"), slices - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
        spread = spread.join(hot, (F.col("mask") == F.col("h_mask")) & (F.col("part") == F.col("h_part")), "left")
        spread = spread.select("mask", "part", F.explode(cells).alias("c"), "hi", "lo", "node").select("mask", "part", "c.i", "c.j", "hi", "lo", "node")
    else:
        spread = spread.select("mask", "part", F.lit(0).alias("i"), F.lit(0).alias("j"), "hi", "lo", "node")
    found = spread.repartition("mask", "part", "i", "j").sortWithinPartitions("mask", "part", "i", "j").mapInPandas(_edges, "a bigint, b bigint")
    roots = components(found.distinct())
    named = distinct.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))
    return prints.join(named, ["hi", "lo"]).select("doc_id", "mark", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that copy another row of their group."""
    prints = saved(fingerprints(docs, id_col, text), "fingerprints")
    members = saved(_members(prints), "members")
    best = members.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("best"), F.count("*").alias("n")).where("n > 1")
    marked = members.join(best, "root").groupBy("doc_id", "mark").agg(F.count("*").alias("times"), F.max(F.struct("doc_id", "mark") == F.col("best")).alias("stays"))
    drop = marked.where("not stays or times > 1").select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), F.col("stays").alias("s_stays"))
    rows, (i, t) = plain(docs, id_col, text)
    keyed = rows.withColumns({"s_key": F.col(i).cast("bigint"), "s_text": F.xxhash64(t)})
    hit = (F.col("s_key") == F.col("s_id")) & (F.col("s_text") == F.col("s_mark"))
    drop = small_side(drop, "dropped", beyond="shuffle_hash")
    out = keyed.join(drop, hit, "left_anti").select(*rows.columns)
    again = drop.where("s_stays")
    if again.isEmpty():
        return out.toDF(*docs.columns)
    # rows repeated whole: one of each stays
    once = keyed.join(again, hit).groupBy("s_id", "s_mark").agg(*[F.first(c).alias(c) for c in rows.columns])
    return out.unionByName(once.select(*rows.columns)).toDF(*docs.columns)
