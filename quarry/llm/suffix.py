"""Passages repeated across documents, by difference-cover blockwise suffix sorting.

A passage is ``L`` consecutive words (runs of letters and digits, lower-cased). The result
is, for each document, the maximal runs of words covered by passages that also occur in a
document of another id, and those covered by passages that a document of a lesser id has:
cutting these (:func:`drop_repeats`) leaves one copy of each.

Sorting all suffixes of a corpus would ship every text once a suffix, so suffixes are
first narrowed down, exactly: winnowed ``K``-word anchors (every passage of L words holds
one) are counted, and only anchors of two documents keep their surroundings, the L - K
words before and L after. Surroundings of one anchor, which is a bucket of suffixes, go to
one task, which builds their suffix array blockwise:

* suffixes at a difference cover's residues (mod 7: 0, 1, 3) are ranked first, by prefix
  doubling in steps of the cover's period;
* then one bucket of suffixes (by first word) is sorted at a time. Ties in the first seven
  words, however long, are resolved by the two suffixes' cover ranks at the offset at
  which both lie in the cover, so no suffix is ever read further and memory is bounded by
  the bucket;
* neighbours with L common words form runs; a run with two document ids is a repeat.

An anchor of more than ``HOT`` places would be too large a bucket. The passages that hold
such an anchor are counted by 128-bit hashes instead, added up before they are shuffled.

Within a bucket words are told apart by 32 bits of their hash, and anchors by 64: texts
that differ are taken for the same with a probability of about 2^-32 a compared word.

Defined cases: null texts, texts of under L words and rows with a null doc_id have no
passages; rows of one id aren't repeats of each other; each text of an id has runs of its
own, and equal runs are returned once; repeated rows count once; extra columns are ignored
by :func:`repeated_passages` and kept by :func:`drop_repeats`, under any names; empty tables
give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import plain, saved, small_side

L, K = 50, 16
PERIOD, COVER = 7, (0, 1, 3)
#: Surroundings sorted together; a task works through its anchors in shards of about this.
SHARD_ROWS = 20_000
BUCKETS = 4
#: Places of an anchor that one task sorts.
HOT = 20_000
WORD = re.compile(r"[^\W_]+")
MEMO = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

_IN = np.array([r in COVER for r in range(PERIOD)])
#: The least offset at which residues r and s both lie in the cover.
OFFSET = np.array([[next(k for k in range(PERIOD) if _IN[(r + k) % PERIOD] and _IN[(s + k) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])


class Words:
    """Texts to arrays of 64-bit word hashes."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text) if text else []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.lower())
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(words: np.ndarray, k: int = K) -> np.ndarray:
    """Mixed hashes of all k-word windows; k is a power of two."""
    h, width, power = words, 1, _ODD
    while width < k:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power & _M64
        width *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(words: np.ndarray, length: int = L, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the least k-gram of every window of ``length`` words (leftmost)."""
    if len(words) < length:
        return np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    h = grams(words, k)
    w = length - k + 1
    low, width = h, 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(h) - w + 1], low[w - width : w - width + len(h) - w + 1])
    # the leftmost place of each window's minimum, from its last place of that value on
    place = np.flatnonzero(np.ones(len(h), dtype=bool))
    seen = np.zeros(len(h), dtype=bool)
    todo = np.arange(len(low))
    for step in range(w):
        at = todo + step
        hit = h[at] == low[todo]
        seen[at[hit]] = True
        todo = todo[~hit]
        if not len(todo):
            break
    return h[seen], place[seen]


class CoverSorter:
    """Suffix order of ``text`` (word ids; equal ids, equal words) with cover ranks."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        ids = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        self.text = np.concatenate([ids, np.zeros(depth + 2 * PERIOD, dtype=np.int64)])
        sample = np.flatnonzero(_IN[np.arange(n) % PERIOD])
        self.rank = np.zeros(n + 2 * depth + 4 * PERIOD, dtype=np.int64)
        width = PERIOD
        keys = self._columns(sample)
        while True:
            order = np.lexsort(keys[::-1])
            changed = np.zeros(len(order), dtype=bool)
            for key in keys:
                s = key[order]
                changed[1:] |= s[1:] != s[:-1]
            ranks = np.cumsum(changed) + 1
            self.rank[sample[order]] = ranks
            if width >= depth or not len(order) or ranks[-1] == len(order):
                return
            keys = [self.rank[sample] << 32 | self.rank[sample + width]]
            width *= 2

    def _columns(self, at: np.ndarray) -> list[np.ndarray]:
        """The first PERIOD words at ``at``, two a column."""
        t = self.text
        return [t[at + c] << 32 | (t[at + c + 1] if c + 1 < PERIOD else 0) for c in range(0, PERIOD, 2)]

    def compare(self, i: int, j: int) -> int:
        """Suffixes ``i`` and ``j``, alike in their first PERIOD words."""
        k = OFFSET[i % PERIOD, j % PERIOD]
        a, b = self.rank[i + k], self.rank[j + k]
        return int(a > b) - int(a < b)

    def buckets(self, at: np.ndarray, parts: int = BUCKETS) -> Iterator[np.ndarray]:
        """``at`` in suffix order, one bucket at a time."""
        if not len(at):
            return
        first = self.text[at]
        bounds = np.unique(np.quantile(first, np.linspace(0, 1, parts + 1)[1:-1], method="lower"))
        which = np.searchsorted(bounds, first)
        for b in range(len(bounds) + 1):
            part = at[which == b]
            if not len(part):
                continue
            columns = self._columns(part)
            residue = part % PERIOD
            own = self.rank[part + OFFSET[residue, residue]]
            order = np.lexsort([own, *columns[::-1]])
            part, residue = part[order], residue[order]
            tie = np.ones(len(part), dtype=bool)
            tie[0] = False
            for c in columns:
                s = c[order]
                tie[1:] &= s[1:] == s[:-1]
            mixed = np.flatnonzero(tie[1:] & (residue[1:] != residue[:-1])) + 1
            if len(mixed):  # ties of several residues: compared pair by pair
                starts = np.flatnonzero(~tie)
                ends = np.append(starts[1:], len(part))
                for g in np.unique(np.searchsorted(starts, mixed, "right") - 1):
                    part[starts[g] : ends[g]] = sorted(part[starts[g] : ends[g]].tolist(), key=cmp_to_key(self.compare))
            yield part

    def common(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes at ``a`` and ``b`` have ``length`` words in common."""
        live = np.arange(len(a))
        for j in range(length):
            live = live[self.text[a[live] + j] == self.text[b[live] + j]]
        out = np.zeros(len(a), dtype=bool)
        out[live] = True
        return out


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the runs of true places in each row."""
    edge = np.zeros((len(on), on.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = on
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1]  # both row by row, so they pair up


def repeats(doc: np.ndarray, start: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = L) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first word, end word, drop) of passages of two documents within ``rows``, a
    matrix of words: row r holds words ``low[r]`` to ``high[r]`` of its columns, column 0
    being word ``start[r]`` of document ``doc[r]``; with ``drop``, of those passages that a
    lesser document has."""
    width = rows.shape[1]
    starts = width - length + 1
    columns = np.arange(width)
    inside = (columns >= low[:, None]) & (columns < high[:, None])
    powers = np.array([pow(_ODD, c + 1, 1 << 64) for c in range(width)], dtype=np.uint64)
    masked = np.where(inside, rows.astype(np.uint64) + np.uint64(1), np.uint64(0))
    mixed = (masked ^ (masked << np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
    mark = ((mixed ^ (mixed >> np.uint64(29))) * powers).sum(axis=1, dtype=np.uint64)
    _, first, of = np.unique(mark, return_index=True, return_inverse=True)
    n = len(first)
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, of, doc)
    np.maximum.at(most, of, doc)
    stride = -(-(width + 1) // PERIOD) * PERIOD
    text = np.repeat((1 << 33) + np.arange(n, dtype=np.int64), stride).reshape(n, stride)  # an end mark a row
    text[:, :width] = np.where(inside[first], rows[first].astype(np.int64), text[:, :width])
    valid = (columns[:starts] >= low[first, None]) & (columns[:starts] + length <= high[first, None])
    found = valid & (least < most)[:, None]
    lead = np.repeat(least[:, None], starts, axis=1)  # the least document that has the passage
    sorter = CoverSorter(text.ravel(), stride)
    at = (np.arange(n)[:, None] * stride + columns[:starts])[valid]
    for part in sorter.buckets(at):
        joined = np.zeros(len(part), dtype=bool)
        joined[1:] = sorter.common(part[:-1], part[1:], length)
        run = np.cumsum(~joined) - 1
        heads = np.flatnonzero(~joined)
        row, column = np.divmod(part, stride)
        low_id, high_id = np.minimum.reduceat(least[row], heads), np.maximum.reduceat(most[row], heads)
        lead[row, column] = low_id[run]
        across = (low_id < high_id)[run]
        found[row[across], column[across]] = True
    every = found[of]
    out = [(*_runs(every), False), (*_runs(every & (lead[of] < doc[:, None])), True)]
    row, c0, c1 = (np.concatenate([x[k] for x in out]) for k in range(3))
    drop = np.concatenate([np.full(len(x[0]), x[3]) for x in out])
    return row, start[row] + c0, start[row] + c1 - 1 + length, drop


RUN = "doc_id bigint, mark bigint, start_word bigint, end_word bigint, drop boolean"


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = L, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, mark, start_word, end_word, drop): merged runs of each text, which mark hashes."""
    before, width = length - k, 2 * length - k
    docs, (i, t) = plain(docs, id_col, text)
    # no id is null here, so pandas leaves bigints as they are
    rows = docs.where(F.col(i).isNotNull() & (F.length(t) >= 2 * length - 1)).select(F.col(i).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("mark"), F.col(t).alias("text")).where("doc_id is not null")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            got = [anchors(words(x), length, k) for x in pdf["text"]]
            if got:
                n = [len(h) for h, _ in got]
                yield pd.DataFrame({"h": np.concatenate([h for h, _ in got]).view(np.int64), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), n), "mark": np.repeat(pdf["mark"].to_numpy(), n), "place": np.concatenate([p for _, p in got]).astype(np.int32)})

    found = saved(rows.mapInPandas(sample, "h bigint, doc_id bigint, mark bigint, place int"), "anchors")
    shared = saved(found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("h", (F.col("n") > hot).alias("hot")), "shared")
    some_hot = not shared.where("hot").isEmpty()
    # what is alike is collected once, so a list is bounded by its text
    near = found.join(shared, "h").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("place", "h", "hot")).alias("at"))
    if not rows.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():  # one of the rows alike; the join needs the same partitions
        rows = rows.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    half = 1 << (length.bit_length() - 1)

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        names = ["h", "doc_id", "mark", "start", "low", "high", "words"]
        for pdf in batches:
            out = []
            for doc, mark, x, at in zip(pdf["doc_id"], pdf["mark"], pdf["text"], pdf["at"]):
                w = words(x)
                place = np.array([p["place"] for p in at], dtype=np.int64)
                h = np.array([p["h"] for p in at], dtype=np.int64)
                often = np.array([p["hot"] for p in at], dtype=bool)
                if often.any():  # passages around frequent anchors, by two hashes
                    g = grams(w, half)
                    s = np.unique(np.concatenate([place[often] - c for c in range(before + 1)]))
                    s = s[(s >= 0) & (s + length <= len(w))]
                    pair = g[s].view(np.int64), g[s + length - half]
                    out.extend(zip(pair[0].tolist(), [doc] * len(s), [mark] * len(s), s.tolist(), [-1] * len(s), [-1] * len(s), [x.tobytes() for x in pair[1]]))
                    place, h = place[~often], h[~often]
                start = place - before
                low, high = np.maximum(0, -start), np.minimum(width, len(w) - start)
                index = np.clip(start[:, None] + np.arange(width), 0, len(w) - 1)
                block = (w[index] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.extend(zip(h.tolist(), [doc] * len(h), [mark] * len(h), start.tolist(), low.tolist(), high.tolist(), [b.tobytes() for b in block]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    wide = rows.join(near.hint("shuffle_hash"), ["doc_id", "mark"]).mapInPandas(surround, "h bigint, doc_id bigint, mark bigint, start int, low int, high int, words binary")
    wide = saved(wide, "wide") if some_hot else wide

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.frombuffer(b"".join(pdf["words"]), dtype=np.uint32).reshape(len(pdf), width)
            row, a, b, drop = repeats(pdf["doc_id"].to_numpy(), pdf["start"].to_numpy(dtype=np.int64), m, pdf["low"].to_numpy(dtype=np.int64), pdf["high"].to_numpy(dtype=np.int64), length)
            return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "mark": pdf["mark"].to_numpy()[row], "start_word": a, "end_word": b, "drop": drop}).drop_duplicates()

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < SHARD_ROWS:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = pdf["h"] == pdf["h"].iloc[-1]  # an anchor, of at most HOT places, may span batches
            held = [pdf[last]]
            if not last.all():
                yield shard(pdf[~last])
        if held and sum(map(len, held)):
            yield shard(pd.concat(held, ignore_index=True))

    got = wide.where("low >= 0").repartition("h").sortWithinPartitions("h").mapInPandas(sort, RUN)
    if some_hot:
        often = wide.where("low < 0").select("h", "words", "doc_id", "mark", "start")
        both = often.groupBy(F.col("h").alias("s_h"), F.col("words").alias("s_words")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
        hit = often.join(small_side(both, "passages"), (F.col("h") == F.col("s_h")) & (F.col("words") == F.col("s_words")))
        kinds = F.explode(F.when(F.col("a") < F.col("doc_id"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        more = hit.select("doc_id", "mark", F.col("start").cast("bigint").alias("start_word"), (F.col("start") + length).cast("bigint").alias("end_word"), kinds.alias("drop"))
        got = got.unionByName(more)
    return merged(got)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = L, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, drop): the runs, end_word exclusive; of rows with
    ``drop`` another document keeps the words."""
    return runs(docs, id_col, text, length, k, hot).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "drop").distinct()


def merged(runs: DataFrame) -> DataFrame:
    """Overlapping or touching runs of a text as one."""
    key = ["doc_id", "mark", "drop"]
    order = Window.partitionBy(*key).orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col("start_word"), 0).otherwise(1)).over(order)
    return runs.withColumn("island", island).groupBy(*key, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what lies between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = L, k: int = K, hot: int = HOT) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but that of the least id;
    other columns and all rows stay."""
    spans = runs(docs, id_col, text, length, k, hot).where("drop").groupBy(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark"))
    spans = small_side(spans.agg(F.collect_list(F.struct("start_word", "end_word")).alias("r_spans")), "spans", 4 << 20, "shuffle_hash")
    rows, (i, t) = plain(docs, id_col, text)
    here = (F.col(i).cast("bigint") == F.col("r_id")) & (F.xxhash64(t) == F.col("r_mark"))
    at = rows.columns.index(t)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(x, [(s["start_word"], s["end_word"]) for s in own]) for x, own in zip(batch.column(at).to_pylist(), spans)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    hit = rows.join(spans, here).select(*rows.columns, "r_spans").mapInArrow(shorten, rows.schema)
    return rows.join(spans, here, "left_anti").unionByName(hit).toDF(*docs.columns)


SQL = rf"""
WITH w AS (SELECT DISTINCT doc_id, md5(text) AS mark, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, mark, i AS a, md5(array_to_string(w[i + 1 : i + {L}], ' ')) AS h FROM (SELECT doc_id, mark, w, unnest(range(len(w) - {L - 1})) AS i FROM w WHERE len(w) >= {L})),
r AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, mark, a, first FROM g JOIN r USING (h)),
p AS (SELECT doc_id, mark, a, false AS drop_ FROM f UNION SELECT doc_id, mark, a, true FROM f WHERE first < doc_id),
s AS (SELECT *, sum(CASE WHEN a <= coalesce(prev, -1) + {L} AND prev IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, mark, drop_ ORDER BY a) AS island
  FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id, mark, drop_ ORDER BY a) AS prev FROM p))
SELECT DISTINCT doc_id, min(a)::BIGINT AS start_word, (max(a) + {L})::BIGINT AS end_word, (max(a) + {L} - min(a))::BIGINT AS n_words, drop_ AS "drop" FROM s GROUP BY doc_id, mark, drop_, island
"""
