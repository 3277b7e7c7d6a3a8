"""Best-fit packing into bins of several permitted sequence lengths.

Lengths are token counts. Pieces are taken in falling order of length; each goes to the
open bin with the least room that still holds it, and if there is none a bin is opened.
Which size it gets is settled for all sizes together: for each size that holds the piece
the pieces still to come, less those that earlier bins were opened for, are laid into it
(the longest that fits first, from a histogram of lengths), and the size of least cost for
each token that it would hold is opened. Those pieces are then spoken for. At the end each bin is cut down to the
least permitted length that holds its contents.

A sequence of c tokens costs c + c^2 / ``attention`` + ``overhead``: the work that grows with
tokens, that which grows with pairs of tokens, and a fixed part. Long sequences pay more
for each token, short ones more overhead and padding, so that every size has its use:
pieces that must have a long one open it, others fill its room, and what then is left goes
to the sizes that are cheapest a token. As a greedy choice can lose against a plain
one, a shard is also packed with each single size as the one that is opened wherever it
is long enough, and the packing of least total cost (of the final lengths)
stands: never dearer than best-fit with any one size, downsized.

Documents longer than the largest length are cut into full pieces of it and a rest, so all
text is packed.

Documents are spread over shards by a hash of their key and, for rows that are repeated,
of the copy's number; shards hold about ``shard_docs`` rows and are packed apart, so
lengths are all that is shuffled. One shard has one part-filled bin or so of its own: the
capacity that sharding costs is in the README.

Defined cases: null texts and texts of no tokens have no piece and are left out; a null
doc_id is carried through; repeated rows are packed each and told apart by ``copy`` (0, 1,
... for rows alike in id and text); ties in length go by doc_id (null first), text hash,
copy and piece; extra columns are ignored, under any names; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain, saved, small_side

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Of a sequence's cost: the length at which attention costs as much as all the rest, and
#: what any sequence costs besides, in tokens.
ATTENTION, OVERHEAD = 24_576, 64
SHARD_DOCS = 50_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 1_000_000
#: Copies of one row that a task numbers.
COPIES = 100_000
#: Where a byte-level BPE never joins: before one space between two non-spaces.
SAFE = re.compile(r"(?<=\S)(?= \S)")


class Tokens:
    """Counts the byte-level BPE tokens of whole texts. A text is cut where no token can
    cross, and counts of the parts are remembered."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def _parts(self, text: str) -> tuple[list[str], list[int]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts, counts = SAFE.split(text), []
        for part in parts:
            k = memo.get(part)
            if k is None:
                k = len(self.bpe.encode_ordinary(part))
                if len(part) < 64:
                    memo[part] = k
            counts.append(k)
        return parts, counts

    def __call__(self, text: str) -> int:
        return sum(self._parts(text)[1])

    def cuts(self, text: str, length: int) -> tuple[int, list[int]]:
        """The token count, and the character at which each piece of ``length`` tokens
        begins: of a token that ends inside a character, the character's start."""
        parts, counts = self._parts(text)
        total = sum(counts)
        begins, char, token, wanted = [0], 0, 0, length
        for part, n in zip(parts, counts):
            if token + n > wanted:
                sizes = [len(self.bpe.decode_single_token_bytes(t)) for t in self.bpe.encode_ordinary(part)]
                ends, raw = np.cumsum([0, *sizes]), part.encode("utf-8", "surrogatepass")
                while wanted < token + n:
                    begins.append(char + len(raw[: ends[wanted - token]].decode("utf-8", "ignore")))
                    wanted += length
            token += n
            char += len(part)
        return total, begins


COUNTED = "absent boolean, doc_id bigint, mark bigint, n_tokens bigint, begins array<int>"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = max(CAPACITIES)) -> DataFrame:
    """A row for each row with a token: absent (whether the id is null), doc_id (then 0),
    mark (a text hash), n_tokens, and where pieces of ``length`` tokens begin, in characters.
    The vocabulary is read by the driver and sent to the tasks."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Tokens(raw.value)
        for batch in batches:
            got = [count.cuts(x, length) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([n for n, _ in got], pa.int64()), pa.array([b for _, b in got], pa.list_(pa.int32()))],
                ["absent", "doc_id", "mark", "n_tokens", "begins"],
            )

    rows, (i, t) = plain(docs, id_col, text)
    own = F.col(i).cast("bigint")
    some = rows.where(F.length(t) > 0).select(own.isNull().alias("absent"), F.coalesce(own, F.lit(0)).alias("doc_id"), F.xxhash64(t).alias("mark"), F.col(t).alias("text"))
    return some.mapInArrow(run, COUNTED).where("n_tokens > 0")


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + OVERHEAD


class Supply:
    """Lengths that no open bin has been promised: a histogram, longest first."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.left = Counter(lengths)
        self.sizes = sorted(self.left)

    def take(self, n: int, times: int = 1) -> None:
        self.left[n] -= times
        if self.left[n] <= 0:
            del self.left[n]
            self.sizes.pop(bisect_left(self.sizes, n))

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, times): the longest that fits, again and again."""
        out, at = [], len(self.sizes)
        while (at := bisect_right(self.sizes, room, 0, at)) and self.sizes[0] <= room:
            n = self.sizes[at - 1]
            times = min(self.left[n], room // n)
            out.append((n, times))
            room -= n * times
            at -= 1
        return out


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost, opened: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each of ``lengths``, given in falling order and none above the
    largest capacity, and each bin's final capacity. With ``opened`` bins are opened at that
    size, or at the least that holds the piece, instead of the one of least cost."""
    caps = sorted(capacities)
    price = [cost(c) for c in caps]
    supply = Supply(lengths) if opened is None else None
    rooms: list[int] = []  # rooms of which there are open bins, rising
    at: dict[int, list[int]] = {}
    promised: Counter[int] = Counter()
    bins, offsets, used = [], [], []
    for n in lengths:
        if supply is not None:
            if promised[n]:
                promised[n] -= 1
            else:
                supply.take(n)
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
        else:
            if supply is None:
                room = next(c for c in caps if c >= max(n, min(opened, caps[-1])))
            else:
                best = None
                for c in caps[bisect_left(caps, n) :]:
                    fill = supply.fill(c - n)
                    held = n + sum(x * times for x, times in fill)
                    each = price[bisect_left(caps, held)] / held
                    if best is None or each < best[0]:
                        best = (each, c, fill)
                _, room, fill = best
                for x, times in fill:
                    supply.take(x, times)
                    promised[x] += times
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room:
            if room not in at:
                at[room] = []
                insort(rooms, room)
            at[room].append(b)
    return bins, offsets, [caps[bisect_left(caps, u)] for u in used]


def pack_shard(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """The :func:`best_fit` of least total cost: the joint choice of sizes, or one size."""
    tried = [best_fit(lengths, capacities, cost, c) for c in (None, *sorted(capacities, reverse=True))]
    return min(tried, key=lambda x: sum(map(cost, x[2])))


PLACED = "absent boolean, doc_id bigint, mark bigint, copy bigint, piece int, start_token bigint, n_tokens int, shard int, bin int, bin_offset int, capacity int"


def pack_lengths(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(absent, doc_id, mark, n_tokens) -> the same with copy, piece, start_token, n_tokens,
    shard, bin, bin_offset, capacity for each piece; (shard, bin) names a sequence."""
    # rows alike are counted, so that no task holds them all, and numbered
    alike = saved(lengths.groupBy("absent", "doc_id", "mark", "n_tokens").agg(F.count("*").alias("times")), "lengths")
    rows = alike.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-rows // shard_docs))
    top = max(capacities)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long")))
    each = alike.withColumn("block", blocks)
    if not alike.where(F.col("times") > COPIES).isEmpty():
        each = each.repartition("absent", "doc_id", "mark", "block")
    each = each.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, "times") - 1)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n_tokens"].to_numpy()
        pieces = -(-n // top)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(top, n[row] - piece * top)
        key = {c: pdf[c].to_numpy()[row] for c in ("absent", "doc_id", "mark", "copy")}
        order = np.lexsort((piece, key["copy"], key["mark"], key["doc_id"], ~key["absent"], -length))
        piece, length = piece[order], length[order]
        bins, offsets, caps = pack_shard(length.tolist(), capacities, cost)
        return pd.DataFrame({
            **{c: v[order] for c, v in key.items()}, "piece": piece, "start_token": piece * top, "n_tokens": length,
            "shard": pdf["shard"].iloc[0], "bin": bins, "bin_offset": offsets, "capacity": np.array(caps, dtype=np.int64)[bins],
        })

    shard = F.pmod(F.xxhash64("absent", "doc_id", "mark", "copy"), F.lit(shards)).cast("int")
    return each.select("absent", "doc_id", "mark", "n_tokens", "copy", shard.alias("shard")).groupBy("shard").applyInPandas(pack, PLACED)


RESULT = ("copy", "piece", "start_token", "n_tokens", "shard", "bin", "bin_offset", "capacity")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, copy, piece, start_token, n_tokens, shard, bin, bin_offset, capacity): where
    every piece of every document goes."""
    counts = token_counts(docs, id_col, text, vocabulary, max(capacities)).drop("begins")
    return pack_lengths(counts, capacities, cost, shard_docs).select(F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id"), *RESULT)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """:func:`pack` with each piece's text. A row's pieces, put together, are its text."""
    counts = saved(token_counts(docs, id_col, text, vocabulary, max(capacities)), "counts")
    places = pack_lengths(counts.drop("begins"), capacities, cost, shard_docs)
    long = small_side(counts.where(F.size("begins") > 1).select(F.col("absent").alias("b_absent"), F.col("doc_id").alias("b_id"), F.col("mark").alias("b_mark"), "begins").distinct(), "begins")
    cut = (F.col("absent") == F.col("b_absent")) & (F.col("doc_id") == F.col("b_id")) & (F.col("mark") == F.col("b_mark"))
    begin, end = F.coalesce(F.get("begins", F.col("piece")), F.lit(0)), F.get("begins", F.col("piece") + 1)
    places = places.join(long, cut, "left").select(*places.columns, begin.alias("p_begin"), end.alias("p_end"))
    rows, (i, t) = plain(docs, id_col, text)
    own = F.col(i).cast("bigint")
    keyed = rows.where(F.length(t) > 0).select(own.isNull().alias("absent"), F.coalesce(own, F.lit(0)).alias("doc_id"), F.xxhash64(t).alias("mark"), F.col(t).alias("text"))
    # one of the rows alike; the same partitioning serves the join
    texts = keyed.groupBy("absent", "doc_id", "mark").agg(F.first("text").alias("text"))
    key = ["absent", "doc_id", "mark"]
    many = counts.groupBy(*key).agg(F.count("*").alias("times")).where(F.col("times") > COPIES)
    many = small_side(many.select(*[F.col(c).alias(f"m_{c}") for c in key], "times"), "many")
    if not many.isEmpty():  # a row of very many copies is joined in as many parts
        alike = (F.col("absent") == F.col("m_absent")) & (F.col("doc_id") == F.col("m_doc_id")) & (F.col("mark") == F.col("m_mark"))
        blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.coalesce("times", F.lit(1)) - 1) / COPIES))
        texts = texts.join(many, alike, "left").select(*key, "text", F.explode(blocks).alias("block"))
        places = places.withColumn("block", F.floor(F.col("copy") / COPIES))
        key = [*key, "block"]
    part = F.when(F.col("p_begin").eqNullSafe(0) & F.col("p_end").isNull(), F.col("text")).otherwise(F.substr(F.col("text"), F.col("p_begin") + 1, F.coalesce(F.col("p_end"), F.length("text")) - F.col("p_begin")))
    return places.join(texts, key).select(F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id"), *RESULT, part.alias("text"))
