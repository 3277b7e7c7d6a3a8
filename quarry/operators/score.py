"""A query over an index frame as one DataFrame of matches with BM25 scores.

Where an index has stored postings, each text leaf reads its terms' postings and is joined
to the documents, and the statistics (live documents, average clamped lengths) are known.
Otherwise one aggregate over the frame gives the statistics that scored leaves need, and
terms and phrases are plain columns over all documents' terms, or of a table that
:meth:`Scorer.tally` writes as it reads the texts, once. Either way the statistics enter the
plan as literals. Prefixes and ranges score the sum of BM25 over every term they
match, whose frequencies come from a grouped table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import UnsupportedFeatureError
from quarry.functions.analysis import let
from quarry.operators.frame import IndexFrame, c
from quarry.plans.ast import Bool, Exists, MatchAll, Phrase, Prefix, Query, Range, Term

K1, B = 1.2, 0.75
#: The number of live documents among the statistics; no field is called this.
LIVE = ("live",)
Leaf = Term | Phrase | Prefix | Range


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) if n > 0 and df > 0 else 0.0


def bm25(weight: Column | float, tf: Column, dl: Column, avgdl: float) -> Column:
    ratio = dl / F.lit(avgdl) if avgdl > 0 else F.lit(0.0)
    return F.lit(weight) * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * ratio))


def phrase_tf(index: IndexFrame, node: Phrase) -> Column:
    """Starts of the phrase in a document: of its first term, such that the nearest next
    terms take at most ``slop`` extra positions."""
    terms, n = c(f"{node.field}__terms"), len(node.terms)
    gaps = f"{node.field}__pos" in index.columns
    if node.slop == 0 and not gaps:
        # every window of n terms, side by side; the terms are evaluated once
        def windows(t: Column) -> Column:
            beside = F.arrays_zip(*[F.slice(t, k + 1, F.size(t)).alias(f"t{k}") for k in range(n)])
            return F.size(F.filter(beside, lambda x: x == F.struct(*[F.lit(w).alias(f"t{k}") for k, w in enumerate(node.terms)])))

        return F.coalesce(let(terms, windows), F.lit(0))
    # what isn't a word of the phrase goes first, so that the rest looks at a few terms
    words = list(dict.fromkeys(node.terms))
    if gaps:
        few = F.filter(F.arrays_zip(terms.alias("term"), c(f"{node.field}__pos").alias("pos")), lambda x: x["term"].isin(words))
    else:
        few = F.filter(F.transform(terms, lambda x, i: F.when(x.isin(words), F.struct(x.alias("term"), i.alias("pos")))), lambda x: x.isNotNull())

    def starts(placed: Column) -> Column:
        def place(term: str) -> Column:
            return F.transform(F.filter(placed, lambda x: x["term"] == F.lit(term)), lambda x: x["pos"])

        return beside([place(t) for t in node.terms], node.slop)

    return F.coalesce(let(few, starts), F.lit(0))


def _within(node: Range) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        out = F.lit(True)
        for bound, strict, way in ((node.gte, node.gt, 1), (node.lte, node.lt, -1)):
            if bound is not None:
                out = out & (x >= F.lit(bound) if way > 0 else x <= F.lit(bound))
            elif strict is not None:
                out = out & (x > F.lit(strict) if way > 0 else x < F.lit(strict))
        return out

    return test


def _any(tests: list[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return lambda x: reduce(Column.__or__, [test(x) for test in tests])


def _less(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def beside(places: list[Column], slop: int) -> Column:
    """Starts of a phrase whose terms stand at ``places``, a column of positions each."""
    if slop == 0:
        starts = places[0]
        for k, at in enumerate(places[1:], 1):
            starts = F.array_intersect(starts, F.transform(at, _less(k)))
        return F.size(starts)

    def spread(start: Column, k: int, here: Column) -> Column:
        if k == len(places):
            return here - start - (len(places) - 1) <= slop
        return let(F.array_min(F.filter(places[k], lambda q: q > here)), lambda q: spread(start, k + 1, q))

    return F.size(F.filter(places[0], lambda p: F.coalesce(spread(p, 1, p), F.lit(False))))


class Scorer:
    def __init__(self, index: IndexFrame) -> None:
        self.index = index
        self.stats: dict = {}
        #: Columns of the text leaves that postings answer.
        self.bound: dict[Query, str] = {}
        if index.live is not None:
            n = index.live["n"]
            self.stats = {LIVE: n} | {f: x / n if n else 0 for f, x in index.live["sums"].items()}

    # matching

    def _test(self, node: Prefix | Range) -> Callable[[Column], Column]:
        return (lambda x: x.startswith(node.value)) if isinstance(node, Prefix) else _within(node)

    def match(self, node: Query) -> Column:
        if isinstance(node, MatchAll):
            return F.lit(True)
        if isinstance(node, Bool):
            gate = [self.match(q) for q in (*node.must, *node.filter)]
            out = F.lit(True)
            if gate:
                for g in gate:
                    out = out & g
            elif node.should:
                out = F.lit(False)
                for q in node.should:
                    out = out | self.match(q)
            for q in node.must_not:
                # two-valued logic below NOT; elsewhere a null drops out as it stands
                out = out & ~F.coalesce(self.match(q), F.lit(False))
            return out
        f = self.index.held(node.field)
        if f is None or (isinstance(node, Phrase) and not node.terms):
            return F.lit(False)
        text, column = f.type == "text", c(node.field)
        if isinstance(node, Exists):
            return c(f"{node.field}__dl") > 0 if text else column.isNotNull()
        if isinstance(node, Phrase) and f.index_options != "positions":
            raise UnsupportedFeatureError(f"field {node.field!r} keeps no positions, so it has no phrases")
        if self._key(node) in self.bound:
            return F.col(self.bound[self._key(node)]).isNotNull()
        terms = c(f"{node.field}__terms")
        if isinstance(node, Term):
            return F.array_contains(terms, node.value) if text else F.array_contains(column, F.lit(node.value)) if self.index.multi else column == F.lit(node.value)
        if isinstance(node, Phrase):
            return F.array_contains(terms, node.terms[0]) if len(node.terms) == 1 else phrase_tf(self.index, node) > 0
        test = self._test(node)
        if text:
            return F.exists(terms, test)
        if not self.index.multi:
            return column.isNotNull() & test(column)
        return F.exists(column, test)

    # postings

    @staticmethod
    def _key(node: Query) -> Query:
        return replace(node, boost=1.0) if isinstance(node, Leaf) else node

    def _text_leaves(self, node: Query) -> list[Leaf]:
        if isinstance(node, Bool):
            return [x for q in (*node.must, *node.filter, *node.should, *node.must_not) for x in self._text_leaves(q)]
        f = self.index.held(node.field) if isinstance(node, Leaf) else None
        return [self._key(node)] if f is not None and f.type == "text" and not (isinstance(node, Phrase) and not node.terms) else []

    def _posted(self, leaf: Leaf, scored: bool) -> DataFrame:
        """(doc_ord, x) of a text leaf: its frequency, or what an expanded leaf scores."""
        held = self.index.postings.where(F.col("field") == leaf.field)
        if isinstance(leaf, Term) or (isinstance(leaf, Phrase) and len(leaf.terms) == 1):
            word = leaf.value if isinstance(leaf, Term) else leaf.terms[0]
            return held.where(F.col("term") == word).select("doc_ord", F.col("tf").cast("double").alias("x"))
        if isinstance(leaf, Phrase):
            words = list(dict.fromkeys(leaf.terms))
            places = {w: f"p{k}" for k, w in enumerate(words)}
            rows = held.where(F.col("term").isin(words)).groupBy("doc_ord").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(n) for w, n in places.items()])
            rows = rows.where(" and ".join(f"{n} is not null" for n in places.values()))
            return rows.select("doc_ord", beside([F.col(places[w]) for w in leaf.terms], leaf.slop).cast("double").alias("x")).where("x > 0")
        rows = held.where(self._test(leaf)(F.col("term")))
        if not scored:
            return rows.select("doc_ord").distinct().withColumn("x", F.lit(0.0))
        df = rows.groupBy(F.col("term").alias("__term")).agg(F.count(F.lit(1)).alias("__df"))
        score = bm25(self._weight(leaf), F.col("tf").cast("double"), F.col("dl"), self.stats[leaf.field])
        return rows.join(df, F.col("term") == F.col("__term")).groupBy("doc_ord").agg(F.sum(score).alias("x"))

    def _bind(self, node: Query, scored: bool) -> DataFrame:
        """The frame with a column for each text leaf that postings answer."""
        df, counted = self.index.df, set(self._leaves(node)) if scored else set()
        if self.index.postings is None:
            return df
        self.bound = {}
        for leaf in dict.fromkeys(self._text_leaves(node)):
            self.match(leaf)  # refuses what the field can't answer
            name = self.bound[leaf] = f"__t{len(self.bound)}"
            df = df.join(self._posted(leaf, leaf in counted).withColumnRenamed("x", name), "doc_ord", "left")
        return df

    # frequencies without postings

    def _tf(self, leaf: Term | Phrase) -> Column:
        """How often a word or phrase is among a document's terms; null where it isn't."""
        terms, words = c(f"{leaf.field}__terms"), (leaf.value,) if isinstance(leaf, Term) else leaf.terms
        tf = F.size(terms) - F.size(F.array_remove(terms, words[0])) if len(words) == 1 else F.nullif(phrase_tf(self.index, leaf), F.lit(0))
        held = F.array_contains(terms, words[0])
        for w in dict.fromkeys(words[1:]):
            held = held & F.array_contains(terms, w)
        return F.when(held, tf)

    def tally(self, node: Query, save: Callable[[DataFrame], DataFrame]) -> None:
        """Puts a table in place of a frame without postings, for ``node`` alone: exact fields,
        lengths and each text leaf's frequencies. Texts are thus analyzed once, as ``save``
        writes it, and statistics, matches and scores read numbers. Of the terms only those
        that a prefix covers stay."""
        texts, covered, tfs = self.index.mapping.text_fields(), {}, {}
        for leaf in dict.fromkeys(self._text_leaves(node)):
            self.match(leaf)  # refuses what the field can't answer
            if isinstance(leaf, Term | Phrase):
                tfs[leaf] = self._tf(leaf).alias(f"__t{len(tfs)}")
            else:
                covered.setdefault(leaf.field, []).append(self._test(leaf))
        gone = {f"{n}__{x}" for n in texts for x in ("terms", "pos", "raw")}
        terms = [F.filter(c(f"{n}__terms"), _any(tests)).alias(f"{n}__terms") for n, tests in covered.items()]
        self.index = replace(self.index, df=save(self.index.df.select(*[c(x) for x in self.index.df.columns if x not in gone], *terms, *tfs.values())))
        self.bound = {leaf: f"__t{k}" for k, leaf in enumerate(tfs)}

    # statistics

    def _leaves(self, node: Query) -> list[Leaf]:
        """Leaves whose score counts, without their boost."""
        if isinstance(node, Bool):
            return [x for q in (*node.must, *node.should) for x in self._leaves(q)]
        scored = isinstance(node, Leaf) and self.index.held(node.field) is not None and not (isinstance(node, Phrase) and not node.terms)
        return [replace(node, boost=1.0)] if scored else []

    def gather(self, node: Query) -> None:
        """The statistics that ``node``'s scores need: one job over the frame for those that
        aren't known, one over the postings of the terms, one for each stored phrase."""
        leaves = list(dict.fromkeys(self._leaves(node)))
        wanted = {LIVE: F.count(F.lit(1))} if leaves else {}
        for f in dict.fromkeys(x.field for x in leaves):
            wanted[f] = F.avg(F.coalesce(self.index.length(f), F.lit(0)))
        simple = [x for x in leaves if isinstance(x, Term | Phrase) and x not in self.stats]
        stored = [x for x in simple if self.index.postings is not None and self.index.mapping.fields[x.field].type == "text"]
        for x in simple:
            if x not in stored:
                wanted[x] = F.count_if(self.match(x))
        wanted = {k: v for k, v in wanted.items() if k not in self.stats}
        if wanted:
            row = self.index.df.agg(*[v.alias(f"s{i}") for i, v in enumerate(wanted.values())]).first()
            self.stats |= {k: x or 0 for k, x in zip(wanted, row)}
        terms = {(x.field, x.value if isinstance(x, Term) else x.terms[0]): x for x in stored if isinstance(x, Term) or len(x.terms) == 1}
        if terms:
            test = F.lit(False)
            for f, w in terms:
                test = test | ((F.col("field") == f) & (F.col("term") == w))
            found = {(r["field"], r["term"]): r["count"] for r in self.index.postings.where(test).groupBy("field", "term").count().collect()}
            for x in stored:
                if isinstance(x, Term) or len(x.terms) == 1:
                    self.stats[x] = found.get((x.field, x.value if isinstance(x, Term) else x.terms[0]), 0)
        for x in stored:
            if x not in self.stats:
                self.stats[x] = self._posted(x, False).count()

    # scores

    def _simple(self, node: Term | Phrase) -> Column:
        weight = node.boost * idf(self.stats[LIVE], self.stats[replace(node, boost=1.0)])
        text = self.index.mapping.fields[node.field].type == "text"
        if self._key(node) in self.bound:
            tf = F.col(self.bound[self._key(node)])
        elif isinstance(node, Phrase) and len(node.terms) > 1:
            tf = phrase_tf(self.index, node)
        elif text or self.index.multi:
            value = node.value if isinstance(node, Term) else node.terms[0]
            held = c(f"{node.field}__terms") if text else c(node.field)
            tf = F.size(F.filter(held, lambda x: x == F.lit(value)))
        else:
            tf = F.lit(1)
        return bm25(weight, tf.cast("double"), self.index.length(node.field), self.stats[node.field])

    def _weight(self, node: Leaf) -> Column:
        n = F.lit(self.stats[LIVE])
        return F.lit(node.boost) * F.log(1 + (n - F.col("__df") + 0.5) / (F.col("__df") + 0.5))

    def _expanded(self, node: Prefix | Range, matched: DataFrame, name: str) -> DataFrame:
        """``matched`` with the summed score of all terms that ``node`` covers, as ``name``."""
        text, avgdl, test = self.index.mapping.fields[node.field].type == "text", self.stats[node.field], self._test(node)
        if not text and not self.index.multi:  # one value a document: its frequency decides
            value = c(node.field)
            counts = self.index.df.where(value.isNotNull() & test(value)).groupBy(value.alias("__value")).agg(F.count(F.lit(1)).alias("__df"))
            scored = counts.select("__value", bm25(self._weight(node), F.lit(1.0), F.lit(1), avgdl).alias(name))
            return matched.join(scored, c(node.field) == F.col("__value"), "left").drop("__value")
        held = c(f"{node.field}__terms") if text else c(node.field)
        each = self.index.df.select("doc_ord", self.index.length(node.field).alias("__dl"), F.explode(F.filter(held, test)).alias("__term"))
        tfs = each.groupBy("doc_ord", "__dl", "__term").agg(F.count(F.lit(1)).cast("double").alias("__tf"))
        dfs = tfs.groupBy("__term").agg(F.count(F.lit(1)).alias("__df"))
        scored = tfs.join(dfs, "__term").groupBy("doc_ord").agg(F.sum(bm25(self._weight(node), F.col("__tf"), F.col("__dl"), avgdl)).alias(name))
        return matched.join(scored, "doc_ord", "left")

    def _score(self, node: Query, expanded: dict[Query, str]) -> Column:
        if isinstance(node, MatchAll | Exists):
            return F.lit(1.0)
        if isinstance(node, Bool):
            parts = [self._score(q, expanded) for q in node.must]
            parts += [F.when(self.match(q), self._score(q, expanded)).otherwise(0.0) for q in node.should]
            if not parts and not node.filter:
                return F.lit(1.0)
            return sum(parts[1:], parts[0]) if parts else F.lit(0.0)
        if self.index.held(node.field) is None or (isinstance(node, Phrase) and not node.terms):
            return F.lit(0.0)
        if node in expanded:
            return F.coalesce(F.col(expanded[node]), F.lit(0.0))
        if isinstance(node, Prefix | Range) and self._key(node) in self.bound:
            return F.coalesce(F.lit(node.boost) * F.col(self.bound[self._key(node)]), F.lit(0.0))
        return self._simple(node)

    def matches(self, node: Query, scored: bool = True) -> DataFrame:
        """The frame's matching rows with ``score`` (null unless ``scored``)."""
        if scored:
            self.gather(node)
        found = self._bind(node, scored)
        found = found.where(self.match(node))
        if not scored:
            return found.withColumn("score", F.lit(None).cast("double")).drop(*self.bound.values())
        expanded: dict[Query, str] = {}
        for leaf in _scored_leaves(node):
            if isinstance(leaf, Prefix | Range) and self.index.held(leaf.field) is not None and leaf not in expanded and self._key(leaf) not in self.bound:
                expanded[leaf] = f"__x{len(expanded)}"
                found = self._expanded(leaf, found, expanded[leaf])
        return found.withColumn("score", self._score(node, expanded).cast("double")).drop(*expanded.values(), *self.bound.values())


def _scored_leaves(node: Query) -> list[Query]:
    return [x for q in (*node.must, *node.should) for x in _scored_leaves(q)] if isinstance(node, Bool) else [node]


def matches(index: IndexFrame, node: Query, scored: bool = True) -> DataFrame:
    return Scorer(index).matches(node, scored)
