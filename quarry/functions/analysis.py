"""Tokenizers, filters and analyzers as Column builders, with a plain-Python twin each for
query text. Filters that drop a token leave a gap in the positions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import ConfigurationError

TOKEN_CHARS = 255
SEPARATOR = "\x01"
#: Every character that Python's str.isspace holds for.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
STOP_EN = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Tokenizer:
    columns: Callable[[Column], Column]
    python: Callable[[str], list[str]]


@dataclass(frozen=True)
class Filter:
    """``change`` maps terms (Columns, or str in Python); ``keep`` says which stay."""

    change: Callable[[Column], Column] | None = None
    change_python: Callable[[str], str] | None = None
    keep: Callable[[Column], Column] | None = None
    keep_python: Callable[[str], bool] | None = None
    empties: bool = False  # whether a changed term may be empty; such terms are dropped
    change_all: Callable[[Column], Column] | None = None  # ``change`` of an array of terms, all at once


def _split(java: str, python: str) -> Tokenizer:
    return Tokenizer(
        lambda c: F.transform(F.filter(F.split(c, java), lambda x: x != ""), lambda x: F.substring(x, 1, TOKEN_CHARS)),
        lambda t: [x[:TOKEN_CHARS] for x in re.split(python, t) if x],
    )


def pattern(regex: str) -> Tokenizer:
    """Splits at ``regex``, in the syntax that Java and Python share."""
    return _split(regex, regex)


TOKENIZERS: dict[str, Tokenizer] = {
    "standard": Tokenizer(
        lambda c: F.regexp_extract_all(c, F.lit(rf"([\p{{L}}\p{{N}}]{{1,{TOKEN_CHARS}}})[\p{{L}}\p{{N}}]*"), F.lit(1)),
        lambda t: [x[:TOKEN_CHARS] for x in re.findall(r"[^\W_]+", t)],
    ),
    "whitespace": Tokenizer(_split(rf"{SPACE}+", r"\s+").columns, lambda t: [x[:TOKEN_CHARS] for x in t.split()]),
    "keyword": Tokenizer(lambda c: F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>")), lambda t: [t] if t else []),
    "letters": pattern(r"[^A-Za-z]+"),
    "log": _split(r"[\s\x1c-\x1f\x85\p{Z}=:\[\]]+", r"[\s=:\[\]]+"),
}


def fold(term: str) -> str:
    return unicodedata.normalize("NFKD", term).encode("ascii", "ignore").decode() or term


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one, and what to; those that fold to several."""
    single, several = {}, {}
    for k in range(128, 0x110000):
        if not 0xD800 <= k < 0xE000 and len(x := unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()):
            (single if len(x) == 1 else several)[chr(k)] = x
    return "".join(single), "".join(single.values()), several


def _ranges(chars: Iterable[str]) -> str:
    """A class of ``chars``, in ranges: it is tried character by character."""
    out: list[list[int]] = []
    for k in sorted(map(ord, chars)):
        if out and out[-1][1] == k - 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


@cache
def _fold_parts() -> tuple[str, str, Column, str]:
    one, to, several = _foldings()
    return one, to, F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in several.items())), F.lit("\x02"), F.lit("\x01")), _ranges(several)


def fold_column(term: Column) -> Column:
    """:func:`fold` by built-ins: characters that fold to one are translated, the few that
    fold to several are looked up, and what isn't ASCII then goes."""
    one, to, several, any_of = _fold_parts()
    spelled = F.array_join(F.transform(F.split(term, ""), lambda x: F.coalesce(F.try_element_at(several, x), x)), "")
    ascii_ = F.regexp_replace(F.translate(F.when(term.rlike(any_of), spelled).otherwise(term), one, to), r"[^\x00-\x7f]", "")
    return F.when(ascii_ != "", ascii_).otherwise(term)


def fold_terms(terms: Column) -> Column:
    """:func:`fold_column` of an array's terms, as one text: a call a document, not a token.
    Terms that hold the separator are folded one by one."""
    one, to, several, any_of = _fold_parts()

    def folded(x: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(x["text"], ""), lambda y: F.coalesce(F.try_element_at(several, y), y)), "")
        text = F.when(F.regexp_replace(x["text"], r"[\x00-\x7f]+", "").rlike(any_of), spelled).otherwise(x["text"])
        parts = F.split(F.regexp_replace(F.translate(text, one, to), r"[^\x00-\x7f]+", ""), SEPARATOR)
        return let(F.struct(x["terms"].alias("terms"), parts.alias("parts")), whole)

    def whole(x: Column) -> Column:
        # a term that nothing is left of stays as it was
        filled = F.when(F.array_contains(x["parts"], ""), F.transform(x["parts"], lambda y, i: F.when(y == "", F.get(x["terms"], i)).otherwise(y))).otherwise(x["parts"])
        return F.when(F.size(x["parts"]) == F.size(x["terms"]), filled).otherwise(F.transform(x["terms"], fold_column))

    def joined(x: Column) -> Column:
        return F.when(F.octet_length(x["text"]) > F.length(x["text"]), let(x, folded)).otherwise(x["terms"])

    return let(terms, lambda t: let(F.struct(t.alias("terms"), F.array_join(t, SEPARATOR).alias("text")), joined))


def stop(words: frozenset[str] = STOP_EN) -> Filter:
    listed = sorted({w.lower() for w in words})
    return Filter(keep=lambda x: ~F.lower(x).isin(listed), keep_python=lambda x: x.lower() not in listed)


def length(least: int = 0, most: int | None = None) -> Filter:
    top = most if most is not None else 1 << 30
    return Filter(keep=lambda x: F.length(x).between(least, top), keep_python=lambda x: least <= len(x) <= top)


def truncate(n: int) -> Filter:
    if n < 1:
        raise ConfigurationError("truncate keeps at least one character")
    return Filter(change=lambda x: F.substring(x, 1, n), change_python=lambda x: x[:n])


LOWERCASE = Filter(change=F.lower, change_python=str.lower)
ASCII_FOLDING = Filter(change=lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), fold_column(x)).otherwise(x), change_python=fold, change_all=fold_terms)
FILTERS: dict[str, Callable[..., Filter]] = {"lowercase": lambda: LOWERCASE, "asciifolding": lambda: ASCII_FOLDING, "stop": stop, "length": length, "truncate": truncate}


def _on_term(keep: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: keep(x["term"])


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Tokenizer
    filters: tuple[Filter, ...] = ()

    @property
    def gaps(self) -> bool:
        return any(f.keep or f.empties for f in self.filters)

    def columns(self, text: Column) -> tuple[Column, Column | None]:
        """(terms, positions); positions are None where they equal the array index."""
        filters, at = self.filters, None
        if self.tokenizer is TOKENIZERS["standard"] and filters[:1] == (LOWERCASE,):
            # a whole text in lower case has the same terms, but for letters that become two
            # or whose neighbours decide
            each = F.transform(self.tokenizer.columns(text), F.lower)
            terms, filters = F.when(text.rlike("[\u0130\u03a3]"), each).otherwise(self.tokenizer.columns(F.lower(text))), filters[1:]
        else:
            terms = self.tokenizer.columns(text)
        for f in filters:
            if f.change is not None:
                terms = f.change_all(terms) if f.change_all is not None else F.transform(terms, f.change)
            else:
                if at is None:
                    at = F.transform(terms, lambda x, i: i)
                both = F.filter(F.arrays_zip(terms.alias("term"), at.alias("pos")), _on_term(f.keep))
                terms, at = F.transform(both, lambda x: x["term"]), F.transform(both, lambda x: x["pos"])
        if any(f.empties for f in self.filters):
            at = F.transform(terms, lambda x, i: i) if at is None else at
            both = F.filter(F.arrays_zip(terms.alias("term"), at.alias("pos")), lambda x: x["term"] != "")
            terms, at = F.transform(both, lambda x: x["term"]), F.transform(both, lambda x: x["pos"])
        return terms, at

    def analyze(self, text: str) -> list[tuple[str, int]]:
        out = [(t, i) for i, t in enumerate(self.tokenizer.python(text))]
        for f in self.filters:
            if f.change_python is not None:
                out = [(f.change_python(t), i) for t, i in out]
            elif f.keep_python is not None:
                out = [(t, i) for t, i in out if f.keep_python(t)]
        return [(t, i) for t, i in out if t]


ANALYZERS: dict[str, Analyzer] = {
    "standard": Analyzer(TOKENIZERS["standard"], (LOWERCASE,)),
    "simple": Analyzer(TOKENIZERS["letters"], (LOWERCASE,)),
    "whitespace": Analyzer(TOKENIZERS["whitespace"]),
    "keyword": Analyzer(TOKENIZERS["keyword"]),
    "stop_en": Analyzer(TOKENIZERS["standard"], (LOWERCASE, stop())),
    "log": Analyzer(TOKENIZERS["log"], (LOWERCASE,)),
}


def analyzer(name: str | None) -> Analyzer:
    try:
        return ANALYZERS[name or "standard"]
    except KeyError:
        raise ConfigurationError(f"unknown analyzer {name!r}") from None


def groups_of(text: Column, form: str, n: int) -> Column:
    """The ``n`` groups of ``form``, which matches ``text`` from ^ to $, in one matching; empty
    where they take no part. They don't hold the separator."""
    return F.split(F.regexp_replace(text, form + r"[\s\S]*", SEPARATOR.join(f"${k}" for k in range(1, n + 1))), SEPARATOR)


def iso_time(text: Column) -> Column:
    """Calendar ISO-8601 times, in basic and extended form; null where it isn't one."""
    form = r"^(\d{4})(-?)(\d\d)\2(\d\d)(?:\D(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d\d(?::?\d\d)?)?)?$"

    def at(groups: Column) -> Column:
        g = lambda n, other: F.coalesce(F.nullif(F.get(groups, F.lit(n - 1)), F.lit("")), F.lit(other))
        zone = F.regexp_replace(F.regexp_replace(g(9, "Z"), r"^([+-]\d\d)$", "$1:00"), r"^([+-]\d\d)(\d\d)$", "$1:$2")
        full = F.concat(g(1, ""), F.lit("-"), g(3, ""), F.lit("-"), g(4, ""), F.lit("T"), g(5, "00"), F.lit(":"), g(6, "00"), F.lit(":"), g(7, "00"), F.lit("."), g(8, "0"), zone)
        return full.try_cast("timestamp")

    return F.when(text.rlike(form), let(groups_of(text, form, 9), at))


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds (half-even) of :func:`iso_time`. Week dates are only read by the
    driver."""
    return millis(iso_time(text))


def millis(at: Column) -> Column:
    return F.bround(F.unix_micros(at) / F.lit(1000).cast("decimal(20,0)"), 0).cast("bigint")


def python_float(x: Column) -> Column:
    """A double as Python's str() writes it, but for the few (subnormals above all) that the
    JVM's own conversion gives a digit more."""
    s = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.split(s, "E")[0], r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    inside = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16)
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(~s.contains("E"), s).when(inside, plain).otherwise(F.concat(mantissa, exponent))
