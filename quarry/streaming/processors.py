"""Record processors: a document in, one out; null drops the record. A document is a map of
its fields to variants, so that a chain parses JSON once and writes it once; the processors
here are built-in functions throughout."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PluginError
from quarry.functions.analysis import groups_of, iso_time, let

Processor = Callable[[Column], Column]

DOCUMENT = "map<string,variant>"
TIME_FIELDS = ("@timestamp", "timestamp", "time", "ts", "date")
LEADING_WORDS = 4
FORMATS = ("%d/%b/%Y:%H:%M:%S %z", "%Y-%m-%d %H:%M:%S,%f", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S")
YEARLESS = "%b %d %H:%M:%S"


def keeps(step: Processor) -> Processor:
    """Marks a processor that drops no record, so that none are looked for."""
    step.keeps = True
    return step


def seed(message: Column) -> Column:
    return F.create_map(F.lit("message"), message.cast("variant"))


def text_of(doc: Column, field: str) -> Column:
    """A field that is a string, else null."""
    value = F.try_element_at(doc, F.lit(field))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def extended(doc: Column, fields: Column) -> Column:
    """``doc`` with the entries of the map ``fields`` in place of its own."""
    return let(F.struct(doc.alias("d"), fields.alias("f")), lambda x: F.map_concat(F.map_filter(x["d"], lambda k, v: ~F.map_contains_key(x["f"], k)), x["f"]))


def json_line(doc: Column) -> Column:
    """The message itself where it is a JSON object (one that names a field twice isn't)."""
    return let(text_of(doc, "message"), lambda m: F.when(F.schema_of_variant(F.try_parse_json(m)).startswith("OBJECT"), F.from_json(m, DOCUMENT)).otherwise(doc))


def rows(function: Callable[[dict[str, Any]], dict[str, Any] | None]) -> Processor:
    """A processor from a Python function of one document, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            got = function(json.loads(text)) if text is not None else None
            return None if got is None else json.dumps(got, ensure_ascii=False)

        return docs.map(one, na_action=None)

    return lambda doc: F.from_json(run(F.to_json(doc)), DOCUMENT)


def regex_extract(pattern: str) -> Processor:
    """The named groups of the first match in the message as fields; a group that takes no
    part in the match, or matches no character, gives none. The pattern is in the syntax
    that Python and Java share, with Python's names of groups."""
    names = re.compile(pattern).groupindex
    java = re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{names[m[1]]})", re.sub(r"\(\?P<\w+>", "(", pattern))

    def extract(doc: Column) -> Column:
        return let(text_of(doc, "message"), lambda m: added(doc, m)) if names else doc

    def added(doc: Column, message: Column) -> Column:
        found = F.array(*[F.struct(F.lit(n).alias("key"), F.regexp_extract(message, java, k).alias("value")) for n, k in names.items()])
        entries = F.transform(F.filter(found, lambda x: x["value"] != ""), lambda x: F.struct(x["key"].alias("key"), x["value"].cast("variant").alias("value")))
        return F.when(message.rlike(java), extended(doc, F.map_from_entries(entries))).otherwise(doc)

    return keeps(lambda doc: let(doc, extract))


def normalized(at: datetime) -> str:
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return at.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def parse_time(value: Any, year: int | None = None) -> str | None:
    """Epoch seconds or milliseconds, ISO-8601, common log formats, RFC 2822; as ISO with
    milliseconds in UTC."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    text = value.strip() if isinstance(value, str) else ""
    if not isinstance(value, str) or re.fullmatch(r"-*\d{9,14}(\..*)?", text):
        try:
            n = float(value)
            return normalized(datetime.fromtimestamp(n / 1000 if abs(n) >= 1e12 else n, UTC))
        except (ValueError, OverflowError, OSError):
            if not isinstance(value, str):
                return None
    if not text:
        return None
    try:
        return normalized(datetime.fromisoformat(text))
    except ValueError:
        pass
    for form in FORMATS:
        try:
            return normalized(datetime.strptime(text, form))
        except ValueError:
            pass
    this_year = year or datetime.now(UTC).year
    try:
        return normalized(datetime.strptime(f"{this_year} {text}", f"%Y {YEARLESS}"))
    except ValueError:
        pass
    try:
        return normalized(parsedate_to_datetime(text))
    except (TypeError, ValueError, IndexError):
        return None


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY, _CLOCK = r"(\d{1,2})", r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
#: Shapes besides epochs and ISO-8601: a pattern, and which groups are year, month, day,
#: hour, minute, second, fraction and zone.
_SHAPES = (
    (rf"^{_DAY}/([A-Za-z]{{3}})/(\d{{4}}):{_CLOCK}\s+(Z|[+-]\d\d:?\d\d)$", (3, 2, 1, 4, 5, 6, None, 7)),
    (rf"^(\d{{4}})-(\d{{1,2}})-{_DAY}\s+{_CLOCK}(?:,(\d{{1,6}}))?$", (1, 2, 3, 4, 5, 6, 7, None)),
    (rf"^(\d{{4}})/(\d{{1,2}})/{_DAY}\s+{_CLOCK}$", (1, 2, 3, 4, 5, 6, None, None)),
    (rf"^([A-Za-z]{{3}})\s+{_DAY}\s+{_CLOCK}$", (None, 1, 2, 3, 4, 5, None, None)),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_DAY}\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{4}})\s+(\d{{1,2}}):(\d\d)(?::(\d\d))?(?:\s+([+-]\d{{4}}|[A-Z]{{1,5}}))?$", (3, 2, 1, 4, 5, 6, None, 7)),
)
_ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


#: What any shape begins with.
_BEGINS = r"^(?:-?\d|[A-Za-z]{3,9},?\s+\d)"


def _shaped(groups: tuple, year: int | None) -> Callable[[Column], Column]:
    def at(found: Column) -> Column:
        def part(k: int | None) -> Column | None:
            return None if k is None else F.get(found, F.lit(k - 1))

        y, mo, d, h, mi, s, frac, zone = map(part, groups)
        y = y if y is not None else F.lit(str(year)) if year else F.date_format(F.current_timestamp(), "yyyy")
        place = F.call_function("locate", F.lower(mo), F.lit(_MONTHS))
        named = mo.rlike("^[A-Za-z]")
        month = F.when(named & (F.pmod(place, F.lit(3)) == 1), ((place + 2) / 3).cast("int").cast("string")).when(~named, mo)
        two = lambda c: F.lpad(c, 2, "0")
        offset = F.lit("Z")
        if zone is not None:
            known = F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv])
            offset = F.when(zone.rlike(r"^[+-]"), F.regexp_replace(zone, r"^([+-]\d\d):?(\d\d)$", "$1:$2")).otherwise(F.coalesce(F.try_element_at(known, zone), F.lit("Z")))
        second = F.when(s != "", two(s)).otherwise("00")
        fraction = F.when(frac != "", F.concat(F.lit("."), frac)).otherwise("") if frac is not None else F.lit("")
        return F.concat(y, F.lit("-"), two(month), F.lit("-"), two(d), F.lit("T"), two(h), F.lit(":"), two(mi), F.lit(":"), second, fraction, offset).try_cast("timestamp")

    return at


def _time(text: Column, year: int | None) -> Column:
    """:func:`parse_time` of a string, as a timestamp; ISO week dates aren't read."""
    out = F.when(text.rlike(r"^-?\d{9,14}(?:\..*)?$"), _epoch(text.try_cast("double"))).when(text.rlike(r"^\d{4}-?\d\d-?\d\d"), iso_time(text))
    for pattern, groups in _SHAPES:
        read = let(groups_of(text, pattern, max(k for k in groups if k)), _shaped(groups, year))
        out = F.coalesce(out, F.when(text.rlike(pattern), read))
    return F.when(text.rlike(_BEGINS), out)


def _epoch(n: Column) -> Column:
    seconds = let(n, lambda v: F.when(F.abs(v) >= 1e12, v / 1000).otherwise(v))
    # years 1 to 9999
    return let(seconds, lambda s: F.when(s.between(-62135596800, 253402300799), F.timestamp_micros(F.rint(s * 1e6).cast("bigint"))))


def timestamp(fields: tuple[str, ...] = TIME_FIELDS, year: int | None = None) -> Processor:
    """``@timestamp`` from the first field that holds a time, else from the message's start."""

    def stamp(doc: Column) -> Column:
        values = [F.try_element_at(doc, F.lit(f)) for f in fields]
        number = [F.when(F.schema_of_variant(v).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")) for v in values]
        words = F.slice(F.split(F.trim(text_of(doc, "message")), r"\s+", LEADING_WORDS + 1), 1, LEADING_WORDS)
        none = F.lit(None).cast("timestamp")

        def head(w: Column, k: Column) -> Column:
            return let(F.regexp_replace(F.array_join(F.slice(w, F.lit(1), k), " "), r"[:,;]+$", ""), lambda t: _time(t, year))

        # a head is put together only where no time was found before
        heads = let(words, lambda w: F.aggregate(F.sequence(F.lit(1), F.size(w)), none, lambda a, k: F.coalesce(a, head(w, k))))
        given = F.array(*[F.struct(n.alias("n"), F.trim(text_of(doc, f)).alias("t")) for f, n in zip(fields, number)])
        given = F.filter(given, lambda x: x["n"].isNotNull() | x["t"].isNotNull())
        at = F.coalesce(F.aggregate(given, none, lambda a, x: F.coalesce(a, _epoch(x["n"]), _time(x["t"], year))), heads)
        text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return let(text, lambda t: F.when(t.isNotNull(), extended(doc, F.create_map(F.lit("@timestamp"), t.cast("variant")))).otherwise(doc))

    return keeps(lambda doc: let(doc, stamp))


PROCESSORS: dict[str, Processor] = {"json_line": json_line, "timestamp": timestamp()}


def resolve(names: list[str], regex: str | None = None) -> list[Processor]:
    known = PROCESSORS | ({"regex_extract": regex_extract(regex)} if regex else {"regex_extract": lambda doc: doc})
    missing = [n for n in names if n not in known]
    if missing:
        raise PluginError(f"there is no processor {missing[0]!r}; there are {', '.join(sorted(known))}")
    return [known[n] for n in names]


def process(records: DataFrame, chain: list[Processor], doc_id: Column | None = None) -> DataFrame:
    """(doc_id, source) of ``records`` (message, ...) after the chain."""
    out = records.select((doc_id if doc_id is not None else F.lit(None).cast("string")).alias("doc_id"), seed(F.col("message")).alias("document"))
    for step in chain:
        out = out.withColumn("document", step(F.col("document")))
        if not getattr(step, "keeps", False):  # the optimizer works a step out again in such a filter
            out = out.where("document is not null")
    return out.select("doc_id", F.to_json("document").alias("source"))
