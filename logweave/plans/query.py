"""The query language: field terms `key op value`, AND-ed, and a free-text expression over the whole line."""

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

OPERATORS = (">=", "<=", "!=", ">", "<", "=", ":")
FLOAT = r"^\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?|(?i:inf|infinity|nan))\s*$"


class QueryError(ValueError):
    """A query that cannot be understood; the text says why."""


@dataclass(frozen=True)
class Term:
    key: str
    op: str
    value: str

    def render(self) -> str:
        return f'{self.key}{self.op}"{self.value}"' if re.search(r"\s", self.value) else f"{self.key}{self.op}{self.value}"


@dataclass(frozen=True)
class Query:
    terms: tuple = ()
    text: str = ""


def tokens(query: str):
    """Words of a query; a quote at a word's start or behind an operator holds white space together."""
    out, at = [], 0
    part = re.compile(r"""(?:(?<![^\s])|(?<=[:=<>!]))(?:"([^"]*)"|'([^']*)')|(\S)""", re.S)
    word = None
    while at < len(query):
        if query[at].isspace():
            if word is not None:
                out.append(word)
            word, at = None, at + 1
            continue
        m = part.match(query, at)
        word = (word or "") + (m[3] if m[3] is not None else m[1] if m[1] is not None else m[2])
        at = m.end()
    return out + ([word] if word is not None else [])


def parse_query(query: str, known_keys=X.KNOWN_KEYS) -> Query:
    """Terms for known keys, the rest as free text; a query without terms stays as it was written."""
    known = {k.lower() for k in known_keys}
    terms, rest = [], []
    for word in tokens(query or "") if re.search("[:=<>]", query or "") else ():
        m = re.match(r"([A-Za-z_][A-Za-z0-9_.\-]*)(>=|<=|!=|>|<|=|:)(.*)$", word, re.S)
        if not m or m[1].lower() not in known:
            rest.append(word)
        elif not m[3] and m[2] != ":":
            raise QueryError(f"{m[1]}{m[2]} needs a value")
        else:
            terms.append(Term(m[1], m[2], m[3]))
    return Query(tuple(terms), " ".join(rest)) if terms else Query((), query or "")


def validate(text: str, regex: bool = True) -> None:
    """Raises QueryError where a pattern is no regular expression."""
    try:
        re.compile(text if regex else re.escape(text))
    except re.error as e:
        raise QueryError(f"invalid expression: {e}") from e


def field_value(key: str) -> Column:
    """A field by exact name, else by name without case (the least such name); source and node are columns."""
    if key in ("source", "node"):
        return F.col(key)
    folded = F.map_filter("fields", lambda k, v: F.lower(k) == key.lower())
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.try_element_at(folded, F.array_min(F.map_keys(folded))))


def as_number(text: Column) -> Column:
    plain = F.lower(F.trim(F.replace(text, F.lit("_"), F.lit(""))))
    plain = F.regexp_replace(plain, "^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(text.rlike(FLOAT), F.when(plain.rlike("nan"), F.lit(float("nan"))).otherwise(plain.try_cast("double")))


def term_test(term: Term) -> Column:
    """True, false, or null where the entry has no such field."""
    v, value = field_value(term.key), term.value
    if term.op == ":":
        hit = F.contains(v, F.lit(value)) if T.smart_case(value) else F.contains(F.lower(v), F.lit(value.lower()))
        return F.when(v.isNull(), None).otherwise(hit)
    if term.op in ("=", "!="):
        return (v == value) if term.op == "=" else (v != value)
    compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}[term.op]
    by_text = compare(v, F.lit(value))
    try:
        number = float(value)
    except ValueError:
        return by_text
    n = as_number(v)
    by_number = F.lit(False) if number != number else ~F.isnan(n) & compare(n, F.lit(number))
    return F.when(v.isNull(), None).when(n.isNotNull(), by_number).otherwise(by_text)


def terms_outcome(terms) -> Column:
    """"hit", "miss" or "missing-field": any false term misses, whatever the others lack."""
    tests = [term_test(t) for t in terms]
    if not tests:
        return F.lit("hit")
    false = F.greatest(*[F.coalesce(~t, F.lit(False)) for t in tests], F.lit(False))
    missing = F.greatest(*[t.isNull() for t in tests], F.lit(False))
    return F.when(false, "miss").when(missing, "missing-field").otherwise("hit")


@dataclass(frozen=True)
class Window:
    """A closed span of time, either end open; wall clocks are compared unless both sides carry an offset."""

    start: datetime | None = None
    end: datetime | None = None

    def holds(self) -> Column:
        def side(bound, op):
            if bound is None:
                return F.lit(True)
            wall = F.lit(str(bound.replace(tzinfo=None))).cast("timestamp_ntz")
            plain = op(F.col("ts"), wall)
            if bound.tzinfo is None:
                return plain
            shift = F.col("ts_offset_s") - int(bound.utcoffset().total_seconds())
            return F.when(F.col("ts_offset_s").isNull(), plain).otherwise(op(F.timestamp_add("SECOND", -shift, F.col("ts")), wall))

        return F.col("ts").isNotNull() & side(self.start, Column.__ge__) & side(self.end, Column.__le__)


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def relative_window(text: str, now: datetime) -> Window | None:
    """"15m", "6h", "7d", "2w" or "30s" before now; "all" is no window."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text.lower())
    if not m:
        if text.strip().lower() in ("", "all"):
            return None
        raise QueryError(f"not a time window: {text}")
    return Window(now - timedelta(seconds=int(m[1]) * UNITS[m[2]]), None)


def moment(text: str, now: datetime) -> datetime | None:
    """An ISO time, or an offset from now: "-2h", "+30m"; without a sign it lies in the past."""
    text = text.strip()
    if not text:
        return None
    if m := re.fullmatch(r"([+-]?)(\d+)([smhdw])", text.lower()):
        step = timedelta(seconds=int(m[2]) * UNITS[m[3]])
        return now + step if m[1] == "+" else now - step
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise QueryError(f"not a time: {text}") from e


def absolute_window(start: str, end: str, now: datetime) -> Window:
    a, b = moment(start, now), moment(end, now)
    if a and b and a.replace(tzinfo=None) > b.replace(tzinfo=None):
        a, b = b, a
    return Window(a, b)


@dataclass(frozen=True)
class Filter:
    """What to show: a query, a severity bucket and a window of time."""

    query: str = ""
    severity: str = "all"
    window: Window | None = None
    case_sensitive: bool | None = None
    regex: bool = True
    invert: bool = False
    known_keys: frozenset = field(default=X.KNOWN_KEYS)

    def parsed(self) -> Query:
        out = parse_query(self.query, self.known_keys)
        if out.text:
            validate(out.text, self.regex)
        return out
