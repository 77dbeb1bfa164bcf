"""Lexical spaces of the recognised XSD datatypes, and canonical forms, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import XSD

_ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_YEAR = r"-?([1-9][0-9]{3,}|0[0-9]{3})"
_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
_DAYTIME = r"([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?"

#: Lexical patterns (whole text) by datatype.
PATTERNS = {
    "string": r"(?s).*",
    "anyURI": r'[^\x00-\x20<>"{}|\\^`]*',
    "normalizedString": r"[^\t\n\r]*",
    "token": r"([^\t\n\r ]+( [^\t\n\r ]+)*)?",
    "boolean": r"true|false|1|0",
    "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "float": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([Ee][+-]?[0-9]+)?|[+-]?INF|NaN",
    "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([Ee][+-]?[0-9]+)?|[+-]?INF|NaN",
    "dateTime": rf"{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}",
    "date": rf"{_YEAR}-{_MONTH}-{_DAY}{_ZONE}",
    "time": rf"{_TIME}{_ZONE}",
    "gYearMonth": rf"{_YEAR}-{_MONTH}{_ZONE}",
    "gYear": rf"{_YEAR}{_ZONE}",
    "gMonthDay": rf"--{_MONTH}-{_DAY}{_ZONE}",
    "gMonth": rf"--{_MONTH}{_ZONE}",
    "gDay": rf"---{_DAY}{_ZONE}",
    "duration": rf"-?P(?=.)([0-9]+Y)?([0-9]+M)?{_DAYTIME}",
    "yearMonthDuration": r"-?P(?=[0-9])([0-9]+Y)?([0-9]+M)?",
    "dayTimeDuration": rf"-?P(?=.){_DAYTIME}",
    "hexBinary": r"([0-9A-Fa-f]{2})*",
}
#: The integer family with its bounds (null: unbounded).
INTEGERS = {
    "integer": (None, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
}
_DATED = {"dateTime", "date", "gMonthDay"}


def canonical_integer(lex: Column) -> Column:
    """Sign and digits without leading zeros or a plus; null if it is no integer."""
    digits = F.regexp_replace(F.regexp_replace(lex, "^[+-]", ""), "^0+(?=[0-9])", "")
    return F.when(lex.rlike("^[+-]?[0-9]+$"), F.when(lex.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits))


def canonical_decimal(lex: Column) -> Column:
    """At least one digit on either side of the point; null if it is no decimal."""
    whole = F.regexp_replace(F.regexp_extract(lex, r"^[+-]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(lex, r"\.([0-9]*)$", 1), "0+$", "")
    plain = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part))
    return F.when(lex.rlike(f"^({PATTERNS['decimal']})$"), F.when(lex.startswith("-") & (plain != "0.0"), F.concat(F.lit("-"), plain)).otherwise(plain))


def _at_most(a: Column, bound: int) -> Column:
    """Whether a canonical integer text is at most ``bound``, however long it is: by sign, length, then digits."""
    neg, digits = a.startswith("-"), F.regexp_replace(a, "^-", "")
    other = str(abs(bound))
    less = (F.length(digits) < len(other)) | ((F.length(digits) == len(other)) & (digits <= other))
    more = (F.length(digits) > len(other)) | ((F.length(digits) == len(other)) & (digits >= other))
    return (neg | less) if bound >= 0 else (neg & more)


def _day_exists(lex: Column) -> Column:
    """Whether the day is one of its month, for texts in the shape of dates."""
    shape = r"^(?:-?[0-9]{4,}|-)-([0-9]{2})-([0-9]{2})"
    month, day = F.regexp_extract(lex, shape, 1), F.regexp_extract(lex, shape, 2).try_cast("int")
    year = F.right(F.regexp_extract(lex, "^-?([0-9]{4,})-", 1), F.lit(4)).try_cast("int")
    leap = F.coalesce((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), F.lit(True))
    return day <= F.when(month.isin("04", "06", "09", "11"), 30).when(month == "02", F.when(leap, 29).otherwise(28)).otherwise(31)


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def valid(datatype: str, lex: Column) -> Column:
    """Whether ``lex`` is in the lexical space; null for a datatype that isn't recognised."""
    name = datatype.removeprefix(XSD)
    if name in INTEGERS:
        low, high = INTEGERS[name]
        a = canonical_integer(lex)
        tests = [a.isNotNull()]
        if high is not None:
            tests.append(_at_most(a, high))
        if low is not None:
            tests.append(~_at_most(a, low - 1))
        return reduce(lambda x, y: x & y, tests)
    if name not in PATTERNS:
        return F.lit(None).cast("boolean")
    shape = lex.rlike(_whole(PATTERNS[name]))
    return shape & _day_exists(lex) if name in _DATED else shape


def validate(datatype: Column, lex: Column) -> Column:
    """The same for a datatype in a column: patterns and bounds are looked up, so the expression stays small."""
    table = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(XSD + k), v)]), datatype)
    pattern = table({k: F.lit(_whole(v)) for k, v in PATTERNS.items()} | {k: F.lit(_whole("[+-]?[0-9]+")) for k in INTEGERS})
    bound = lambda k: table({n: F.lit(str(b[k])).cast("decimal(38,0)") for n, b in INTEGERS.items() if b[k] is not None})
    low, high, number = bound(0), bound(1), canonical_integer(lex).try_cast("decimal(38,0)")
    negative = lex.startswith("-")  # of a number too long to hold, the sign decides
    fits = F.when(number.isNull(), F.when(negative, low.isNull()).otherwise(high.isNull())).otherwise(F.coalesce(number >= low, F.lit(True)) & F.coalesce(number <= high, F.lit(True)))
    integer, dated = datatype.isin(*[XSD + k for k in INTEGERS]), datatype.isin(*[XSD + k for k in sorted(_DATED)])
    return F.rlike(lex, pattern) & F.when(integer, fits).when(dated, _day_exists(lex)).otherwise(True)


def canonical(datatype: Column, lex: Column) -> Column:
    """The canonical form where one is defined (integers, decimal, boolean, hexBinary), else the text itself."""
    name = F.replace(datatype, F.lit(XSD), F.lit(""))
    return (
        F.when(name.isin(*INTEGERS), canonical_integer(lex))
        .when(name == "decimal", canonical_decimal(lex))
        .when(name == "boolean", F.when(lex.isin("1", "true"), "true").when(lex.isin("0", "false"), "false"))
        .when(name == "hexBinary", F.upper(lex))
        .otherwise(lex)
    )
