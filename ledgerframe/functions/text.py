"""Text predicates and counts."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All characters that Unicode counts as white space, and the four separators of ASCII, for a character class.
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def is_sha256(x: Column) -> Column:
    """64 hex digits of either case."""
    return F.coalesce(x.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))


def is_lower_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_safe_id(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Za-z0-9._:-]+$"), F.lit(False))


def lexical_tokens(x: Column) -> Column:
    """Number of words and of single marks, by Unicode letters, digits and white space."""
    return F.regexp_count(x, F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]"))


def mentions(x: Column, terms: list[str]) -> Column:
    """Whether any term occurs, in any case."""
    return F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.lower(x).contains(t))


#: ISO-8601: a calendar or week date, any one character, hours and what follows, an offset; groups by name.
_INSTANT = (
    r"^(?:(?<y>\d{4})(?<a>-?)(?<m>\d{2})\k<a>(?<d>\d{2})|(?<wy>\d{4})(?<b>-?)W(?<w>\d{2})(?:\k<b>(?<wd>\d))?)(?s:.)"
    r"(?<h>\d{2})(?:(?<c>:?)(?<mi>\d{2})(?:\k<c>(?<s>\d{2}))?)?(?:[.,](?<f>\d*))?"
    r"(?:Z|(?<o>[+-])(?<oh>\d{2})(?:(?<e>:?)(?<om>\d{2})(?:\k<e>(?<os>\d{2}))?)?(?:[.,](?<of>\d*))?)\z"
)
_GROUPS = ["y", "m", "d", "wy", "w", "wd", "h", "mi", "s", "f", "o", "oh", "om", "os", "of"]
#: A day, and the years 1 to 9999.
_DAY, _FIRST, _LAST = 86_400_000_000, -62_135_596_800_000_000, 253_402_300_800_000_000


def parse_instant(x: Column, utc_only: bool = False) -> Column:
    """Microseconds since 1970 of ISO-8601 text with an offset (or Z only); else null.

    Dates may be basic, extended or by week; times may stop after hours, minutes or
    seconds, a fraction counts to six digits; an offset has the same forms and is less
    than a day.  Blanks are nowhere but between date and time.
    """
    parts = F.split(F.regexp_replace(x, _INSTANT, ",".join(f"${{{g}}}" for g in _GROUPS)), ",", -1)
    shaped = x.rlike(_INSTANT) & (x.endswith("Z") if utc_only else F.lit(True))
    # Through a one-element array, so that the text is matched and split once.
    return F.when(shaped, F.get(F.transform(F.array(parts), _instant), F.lit(0)))


def _instant(parts: Column) -> Column:
    """Microseconds from the parts of a text of the right shape, or null."""
    part = {g: F.get(parts, F.lit(i)) for i, g in enumerate(_GROUPS)}
    number = lambda g, other=0: F.when(part[g] == "", F.lit(other).cast("long")).otherwise(part[g].cast("long"))
    fraction = lambda g: F.rpad(F.substring(part[g], 1, 6), 6, "0").cast("long")
    clock = lambda h, m, s, f: ((number(h) * 60 + number(m)) * 60 + number(s)) * 1_000_000 + fraction(f)
    date = lambda *texts: F.unix_date(F.concat_ws("-", *texts).try_cast("date")).cast("long")
    calendar = F.when(number("y") > 0, date(part["y"], part["m"], part["d"]))

    def week(fourth: Column) -> Column:
        # The fourth of January is always in the first week; day 0 was a Thursday.
        monday = fourth - F.pmod(fourth + 3, F.lit(7)) + (number("w") - 1) * 7
        same_year = F.year(F.date_from_unix_date((monday + 3).cast("int"))) == number("wy")
        return F.when((number("wy") > 0) & number("w").between(1, 53) & same_year & number("wd", 1).between(1, 7), monday + number("wd", 1) - 1)

    day = F.when(part["y"] != "", calendar).otherwise(F.get(F.transform(F.array(date(part["wy"], F.lit("01"), F.lit("04"))), week), F.lit(0)))
    offset = clock("oh", "om", "os", "of")
    signed = F.when(part["o"] == "-", -offset).otherwise(offset)
    valid = (number("h") < 24) & (number("mi") < 60) & (number("s") < 60) & (offset < _DAY)
    inside = lambda at: F.when((at >= _FIRST) & (at < _LAST), at)
    return F.when(valid, F.get(F.transform(F.array(day * _DAY + clock("h", "mi", "s", "f") - signed), inside), F.lit(0)))


def parse_now(text: str) -> int:
    """Microseconds since 1970 of a caller's clock; an offset is needed."""
    at = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    if at.tzinfo is None:
        raise ValueError("timestamp_timezone_missing")
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def now_micros() -> int:
    """The driver's clock, for a caller that has none: read once and passed on as a literal."""
    return time.time_ns() // 1000
