"""Dates as sites write them, against a given as_of; Korean time throughout.

A date is (event_ts, event_date): the time if it's known, else only the day, else both null. Times are
timestamp_ntz on the Korean clock, so no session time zone changes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = 9  # Korea's offset from UTC, all year


def _n(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _at(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Time of a day; null where no such time exists."""
    fits = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    seconds = hour * 3600 + minute * 60 + second
    return F.when(fits, F.date_format(date, "yyyy-MM-dd").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def _day(y: Column, m: Column, d: Column) -> Column:
    """A date; null where no such day exists."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return text.try_cast("date")


@dataclass(frozen=True)
class Spelling:
    """A way to write a date: fields with their numbers of digits, marks of which one stands between two, and a clock.

    word: what stands for a day; dot: one may come after the fields; clock: may or must follow; seconds: the clock may have
    them; open: anything may come after.
    """

    fields: tuple[tuple[str, str], ...] = ()
    marks: str = ""
    word: str = ""
    dot: bool = False
    must: bool = False
    seconds: bool = True
    open: bool = False

    def pattern(self) -> str:
        clock = r"([0-9]{1,2}):([0-9]{2})" + (r"(?::([0-9]{2}))?" if self.seconds else "()")
        day = self.word + f"[{self.marks}]".join(f"([0-9]{{{digits}}})" for _, digits in self.fields) + (r"\.?" if self.dot else "")
        return "^" + (clock if self.must else rf"{day}(?:\s+{clock})?") + ("" if self.open else "$")

    def group(self, name: str) -> int | None:
        """Group of a field or of hour, minute, second."""
        names = [*(f for f, _ in self.fields), "hour", "minute", "second"]
        return names.index(name) + 1 if name in names else None


#: Fixed values of the sites' formats: spellings, in the order in which they're tried; units of "... ago" in seconds (a day
#: has no time); words for now; bars before a count of views, which isn't part of the date.
SPELLINGS = (
    Spelling(word="어제"),
    Spelling(must=True),
    Spelling((("month", "1,2"), ("day", "1,2")), "./-", dot=True, seconds=False),
    Spelling((("year", "2"), ("month", "2"), ("day", "2")), "./-"),
    Spelling((("year", "4"), ("month", "1,2"), ("day", "1,2")), "./-", dot=True, open=True),
)
AGO = {"초": 0, "분": 60, "시간": 3600, "일": 86_400}
NOW = ("방금", "방금 전")
BARS, VIEWS = "lL│|ㅣ", "조회"
ISO = Spelling((("year", "4"), ("month", "2"), ("day", "2")), "-").pattern()[:-1].replace(r"(?:\s+([0-9]{1,2})", "T([0-9]{2})").removesuffix(")?") + r"(?:\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _date(event_ts: Column, event_date: Column) -> Column:
    """A known time has its own day."""
    return F.struct(event_ts.cast("timestamp_ntz").alias("event_ts"), F.coalesce(event_ts.cast("date"), event_date.cast("date")).alias("event_date"))


def _written(t: Column, how: Spelling, as_of: Column) -> Column:
    """The date of a text in one spelling."""
    pattern, today, none = how.pattern(), as_of.cast("date"), F.lit(None)
    get = lambda name: _n(t, pattern, how.group(name))
    if how.word:
        day = F.date_sub(today, 1)
    elif how.must:
        day = today
    elif how.group("year"):
        day = _day(get("year") + (2000 if how.fields[0][1] == "2" else 0), get("month"), get("day"))
    else:  # this year's, or last year's if it's more than a day ahead
        this, last = (_day(F.year(as_of) - back, get("month"), get("day")) for back in (0, 1))
        day = F.when(this.cast("timestamp_ntz") > as_of + F.make_dt_interval(F.lit(1)), last).otherwise(this)
    ts = _at(day, get("hour"), get("minute"), F.coalesce(get("second"), F.lit(0)))
    if how.must:  # yesterday's if it's more than ten minutes ahead
        ts = F.when(ts > as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10)), ts - F.make_dt_interval(F.lit(1))).otherwise(ts)
    timed = F.regexp_extract(t, pattern, how.group("hour")) != ""
    return _date(F.when(timed, ts), F.when(~timed, day).otherwise(none))


def _iso(t: Column) -> Column:
    """Time of an ISO 8601 text on the Korean clock; without a zone it's Korean."""
    zone = F.regexp_extract(t, ISO, 7)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    offset = F.when(zone == "", HOURS * 60).when(zone == "Z", 0).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    at = _at(_day(*(_n(t, ISO, i) for i in (1, 2, 3))), _n(t, ISO, 4), _n(t, ISO, 5), F.coalesce(_n(t, ISO, 6), F.lit(0)))
    return at + F.make_dt_interval(F.lit(0), F.lit(0), HOURS * 60 - offset, F.lit(0))


def parse_date(text: Column, as_of: Column) -> Column:
    """struct<event_ts timestamp_ntz, event_date date> of ten spellings; both null for others and for days that don't exist.

    as_of is a timestamp_ntz. A time alone is today's, or yesterday's if over ten minutes ahead; a day without a year
    is this year's, or last year's if over a day ahead.
    """
    plain = F.trim(F.split(F.trim(F.coalesce(text, F.lit(""))), rf"[{BARS}]\s*{VIEWS}", 2)[0])
    # a lambda's variable: the text is cut once a row, and the generated code stays within a method's size
    return F.transform(F.array(plain), lambda t: _parsed(t, as_of))[0]


def _parsed(t: Column, as_of: Column) -> Column:
    ago = rf"^([0-9]+)\s*({'|'.join(AGO)})\s*전"
    unit = F.regexp_extract(t, ago, 2)
    seconds = _n(t, ago, 1) * F.element_at(F.create_map(*[F.lit(x) for pair in AGO.items() for x in pair]), unit)
    since = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    none = F.lit(None)
    out = F.when(t.rlike(ISO), _date(_iso(t), none)).when(t.isin(*NOW), _date(as_of, none))
    out = out.when(t.rlike(ago), _date(F.when(unit != "일", since), since))
    for how in SPELLINGS:
        out = out.when(t.rlike(how.pattern()), _written(t, how, as_of))
    return out.otherwise(_date(none, none))


def api_date(written: Column, target: Column) -> Column:
    """Date of an API post: UTC time on the Korean clock, only the day if that is midnight sharp; before 2000 or null the target day."""
    local = written.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(HOURS))
    good = F.coalesce(F.year(written) >= 2000, F.lit(False))
    sharp = F.date_trunc("DAY", local) == local
    return F.struct(
        F.when(good & ~sharp, local).cast("timestamp_ntz").alias("event_ts"),
        F.when(good, local.cast("date")).otherwise(target.try_cast("date")).alias("event_date"),
    )


def is_valid_date(text: Column) -> Column:
    """Whether a text is a real day as YYYY-MM-DD and nothing else."""
    return F.coalesce(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & text.try_cast("date").isNotNull(), F.lit(False))


def age_days(event_ts: Column, event_date: Column, as_of: Column) -> Column:
    """Days from a date to as_of, 0 at least; unknown dates are 0."""
    since = F.coalesce(event_ts, event_date.cast("timestamp_ntz"))
    return F.greatest(F.lit(0.0), F.coalesce(F.timestamp_diff("MICROSECOND", since, as_of) / F.lit(86_400_000_000.0), F.lit(0.0)))


def date_window(as_of: Column, merge_until_hour: int = 2) -> Column:
    """Days whose lists count: today, and yesterday before two."""
    today = as_of.cast("date")
    return F.when(F.hour(as_of) < merge_until_hour, F.array(F.date_sub(today, 1), today)).otherwise(F.array(today))


def hours_to_cover(as_of: Column) -> Column:
    """Least of 3, 6, 12 and 24 hours that reaches back to midnight."""
    need = F.hour(as_of) + (F.minute(as_of) + F.second(as_of) / 60) / 60
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, (3, 6, 12, 24))), lambda h: h >= need), F.lit(1)), F.lit(24))
