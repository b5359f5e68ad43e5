"""Dates in sixteen written forms: parsed in a fixed order, shifted and printed alike.

Forms beyond the list are not dates here: libraries that guess fill missing parts from
the clock, which no rerun repeats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_D, _M, _Y = r"(?<d>3[01]|[12]\d|0?[1-9])", r"(?<m>1[0-2]|0?[1-9])", r"(?<y>\d{4})"
_SHORT = r"(?<y>\d{2})"
_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_LONG = f"(?<n>{'|'.join(_NAMES)})"
_ABBR = f"(?<n>{'|'.join(n[:3] for n in _NAMES)})"
_S = r"\s+"

# The forms, the first that fits wins; each with how it is printed.
FORMS = [
    (f"{_Y}-{_M}-{_D}", "yyyy-MM-dd"),
    (f"{_D}/{_M}/{_Y}", "dd/MM/yyyy"),
    (f"{_M}/{_D}/{_Y}", "MM/dd/yyyy"),
    (f"{_D}-{_M}-{_Y}", "dd-MM-yyyy"),
    (f"{_Y}/{_M}/{_D}", "yyyy/MM/dd"),
    (rf"{_D}\.{_M}\.{_Y}", "dd.MM.yyyy"),
    (f"{_D}{_S}{_LONG}{_S}{_Y}", "dd MMMM yyyy"),
    (f"{_D}{_S}{_ABBR}{_S}{_Y}", "dd MMM yyyy"),
    (f"{_LONG}{_S}{_D},{_S}{_Y}", "MMMM dd, yyyy"),
    (f"{_ABBR}{_S}{_D},{_S}{_Y}", "MMM dd, yyyy"),
    (f"{_LONG}{_S}{_D}{_S}{_Y}", "MMMM dd yyyy"),
    (f"{_ABBR}{_S}{_D}{_S}{_Y}", "MMM dd yyyy"),
    (f"{_D}{_S}{_LONG},{_S}{_Y}", "dd MMMM, yyyy"),
    (rf"{_Y}-{_M}-{_D}T(?<t>(?:2[0-3]|[01]?\d):[0-5]?\d:(?:6[01]|[0-5]?\d))", "yyyy-MM-dd'T'"),
    (f"{_D}/{_M}/{_SHORT}", "dd/MM/yy"),
    (f"{_M}/{_D}/{_SHORT}", "MM/dd/yy"),
]


def _group(form: str, letter: str) -> int | None:
    """The number of a named group: Spark takes groups by number."""
    named = [form[i + 3] for i in range(len(form)) if form.startswith("(?<", i) and form[i + 3 : i + 5][1:] == ">"]
    return named.index(letter) + 1 if letter in named else None


def parsed(surface: Column) -> Column:
    """struct(date, form number, time text) of the first form that gives a real date, or null."""
    s = F.trim(F.regexp_replace(surface, r"^\s+|\s+$", ""))
    tries = []
    for k, (form, _) in enumerate(FORMS):
        pattern = f"^(?i:{form})$"
        take = lambda letter, form=form, pattern=pattern: F.regexp_extract(s, pattern, _group(form, letter))
        year = take("y")
        if "{2}" in form:  # two digits: 69 to 99 are of the last century
            year = F.concat(F.when(year >= "69", "19").otherwise("20"), year)
        if _group(form, "n"):
            names = F.array(*(F.lit(n[:3]) for n in _NAMES))
            month = F.array_position(names, F.substring(F.lower(take("n")), 1, 3)).cast("string")
        else:
            month = take("m")
        date = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(take("d"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
        clock = F.transform(F.split(take("t"), ":"), lambda x: F.lpad(x, 2, "0")) if _group(form, "t") else None
        time = F.array_join(clock, ":") if clock is not None else F.lit("")
        tries.append(F.when(s.rlike(pattern) & date.isNotNull(), F.struct(date.alias("date"), F.lit(k).alias("form"), time.alias("time"))))
    return F.coalesce(*tries)


def shifted_date(p: Column, days: Column) -> Column:
    """A parsed date moved by days, in its own form; null for null."""
    moved = F.date_add(p["date"], days.cast("int"))
    out = None
    for k, (_, shape) in enumerate(FORMS):
        out = (F.when if out is None else out.when)(p["form"] == k, F.concat(F.date_format(moved, shape), p["time"]))
    return out


def shifted(surface: Column, days: Column) -> Column:
    """The date moved by days; null where there is no date."""
    return shifted_date(parsed(surface), days)


def year_only(surface: Column) -> Column:
    return F.year(parsed(surface)["date"]).cast("string")
