"""Version ranges of two ecosystems as half-open intervals of number tuples. What is not understood never excludes a version.

A version beyond an interval is one that isn't in [low, high); "greater than x" begins at the next tuple after x, so one containment test
serves every operator. A prerelease counts by its numbers with npm; with PEP 440 only final releases are judged.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Numbers = tuple[int, ...]
Interval = tuple[Numbers, Numbers | None]  # None: without end

#: Ranges that allow everything.
ANY = ("", "*", "x", "X", "latest")
NPM_PART = re.compile(r"(\^|~>?|>=|<=|>|<|=)?v?=?((?:\d+|[xX*])(?:\.(?:\d+|[xX*])){0,2})(?:[-+][0-9A-Za-z.+-]*)?")
PEP_PART = re.compile(r"(~=|===?|!=|<=|>=|<|>)\s*v?(\d+(?:\.\d+)*)(\.\*)?")


def above(numbers: Numbers, place: int) -> Numbers:
    """The least tuple beyond all that agree with numbers up to `place`."""
    return (*numbers[:place], numbers[place] + 1, *(0 for _ in numbers[place + 1 :]))


def contains(interval: Interval, version: Numbers) -> bool:
    low, high = interval
    return low <= version and (high is None or version < high)


def npm_interval(part: str) -> Interval | None:
    """Interval of one comparator; None if it isn't understood."""
    if part in ANY:
        return (0, 0, 0), None
    found = NPM_PART.fullmatch(part)
    if not found:
        return None
    given: list[int] = []
    for x in found[2].split("."):
        if not x.isdigit():
            break
        given.append(int(x))
    floor, last = (*given, *(0,) * (3 - len(given))), len(given) - 1
    if last < 0:
        return (0, 0, 0), None
    match found[1] or "=":
        case "^":
            return floor, above(floor, next((i for i, n in enumerate(given) if n), last))
        case "~" | "~>":
            return floor, above(floor, min(1, last))
        case "=":
            return floor, above(floor, last)
        case ">=":
            return floor, None
        case ">":
            return above(floor, last), None
        case "<":
            return (0, 0, 0), floor
        case _:
            return (0, 0, 0), above(floor, last)


def npm_excludes(declared: str, version: str) -> bool:
    own = re.fullmatch(r"[v=]?(\d+)\.(\d+)\.(\d+)(?:[-+][0-9A-Za-z.+-]*)?", version.strip())
    if not own:
        return False
    numbers = tuple(map(int, own.groups()))
    allowed = False
    for choice in declared.split("||"):
        span = re.fullmatch(r"\s*(\S+)\s+-\s+(\S+)\s*", choice)
        parts = [f">={span[1]}", f"<={span[2]}"] if span else re.sub(r"([\^~<>=])\s+(?=[\dvxX*])", r"\1", choice).split() or [""]
        intervals = [npm_interval(p) for p in parts]
        if None in intervals:
            return False
        allowed = allowed or all(contains(i, numbers) for i in intervals)
    return not allowed


def pypi_excludes(declared: str, version: str) -> bool:
    if not re.fullmatch(r"\d+(?:\.\d+)*", version.strip()):
        return False
    own = tuple(map(int, version.strip().split(".")))
    excluded = False
    for part in filter(None, map(str.strip, declared.split(","))):
        found = PEP_PART.fullmatch(part)
        if not found or found[3] and found[1] not in ("==", "!=") or found[1] == "~=" and "." not in found[2]:
            return False
        given = tuple(map(int, found[2].split(".")))
        width, last = max(len(own), len(given)), len(given) - 1
        floor, mine = (*given, *(0,) * (width - len(given))), (*own, *(0,) * (width - len(own)))
        start, after, wide = (0,) * width, above(floor, width - 1), above(floor, last)
        interval = {"==": (floor, wide if found[3] else after), "!=": (floor, wide if found[3] else after), "===": (floor, after), ">=": (floor, None), ">": (after, None), "<": (start, floor), "<=": (start, after), "~=": (floor, above(floor, max(0, last - 1)))}[found[1]]
        excluded = excluded or contains(interval, mine) == (found[1] == "!=")
    return excluded


@F.pandas_udf(T.BooleanType())
def range_excludes(ecosystem: pd.Series, declared: pd.Series, version: pd.Series) -> pd.Series:
    """Whether a declared range rules a version out; a null range never does."""
    rules = {"npm": npm_excludes, "pypi": pypi_excludes}
    return pd.Series([bool(d is not None and v is not None and str(e).lower() in rules and rules[str(e).lower()](d, v)) for e, d, v in zip(ecosystem, declared, version, strict=True)])


def within(version: Column, low: list[int], high: list[int]) -> Column:
    """Whether an array of numbers lies in [low, high)."""
    bound = lambda x: F.array(*[F.lit(i).cast("long") for i in x])
    return (version >= bound(low)) & (version < bound(high))
