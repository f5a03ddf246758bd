"""Moments written in many ways to one instant each.

Every written moment is read under all formats that fit it; each reading is an
*interpretation* (format, microseconds, cost). Among them are readings a clock showed
twice or never: they compete like all others, and where one wins the record names no instant.
The choice is made jointly over each source's records in the order they came, by
Viterbi: an interpretation costs what its reading departs from what is known of
the source (``AGAINST``), and a step from one record to the next costs ``SWITCH`` if the order
of day and month changes and up to ``BACK`` if time runs backwards. A record that
shows no order (a month in letters, a year first) carries the order of those before it
on, so a source's habit is learnt from all its records even where nothing is known of it.

The chain of a source is cut into the partitions of one range partitioning by
(source, order), so a source that holds a third of all rows is spread over many
tasks. Minimal costs of paths are a (min, +) matrix product and thus associative:
a first pass reduces each partition's part of a source to a matrix between the
interpretations of its first and of its last record, the driver chains these few
matrices (two a partition at most, for other sources lie in one partition) and fixes the end points, a second
pass traces the best path inside. The result equals Viterbi over the unbroken chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Cost of writing all-numeric dates in another order than the record before.
SWITCH = 1.0
#: Cost of a step back in time of a year or more; shorter steps cost proportionally less.
BACK = 0.5
#: Cost of a reading that contradicts the known habit of the source (its date order).
AGAINST = 3.0
ORDERS = ("DMY", "MDY")
#: Marks a reading that the clock showed twice or never.
NEVER = "never:"

# English month and weekday names, day ordinals.
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
MONTH_WORD = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAY_WORD = r"(?:mon|tues?|wed(?:nes)?|thur?s?|fri|sat(?:ur)?|sun)(?:day)?"
# Zone abbreviations in civil use and the offsets, in minutes, they stand for.
ABBREVIATIONS = {
    "UTC": (0,), "GMT": (0,), "UT": (0,), "Z": (0,),
    "IST": (330, 120, 60), "BST": (60, 360), "WET": (0,), "WEST": (60,), "CET": (60,), "CEST": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "EST": (-300,), "EDT": (-240,), "CST": (-360, 480, -300), "CDT": (-300, -240), "MST": (-420, 480), "MDT": (-360,), "PST": (-480, 480), "PDT": (-420,),
    "AST": (-240, 180), "ADT": (-180,), "NST": (-210,), "NDT": (-150,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
    "SGT": (480,), "HKT": (480,), "MYT": (480,), "JST": (540,), "KST": (540,), "PKT": (300,), "NPT": (345,), "GST": (240,), "WIB": (420,),
    "AEST": (600,), "AEDT": (660,), "ACST": (570,), "ACDT": (630,), "AWST": (480,), "NZST": (720,), "NZDT": (780,), "SAST": (120,), "EAT": (180,), "WAT": (60,), "CAT": (120,),
}

_CLOCK = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?\s?m\b\.?)?"
_ZONE = r"(?:\s*(?P<z>Z|(?:GMT|UTC)?\s?[+-]\d{1,2}(?::?\d{2})?|(?!(?:on|at|am|pm)\b)[A-Z]{2,5}))?"
_NUMERIC = r"(?P<n1>\d{1,2})(?P<sep>[/.\-])(?P<n2>\d{1,2})(?P=sep)(?P<ny>\d{4}|\d{2})"
_WORDY = rf"(?:{DAY_WORD},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+(?P<mon>{MONTH_WORD})\.?,?[\s\-]+(?P<y>\d{{4}}|\d{{2}})"
_WORDY_US = rf"(?:{DAY_WORD},?\s+)?(?P<mon>{MONTH_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})"
_ISO = r"(?P<y>\d{4})(?P<sep>[/.\-])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})"
_JOIN = r"(?:\s*,\s*|\s+at\s+|\s+)"
_DATES = (("iso", _ISO), ("numeric", _NUMERIC), ("wordy", _WORDY), ("wordy_us", _WORDY_US))
#: (format, pattern); a text may fit several.
FORMATS = tuple(
    (name, re.compile(rf"^{pattern}$", re.IGNORECASE))
    for name, pattern in (
        ("compact", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_ZONE}"),
        ("iso", rf"{_ISO}(?:T|{_JOIN}){_CLOCK}{_ZONE}"),
        *((name, rf"{p}{_JOIN}{_CLOCK}{_ZONE}") for name, p in _DATES[1:]),
        *((f"hours_{name}", rf"(?P<h>\d{{2}})(?P<mi>\d{{2}})\s*(?:hrs|hours|h)\.?{_ZONE}(?:\s*,\s*|\s+on\s+|\s+){p}") for name, p in _DATES),
        *((f"clock_{name}", rf"{_CLOCK}{_ZONE}(?:\s*,\s*|\s+on\s+|\s+){p}") for name, p in _DATES),
    )
)
_EPOCH = re.compile(r"^(?:\d{10}|\d{13})$")
_DIGITS = re.compile(r"\d")


def _offset(text: str) -> int | None:
    m = re.match(r"^(?:GMT|UTC)?\s?([+-])(\d{1,2})(?::?(\d{2}))?$", text, re.IGNORECASE)
    if not m:
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return (minutes if m[1] == "+" else -minutes) if int(m[3] or 0) < 60 and minutes <= 14 * 60 + 59 else None


@lru_cache(maxsize=1024)
def _zone(name: str | None):
    from zoneinfo import ZoneInfo

    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _abbreviation(text: str, tz_name: str | None) -> tuple[int, ...]:
    """Offsets in minutes an abbreviation may stand for; the source's own zone settles it."""
    known = ABBREVIATIONS.get(text.upper(), ())
    zone = _zone(tz_name)
    if zone is not None and len(known) != 1:
        own = {t.utcoffset() for t in (datetime(2021, 1, 15, tzinfo=zone), datetime(2021, 7, 15, tzinfo=zone)) if t.tzname() == text.upper()}
        if own:
            return tuple(int(o.total_seconds() // 60) for o in own)
    return known


def _micros(local: datetime, minutes: int) -> int:
    delta = local.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc) - timedelta(minutes=minutes)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _on_clock(local: datetime, tz_name: str | None) -> tuple[int, bool] | None:
    """(instant of a zoneless clock reading, whether it names exactly one); None without a known zone."""
    zone = _zone(tz_name)
    if zone is None:
        return None
    first, second = local.replace(tzinfo=zone).utcoffset(), local.replace(tzinfo=zone, fold=1).utcoffset()
    return _micros(local, 0) - int(first.total_seconds()) * 1_000_000, first == second


def interpretations(text: str | None, tz_name: str | None, date_order: str | None) -> list[tuple[str, int, float]]:
    """(format, instant in microseconds, cost) of every valid reading, in a fixed order; ``NEVER`` leads formats of clock readings that name no one instant."""
    text = " ".join((text or "").split())
    if _EPOCH.match(text):
        return [("epoch", int(text) * (1_000_000 if len(text) == 10 else 1_000), 0.0)]
    if not _DIGITS.search(text):
        return []
    out: dict[tuple[str, int], float] = {}
    for name, pattern in FORMATS:
        if not (m := pattern.match(text)):
            continue
        g = m.groupdict()
        hour, minute, second = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
        micro = int(((g.get("f") or "") + "000000")[:6])
        if ap := g.get("ap"):
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + (12 if ap in "pP" else 0)
        if hour > 23 or minute > 59 or second > 59:
            continue
        if g.get("n1"):
            a, b, year = int(g["n1"]), int(g["n2"]), int(g["ny"])
            year += 2000 if len(g["ny"]) == 2 else 0
            known = date_order if date_order in ORDERS else None
            dates = [(f"{name}_{order}", year, mo, d, AGAINST if known not in (None, order) else 0.0) for order, d, mo in (("DMY", a, b), ("MDY", b, a))]
            if known is not None and a != b and not any(_possible(y, mo, d) for _, y, mo, d, cost in dates if not cost):
                dates = []  # the source's own order makes it an impossible date
        else:
            year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
            dates = [(name, year, int(g["m"]) if g.get("m") else MONTHS[g["mon"][:3].lower()], int(g["d"]), 0.0)]
        for label, year, month, day, cost in dates:
            if not _possible(year, month, day):
                continue
            local = datetime(year, month, day, hour, minute, second, micro)
            zone = (g.get("z") or "").strip()
            if not zone:
                at = _on_clock(local, tz_name)
                found = [at[0]] if at else []
                label = label if not at or at[1] else NEVER + label
            elif (minutes := _offset(zone)) is not None:
                found = [_micros(local, minutes)]
            else:
                found = [_micros(local, x) for x in _abbreviation(zone, tz_name)]
            for us in found:
                out[label, us] = min(cost, out.get((label, us), cost))
    return [(f, us, c) for (f, us), c in out.items()]


def _possible(year: int, month: int, day: int) -> bool:
    try:
        date(year, month, day)
    except ValueError:
        return False
    return True


def states(found: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """The interpretations of one record, each under every order of day and month it leaves open (``|DMY``, ``|MDY``)."""
    return [(f if f[-3:] in ORDERS else f"{f}|{o}", us, c) for f, us, c in found for o in (ORDERS if f[-3:] not in ORDERS else (None,))]


def _step(a: tuple[str, int], b: tuple[str, int]) -> float:
    """Cost of reading one record as ``b`` after reading the one before as ``a``."""
    cost = SWITCH if a[0][-3:] != b[0][-3:] else 0.0
    back = a[1] - b[1]
    return cost + (BACK * min(1.0, back / 31_536_000_000_000) if back > 0 else 0.0)


def _forward(first_costs: list[float], chain: list[list[tuple[str, int, float]]]) -> tuple[list[float], list[list[int]]]:
    """Costs at the last record and, per later record, the best predecessor of each interpretation."""
    costs, back = first_costs, []
    for prev, cur in zip(chain, chain[1:]):
        now, arrow = [], []
        for x in cur:
            best = min(range(len(prev)), key=lambda i: (costs[i] + _step(prev[i], x), i))
            now.append(costs[best] + _step(prev[best], x) + x[2])
            arrow.append(best)
        costs = now
        back.append(arrow)
    return costs, back


def viterbi(chain: list[list[tuple[str, int, float]]], first: int | None = None, last: int | None = None) -> list[int]:
    """The cheapest choice of one interpretation per record; ties go to the earlier interpretation."""
    if not chain:
        return []
    start = [x[2] if first in (None, i) else float("inf") for i, x in enumerate(chain[0])]
    costs, back = _forward(start, chain)
    at = min(range(len(costs)), key=lambda i: (costs[i], i)) if last is None else last
    path = [at]
    for arrow in reversed(back):
        at = arrow[at]
        path.append(at)
    return path[::-1]


PARSED = "source string, record_key string, pid int, fmts array<string>, us array<bigint>, costs array<double>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("source", "record_key", "written", "tz_name", "date_order")}
        keep, found = [], []
        for i, (w, tz, order) in enumerate(zip(cols["written"], cols["tz_name"], cols["date_order"])):
            if x := interpretations(w, tz, order):
                keep.append(i)
                found.append(states(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array([cols["source"][i] for i in keep], pa.string()), pa.array([cols["record_key"][i] for i in keep], pa.string()), pa.array([pid] * len(keep), pa.int32()), pa.array([[y[0] for y in x] for x in found], pa.list_(pa.string())), pa.array([[y[1] for y in x] for x in found], pa.list_(pa.int64())), pa.array([[y[2] for y in x] for x in found], pa.list_(pa.float64()))],
            names=["source", "record_key", "pid", "fmts", "us", "costs"],
        )


def _chains(batches: Iterator[pa.RecordBatch]):
    """(source, pid, keys, chain) of each run of one source in a partition."""
    source, pid, keys, chain, started = None, 0, [], [], False
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("source", "pid", "record_key", "fmts", "us", "costs")))
        for s, p, k, f, u, c in rows:
            if started and s != source:
                yield source, pid, keys, chain
                keys, chain = [], []
            source, pid, started = s, p, True
            keys.append(k)
            chain.append(list(zip(f, u, c)))
    if started:
        yield source, pid, keys, chain


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition, which alone may go on in another one."""
    rows, last = [], None

    def summary(source, pid, chain) -> dict:
        matrix = []
        for i in range(len(chain[0])):
            start = [x[2] if i == j else float("inf") for j, x in enumerate(chain[0])]
            matrix.append(_forward(start, chain)[0])
        return {"source": source, "pid": pid, "fmts0": [x[0] for x in chain[0]], "us0": [x[1] for x in chain[0]], "fmts1": [x[0] for x in chain[-1]], "us1": [x[1] for x in chain[-1]], "matrix": matrix}

    for source, pid, _, chain in _chains(batches):
        if not rows:
            rows.append(summary(source, pid, chain))
        else:
            last = (source, pid, chain)
    if last:
        rows.append(summary(*last))
    schema = pa.schema([("source", pa.string()), ("pid", pa.int32()), ("fmts0", pa.list_(pa.string())), ("us0", pa.list_(pa.int64())), ("fmts1", pa.list_(pa.string())), ("us1", pa.list_(pa.int64())), ("matrix", pa.list_(pa.list_(pa.float64())))])
    yield pa.RecordBatch.from_pylist(rows, schema)


SUMMARY = "source string, pid int, fmts0 array<string>, us0 array<bigint>, fmts1 array<string>, us1 array<bigint>, matrix array<array<double>>"


def _ends(parts: list) -> dict[tuple[str | None, int], tuple[int, int]]:
    """First and last choice of each part, from the parts' matrices in order: Viterbi over the parts."""
    fixed: dict[tuple[str | None, int], tuple[int, int]] = {}
    by_source: dict[str | None, list] = {}
    for p in sorted(parts, key=lambda p: p.pid):
        by_source.setdefault(p.source, []).append(p)
    for source, own in by_source.items():
        costs = [0.0] * len(own[0].us0)
        trace, before = [], None
        for p in own:
            first = list(zip(p.fmts0, p.us0))
            if before is not None:
                arrow = [min(range(len(costs)), key=lambda j: (costs[j] + _step(before[j], x), j)) for x in first]
                costs = [costs[j] + _step(before[j], x) for j, x in zip(arrow, first)]
            else:
                arrow = [0] * len(first)
            inner = [min(range(len(first)), key=lambda i: (costs[i] + p.matrix[i][o], i)) for o in range(len(p.us1))]
            costs = [costs[i] + p.matrix[i][o] for o, i in enumerate(inner)]
            trace.append((p, arrow, inner))
            before = list(zip(p.fmts1, p.us1))
        at = min(range(len(costs)), key=lambda o: (costs[o], o))
        for p, arrow, inner in reversed(trace):
            fixed[source, p.pid] = (inner[at], at)
            at = arrow[inner[at]]
    return fixed


def resolve_instants(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(record_key, instant_us, fmt) for every record that names exactly one instant.

    ``df`` has ``record_key, source, seq, written, tz_name, date_order``, all STRING
    but ``seq``, which orders the records of a source; one row per key. Null or empty
    texts, texts without a day or a time of day, impossible dates or times, zoneless
    readings without a known zone, and readings a clock showed twice or never give no
    row. A null source is a source of its own, a null key gives no row.
    """
    shared_dir(spark)
    rows = df.where(F.col("record_key").isNotNull() & F.col("written").isNotNull()).select("source", "seq", "record_key", "written", "tz_name", "date_order")
    ordered = rows.repartitionByRange("source", "seq", "record_key").sortWithinPartitions("source", "seq", "record_key")
    parsed = ordered.drop("seq").mapInArrow(_parse, PARSED).checkpoint()  # keeps partitions and their order
    fixed = _ends(parsed.mapInArrow(_summaries, SUMMARY).collect())  # two rows a partition at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, pid, keys, chain in _chains(batches):
            best = viterbi(chain, *fixed.get((source, pid), (None, None)))
            picked = [(k, x[i][1], x[i][0].partition("|")[0]) for k, x, i in zip(keys, chain, best) if not x[i][0].startswith(NEVER)]
            for i in range(0, len(picked), 50_000):
                part = picked[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.string())], names=["record_key", "instant_us", "fmt"])

    return parsed.mapInArrow(choose, "record_key string, instant_us bigint, fmt string")
