"""Time zones as versioned transition tables: sorted arrays of instants, offsets and abbreviations.

A release is read once, on the driver, and sent whole to wherever tables are made from it, so that no worker reads its own
files. After the last year with transitions of its own a zone follows its closing rule, which depends on a year's first
weekday and length only; the calendar repeats after 400 years, and a table holds 400 years of that rule.
"""

from __future__ import annotations

import importlib.resources
import io
import struct
import zoneinfo
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import cache
from pathlib import Path

import numpy as np

DAY = 86_400
FROM = -62_135_596_800  # 0001-01-01, before which there are no dates here
FIRST_CHANGE = -5_364_662_400  # 1800-01-01, before the first change of any zone
CYCLE = 400  # years after which the calendar repeats
STEP = 7 * DAY  # no zone changes twice within a week and back


@dataclass(frozen=True)
class Release:
    """The zone files of one release; tables are made from them when first asked for, once per process."""

    version: str
    files: dict[str, bytes]
    tables: dict = field(default_factory=dict, compare=False, repr=False)

    def table(self, name: str) -> ZoneTable | None:
        if name not in self.tables:
            data = self.files.get(name)
            self.tables[name] = None if data is None else _build(data)
        return self.tables[name]

    def __reduce__(self):
        return Release, (self.version, self.files)


@cache
def release() -> Release:
    """The release of this machine: some 600 files of 1 to 3 KB."""
    files, version = {}, "unknown"
    folders = [Path(p) for p in zoneinfo.TZPATH]
    try:
        packaged = importlib.resources.files("tzdata")
    except ModuleNotFoundError:
        packaged = None
    for name in zoneinfo.available_timezones():
        for folder in folders:
            if (path := folder / name).is_file():
                files[name] = path.read_bytes()
                break
        else:
            if packaged is not None:
                files[name] = packaged.joinpath("zoneinfo", *name.split("/")).read_bytes()
    for folder in folders:
        if (listing := folder / "tzdata.zi").exists():
            with listing.open() as f:
                version = f.readline().rpartition(" ")[2].strip()
            break
    else:
        if packaged is not None:
            version = packaged.joinpath("VERSION").read_text().strip()
    return Release(version, files)


def zone_version() -> str:
    """The release of the zone data in use."""
    return release().version


@dataclass(frozen=True)
class ZoneTable:
    offsets: np.ndarray  # seconds; offsets[i] holds up to changes[i]
    changes: np.ndarray  # local second from which offsets[i + 1] is read; what occurs twice or never is before it
    instants: np.ndarray  # the UTC second of each change
    names: tuple[str, ...]
    rule_from: int  # the second from which the table holds the closing rule alone

    def _within(self, local: np.ndarray) -> np.ndarray:
        """Seconds beyond the table's 400 years of the closing rule, moved back by whole cycles of the calendar."""
        beyond = local - (self.rule_from + DAY)  # the first day is left to what comes before
        return np.where(beyond >= _CYCLE_SECONDS, local - beyond // _CYCLE_SECONDS * _CYCLE_SECONDS, local)

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """UTC seconds of local seconds: the first of two, and for a skipped time the offset before the change."""
        return local - self.offsets[np.searchsorted(self.changes, self._within(local), side="right")]

    def named_to_utc(self, name: str, local: np.ndarray) -> np.ndarray | None:
        """UTC seconds of local times that name an abbreviation of this zone: the offset under which the abbreviation
        was in force at that instant, else its latest one; None if the zone has no such abbreviation."""
        mine = [i for i, n in enumerate(self.names) if n == name]
        if not mine:
            return None
        out, folded = local - self.offsets[mine[-1]], self._within(local)
        for offset in dict.fromkeys(self.offsets[i] for i in mine):
            at = np.searchsorted(self.instants, folded - offset, side="right")
            held = np.isin(at, mine) & (self.offsets[at] == offset)
            out = np.where(held, local - offset, out)
        return out


_CYCLE_SECONDS = 146_097 * DAY


def _second(year: int) -> int:
    return int((datetime(year, 1, 1) - datetime(1970, 1, 1)).total_seconds())


def _listed(data: bytes) -> list[tuple[int, tuple[int, str]]]:
    """The transitions that a zone file (TZif, version 2 or later) lists: instant, and offset and abbreviation from then on."""
    at = 0
    for width in (4, 8):  # the first block is for old readers
        utc, std, leaps, times, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        at += 44
        body = at
        at += times * (width + 1) + types * 6 + chars + leaps * (width + 4) + std + utc
    instants = struct.unpack(f">{times}q", data[body : body + 8 * times])
    kinds = data[body + 8 * times : body + 9 * times]
    table = body + 9 * times
    words = data[table + 6 * types : table + 6 * types + chars]
    states = []
    for i in range(types):
        offset, _, word = struct.unpack(">lbB", data[table + 6 * i : table + 6 * i + 6])
        states.append((offset, words[word : words.index(b"\0", word)].decode()))
    return [(t, states[k]) for t, k in zip(instants, kinds, strict=True)]


def _build(data: bytes) -> ZoneTable:
    zone = zoneinfo.ZoneInfo.from_file(io.BytesIO(data))
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def state(second: int) -> tuple[int, str]:
        at = (epoch + timedelta(seconds=second)).astimezone(zone)
        return int(at.utcoffset().total_seconds()), at.tzname()

    def changes(first: int, until: int) -> list[tuple[int, tuple[int, str]]]:
        found, before = [], state(first)
        for low in range(first, until, STEP):
            high = min(low + STEP, until)
            after = state(high)
            if after == before:
                continue
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if state(mid) == before else (a, mid)
            found.append((b, after))
            before = after
        return found

    listed = _listed(data)
    rule_year = max([1970, *[(epoch + timedelta(seconds=t)).year + 1 for t, _ in listed]])
    known = [(FROM, state(FIRST_CHANGE)), *(x for x in listed if x[0] > FIRST_CHANGE)]
    kinds: dict[tuple[int, int], list] = {}
    for year in range(rule_year, rule_year + CYCLE + 1):  # one year more, for local times at the end of the cycle
        begin, days = _second(year), (_second(year + 1) - _second(year)) // DAY
        kind = begin // DAY % 7, days
        if kind not in kinds:
            kinds[kind] = [(at - begin, to) for at, to in changes(begin, begin + days * DAY)]
        known += [(begin + at, to) for at, to in kinds[kind]]
    known = [x for i, x in enumerate(known) if not i or x[1] != known[i - 1][1]]
    offsets = np.array([o for _, (o, _) in known], dtype=np.int64)
    at = np.array([t for t, _ in known[1:]], dtype=np.int64)
    return ZoneTable(offsets, at + np.maximum(offsets[:-1], offsets[1:]) if len(at) else at, at, tuple(n for _, (_, n) in known), _second(rule_year))
