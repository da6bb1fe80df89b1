"""Settings with defaults and clamps, and the lock of a run."""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime

from tidemark import constants as C
from tidemark.operators.enrich import lock_is_active
from tidemark.sources.seed import FEEDS
from tidemark.sources.store import KEPT, Store


@dataclass(frozen=True)
class Settings:
    """What a user may change; caps are clamped when saved."""

    model: str = "stub"
    effort: str = "medium"
    interval_minutes: int = C.DEFAULT_INTERVAL_MINUTES
    notifications_enabled: bool = True
    enabled_sources: list[str] = field(default_factory=lambda: [i for i, *_ in FEEDS])
    feed_url_overrides: dict[str, str] = field(default_factory=dict)
    summary_concurrency: int = C.SUMMARY_CONCURRENCY
    max_content_chars: int = C.MAX_CONTENT_CHARS
    max_new_per_source_per_run: int = C.MAX_NEW_PER_SOURCE_PER_RUN
    max_summaries_per_run: int = C.MAX_SUMMARIES_PER_RUN
    last_run_at: str | None = None


def _whole(x, low: int, high: int | None = None) -> int:
    """floor(x) within bounds; what is no number counts as the lower bound."""
    n = math.floor(x) if isinstance(x, (int, float)) and math.isfinite(x) else low
    return max(low, n if high is None else min(high, n))


def clamped(s: Settings) -> Settings:
    return replace(
        s,
        summary_concurrency=_whole(s.summary_concurrency, 1, 4),
        max_content_chars=_whole(s.max_content_chars, 1000),
        max_new_per_source_per_run=_whole(s.max_new_per_source_per_run, 1),
        max_summaries_per_run=_whole(s.max_summaries_per_run, 1),
    )


def merged(saved: dict) -> Settings:
    """Defaults overlaid by what is saved; unknown keys are ignored."""
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in saved.items() if k in known})


def load_settings(store: Store) -> Settings:
    return merged(json.loads(store.read_note("settings") or "{}"))


def save_settings(store: Store, patch: dict) -> Settings:
    """Saved settings overlaid by ``patch``, clamped; fields that are not in it stay as they were saved."""
    out = clamped(merged(asdict(load_settings(store)) | patch))
    store.write_note("settings", json.dumps(asdict(out)))
    return out


def trigger_seconds(s: Settings) -> int | None:
    """The interval of scheduled runs: at least 15 minutes; none for zero or less."""
    return None if s.interval_minutes <= 0 else 60 * max(C.MIN_INTERVAL_MINUTES, s.interval_minutes)


def _holder(store: Store, now: datetime) -> tuple[int, bool]:
    """(the highest number of the lock, whether it is held). An empty file, whose writer died, counts from when it was made."""
    number = next(iter(store.numbers("_lock")), 0)
    if not number or store.content(f"_released/{number:012d}") is not None:
        return number, False
    try:
        started = datetime.fromisoformat(json.loads(store.content(f"_lock/{number:012d}") or "")["started_at"])
    except (ValueError, KeyError, TypeError):
        # of an unknown start, by the file's time
        age = store.age(f"_lock/{number:012d}", time.time())
        return number, age is not None and age < 60 * C.LOCK_STALE_MINUTES
    return number, lock_is_active(True, started, now)


def is_locked(store: Store, now: datetime) -> bool:
    return _holder(store, now)[1]


def acquire(store: Store, now: datetime) -> int | None:
    """A number if the lock of a run is free or has been held for 20 minutes, else none; one request that came meanwhile is remembered.

    Locks are numbered files that only one call can make, and the highest one holds: of two that meet at a stale lock one gets the next number. The number is a
    fence: what ``store.fenced(number)`` writes is refused once a higher one has begun, so a run that was thought dead changes nothing.
    """
    number, held = _holder(store, now)
    if held or not store.create(f"_lock/{number + 1:012d}", json.dumps({"started_at": now.isoformat()})):
        store.create("_pending", "")
        return None
    store.fenced(number + 1).raise_fence()
    for old in store.numbers("_lock")[KEPT:]:
        store.remove(f"_lock/{old:012d}")
        store.remove(f"_released/{old:012d}")
    return number + 1


def release(store: Store, number: int) -> bool:
    """Give a lock back by its number; whether a run was asked for meanwhile. One that another run has taken since is not touched."""
    store.create(f"_released/{number:012d}", "")
    return next(iter(store.numbers("_lock")), 0) == number and store.remove("_pending")
