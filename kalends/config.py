"""Limits of the tools, all of them parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Fixed default values; pass another instance to change them."""

    file_bytes: int = 10 * 1024 * 1024
    #: None: all files. The interactive tool takes 20 at once.
    files: int | None = None
    events: int = 25_000
    contacts: int = 50_000
    property_chars: int = 1_000_000
    attendees: int = 10_000
    repeated_values: int = 10_000
    series_occurrences: int = 10_000
    occurrences: int = 25_000
    range_days: int = 1830
    #: None: all pairs. The interactive tool stops at 50,000.
    candidate_pairs: int | None = None
    group_members: int = 50
    weak_bucket: int = 100
    strong_bucket: int = 1000
    page: int = 100


LIMITS = Limits()
