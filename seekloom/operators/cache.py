"""A bounded cache of result pages on the driver: a few rows an entry, emptied when full."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from threading import Lock

MOST_ENTRIES = 5_000


class ResultCache:
    """Pages by everything that decides them: query, language, location, rule sets. Emptied as a whole at most entries."""

    def __init__(self, most: int = MOST_ENTRIES):
        self._most, self._pages, self._lock = most, {}, Lock()

    def page(self, key: Hashable, make: Callable[[], list]) -> list:
        """The page of key, made on its first use."""
        with self._lock:
            if key in self._pages:
                return self._pages[key]
        rows = make()
        with self._lock:
            if len(self._pages) >= self._most:
                self._pages.clear()
            return self._pages.setdefault(key, rows)

    def __len__(self) -> int:
        return len(self._pages)
