"""Timestamps, read marks and conflict detection of a store's transactions."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Sequence

from tesselkv.errors import Conflict

#: Keys from a start (included) to an end (excluded); None leaves a side open.
KeyRange = tuple[bytes | None, bytes | None]


def covers(r: KeyRange, key: bytes) -> bool:
    return (r[0] is None or key >= r[0]) and (r[1] is None or key < r[1])


class Watermark:
    """``done_until``: the greatest mark up to which all that began have ended."""

    def __init__(self, at: int = 0):
        self.done_until, self._open, self._ended = at, {}, set()

    def begin(self, ts: int) -> None:
        self._open[ts] = self._open.get(ts, 0) + 1

    def end(self, ts: int) -> None:
        self._open[ts] -= 1
        if not self._open[ts]:
            del self._open[ts]
            self._ended.add(ts)
        least = min(self._open, default=None)
        passed = {t for t in self._ended if least is None or t < least}
        self.done_until = max(passed, default=self.done_until) if max(passed, default=-1) > self.done_until else self.done_until
        self._ended -= passed

    @property
    def least_open(self) -> int | None:
        return min(self._open, default=None)


class Oracle:
    """One writer process per store, so timestamps are a counter; its threads share it."""

    def __init__(self, max_version: int, detect_conflicts: bool = True, managed: bool = False):
        self.next_ts, self.detect, self.managed = max_version + 1, detect_conflicts, managed
        self.managed_discard = 0
        self.reads, self.commits = Watermark(), Watermark(max_version)
        self.committed: dict[bytes, int] = {}
        self.ingested: dict[int, str] = {}  # bulk commits, whose keys stay in their files
        self._owner: dict[int, int] = {}  # commits in flight and their threads
        self._changed = threading.Condition(threading.RLock())

    def read_ts(self, wait: float | None = None) -> int:
        """The newest version that is wholly applied; marks it as being read.

        Waits for commits of other threads that are in flight.  A commit of this very
        thread can't end while it waits, and neither can others after ``wait`` seconds:
        then the version before them is read.
        """
        with self._changed:
            me, ts = threading.get_ident(), self.next_ts - 1
            others = lambda: any(t <= ts and who != me for t, who in self._owner.items())
            self._changed.wait_for(lambda: not others(), wait)
            ts = min([ts, *[t - 1 for t in self._owner]])
            self.reads.begin(ts)
            return ts

    def commit_ts(
        self, read_ts: int, reads: Iterable[bytes], writes: Iterable[bytes], managed: int | None = None, ranges: Sequence[KeyRange] = ()
    ) -> int:
        """The commit's version; raises ``Conflict`` if a key read was committed since."""
        with self._changed:
            if self.detect:
                since = {k for k, t in self.committed.items() if t > read_ts} if ranges else set()
                if any(self.committed.get(k, 0) > read_ts for k in reads) or any(covers(r, k) for r in ranges for k in since):
                    raise Conflict("a key that was read has been committed since")
            ts = self.next_ts if managed is None else managed
            self.next_ts = max(self.next_ts, ts + 1)
            self.commits.begin(ts)
            self._owner[ts] = threading.get_ident()
            if self.detect:
                self.committed.update(dict.fromkeys(writes, ts))
            return ts

    def ingested_since(self, read_ts: int) -> list[str]:
        """The folders of bulk commits newer than ``read_ts``."""
        return [path for ts, path in self.ingested.items() if ts > read_ts] if self.detect else []

    def done_commit(self, ts: int) -> None:
        with self._changed:
            self.commits.end(ts)
            self._owner.pop(ts, None)
            self._changed.notify_all()

    def done_read(self, ts: int) -> None:
        with self._changed:
            self.reads.end(ts)
            low = self.discard_ts()
            self.committed = {k: t for k, t in self.committed.items() if t > low}

    def set_discard_ts(self, ts: int) -> None:
        """Managed: versions hidden at or below ``ts`` are not read any more."""
        with self._changed:
            self.managed_discard = max(self.managed_discard, ts)
            self.committed = {k: t for k, t in self.committed.items() if t > self.managed_discard}

    def discard_ts(self) -> int:
        """No reader needs versions hidden at or below this; managed, 0 until it is set."""
        with self._changed:
            if self.managed:
                return self.managed_discard
            low = self.reads.least_open
            top = min([self.next_ts, *self._owner]) - 1
            return top if low is None else min(low, top)
