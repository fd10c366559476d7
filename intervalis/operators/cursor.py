"""A closeable, peekable cursor over a result, which closes itself when its client is idle."""

from __future__ import annotations

import threading
import time
import weakref

from pyspark.sql import DataFrame

from ..errors import CursorClosedError

IDLE_SECONDS = 15.0
_NOTHING = object()


class Cursor:
    """Rows arrive partition by partition. After ``timeout`` idle seconds a timer closes the cursor and frees what it holds; 0 or
    less closes it at once."""

    def __init__(self, frame: DataFrame, timeout: float | None = None, clock=time.monotonic):
        self.timeout = IDLE_SECONDS if timeout is None else timeout
        self._clock, self._ahead, self._closed = clock, _NOTHING, self.timeout <= 0
        self._rows = None if self._closed else iter(frame.toLocalIterator())
        self._used, self._lock = clock(), threading.RLock()
        if not self._closed:
            self._watch(self.timeout)

    def _watch(self, seconds: float) -> None:
        """Looks after the cursor in so many seconds, without keeping it alive."""
        known = weakref.ref(self)

        def look() -> None:
            if (cursor := known()) is not None:
                cursor._close_if_idle()

        self._timer = threading.Timer(seconds, look)
        self._timer.daemon = True
        self._timer.start()

    def _close_if_idle(self) -> None:
        with self._lock:
            left = self.timeout - (self._clock() - self._used)
            if not self._closed and left <= 0:
                self.close()
            elif not self._closed:
                self._watch(max(left, 0.01))

    def _touch(self) -> None:
        with self._lock:
            if not self._closed and self._clock() - self._used > self.timeout:
                self.close()
            if self._closed:
                raise CursorClosedError("the cursor is closed")
            self._used = self._clock()

    def keep_alive(self) -> None:
        self._touch()

    def has_next(self) -> bool:
        with self._lock:
            self._touch()
            if self._ahead is _NOTHING:
                self._ahead = next(self._rows, _NOTHING)
                self._used = self._clock()  # waiting for rows is not idleness
            return self._ahead is not _NOTHING

    def peek(self):
        return self._ahead if self.has_next() else None

    def next(self):
        with self._lock:
            if not self.has_next():
                raise StopIteration
            row, self._ahead = self._ahead, _NOTHING
            return row

    def count_remainder_and_close(self) -> int:
        count = 0
        while self.has_next():
            self.next()
            count += 1
        self.close()
        return count

    def close(self) -> None:
        self._closed, self._rows, self._ahead = True, None, _NOTHING
        if timer := getattr(self, "_timer", None):
            timer.cancel()

    __next__ = next

    def __iter__(self):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def mapped(cursor, function):
    return (function(x) for x in cursor)


def flat_mapped(cursor, function):
    return (y for x in cursor for y in function(x))


def filtered(cursor, test):
    return (x for x in cursor if test(x))


def validated(cursor, check):
    """Passes rows on after a check that may raise."""
    for x in cursor:
        check(x)
        yield x
