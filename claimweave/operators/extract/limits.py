"""Time limits of single files, so that one which a parser can't get through doesn't hold its task."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Seconds that a file may take.
SECONDS = 30.0


class TooSlow(Exception):
    """The file took longer than it may."""


def _stop(signum: int, frame: object) -> None:
    raise TooSlow


def within(seconds: float, work: Callable[[], T]) -> tuple[T | None, str | None]:
    """(result, None), or (None, reason) of a file that took too long or broke the parser. Python workers run tasks in their main thread;
    elsewhere there is no timer, and no limit."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        return _tried(work)
    before = signal.signal(signal.SIGALRM, _stop)
    try:
        try:
            signal.setitimer(signal.ITIMER_REAL, seconds)
            return _tried(work)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
    except TooSlow:  # it may come as late as the timer is being stopped
        return None, "timeout"
    finally:
        signal.signal(signal.SIGALRM, before)


def _tried(work: Callable[[], T]) -> tuple[T | None, str | None]:
    try:
        return work(), None
    except (IndexError, RecursionError, MemoryError, ValueError, KeyError, AttributeError, TypeError) as e:
        return None, type(e).__name__
