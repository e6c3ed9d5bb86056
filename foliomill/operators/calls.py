"""Calls of a slow service from one task: several at once, in order, with retries and a time limit."""

from __future__ import annotations

import threading
import urllib.error
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """How a partition's calls are made.

    ``parallel`` run at once; each has ``attempts``, of at most ``limit`` seconds each, between which it
    waits ``wait`` seconds, twice as long each time (or as long as the service says, up to ``longest``).
    ``ahead`` answers at most are kept while an earlier one is awaited.
    """

    parallel: int = 8
    attempts: int = 3
    limit: float = 600.0
    wait: float = 1.0
    longest: float = 60.0
    ahead: int = 64


def worth_another(error: BaseException) -> bool:
    """Whether the same call may succeed later: not if the service has refused it as wrong."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in (408, 409, 425, 429) or error.code >= 500
    return not isinstance(error, (ValueError, TypeError, KeyError, ImportError))


def _told(error: BaseException) -> float | None:
    """Seconds to wait by a ``Retry-After`` header."""
    headers = getattr(error, "headers", None) or getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        return max(0.0, float(headers.get("Retry-After")))
    except (AttributeError, TypeError, ValueError):
        return None


class _Call:
    """One call: ``done`` is set when it has an answer or no attempt is left."""

    def __init__(self, ask: Callable, arguments: tuple, policy: Policy, slots: threading.Semaphore):
        self.ask, self.arguments, self.policy, self.slots = ask, arguments, policy, slots
        self.done, self.answer, self.error = threading.Event(), None, None
        threading.Thread(target=self._run, daemon=True).start()

    def _attempt(self, ended: threading.Event, out: list) -> None:
        try:
            out += [self.ask(*self.arguments), None]
        except Exception as e:
            out += [None, e]
        ended.set()

    def _run(self) -> None:
        try:
            for n in range(max(1, self.policy.attempts)):
                ended, out = threading.Event(), []
                threading.Thread(target=self._attempt, args=(ended, out), daemon=True).start()  # left to itself if it is late
                self.answer, self.error = out if ended.wait(self.policy.limit) else (None, TimeoutError(f"no answer in {self.policy.limit:g} s"))
                if self.error is None or not worth_another(self.error) or n + 1 >= self.policy.attempts:
                    return
                pause = _told(self.error)
                threading.Event().wait(min(self.policy.longest, self.policy.wait * 2**n if pause is None else pause))
        finally:
            self.slots.release()
            self.done.set()


def answers(ask: Callable, calls: Iterable[tuple], policy: Policy = Policy()) -> Iterator[tuple[object, Exception | None]]:
    """Answer and error of ``ask(*arguments)`` for each of ``calls``, in their order."""
    slots, waiting = threading.Semaphore(policy.parallel), deque()
    for arguments in calls:
        while waiting and (waiting[0].done.is_set() or len(waiting) >= policy.ahead):
            waiting[0].done.wait()
            first = waiting.popleft()
            yield first.answer, first.error
        slots.acquire()
        waiting.append(_Call(ask, arguments, policy, slots))
    while waiting:
        first = waiting.popleft()
        first.done.wait()
        yield first.answer, first.error
