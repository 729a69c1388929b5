"""Asynchronous actions on the driver: Spark jobs in threads, with the usual combinators."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

_POOL = ThreadPoolExecutor(16, thread_name_prefix="ordinaut")


def async_(action: Callable[..., Any], *args: Any, **kwargs: Any) -> Future:
    """Runs ``action`` (say, a frame's ``collect``) beside the caller."""
    return _POOL.submit(action, *args, **kwargs)


def ready(value: Any) -> Future:
    out: Future = Future()
    out.set_result(value)
    return out


def failed(error: BaseException) -> Future:
    out: Future = Future()
    out.set_exception(error)
    return out


def then(future: Future, step: Callable[[Any], Any]) -> Future:
    """``step`` of the result, once there is one; a failure goes on unchanged."""
    out: Future = Future()

    def done(f: Future) -> None:
        try:
            out.set_result(step(f.result()))
        except BaseException as e:  # noqa: BLE001 - it belongs to the one who waits
            out.set_exception(e)

    future.add_done_callback(done)
    return out


def on_error(future: Future, step: Callable[[BaseException], Any]) -> Future:
    out: Future = Future()

    def done(f: Future) -> None:
        try:
            out.set_result(step(e) if (e := f.exception()) else f.result())
        except BaseException as e:  # noqa: BLE001
            out.set_exception(e)

    future.add_done_callback(done)
    return out


def flat_map(future: Future, step: Callable[[Any], Future]) -> Future:
    out: Future = Future()

    def done(f: Future) -> None:
        try:
            step(f.result()).add_done_callback(lambda g: out.set_exception(e) if (e := g.exception()) else out.set_result(g.result()))
        except BaseException as e:  # noqa: BLE001
            out.set_exception(e)

    future.add_done_callback(done)
    return out


def when_all(futures: Iterable[Future]) -> Future:
    """All results, in the order given; the first failure otherwise.  Nothing waits in a thread."""
    futures, out, lock = list(futures), Future(), threading.Lock()
    left = len(futures)
    if not futures:
        return ready([])

    def done(f: Future) -> None:
        nonlocal left
        with lock:
            left -= 1
            last = not left
        if last:
            error = next((e for g in futures if (e := g.exception())), None)
            out.set_exception(error) if error else out.set_result([g.result() for g in futures])

    for f in futures:
        f.add_done_callback(done)
    return out


def when_any(futures: Iterable[Future]) -> Future:
    """``(place, result)`` of one that is done first."""
    futures, out, lock = list(futures), Future(), threading.Lock()
    over = False

    def done(at: int, f: Future) -> None:
        nonlocal over
        with lock:
            first, over = not over, True
        if first:
            out.set_exception(e) if (e := f.exception()) else out.set_result((at, f.result()))

    for k, f in enumerate(futures):
        f.add_done_callback(lambda f, k=k: done(k, f))
    return out


def chain(future: Future, *steps: Callable[[Any], Any]) -> Future:
    """Steps one after another, each of the result before."""
    for step in steps:
        future = then(future, step)
    return future
