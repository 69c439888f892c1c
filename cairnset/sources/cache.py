"""A read-through cache of files, shared by the processes of one machine, and ordered look-ahead."""

from __future__ import annotations

import fcntl
import hashlib
import os
import shutil
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any, TypeVar

from ..errors import DatasetError

A, B = TypeVar("A"), TypeVar("B")


@contextmanager
def locked(path: str, timeout: float = 300.0) -> Iterator[None]:
    """Hold a lock file. The system frees it if its holder dies; waiting longer than the timeout is an error."""
    until = time.monotonic() + timeout
    with open(path, "w") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > until:
                    raise DatasetError(f"{path} was not free in {timeout} s") from None
                time.sleep(0.02)
        yield


def retried(call: Callable[[], A], attempts: int = 3, wait: float = 0.1, errors: tuple[type[BaseException], ...] = (OSError,)) -> A:
    """call(), again after an error, with waits that double."""
    for n in range(attempts):
        try:
            return call()
        except errors:
            if n + 1 == attempts:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("attempts must be positive")


class FileCache:
    """get() gives a local copy of a file that never changes. One process fetches it; the others wait for that one."""

    def __init__(self, folder: str, timeout: float = 300.0, attempts: int = 3):
        self.folder, self.timeout, self.attempts = folder, timeout, attempts

    def get(self, path: str, fetch: Callable[[str], Any]) -> str:
        """fetch(to) writes the file to a new local path; the copy appears as a whole or not at all."""
        os.makedirs(self.folder, exist_ok=True)
        own = os.path.join(self.folder, hashlib.sha256(path.encode()).hexdigest())
        if not os.path.exists(own):
            with locked(own + ".lock", self.timeout):
                if not os.path.exists(own):
                    part = f"{own}.{uuid.uuid4().hex}"
                    retried(lambda: fetch(part), self.attempts)
                    os.replace(part, own)
        return own


def copy_out(store: Any, path: str, to: str) -> None:
    """A file of an Arrow file system to a local path."""
    with store.open_input_stream(path, compression=None) as source, open(to, "wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)


def ahead(fetch: Callable[[A], B], items: Iterable[A], size: Callable[[A], int], threads: int = 16, most: int = 2_000_000_000) -> Iterator[B]:
    """fetch(item) of each item, in order; threads work ahead, on items of at most `most` bytes together, or one."""
    waiting, held = deque(), 0
    with ThreadPoolExecutor(threads, thread_name_prefix="ahead") as pool:
        for item in items:
            while waiting and held + size(item) > most:
                done, n = waiting.popleft()
                held -= n
                yield done.result()
            waiting.append((pool.submit(fetch, item), size(item)))
            held += size(item)
        while waiting:
            yield waiting.popleft()[0].result()
