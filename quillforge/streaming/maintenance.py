"""Background rebuilds of a catalogue: one runs at a time, requests meanwhile become one more."""

from __future__ import annotations

import threading
from collections.abc import Callable


class Rebuilder:
    """Runs `build` in the background whenever `request` is called and the inputs' fingerprint has changed.

    While a build runs, any number of requests lead to one further build. A build that fails leaves what was
    published and is kept in `error`.
    """

    def __init__(self, build: Callable[[], object], fingerprint: Callable[[], str]):
        self.build, self.fingerprint = build, fingerprint
        self.error: Exception | None = None
        self.built: str | None = None
        self._lock = threading.Lock()
        self._running = self._pending = False
        self._idle = threading.Event()
        self._idle.set()

    def request(self) -> None:
        with self._lock:
            if self._running:
                self._pending = True
                return
            self._running = True
            self._idle.clear()
        threading.Thread(target=self._work, daemon=True).start()

    def wait(self, seconds: float | None = None) -> bool:
        return self._idle.wait(seconds)

    def _work(self) -> None:
        while True:
            try:
                now = self.fingerprint()
                if now != self.built:
                    self.build()
                    self.built, self.error = now, None
            except Exception as e:
                self.error = e
            with self._lock:
                if not self._pending:
                    self._running = False
                    self._idle.set()
                    return
                self._pending = False
