"""Maintenance at an interval, one run at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class Maintenance:
    """Runs an action when `seconds` have gone since it last began; a run that is due while another lasts is left out."""

    def __init__(self, action: Callable[[], object], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.action, self.seconds, self.clock = action, seconds, clock
        self._lock, self._last, self.runs, self.errors = threading.Lock(), None, 0, []

    def due(self) -> bool:
        return self._last is None or self.clock() - self._last >= self.seconds

    def tick(self) -> bool:
        """Run the action if it is due and none is running; True if it ran. Errors are kept, not raised."""
        if not self.due() or not self._lock.acquire(blocking=False):
            return False
        try:
            self._last = self.clock()
            self.action()
            self.runs += 1
        except Exception as e:  # the next run may succeed
            self.errors.append(str(e))
        finally:
            self._lock.release()
        return True

    def start(self) -> threading.Event:
        """Tick in a thread of its own until the event is set."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(min(1.0, self.seconds)):
                self.tick()

        threading.Thread(target=run, daemon=True).start()
        return stop
