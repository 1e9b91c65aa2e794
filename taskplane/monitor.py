"""Progress: samples as lines for people, or as JSON lines."""

from __future__ import annotations

import json
import sys
import time
from typing import Any, TextIO


class JsonConsole:
    def __init__(self, out: TextIO | None = None):
        self.out = out or sys.stdout

    def sample(self, state: dict[str, Any]) -> None:
        print(json.dumps({"t": round(time.time(), 3), **state}), file=self.out, flush=True)


class LiveConsole:
    """Rewrites its line on a terminal, else appends one each time."""

    def __init__(self, out: TextIO | None = None, live: bool | None = None):
        self.out = out or sys.stderr
        self.live = self.out.isatty() if live is None else live

    def sample(self, state: dict[str, Any]) -> None:
        line = "  ".join(f"{k}={','.join(v) if isinstance(v, list) else v}" for k, v in state.items())
        print(("\r\x1b[2K" if self.live else "") + line, end="" if self.live else "\n", file=self.out, flush=True)


class Collected:
    """Keeps its samples, for tests."""

    def __init__(self) -> None:
        self.samples: list[dict[str, Any]] = []

    def sample(self, state: dict[str, Any]) -> None:
        self.samples.append(dict(state))
