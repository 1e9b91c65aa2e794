"""Commands and files in a folder of their own. The local backend limits time and output; it does not isolate."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from .agents import Tool


@dataclass
class SandboxSpec:
    timeout_s: float = 300
    output_bytes: int = 1 << 20
    files: dict[str, bytes] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)


@dataclass
class Result:
    exit_code: int
    stdout: bytes
    stderr: bytes
    truncated: bool = False
    timed_out: bool = False


class LocalSandbox:
    """A temporary folder; commands see PATH and the spec's variables only. A timeout ends with exit code 124."""

    def __init__(self, spec: SandboxSpec | None = None):
        self.spec = spec or SandboxSpec()
        self.root = Path(tempfile.mkdtemp(prefix="taskplane-sandbox-")).resolve()
        for name, data in self.spec.files.items():
            self.write_file(name, data)

    def _inside(self, name: str) -> Path:
        path = (self.root / name).resolve()
        if path != self.root and self.root not in path.parents:
            raise ValueError(f"{name!r} is outside the sandbox")
        return path

    def write_file(self, name: str, data: bytes | str) -> None:
        path = self._inside(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data.encode() if isinstance(data, str) else data)

    def read_file(self, name: str) -> bytes:
        return self._inside(name).read_bytes()

    def exec(self, command: list[str], stdin: bytes = b"", timeout_s: float | None = None) -> Result:
        """At most the spec's time, or less."""
        limit = self.spec.timeout_s if timeout_s is None else min(timeout_s, self.spec.timeout_s)
        env = {"PATH": os.environ.get("PATH", ""), **self.spec.env}
        try:
            done = subprocess.run(command, cwd=self.root, env=env, input=stdin, capture_output=True, timeout=limit)
            code, out, err, late = done.returncode, done.stdout, done.stderr, False
        except subprocess.TimeoutExpired as e:
            code, out, err, late = 124, e.stdout or b"", e.stderr or b"", True
        most = self.spec.output_bytes
        return Result(code, out[:most], err[:most], len(out) > most or len(err) > most, late)

    def teardown(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)

    def __enter__(self) -> LocalSandbox:
        return self

    def __exit__(self, *_: object) -> None:
        self.teardown()

    def tools(self) -> list[Tool]:
        """run_command, write_file and read_file for an agent."""
        text = {"type": "string"}
        argv = {"type": "array", "items": text}

        def run(command: list[str] | str, timeout_secs: float | None = None) -> str:
            r = self.exec(["sh", "-c", command] if isinstance(command, str) else list(command), timeout_s=timeout_secs)
            return f"exit code {r.exit_code}\n{r.stdout.decode(errors='replace')}{r.stderr.decode(errors='replace')}"

        def write(path: str, content: str) -> str:
            self.write_file(path, content)
            return "ok"

        return [
            Tool("run_command", "run a program with its arguments in the sandbox", {"type": "object", "properties": {"command": argv, "timeout_secs": {"type": "number"}}, "required": ["command"]}, run),
            Tool("write_file", "write a file in the sandbox", {"type": "object", "properties": {"path": text, "content": text}, "required": ["path", "content"]}, write),
            Tool("read_file", "read a file of the sandbox", {"type": "object", "properties": {"path": text}, "required": ["path"]}, lambda path: self.read_file(path).decode(errors="replace")),
        ]
