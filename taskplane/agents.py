"""Workers whose process is a conversation with a language model that may call tools; the client is any callable."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .plans.engine import Context, Fatal, Retryable, Task, Worker


class ClientError(Exception):
    """An answer with an error status; 429, 5xx and transport errors (no status) may be tried again."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def retryable(self) -> bool:
        return self.status is None or self.status == 429 or self.status >= 500


def json_schema(schema: T.StructType) -> dict[str, Any]:
    """The JSON schema of a task type's columns, as tools state their arguments."""
    simple = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer"}

    def of(kind: T.DataType) -> dict[str, Any]:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, T.StructType):
            return json_schema(kind)
        return {"type": simple.get(type(kind), "string")}

    return {"type": "object", "properties": {f.name: of(f.dataType) for f in schema.fields}, "required": [f.name for f in schema.fields if not f.nullable]}


def schema_of(cls: type) -> T.StructType:
    """The columns of a task type that is declared as a dataclass; Optional fields and those with a default may be missing."""
    simple = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType()}

    def of(hint: Any) -> tuple[T.DataType, bool]:
        parts = typing.get_args(hint)
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            (inner,) = [p for p in parts if p is not type(None)]
            return of(inner)[0], True
        if typing.get_origin(hint) is list:
            return T.ArrayType(of(parts[0])[0]), False
        if dataclasses.is_dataclass(hint):
            return schema_of(hint), False
        return simple[hint], False

    hints, out = typing.get_type_hints(cls), T.StructType()
    for f in dataclasses.fields(cls):
        kind, optional = of(hints[f.name])
        out = out.add(f.name, kind, optional or f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING)
    return out


@dataclass
class HttpClient:
    """A client for services with chat completions over HTTP: what ``AgentWorker`` calls. It is sent to the executors, so that its key
    is too. Transport errors have no status; answers with an error status keep it."""

    base_url: str
    api_key: str = ""
    timeout_s: float = 120.0

    def body(self, request: dict) -> dict:
        """The request in the service's form."""
        messages = []
        for m in request["messages"]:
            out = {"role": m["role"], "content": m.get("content")}
            if m["role"] == "tool":
                out["tool_call_id"] = m.get("id")
            if m.get("calls"):
                out["tool_calls"] = [{"id": c.get("id"), "type": "function", "function": {"name": c["name"], "arguments": json.dumps(c.get("arguments") or {})}} for c in m["calls"]]
            messages.append(out)
        out = {**request, "messages": messages, "tools": [{"type": "function", "function": t} for t in request.get("tools", [])]}
        if not out["tools"]:
            out.pop("tools")
            out.pop("tool_choice", None)
        return out

    def __call__(self, request: dict) -> dict:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})}
        post = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(self.body(request)).encode(), headers)
        try:
            with urllib.request.urlopen(post, timeout=self.timeout_s) as answer:
                said = json.loads(answer.read())["choices"][0]["message"]
        except urllib.error.HTTPError as e:
            raise ClientError(f"status {e.code}: {e.read()[:500].decode(errors='replace')}", e.code) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise ClientError(str(e)) from e
        try:
            calls = [{"id": c.get("id"), "name": c["function"]["name"], "arguments": json.loads(c["function"].get("arguments") or "{}")} for c in said.get("tool_calls") or []]
        except ValueError as e:
            raise ClientError(f"arguments that are not JSON: {e}", 400) from e
        return {"text": said.get("content"), "calls": calls}


def render(task: Mapping[str, Any]) -> str:
    """``key: value`` lines: strings bare, the rest as compact JSON."""
    return "\n".join(f"{k}: {v if isinstance(v, str) else json.dumps(v, separators=(',', ':'), default=str)}" for k, v in task.items())


@dataclass
class AgentOptions:
    system: str = ""
    model: str = ""
    max_steps: int = 16
    temperature: float | None = None
    max_tokens: int | None = None
    tool_choice: str = "auto"
    on_text: Callable[[str], None] | None = None


@dataclass
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]
    call: Callable[..., str]


@dataclass
class AgentWorker(Worker):
    """``client(request)`` returns {"text": str or None, "calls": [{"id", "name", "arguments"}]}. Emitted types are tools of their own:
    calling one emits a task. A turn without calls ends the task; more than max_steps turns fail it."""

    client: Callable[[dict], dict]
    emits: Mapping[str, T.StructType]
    tools: list[Tool] = field(default_factory=list)
    options: AgentOptions = field(default_factory=AgentOptions)

    def request(self, messages: list[dict]) -> dict:
        specs = [{"name": n, "description": f"emit a task of type {n}", "parameters": json_schema(s)} for n, s in self.emits.items()]
        specs += [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in self.tools]
        o = self.options
        return {k: v for k, v in {"model": o.model, "messages": messages, "tools": specs, "tool_choice": o.tool_choice, "temperature": o.temperature, "max_tokens": o.max_tokens}.items() if v is not None}

    def process(self, task: Task, ctx: Context) -> None:
        own = {t.name: t for t in self.tools}
        messages = [{"role": "system", "content": self.options.system}, {"role": "user", "content": render(task)}]
        for _ in range(self.options.max_steps):
            try:
                reply = self.client(self.request(messages))
            except ClientError as e:
                raise (Retryable(("avoid_tried",), str(e)) if e.retryable else Fatal(str(e))) from e
            if reply.get("text") and self.options.on_text:
                self.options.on_text(reply["text"])
            calls = reply.get("calls") or []
            if not calls:
                return
            messages.append({"role": "assistant", "content": reply.get("text"), "calls": calls})
            for call in calls:
                name, arguments = call["name"], call.get("arguments") or {}
                if name in self.emits:
                    ctx.emit(name, arguments)
                    said = "ok"
                elif name in own:
                    said = own[name].call(**arguments)
                else:
                    raise Fatal(f"unknown tool {name!r}")
                messages.append({"role": "tool", "id": call.get("id"), "content": said})
        raise Fatal(f"no end after {self.options.max_steps} turns")
