"""Providers of external answers: a protocol, a registry, and a deterministic one without a network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

USAGE = ("in_tokens", "out_tokens", "cache_read", "cache_write")
#: Stop reasons that mean a cut answer.
TRUNCATED = frozenset(("max_tokens", "length"))


def usage(**given: int | None) -> dict[str, int]:
    """The four counts, missing ones 0."""
    return {k: int(given.get(k) or 0) for k in USAGE}


@dataclass
class Answer:
    text: str
    usage: dict[str, int] = field(default_factory=usage)
    stop: str = "end"

    @property
    def truncated(self) -> bool:
        return self.stop in TRUNCATED


class Provider(Protocol):
    name: str
    default_model: str
    supports_cache: bool

    def client(self) -> Any: ...

    def call(self, client: Any, model: str, system: str, user: str) -> Answer: ...

    def is_fatal(self, error: Exception) -> bool: ...

    def is_retryable(self, error: Exception) -> bool: ...


class FatalError(Exception):
    """Stops a run: nothing that follows can succeed."""


class Echo:
    """Answers every segment with its own text behind ``[VI] ``."""

    name, default_model, supports_cache = "echo", "echo-1", False

    def client(self) -> None:
        return None

    def call(self, client: None, model: str, system: str, user: str) -> Answer:
        found = re.findall(r'(?s)<seg id="(\d+)"[^>]*>(.*?)</seg>', user)
        return Answer("\n".join(f'<seg id="{i}">[VI] {body}</seg>' for i, body in found), usage(in_tokens=10, out_tokens=20))

    def is_fatal(self, error: Exception) -> bool:
        return isinstance(error, FatalError)

    def is_retryable(self, error: Exception) -> bool:
        return isinstance(error, (TimeoutError, ConnectionError))


class HttpChat:
    """Base of adapters to chat services: subclasses make the client; errors are told apart by their status.

    A spent quota (429 saying so) and a payment that is due (402) won't pass by waiting, so they are fatal.
    """

    name, default_model, supports_cache = "http", "", False
    fatal, retryable = frozenset((400, 401, 402, 403, 404, 422)), frozenset((408, 409, 425, 429, 500, 502, 503, 504, 529))

    def status(self, error: Exception) -> int | None:
        return getattr(error, "status_code", None)

    def quota_spent(self, error: Exception) -> bool:
        return self.status(error) == 429 and "quota" in str(error).lower()

    def is_fatal(self, error: Exception) -> bool:
        return self.status(error) in self.fatal or self.quota_spent(error)

    def is_retryable(self, error: Exception) -> bool:
        return not self.is_fatal(error) and (self.status(error) in self.retryable or isinstance(error, (TimeoutError, ConnectionError)))


class CachedMessages(HttpChat):
    """A messages service with a cached system prompt; its package is imported when a client is made."""

    name, default_model, supports_cache = "anthropic", "", True

    def client(self) -> Any:
        import anthropic  # noqa: PLC0415

        return anthropic.Anthropic()

    def call(self, client: Any, model: str, system: str, user: str) -> Answer:
        r = client.messages.create(model=model, max_tokens=16_000, system=[{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}], messages=[{"role": "user", "content": user}])
        u = r.usage
        spent = usage(in_tokens=u.input_tokens, out_tokens=u.output_tokens, cache_read=getattr(u, "cache_read_input_tokens", 0), cache_write=getattr(u, "cache_creation_input_tokens", 0))
        return Answer("".join(b.text for b in r.content if b.type == "text"), spent, r.stop_reason)


class Compatible(HttpChat):
    """A chat-completions service; cached tokens are taken off the input, and an answer without choices is an error."""

    name, default_model = "openai", ""

    def __init__(self, base_url: str | None = None):
        self.base_url = base_url

    def client(self) -> Any:
        import openai  # noqa: PLC0415

        return openai.OpenAI(base_url=self.base_url)

    def call(self, client: Any, model: str, system: str, user: str) -> Answer:
        r = client.chat.completions.create(model=model, messages=[{"role": "system", "content": system}, {"role": "user", "content": user}])
        if not r.choices:
            raise RuntimeError("an answer without choices")
        cached = getattr(getattr(r.usage, "prompt_tokens_details", None), "cached_tokens", 0) or 0
        return Answer(r.choices[0].message.content or "", usage(in_tokens=r.usage.prompt_tokens - cached, out_tokens=r.usage.completion_tokens, cache_read=cached), r.choices[0].finish_reason)


REGISTRY: dict[str, Callable[[], Provider]] = {"echo": Echo, "anthropic": CachedMessages, "openai": Compatible}


def names() -> list[str]:
    return sorted(REGISTRY)


def get(name: str) -> Provider:
    if name not in REGISTRY:
        raise ValueError(f"no provider {name!r}; there are {', '.join(names())}")
    return REGISTRY[name]()


ANSWERS = "book_id string, chunk_id long, answer string, error string, fatal boolean, called boolean, truncated boolean, provider string, model string, in_tokens long, out_tokens long, cache_read long, cache_write long"


def ask(prompts: DataFrame, provider: str | Callable[[], Provider], system: str, model: str | None = None) -> DataFrame:
    """Answers to (book_id, chunk_id, prompt): one client for each task; errors are rows, told apart as the provider does.
    An error of neither kind counts as fatal, and after a fatal one a task calls no more: what is left comes back as not called."""
    make = (lambda: get(provider)) if isinstance(provider, str) else provider
    columns = [x.split()[0] for x in ANSWERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = make()
        client, name, stopped = None, model or who.default_model, False
        for batch in batches:
            rows = []
            for book, chunk, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                if stopped:
                    rows.append((book, chunk, None, None, False, False, False, who.name, name, 0, 0, 0, 0))
                    continue
                try:
                    client = client or who.client()
                    a = who.call(client, name, system, prompt)
                    rows.append((book, chunk, a.text, None, False, True, a.truncated, who.name, name, *a.usage.values()))
                except Exception as e:  # noqa: BLE001  every kind of error becomes a row
                    stopped = who.is_fatal(e) or not who.is_retryable(e)
                    rows.append((book, chunk, None, str(e), stopped, True, False, who.name, name, 0, 0, 0, 0))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], columns)

    return prompts.select("book_id", "chunk_id", "prompt").mapInArrow(run, ANSWERS)
