"""Model calls: a protocol, a client over HTTP with retries and negotiation, a stub for tests and dry runs."""

from __future__ import annotations

import json
import logging
import random
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Any, Protocol

from quire.plans.settings import Settings

ATTEMPTS = 8
#: A server may ask for any delay; a task waits this long at most.
LONGEST_DELAY = 600.0
FINISHED = (None, "stop", "end_turn")


class ModelError(RuntimeError):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class Completer(Protocol):
    def complete(self, messages: list[dict[str, Any]], model: str | None = None) -> str: ...


class Unreachable(Exception):
    """The connection failed or timed out."""


#: (url, headers, body, timeout) -> status, headers, body
Transport = Callable[[str, dict[str, str], bytes, float], tuple[int, dict[str, str], str]]


def http(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, dict[str, str], str]:
    request = urllib.request.Request(url, body, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise Unreachable from e


def retry_delay(asked: str | None, attempt: int, now: datetime | None = None) -> float:
    """Seconds to wait before the next try: what the server asks for, as a number or a date, within bounds; where it
    asks for nothing that can be read, twice as long each time and a little more."""
    for read in (float, lambda x: (parsedate_to_datetime(x) - (now or datetime.now(UTC))).total_seconds()):
        try:
            return min(max(read(asked), 0.0), LONGEST_DELAY)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
    return min(60.0, 2.0**attempt) + random.random()


def refused_value(said: str) -> bool:
    """Whether a refusal is of a parameter's value or of the parameter: by its error's code, else by its wording."""
    try:
        error = json.loads(said).get("error") or {}
        if error.get("param"):
            return error["param"] == "temperature"
        if error.get("code"):
            return str(error["code"]).startswith(("unsupported", "invalid"))
    except (AttributeError, TypeError, ValueError):
        pass
    return re.search(r"(?i)un(?:supported|known|recognized)|(?:not|n't) (?:support|allow|accept|permit)|must be|one of|fixed", said) is not None


@dataclass(frozen=True)
class Adaptation:
    """A way to send a request that an endpoint wants: what in its refusal asks for it, and what it changes."""

    name: str
    asked: Callable[[str], bool]
    change: Callable[[dict[str, Any]], dict[str, Any]]


ADAPTATIONS = (
    Adaptation("other limit", lambda said: "max_completion_tokens" in said, lambda p: {("max_completion_tokens" if k == "max_tokens" else k): v for k, v in p.items()}),
    Adaptation("no temperature", lambda said: "temperature" in said and refused_value(said), lambda p: {k: v for k, v in p.items() if k != "temperature"}),
)
#: What a reply means, by its status; the first line that fits counts.  An adaptation that isn't found is a refusal.
ANSWERED, ADAPT, WAIT, REFUSED = "answered", "adapt", "wait", "refused"
OUTCOMES: tuple[tuple[Callable[[int], bool], str], ...] = (
    (lambda s: s == 0 or s == 429 or s >= 500, WAIT),  # 0: no connection
    (lambda s: s in (400, 422), ADAPT),
    (lambda s: s >= 400, REFUSED),
    (lambda s: True, ANSWERED),
)


@dataclass
class Client:
    """Asks an endpoint; how it wants to be asked is found out from its refusals and kept."""

    settings: Settings
    transport: Transport = http
    sleep: Callable[[float], None] = time.sleep
    input_tokens: int = 0
    output_tokens: int = 0
    adapted: tuple[str, ...] = ()
    log: logging.Logger = field(default_factory=lambda: logging.getLogger("quire.client"))

    def __post_init__(self) -> None:
        self.slots = threading.Semaphore(self.settings.concurrency)

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self.slots = threading.Semaphore(self.settings.concurrency)

    def _request(self, messages: list[dict[str, Any]], model: str | None) -> bytes:
        own = self.settings
        whole = {"model": model or own.model, "messages": messages, "max_tokens": own.max_tokens, "temperature": own.temperature}
        for a in ADAPTATIONS:
            whole = a.change(whole) if a.name in self.adapted else whole
        return json.dumps(whole).encode()

    def _reply(self, request: bytes) -> tuple[int, dict[str, str], str]:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.settings.api_key}"}
        try:
            with self.slots:
                return self.transport(self.settings.base_url.rstrip("/") + "/chat/completions", headers, request, self.settings.timeout)
        except Unreachable:
            return 0, {}, ""

    def _wanted(self, refusal: str) -> Adaptation | None:
        try:
            said = json.dumps(json.loads(refusal)).lower()
        except ValueError:
            return None
        return next((a for a in ADAPTATIONS if a.name not in self.adapted and a.asked(said)), None)

    def complete(self, messages: list[dict[str, Any]], model: str | None = None) -> str:
        status = 0
        for attempt in range(ATTEMPTS):
            status, headers, body = self._reply(self._request(messages, model))
            outcome = next(o for fits, o in OUTCOMES if fits(status))
            if outcome == ANSWERED:
                return self.read(body)
            if outcome == ADAPT and (way := self._wanted(body)):
                self.log.warning("the endpoint refuses a parameter; from here on: %s", way.name)
                self.adapted += (way.name,)
            elif outcome != WAIT:
                raise ModelError(f"refused with status {status}: see endpoint, key and model", status)
            elif attempt + 1 < ATTEMPTS:
                self.sleep(retry_delay(next((v for k, v in headers.items() if k.lower() == "retry-after"), None), attempt))
        raise ModelError(f"no answer in {ATTEMPTS} tries, the last with status {status}" if status else "no connection to the endpoint", status or None)

    def read(self, body: str) -> str:
        """The text of a reply; what it used is counted even if its text can't be."""
        try:
            reply = json.loads(body)
            used, first = reply.get("usage") or {}, reply["choices"][0]
            text, finish = first["message"]["content"], first.get("finish_reason")
            counts = [int(used.get(k, 0)) for k in ("prompt_tokens", "completion_tokens")]
        except (AttributeError, IndexError, KeyError, TypeError, ValueError):
            raise ModelError("the reply is no chat completion") from None
        self.input_tokens, self.output_tokens = self.input_tokens + counts[0], self.output_tokens + counts[1]
        why = unusable(finish, text)
        if why:
            raise ModelError(why)
        return text


def unusable(finish: str | None, text: Any) -> str | None:
    """Why a finished reply is of no use, None if it is."""
    if finish not in FINISHED:
        return f"the reply ended with {finish}: it was cut or filtered, --max-tokens may be too small"
    return None if isinstance(text, str) and text.strip() else "the reply has no text"


@dataclass
class Stub:
    """A deterministic model: repeats the source's text and placeholders, and names the first word as a term."""

    calls: list[list[dict[str, Any]]] | None = field(default_factory=list)  # None: calls aren't kept

    def complete(self, messages: list[dict[str, Any]], model: str | None = None) -> str:
        from html import escape

        from quire.operators.markup import TOKEN, parse

        if self.calls is not None:
            self.calls.append(messages)
        content = messages[1]["content"] if len(messages) > 1 else ""
        if not isinstance(content, str) or not content:
            return "a picture"
        context = json.loads(content)
        source = context["source_xhtml"]
        words = TOKEN.sub(" ", parse(source).text(" ", True)).split()
        body = f"<p>{escape(' '.join(words[:40]))}</p>" + "".join(f"\n{t}\n" for t in TOKEN.findall(source))
        terms = f"<dt>{escape(words[0])}</dt><dd>{escape(context['glossary'].get(words[0], words[0].upper()))}</dd>" if words else ""
        return f'<section data-role="summary" data-title="{escape(context["chapter"]) or "untitled"}">{body}</section><dl data-role="glossary">{terms}</dl>'
