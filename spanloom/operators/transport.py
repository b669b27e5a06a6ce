"""Chat completions over HTTP: a table of outcomes, run by one loop, paced by a virtual empty time.

What a reply means is data: :data:`OUTCOMES` lists, in the order in which they are tried, how a reply is
recognised, which error it ends in, and after which pause it is asked for again. The pacer keeps one
number, the moment at which the server's token bucket was (or will be) empty at its refill rate.
"""

from __future__ import annotations

import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from ..config import SETTINGS


class GenerationError(RuntimeError):
    """A request failed for good."""


class Truncated(GenerationError):
    """The reply was cut off at its token limit."""


class QuotaExhausted(GenerationError):
    """The daily quota is used up; ``retry_after`` seconds remain."""

    def __init__(self, message: str, retry_after: float = SETTINGS.longest_daily_wait):
        super().__init__(message)
        self.retry_after = retry_after


# ---------------------------------------------------------------- waits that servers name

#: Seconds of each unit of a duration, and the headers that name a wait, the first that can be read counts.
UNITS = {"m": 60.0, "s": 1.0, "ms": 0.001}
WAIT_HEADERS = ("retry-after", "x-ratelimit-reset-tokens", "x-ratelimit-reset-requests")
DAILY_WAIT_HEADERS = WAIT_HEADERS[:2]
BUCKET_HEADERS = ("x-ratelimit-limit-tokens", "x-ratelimit-remaining-tokens")
_AMOUNT = re.compile(r"([0-9]+(?:\.[0-9]+)?)(ms|m|s)")


def parse_wait(value: str | None) -> float | None:
    """Seconds of a plain number or of minutes, seconds and milliseconds in this order; None for anything else."""
    value = (value or "").strip()
    try:
        return float(value)
    except ValueError:
        amounts = _AMOUNT.findall(value)
    order = [list(UNITS).index(unit) for _, unit in amounts]
    whole = "".join(n + unit for n, unit in amounts) == value
    return sum(float(n) * UNITS[unit] for n, unit in amounts) if amounts and whole and order == sorted(set(order)) else None


def named_wait(headers: dict, names: tuple[str, ...]) -> float | None:
    """The first wait that the headers name."""
    return next((w for w in map(parse_wait, map(headers.get, names)) if w is not None), None)


# ---------------------------------------------------------------- outcomes


class Reply(NamedTuple):
    """What came back; status 0 stands for a host that can't be reached."""

    status: int
    headers: dict
    body: str


Pause = Callable[[Reply, int, Callable[[float, float], float]], float]


def _doubling(reply: Reply, attempt: int, jitter: Callable[[float, float], float]) -> float:
    return 2.0**attempt


def _as_told(reply: Reply, attempt: int, jitter: Callable[[float, float], float]) -> float:
    """The server's wait, with a floor, as a bucket that refills all the time names waits too short to be of use."""
    told = named_wait(reply.headers, WAIT_HEADERS)
    return _doubling(reply, attempt, jitter) + jitter(0, 1) if told is None else max(told, SETTINGS.least_wait) + jitter(0.1, 0.5)


def _quota(message: str, reply: Reply) -> GenerationError:
    told = named_wait(reply.headers, DAILY_WAIT_HEADERS)
    return QuotaExhausted(message, SETTINGS.longest_daily_wait if told is None else min(told, SETTINGS.longest_daily_wait))


class Outcome(NamedTuple):
    """How a reply is recognised, the words and the error it ends in, and the pause after which it is asked for again (None: never)."""

    matches: Callable[[Reply], bool]
    words: str
    error: Callable[[str, Reply], GenerationError]
    pause: Pause | None = None


_plain = lambda message, reply: GenerationError(message)
OUTCOMES = (
    Outcome(lambda r: r.status == 0, "the host can't be reached", _plain, _doubling),
    Outcome(lambda r: r.status == 401, "the key was rejected", _plain),
    Outcome(lambda r: r.status == 429 and bool(re.search(r"tokens per day|\(tpd\)", r.body, re.I)), "the daily quota is used up", _quota),
    Outcome(lambda r: r.status == 429 or r.status >= 500, "the server is busy", _plain, _as_told),
    Outcome(lambda r: "json_validate_failed" in r.body, "the reply was cut off", lambda message, reply: Truncated(message)),
    Outcome(lambda r: True, "the request was refused", _plain),
)


# ---------------------------------------------------------------- pacing


@dataclass
class Pacer:
    """When the server's bucket of tokens is full enough; ``share`` is this task's part of the refill.

    At its refill rate a bucket that holds x tokens now was empty x / rate seconds ago, and holds y
    tokens y / rate seconds after that moment. So one time stands for limit, rest and clock.
    """

    share: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    limit: float = 0.0
    empty_at: float = 0.0

    @property
    def rate(self) -> float:
        return self.limit * self.share / 60

    def remember(self, headers: dict) -> None:
        """Take over what the server reports; replies that report nothing change nothing."""
        try:
            limit, left = (float(headers[name]) for name in BUCKET_HEADERS)
        except (KeyError, ValueError):
            return
        self.limit = limit
        self.empty_at = self.clock() - left / self.rate if limit else 0.0

    def wait_for(self, tokens: float) -> float:
        """Sleep until so many tokens, or a whole bucket, have likely been refilled; the seconds slept."""
        if not self.limit:
            return 0.0
        now = self.clock()
        full_since = self.empty_at + self.limit / self.rate
        self.empty_at += max(0.0, now - full_since)  # a full bucket gains nothing
        pause = min(max(0.0, self.empty_at + min(tokens, self.limit) / self.rate - now), SETTINGS.longest_wait)
        if pause:
            self.sleep(pause)
        return pause


# ---------------------------------------------------------------- client

Transport = Callable[[dict, float], "tuple[int, dict, str]"]
"""(payload, timeout) -> (status, lower-case headers, body); raises OSError when the host can't be reached."""


@dataclass(frozen=True)
class HttpTransport:
    """POSTs JSON to ``{base_url}/chat/completions`` with a bearer key; lists models from ``{base_url}/models``."""

    base_url: str
    key: str = field(repr=False, default="")
    agent: str = "spanloom/1"

    def _send(self, path: str, payload: dict | None, timeout: float) -> tuple[int, dict, str]:
        headers = {"Content-Type": "application/json", "User-Agent": self.agent} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = None if payload is None else json.dumps(payload).encode()
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", body, headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read().decode()
        except urllib.error.HTTPError as e:  # a status of 400 or more is an answer
            return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode(errors="replace")

    def __call__(self, payload: dict, timeout: float) -> tuple[int, dict, str]:
        return self._send("chat/completions", payload, timeout)

    def models(self, timeout: float = 30.0) -> list[str]:
        """The ids of the models that the key can use, in order."""
        status, _, body = self._send("models", None, timeout)
        if status >= 400:
            raise GenerationError(f"status {status}: {body[:300]}")
        return sorted(m["id"] for m in json.loads(body).get("data", []))


def required_key(variable: str) -> str:
    """A credential from the environment, or an error that names the backends that need none."""
    if value := os.environ.get(variable, "").strip():
        return value
    raise GenerationError(f"{variable} is not set; the extractive backend needs no key, the local one no network")


@dataclass
class ChatClient:
    """A chat-completions generator with retries and pacing over a transport."""

    transport: Transport
    model: str = "model"
    timeout: float = SETTINGS.timeout
    retries: int = SETTINGS.retries
    pacer: Pacer = field(default_factory=Pacer)
    jitter: Callable[[float, float], float] = random.uniform

    def shared(self, tasks: int) -> ChatClient:
        """The client of one of so many tasks that ask at the same time: each may use its part of the refill."""
        return replace(self, pacer=replace(self.pacer, share=self.pacer.share / max(1, tasks)))

    def _ask(self, payload: dict) -> Reply:
        try:
            return Reply(*self.transport(payload, self.timeout))
        except OSError as e:
            return Reply(0, {}, str(e))

    def post(self, payload: dict) -> dict:
        """The answer to a payload, by the table of outcomes."""
        # A server reserves the most tokens that a reply may take, and reads about one for four characters.
        said = [m["content"] if isinstance(m["content"], str) else json.dumps(m["content"]) for m in payload["messages"]]
        cost = payload["max_tokens"] + sum(map(len, said)) // 4
        attempt = 0
        while True:
            self.pacer.wait_for(cost)
            reply = self._ask(payload)
            self.pacer.remember(reply.headers)
            if 0 < reply.status < 400:
                return json.loads(reply.body)
            outcome = next(o for o in OUTCOMES if o.matches(reply))
            if outcome.pause is None or attempt == self.retries:
                raise outcome.error(f"{outcome.words} (status {reply.status}, {attempt + 1} attempts): {reply.body[:300]}", reply)
            self.pacer.sleep(min(outcome.pause(reply, attempt, self.jitter), SETTINGS.longest_wait))
            attempt += 1

    def complete(self, prompt: dict) -> dict:
        """The reply to a prompt; one that is cut off is asked for again with room for twice the tokens."""
        content = "\n\n".join([f"[excerpt {k + 1}]\n{t}" for k, t in enumerate(prompt["excerpts"])] + ["---", prompt["task"]])
        if prompt.get("documents"):  # citable blocks instead of running text
            content = [*json.loads(prompt["documents"]), {"type": "text", "text": prompt["task"]}]
        room = [min(prompt["max_tokens"] << k, max(prompt["max_tokens"], SETTINGS.verified_ceiling)) for k in range(SETTINGS.verified_escalations + 1)]
        for k, tokens in enumerate(room):
            payload: dict[str, Any] = {"model": self.model, "temperature": 0, "max_tokens": tokens, "messages": [{"role": "user", "content": content}]}
            if prompt["json"]:
                payload["response_format"] = {"type": "json_object"}
            try:
                return self._read(self.post(payload))
            except Truncated:
                if k + 1 == len(room):
                    raise
        raise AssertionError("a prompt is asked at least once")

    def _read(self, data: dict) -> dict:
        usage, (choice, *_) = data.get("usage", {}), data["choices"]
        content = choice["message"].get("content")
        blocks = content if isinstance(content, list) else None  # a server with native citations answers in blocks
        return {
            "content": "".join(b.get("text") or "" for b in blocks) if blocks else content, "blocks": blocks,
            "stop_reason": choice.get("finish_reason"), "model": data.get("model", self.model),
            "input_tokens": usage.get("prompt_tokens", 0), "output_tokens": usage.get("completion_tokens", 0),
        }


# ---------------------------------------------------------------- a model in the worker


@dataclass
class LocalModel:
    """A causal language model of the ``transformers`` library, loaded once in each worker.

    The prompt goes through the tokenizer's own chat template; where it has none, through plain text.
    Raises ImportError on first use where the library is not installed.
    """

    path: str
    device: str = "cpu"

    def _loaded(self):
        import transformers

        cache = LocalModel.__dict__.get("_cache") or {}
        if self.path not in cache:
            tokenizer = transformers.AutoTokenizer.from_pretrained(self.path)
            model = transformers.AutoModelForCausalLM.from_pretrained(self.path, torch_dtype="auto").to(self.device)
            cache[self.path] = tokenizer, model.eval()
            LocalModel._cache = cache
        return cache[self.path]

    def render(self, tokenizer, prompt: dict) -> str:
        """The text that the model continues."""
        said = "\n\n".join([*prompt["excerpts"], prompt["task"]])
        if getattr(tokenizer, "chat_template", None):
            return tokenizer.apply_chat_template([{"role": "user", "content": said}], tokenize=False, add_generation_prompt=True, enable_thinking=False)
        return said + "\n\n"

    def complete(self, prompt: dict) -> dict:
        tokenizer, model = self._loaded()
        given = tokenizer(self.render(tokenizer, prompt), return_tensors="pt").to(self.device)
        n = given["input_ids"].shape[1]
        made = model.generate(**given, max_new_tokens=prompt["max_tokens"], do_sample=False)[0][n:]
        return {
            "content": tokenizer.decode(made, skip_special_tokens=True), "stop_reason": "length" if len(made) == prompt["max_tokens"] else "stop",
            "model": self.path, "input_tokens": n, "output_tokens": len(made),
        }
