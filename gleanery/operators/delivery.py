"""Messages and where they go."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import subprocess
import sys
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol, TextIO

from pyspark.sql import Row, SparkSession

from gleanery.functions.text import mask_assignments
from gleanery.session import read_text, write_text


@dataclass
class Message:
    """What is sent: a kind, a title, and a bounded list of lines to show."""

    kind: str
    title: str
    rows: list[dict] = field(default_factory=list)

    def plain(self) -> str:
        return "\n".join([f"[{self.kind.upper()}] {self.title}", *(f"  {r.get('score', '')} {r.get('title', '')} {r.get('url', '')}".rstrip() for r in self.rows)])

    def markdown(self) -> str:
        return "\n".join([f"# {self.title}", "", *(f"- **{r.get('score', '')}** [{r.get('title', '')}]({r.get('url', '')})" for r in self.rows)]) + "\n"


def message(kind: str, title: str, rows: Iterable[Row]) -> Message:
    return Message(kind, title, [r.asDict(recursive=True) for r in rows])


class Sink(Protocol):
    def send(self, message: Message) -> None: ...


class Console:
    def __init__(self, out: TextIO = sys.stdout) -> None:
        self.out = out

    def send(self, message: Message) -> None:
        print(message.plain(), file=self.out)


class FileDrop:
    """``latest.md`` and ``latest.json`` replaced as a whole, and a line per message in a daily log; on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, day: str) -> None:
        self.spark, self.folder, self.day = spark, folder, day

    def send(self, message: Message) -> None:
        body = json.dumps({"kind": message.kind, "title": message.title, "rows": message.rows}, ensure_ascii=False, default=str)
        log = f"{self.folder}/{self.day}.jsonl"
        # a day's messages are few, as budgets bound them
        write_text(self.spark, log, (read_text(self.spark, log) or "") + body + "\n")
        write_text(self.spark, f"{self.folder}/latest.md", message.markdown())
        write_text(self.spark, f"{self.folder}/latest.json", body)


class FanOut:
    """Sends to all sinks, each within ``seconds``; delivered if any takes it, an error if none does."""

    def __init__(self, sinks: list[Sink], seconds: float = 25.0) -> None:
        self.sinks, self.seconds = sinks, seconds

    def send(self, message: Message) -> None:
        errors: list[Exception] = []
        pool = ThreadPoolExecutor(max(1, len(self.sinks)))
        futures = [pool.submit(s.send, message) for s in self.sinks]
        for f in futures:
            try:
                f.result(self.seconds)
            except Exception as e:
                errors.append(e)
        pool.shutdown(wait=False, cancel_futures=True)
        if len(errors) == len(self.sinks):
            raise ExceptionGroup("no sink took the message", errors or [RuntimeError("no sinks")])


def signature(timestamp: int, secret: str) -> bytes:
    """The signature of a webhook call: HMAC-SHA256 of nothing, keyed by time and secret."""
    return hmac.new(f"{timestamp}\n{secret}".encode(), b"", hashlib.sha256).digest()


def card(message: Message, template: str = "blue", timestamp: int | None = None, secret: str = "") -> dict:
    """The body of a webhook call that shows a message as a card, signed if a secret is given."""
    lines = [f"**{r.get('score', '')}** [{r.get('title', '')}]({r.get('url', '')})" for r in message.rows]
    body = {
        "msg_type": "interactive",
        "card": {
            "config": {"wide_screen_mode": True},
            "header": {"template": template, "title": {"tag": "plain_text", "content": message.title}},
            "elements": [{"tag": "markdown", "content": line} for line in lines],
        },
    }
    if secret and timestamp is not None:
        body |= {"timestamp": str(timestamp), "sign": base64.b64encode(signature(timestamp, secret)).decode()}
    return body


class Relay:
    """Hands a message's text to a fixed external command, without a shell; its output is clipped and secrets in it are masked."""

    def __init__(self, command: list[str], seconds: float = 25.0, most: int = 400) -> None:
        self.command, self.seconds, self.most = command, seconds, most

    def send(self, message: Message) -> None:
        done = subprocess.run([*self.command, message.plain()], capture_output=True, text=True, timeout=self.seconds, check=False)
        if done.returncode:
            raise RuntimeError(mask_assignments((done.stderr or done.stdout).strip()[: self.most]))


class App:
    """Delivery by an application identity. ``call`` posts (path, body, token) and gives the answer as a dictionary.

    A token is asked for once and used until two minutes before it ends. A card that is refused is sent again as text; only an answer with a
    message id counts as delivered.
    """

    def __init__(self, call: Callable[[str, dict, str | None], dict], identity: dict, receiver: str, clock: Callable[[], float] = time.time) -> None:
        self.call, self.identity, self.receiver, self.clock = call, identity, receiver, clock
        self.token, self.until = "", 0.0

    def _token(self) -> str:
        if self.clock() >= self.until:
            answer = self.call("token", self.identity, None)
            if not answer.get("token"):
                raise RuntimeError(f"no token: {mask_assignments(str(answer.get('message', '')))}")
            self.token, self.until = answer["token"], self.clock() + float(answer.get("expire", 0)) - 120
        return self.token

    def send(self, message: Message) -> None:
        bodies = ({"msg_type": "interactive", "content": json.dumps(card(message)["card"], ensure_ascii=False)}, {"msg_type": "text", "content": json.dumps({"text": message.plain()}, ensure_ascii=False)})
        answer: dict = {}
        for body in bodies:
            answer = self.call("message", {"receive_id": self.receiver, **body}, self._token())
            if answer.get("message_id"):
                return
        raise RuntimeError(f"not delivered: {mask_assignments(str(answer.get('message', '')))}")
