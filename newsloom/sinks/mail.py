"""Recipients, messages and transports. Delivery is a side effect of the driver; tests use the memory transport."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from . import render

_ADDRESS = re.compile(r"[^\s@<>]+@[^\s@<>]+\.[^\s@<>.]+")


def parse_recipients(text: str | list[str] | None) -> list[str]:
    parts = text if isinstance(text, list) else re.split(r"[,;]", text or "")
    return [p.strip() for p in parts if p and p.strip()]


def valid_recipient(address: str) -> bool:
    m = re.fullmatch(r"[^<>]*<([^<>]+)>", address.strip())
    return bool(_ADDRESS.fullmatch((m[1] if m else address).strip()))


@dataclass(frozen=True)
class Message:
    sender: str
    to: list[str]
    subject: str
    html: str
    text: str
    reply_to: str | None = None


class Transport(Protocol):
    name: str

    def send(self, message: Message) -> object: ...
    def close(self) -> None: ...


@dataclass
class Memory:
    name: str = "memory"
    sent: list[Message] = field(default_factory=list)
    closed: bool = False

    def send(self, message: Message) -> int:
        self.sent.append(message)
        return len(self.sent)

    def close(self) -> None:
        self.closed = True


@dataclass
class Called:
    """Any service behind a callable, such as an SMTP session or an HTTP interface."""

    name: str
    call: Callable[[Message], object]

    def send(self, message: Message) -> object:
        return self.call(message)

    def close(self) -> None:
        pass


def deliver(digest: dict, to: str | list[str], transport: Transport, sender: str = "revue@localhost", reply_to: str | None = None, subject: str | None = None) -> object:
    """Check the recipients, send both forms, and always close the transport."""
    try:
        recipients = parse_recipients(to)
        if not recipients:
            raise ValueError("no recipient")
        if bad := [r for r in recipients if not valid_recipient(r)]:
            raise ValueError(f"invalid recipient: {', '.join(bad)}")
        return transport.send(Message(sender, recipients, subject or render.subject(digest), render.to_email(digest), render.to_text(digest), reply_to))
    finally:
        transport.close()
