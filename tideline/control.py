"""Control commands: ownership questions and handoffs by name, with coerced arguments.

``run`` never raises for a bad command; it answers ("ok", value) or ("error", text).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tideline.engine import Engine
from tideline.operators import ownership


def as_text(value: Any) -> str:
    """Text or UTF-8 bytes."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode()
    if isinstance(value, str):
        return value
    raise TypeError(f"text is wanted, not {type(value).__name__}")


def as_bytes(value: Any) -> bytes:
    return bytes(value) if isinstance(value, (bytes, bytearray)) else as_text(value).encode()


def as_int(value: Any) -> int:
    """A whole number, or text of one; truth values aren't numbers."""
    if isinstance(value, bool) or isinstance(value, float) and not value.is_integer():
        raise TypeError(f"a whole number is wanted, not {value!r}")
    if isinstance(value, (int, float)):
        return int(value)
    return int(as_text(value))


def as_list(value: Any) -> list:
    """A list, or one value as a list of it; none for nothing."""
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _dispatch(engine: Engine, event: dict, subscribers: Any) -> int:
    who = [{"id": as_text(s["id"]), "url": as_text(s["url"])} for s in as_list(subscribers)]
    engine.dispatch(as_text(event["id"]), as_text(event.get("type") or ""), as_text(event.get("data") or "null"), who)
    return len(who)


def _owner(engine: Engine, partition: Any) -> list | None:
    row = ownership.owner_row(engine.store.read(live=True).partition_owners, as_int(partition))
    return [row.owner_node, row.generation, row.state, row.next_owner] if row else None


COMMANDS: dict[str, Callable[..., Any]] = {
    "run_id": lambda e: e.run,
    "owner_of": _owner,
    "begin_handoff": lambda e, p, source, target: e.begin_handoff(as_int(p), as_text(source), as_text(target)),
    "complete_handoff": lambda e, p: e.complete_handoff(as_int(p)),
    "inflight_count": lambda e, p: e.in_flight(as_int(p)),
    "take_over": lambda e, p, target, expected: e.take_over(as_int(p), as_text(target), as_int(expected)),
    "resize": lambda e, n: e.resize(as_int(n)),
    "resume": lambda e, who: e.resume(as_text(who)).asDict(),
    "dispatch": _dispatch,
}


def run(engine: Engine, command: str, *arguments: Any) -> tuple[str, Any]:
    if command not in COMMANDS:
        return "error", f"unknown command {command!r}"
    try:
        return "ok", COMMANDS[command](engine, *arguments)
    except (ValueError, TypeError, KeyError, RuntimeError) as e:
        return "error", f"{type(e).__name__}: {e}"
