"""Step functions of keyed sequential operators.

Each takes the key's state (None at first) and a row, and returns the new state
and what to add to the row. Batch (``sequential``) and stream (``live``) call the
same functions, so they cannot drift apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

Row = dict[str, Any]
Step = Callable[[Any, Row], tuple[Any, Row]]


def change_step(threshold: int = 8) -> Step:
    """A hash counts as changed if it is the first or differs from the last
    changed one by ``threshold`` bits; smaller drift adds up."""

    def step(state: int | None, row: Row) -> tuple[int, Row]:
        now = row["hash"]
        distance = None if state is None else ((state ^ now) & 0xFFFFFFFFFFFFFFFF).bit_count()
        changed = distance is None or distance >= threshold
        return (now if changed else state), {"distance": distance, "changed": changed}

    return step


def interval_step(seconds: float | str) -> Step:
    """Accepted if at least ``seconds`` (a number, or the name of a column) have
    gone since the last accepted row."""

    def step(state: float | None, row: Row) -> tuple[float, Row]:
        accepted = state is None or row["at"] - state >= (row[seconds] if isinstance(seconds, str) else seconds)
        return (row["at"] if accepted else state), {"accepted": accepted}

    return step


def tab_step() -> Step:
    """A tab and URL that were processed last are skipped for ``wait`` seconds (a column)."""

    def step(state: tuple[Any, str, float] | None, row: Row) -> tuple[tuple[Any, str, float], Row]:
        same = state is not None and (row["tab"], row["url"]) == state[:2]
        accepted = not same or row["at"] - state[2] >= row["wait"]
        return ((row["tab"], row["url"], row["at"]) if accepted else state), {"accepted": accepted}

    return step


def export_step(gap: float, penalty: float) -> Step:
    """When a fetch may start: ``gap`` seconds after the last one, and after an
    answer that there were too many (column limited), ``penalty`` more."""

    def step(state: float | None, row: Row) -> tuple[float, Row]:
        start = row["at"] if state is None else max(row["at"], state + gap)
        return start + (penalty if row["limited"] else 0), {"start": start, "waited": start - row["at"]}

    return step


def backoff_step(seconds: float) -> Step:
    """A key that failed (column ok) is left alone for ``seconds``; success ends it."""

    def step(state: float | None, row: Row) -> tuple[float | None, Row]:
        if state is not None and row["at"] - state < seconds:
            return state, {"tried": False}
        return (None if row["ok"] else row["at"]), {"tried": True}

    return step


def unrepeated_step() -> Step:
    """Content whose hash is that of the row before it is not passed on."""

    def step(state: str | None, row: Row) -> tuple[str, Row]:
        now = sha(row["text"] or "")
        return now, {"passed": now != state}

    return step


def dedup_step(ttl: float = 24 * 3600) -> Step:
    """New, changed or duplicate content of a path; a path idle for ``ttl`` is new."""

    def step(state: tuple[str, float] | None, row: Row) -> tuple[tuple[str, float], Row]:
        known = state is not None and row["at"] - state[1] < ttl
        action = "created" if not known else "skipped" if state[0] == row["content_hash"] else "updated"
        return (row["content_hash"], row["at"]), {"action": action}

    return step


def ring_step(similarity: float = 0.9, size: int = 100, seconds: float = 300) -> Step:
    """A near duplicate of one of the last accepted texts of the last seconds."""

    def step(state: list[tuple[frozenset[str], float]] | None, row: Row) -> tuple[list, Row]:
        own = frozenset((row["text"] or "").lower().split())
        ring = [x for x in state or [] if row["at"] - x[1] < seconds]
        near = any((1.0 if not own and not old else len(own & old) / len(own | old)) >= similarity for old, _ in ring)
        return (ring if near else [*ring, (own, row["at"])][-size:]), {"duplicate": near}

    return step


class Known:
    """Lines and words of a stored text, and its running hash. The text itself is
    kept only where the state is to be pickled (``keep``): a hash object isn't."""

    def __init__(self, text: str, keep: bool = False):
        self.lines: set[str] = set()
        self.words: set[str] = set()
        self.text: list[str] | None = [] if keep else None
        self.hash = hashlib.sha256()
        self.add(text)

    def add(self, text: str) -> None:
        self.lines |= {x for x in (y.strip() for y in text.split("\n")) if len(x.encode()) > 10}
        self.words |= set(text.split())
        self.hash.update(text.encode())
        if self.text is not None:
            self.text.append(text)

    def new(self, incoming: str) -> str:
        """Lines of ``incoming`` that are new."""
        out = []
        for line in (x.strip() for x in incoming.split("\n")):
            if len(line.encode()) >= 10 and line not in self.lines:
                own = line.split()
                if sum(w in self.words for w in own) / len(own) < 0.8:
                    out.append(line)
        return "\n".join(out)

    def __reduce__(self):
        if self.text is None:
            raise TypeError("a state that is kept between batches needs keep=True")
        return Known, ("".join(self.text), True)


def new_lines(existing: str, incoming: str) -> str:
    """Lines of ``incoming`` that are new to ``existing``."""
    return Known(existing).new(incoming)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_step(least_bytes: int = 50, keep: bool = False) -> Step:
    """Recognised text of a path: equal to what is stored, nothing new, or appended.

    A path's state is its different lines and words, and is gone over for new rows
    only. keep: for streams, whose state is pickled; it then holds the text, too.
    """

    def step(state: Known | None, row: Row) -> tuple[Known, Row]:
        content = row["text"] or ""
        if state is None:
            return Known(content, keep), {"action": "created", "n_added": len(content), "stored_hash": sha(content)}
        digest = state.hash.hexdigest()
        new = "" if sha(content) == digest else state.new(content)
        if len(new.encode()) < least_bytes:
            return state, {"action": "skipped", "n_added": 0, "stored_hash": digest}
        state.add(f"\n\n{new}")
        return state, {"action": "updated", "n_added": len(new), "stored_hash": state.hash.hexdigest()}

    return step
