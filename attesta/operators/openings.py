"""The stack of open strings of a sorted pass. Nothing else is imported, so tasks start fast."""

from __future__ import annotations

KNOWN, TARGET, GUEST = 1, 2, 4


class _Open:
    """A string that later ones may continue, with the longest known string below it and the best known one above."""

    __slots__ = ("text", "kind", "below", "best")

    def __init__(self, text: str, kind: int, below: str | None):
        self.text, self.kind, self.below, self.best = text, kind, below, None

    def offer(self, name: str | None) -> None:
        """The longer known string stays, of equally long ones the first by name."""
        if name is not None and (self.best is None or (-len(name), name) < (-len(self.best), self.best)):
            self.best = name


class Stack:
    """The open strings of one day while its strings arrive in order."""

    def __init__(self):
        self.open: list[_Open] = []
        self.done: list[tuple[str, str | None, str | None]] = []

    def close(self, text: str | None = None) -> None:
        """Take off what `text` does not continue; all of it without a text. Targets taken off are done."""
        while self.open and (text is None or not text.startswith(self.open[-1].text)):
            gone = self.open.pop()
            if self.open:
                self.open[-1].offer(gone.best)
            below = None if gone.kind & GUEST else gone.below
            if gone.kind & TARGET and (below is not None or gone.best is not None):
                self.done.append((gone.text, below, gone.best))

    def meet(self, text: str, kind: int) -> None:
        self.close(text)
        top = self.open[-1] if self.open else None
        if top is not None and top.text == text:
            fresh = kind & KNOWN and not top.kind & KNOWN
            top.kind |= kind
            top = self.open[-2] if len(self.open) > 1 else None
        else:
            fresh = kind & KNOWN
            below = None if top is None else top.text if top.kind & KNOWN else top.below
            self.open.append(_Open(text, kind, below))
        if fresh and top is not None and not kind & GUEST:
            top.offer(text)
