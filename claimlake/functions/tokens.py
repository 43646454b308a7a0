"""Tokens of running text with their places: runs of letters, runs of digits, and single marks."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\s]")


class Token(NamedTuple):
    low: str
    at: int
    to: int


class Tokens(list):
    """The tokens of a text; everything between two of them is white space."""

    def __init__(self, text: str):
        super().__init__(Token(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text))
        self.text = text

    def low(self, i: int) -> str:
        return self[i].low if 0 <= i < len(self) else ""

    def gap(self, i: int) -> int:
        """White space before token ``i``."""
        return self[i].at - self[i - 1].to if 0 < i < len(self) else 0

    def opens(self, i: int) -> bool:
        """Whether a word starts at token ``i``: nothing of a word goes before it."""
        at = self[i].at
        return not (at and (self.text[at - 1].isalnum() or self.text[at - 1] == "_"))

    def closes(self, i: int) -> bool:
        """Whether a word ends with token ``i``."""
        after = self.text[self[i].to : self[i].to + 1]
        return not (after.isalnum() or after == "_")
