"""Splitting text into the pre-tokens of byte-level BPE, with caches of bounded size.

The pre-token pattern looks at most one character past a token, so text falls apart at any single white-space character
between two others: what stands between two such places is split the same way wherever it occurs.  Ordinary text is
therefore cut at single spaces and line breaks (fast) and only the resulting chunks go through the pattern, each once
per cache; text with other white space goes through the pattern as a whole.
"""

from __future__ import annotations

import re

import regex

#: A text for which cutting at spaces and line breaks is not enough.
ODD = re.compile(r"\s\s|\A\s|\s\Z")


class TwoGenerations(dict):
    """A cache of at most twice ``most`` entries: when full it becomes the old generation, from which entries in use come back."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def pre_tokens(pattern: str):
    """A function from text to its pre-tokens.  White space is Unicode's, as in the tokenizer libraries."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")).findall


def chunk_lines(text: str) -> list[list[str]] | None:
    """Lines of chunks; all but the first chunk of a line follow a space.  None: the text has to be split as a whole."""
    if ODD.search(text):
        return None
    return [line.split(" ") for line in text.split("\n")]
