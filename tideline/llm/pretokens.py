"""Cutting long texts where no match of a byte-level BPE pattern can reach across.

In the patterns meant here no alternative takes a white-space character after
another kind of character.  So a match always ends before white space that follows
something else, and a text may be cut there, provided that the cut leaves the white
space's own matches as they are: before one single space that is followed by
something else, or around a long run of white space, whose matches are known (all of
the run but its last character; the whole run at the end of the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

LIMIT = 1 << 15
RUN = 4096
_gap = regex.compile(r"(?<=\S) (?=\S)")
_run = regex.compile(r"\p{White_Space}{%d,}+" % RUN)


def _cuts(text: str, limit: int) -> Iterator[str]:
    at = 0
    while len(text) - at > limit:
        m = _gap.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def pieces(text: str, limit: int = LIMIT) -> Iterator[tuple[str, bool]]:
    """(piece, whole) in order; ``whole``: the piece is one match, else it can be split by the pattern on its own."""
    if len(text) <= min(limit, RUN):
        yield text, False
        return
    at = 0
    for m in _run.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield from ((x, False) for x in _cuts(text[at : m.start()], limit))
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield from ((x, False) for x in _cuts(text[at:], limit))
