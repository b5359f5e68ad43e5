"""Pre-tokens of byte-level vocabularies, found by way of chunks that can be kept.

A chunk is a run of white space with the run of other characters after it. The pattern
of these vocabularies never lets a pre-token begin in one chunk and end in the next,
and looks only forward, so a text's pre-tokens are those of its chunks in a row. Of other
patterns that isn't known: for them a text is one chunk.
"""

from __future__ import annotations

import contextlib
import gc
import re
from collections.abc import Iterator

#: White space for `re`, but not for the pattern: such texts are taken as one chunk.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_chunks = re.compile(r"\s*\S+|\s+").findall
LONGEST_KEPT = 64
#: Texts above this many characters are taken in several lists, which bounds memory.
_LONG = 4_000_000
_chunk_iter = re.compile(r"\s*\S+|\s+").finditer


def chunk_lists(text: str, whole: bool = False) -> Iterator[list[str]]:
    """Lists of a text's chunks, one after another; with whole, the text itself."""
    if whole or any(c in text for c in _SEPARATORS):
        yield [text]
    elif len(text) <= _LONG:
        yield _chunks(text)
    else:
        part = []
        for m in _chunk_iter(text):
            part.append(m.group())
            if len(part) >= 500_000:
                yield part
                part = []
        yield part


@contextlib.contextmanager
def no_gc():
    """Millions of strings are made here and none in cycles: collecting finds nothing."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
