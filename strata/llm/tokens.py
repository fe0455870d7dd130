"""Encoding of many short strings at once, for tables that remember what a string encodes to."""

from __future__ import annotations

import os
from collections.abc import Iterable

#: Strings that a table holds before it starts anew.
CACHE = 250_000
#: Characters of text handled at once.
SLICE_CHARS = 1 << 23


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS):
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own. Null texts are empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def texts_of(column, rows: int = 1000):
    """The texts of an Arrow column, a few rows at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()
