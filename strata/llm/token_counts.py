"""Token counts with a shortcut for strings that are one token.

A byte-level tokenizer first cuts a text into pre-tokens and merges only within
each.  Which vocabulary strings encode alone as one token is proved once, before
the scan, by encoding every one of them (the proof's size is the vocabulary's).
A pre-token that is such a string counts one without any merging.  All other
pre-tokens are merged by the library once, and remembered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import table
from .tokens import CACHE, slices, texts_of, tokenizer

#: Tokens above which a document is over the limit.
LIMIT = 512

# How the tokenizer cuts a text. The second form is the same for texts of plain characters, in the faster library.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xac\xae-\xb1\xb4-\xb8\xbb\xbf-ž‐-‧€]*")
_MIXED = re.compile(r"\s[ ]|[ ]\s|[\t\r]|\s\Z")


def _bytes_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove(path: str) -> frozenset[str]:
    """The vocabulary strings that, as a text of their own, are one token."""
    tok, back = tokenizer(path), _bytes_of()
    texts = []
    for word in tok.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(back[c] for c in word).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character is no text
    found = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found) if t and len(e.ids) == 1)


class Counts:
    """Numbers of tokens of texts."""

    def __init__(self, path: str, single: frozenset[str]):
        import regex

        self.tokenizer, self.single, self.cut = tokenizer(path), single, regex.compile(_CUT)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.merged: dict[str, int] = {}  # pre-tokens that are more than one token
        self.chunks: dict[str, int] = {}  # words with what follows up to a blank, after a blank

    def merge(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tokenizer.encode_batch(parts, add_special_tokens=False)):
            self.merged[p] = len(e.ids)

    def of_parts(self, groups: list[list[str]]) -> list[int]:
        """For each list of pre-tokens, its tokens."""
        if len(self.merged) > CACHE:
            self.merged.clear()
        self.merge(list(set().union(*groups) - self.single - self.merged.keys()))
        extra = self.merged.get
        return [sum([extra(p, 1) for p in g]) for g in groups]

    def learn(self, chunks: list[str]) -> None:
        self.chunks.update(zip(chunks, self.of_parts([_CUT_PLAIN.findall(" " + c) for c in chunks])))

    def of(self, texts: list[str | None]):
        for run in slices(texts):
            plain = [bool(t) and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in run]
            easy = [t.split(" ") if p and not _MIXED.search(t) else None for t, p in zip(run, plain)]
            met = set().union(*[c[1:] for c in easy if c])
            new = list(met - self.chunks.keys())
            if len(self.chunks) + len(new) > CACHE:  # the chunks of this run stay: the frequent ones are among them
                self.chunks = {c: self.chunks[c] for c in met.difference(new)}
            self.learn(new)
            firsts = iter(self.of_parts([_CUT_PLAIN.findall(c[0]) for c in easy if c]))
            for t, p, c in zip(run, plain, easy):
                if c:
                    yield next(firsts) + sum(map(self.chunks.__getitem__, c[1:]))
                elif p:
                    yield self.of_parts([_CUT_PLAIN.findall(t)])[0]
                elif not t:
                    yield 0
                else:
                    yield len(self.special.findall(t)) + sum(self.of_parts([self.cut.findall(x) for x in self.special.split(t)]))


_made: dict[str, Counts] = {}


def _count_rows(path: str, single):
    def rows(batches):
        if path not in _made:
            _made[path] = Counts(path, single.value)
        counts = _made[path]  # a worker keeps its tables between tasks
        for batch in batches:
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
            n = pa.array(np.fromiter(counts.of(texts_of(text)), np.int64, len(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    return bw.giving_back(rows)


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row of ``documents``.

    ``path`` is the file of a byte-level BPE tokenizer.  Special tokens' strings
    inside a text count as the library counts them, one each.  Null and
    empty texts have no bytes and no tokens.  Repeated rows and null ids are
    kept; other columns are not read.
    """
    single = documents.sparkSession.sparkContext.broadcast(prove(path))  # as many strings as the vocabulary at most
    counted = documents.select("doc_id", "text").mapInArrow(_count_rows(path, single), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
