"""Packing of documents into sequences by exact-complement hashing, then best fit.

Only lengths matter to the plan, and there are at most ``limit`` of them, so the
plan is made from the histogram of piece lengths, which does not grow with the
corpus.  From the longest length down, gaps are looked up in indexes of single,
pair and triple sums of the lengths still available; a combination that fills
the gap exactly is consumed as often as the counts allow.  What is left is
packed best fit, longest first, again by counts.  The plan is a list of
templates (lengths, how many sequences).  Pieces of a length are numbered
without a global sort, and each number falls into one interval of the plan,
which gives the sequence and the offset.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import Scratch, table
from .tokens import CACHE, slices, texts_of, tokenizer

#: Tokens of a sequence.
LIMIT = 4096
#: The id that ends each document.
END = 1
#: Parts that the pieces of one length are numbered in.
PARTS = 256

#: Texts whose words the tokenizer can be given in any company: for these characters both libraries lower-case and part alike.
#: Fixed value: what the tokenizer cuts off a run of letters (RE2).
_PARTS = r"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\p{L}\p{N}\s]+)"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xac\xae-\xb1\xb4-\xb8\xbb\xbf-ÿ‐-‧€]*")


class Ids:
    """The ids of texts as bytes (unsigned, little-endian, 32 bits).

    The tokenizer drops white space, cuts words into pieces and never merges
    across pieces, so a text's ids are those of its pieces one after the other.
    Each piece is encoded once and kept as a place in one array of ids.  Texts
    with other than plain characters, or with what may be a special token, go to
    the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a piece.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.bounds, self.ids = np.zeros(2, np.int64), np.zeros(0, "<u4")

    def _keep_only(self, words: list[str]) -> None:
        words = ["", *[w for w in words if w]]
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        size = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(size)
        self.ids = self.ids[np.arange(ends[-1]) + np.repeat(self.bounds[at] - ends + size, size)]
        self.place, self.bounds = dict(zip(words, range(len(words)))), np.r_[0, ends]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str], step: int = 500) -> None:
        ids, sizes = [self.ids], []
        runs = [new[k : k + step] for k in range(0, len(new), step)]
        coded = (np.array(e.ids, "<u4") for k in range(0, len(runs), 16) for e in self.tokenizer.encode_batch_fast([" ".join(run) for run in runs[k : k + 16]], add_special_tokens=False))
        for run, own in zip(runs, coded):
            ends = np.flatnonzero(self.last[own])
            if len(ends) == len(run):
                ids.append(own)
                sizes.append(np.diff(np.r_[-1, ends]))
            else:  # a piece that the vocabulary cannot spell
                each = [np.frombuffer(self.whole(w), "<u4") for w in run]
                ids += each
                sizes.append(np.fromiter(map(len, each), np.int64, len(run)))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.ids = np.concatenate(ids)
        self.bounds = np.r_[self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))]

    def of(self, texts: list[str | None]):
        for run in slices(texts):
            plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in run]
            low = pc.utf8_lower(pa.array([t if p else "" for t, p in zip(run, plain)], pa.string()))
            words = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _PARTS, r" \1 "))
            coded = words.values.dictionary_encode()
            met = coded.dictionary.to_pylist()
            if len(self.place) > CACHE:
                self._keep_only([w for w in met if w in self.place])  # the frequent ones are among them
            new = [w for w in met if w not in self.place]
            if new:
                self._learn(new)
            place = np.fromiter(map(self.place.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy()]
            size = self.bounds[place + 1] - self.bounds[place]
            ends = np.cumsum(size)
            flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[place] - ends + size, size)].tobytes()
            cuts = 4 * np.r_[0, ends][words.offsets.to_numpy()]
            for t, p, a, b in zip(run, plain, cuts[:-1].tolist(), cuts[1:].tolist()):
                yield flat[a:b] if p else self.whole(t)


_made: dict[str, Ids] = {}


def _piece_rows(path: str, limit: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def rows(batches):
        ids = _made[path] if path in _made else _made.setdefault(path, Ids(path))  # a worker keeps its table between tasks
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(ids.of(texts_of(batch.column("text")))):
                own = text + last
                for at in range(0, len(own), 4 * limit):
                    part = own[at : at + 4 * limit]
                    row.append(k)
                    piece.append(at // (4 * limit))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64()))}
            out |= {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    return bw.giving_back(rows)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Templates (lengths in order, number of sequences) that use each length exactly as often as ``counts`` says."""
    if any(not 1 <= n <= limit for n, c in counts.items() if c > 0):
        raise ValueError("lengths are from 1 to the limit")
    left = np.zeros(limit + 1, np.int64)
    for n, c in counts.items():
        left[n] = max(c, 0)
    there = left > 0  # the index of single sums; pair and triple sums are read off it
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(left[n]) // k for n, k in need.items())
        if times:
            out.append((lengths, times))
            for n, k in need.items():
                left[n] -= k * times
                there[n] = left[n] > 0
        return times > 0

    def pairs(total: int, least: int = 1) -> np.ndarray:
        """The shorter lengths, from ``least`` on, of the pairs that sum to ``total``; the longest first."""
        half = total // 2
        if half < least:
            return np.zeros(0, np.int64)
        return (np.flatnonzero(there[least : half + 1] & there[total - half : total - least + 1][::-1]) + least)[::-1]

    def fill(n: int) -> None:  # each combination that is used ends the supply of a length, so there are few
        gap = limit - n
        if there[gap]:
            use(n, gap)
        for a in pairs(gap).tolist():
            if not there[n]:
                return
            use(n, gap - a, a)
        for a in np.flatnonzero(there[1 : gap // 3 + 1])[::-1].tolist():
            for b in pairs(gap - a - 1, a + 1).tolist():
                if not there[n]:
                    return
                if not there[a + 1]:
                    break
                use(n, gap - a - 1 - b, b, a + 1)

    if there[limit]:
        use(limit)
    for n in range(limit - 1, 0, -1):
        if there[n]:
            fill(n)
    return out + _best_fit({n: int(left[n]) for n in np.flatnonzero(there).tolist()}, limit)


def _best_fit(left: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by counts: bins of equal contents are handled as one."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(contents, times):
        room = limit - sum(contents)
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([contents, times])

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                each = limit // n
                if todo >= each:
                    put((n,) * each, todo // each)
                    todo %= each
                if todo:
                    put((n,) * todo, 1)
                    todo = 0
                break
            room = rooms[k]
            contents, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            each = min(room // n, todo)
            bins = min(times, todo // each)
            if times > bins:
                by_room.setdefault(room, []).append([contents, times - bins])
                if len(by_room[room]) == 1:
                    bisect.insort(rooms, room)
            put(contents + (n,) * each, bins)
            todo -= each * bins
    return [(c, t) for r in by_room.values() for c, t in r]


def intervals(templates: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of the plan: rank r of a length lies in sequence first + (r - first rank)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in templates:
        offset = 0
        for n in lengths:
            at = rank.get(n, 0)
            out.append((n, at, at + times, sequence, offset))
            rank[n] = at + times
            offset += n
        sequence += times
    return out


def pieces(documents: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The documents' tokens, cut where a document has more than ``limit`` of them."""
    return documents.select("doc_id", "text").mapInArrow(_piece_rows(path, limit, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Packs all documents into few sequences of at most ``limit`` tokens; ``path`` is the tokenizer's file.

    A null text counts as empty: its only token is ``end``.  Each input row is
    packed, repeated ids and null ids included; nothing is dropped.  Pieces of
    equal length are interchangeable, so ties do not change the number of
    sequences.  An empty table gives an empty result.  Columns other than
    doc_id and text are not read.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    kept = scratch.keep(pieces(documents, path, limit, end)).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    counts = kept.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"))
    rows = intervals(plan({r.length: r.n for r in histogram.collect()}, limit))  # at most ``limit`` rows
    where = spark.createDataFrame([(a, list(b)) for a, b in _by_length(rows).items()], "length long, slots array<struct<first:long,last:long,sequence:long,offset:long>>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = kept.withColumn("own", own).join(firsts, ["length", "part"])  # on the keys that the window is dealt by
    ranked = ranked.withColumn("rank", F.col("own") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(where), "length")  # as many rows as lengths; slots follow the templates, not the pieces
    slot = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])), 1)
    return placed.withColumn("slot", slot).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def _by_length(rows):
    out: dict[int, list] = {}
    for n, first, last, sequence, offset in rows:
        out.setdefault(n, []).append((first, last, sequence, offset))
    return out


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
