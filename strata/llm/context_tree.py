"""Language-model scores by context-tree weighting.

A text is the bytes of its words, A-Z as a-z, joined by one blank, and an end
symbol.  Each byte is eight binary decisions; each decision has a tree of
contexts of the ``DEPTH`` bytes before.  A node holds how often its decision
came out 0 and 1; its Krichevsky-Trofimov estimate and the product of its
children's weighted estimates are mixed by halves, which gives the node's
weight against everything deeper.  A bit's probability mixes the estimates of
all depths along its path by those weights; where a context was never seen, the
path ends at the last one seen.  So every byte has a proper probability, and a
text's score is the sum of their logarithms.

The corpus is gathered as counts of (DEPTH + 1)-byte strings.  Subtrees below
the two latest bytes are worked out apart from each other; the levels above have
at most 256 * 255 nodes.  Texts are scored in blocks: a block names the strings
and words that it holds, gets their probabilities and counts by joins, and adds
them up.  No task holds the whole model.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import Scratch, estimated_bytes, remainder, table

#: Bytes of the longest context.
DEPTH = 5
#: Estimated bytes of input in one block.
BLOCK = 16 << 20
#: Different strings that a task holds before it passes them on.
PENDING = 3_000_000
#: Strings that it finds before it merges them with the others.
LOOSE = 500_000
#: Strings of whole subtrees that are worked out at once.
TOGETHER = 200_000

U64, _END = np.uint64, 0xFF
_LN2 = math.log(2.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after seven steps up."""
    y, low = x + 7.0, np.ones_like(x)
    for k in range(7):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _mixed(n0, n1, deeper):
    """ln of the weighted probability, and the weight of the node's own estimate."""
    own, below = log_kt(n0, n1) - _LN2, deeper - _LN2
    both = np.logaddexp(own, below)
    return both, np.exp(own - both)


class Subtrees:
    """The nodes of depth 2 to DEPTH of some strings, given with their counts; whole subtrees below two bytes."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        byte = code & U64(255)
        j = np.arange(8, dtype=U64)
        prefix = (U64(1) << j) | (byte[:, None] >> (U64(8) - j))
        self.bit = ((byte[:, None] >> (U64(7) - j)) & U64(1)).astype(bool)
        self.keys, self.at, self.n0, self.n1 = {}, {}, {}, {}
        for d in range(2, depth + 1):
            context = (code >> U64(8)) & U64((1 << 8 * d) - 1)
            self.keys[d], at = np.unique((context[:, None] << U64(8)) | prefix, return_inverse=True)
            self.at[d] = at.reshape(prefix.shape)
            flat, ones, size = self.at[d].ravel(), self.bit.ravel(), len(self.keys[d])
            each = np.repeat(n, 8)
            self.n1[d] = np.bincount(flat, each * ones, size)
            self.n0[d] = np.bincount(flat, each * ~ones, size)
        self.weight = {depth: np.ones(len(self.keys[depth]))}
        self.log = {depth: log_kt(self.n0[depth], self.n1[depth])}
        for d in range(depth - 1, 1, -1):
            above = ((self.keys[d + 1] >> U64(8)) & U64((1 << 8 * d) - 1)) << U64(8) | (self.keys[d + 1] & U64(255))
            deeper = np.bincount(np.searchsorted(self.keys[d], above), self.log[d + 1], len(self.keys[d]))
            self.log[d], self.weight[d] = _mixed(self.n0[d], self.n1[d], deeper)

    def log10(self, top: Top) -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before."""
        total, left, last = top.of(self.keys[2][self.at[2]])
        for d in range(2, self.depth + 1):
            n0, n1, at = self.n0[d], self.n1[d], self.at[d]
            seen = (n0 + n1 > 0)[at] & (left > 0)
            own = ((n1 + 0.5) / (n0 + n1 + 1.0))[at]
            w = self.weight[d][at]
            total = np.where(seen, total + left * w * own, total + left * last)
            left = np.where(seen, left * (1 - w), 0.0)
            last = np.where(seen, own, last)
        p = np.where(self.bit, total, 1.0 - total)
        return np.log10(p).sum(axis=1)


class Top:
    """The nodes of depth 0 and 1, from those of depth 1 with their children's product."""

    def __init__(self, context: np.ndarray, prefix: np.ndarray, n0: np.ndarray, n1: np.ndarray, deeper: np.ndarray):
        size = 256 * 256
        zero, one, below = np.zeros(size), np.zeros(size), np.zeros(size)
        k = context * 256 + prefix
        np.add.at(zero, k, n0)
        np.add.at(one, k, n1)
        np.add.at(below, k, deeper)
        log1, w1 = _mixed(zero, one, below)
        seen1 = zero + one > 0
        up = lambda x: x.reshape(256, 256).sum(axis=0)
        zero0, one0 = up(zero), up(one)
        _, w0 = _mixed(zero0, one0, up(np.where(seen1, log1, 0.0)))
        seen0 = zero0 + one0 > 0
        kt0 = np.tile((one0 + 0.5) / (zero0 + one0 + 1.0), 256)
        w0, seen0 = np.tile(w0, 256), np.tile(seen0, 256)
        kt1 = (one + 0.5) / (zero + one + 1.0)
        total0, left0 = np.where(seen0, w0 * kt0, 0.5), np.where(seen0, 1 - w0, 0.0)
        self.total = np.where(seen1, total0 + left0 * w1 * kt1, total0 + left0 * kt0)
        self.left = np.where(seen1, left0 * (1 - w1), 0.0)
        self.last = np.where(seen1, kt1, kt0)

    def of(self, keys2: np.ndarray):
        """What is mixed so far, what is left to mix, and the last estimate, for nodes of depth 2."""
        k = (((keys2 >> U64(8)) & U64(255)) * U64(256) + (keys2 & U64(255))).astype(np.int64)
        return self.total[k], self.left[k], self.last[k]


# -- texts ----------------------------------------------------------------------


def plain(texts: pa.Array) -> list[bytes]:
    return [b" ".join((t or b"").lower().split()) for t in texts.cast(pa.binary()).to_pylist()]


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each text's every byte with the ``depth`` before (the end symbol before the first), ends included, and how many each text has."""
    lead = bytes([_END]) * depth
    raw = np.frombuffer(lead + (bytes([_END]) + lead).join(texts) + bytes([_END]), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.zeros(len(raw) - depth, U64)
    for k in range(depth + 1):
        code = (code << U64(8)) | raw[k : k + len(code)]
    starts = np.cumsum(n + depth) - n - depth
    keep = np.zeros(len(code) + 1, np.int32)
    keep[starts] += 1
    np.add.at(keep, np.minimum(starts + n, len(code)), -1)
    return code[np.cumsum(keep[:-1]) > 0], n


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key (below zero) of each word, and how many each text has."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    starts, ends, first = bw.words(raw, offsets)
    return (bw.word_hashes(raw, starts, ends) | U64(1 << 63)).view(np.int64), np.diff(first)


def _runs(texts: list[bytes], size: int = 1 << 20):
    """(first, last) of runs of texts of about ``size`` bytes."""
    first, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield first, k + 1
            first, n = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _held_rows(depth: int, kind: str):
    """(block, key, n): the keys in a block's texts and how often its training texts have them."""

    def rows(batches):
        pending: dict[int, list] = defaultdict(list)
        loose = 0  # keys not merged yet

        def merge() -> int:
            for block, found in pending.items():
                pending[block] = [_summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]
            return sum(len(found[0][0]) for found in pending.values())

        def flush():
            merge()
            for block, [(keys, n)] in pending.items():
                for k in range(0, len(keys), 1 << 16):
                    part = keys[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[k : k + (1 << 16)])], names=["block", "key", "n"])
            pending.clear()

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False)
            texts = plain(batch.column("text"))
            for block in np.unique(blocks):
                for learn in (True, False):
                    own = [texts[k] for k in np.flatnonzero((blocks == block) & (train == learn))]
                    for a, b in _runs(own):
                        keys = strings_of(own[a:b], depth)[0].view(np.int64) if kind == "strings" else words_of(own[a:b])[0]
                        found, n = np.unique(keys, return_counts=True)
                        pending[int(block)].append((found, n * learn))
                        loose += len(found)
                        if loose > LOOSE:
                            loose = 0
                            if merge() > PENDING:
                                yield from flush()
        yield from flush()

    return bw.giving_back(rows)


def _subtree_rows(depth: int, top):
    """Works on rows sorted by their two latest bytes. Without ``top``: the nodes of depth 2; with it, the strings' probabilities."""

    def made(code, n):
        t = Subtrees(code, n.astype(float), depth)
        if top is not None:
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(t.log10(top.value))], names=["key", "value"])
        k = t.keys[2]
        return pa.RecordBatch.from_arrays(
            [pa.array(((k >> U64(8)) & U64(255)).astype(np.int32)), pa.array((k & U64(255)).astype(np.int32)), pa.array(t.n0[2]), pa.array(t.n1[2]), pa.array(t.log[2])],
            names=["context", "prefix", "n0", "n1", "log"],
        )

    def rows(batches):
        code, n, waiting = [], [], 0
        for batch in batches:
            code.append(batch.column("key").to_numpy().view(U64))
            n.append(batch.column("n").to_numpy())
            waiting += len(n[-1])
            if waiting >= TOGETHER:
                c, m = np.concatenate(code), np.concatenate(n)
                two = (c >> U64(8)) & U64(0xFFFF)
                cut = int(np.flatnonzero(two != two[-1])[-1]) + 1 if (two != two[-1]).any() else 0  # the last subtree may go on
                if cut:
                    yield made(c[:cut], m[:cut])
                code, n, waiting = [c[cut:]], [m[cut:]], len(c) - cut
        if waiting:
            yield made(np.concatenate(code), np.concatenate(n))

    return bw.giving_back(rows)


class _Lookup:
    """A hash table from keys to values, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2.5 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.int64).min + 1)
        self.values = np.zeros(1 << bits)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            empty = self.keys[at] == np.iinfo(np.int64).min + 1
            self.keys[at[empty]] = keys[left[empty]]  # of several, the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _start(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for keys without one), and which keys have one."""
        at = self._start(keys)
        found = self.keys[at]
        out, has = self.values[at], found == keys
        todo = np.flatnonzero(~has & (found != np.iinfo(np.int64).min + 1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            has[todo[hit]] = True
            on = ~hit & (found != np.iinfo(np.int64).min + 1)
            todo, at = todo[on], at[on]
        out[~has] = 0.0
        return out, has


def _score_rows(depth: int, tokens: int, distinct: int, ends: int):
    whole = math.log10(tokens + 0.1 * (distinct + 1))

    def rows(docs: pa.Table, told: pa.Table) -> pa.Table:
        keys, values = told.column("key").to_numpy(), told.column("value").to_numpy()
        strings = _Lookup(keys[keys >= 0], values[keys >= 0])
        elsewhere = _Lookup(keys[keys < 0], values[keys < 0])
        train = docs.column("train").to_numpy()
        texts = plain(docs.column("text").combine_chunks() if isinstance(docs.column("text"), pa.ChunkedArray) else docs.column("text"))
        # words that only this block's training texts have are counted here
        here_k, here_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = [t for t, learn in zip(texts, train) if learn]
        for a, b in _runs(own):
            k, n = np.unique(words_of(own[a:b])[0], return_counts=True)
            here_k.append(k)
            here_n.append(n)
        k, n = _summed(np.concatenate(here_k), np.concatenate(here_n))
        here = _Lookup(k, n.astype(float))
        out = {c: np.zeros(len(texts), np.int64) for c in ("n_tokens", "n_known")} | {c: np.zeros(len(texts)) for c in ("base_score", "score")}
        out["n_bytes"] = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in _runs(texts):
            code, n = strings_of(texts[a:b], depth)
            p, has = strings.of(code.view(np.int64))
            if not has.all():
                raise RuntimeError("a block was not told of all its strings")
            out["score"][a:b] = np.add.reduceat(p, np.cumsum(n) - n)
            words, m = words_of(texts[a:b])
            c, has = elsewhere.of(words)
            c = np.where(has, c, here.of(words)[0])
            owner = np.repeat(np.arange(b - a), m)
            count = lambda w=None: np.bincount(owner, w, b - a)
            out["n_tokens"][a:b] = m + 1
            out["n_known"][a:b] = count((c > 0).astype(float)) + (ends > 0)
            out["base_score"][a:b] = count(np.log10(c + 0.1)) + math.log10(ends + 0.1) - (m + 1) * whole
        size = len(texts)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pa.array(~train), "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": pa.array(np.full(size, tokens)), "base_score": out["base_score"], "score": out["score"], "n_bytes": out["n_bytes"]})

    return bw.giving_back(rows)


def score_texts(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores all texts under the model of those whose crc32(doc_id) modulo 10 is not 0.

    Null and blank texts are the end symbol alone.  A null id is of remainder 0:
    held out.  Repeated rows are learnt from as often as they stand and scored
    alike.  Without training texts every bit has probability one half.  Other
    columns are not read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10) and n_bytes of the scored text without its end.
    """
    if not 2 <= depth <= 6:
        raise ValueError("contexts have from 2 to 6 bytes")
    spark = documents.sparkSession
    scratch = Scratch(spark)
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    parts = max(1, -(-min(split, estimated_bytes(documents)) // BLOCK))
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    docs = documents.select("doc_id", "text", (remainder(F.col("doc_id"), 10) != 0).alias("train"), block.alias("block"))
    held = lambda kind: docs.mapInArrow(_held_rows(depth, kind), "block long, key long, n long")

    strings = scratch.keep(held("strings"))
    counted = scratch.keep(strings.groupBy("key").agg(F.sum("n").alias("n")))
    two = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    sorted_by_two = lambda df: df.repartition(two).sortWithinPartitions(two, "key")
    nodes = sorted_by_two(counted.where("n > 0")).mapInArrow(_subtree_rows(depth, None), "context int, prefix int, n0 double, n1 double, log double")
    first = nodes.groupBy("context", "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log")).toPandas()  # 256 * 255 rows at most
    top = spark.sparkContext.broadcast(Top(*(first[c].to_numpy() for c in ("context", "prefix", "n0", "n1", "log"))))
    model = sorted_by_two(counted).mapInArrow(_subtree_rows(depth, top), "key long, value double")

    same = Window.partitionBy("key")
    words = held("words").withColumns({"value": F.sum("n").over(same), "blocks": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("block"))})
    words = scratch.keep(words.select("block", "key", F.col("value").cast("double").alias("value"), (F.col("blocks") > 1).alias("shared"), (F.col("nth") == 1).alias("lead")))
    seen = words.where("lead and value > 0").agg(F.count("*").alias("distinct"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("tokens")).first()
    ends = docs.where("train").count()
    tokens, distinct = int(seen.tokens) + ends, seen.distinct + (ends > 0)

    told = words.where("shared").select("block", "key", "value").union(strings.join(model, "key").select("block", "key", "value"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score_rows(depth, tokens, distinct, ends), schema)


def _bytes(size: str) -> int:
    """Spark's notation of sizes, in bytes."""
    size = size.lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1:], 0)
    return int(size[:-1] if unit else size) << unit


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
