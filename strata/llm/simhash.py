"""Near copies by SimHash, with pigeonring filtering of the candidate pairs.

A fingerprint's 64 bits are dealt to six segments on a ring.  If two
fingerprints differ in at most three bits, then from some segment on every
chain of l consecutive segments differs in at most l * 3 / 6 bits (the
pigeonring principle).  So the first segment of that chain agrees, one of the
next two does, and two of the next four: some three segments agree in all.
Fingerprints meet in an index on each three of the six segments (32 bits or
so); pairs that meet must pass the chains before their full distance is taken.

Only distinct fingerprints enter the index.  Within a bucket pairs are compared
in place and only a spanning forest leaves it, so large groups of near copies
give no more edges than members.  A bucket with more than ``HOT`` fingerprints
is split by a fourth segment of the bits left over: at most three of them
differ, so of four parts one agrees, and no pair is lost.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import Scratch, table
from .components import connected

#: Differing bits up to which fingerprints link.
DISTANCE = 3
#: Words of a shingle.
SHINGLE = 3
#: Seed of the shingles' hash.
SEED = 42
#: Fingerprints of one bucket beyond which it is split further.
HOT = 4096

_WIDTHS = (11, 11, 11, 11, 10, 10)
_LOWS = tuple(sum(_WIDTHS[:k]) for k in range(6))
_TRIPLES = tuple(combinations(range(6), 3))


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    sizes, hashes = [], []
    for text in texts:
        words = (text or b"").lower().split()
        if len(words) > shingle:
            parts = [words[k:] for k in range(shingle)]
            grams = map(b" ".join, zip(*parts))
            own = list(map(xxhash.xxh64_intdigest, grams, repeat(SEED)))
        else:
            own = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
        sizes.append(len(own))
        hashes.append(np.array(own, np.uint64))
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, (n, h) in enumerate(zip(sizes, hashes)):
        if n:
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k] = weights[2 * bits.sum(axis=0, dtype=np.int64) > n].sum(dtype=np.uint64)
    return out


def _fingerprint_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = pa.array(fingerprints_of(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fps], names=["doc_id", "text_hash", "fp"])

    return bw.giving_back(rows)


def chains_hold(x: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether some chain of segments of the differing bits ``x`` keeps within its proportional budgets."""
    parts = np.stack([np.bitwise_count((x >> np.uint64(lo)) & np.uint64((1 << w) - 1)) for lo, w in zip(_LOWS, _WIDTHS)]).astype(np.int16)
    some = np.zeros(len(x), bool)
    for first in range(6):
        sums = np.cumsum(parts[[(first + k) % 6 for k in range(6)]], axis=0)
        some |= (sums <= (np.arange(1, 7) * distance // 6)[:, None]).all(axis=0)
    return some


def _forest(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the smallest one it is linked with inside the buckets. Keys are sorted."""
    values, node = np.unique(fps, return_inverse=True)
    root = np.arange(len(values))
    at, apart = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[keys[at] == keys[at + apart]]
        a, b = node[at], node[at + apart]
        new = root[a] != root[b]
        a, b = a[new], b[new]
        x = values[a] ^ values[b]
        held = chains_hold(x, distance)
        held[held] = np.bitwise_count(x[held]) <= distance
        a, b = a[held], b[held]
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            left = root[a] != root[b]
            a, b = a[left], b[left]
        apart += 1
        at = at[at + apart < len(keys)]
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _edge_rows(distance: int):
    def rows(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole:
                yield out(*_forest(keys[:whole], fps[:whole], distance))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield out(*_forest(keys, fps, distance))

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return bw.giving_back(rows)


def _bits(low: int, width: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)


def _index(fps: DataFrame, hot: int) -> DataFrame:
    """(key, fp): each fingerprint under each three of its segments; a fourth one, too, in large buckets."""
    keys = []
    for k, triple in enumerate(_TRIPLES):
        key = F.lit(k).cast("long")
        for s in triple:
            key = F.shiftleft(key, _WIDTHS[s]).bitwiseOR(_bits(_LOWS[s], _WIDTHS[s]))
        keys.append(key)
    index = fps.select("fp", F.posexplode(F.array(*keys)).alias("triple", "key"))
    large = index.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("large"))
    rest = []
    for triple in _TRIPLES:
        left = [(lo, w) for s, (lo, w) in enumerate(zip(_LOWS, _WIDTHS)) if s not in triple]
        (a, wa), (b, wb), (c, wc) = left
        parts = [_bits(a, wa), _bits(b, wb), _bits(c, wc // 2), _bits(c + wc // 2, wc - wc // 2)]
        rest.append(F.array(*[F.lit(k << 12).cast("long").bitwiseOR(p).bitwiseOR(1 << 15) for k, p in enumerate(parts)]))
    parts = F.when(F.col("large"), F.element_at(F.array(*rest), F.col("triple") + 1)).otherwise(F.array(F.lit(0).cast("long")))
    return index.join(large, "key", "left").select("fp", F.explode(parts).alias("part"), "key").select(F.shiftleft("key", 16).bitwiseOR(F.col("part")).alias("key"), "fp")


def near_copies(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Each document's fingerprint and the group of documents that links of at most ``distance`` bits join.

    A-Z count as a-z.  A text of fewer words than a shingle is one shingle; a
    null text or one without words has fingerprint zero and links like any
    other.  Every input row gives a row, repeated ids included; a null id never
    is the smallest of a group unless the group has no other.  Columns other
    than doc_id and text are not read.

    Returns doc_id, text_hash, fp long, root long (the group's name),
    component_id (the group's smallest doc_id).
    """
    if not 0 <= distance <= 3:
        raise ValueError("three of six segments agree only up to three differing bits")
    scratch = Scratch(documents.sparkSession)
    marked = scratch.keep(documents.select("doc_id", "text", _text_hash().alias("text_hash")).mapInArrow(_fingerprint_rows(shingle), "doc_id long, text_hash long, fp long"))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    index = _index(fps.select("fp"), hot)
    edges = index.repartition("key").sortWithinPartitions("key").mapInArrow(_edge_rows(distance), "a long, b long")
    roots = connected(edges, scratch)
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = member.join(component, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The row of the smallest id of each group of near copies, whole; of several such rows, one. A null id gives way to any other."""
    scratch = Scratch(documents.sparkSession)
    found = scratch.keep(near_copies(documents))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = scratch.keep(found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")))
    of = (F.col("first_hash") == _text_hash()) & F.col("first_id").eqNullSafe(F.col("doc_id"))
    kept = documents.join(first, of, "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if not repeated:  # rows of one id and text, of which one stays, are rare; only then are the kept texts dealt out by them
        return kept
    nth = F.row_number().over(Window.partitionBy("doc_id", _text_hash()).orderBy(F.lit(0)))
    return kept.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
