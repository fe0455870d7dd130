"""Removal of repeated word spans by compaction of a de Bruijn graph.

The graph's edges are the windows of ``window`` consecutive words, each joining
its first and its last ``window - 1`` words.  Only windows that can repeat
enter it: each window is represented by the smallest hashed k-mer of words in
it (its anchor), equal windows have equal anchors, and a window whose anchor
occurs once in the corpus occurs once itself.

A path of windows is nonbranching where every occurrence of a window has the
same next window and every occurrence of that one has the same window before
it.  All windows of such a path occur at the same places, shifted, so one
lookup at the head of a path settles the path (a document's first window is a
head): where the head's source
coordinates (document, start) are not the smallest of all its occurrences, all
windows of that occurrence repeat an earlier one.  A window with several
predecessors is a head, and so is each successor of a window with several
successors; where such a successor has no other predecessor, its occurrences are
those of the edge to it, so one shuffle by window tells both.  The heads' verdicts
are joined to the documents, where each holds up to the next head.

Documents are handled in blocks of bounded size; a block reports each window
with the same neighbours once, at its first place, so a passage that a third of
all documents share costs at most a row per block and neighbour pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import Scratch, block_count, block_of, table
from .tokens import texts_of

#: Words of a repeated window.
WINDOW = 20
#: Words of an anchor.
ANCHOR = 6
#: Shares that the copies of one text are dealt to, at least; they grow with the blocks.
LEAST_SHARES = 64
#: Stands for the id of a document without one; sorts before all others.
NO_ID = -(2**63)

_ANCHOR, _COPY, _HEAD, _BEHIND = 0, 1, 2, 3


def _anchors_at(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-mer hashes, each window's smallest one, and which places start a whole window."""
    k = bw.run_hashes(h, anchor)
    width = window - anchor + 1
    if len(k) < width:
        return k, np.zeros(0, bw.U64), np.zeros(0, bool)
    least = bw.slide(k, width, np.minimum)
    return k, least, bw.fits(first, window)[: len(least)]


def _anchor_rows(window: int, anchor: int):
    width = window - anchor + 1

    def rows(batches):
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, raw, offsets in bw.chunks(batch.column("text")):
                starts, ends, first = bw.words(raw, offsets)
                k, least, ok = _anchors_at(bw.word_hashes(raw, starts, ends), first, window, anchor)
                if not ok.any():
                    continue
                pad = np.zeros(width - 1, bw.U64)
                chosen = bw.slide(np.concatenate([pad, np.where(ok, least, bw.U64(0)), pad]), width, np.maximum) == k
                chosen &= k > 0
                at = np.flatnonzero(chosen)
                own = np.repeat(blocks[a:b], np.diff(first))[at]
                order = np.lexsort((own, k[at]))
                key, own = k[at][order], own[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
                n = np.diff(np.r_[np.flatnonzero(new), len(key)])
                yield pa.RecordBatch.from_arrays([pa.array(own[new].astype(np.int32)), pa.array(key[new].view(np.int64)), pa.array(n.astype(np.int32))], names=["block", "a", "n"])

    return bw.giving_back(rows)


def _summary_rows(window: int):
    def rows(batches):
        for batch in batches:
            ids, shas = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                w = (t or "").encode().split()
                if len(w) >= window:
                    ids.append(i)
                    shas.append(_sha(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary())], names=["doc_id", "sha"])

    return bw.giving_back(rows)


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _words_key(text: str | None) -> int:
    """What Spark's xxhash64 makes of the digest of a text's words."""
    h = xxhash.xxh64_intdigest(_sha((text or "").encode().split()), 42)
    return h - (1 << 64) if h >> 63 else h


class _Block:
    """The candidate windows of a block's documents, in the order of (document, start)."""

    def __init__(self, docs: pa.Table, notes: pa.Table, window: int, anchor: int):
        kind = notes.column("kind").to_numpy()
        a = notes.column("a").to_numpy()
        known = np.sort(a[kind == _ANCHOR].view(bw.U64))
        h = notes.column("h").fill_null(0).to_numpy()
        copies = set(zip(a[kind == _COPY].tolist(), h[kind == _COPY].tolist()))
        copied = {i for i, _ in copies}
        ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.docs = ids[order], docs.take(pa.array(order))
        # rows may share an id, so a copy is told by its words, too
        texts = self.docs.column("text")
        self.copy = np.array([int(i) in copied and (int(i), _words_key(texts[k].as_py())) in copies for k, i in enumerate(self.ids)], bool)
        doc, start, h, before, after = [], [], [], [], []
        for lo, hi, raw, offsets in bw.chunks(self.docs.column("text")):
            s, e, first = bw.words(raw, offsets)
            words = bw.word_hashes(raw, s, e)
            _, least, ok = _anchors_at(words, first, window, anchor)
            if not ok.any() or not len(known):
                continue
            owner = np.repeat(np.arange(lo, hi), np.diff(first))[: len(least)]
            place = np.minimum(np.searchsorted(known, least), len(known) - 1)
            all_h = bw.run_hashes(words, window)
            at = np.flatnonzero(ok & (known[place] == least) & ~self.copy[owner])
            if not len(at):
                continue
            follows = np.r_[ok[1:], False] & np.r_[owner[1:] == owner[:-1], False]
            leads = np.r_[False, follows[:-1]]
            nxt = np.where(follows, np.r_[all_h[1:], bw.U64(0)], bw.U64(0))
            prv = np.where(leads, bw.mix(np.r_[bw.U64(0), words[: len(all_h) - 1]] ^ all_h) >> bw.U64(32), bw.U64(0))
            doc.append(owner[at])
            start.append(at - first[owner[at] - lo])
            h.append(all_h[at])
            before.append(prv[at])
            after.append(nxt[at])
        glue = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.start = glue(doc, np.int64), glue(start, np.int64)
        self.h, self.before, self.after = (glue(x, bw.U64) for x in (h, before, after))
        n = len(self.h)
        order = np.lexsort((self.start, self.ids[self.doc], self.after, self.before, self.h))
        x, y, z = self.h[order], self.before[order], self.after[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])] if n else np.zeros(0, bool)
        #: Whether a window is the block's first one with its neighbours. Rows that share an id and a start are at one place.
        self.lead = np.zeros(n, bool)
        self.lead[order[new]] = True
        lead_of = np.zeros(n, np.int64)
        if n:
            lead_of[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        at_place = (self.ids[self.doc] == self.ids[self.doc[lead_of]]) & (self.start == self.start[lead_of])
        self.later = ~self.lead & ~at_place


def _window_rows(window: int, anchor: int):
    def rows(docs: pa.Table, notes: pa.Table) -> pa.Table:
        b = _Block(docs, notes, window, anchor)
        k = np.flatnonzero(b.lead)
        packed = (b.start[k].astype(bw.U64) << bw.U64(32)) | b.before[k]
        return pa.table({"h": b.h[k].view(np.int64), "doc_id": b.ids[b.doc[k]], "at": packed.view(np.int64), "next": b.after[k].view(np.int64)})

    return bw.giving_back(rows)


def _place_key(ids: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit key for a document, a start and a window: rows may share an id, so the window is part of it."""
    return bw.mix(bw.mix(ids.astype(np.int64).view(bw.U64)) ^ bw.mix(starts.astype(bw.U64) + bw.U64(1)) ^ h)


def _kept_rows(window: int, anchor: int):
    def rows(docs: pa.Table, notes: pa.Table) -> pa.Table:
        b = _Block(docs, notes, window, anchor)
        own, n = b.ids[b.doc], len(b.h)
        key = _place_key(own, b.start, b.h)
        # what settles a window, where something does: the start of a run, the one before it, its own node, an earlier one in the block
        settled, verdict = np.ones(n, bool), np.zeros(n, bool)
        settled[1:] = (b.doc[1:] != b.doc[:-1]) | (b.start[1:] != b.start[:-1] + 1)
        for kind in (_BEHIND, _HEAD):
            t = notes.filter(pc.equal(notes.column("kind"), kind))
            if n and t.num_rows:
                keys = _place_key(t.column("a").to_numpy(), t.column("at").to_numpy(), t.column("h").to_numpy().view(bw.U64))
                order = np.argsort(keys)
                at = order[np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)]
                hit = keys[at] == key
                verdict[hit] = t.column("dup").to_numpy(zero_copy_only=False).astype(bool)[at[hit]]
                settled |= hit
        settled |= b.later
        verdict |= b.later
        repeat = verdict[np.maximum.accumulate(np.where(settled, np.arange(n), 0))] if n else verdict
        first_of = np.searchsorted(b.doc, np.arange(len(b.ids) + 1))
        out = []
        for d, text in enumerate(b.docs.column("text").to_pylist()):
            w = (text or "").encode().split()
            if b.copy[d]:
                out.append((len(w), len(w), hashlib.sha256(b"").hexdigest()))
                continue
            span = slice(first_of[d], first_of[d + 1])
            starts = b.start[span][repeat[span]]
            if not len(starts):
                out.append((len(w), 0, hashlib.sha256(b" ".join(w)).hexdigest()))
                continue
            edge = np.zeros(len(w) + 1, np.int64)
            edge[starts] += 1
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g])
            out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = {"doc_id": pa.array([None if i == NO_ID else i for i in b.ids.tolist()], pa.int64())}
        columns |= {c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())))}
        if "rest" in b.docs.column_names:
            columns["text"] = pa.array([x[3] if len(x) > 3 else "" if x[1] else t for x, t in zip(out, b.docs.column("text").to_pylist())], pa.string())
            columns["rest"] = b.docs.column("rest")
        return pa.table(columns)

    return bw.giving_back(rows)


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: bool = False) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that starts earlier, too.

    Earlier: in a document of a smaller id, or in the same document at a
    smaller start; rows that share an id count as one document, and a null id
    sorts before all others.  Windows are judged on the input.  Null and empty
    texts have no words; a text of fewer words than a window keeps all.
    Columns other than doc_id and text are not read, unless ``carry``: then
    the result also has text (the kept words joined by one blank; unchanged
    where nothing was removed) and rest, a struct of all other columns.

    Returns doc_id, n_words, n_removed, kept_sha256, a row for each input row.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has from 1 to window words")
    scratch = Scratch(documents.sparkSession)
    blocks = block_count(documents)
    docs = documents.select("doc_id", "text", block_of(F.col("doc_id"), blocks).alias("block"))

    found = docs.mapInArrow(_anchor_rows(window, anchor), "block int, a long, n int")
    often = found.withColumn("all", F.sum("n").over(Window.partitionBy("a"))).where("all > 1").select("block", "a").distinct()
    summary = docs.mapInArrow(_summary_rows(window), "doc_id long, sha binary")
    # a text that very many documents share is dealt to shares by the documents' ids; only a row per share meets at the text
    summary = summary.withColumn("share", block_of(F.col("doc_id"), LEAST_SHARES + blocks // LEAST_SHARES))
    shares = summary.groupBy("sha", "share").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.count("doc_id").alias("m"))
    text = Window.partitionBy("sha")
    firsts = shares.select("sha", "share", *[f(c).over(text).alias(c) for f, c in ((F.min, "least"), (F.sum, "n"), (F.sum, "m"))]).where("n > 1 and n = m").select("sha", "share", "least")
    copies = summary.join(firsts, ["sha", "share"]).where("doc_id > least").select(block_of(F.col("doc_id"), blocks).alias("block"), F.col("doc_id").alias("a"), F.xxhash64("sha").alias("h")).distinct()
    note = lambda df, kind, h=F.lit(None): df.select("block", F.lit(kind).alias("kind"), "a", F.lit(None).cast("long").alias("at"), h.cast("long").alias("h"), F.lit(None).cast("boolean").alias("dup"))
    notes = scratch.keep(note(often, _ANCHOR).unionByName(note(copies, _COPY, F.col("h"))))

    rows = docs.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_window_rows(window, anchor), "h long, doc_id long, at long, next long")
    rows = rows.repartition("h")  # once, packed: both windows below are on its key
    rows = rows.withColumns({"start": F.shiftrightunsigned("at", 32), "prev": F.col("at").bitwiseAND(0xFFFFFFFF)})
    place, same = F.struct("doc_id", "start"), Window.partitionBy("h")
    nodes = rows.withColumn("next_first", F.min(place).over(Window.partitionBy("h", "next"))).withColumns({
        "first": F.min(place).over(same),
        "joins": (F.min("prev").over(same) != F.max("prev").over(same)) | (F.col("prev") == 0),
        "forks": (F.min("next").over(same) != F.max("next").over(same)) & (F.col("next") != 0),
    })
    here = F.when(F.col("joins"), F.struct(F.lit(_HEAD).alias("kind"), F.col("start").alias("at"), F.col("h").alias("h"), (place != F.col("first")).alias("dup")))
    after = F.when(F.col("forks"), F.struct(F.lit(_BEHIND).alias("kind"), (F.col("start") + 1).alias("at"), F.col("next").alias("h"), (place != F.col("next_first")).alias("dup")))
    heads = nodes.where("joins or forks").select("doc_id", F.explode(F.array_compact(F.array(here, after))).alias("r"))
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    told = scratch.keep(heads.select(block_of(own, blocks).alias("block"), "r.kind", F.col("doc_id").alias("a"), "r.at", "r.h", "r.dup"))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if carry:
        rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("boolean").alias("none")]
        docs = documents.select("doc_id", "text", block_of(F.col("doc_id"), blocks).alias("block"), F.struct(*rest).alias("rest"))
        schema += f", text string, rest {docs.schema['rest'].dataType.simpleString()}"
    return docs.groupBy("block").cogroup(notes.unionByName(told).groupBy("block")).applyInArrow(_kept_rows(window, anchor), schema)


def without_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``documents`` with their texts rid of repeated spans, as ``remove_repeats`` does; n_chars, where there is one, follows the text."""
    found = remove_repeats(documents, window, anchor, carry=True)
    column = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if dict(documents.dtypes).get("n_chars") in ("int", "bigint"):
        column["n_chars"] = F.length("text").cast(dict(documents.dtypes)["n_chars"])
    return found.select(*[column.get(c, F.col("rest").getField(c)).alias(c) for c in documents.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
