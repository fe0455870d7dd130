"""Toxicity by noisy-channel deobfuscation: disguised words are restored first, then the text is scored.

Disguises are leetspeak, parted letters and repeated letters.  A suspect token
spans a lattice: each character may stand for itself, for a letter that it
imitates, for nothing (a separator inside a word) or for a repetition of the
letter before.  Viterbi search finds the string of the highest probability
under a character trigram model and the channel.  Words and restored words are
scored by letter n-grams that mark toxic documents, and a logistic model of the
highest word scores gives the document's score.

Everything is fitted on all labelled rows outside the held-out fold: words and
n-grams are counted by tasks and summed by Spark, and the logistic layer takes
Newton steps whose sums Spark forms.  Only the model leaves the tasks, n-grams
that mark toxic texts and letter trigrams; it is sent to all tasks.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import Scratch, delete, remainder, table
from .tokens import slices, texts_of

#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Word scores that one task keeps.
CACHE = 200_000
#: Keys whose counts a task of the fit keeps before it hands them on to be summed.
COUNTED = 200_000
#: Characters of a token that are restored at once.
PIECE = 48
#: Characters of texts, and of new tokens, that are looked at together.
TOGETHER = 1 << 20
#: Labels up to which they are sent to all tasks to meet the documents; beyond, the join shuffles.
BROADCAST_ROWS = 400_000

# Characters and the letters that they imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou",
}
_EDGE = ".,;:!?\"'()[]{}<>%*&#$|_-…«»„“”‘’¿¡/\\+=~^`"
_PARTING = "._-*'/\\~^`,:; "
_SUSPECT = re.compile(r"[^\W\d_][^\s]*[0-9@$!|+(<€£¡._*#'/\\~^`:-][^\s]*[^\W_]|[0-9@$!|+(<€£¡][^\s]*[^\W\d_]|[^\W\d_][0-9@$!|+(<€£¡]|([^\W\d_])\1\1")
_PARTED = re.compile(r"(?<![^\s])[^\W_](?:[ ._*/\\-]+[^\W_]){2,}(?![^\s.,;:!?])|(?<![^\s])[^\W\d_@$!](?: [^\s]){2,}(?![^\s])")
#: Runs of a symbol at either end of a token, and marks that belong to the sentence: no part of a word.
_RUNS = re.compile(r"^(?:([^\w])\1+)|(?:([^\w])\2+)[.,;:!?]*$")
_MARKS = ".,;:?\"'()[]{}>«»„“”‘’¿"
#: Repetitions in long tokens: letters, and what parts them.
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_LONG_PARTING = re.compile(r"([._'/\\~^`,:;-])[._'/\\~^`,:;-]+|(?<=(\*))\*{4,}")
_GRAMS = (4, 5)
#: What ``_SUSPECT`` asks of a token: one of the first, or one of the second before its end, or a letter three times.
_ALONE, _BEFORE = "0123456789@$!|+(<€£¡", "._*#'/\\~^`:-"


def _pieces(token: str) -> list[str]:
    """A token's parts to restore: itself, or overlapping pieces where it is long even without its repetitions."""
    if len(token) > PIECE:
        token = _LONG_PARTING.sub(lambda m: m[1] or "", _STRETCHED.sub(r"\1\1\1", token))
    return [token[k : k + PIECE] for k in range(0, max(len(token) - PIECE // 2, 1), PIECE // 2)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words or texts, parted and followed by line ends, and where each starts."""
    joined = "\n".join(words) + "\n" * max(_GRAMS)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), np.r_[0, ends[:-1]]


def _flags(chars: str) -> np.ndarray:
    """By code point, whether it is one of ``chars``; the last place stands for all beyond."""
    out = np.zeros(max(map(ord, chars)) + 2, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_ALONE, _IS_BEFORE, _IS_PARTING = _flags(_ALONE), _flags(_BEFORE), _flags(" ._*/\\-")
_IS_SPACE = _flags("".join(c for c in map(chr, range(0x3001)) if c.isspace()))


def _is_one(codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return flags[np.minimum(codes, len(flags) - 1)]


def _may_part(texts: list[str]) -> set[int]:
    """The places of the texts in which ``_PARTED`` can find something; all in which it does are among them."""
    codes, starts = _codes(texts)
    codes = np.r_[np.uint32(10), codes]  # what stands before and behind a text counts as white space
    space, blank = _is_one(codes, _IS_SPACE), codes == 32
    spaced = np.flatnonzero(space[:-6] & blank[2:-4] & blank[4:-2] & space[6:])  # three characters, a blank between each
    at = np.flatnonzero(~_is_one(codes, _IS_PARTING))
    apart = np.diff(at) > 1
    parted = at[:-2][apart[:-1] & apart[1:] & space[at[:-2] - 1]] - 1  # two that start and stand alone between what parts them
    return set((np.searchsorted(starts, np.r_[spaced, parted], "right") - 1).tolist())


def _may_hide(tokens: list[str]) -> np.ndarray:
    """Whether each token can have a piece that ``_SUSPECT`` finds; all that do are among them."""
    codes, starts = _codes(tokens)
    hides = _is_one(codes, _IS_ALONE)
    hides[:-1] |= _is_one(codes[:-1], _IS_BEFORE) & (codes[1:] != 10)
    hides[:-2] |= (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:])
    return np.logical_or.reduceat(hides, starts) | (np.fromiter(map(len, tokens), np.int64, len(tokens)) > PIECE)


def _places(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits of the ``n`` characters from each place on."""
    h = np.zeros(len(codes) - n + 1, np.uint32)
    for k in range(n):
        h *= np.uint32(0x9E3779B1)
        h += codes[k : len(codes) - n + 1 + k]
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def grams(word: str) -> set[str]:
    """The word with its ends marked, and its letter n-grams."""
    w = f"^{word}$"
    return {w} | {w[k : k + n] for n in _GRAMS for k in range(len(w) - n + 1)}


@dataclass
class Model:
    """Weights of n-grams, the character model and the logistic layer."""

    weights: dict[str, float] = field(default_factory=dict)
    trigrams: dict[str, float] = field(default_factory=dict)
    layer: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0, 0.0)
    unseen: float = -9.0

    def __post_init__(self):
        self._cache: dict[str, float] = {}
        self._filter: tuple[int, dict[int, np.ndarray]] | None = None
        known = [self.unseen, 0.0, *self.trigrams.values()]
        self._margin = 2 * (max(known) - min(known)) + 8.0

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_filter": None}

    # -- the noisy channel ------------------------------------------------
    def restore(self, token: str) -> str:
        """The likeliest word behind a token, by Viterbi search over its lattice.

        A state is the two latest letters and whether the last one is being
        repeated, which is all that the character model and the channel look
        back to, so the search is exact.  Of two states the worse one can still
        win by what its next two letters and a repetition gain on the other's,
        no more; beyond that margin it is let go.
        """
        tri, unseen, margin = self.trigrams.get, self.unseen, self._margin
        paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for ch in token:
            new: dict[str, tuple[float, str]] = {}

            def offer(state, score, text, new=new):
                if state not in new or new[state] < (score, text):
                    new[state] = (score, text)

            letters = IMITATES.get(ch, "")
            plain, dropped = ch.isalpha(), -(12.0 if ch.isalnum() else 6.0 if letters else 1.0)
            imitated = -math.log(1.5 + len(letters))
            for state, (score, text) in paths.items():
                two, again = state[:2], state[:2] + "+"
                repeated = score - (0.5 if state[2:] else 3.5)
                if plain:
                    offer(state[1] + ch, score + tri(two + ch, unseen), text + ch)
                    if state[1] == ch:
                        offer(again, repeated, text)
                else:
                    offer(state, score + dropped, text)
                for letter in letters:
                    offer(state[1] + letter, score + imitated + tri(two + letter, unseen), text + letter)
                    if state[1] == letter:
                        offer(again, repeated - 0.5, text)
            least = max(new.values())[0] - margin
            paths = {k: v for k, v in new.items() if v[0] >= least}
        return max((s + tri(state[:2] + "$", unseen), text) for state, (s, text) in paths.items())[1]

    # -- words ------------------------------------------------------------
    def of_word(self, word: str) -> float:
        return max(map(self.weights.get, grams(word) & self.weights.keys()), default=0.0) if word else 0.0

    def _filters(self) -> tuple[int, dict[int, np.ndarray]]:
        """Bits of a hash, and for each length of n-grams which hashes those with weights have."""
        if self._filter is None:
            own = {n: [g for g in self.weights if len(g) == n] for n in _GRAMS}
            bits = min(25, max(16, (256 * max(map(len, own.values()))).bit_length()))
            held = {n: np.zeros(1 << bits, bool) for n in _GRAMS}
            for n, found in own.items():
                if found:
                    codes, starts = _codes(found)
                    held[n][_places(codes, n, bits)[starts]] = True
            self._filter = bits, held
        return self._filter

    def of_words(self, words: list[str]) -> list[float]:
        """``of_word`` of each: a filter tells at once which words have no n-gram with a weight, which are most."""
        bits, held = self._filters()
        marked = [f"^{w}$" for w in words]
        codes, starts = _codes(marked)
        hits = np.zeros(len(codes), bool)
        for n in _GRAMS:
            hits[: len(codes) - n + 1] |= held[n][_places(codes, n, bits)]
        get, found = self.weights.get, np.logical_or.reduceat(hits, starts).tolist()
        return [(self.of_word(w) if hit else get(m, 0.0)) if w else 0.0 for w, m, hit in zip(words, marked, found)]

    def _hidden(self, token: str) -> float:
        """The highest score of the words that are restored from a token."""
        found = 0.0
        for piece in _pieces(token):
            if _SUSPECT.search(piece):
                for shape in {piece.strip(_EDGE), _RUNS.sub("", piece).strip(_MARKS)}:
                    if _SUSPECT.search(shape):
                        found = max(found, self.of_word(self.restore(shape)))
        return found

    def _meet(self, tokens: set[str]) -> None:
        """Scores the tokens that are not known yet, as they stand and restored."""
        new = tokens.difference(self._cache)
        if len(self._cache) + len(new) > CACHE:
            self._cache.clear()
            new = tokens
        for run in slices(new, TOGETHER) if sum(map(len, new)) > 2 * TOGETHER else [list(new)] if new else []:
            found = self.of_words([t.strip(_EDGE) for t in run])
            for k in np.flatnonzero(_may_hide(run)).tolist():
                found[k] = max(found[k], self._hidden(run[k]))
            self._cache.update(zip(run, found))

    def features(self, texts: list[str | None]) -> list[tuple[float, float, float, float]]:
        """For each text the mean of the three highest word scores, their highest, and how many words are marked, in all and in a thousand."""
        out = []
        for lows in slices(((t or "").lower() for t in texts), TOGETHER):
            tokens = [set(low.split()) for low in lows]
            self._meet(set().union(*tokens))
            parted = _may_part(lows)
            for k, (low, own) in enumerate(zip(lows, tokens)):
                scores = [s for s in map(self._cache.__getitem__, own) if s]
                for m in _PARTED.finditer(low) if k in parted else ():
                    letters = [x for x in re.split(r"[ ._*/\\-]+", m[0]) if x]
                    for j in range(0, len(letters), 32):
                        scores.append(self.of_word(self.restore("".join(letters[j : j + 40]).strip(_EDGE))))
                top = sorted(scores, reverse=True)[:3]
                marked = sum(s > 2.0 for s in scores)
                out.append((sum(top) / 3, top[0] if top else 0.0, math.log1p(marked), math.log1p(1000.0 * marked / max(len(own), 1))))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        z = [self.layer[0] + sum(w * x for w, x in zip(self.layer[1:], f)) for f in self.features(texts)]
        return [1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, v)))) for v in z]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _gram_counts(words: list[set[str]], toxic: np.ndarray, side: list[int]) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """How often each n-gram of the toxic texts stands in toxic texts of either side, and in all texts of either side."""
    counts = {(s, t): Counter() for s in (0, 1) for t in (0, 1)}
    for own, label, s in zip(words, toxic, side):
        counts[s, int(label)].update(own)
    bad: dict[str, list[int]] = {}
    for word in counts[0, 1].keys() | counts[1, 1].keys():
        m, n = counts[0, 1][word], counts[1, 1][word]
        for g in grams(word):
            c = bad.setdefault(g, [0, 0])
            c[0] += m
            c[1] += n
    every: dict[str, list[int]] = {g: [0, 0] for g in bad}
    for word in set().union(*counts.values()):
        m, n = (counts[s, 0][word] + counts[s, 1][word] for s in (0, 1))
        for g in grams(word) & bad.keys():
            c = every[g]
            c[0] += m
            c[1] += n
    return bad, every


def _weights(bad: dict[str, list[int]], every: dict[str, list[int]], sides: tuple[int, ...], rate: float, prior: float = 2.0) -> dict[str, float]:
    """Log odds of toxicity given an n-gram, by the texts of some sides, shrunk to the base rate; only those that raise it."""
    rate = max(1e-4, min(0.5, rate))
    base = math.log(rate / (1 - rate))
    out = {}
    for g, b in bad.items():
        p = (sum(b[s] for s in sides) + prior * rate) / (sum(every[g][s] for s in sides) + prior)
        w = math.log(p / (1 - p)) - base
        if w > 1.0:
            out[g] = w
    return out


def _trigrams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[k - 2 : k + 1] for k in range(2, len(w))]


def _log_probabilities(tri: dict[str, int]) -> dict[str, float]:
    two = Counter()
    for g, n in tri.items():
        two[g[:2]] += n
    return {g: math.log((n + 0.1) / (two[g[:2]] + 4.0)) for g, n in tri.items()}


def _characters(texts: list[set[str]]) -> dict[str, float]:
    """Log probabilities of character trigrams."""
    tri = Counter()
    for word, n in Counter(w for t in texts for w in t if w.isalpha()).items():
        for g in _trigrams(word):
            tri[g] += n
    return _log_probabilities(tri)


def _newton(sums, size: int, ridge: float = 0.3) -> tuple[float, ...]:
    """Weights of a ridge-regularised logistic regression; ``sums`` gives the likelihood's gradient and information at weights."""
    w = np.zeros(size)
    keep = np.r_[0.0, np.full(size - 1, ridge)] + 1e-9
    for _ in range(40):
        gradient, information = sums(w)
        step = np.linalg.solve(information + np.diag(keep + 1e-6), gradient - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = np.c_[np.ones(len(x)), x]
    return _newton(lambda w: _sums(x, y, w), x.shape[1])


def _words(text: str | None) -> set[str]:
    return {x for w in (text or "").lower().split() if (x := w.strip(_EDGE))}


def _side(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) >> 7 & 1


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of labelled texts. With no rows, or rows of one label only, no text scores as toxic."""
    y = np.array(toxic, int)
    if len(y) == 0 or y.min() == y.max():
        return Model(layer=(-4.0, 0.0, 0.0, 0.0, 0.0))
    one: dict[str, str] = {}  # equal words are one object: most words stand in many texts
    words = [{one.setdefault(x, x) for x in _words(t)} for t in texts]
    del one
    trigrams = _characters(words)
    side = [_side(t) for t in texts]
    bad, every = _gram_counts(words, y, side)

    def weights(*sides: int) -> dict[str, float]:
        size = lambda labels: sum(len(w) for w, t, s in zip(words, y, side) if s in sides and t in labels)
        return _weights(bad, every, sides, size((1,)) / max(size((0, 1)), 1))

    rows, labels = [], []
    for half in (0, 1):  # the layer is fitted on texts that the weights have not seen
        part = Model(weights(1 - half), trigrams)
        rest = [k for k in range(len(y)) if side[k] == half]
        rows += part.features([texts[k] for k in rest])
        labels += y[rest].tolist()
    return Model(weights(0, 1), trigrams, _logistic(np.array(rows), np.array(labels)))


#: Counts of a key: in texts of side 0 and 1 that are not toxic, and of side 0 and 1 that are.
_COUNTS = ("n0", "n1", "t0", "t1")
_COUNT_ROWS = "key string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _summed(rows: DataFrame, keys) -> DataFrame:
    """Counts of keys over all rows; ``keys`` gives, for a batch, (key, the four counts) as often as it likes. Tasks sum what they can hold."""

    def of_batches(batches):
        held: dict[str, list[int]] = {}

        def out():
            columns = [pa.array(list(held), pa.string()), *[pa.array([c[k] for c in held.values()], pa.int64()) for k in range(4)]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["key", *_COUNTS])

        for batch in batches:
            for key, counts in keys(batch):
                c = held.setdefault(key, [0, 0, 0, 0])
                for k in range(4):
                    c[k] += counts[k]
                if len(held) >= COUNTED:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(bw.giving_back(of_batches), _COUNT_ROWS).groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _word_keys(batch):
    for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
        own = [0, 0, 0, 0]
        own[2 * int(toxic) + _side(text)] = 1
        for word in _words(text):
            yield word, own


def _counted(batch):
    return zip(batch.column("key").to_pylist(), zip(*[batch.column(c).to_pylist() for c in _COUNTS]))


def _gram_keys(batch):
    for word, counts in _counted(batch):
        for g in grams(word):
            yield g, counts


def _trigram_keys(batch):
    for word, counts in _counted(batch):
        if word.isalpha():
            for g in _trigrams(word):
                yield g, counts


def _models(total: list[int]):
    """A function of all n-grams' and trigrams' counts: the weights by either side and by both, and the trigrams, pickled. total: the four counts of all words."""

    def of_batches(batches):
        bad: dict[str, list[int]] = {}
        every: dict[str, list[int]] = {}
        tri: dict[str, int] = {}
        for batch in batches:
            for is_gram, (key, c) in zip(batch.column("is_gram").to_pylist(), _counted(batch)):
                if is_gram:
                    bad[key], every[key] = [c[2], c[3]], [c[0] + c[2], c[1] + c[3]]
                else:
                    tri[key] = sum(c)

        def weights(*sides: int) -> dict[str, float]:
            toxic = sum(total[2 + s] for s in sides)
            return _weights(bad, every, sides, toxic / max(toxic + sum(total[s] for s in sides), 1))

        made = pickle.dumps((weights(0), weights(1), weights(0, 1), _log_probabilities(tri)))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    return of_batches


def _layer_rows(pickled: bytes):
    """A function of batches of labelled texts: the features of each under the model that has not seen its side."""

    def of_batches(batches):
        first, second, _, trigrams = pickle.loads(pickled)
        unseen = Model(second, trigrams), Model(first, trigrams)
        for batch in batches:
            labels = iter(batch.column("toxic").to_pylist())
            for texts in slices(texts_of(batch.column("text")), TOGETHER):
                y, side = [next(labels) for _ in texts], [_side(t) for t in texts]
                x: list[tuple[float, ...]] = [()] * len(texts)
                for s in (0, 1):
                    own = [k for k in range(len(texts)) if side[k] == s]
                    for k, f in zip(own, unseen[s].features([texts[k] for k in own])):
                        x[k] = f
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in x], pa.float64()) for k in range(4)], pa.array(y, pa.float64())], names=["x0", "x1", "x2", "x3", "y"])

    return of_batches


def _layer(rows: DataFrame) -> tuple[float, ...]:
    """The logistic layer of rows (x0 to x3, y): each Newton step is one pass, which returns its sums."""

    def sums(w):
        def of_batches(batches):
            gradient, information = np.zeros(5), np.zeros((5, 5))
            for batch in batches:
                x = np.c_[np.ones(batch.num_rows), *[batch.column(f"x{k}").to_numpy() for k in range(4)]]
                g, i = _sums(x, batch.column("y").to_numpy(), w)
                gradient, information = gradient + g, information + i
            yield pa.RecordBatch.from_arrays([pa.array(range(30), pa.int32()), pa.array([*gradient, *information.ravel()], pa.float64())], names=["k", "v"])

        found = rows.mapInArrow(of_batches, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(30)
        for r in found:
            v[r.k] = r.v
        return v[:5], v[5:].reshape(5, 5)

    return _newton(sums, 5)


def train(documents: DataFrame, labels: DataFrame) -> bytes:
    """A pickled model of all labelled rows outside the held-out fold, as ``fit`` gives it, but by tasks: the driver sees no text.

    Null labels and null ids are left out; a document with several labels takes
    the highest, and rows that share an id take its label.  Without rows, or
    with rows of one label only, no text scores as toxic.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    scratch = Scratch(documents.sparkSession)
    try:
        chosen = scratch.keep(chosen)
        few = chosen.count() <= BROADCAST_ROWS
        rows = scratch.keep(documents.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id").select("text", "toxic"))
        kinds = rows.agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).first()
        if kinds.a is None or kinds.a == kinds.b:
            return pickle.dumps(fit([], []))
        words = scratch.keep(_summed(rows, _word_keys))
        total = [int(n or 0) for n in words.agg(*[F.sum(c) for c in _COUNTS]).first()]
        found = _summed(words, _gram_keys).where("t0 + t1 > 0").withColumn("is_gram", F.lit(True))
        found = scratch.keep(found.unionByName(_summed(words, _trigram_keys).withColumn("is_gram", F.lit(False))))
        made = found.coalesce(1).mapInArrow(bw.giving_back(_models(total)), "model binary").first()
        pickled = bytes(made.model) if made else pickle.dumps(({}, {}, {}, {}))
        layer = _layer(scratch.keep(rows.mapInArrow(bw.giving_back(_layer_rows(pickled)), "x0 double, x1 double, x2 double, x3 double, y double")))
    finally:
        delete(scratch.root)
    *_, weights, trigrams = pickle.loads(pickled)
    return pickle.dumps(Model(weights, trigrams, layer))


_loaded: dict[int, Model] = {}


def _load(pickled: bytes) -> Model:
    """The model; a worker keeps the one that it used last, with the words that it met."""
    key = zlib.crc32(pickled)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(pickled)
    return _loaded[key]


def scorer(pickled: bytes):
    """A function of a text column that gives the score of each text; null texts count as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = _load(pickled)
        out = pa.array([x for run in slices(texts_of(texts), TOGETHER) for x in model.scores(run)], pa.float64())
        bw.give_back()
        return out

    return score


def with_score(documents: DataFrame, labels: DataFrame, text: Column | None = None) -> Column:
    """The score column for ``documents``; the model is fitted when this is called."""
    return scorer(train(documents, labels))(F.col("text") if text is None else text)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Empty, null and blank texts score as texts without any marked word.  A null
    id is not held out.  Repeated rows are scored alike; other columns and
    columns with the results' names are not read.
    """
    scored = documents.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), with_score(documents, labels).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on all documents; nulls, ties, repeats and empty tables as in ``score_documents`` and ``train``."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
