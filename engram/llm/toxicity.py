"""Toxicity scores of deobfuscated text.

Noisy channel: a hidden writer takes plain words and disguises them, by leetspeak (1d1ot), marks between letters (i.d.i.o.t),
spaces between letters (i d i o t) or repeated letters (idiooot). Each disguised token becomes a lattice, whose steps are the
letters that a character may stand for, nothing for a mark, one or two letters for a run, and for the blanks between single characters
nothing or a word's end. A Viterbi search over letter pairs finds the likeliest reading, of any length, under a character trigram
model, whose counts cover all documents. The restored text is scored.

The scorer's lexicon (words and word beginnings) comes from one half of the training labels, its logistic weights from the other.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_type, id_type, texts, written

#: The letters that a character may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Marks that may stand between letters.
MARKS = ".-_*~^'`"
#: What a step of the channel costs, as a negative log probability.
COSTS = {"same": 0.0, "leet": 1.5, "mark": 1.0, "single": 0.3, "double": 0.9, "edge": 4.0}

_CLASSES = np.full(256, 0, np.int64)
_CLASSES[97:123] = np.arange(1, 27)
_CLASSES[65:91] = np.arange(1, 27)
_CLASSES[128:] = 27
_N = 28
_RUN = re.compile(r"([^\W\d_])\1\1")
_LETTER = r"[^\W\d_]"
_ODD = re.compile(rf"{_LETTER}[0-9@$!|+€.\-_*~^'`]+{_LETTER}|[0-9@$!|+€]{_LETTER}{{2}}|{_LETTER}{{2}}[01345789]|{_LETTER}[01345789@$!|+€]{{2}}")
_EDGE = ".,;:!?\"()[]{}<>%&#*$'`~^|_-+"
#: Symbols at a token's edge that are marks, or letters in leetspeak.
_EITHER = "$!|+@€"
_SOFT = "".join(set(_EDGE) - set(_EITHER))
_BREAK = re.compile(r"[^\w@$!|+€]+")
_SINGLE = re.compile(b"\1+")
_WORD, _BLANKS = re.compile(r"\S+"), re.compile(r"\s+")


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of byte classes (a-z, any other letter byte, boundary) over all documents; their number is fixed."""

    def counts(batches):
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            for text in b.column("t").to_pylist():
                c = np.concatenate(([0, 0], _CLASSES[np.frombuffer(text, np.uint8)], [0]))
                total += np.bincount(c[:-2] * _N * _N + c[1:-1] * _N + c[2:], minlength=_N**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    summed = texts(docs.withColumn("one", F.lit(0)), "one", text_col).select("t").mapInArrow(counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(_N**3)
    for r in summed.collect():  # at most 28 ** 3 rows
        out[r.gram] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a class after two others, trigrams interpolated with bigrams."""
    three = counts.reshape(_N, _N, _N)
    two = three.sum(0)
    after2 = (two + 0.1) / (two + 0.1).sum(1, keepdims=True)
    seen = three.sum(2, keepdims=True)
    return -np.log((three + 5.0 * after2[None]) / (seen + 5.0))


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else (0 if not ch.isalpha() else 27)


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """Steps of a lower-case token, or of single characters between blanks. A blank between them is nothing or a word's end, two
    blanks are rather a word's end, and marks may be one."""
    spaced = " " in token
    steps: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(\S)(?: ?\1)*|( +)" if spaced else r"(.)\1*", token):
        ch = m[1]
        if ch is None:
            steps.append([("", COSTS["same" if len(m[0]) == 1 else "edge"]), (" ", COSTS["same"])])
            continue
        run = m[0].count(ch)
        readings = [(ch, COSTS["same"])] if ch.isalpha() else []
        readings += [(x, COSTS["leet"]) for x in LEET.get(ch, "")]
        if run >= 3:
            options = [(x, c + COSTS["single"]) for x, c in readings] + [(x + x, c + COSTS["double"]) for x, c in readings]
        else:
            options = [(x * run, c * run) for x, c in readings]
        if ch in MARKS or not readings:
            options.append(("", COSTS["mark"]))
        if spaced:
            options += [(x + " " + x, c * 2) for x, c in readings if run > 1]
            if not ch.isalnum():
                options.append((" ", COSTS["mark" if readings else "same"]))
        steps.append(options)
    return steps


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest plain reading of a lower-case token; of single characters between blanks, words between blanks."""
    return _reading(token, model)[1]


def _reading(token: str, model: np.ndarray) -> tuple[float, str]:
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two classes: cost, and the path there
    for options in _lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for letters, more in options:
                p, q, total = a, b, cost + more
                for ch in letters:
                    r = _class(ch)
                    total += model[p, q, r]
                    p, q = q, r
                key = (p, q)
                if key not in new or total < new[key][0]:
                    new[key] = (total, (path, letters))
        best = new
    cost, path = min(((cost + model[a, b, 0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, last = path
        letters.append(last)
    return cost, "".join(reversed(letters))


class Deobfuscator(dict):
    """Raw token to plain word: its marks at the edges stripped, and restored if it is disguised.

    Tokens seen before are looked up, until they take ``most`` characters; ``disguised`` has those among them that were restored. ``also``
    has a second reading of tokens with symbols at an edge: as letters ($hit). ``spaced`` has the words of runs of single characters."""

    def __init__(self, model: np.ndarray, most: int = 5_000_000):
        self.model, self.most, self.held, self.disguised, self.also, self.spaced = model, most, 0, set(), {}, {}

    def __missing__(self, token: str) -> str:
        outer = token.strip(_SOFT)
        word = core = outer.strip(_EDGE + _EITHER)
        if _RUN.search(core) if core.isalpha() else _ODD.search(core) or _RUN.search(core):
            word = restore(core, self.model)
            self.disguised.add(token)
        if outer != core and any(map(str.isalpha, core)):
            cost, letters = _reading(outer, self.model)
            if letters != word:
                self.also[token] = letters
                if cost < _reading(core, self.model)[0] + (COSTS["edge"] if outer.rstrip("!") != core else 0.0):
                    self.disguised.add(token)
        self[token] = word
        self.held += len(token) + 20
        return word

    def readings(self, token: str) -> tuple[str, ...]:
        word = self[token]
        return (word, self.also[token]) if token in self.also else (word,)

    def read(self, text: str) -> tuple[set[str], int]:
        """The distinct raw tokens of a text, with the words of spaced letters, and how many of them are disguised."""
        if self.held > self.most:
            self.held = 0
            for known in (self, self.disguised, self.also, self.spaced):
                known.clear()
        text = text.lower()
        words = text.split()
        tokens = set(words)
        joined, starts = set(), None
        for m in _SINGLE.finditer(bytes([min(len(w), 2) for w in words])):
            first, end = m.span()
            # the token before belongs to the run if it is a character after marks, the token after it if one before marks
            if first and 1 in (len(words[first - 1].lstrip(_EDGE)), len(words[first - 1].lstrip(_SOFT))):
                first -= 1
            if end < len(words) and 1 in (len(words[end].rstrip(_EDGE)), len(words[end].rstrip(_SOFT))):
                end += 1
            if end - first < 3:
                continue
            run = "".join(words[first:end])
            if sum(c.isalnum() or c in LEET for c in run) >= 3 and any(map(str.isalpha, run)):
                starts = starts or [w.start() for w in _WORD.finditer(text)]
                joined.add(run)
                tokens |= self._words(_BLANKS.sub(lambda b: " " if len(b[0]) == 1 else "  ", text[starts[first] : starts[end - 1] + len(words[end - 1])]))
                tokens.update(part for part in _BREAK.split(run) if 3 <= len(part) < len(run))
        tokens |= joined
        for t in tokens:
            self[t]  # noqa: B018  looks the token up
        return tokens, len(self.disguised & tokens) + len(joined - self.disguised)

    def _words(self, run: str) -> set[str]:
        if run not in self.spaced:
            # letters other than a to z are one class, which has no word's ends to find
            self.spaced[run] = set(restore(run, self.model).split()) if any("a" <= c <= "z" for c in run) else set()
            self.held += 2 * len(run)
        return self.spaced[run]


def words_of(text: str, deobfuscate: Deobfuscator) -> set[str]:
    tokens, _ = deobfuscate.read(text)
    return {word for t in tokens for word in deobfuscate.readings(t)} - {""}


def beginnings(word: str) -> list[str]:
    """A word's features: itself, marked by =, and its beginnings of 4 to 7 letters."""
    return ["=" + word, *(word[:k] for k in range(4, min(len(word), 8)))]


@dataclass
class Model:
    language: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray


class _Weights(dict):
    """Plain word to its largest weight; of raw tokens, that of all their readings, if they are read through a deobfuscator."""

    def __init__(self, lexicon: dict[str, float], plain: Deobfuscator | None = None):
        self.lexicon, self.plain, self.held = lexicon, plain, 0

    def forget(self, most: int) -> None:
        if self.held > most:
            self.clear()
            self.held = 0

    def __missing__(self, token: str) -> float:
        self.held += len(token) + 20
        words = (token,) if self.plain is None else self.plain.readings(token)
        w = self[token] = max((self.lexicon.get(x, 0.0) for word in words if word for x in beginnings(word)), default=0.0)
        return w


def features(words: set[str], weights: dict[str, float]) -> list[float]:
    found = sorted((w for w in map(weights.__getitem__, words) if w), reverse=True)
    top = (found + [0.0] * 3)[:3]
    return [1.0, *top, math.log1p(len(found)), 10.0 * len(found) / (len(words) + 10), math.log1p(sum(w > 2 for w in found))]


def train(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 40_000, least_seen: int = 4, least_z: float = 3.0
) -> Model:
    """labelled: doc_id, label (0 or 1; others are ignored). At most about most_rows labelled rows are used, chosen by a hash of the
    id; of rows with one id that with the least hash of its text. The lexicon has the entries that the toxic rows of that sample have least_seen
    times, and significantly more often. Without rows of both labels the lexicon is empty and scores are even."""
    language = language_model(character_counts(docs, text_col))
    labelled = labelled.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = min(1.0, most_rows / max(1, labelled.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    chosen = labelled.filter(draw < int(share * 1_000_000)).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("string")), F.lit(2)))
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # bounded by most_rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("t").alias("th"), "t", "label", "half")).alias("one")).select("one.*")

    def tokens(batches):
        deobfuscate = Deobfuscator(language)
        for b in batches:
            words = [sorted(words_of(t.decode("utf-8", "replace"), deobfuscate)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("half"), pa.array(words, pa.list_(pa.string()))], ["label", "half", "words"])

    read = written(rows.mapInArrow(tokens, "label int, half bigint, words array<string>"))

    def entries(batches):
        for b in batches:
            for label, words in zip(b.column("label").to_pylist(), b.column("words").to_pylist(), strict=True):
                found = list({x for w in words for x in beginnings(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["entry", "label"])

    n = {(r.half, r.label): r.n for r in read.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get((0, 0), 0), n.get((0, 1), 0)
    lexicon: dict[str, float] = {}
    if good and bad:
        seen = read.filter("half = 0").select("label", "words").mapInArrow(entries, "entry string, label int")
        counts = seen.groupBy("entry").agg(F.sum("label").alias("b"), F.count("*").alias("n")).filter(F.col("b") >= least_seen)
        odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("b") + 0.5) / (good + 1))
        z = odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("n") - F.col("b") + 0.5))
        best = counts.select("entry", odds.alias("odds"), z.alias("z")).filter((F.col("z") >= least_z) & (F.col("odds") > 1))
        lexicon = {r.entry: float(r.odds) for r in best.collect()}

    def measured(batches):
        weights = _Weights(lexicon)
        for b in batches:
            x = [features(set(w), weights) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    fit = read.filter("half = 1").mapInArrow(measured, "label int, x array<double>").toPandas()  # bounded by most_rows
    return Model(language, lexicon, _logistic(np.array(fit["x"].tolist(), float).reshape(len(fit), 7), fit["label"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    if not len(y) or y.min() == y.max():
        return np.zeros(7)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, n_restored, th, and row, a struct of the columns to keep, if any. Null texts count as empty; empty texts get the score of a
    text without any toxic word. Whole texts are read, tokens and spaced runs of any length too. Repeated rows score alike, an empty table
    gives no rows, other columns are not read."""
    rows = texts(docs, id_col, text_col, keep).withColumn("th", F.xxhash64("t"))
    carried = ["row"] if keep else []
    language, lexicon, coefficients = model.language, model.lexicon, model.weights

    def scored(batches):
        deobfuscate = Deobfuscator(language)
        weights = _Weights(lexicon, deobfuscate)
        for b in batches:
            x, restored = [], []
            for t in b.column("t").to_pylist():
                tokens, n = deobfuscate.read(t.decode("utf-8", "replace"))
                weights.forget(deobfuscate.most)
                x.append(features(tokens, weights))
                restored.append(n)
            p = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, 7) @ coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(restored, pa.int64()), b.column("th"), *(b.column(c) for c in carried)],
                ["doc_id", "score", "predicted", "n_restored", "th", *carried],
            )

    return rows.mapInArrow(scored, f"doc_id {id_type(rows)}, score double, predicted int, n_restored bigint, th bigint" + carried_type(rows, carried))


def remainder(id_col, of: int):
    """crc32 of the id as text, modulo of; null ids are never held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))
