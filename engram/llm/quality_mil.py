"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by what can be measured in it; a hidden layer embeds it; gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and the weighted sum of their embeddings is
classified. Labels exist for documents only, and the weights are learned from them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, texts, written

#: The byte classes of which a passage's shares are measured.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"%&#*$@", b"<>{}[]()/\\=", b"\"'`-_:;+^~"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
_SHARES = len(_GROUPS) + 2
FEATURES = _SHARES + 10


def encode(words: list[bytes]) -> list[float]:
    """Of one passage, its words joined by single spaces."""
    joined = b" ".join(words)
    shares = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=_SHARES) / max(1, len(joined))
    n = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *(4 * np.sqrt(shares)).tolist(),
        len(counts) / n,
        max(counts.values()) / n,
        pairs / max(1, n - 1),
        min(3.0, lengths.mean() / 5),
        min(3.0, lengths.std() / 4),
        float((lengths <= 3).mean()),
        sum(w[-1:] in b".!?" for w in words) / n * 4,
        sum(len(w) > 1 and w.isupper() for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,!?" for w in words) / n,
        min(1.0, n / 100),
    ]


def passages(text: bytes, size: int = 100) -> np.ndarray:
    """One row per passage of so many words; a text without words is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    return np.array([encode(words[i : i + size]) for i in range(0, len(words), size)], np.float32)


def _slices(batches, rows: int = 256):
    """A few rows of Arrow's batches at a time, so that not all texts of a batch are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Network:
    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": draw(FEATURES, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, bags: np.ndarray):
        """x: passages; bags: the first passage of each document, ascending. Returns the logits and what backward needs."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = ((t * g) @ p["w"])[:, 0]
        sizes = np.diff(np.append(bags, len(x)))
        of = np.repeat(np.arange(len(bags)), sizes)
        s = np.exp(s - np.maximum.reduceat(s, bags)[of])
        a = s / np.add.reduceat(s, bags)[of]
        z = np.add.reduceat(a[:, None] * h, bags, axis=0)
        return (z @ p["c"])[:, 0] + p["b"][0], (x, h, t, g, a, z, of)

    def gradients(self, kept, error: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, h, t, g, a, z, of) = self.p, kept
        dz = error[:, None] @ p["c"].T
        da = (dz[of] * h).sum(1)
        ds = a * (da - (dz * z).sum(1)[of])
        dh = a[:, None] * dz[of]
        dtg = ds[:, None] @ p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds[:, None], "c": z.T @ error[:, None], "b": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-3
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(bags), batch):
                own = order[at : at + batch]
                first = np.cumsum([0, *(len(bags[i]) for i in own)])[:-1]
                logits, kept = self.forward(np.concatenate([bags[i] for i in own]), first)
                error = ((1 / (1 + np.exp(-logits)) - labels[own]) / len(own)).astype(np.float32)
                step += 1
                for k, g in self.gradients(kept, error).items():  # Adam
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 16_000, most_bytes: int = 1 << 28) -> Network:
    """labelled: doc_id, label (0 or 1). At most about most_rows labelled rows are used, chosen by a hash of the id; of rows with
    one id that with the least hash of its text. Of those every passage is read, as long as the passages of all, taken in order of
    their texts' hashes, fit most_bytes: the driver, which fits the network, holds no more. A text of more passages than that is
    not in the sample. Ties and repeats in the sample count as rows of their own ids."""
    labelled = labelled.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = min(1.0, most_rows / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # bounded by most_rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("t").alias("th"), "t", "label")).alias("one")).select("one.*")

    def bags(batches):
        for b in _slices(batches):
            out = [passages(t).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("th"), b.column("label"), pa.array(out, pa.binary())], ["th", "label", "bag"])

    kept = written(rows.mapInArrow(bags, "th bigint, label int, bag binary"))
    sizes = kept.groupBy("th").agg(F.sum(F.length("bag")).alias("n")).orderBy("th").collect()  # at most about most_rows
    held, some = 0, []
    for r in sizes:
        if held + r.n <= most_bytes:
            held += r.n
            some.append((r.th,))
    if len(some) < len(sizes):
        kept = kept.join(F.broadcast(docs.sparkSession.createDataFrame(some, "th long")), "th")  # at most about most_rows
    sample = kept.select("label", "bag").toPandas()
    sample = sample.sort_values(["bag", "label"], ignore_index=True)  # in whatever order tasks end, the same fit
    net = Network()
    if sample["label"].nunique() == 2:
        net.fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in sample["bag"]], sample["label"].to_numpy(np.float32))
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, n_passages, top_passage (the one of most weight).

    Null texts count as empty; a text without words is one empty passage and gets its score. Repeated rows score alike, an
    empty table gives no rows, other columns are not read. Long texts have as many passages as they need.
    """
    rows = texts(docs, id_col, text_col)
    p, mean, scale = net.p, net.mean, net.scale

    def scored(batches):
        own = Network()
        own.p, own.mean, own.scale = p, mean, scale
        for b in _slices(batches):
            bags = [passages(t) for t in b.column("t").to_pylist()]
            if not bags:
                continue
            sizes = np.array([len(x) for x in bags])
            first = np.cumsum(sizes) - sizes
            logits, kept = own.forward(np.concatenate(bags), first)
            q = 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))
            top = [int(kept[4][i : i + n].argmax()) for i, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int64())
            columns = (q, (q >= 0.5).astype(np.int32), sizes, top)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "score", "predicted", "n_passages", "top_passage"])

    return rows.mapInArrow(scored, f"doc_id {id_type(rows)}, score double, predicted int, n_passages bigint, top_passage bigint")
