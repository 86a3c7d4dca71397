"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of the w k-grams in each sliding window of k + w - 1 words. Any shared span of that length
has a shared fingerprint, so with k = w = 7 every shared 13-word window is found. Document and benchmark fingerprints are
joined on their hash; each hit fixes a shift between document and item, along which the match is extended word by word.
Items of fewer than 13 words are one window of their own length L, found with k = (L + 1) // 2 and w = L - k + 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_type, id_type, plain_words, texts, written


class _Hashes(dict):
    """Word to 64-bit hash; kept for the words seen so far, up to a bound that is tested between documents."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _hashed(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > 250_000:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = pick(a[:-step], a[step:])
        have += step
    return a


def winnow(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints that each span of so many words holds at least one of."""
    k = (span + 1) // 2
    w = span - k + 1
    n = len(hashes) - k + 1
    if n < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.full(n, span, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    least = _sliding(grams, w, np.minimum)
    # a gram is chosen if one of the windows over it has it as least value, that is, if it equals the largest of their least values
    ends = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate((ends, least, ends)), w, np.maximum) == grams)
    return chosen, grams[chosen]


def _fingerprints(rows: DataFrame, spans: list[int], whole: int | None, keys: list[str]) -> DataFrame:
    """keys, place, hash. whole: rows of up to so many words give only the span of their own length (benchmark items)."""

    def prints(batches):
        for b in batches:
            at, places, hashes = [], [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                words = _hashed(plain_words(text))
                for span in spans if whole is None else [min(len(words), whole)] if len(words) else []:
                    place, value = winnow(words, span)
                    at.append(np.full(len(place), i))
                    places.append(place)
                    hashes.append(value)
            if at:
                row = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(row) for k in keys), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))],
                    [*keys, "place", "hash"],
                )
        _HASHES.clear()  # workers are used again by other stages

    kinds = ", ".join(f"{k} {id_type(rows, k)}" for k in keys)
    return rows.mapInArrow(prints, f"{kinds}, place int, hash bigint")


def _marks(words: np.ndarray, item: np.ndarray, shift: int, span: int) -> list[tuple[int, int]]:
    """Runs of at least span equal words at one shift, as [from, to) of the document's words."""
    first, last = max(0, shift), min(len(words), shift + len(item))
    if last - first < span:
        return []
    same = np.concatenate(([0], (words[first:last] == item[first - shift : last - shift]).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(same))
    return [(first + a, first + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= span]


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, small_bytes: int = 32_000_000, most_items: int = 256, keep: list[str] | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans, th, and row, a
    struct of the columns to keep, if any.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A word is hit if it lies in any occurrence of a
    window: ``window`` consecutive words of an item, or all words of a shorter item. Null and wordless texts have no words
    and are not contaminated; items without words or with null text have no window. Items with a null id count as the
    item "null". Repeated items and rows change nothing. Empty tables: no hit, or no rows. item_ids: the hit items, sorted
    as strings; spans: the hit runs of words as [from, to).

    The benchmark's fingerprints are broadcast only if their counted rows fit small_bytes, its texts only if their counted bytes do;
    beyond that they are shuffled. Of a document and an item all shifts are collected before the item's text joins, once. A document
    that hits more than about most_items items is judged in as many rows as that takes, so no row holds the benchmark.
    Texts of any length are read whole.
    """
    rows = texts(docs, id_col, text_col, keep).withColumn("th", F.xxhash64("t"))
    carried = ["row"] if keep else []
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    bench = written(bench.groupBy("t").agg(F.collect_set("item").alias("items")).withColumn("item_th", F.unhex(F.sha2("t", 256))))  # a row for each text
    counted = bench.mapInArrow(_lengths(window), "span int").distinct()
    spans = sorted(r.span for r in counted.collect())  # at most as many as the window has words
    tests = written(_fingerprints(bench, [], window, ["item_th"]))
    # bytes of a row, with what the hash table adds
    few = (lambda df: F.broadcast(df)) if tests.count() * 128 <= small_bytes else (lambda df: df)
    size = bench.select(F.sum(F.length("t") + F.length(F.concat_ws(",", "items")) + 24 * F.size("items") + 128)).first()[0] or 0
    few_texts = (lambda df: F.broadcast(df)) if size <= small_bytes else (lambda df: df)
    tests = tests.withColumnRenamed("place", "item_place")
    prints = _fingerprints(rows.select("doc_id", "th", "t"), spans, None, ["doc_id", "th"])
    hits = prints.join(few(tests), "hash").select("doc_id", "th", "item_th", (F.col("place") - F.col("item_place")).alias("shift"))
    shifts = written(hits.groupBy("doc_id", "th", "item_th").agg(F.collect_set("shift").alias("shifts")))
    # tables between aggregation and join: the join can then split what has very many rows
    wide = written(shifts.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter(F.col("n") > most_items))
    own = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.th") == F.col(f"{y}.th"))
    # rows with texts repeat the same few items, so their files are far smaller than they are: never broadcast by the size of those
    hit = F.struct("items", "shifts", F.col("t").alias("words"))
    texts_of = few_texts(bench)
    a, b, c = rows.alias("a"), shifts.alias("b"), wide.alias("c")
    any_wide = not wide.isEmpty()
    narrow = b.join(c, own("b", "c"), "left_anti") if any_wide else b
    found = written(narrow.join(texts_of, "item_th").groupBy("doc_id", "th").agg(F.collect_list(hit).alias("hits")))
    if any_wide:
        parts = b.join(c, own("b", "c")).select("b.*", F.pmod(F.xxhash64("item_th"), F.ceil(F.col("c.n") / most_items)).alias("part"))
        parts = written(parts.join(texts_of, "item_th").groupBy("doc_id", "th", "part").agg(F.collect_list(hit).alias("hits"))).hint("merge").alias("d")
        one = rows.select("doc_id", "th", "t").join(wide.select(F.col("doc_id").alias("i"), F.col("th").alias("h")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).drop("i", "h").dropDuplicates(["doc_id", "th"])
        judged_parts = one.alias("a").join(parts, own("a", "d")).select("a.doc_id", "a.th", "a.t", "d.hits").mapInArrow(_partly(window), f"doc_id {id_type(rows)}, th bigint, runs array<array<bigint>>, named array<string>")
        done = written(judged_parts.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("named"))).alias("named")))
        b, d = found.hint("merge").alias("b"), done.hint("merge").alias("d")
        joined = a.join(b, own("a", "b"), "left").join(d, own("a", "d"), "left").select("a.*", "b.hits", "d.runs", "d.named")
    else:
        b = found.hint("merge").alias("b")
        none = F.lit(None)
        joined = a.join(b, own("a", "b"), "left").select("a.*", "b.hits", none.cast("array<array<bigint>>").alias("runs"), none.cast("array<string>").alias("named"))

    def judged(batches):
        for b in batches:
            out = []
            for text, hits, runs, named in zip(*(b.column(c).to_pylist() for c in ("t", "hits", "runs", "named")), strict=True):
                words = plain_words(text)
                if hits:
                    runs, named = _judged(words, hits, window)
                merged = _merged(runs or [])
                out.append((len(words), sum(y - x for x, y in merged), sorted(named or []), merged))
            n, hit, named, runs = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(map(len, named), pa.int64()),
                    pa.array((hashlib.sha256(",".join(x).encode()).hexdigest() for x in named), pa.string()),
                    pa.array((h > 0 and 20 * h >= k for h, k in zip(hit, n, strict=True)), pa.bool_()),
                    pa.array(named, pa.list_(pa.string())),
                    pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                    b.column("th"),
                    *(b.column(c) for c in carried),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans", "th", *carried],
            )
        _HASHES.clear()

    return joined.mapInArrow(
        judged,
        f"doc_id {id_type(rows)}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<array<bigint>>, th bigint" + carried_type(rows, carried),
    )


def _judged(words: list[bytes], hits: list[dict], window: int) -> tuple[list, set[str]]:
    """The runs of words that occurrences of the items' windows cover, and the items that have one."""
    doc, runs, named = _hashed(words), [], set()
    exact = np.array(words, object)
    for hit in hits:
        item = plain_words(hit["words"])
        item_hashes, span, before = _hashed(item), min(window, len(item)), len(runs)
        for shift in hit["shifts"]:
            for x, y in _marks(doc, item_hashes, shift, span):
                # the hashes agree; the words themselves decide
                same = np.array(item[x - shift : y - shift], object) == exact[x:y]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
                runs += [(x + p, x + q) for p, q in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if q - p >= span]
        if len(runs) > before:
            named.update(hit["items"])
    return runs, named


def _merged(runs: list) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(map(tuple, runs)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return out


def _partly(window: int):
    """Of a text and some of the items that it hits: the runs and the items' names."""

    def partly(batches):
        for b in batches:
            runs, named = [], []
            for text, hits in zip(b.column("t").to_pylist(), b.column("hits").to_pylist(), strict=True):
                own, names = _judged(plain_words(text), hits, window)
                runs.append(_merged(own))
                named.append(sorted(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))], ["doc_id", "th", "runs", "named"])
        _HASHES.clear()

    return partly


def _lengths(window: int):
    def lengths(batches):
        for b in batches:
            found = {min(len(plain_words(t)), window) for t in b.column("t").to_pylist()} - {0}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["span"])

    return lengths
