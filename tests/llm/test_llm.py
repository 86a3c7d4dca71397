"""The training-data queries against brute force, on the small tables and on rows that are hard on purpose."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from engram.llm import decontam, exact_dedup, kd_shard, license_scan, packing, preference, quality_mil, queries, simhash, sql, suffix_dedup, toxicity
from tests.oracle import connect, difference

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(20_000))
#: ids and texts: null, empty, spaces, ties, repeated rows, a long text, shared passages, periodic text, characters of any kind.
HARD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (6, "a  b"), (7, "a b"), (7, "a b"), (8, LONG), (9, LONG + " x"), (10, "x " + LONG),
    (11, "start of one " + PASSAGE + " its end"), (12, "quite another start, " + PASSAGE), (13, PASSAGE + " third"), (14, "For " * 300), (15, "For " * 400),
    (16, "é" * 150), (17, "é" * 180 + "z"), (None, "no id " + PASSAGE), (None, None), (18, "<|endoftext|> ÀÉ'S it's,, x.y.z 12345 　wide\x85next\x1cone"), (19, "\n\n\t"), (20, LONG + " x"),
]


@pytest.fixture(scope="module")
def hard(spark):
    """With columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i, "en") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, keep_id long, th string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def table(spark, name, at=TINY):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{at}/{name}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[name], "text").collect()]


# 1


def brute_repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


OP1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_tables(spark):
    assert rows_of(queries.op1_suffix_dedup(spark, TINY), *OP1) == brute_repeats(table(spark, "documents"))


@pytest.mark.parametrize("share", [20_000, 3])
def test_suffix_dedup_hard(spark, hard, none, share, monkeypatch):
    if share == 3:  # grams of more than 3 segments are dealt window by window
        monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (200, "doc_id", "text", 3, 100_000))
    assert rows_of(suffix_dedup.without_repeats(hard), *OP1) == brute_repeats(HARD)
    assert not suffix_dedup.without_repeats(none).count()


def test_segments_of_long_texts_cover_all_windows():
    r = np.random.default_rng(6)
    text = bytes(r.integers(97, 101, 3000).astype(np.uint8)) + b"ab" * 700
    h = suffix_dedup.gram_hashes(text)
    for most in (1 << 23, 500, 1):
        first, last, anchor, grams = suffix_dedup.anchors(text, 200, most)
        covered = [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
        assert covered == list(range(len(text) - 199))
        for a, b, p, g in zip(first, last, anchor, grams, strict=True):
            for w in range(a, b + 1):  # of grams whose upper bits are equal the first counts
                upper = h[w : w + 153] >> np.uint64(30)
                assert p == w + int(upper.argmin()) and g == h[p]


def test_one_window_in_very_many_contexts(spark):
    """A line in 3,000 different contexts: its windows are counted, not gathered."""
    r = np.random.default_rng(8)
    line = "a boilerplate line that stands in very many documents, word for word, and is longer than two hundred bytes, so that all of it goes; " * 2
    noise = lambda: "".join(map(chr, r.integers(97, 123, 60)))
    rows = [(i, f"{noise()} {line}{noise()}") for i in range(3000)]
    spans, names = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 200, share=50)
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows[:400], "doc_id long, text string").repartition(6))
    assert rows_of(found, *OP1) == brute_repeats(rows[:400]) and spans.count() == names.count() == 3000


def test_loser_tree_keeps_shared_prefixes():
    r = np.random.default_rng(1)
    runs = [sorted((bytes(r.integers(97, 99, r.integers(1, 12)).astype(np.uint8)), b"l", i, j, 0, 1) for j in range(r.integers(0, 40))) for i in range(7)]
    found = list(suffix_dedup.merge([suffix_dedup.decode(suffix_dedup.front_code(x)) for x in runs]))
    assert [x[0] for x in found] == sorted(x[0] for run in runs for x in run)
    before = b""
    for x in found:
        assert x[1] == suffix_dedup.shared_prefix(before, x[0], 0)
        before = x[0]
    assert sorted(x[3:5] for x in found) == sorted(x[2:4] for run in runs for x in run)


# 2


def brute_licences(rows):
    out = []
    for i, t in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        out.append((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=repr)


OP2 = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_scan(spark, hard, none):
    assert rows_of(queries.op2_license_scan(spark, SMALL), *OP2) == brute_licences(table(spark, "documents", SMALL))
    assert rows_of(license_scan.scan(hard, license_scan.build_index(hard)), *OP2) == brute_licences(HARD)
    assert not license_scan.scan(none, license_scan.build_index(none)).count()
    rows = [(1, "MIT-License, CC by/NC; apache LICENSE cc BY"), (2, "Released under the GNU Lesser General Public License"), (3, "cc0 1.0 Universal"), (4, "gnu general public"), (5, "mit mit license license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan(df, license_scan.build_index(df))
    assert rows_of(found, *OP2) == brute_licences(rows)
    assert rows_of(found, "doc_id", "labels") == [(1, "apache,cc-by,cc-by-nc,mit"), (2, "lgpl"), (3, "cc0"), (4, ""), (5, "mit")]
    assert all(0 <= r.score <= 1 for r in found.collect())


def brute_notices(text, index, rarest=8):
    """Every start is tried, by the definition."""
    words, out = license_scan.plain_words(text.encode()), []
    for t in index.templates:
        here = [w for w in sorted(set(t.words), key=lambda w: (-index.idf[w], w)) if w in words]
        if any(w not in words for _, key in t.keys for w in key) or sum(w in words for w in t.words) < 0.6 * len(t.words):
            continue
        own, drift = here[:rarest], range(-t.drift, t.drift + 1)
        near = lambda s, i, w, drift: any(0 <= s + i + d < len(words) and words[s + i + d] == w for d in drift)
        votes = lambda s, drift: sum(any(near(s, i, w, drift) for i, x in enumerate(t.words) if x == w) for w in own)
        least = len(own) if t.base else min(len(own), max(2, math.ceil(len(own) / 2)))
        rows, last = [], None
        for s in range(-len(t.words) - 4, len(words) + 4):
            if votes(s, drift) >= least:
                if t.drift and last == s - 1:
                    rows[-1].append(s)
                else:
                    rows.append([s])
                last = s
        for row in rows:
            s = max(row, key=lambda s: (votes(s, [0]), -s))
            keys = all(any(s + i + d >= 0 and words[s + i + d : s + i + d + len(key)] == key for d in drift) for i, key in t.keys)
            share = sum(near(s, i, w, drift) for i, w in enumerate(t.words)) / len(t.words)
            if keys and share >= 0.6:
                out.append((s, t.label, round(share, 9)))
    return sorted(out)


def test_notices_against_brute_force(spark):
    notices = [(label, notice) for label, notice, _ in license_scan.NOTICES]
    r = np.random.default_rng(4)
    rows = []
    for label, notice in notices:
        words = notice.split()
        rows += [notice.upper(), "some words before; " + notice + " and after", " ".join(words[len(words) // 3 :]), " ".join(words[: 2 * len(words) // 3])]
        for changes in (1, 3, 8):
            new = list(words)
            for _ in range(changes):
                k = int(r.integers(0, len(new)))
                new[k : k + int(r.integers(0, 3))] = [str(w) for w in r.choice(words, int(r.integers(0, 3)))]
            rows.append("x y z " + " ".join(new) + " (" + " ".join(r.choice(words, 30)) + ") " + notice)
    mpl = next(n for label, n in notices if label == "mpl")
    rows += ["we compare it with the mozilla public license here", mpl.replace("mozilla public", "public"), "a word " * 50 + (mpl + " ") * 3, "", "license " * 500]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    index = license_scan.build_index(df)
    assert index.idf[b"mozilla"] > index.idf[b"license"]
    found = {row.doc_id: row for row in license_scan.scan(df, index).collect()}
    for k, text in enumerate(rows):
        wanted = brute_notices(text, index)
        assert sorted((p.start, p.label, round(p.agreement, 9)) for p in found[k].places) == wanted, text
        assert found[k].labels == ",".join(sorted({label for _, label, _ in wanted}))
        assert found[k].score == (1.0 if found[k].n_base else pytest.approx(max((s for _, _, s in wanted), default=0.0)))
    assert all(label in found[7 * k].labels.split(",") for k, (label, _) in enumerate(notices))
    prose, cut, thrice = (found[7 * len(notices) + k] for k in range(3))
    assert prose.labels == "" and prose.score == 0 and cut.labels == "mpl" and 0.9 < cut.score < 1
    assert [p.label for p in thrice.places] == ["mpl"] * 3


# 3


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \\t-\\r]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=repr):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


OP3 = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup(spark, hard, none):
    assert rows_of(queries.op3_exact_dedup(spark, SMALL), *OP3) == brute_copies(table(spark, "documents", SMALL))
    assert rows_of(exact_dedup.exact_groups(hard), *OP3) == brute_copies(HARD)
    assert not exact_dedup.exact_groups(none).count()


def test_exact_dedup_tells_contents_of_one_identifier_apart(spark, hard):
    """With identifiers of one byte nearly all clash; the chunks' contents decide."""
    assert rows_of(exact_dedup.exact_groups(hard, id_bytes=1, least=16, mean_bits=5), *OP3) == brute_copies(HARD)


def test_cuts_follow_content():
    text = LONG.encode()
    ends = exact_dedup.cuts(text, 256, 11, 65536)
    assert ends[-1] == len(text) and ends == sorted(set(ends)) and len(ends) > 10
    moved = {e - 2 for e in exact_dedup.cuts(b"x " + text, 256, 11, 65536)}
    assert len(moved & set(ends)) > 0.8 * len(ends)
    assert max(np.diff([0, *exact_dedup.cuts(b"a" * 300_000, 256, 11, 65536)])) <= 65536


# 4


def packed_right(df, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    wanted = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert rows_of(df, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(wanted, key=repr)
    bins = defaultdict(list)
    for r in df.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), math.ceil(sum(w[3] for w in wanted) / 2048)


def test_packing(spark, hard, none):
    n, least = packed_right(queries.op4_best_fit_packing(spark, SMALL), table(spark, "documents", SMALL))
    assert n <= 1.02 * least + 1
    packed_right(packing.pack(hard, queries.tokenizer()), HARD)
    assert not packing.pack(none, queries.tokenizer()).count()


def test_packing_over_many_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(70)
    n, least = packed_right(packing.pack(docs, queries.tokenizer(), fan=4), table(spark, "documents", SMALL))
    assert n <= 1.1 * least  # 14 documents a partition; only their bins meet


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(queries.tokenizer())
    words = ["don't", "'tis", "it's,,", "rock'", "'S", "We'LL", "x.y.z", "Ünder", "naïve's", "<|endoftext|>", "a<b", "1st2nd", "½", "µm", "ß", "\0", "_a_", "ªb", "É.", "ΑΣ", "李", "(a.b)'", "12'S", "e\u0301.x", "a\u0301", "…,", "n,\u0338"]
    texts = [*words, " ".join(words), "\n".join(w for w in words if "<" not in w), "", " \x1c\x85 ", *(t or "" for _, t in HARD)]
    for most in (3, 250_000):  # with few words kept, they change generations all the time
        table = packing._Ids(queries.tokenizer(), most)
        batch = [pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["t"])]
        for size in (20, 4_000_000):  # long texts are encoded chunk by chunk
            found = list(packing._streams(iter(batch), table, size))
            assert found == [np.array(full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(table) <= most and len(table.old) <= most


def test_best_fit():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 100, 2000).tolist()
    at = packing.best_fit(sizes, 100)
    assert len({b for b, _ in at}) <= 1.02 * sum(sizes) / 100 + 1


# 5, 6


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1.0
    for v in np.unique(scores):
        order[scores == v] = order[scores == v].mean()
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize(("query", "label", "of", "held", "least"), [(queries.op5_toxicity, "toxic", 5, 0, 0.85), (queries.op6_quality_mil, "quality", 3, 1, 0.95)])
def test_held_out(spark, query, label, of, held, least):
    df = query(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(df) == 10_000 and df["score"].between(0, 1).all() and ((df["score"] >= 0.5) == (df["predicted"] == 1)).all()
    assert (df["held_out"] == df["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % of == held)).all()
    both = df[df["held_out"]].merge(labels, on="doc_id")
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) > least


def test_models_on_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(HARD)] + [(4, None), (None, 1)], "doc_id long, label int")
    model = toxicity.train(hard, labels)
    found = toxicity.score(hard, model)
    assert found.count() == len(HARD) and all(0 <= r.score <= 1 for r in found.collect())
    net = quality_mil.train(hard, labels)
    found = quality_mil.score(hard, net)
    assert found.count() == len(HARD) and all(0 <= r.score <= 1 for r in found.collect())
    empty = toxicity.train(none, labels.limit(0))
    assert not toxicity.score(none, empty).count() and not quality_mil.score(none, quality_mil.train(none, labels.limit(0))).count()


def test_disguised_words_are_restored(spark):
    plain = "you idiot are a worthless moron and the clown is here to stay with the good people of the nation "
    docs = spark.createDataFrame([(i, plain * 5) for i in range(20)], "doc_id long, text string")
    model = toxicity.language_model(toxicity.character_counts(docs))
    reader = toxicity.Deobfuscator(model)
    found = toxicity.words_of("An 1d1ot and a m.o.r.o.n, w0rthl3ss; i d i o t here, idiooooot cl0wn!", reader)
    assert {"idiot", "moron", "worthless", "clown"} <= found and not any(w[:4] in ("1d1o", "m.o.", "w0rt", "cl0w", "idio") for w in found - {"idiot"})
    tokens, n = reader.read("nothing odd here, at all.")
    assert n == 0 and {reader[t] for t in tokens} == {"nothing", "odd", "here", "at", "all"}


@pytest.fixture(scope="module")
def reader(spark):
    plain = "you idiot are a worthless moron and the clown with a dim bass is here to stay with the good people of the nation "
    docs = spark.createDataFrame([(i, plain * 5) for i in range(20)], "doc_id long, text string")
    return toxicity.Deobfuscator(toxicity.language_model(toxicity.character_counts(docs)))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("an i d i o t, it is", {"idiot"}), ("i d i o t.", {"idiot"}), ('a "m o r o n" said', {"moron"}), ("i d i o t - not here", {"idiot"}), ("i d i o t - m o r o n", {"idiot", "moron"}), ("- m o r o n ! here", {"moron"}),
        ("idio77 an7 b455", {"idiott", "bass"}), ("the 1diot5here", {"idiotshere"}), ("!diot", {"idiot"}), ("cl0wn$", {"clowns"}), ("na+ion+", {"nationt"}), ("b@$$ ba$$", {"bass"}),
        ("y o u i d i o t", {"you", "idiot"}), ("so y o u a r e a w o r t h l e s s m o r o n", {"worthless", "moron"}),
        ("t h e g o o d p e o p l e o f t h e n a t i o n " * 6 + "a n d t h e w o r t h l e s s m o r o n", {"people", "nation", "worthless", "moron"}),
        ("m 0 r 0 n", {"moron"}), ("x! (hello) a", {"hello"}), ("1 d ! 0 t", {"idiot"}), ("y o u  i d i o t", {"you", "idiot"}), ("m o r  o n", {"moron"}),
        ("y o u a r e a n i d i o t o f t h e n a t i o n " * 9, {"you", "idiot", "nation"}), ("1.d.1.o.t." * 7, {"idiot" * 7}), ("m o o o r o n", {"moron"}),
    ],
)
def test_each_disguise(reader, text, found):
    assert found <= toxicity.words_of(text, reader)


def test_marks_are_no_disguise(reader):
    assert reader.read("the good people! stay (here), you - and \"the\" nation.")[1] == 0
    assert reader.read("an i d i o t, !diot")[1] == 2


def test_attention_gradients():
    r = np.random.default_rng(0)
    net = quality_mil.Network(hidden=5, gate=4)
    x, bags = r.standard_normal((9, quality_mil.FEATURES)).astype(np.float32), np.array([0, 2, 3])
    y = np.array([1.0, 0.0, 1.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z, _ = net.forward(x.astype(np.float64), bags)
        return (np.logaddexp(0, z) - y * z).sum()

    z, kept = net.forward(x.astype(np.float64), bags)
    for k, g in net.gradients(kept, 1 / (1 + np.exp(-z)) - y).items():
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        down = loss()
        net.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5, k


# 7


def brute_preferences(chosen, rejected):
    out = []
    def clean(rows):
        by = defaultdict(list)
        for c, n, r, t in rows:
            if c is not None:
                by[c].append(((n is None, n), r or "unknown", t or ""))
        return {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}
    a, b = clean(chosen), clean(rejected)
    for c in a.keys() | b.keys():
        x, y = a.get(c, []), b.get(c, [])
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        usable = any(r == "assistant" for r, _ in x[k:]) and any(r == "assistant" for r, _ in y[k:])
        for part, turns, first in (("prompt", x[:k], 0), ("chosen", x[k:], k), ("rejected", y[k:], k)):
            end = 0
            for n, (r, t) in enumerate(turns, first):
                s = f"<|{r}|>\n{t}<|end|>\n"
                out.append((c, part, n, s, r == "assistant" and part != "prompt", end, end + len(s), usable))
                end += len(s)
    return sorted(out, key=repr)


OP7 = ("pair_id", "part", "place", "segment", "in_loss", "start", "end", "usable")


def test_preferences(spark):
    turns = "conv_id long, turn long, role string, text string"
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "x"), (2, 2, "user", "more"), (2, 3, "assistant", "y"), (3, 0, None, None), (4, None, "user", "u"), (None, 0, "user", "z"), (5, 0, "user", "only"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", "q"), (2, 1, "assistant", "x"), (2, 2, "user", "other"), (3, 0, None, None), (4, None, "user", "v"), (7, 3, "assistant", ""), (6, 0, "user", "a")]
    found = preference.preference_segments(spark.createDataFrame(a, turns).withColumn("place", F.lit(1)), spark.createDataFrame(b, turns))
    assert rows_of(found, *OP7) == brute_preferences(a, b)
    assert not preference.preference_segments(spark.createDataFrame([], turns), spark.createDataFrame([], turns)).count()
    whole = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    last = {}
    for c, n, r, _ in whole:
        if r == "assistant":
            last[c] = max(n, last.get(c, -1))
    cut = [(c, n, r, t[: len(t) // 2] if r == "assistant" and n == last[c] else t) for c, n, r, t in whole]
    assert rows_of(queries.op7_preference_format(spark, SMALL), *OP7) == brute_preferences(whole, cut)


# 8


def dealt_right(rows, df, spread, shards=8):
    found = df.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= spread
    shard_of = defaultdict(set)
    for r in found:
        shard_of[r.size, r.text_crc32].add(r.shard)
    return shard_of


def test_kd_shards(spark, hard, none):
    rows = table(spark, "documents", "/root/testdata/sf0.1")
    total, largest = sum(len(t.encode()) + 1 for _, t in rows), max(len(t.encode()) + 1 for _, t in rows)
    groups = dealt_right(rows, queries.op8_kd_shard(spark, "/root/testdata/sf0.1"), 0.01 * total / 8 + largest)
    assert all(len(x) == 1 for x in groups.values())
    dealt_right(HARD, kd_shard.shard_by_bytes(hard), 1e9)
    assert not kd_shard.shard_by_bytes(none).count()
    same = [(i, "the same text") for i in range(800)]  # one group of more than a shard
    dealt_right(same, kd_shard.shard_by_bytes(spark.createDataFrame(same, "doc_id long, text string")), 14 * 12)


# 9


def brute_simhash(rows):
    prints = []
    for _, t in rows:
        words = [w for w in re.split("[ \\t-\\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(rows)))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    a = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 3).tolist():
            root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    return sorted(((d, f"{p:016x}", min(least[top(i)], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


OP9 = ("doc_id", "fingerprint", "component_id")


def test_simhash(spark, hard, none):
    assert rows_of(queries.op9_simhash(spark, SMALL), *OP9) == brute_simhash(table(spark, "documents", SMALL))
    assert rows_of(simhash.near_duplicates(hard), *OP9) == brute_simhash(HARD)
    assert not simhash.near_duplicates(none).count()


@pytest.mark.parametrize("large", [4096, 40, 3])
def test_pigeonring_loses_no_link(spark, large):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60).astype(np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            flips = r.choice(64, r.integers(1, 6), replace=False)
            values.add(int(b ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))))
    a = np.array(sorted(values), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    found = {frozenset(x) for x in simhash.links(df, large).collect()}
    assert all(((x ^ y) & (2**64 - 1)).bit_count() <= 3 for x, y in found)
    def parts(pairs):
        root = {int(x): int(x) for x in a.view(np.int64)}
        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        for x, y in pairs:
            root[top(x)] = top(y)
        groups = defaultdict(set)
        for x in root:
            groups[top(x)].add(x)
        return set(map(frozenset, groups.values()))
    s = a.view(np.int64).tolist()
    true = [(x, y) for i, x in enumerate(s) for y in s[:i] if ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
    assert parts(found) == parts(true)
    roots = {row.node: row.root for row in simhash.components(spark.createDataFrame([tuple(x) for x in found], "a long, b long")).collect()}
    for group in parts(true):
        if len(group) > 1:
            assert {roots[x] for x in group} == {min(group)}


# 10


def brute_contamination(rows, items, window=13):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        span = min(window, len(w))
        for k in range(len(w) - span + 1) if w else []:
            windows[tuple(w[k : k + span])].add(str(i) if i is not None else "null")
    spans = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = words_of(t)
        hit, named = set(), set()
        for span in spans:
            for k in range(len(w) - span + 1):
                if own := windows.get(tuple(w[k : k + span])):
                    hit.update(range(k, k + span))
                    named |= own
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


OP10 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, hard, none):
    assert rows_of(queries.op10_decontamination(spark, SMALL), *OP10) == brute_contamination(table(spark, "documents", SMALL), table(spark, "benchmark", SMALL))
    items = [(1, " ".join(PASSAGE.split()[5:40])), (2, "For for FOR"), (3, None), (4, ""), (5, "a b"), (6, "a"), (6, "a"), (None, "w0 w7919 w5831"), (7, " ".join(PASSAGE.split()[30:44])), (8, "For " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("clash"))
    for bound in (32_000_000, 0):
        assert rows_of(decontam.contamination(hard, bench, small_bytes=bound), *OP10) == brute_contamination(HARD, items)
    assert rows_of(decontam.contamination(hard, bench.limit(0)), *OP10) == brute_contamination(HARD, [])
    assert not decontam.contamination(none, bench).count()


def test_winnowing_guarantee():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2**62, 500).astype(np.uint64), r.integers(0, 2**62, 700).astype(np.uint64)
    for span in (1, 2, 5, 13):
        for at in range(0, 400, 37):
            c = b.copy()
            c[at + 50 : at + 50 + span] = a[at : at + span]
            assert set(decontam.winnow(a, span)[1]) & set(decontam.winnow(c, span)[1])


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("extra", F.lit(1))
    kept = p.clean(spark, docs, SMALL)
    rejected = {r.doc_id for r in queries.op5_toxicity(spark, SMALL).collect() if r.predicted}
    docs = docs.filter(~F.col("doc_id").isin(list(rejected)))
    assert kept.columns == docs.columns and rows_of(kept, *docs.columns) == rows_of(docs, *docs.columns)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    first = p.distinct(spark, docs, SMALL)
    assert ids(first) == sorted(x[0] for x in brute_copies(rows) if x[3])
    rows = [(r.doc_id, r.text) for r in first.collect()]
    near = p.apart(spark, first, SMALL)
    assert ids(near) == sorted(x[0] for x in brute_simhash(rows) if x[0] == x[2])
    rows = [(r.doc_id, r.text) for r in near.collect()]
    pure = p.decontaminated(spark, near, SMALL)
    assert ids(pure) == sorted(x[0] for x in brute_contamination(rows, table(spark, "benchmark", SMALL)) if not x[5])
    assert pure.columns == docs.columns
    n, least = packed_right(p.packed(spark, pure, SMALL), [(r.doc_id, r.text) for r in pure.collect()])
    assert n <= 1.05 * least + 1
    assert p.run(spark, SMALL).count() == p.packed(spark, pure, SMALL).count()


def test_one_of_each_near_group_stays(spark):
    import corpus_pipeline as p

    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    near = [" ".join([*words, x]) for x in ("", "x", "y", "x")]
    other = " ".join(w + "q" for w in words)
    for ids in ((None, None, None, None), (3, 3, 3, 3), (3, None, 3, 4)):
        rows = spark.createDataFrame([*zip(ids, near, strict=True), (9, other), (5, None), (5, "")], "doc_id long, text string")
        assert simhash.near_duplicates(rows, keyed=True).select("root").distinct().count() == 3
        kept = p.apart(spark, rows, TINY).collect()
        assert sorted((r.doc_id or 0) for r in kept) == sorted([ids[0] or 0, 5, 9]) and other in {r.text for r in kept}


CLASHES = ["own_hash", "times", "row", "t", "th", "rank", "score", "predicted", "root", "hits"]


def test_pipeline_stages_on_hard_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with the operators' own names."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in HARD], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    model = queries.toxicity_model(docs, spark, SMALL)
    assert ids(p.clean(spark, docs, SMALL)) == ids(toxicity.score(docs, model).filter("predicted = 0"))
    assert ids(p.distinct(spark, docs, SMALL)) == sorted((x[0] for x in brute_copies(HARD) if x[3]), key=repr)
    groups = len({x[2] for x in brute_simhash(HARD)})
    near = p.apart(spark, docs, SMALL)
    assert near.count() == groups and all(r.text in {t for i, t in HARD if i == r.doc_id} for r in near.collect())
    pure = p.decontaminated(spark, docs, SMALL)
    assert ids(pure) == sorted((x[0] for x in brute_contamination(HARD, table(spark, "benchmark", SMALL)) if not x[5]), key=repr)
    packed_right(p.packed(spark, docs, SMALL), HARD)
    for stage in (p.clean, p.distinct, p.apart, p.decontaminated):
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} <= {("x",) * len(CLASHES)}


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, own_hash string")
    for name, stage in p.STAGES:
        kept = stage(spark, docs, SMALL)
        assert kept.isEmpty() and (name == "packing" or kept.columns == docs.columns)


def test_pipeline_removes_what_it_wrote(spark):
    import corpus_pipeline as p

    folder = Path(p.shared_dir(spark).removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    assert p.run(spark, TINY).count() > 0 and len(set(folder.iterdir()) - before) == 1


def test_scores_are_those_of_the_formula(spark):
    """Both scorers, once more by plain arithmetic."""
    rows = [(i, t) for i, t in HARD if i is not None] + [(100, "an idiot, such an 1d1ot and moron"), (101, "a fine day " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = np.random.default_rng(2)
    model = toxicity.Model(toxicity.language_model(toxicity.character_counts(docs)), {"=idiot": 3.0, "idio": 2.5, "moro": 1.5, "fine": 1.2}, r.normal(size=7))
    reader = toxicity.Deobfuscator(model.language)
    wanted = []
    for i, t in rows:
        tokens, _ = reader.read(t or "")
        each = [max((model.lexicon.get(x, 0.0) for w in reader.readings(k) if w for x in ["=" + w, *(w[:n] for n in range(4, 8) if n < len(w))]), default=0.0) for k in tokens]
        top = sorted((w for w in each if w), reverse=True)
        x = [1.0, *(top + [0.0] * 3)[:3], math.log1p(len(top)), 10 * len(top) / (len(tokens) + 10), math.log1p(sum(w > 2 for w in top))]
        wanted.append((i, round(1 / (1 + math.exp(-float(np.dot(x, model.weights)))), 6)))
    assert sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score(docs, model).collect()) == sorted(wanted)

    net = quality_mil.Network(hidden=6, gate=3)
    wanted = []
    for i, t in rows:
        words = (t or "").encode().split()
        bags = [words[k : k + 100] for k in range(0, len(words), 100)]
        x = np.array([quality_mil.encode(b) for b in bags]) if bags else np.zeros((1, quality_mil.FEATURES))
        h = np.tanh(x @ net.p["E"] + net.p["e"])
        a = ((np.tanh(h @ net.p["V"]) / (1 + np.exp(-h @ net.p["U"]))) @ net.p["w"])[:, 0]
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        z = float((a @ h @ net.p["c"])[0] + net.p["b"][0])
        wanted.append((i, len(x), 1 / (1 + math.exp(-z))))
    found = sorted((r.doc_id, r.n_passages, r.score) for r in quality_mil.score(docs, net).collect())
    assert [f[:2] for f in found] == [w[:2] for w in sorted(wanted)] and all(abs(f[2] - w[2]) < 1e-4 for f, w in zip(found, sorted(wanted), strict=True))


def test_all_words_of_training_texts_count(spark):
    """Beyond the first passages: only the last of 10,000 words tells good from bad."""
    rows = [(i, "plain words here. " * 3333 + ("@@@@ #### $$$$ " * 40 if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality_mil.train(docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("label")))
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in quality_mil.score(docs, net).collect())


def test_training_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7} good") for i in range(500)] + [(2, "bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    net = quality_mil.train(docs, labels)
    assert net.p["E"].shape and toxicity.train(docs, labels).weights.shape == (7,)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), sql.SQL[name], connect(SMALL)) is None
