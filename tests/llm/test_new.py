"""Line dedup, filter audit and conversation repair against brute force and their SQL."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engram.llm import chat_repair, filter_audit, line_dedup

from .test_llm import HARD

LINES = "\n".join(f"line number {i} of a passage" for i in range(40))
LINE_ROWS = [
    *HARD, (30, LINES), (31, "\n" + LINES.upper() + "\r\n \x0b"), (31, "another text of thirty one\nline number 3 of a passage"), (32, "x\nx\nx"), (33, "ééééééééé\nééééééééé"), (34, "éééééééééé\nééééééééé"),
    (35, "  ÉÉÉÉÉÉÉÉÉÉ\n\téééééééééé "), (36, "line number 3 of a passage\n" * 5000), (None, LINES), (None, "line number 7 of a passage\nonly without an id\nonly without an id"), (None, "only without an id"), (37, "only without an id"), (38, "own line of it\nown line of it\n"),
    *[(i, "a line of every third document\nand one of its own " + str(i)) for i in range(100, 160)], *[(200, "one row very often")] * 60, (201, "one row very often"),
]


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


# 11


def brute_lines(rows, least=10):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line).strip(space)
    at = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            at[key(line)].add((i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(at[key(x)]) == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_lines_brute_force(spark, many_partitions, partitions):
    docs = spark.createDataFrame([(i, t, "h", 1, "p") for i, t in LINE_ROWS], "doc_id long, text string, h string, th int, places string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bitmaps = line_dedup.keep_bitmaps(docs)
        found = sorted(map(tuple, line_dedup.kept_texts(docs, bitmaps, digest=True).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute_lines(LINE_ROWS)


def test_line_bitmaps_and_texts(spark):
    docs = spark.createDataFrame([(1, "one line of text\nsecond line here", 5), (2, "ONE line of text\nshort\nown line of two", 6)], "doc_id long, text string, kept int")
    bitmaps = line_dedup.keep_bitmaps(docs).collect()
    assert [(r.doc_id, r.n_lines, r.n_dropped) for r in bitmaps] == [(2, 3, 1)]
    assert line_dedup.unpack(bytes(bitmaps[0].keep), 3).tolist() == [False, True, True]
    rows = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs), keep=docs.columns).orderBy("doc_id").collect()
    assert [(r.kept, r.row.kept) for r in rows] == [("one line of text\nsecond line here", 5), ("short\nown line of two", 6)]


def test_line_bitmaps_are_small():
    assert len(line_dedup.pack(100_000, list(range(50_000)))) < 200


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.kept_texts(none, line_dedup.keep_bitmaps(none), digest=True).collect() == []


# 12


def brute_audit(docs, labels):
    label = defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        label[i] = [max(label[i][0], int(q == 1)), max(label[i][1], int(x == 1))]
    first, rows = {}, []
    order = lambda i: (i is None, i or 0)
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", (True, 1)), order(i))
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": order(i) > first[t]}
        rows.append((lang or "", fails, *(label[i] if i is not None else (0, 0))))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for o in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(o, 1):
                left = [r for r in own if not any(r[1][x] for x in o[: k - 1])]
                here = [r for r in left if r[1][c]]
                shapley[part, c] += len(here)
                out.append((part, o, k, len(left) - len(here), len(here), sum(r[1][c] for r in own) - len(here), sum(r[1][c] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in here), sum(r[3] for r in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_brute_force(spark):
    draw = random.Random(5)
    body = lambda: " ".join(draw.choice(["Word", "x", "y#", "Q", "z", "ab", f"w{draw.randrange(400)}"]) for _ in range(draw.choice([3, 150, 260])))
    pool = [body() for _ in range(60)] + [None, "", " ", "A" * 30, "é A" * 100, "w " * 5000]
    docs = [(draw.choice([None, *range(80)]), draw.choice(pool), draw.choice([None, "", "en", "fr"])) for _ in range(300)]
    labels = [(draw.choice([None, *range(90)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(120)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, mask int, first int").repartition(4)
    found = filter_audit.audit(filter_audit.cells(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert sorted(map(tuple, found)) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(filter_audit.cells(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


# 13


def brute_repair(rows):
    """rows: role, text, fault. Every edit of every row, up to two turns inserted anywhere."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for own in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(own, rows, strict=True)):
            continue
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            turns, audit, cost = [(x, "") for x in more[0]], "I" * len(more[0]), 3 * sum(map(len, more))
            for e, (role, text, fault), after in zip(own, rows, more[1:], strict=True):
                audit += e[0] + "I" * len(after)
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (e != "D" and fault == "truncated")
                turns += [] if e == "D" else [(role if e == "K" else "user" if e == "Ru" else "assistant", text)]
                turns += [(x, "") for x in after]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def summary(rows):
    """rows: turn, role, text, in order. The counts, and the rows with their faults."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    faults = Counter(f for _, _, f in out)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal), out


def in_order(rows):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def conversations(n, most, seed):
    draw = random.Random(seed)
    roles, said = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "no", "What?", " ", None, "", "end! \t", "é"]
    return {(None if c == 0 else c): [(draw.choice([None, *range(8)]), draw.choice(roles), draw.choice(said)) for _ in range(draw.randrange(1, most + 1))] for c in range(n)}


def repaired(spark, of, **more):
    rows = [(c, *r, "x", 3) for c, own in of.items() for r in own]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, row int").repartition(3)
    return chat_repair.repair(turns, **more)


def test_repair_brute_force(spark):
    of = conversations(150, 2, 1) | {c + 1000: r for c, r in conversations(6, 3, 2).items() if c}
    found = {r.conv_id: tuple(r)[1:] for r in repaired(spark, of)[0].collect()}
    wanted = {}
    for c, own in of.items():
        counts, rows = summary(in_order(own))
        wanted[c] = (*counts, *brute_repair(rows))
    assert found == wanted


def plain_best(rows):
    """The same program with plain strings."""
    v = {0: (0, "", ())}
    put = lambda to, s, new: to.update({s: min(to.get(s, new), new)})
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def inserts(v):
        for _ in range(3):
            for s, (c, a, t) in list(v.items()):
                put(v, after[s], (c + 3, a + "I", (*t, (name[after[s]], ""))))

    for role, text, fault in rows:
        inserts(v)
        new = {}
        for s, (c, a, t) in v.items():
            put(new, s, (c + 4, a + "D", t))
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if to:
                    put(new, to, (c, a + "K", (*t, (role, text))))
                put(new, after[s], (c + 3, a + "R", (*t, (name[after[s]], text))))
        v = new
    inserts(v)
    c, a, t = min(v[s] for s in (0, 3) if s in v)
    return c, a, t


@pytest.mark.parametrize("most_rows", [1, 3, 4096])
def test_long_conversations_are_several_segments(spark, many_partitions, most_rows):
    """One conversation has a third of all rows; every one reaches over segments or partitions."""
    draw = random.Random(9)
    of = conversations(40, 12, 3) | {99: [(draw.choice([None, *range(300)]), draw.choice(["user", "assistant", "user", "system"]), draw.choice(["Yes.", "no", f"{draw.random()}.", "é "])) for _ in range(150)]}
    audits, placed = repaired(spark, of, most_rows=most_rows)
    found = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    turns = defaultdict(list)
    for r in chat_repair.repaired_turns(audits, placed).orderBy("place").collect():
        turns[r.conv_id].append((r.role, r.text))
    for c, own in of.items():
        counts, rows = summary(in_order(own))
        cost, audit, left = plain_best(rows)
        assert found[c] == (*counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()), c
        assert turns[c] == list(left)


def test_equal_hashes_are_verified(monkeypatch):
    rows = [("u", False, False), ("u", False, True), ("a", False, False), ("x", False, True), ("u", True, False)] * 8
    right = chat_repair.segment(rows)
    monkeypatch.setattr(chat_repair, "_MOD", 1)  # all hashes are equal
    assert chat_repair.segment(rows) == right


def test_order_of_trails():
    draw, trails = random.Random(3), chat_repair.Trails()
    nodes = [0]
    for _ in range(600):
        nodes.append(trails.add(draw.choice(nodes[-40:]), draw.choice("KRDI")))
    alike = lambda a, b: trails.spelled(a) == trails.spelled(b)
    for a, b in [(draw.choice(nodes), draw.choice(nodes)) for _ in range(3000)]:
        assert trails.less(a, b) == (trails.spelled(a) < trails.spelled(b)) and trails.alike(a, b) == alike(a, b)


def test_damage_and_what_is_left(spark):
    rows = [(c, t, r, x) for c in [None, *range(60)] for t, r, x in [(0, "user", "Hm?"), (1, "assistant", "Yes. No!"), (None, None, None)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    wanted = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            wanted += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    assert Counter(map(tuple, chat_repair.damaged(table).collect())) == Counter(wanted)
    audits, _ = chat_repair.repair(table.filter("conv_id < 2"))
    all_of = {r.conv_id: r for r in chat_repair.with_all(audits, table).collect()}
    assert len(all_of) == 61 and all_of[5].audit == "" and all_of[None].cost == 0 and all_of[7].repaired_sha256 == hashlib.sha256().hexdigest()


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, placed = chat_repair.repair(none)
    assert audits.collect() == [] and chat_repair.with_all(audits, none).collect() == [] and chat_repair.repaired_turns(audits, placed).collect() == []


def test_one_very_long_turn(spark):
    text = "word " * 400_000
    audits, _ = repaired(spark, {1: [(0, "user", text + "."), (1, "assistant", text)]}, most_bytes=1000)
    row = audits.first()
    assert (row.cost, row.audit, row.truncated) == (3, "KK", 1) and audits.filter(F.col("conv_id").isNull()).count() == 0
