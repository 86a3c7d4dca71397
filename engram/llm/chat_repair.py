"""Conversation structure repair by a persistent dynamic program.

A conversation's turns are read in order; for each state of the role pattern the cheapest edit sequence is kept as a node of a
tree in which sequences share their prefixes. Nodes carry binary-lifting ancestors and rolling hashes, so sequences of equal cost are
compared at the end of their longest common prefix, found by lifting; what hashes say is verified.

The rows lie range-partitioned by conversation and turn. A conversation inside one partition is done there. One that reaches over
partitions, or is very long, gives segments: the cheapest sequence from each state to each state. Segments compose, so one
conversation of any length is the work of many tasks, and only its hash is read in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_MOD, _BASE = (1 << 61) - 1, 1_000_003
#: States: nothing yet, after system, after user, after assistant. What a new user or assistant turn leads to.
_STATES, _ACCEPTED = 4, (0, 3)
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_REROLE, _DELETE, _INSERT, _TRUNCATED = 3, 4, 3, 3


class Trails:
    """Edit sequences as nodes of a tree that share their prefixes; node 0 is the empty one."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, edit: str) -> int:
        node, ups, k = len(self.edit), [parent], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(edit)) % _MOD)
        self.up.append(ups)
        return node

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def alike(self, a: int, b: int) -> bool:
        """Equal hashes of two nodes that aren't one are verified edit by edit."""
        return a == b or self.hash[a] == self.hash[b] and self.depth[a] == self.depth[b] and self.spelled(a) == self.spelled(b)

    def at_depth(self, node: int, depth: int) -> int:
        for k in reversed(range(len(self.up[node]))):
            if k < len(self.up[node]) and self.depth[self.up[node][k]] >= depth:
                node = self.up[node][k]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's sequence comes before b's in ASCII order: they are compared behind their longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if self.alike(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and not self.alike(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x] < self.edit[y]


def _cheapest(trails: Trails, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """Of (cost, node, edit to add or none) the cheapest; ties by their sequences."""
    if not options:
        return None
    cost = min(c for c, _, _ in options)
    best = None
    for c, node, edit in options:
        if c == cost:
            node = trails.add(node, edit) if edit else node
            best = node if best is None or trails.less(node, best) else best
    return cost, best


def _with_inserts(trails: Trails, v: list) -> list:
    inserted = lambda *states: [(v[s][0] + _INSERT, v[s][1], INSERT) for s in states if v[s]]
    own = lambda s: [(*v[s], "")] if v[s] else []
    v = [*v[:2], _cheapest(trails, own(2) + inserted(0, 1, 3)), v[3]]
    v[3] = _cheapest(trails, own(3) + inserted(2))
    return v


def step(trails: Trails, v: list, initial: str, gone: bool, truncated: bool) -> list:
    """The cheapest sequences by state after one more row. gone: it must be deleted."""
    v = _with_inserts(trails, v)
    options: list[list] = [[] for _ in range(_STATES)]
    for s, at in enumerate(v):
        if at:
            cost, node = at
            options[s].append((cost + _DELETE, node, DELETE))
            if not gone:
                more = cost + _TRUNCATED * truncated
                if (s, initial) in _KEPT:
                    options[_KEPT[s, initial]].append((more, node, KEEP))
                options[_NEXT[s]].append((more + _REROLE, node, REROLE))
    return [_cheapest(trails, o) for o in options]


def segment(rows: list[tuple[str, bool, bool]], starts=range(_STATES)) -> list[tuple[int, int, int, str]]:
    """rows: initial, gone, truncated. From state, to state, cost and audit of the cheapest sequences without inserts at the end."""
    out = []
    for start in starts:
        trails = Trails()
        v: list = [None] * _STATES
        v[start] = (0, 0)
        for row in rows:
            v = step(trails, v, *row)
        out += [(start, end, at[0], trails.spelled(at[1])) for end, at in enumerate(v) if at]
    return out


def _finished(v: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The cheapest of whole audits by state, after inserts at the end."""
    options = []
    for s, at in enumerate(v):
        while at:
            if s in _ACCEPTED:
                options.append(at)
                break
            at, s = (at[0] + _INSERT, at[1] + INSERT), _NEXT[s]
    return min(options)


def composed(v: list, edges: list[tuple[int, int, int, str]]) -> list:
    """Audits by state, and the segment after them."""
    out: list = [None] * _STATES
    for start, end, cost, audit in edges:
        if v[start]:
            new = (v[start][0] + cost, v[start][1] + audit)
            out[end] = new if out[end] is None else min(out[end], new)
    return out


def best_audit(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    v: list = [None] * _STATES
    for _, end, cost, audit in segment(rows, [0]):
        v[end] = (cost, audit)
    return _finished(v)


class Editor:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = _NEXT[self.state]
            self.at += 1
            yield _NAMES[self.state], ""

    def row(self, role: str, text: str):
        yield from self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            self.state = _KEPT[self.state, role[:1]]
            yield role, text
        elif edit == REROLE:
            self.state = _NEXT[self.state]
            yield _NAMES[self.state], text

    def end(self):
        yield from self._inserts()


class _Digest:
    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, turns) -> None:
        for role, text in turns:
            self.sha.update(f"{'' if self.first else '\n'}{role}:{text}".encode())
            self.first = False


def _digest(audit: str, rows) -> str:
    editor, digest = Editor(audit), _Digest()
    for role, text in rows:
        digest.add(editor.row(role, text))
    digest.add(editor.end())
    return digest.sha.hexdigest()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text as a test of repair: by crc32("conv_id:turn") % 20 a row is dropped (0), emptied (1), loses [.!?] (2),
    is repeated (3) or gets the role user (4). Nulls count as one space, in that key, as role and as text; turns stay null."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"), n.alias("n"))
    content = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("n <> 0").select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), content.alias("text"), F.explode(times).alias("no")).drop("no")


_SPACE = "[\\x20\\x09-\\x0D]"
_ORDER = ["conv_id", "turn", "role_head", "head", "th", "row"]


def _placed(turns: DataFrame) -> DataFrame:
    """turns with what orders them and whether a row is blank, duplicate or truncated: by the first of these that holds."""
    nothing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", nothing("role").alias("role"), nothing("text").alias("text")).withColumn("row", F.monotonically_increasing_id())
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = written(rows.withColumn("same", same))
    # tables that are read anew on either side, so that Spark can split a conversation's very frequent turn
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    solid = F.regexp_replace("text", f"{_SPACE}+$", "")
    blank = solid == ""
    late = F.col("first").isNotNull() & (F.col("first") < F.struct("turn", "row"))
    fault = F.when(blank, "blank").when(late, "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", F.left("role", F.lit(64)).alias("role_head"), F.left("text", F.lit(64)).alias("head"), F.xxhash64("role", "text").alias("th"), "row", "role", "text", fault.alias("fault"))


class _Run:
    """Rows of one conversation that follow one another."""

    def __init__(self, key: tuple):
        self.key, self.rows, self.edits, self.bytes = key, [], [], 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if self.rows and (self.rows[-1][0][:1] + role[:1]) not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.high  # turns come in order
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text))
        self.edits.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.bytes += len(text)

    def summary(self, opened: bool) -> tuple:
        edges = segment(self.edits) if opened else []
        if opened:
            v: list = [None] * _STATES
            for start, end, cost, audit in edges:
                if not start:
                    v[end] = (cost, audit)
            cost, audit = _finished(v)
        else:
            cost, audit = best_audit(self.edits)
        ends = self.rows[0][0][:1], self.rows[-1][0][:1]
        return (*self.key, *self.faults.values(), self.illegal, self.turns, self.low, self.high, *ends, opened, [e[0] * _STATES + e[1] for e in edges], [e[2] for e in edges], [e[3] for e in edges], cost, audit, _digest(audit, self.rows))


_SUMMARY = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, opened boolean, steps array<int>, costs array<bigint>, audits array<string>, cost bigint, audit string, repaired_sha256 string"
_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _arrow(out: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _kinds(ddl: str) -> list[tuple[str, pa.DataType]]:
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(n, types[t]) for n, t in (x.split() for x in ddl.split(", "))]


def _segments(most_rows: int, most_bytes: int):
    def segments(batches):
        run, first, kinds = None, True, []
        for b in batches:
            kinds, out = [(n, b.schema.field(n).type) for n in _ORDER] + _kinds(_SUMMARY), []
            for *key, role, text, fault in zip(*(b.column(c).to_pylist() for c in [*_ORDER, "role", "text", "fault"]), strict=True):
                new = run is None or run.key[0] != key[0]
                if not new and len(run.rows) >= most_rows or run and run.bytes >= most_bytes and not new:
                    out.append(run.summary(opened=True))
                    run, first = _Run(tuple(key)), True  # the rest of it is open, too
                elif new:
                    if run:
                        out.append(run.summary(opened=first))
                        first = False
                    run = _Run(tuple(key))
                run.add(key[1], role, text, fault)
            if out:
                yield _arrow(out, kinds)
        if run:
            yield _arrow([run.summary(opened=True)], kinds)

    return segments


def _joined_up(conv_kind: pa.DataType):
    """Segments in order, conversation by conversation, to results without their hashes."""
    kinds = [("conv_id", conv_kind), *_kinds(_RESULT)]
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "steps", "costs", "audits"]

    def joined_up(batches):
        now, state = None, None

        def result():
            cost, audit = _finished(state["v"])
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            return (now[0], gaps, *state["sums"], cost, audit, None)

        for b in batches:
            out = []
            for conv, *counts, turns, low, high, first, last, steps, costs, audits in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if now != (conv,):
                    if now:
                        out.append(result())
                    now, state = (conv,), {"v": [(0, ""), None, None, None], "sums": [0, 0, 0, 0], "turns": 0, "low": None, "high": None, "last": None}
                edges = [(s // _STATES, s % _STATES, c, a) for s, c, a in zip(steps, costs, audits, strict=True)]
                state["v"] = composed(state["v"], edges)
                state["sums"] = [x + y for x, y in zip(state["sums"], counts, strict=True)]
                state["sums"][3] += state["last"] is not None and state["last"] + first not in ("su", "ua", "au")
                if low is not None:
                    state["turns"] += turns - (low == state["high"])
                    state["low"], state["high"] = low if state["low"] is None else state["low"], high
                state["last"] = last
            if out:
                yield _arrow(out, kinds)
        if now:
            yield _arrow([result()], kinds)

    return joined_up


def _edited(conv_kind: pa.DataType, digest: bool):
    """An audit and then its rows, in order, conversation by conversation: the repaired turns, or their hash."""
    kinds = [("conv_id", conv_kind), *([("sha", pa.string())] if digest else [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])]

    def edited(batches):
        now, editor, made, place = None, None, None, 0

        def turns(found):
            nonlocal place
            for role, text in found:
                place += 1
                yield now[0], place, role, text

        def closed():
            if digest:
                made.add(editor.end())
                return [(now[0], made.sha.hexdigest())]
            return list(turns(editor.end()))

        for b in batches:
            out = []
            for conv, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if audit is not None:
                    if now:
                        out += closed()
                    now, editor, made, place = (conv,), Editor(audit), _Digest(), 0
                elif digest:
                    made.add(editor.row(role, text))
                else:
                    out += turns(editor.row(role, text))
            if out:
                yield _arrow(out, kinds)
        if now and (out := closed()):
            yield _arrow(out, kinds)

    return edited


def _in_order(audits: DataFrame, placed: DataFrame) -> DataFrame:
    """Each audit before the rows of its conversation, which are read as a stream: one conversation is in one task, but never gathered."""
    blank = lambda c: F.lit(None).cast(placed.schema[c].dataType).alias(c)
    heads = audits.select(F.col("conv_id"), *[blank(c) for c in _ORDER[1:]], "audit", blank("role"), blank("text"), F.lit(0).alias("kind"))
    rows = placed.select(*_ORDER, F.lit(None).cast("string").alias("audit"), "role", "text", F.lit(1).alias("kind"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:])


def _conv_kind(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return df.schema["conv_id"].dataType.simpleString(), to_arrow_type(df.schema["conv_id"].dataType)


def repair(turns: DataFrame, most_rows: int = 4096, most_bytes: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """turns: conv_id, turn, role, text. The audits, a row for each conv_id with rows: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256; and the rows in order, for ``repaired_turns``.

    Rows come by turn (nulls first), then role and text. A row's first fault counts: blank (nothing but [\\x20\\x09-\\x0D]), duplicate (role
    and text were there before), truncated (its last other character isn't one of .!?). Edits: Keep costs 0, Rerole to user or
    assistant 3, Delete 4 (blank and duplicate rows must go), Insert of an empty user or assistant turn 3; truncated rows that
    stay add 3. The audit has the initials of the cheapest edits in order that leave role initials (s?(ua)+)?, of ties the least
    in ASCII. illegal: neighbours whose initials aren't su, ua or au. gaps: highest less lowest turn, plus 1, less different
    turns, 0 without any. Null roles and texts are one space; rows without a conv_id are one conversation; repeated rows are
    duplicates; an empty table gives no rows; other columns are not read. A segment has at most most_rows rows and about most_bytes
    of text; longer conversations are several, and only their hash is streamed in one task.
    """
    placed = written(_placed(turns))
    ddl, kind = _conv_kind(placed)
    ranged = placed.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    keys = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in _ORDER)
    found = written(ranged.select(*_ORDER, "role", "text", "fault").mapInArrow(_segments(most_rows, most_bytes), f"{keys}, {_SUMMARY}"))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    result = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # open segments: the first and last of each partition, and the parts of long conversations
    opened = found.filter("opened").groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"))
    several = written(opened.filter("n > 1").select("c"))
    of_several = F.col("conv_id").eqNullSafe(F.col("c"))
    alone = found.join(several, of_several, "left_anti").select("conv_id", gaps.alias("gaps"), *result)
    parts = found.join(several, of_several, "left_semi").repartition("conv_id").sortWithinPartitions(*_ORDER)
    whole = written(parts.mapInArrow(_joined_up(kind), f"conv_id {ddl}, {_RESULT}"))
    hashes = _in_order(whole, placed.join(several, of_several, "left_semi")).mapInArrow(_edited(kind, digest=True), f"conv_id {ddl}, sha string")
    a, b = whole.alias("a"), hashes.alias("b")
    long = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.conv_id", "a.gaps", *[f"a.{c}" for c in result[:-1]], F.col("b.sha").alias("repaired_sha256"))
    return alone.unionByName(long), placed


def repaired_turns(audits: DataFrame, placed: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: the turns that the audits leave. Both from ``repair``."""
    ddl, kind = _conv_kind(placed)
    return _in_order(audits.select("conv_id", "audit"), placed).mapInArrow(_edited(kind, digest=False), f"conv_id {ddl}, place bigint, role string, text string")


def with_all(audits: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The audits, and zeros, an empty audit and the hash of nothing for conversations of which no row is left."""
    a, b = conversations.select(F.col(conv).alias("conv_id")).distinct().alias("a"), written(audits).alias("b")
    filled: dict[str, Column] = {c: F.coalesce(F.col(f"b.{c}"), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled |= {"audit": F.coalesce("b.audit", F.lit("")), "repaired_sha256": F.coalesce("b.repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.conv_id", *[c.alias(n) for n, c in filled.items()])
