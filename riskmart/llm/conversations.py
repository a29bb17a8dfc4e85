"""Repair of the structure of conversations: least edits that make the roles read `(s?(ua)+)?`, by a bidirectional tight-arc DAG.

The rows of a conversation, by turn (nulls first, then as the table has them), and the states of that pattern (nothing yet, after a system row, after user, after assistant) are the
nodes of a graph; its arcs are edits: Delete a row, Insert an empty one, Keep a row, Rerole it. Least costs from the start (forward) and to the end (backward) tell which arcs are
tight, that is on some cheapest way. A frontier set goes along tight arcs only and takes the least letter (D, I, K, R) that any of its nodes offers, so the string of edits is the
least of all cheapest ones. Every letter leads a state on to one state, so the frontier never has more than one, and the repaired rows follow from the string.

A row's first fault counts: blank, duplicate (its role and text seen earlier in the conversation), truncated (the last character that isn't space isn't one of `.!?`). Blank and
duplicate rows must go. Costs: DELETE, INSERT, REROLE; a truncated row that stays costs TRUNCATED more. Only the first character of a role counts; a role without one is no legal role.

No task sees a whole conversation unless it is short. Rows are sorted over range partitions by conversation, turn and position, with a marker for the first row of each role and
text (found by an aggregation, so no hot text is one task's). A task cuts them into chunks of CHUNK_ROWS rows or CHUNK_BYTES of text at most. A conversation that lies within a chunk
is solved at once. Of the others each chunk gives a min-plus matrix of the states; their products over groups of SPAN, level by level, give each chunk the costs before and after
it, and once tight arcs are known, maps of states do the same for the frontier. Then all chunks are solved on their own. Only `digests` has to read a conversation in order, in one
task, as a digest is of one text; it keeps no more than a batch and the edits.

Null roles and texts count as one space. Null turns come first, and count for no gap. Rows without conv_id are one conversation. Repeated rows are duplicates. Rows equal in turn keep
the table's order, so df must give the same rows in the same order when read again, as files and written tables do. Texts of any length are whole in one chunk. An empty table gives
no pieces. Columns besides the four named ones can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
CHUNK_ROWS, CHUNK_BYTES, SPAN = 1024, 1_000_000, 4096
SPACE = " \t\n\x0b\x0c\r"
#: States, and classes of a role's first character.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
FAR = 1 << 60
START, END = [0, FAR, FAR, FAR], [0, 2 * INSERT, INSERT, 0]
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_MAX = 2**63 - 1


def damage(df: DataFrame) -> DataFrame:
    """Rows of a conversation table with known faults, by the CRC-32 of `conv_id:turn` modulo 20: dropped, emptied, without end marks, repeated, or turned into the user's. Nulls count as one space."""
    either = {c: F.coalesce(df[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.pmod(F.crc32(F.concat(either["conv_id"], F.lit(":"), either["turn"]).cast("binary")), F.lit(20))
    out = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"), either["role"].alias("role"), either["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, from, to) of a row's edits. code: class of its role, 4 if truncated, 8 if it must go."""
    out = [("D", DELETE, s, s) for s in range(4)]
    if code < 8:
        role, more = code & 3, TRUNCATED if code & 4 else 0
        for s, to in _NEXT.items():
            if role == to - 1:
                out.append(("K", more, s, to))
            out.append(("R", REROLE + more, s, to))
        if role == 0:
            out.append(("K", more, NOTHING, SYSTEM))
    return out


_ARCS = [_arcs(c) for c in range(16)]


def _inserted(f: list[int]) -> list[int]:
    """Costs to reach the states once rows may be inserted."""
    user = min(f[USER], min(f[NOTHING], f[SYSTEM], f[ASSISTANT]) + INSERT)
    return [f[NOTHING], f[SYSTEM], user, min(f[ASSISTANT], user + INSERT)]


def forward(codes: bytes, before: list[int]) -> list[list[int]]:
    """For each row and the end, the least costs to reach the states just before it, insertions included but at the end."""
    out, f = [], before
    for code in codes:
        f = _inserted(f)
        out.append(f)
        g = [FAR] * 4
        for _, cost, a, b in _ARCS[code]:
            if f[a] + cost < g[b]:
                g[b] = f[a] + cost
        f = g
    return [*out, f]


def backward(codes: bytes, after: list[int]) -> list[list[int]]:
    """For each row and the end, the least costs from the states just before it to the conversation's end."""
    out, b = [after], after
    for code in reversed(codes):
        g = [FAR] * 4
        for _, cost, a, to in _ARCS[code]:
            if b[to] + cost < g[a]:
                g[a] = b[to] + cost
        user = min(g[USER], g[ASSISTANT] + INSERT)
        b = [min(g[NOTHING], user + INSERT), min(g[SYSTEM], user + INSERT), user, min(g[ASSISTANT], g[USER] + INSERT)]
        out.append(b)
    return out[::-1]


def walk(codes: bytes, to: list[list[int]], rest: list[list[int]], total: int, start: int, last: bool) -> tuple[str, list[int]]:
    """The least edits along tight arcs from a state, and the states they lead to. Insertions after the last row belong to the last chunk."""
    frontier, edits, states = {start}, [], []
    for i in range(len(codes) + 1):
        end = i == len(codes)
        f = _inserted(to[i]) if end else to[i]
        while not end or (last and not any(s in (NOTHING, ASSISTANT) and f[s] == total for s in frontier)):
            found = {}
            for s in frontier:
                arcs = [("I", INSERT, s, _NEXT[s])] if end else [*(x for x in _ARCS[codes[i]] if x[2] == s), ("I", INSERT, s, _NEXT[s])]
                for letter, cost, _, t in arcs:
                    if f[s] + cost + rest[i if letter == "I" else i + 1][t] == total:
                        found.setdefault(letter, set()).add(t)
            letter = min(found)
            frontier = found[letter]
            edits.append(letter)
            states.append(min(frontier))
            if letter != "I":
                break
    return "".join(edits), states


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before a chunk to each after it, row by row."""
    return [x for s in range(4) for x in forward(codes, [0 if k == s else FAR for k in range(4)])[-1]]


def _through(before: list[int], m: list[int]) -> list[int]:
    return [min(FAR, *(before[s] + m[4 * s + t] for s in range(4))) for t in range(4)]


def _back(m: list[int], after: list[int]) -> list[int]:
    return [min(FAR, *(m[4 * s + t] + after[t] for t in range(4))) for s in range(4)]


def _product(ms: list[list[int]]) -> list[int]:
    out = ms[0]
    for m in ms[1:]:
        out = [x for s in range(4) for x in _through(out[4 * s : 4 * s + 4], m)]
    return out


def _costs_within(ms: list[list[int]], around: list[int]) -> list[list[int]]:
    """For each chunk of a row of them the costs before and after it."""
    before, after = [around[:4]], [around[4:]]
    for m in ms[:-1]:
        before.append(_through(before[-1], m))
    for m in reversed(ms[1:]):
        after.append(_back(m, after[-1]))
    return [a + b for a, b in zip(before, reversed(after), strict=True)]


def _mapped(maps: list[list[int]]) -> list[int]:
    out = maps[0]
    for m in maps[1:]:
        out = [m[s] if s >= 0 else -1 for s in out]
    return out


def _states_within(maps: list[list[int]], around: list[int]) -> list[list[int]]:
    out = [around[0]]
    for m in maps[:-1]:
        out.append(m[out[-1]])
    return [[s] for s in out]


_WITHIN = "conv_id long, part long, number long, around array<long>"


def _spread(rows: DataFrame, n_parts: int, join: Callable, within: Callable, outermost: list[int], span: int) -> DataFrame:
    """(conv_id, part, number, x) -> (conv_id, part, number, around): what holds around each chunk, by products over parts, then over span parts at a time, and back down. A group has the chunks of a partition, or span rows."""

    def product(table: pa.Table) -> pa.Table:
        r = sorted(table.to_pylist(), key=lambda y: y["number"])
        return pa.table({"conv_id": pa.array([r[0]["conv_id"]], pa.int64()), "part": [r[0]["part"] // span], "number": [r[0]["part"]], "x": pa.array([join([y["x"] for y in r])], pa.list_(pa.int64()))})

    def inner(table: pa.Table) -> pa.Table:
        r = sorted(table.to_pylist(), key=lambda y: y["number"])
        found = within([y["x"] for y in r], r[0]["outer"])
        return pa.table({"conv_id": pa.array([y["conv_id"] for y in r], pa.int64()), "part": [y["part"] for y in r], "number": [y["number"] for y in r], "around": pa.array(found, pa.list_(pa.int64()))})

    if n_parts <= 1:
        return rows.withColumn("outer", F.array(*[F.lit(x).cast("long") for x in outermost])).groupBy("conv_id", "part").applyInArrow(inner, _WITHIN)
    up = common.materialise(rows.groupBy("conv_id", "part").applyInArrow(product, "conv_id long, part long, number long, x array<long>"), "products")
    outer = _spread(up, -(-n_parts // span), join, within, outermost, span).select(F.col("conv_id").alias("_id"), F.col("number").alias("_part"), F.col("around").alias("outer"))
    return rows.join(outer, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))).select("conv_id", "part", "number", "x", "outer").groupBy("conv_id", "part").applyInArrow(inner, _WITHIN)


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()), ("n_rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_class", pa.int32()), ("last_class", pa.int32()), ("least_turn", pa.int64()), ("most_turn", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()),
    ("codes", pa.binary()), ("x", pa.list_(pa.int64())), ("cost", pa.int64()), ("edits", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_PIECE_DDL = "conv_id long, part long, number long, whole boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, first_class int, last_class int, least_turn long, most_turn long, first_turn long, last_turn long, n_turns long, codes binary, x array<long>, cost long, edits string, roles array<string>, texts array<string>"


class _Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv_id: int | None, number: int, starts: bool):
        self.conv_id, self.number, self.starts = conv_id, number, starts
        self.codes, self.turns, self.roles, self.texts = bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.size = 0

    def add(self, turn: int | None, role: str, text: str, role_class: int, blank: bool, truncated: bool, first: bool) -> None:
        again = not blank and not first
        cut = truncated and not blank and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        self.codes.append(role_class + 4 * cut + 8 * (blank or again))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)

    def piece(self, part: int, ends: bool) -> dict:
        codes, classes, turns = bytes(self.codes), [c & 3 for c in self.codes], [t for t in self.turns if t is not None]
        whole = self.starts and ends and not self.number
        out = {
            "conv_id": self.conv_id, "part": part, "number": self.number, "whole": whole, "n_rows": len(codes), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": sum(p not in _LEGAL for p in zip(classes[:-1], classes[1:], strict=True)), "first_class": classes[0], "last_class": classes[-1],
            "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)), "codes": codes, "roles": self.roles, "texts": self.texts,
        }
        return solved(out, START + END, NOTHING, True) if whole else out | {"x": matrix(codes), "cost": None, "edits": None}


def solved(piece: dict, around: list[int], start: int, last: bool) -> dict:
    """A piece with its edits and the rows that they leave."""
    codes, before, after = piece["codes"], around[:4], around[4:]
    to, rest = forward(codes, before), backward(codes, after)
    total = min(b + r for b, r in zip(before, rest[0], strict=True))
    edits, states = walk(codes, to, rest, total, start, last)
    roles, texts, i = [], [], 0
    for letter, state in zip(edits, states, strict=True):
        if letter in "KR":
            roles.append(piece["roles"][i] if letter == "K" else _ROLES[state])
            texts.append(piece["texts"][i])
        elif letter == "I":
            roles.append(_ROLES[state])
            texts.append("")
        i += letter != "I"
    return piece | {"x": None, "cost": total, "edits": edits, "roles": roles, "texts": texts}


def _batches(pieces: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """In batches of some megabytes."""
    out, size = [], 0
    for p in pieces:
        out.append(p)
        size += 200 + len(p["codes"]) + sum(map(len, p["texts"]))
        if size > CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(out, _PIECE)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict]:
    """Pieces of a sorted partition, one after another."""
    part, now, marked, seen = TaskContext.get().partitionId(), None, None, False
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            conv_id, turn, row, marker, role, text, role_class, blank, truncated = r
            if marker:
                marked = row
                continue
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.piece(part, True)
                now, seen = _Chunk(conv_id, 0, seen), True
            elif len(now.codes) >= rows or now.size >= CHUNK_BYTES:
                yield now.piece(part, False)
                now = _Chunk(conv_id, now.number + 1, now.starts)
            now.add(turn, role, text, role_class, blank, truncated, row == marked)
    if now is not None:
        yield now.piece(part, False)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = CHUNK_ROWS, span: int = SPAN) -> DataFrame:
    """Pieces: of each conversation one row, or several that follow each other by part and number, with counts of faults, the cost of the whole conversation, the edits (one letter each, in order) and the repaired rows (roles, texts)."""
    common.ship(df.sparkSession)
    rows = df.select(df[conv_col].cast("long").alias("conv_id"), df[turn_col].cast("long").alias("turn"), F.coalesce(df[role_col].cast("string"), F.lit(" ")).alias("role"), F.coalesce(df[text_col].cast("string"), F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "row": F.monotonically_increasing_id(), "blank": end == "", "truncated": ~F.substring(end, -1, 1).isin(".", "!", "?"),
        "class": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER),
        "key": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256),
    })
    rows = common.materialise(rows, "turns")
    # The first row of each role and text of a conversation; nulls are least in a struct, as in the order of turns.
    first = rows.where("not blank").groupBy("conv_id", "key").agg(F.min(F.struct("turn", "row")).alias("at")).select("conv_id", "at.*", F.lit(True).alias("marker"))
    kept = rows.select("conv_id", "turn", "row", F.lit(False).alias("marker"), "role", "text", "class", "blank", "truncated")
    ordered = kept.unionByName(first, allowMissingColumns=True).repartitionByRange("conv_id", "turn", "row").sortWithinPartitions("conv_id", "turn", "row", F.desc("marker"))
    pieces = common.materialise(ordered.mapInArrow(lambda batches: _batches(_chunks(batches, chunk_rows)), _PIECE_DDL), "pieces")
    common.discard(rows)
    parts = pieces.where("not whole")
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    # Most parts have two such conversations, the first and the last; they are in one part or two.
    around = common.materialise(_spread(parts.select("conv_id", "part", "number", "x"), n_parts, _product, _costs_within, START + END, span), "around")
    keys = (F.col("p.conv_id").eqNullSafe(F.col("a.conv_id"))) & (F.col("p.part") == F.col("a.part")) & (F.col("p.number") == F.col("a.number"))
    known = common.materialise(parts.drop("whole").alias("p").join(around.alias("a"), keys).select("p.*", "a.around"), "known")

    def mapped(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                to, rest = forward(r["codes"], r["around"][:4]), backward(r["codes"], r["around"][4:])
                total = min(b + x for b, x in zip(r["around"][:4], rest[0], strict=True))
                out.append([walk(r["codes"], to, rest, total, s, False)[1][-1] if r["around"][s] + rest[0][s] == total else -1 for s in range(4)])
            yield pa.record_batch({"conv_id": batch.column(0), "part": batch.column(1), "number": batch.column(2), "x": pa.array(out, pa.list_(pa.int64()))})

    maps = known.select("conv_id", "part", "number", "codes", "around").mapInArrow(mapped, "conv_id long, part long, number long, x array<long>")
    states = common.materialise(_spread(common.materialise(maps, "maps"), n_parts, _mapped, _states_within, [NOTHING], span), "states")

    def solve(batches):
        def each():
            for batch in batches:
                for r in batch.to_pylist():
                    around, start = r.pop("around"), r.pop("state")
                    # Whatever follows costs nothing from NOTHING and ASSISTANT only if it costs nothing from SYSTEM either: END is after the last chunk alone.
                    yield solved(r | {"whole": False}, around, start, around[4:] == END)

        yield from _batches(each())

    rest = known.alias("p").join(states.alias("a"), keys).select("p.*", F.col("a.around")[0].alias("state")).mapInArrow(solve, _PIECE_DDL)
    return pieces.where("whole").unionByName(rest).drop("x", "codes")


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(turns: list[tuple[int, int]], n: int) -> int:
    return min(_MAX, max(t[1] for t in turns) - min(t[0] for t in turns) + 1 - n) if turns else 0


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come in order."""
    schema = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in _DIGEST.split(", "))])

    def done(now: dict) -> dict:
        counts = {c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")}
        return counts | {"gaps": _gaps(now["turns"], now["n_turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

    now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    out.append(done(now))
                now = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["cost"], "turns": [], "n_turns": 0, "audit": [], "sha": hashlib.sha256(), "rows": 0, "class": None, "turn": None}
            for c in ("blank", "duplicate", "truncated"):
                now[c] += r[c]
            now["illegal"] += r["illegal"] + (now["class"] is not None and (now["class"], r["first_class"]) not in _LEGAL)
            now["n_turns"] += r["n_turns"] - (r["first_turn"] is not None and r["first_turn"] == now["turn"])
            if r["least_turn"] is not None:
                now["turns"] = [(min([r["least_turn"], *(t[0] for t in now["turns"])]), max([r["most_turn"], *(t[1] for t in now["turns"])]))]
            now["class"], now["turn"] = r["last_class"], r["last_turn"]
            now["audit"].append(r["edits"])
            for role, text in zip(r["roles"], r["texts"], strict=True):
                now["sha"].update(("\n" if now["rows"] else "").encode() + f"{role}:{text}".encode())
                now["rows"] += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([done(now)], schema)


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of repair()'s pieces: gaps in its turns, counts of faults, cost, all its edits, and the SHA-256 of its repaired rows as `role:text` lines."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)), "\n")
    turns = F.col("most_turn").cast("decimal(38,0)") - F.col("least_turn").cast("decimal(38,0)") + 1 - F.col("n_turns").cast("decimal(38,0)")
    gaps = F.when(F.col("n_turns") > 0, F.least(turns, F.lit(_MAX).cast("decimal(38,0)")).cast("long")).otherwise(F.lit(0).cast("long"))
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    rest = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(_digested, _DIGEST)
    return whole.unionByName(rest)
