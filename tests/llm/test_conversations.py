"""Repair of conversations against a plain search over whole conversations, and that against all edits of short ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskmart.llm import conversations, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = SPACE.findall(text)
        out.append((role, text, "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, repaired rows): the least (cost, edits) to each state, row by row."""
    at = {"": (0, "", [])}

    def inserted(at):
        for _ in range(3):
            for s, (cost, edits, kept) in list(at.items()):
                t = NEXT[s]
                new = (cost + 2, edits + "I", [*kept, NAMES[t] + ":"])
                if t not in at or new[:2] < at[t][:2]:
                    at[t] = new
        return at

    for role, text, fault in rows:
        new, more = {}, fault == "truncated"
        for s, (cost, edits, kept) in inserted(at).items():
            ways = [(s, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                ways.append((NEXT[s], 2 + more, "R", [f"{NAMES[NEXT[s]]}:{text}"]))
                if role[:1] == NEXT[s] or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], more, "K", [f"{role}:{text}"]))
            for t, c, letter, line in ways:
                x = (cost + c, edits + letter, kept + line)
                if t not in new or x[:2] < new[t][:2]:
                    new[t] = x
        at = new
    return min((x for s, x in inserted(at).items() if s in ("", "a")), key=lambda x: x[:2])


def brute(rows):
    out, convs = [], {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for r in damaged(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in own if r[1] is not None]
        found = faults(own)
        count = lambda kind: sum(x[2] == kind for x in found)
        cost, edits, lines = cheapest(found) if own else (0, "", [])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations_of(seed, n=60, longest=9):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", " \t", None, "hi.", "yes", "no!", "ça va?", "x" * rng.randrange(1, 9) + rng.choice(".!? , "), f"t{rng.randrange(10**6)}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Unknown"])
    return [(rng.choice([c, c, c, None]) if c % 9 == 0 else c, rng.choice([t, t, t, t, None, 2, t + 5]), role(), text()) for c in range(n) for t in range(rng.randrange(1, longest))]


def run(spark, rows, tmp_path, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).withColumns({"row": F.lit("r"), "marker": F.lit(1), "part": F.lit(0)})
    pieces = conversations.repair(conversations.damage(df), **how)
    return pieces, sorted((tuple(r) for r in conversations.digests(pieces).collect()), key=repr)


def with_rows(expected, rows):
    """Conversations that have a row after the damage."""
    there = {r[0] for r in damaged(rows)}
    return [x for x in expected if x[0] in there]


def test_the_plain_search_finds_the_least_of_all_edits():
    rng = random.Random(8)
    legal = re.compile(r"(s?(ua)+)?")
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c"]), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(0, 4))]
        best = None
        inserts = ["", "u", "a", "ua", "au"]
        for edits in itertools.product(*[["D"] if f == "blank" else ["D", "K", "u", "a"] for _, _, f in rows]):
            for put in itertools.product(inserts, repeat=len(rows) + 1):
                roles, letters, cost = put[0], "I" * len(put[0]), 2 * sum(map(len, put))
                for (role, _, fault), e, more in zip(rows, edits, put[1:], strict=True):
                    letters += ("R" if e in "ua" else e) + "I" * len(more)
                    roles += ("" if e == "D" else role[0] if e == "K" else e) + more
                    cost += {"D": 3, "K": 0}.get(e, 2) + (fault == "truncated" and e != "D")
                if legal.fullmatch(roles) and (best is None or (cost, letters) < best):
                    best = (cost, letters)
        assert cheapest(rows)[:2] == best


@pytest.mark.parametrize("seed", [1, 2])
def test_short_conversations(spark, tmp_path, seed):
    rows = conversations_of(seed)
    pieces, got = run(spark, rows, tmp_path)
    assert got == with_rows(brute(rows), rows)
    letters = pieces.select(F.length(F.regexp_replace("edits", "D", "")).alias("kept"), F.size("roles").alias("roles"), F.size("texts").alias("texts")).collect()
    assert all(r.kept == r.roles == r.texts for r in letters)


@pytest.mark.parametrize("span", [2, conversations.SPAN])
def test_one_conversation_has_most_rows(spark, tmp_path, span):
    """It lies over all partitions, in chunks of three rows; groups of two chunks need several levels."""
    rng = random.Random(5)
    role = lambda t: rng.choice(["user", "assistant", "system"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
    hot = [(7, t, role(t), rng.choice(["same.", f"t{t}.", f"cut {t}", " "])) for t in range(400)]
    rows = hot + conversations_of(6, 30)
    pieces, got = run(spark, rows, tmp_path, chunk_rows=3, span=span)
    assert got == with_rows(brute(rows), rows)
    assert pieces.where("conv_id = 7").count() > 100


def test_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None), (1, None, "user", "a."), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b."), (None, 3, "system", "s."), (None, 3, "system", "s."), (3, 1, "system", "only."), (4, 0, "", "x."), (4, 1, "user", "y" * 3_000_000 + "."), (4, 1, "assistant", "z.")]
    assert run(spark, rows, tmp_path)[1] == with_rows(brute(rows), rows)
    assert run(spark, [], tmp_path)[1] == []


def test_query_has_every_conversation(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(150) for t in range(1 + c % 3)] + [(None, 1, "user", "a.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op13_conversations(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    gone = {r[0] for r in rows} - {r[0] for r in damaged(rows)}
    assert gone and all(r[1:-1] == (0, 0, 0, 0, 0, 0, "") for r in got if r[0] in gone)
