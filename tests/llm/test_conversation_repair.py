"""Conversation repair against a plain dynamic programme over every conversation."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heddle.llm import conversation_repair as cr

WHITE = " \t\n\v\f\r"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        way = zlib.crc32(key.encode()) % 20
        if way == 0:
            continue
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if way == 3 else 1)
    return out


def best_edits(rows, faults):
    """(cost, audit, lines) by trying every edit of every prefix; nothing but the definition."""
    states = {"": (0, "", [])}  # by what matters of the initials: "", "s", "u", "a"

    def push(into, initial, label):
        if initial not in into or label[:2] < into[initial][:2]:
            into[initial] = label

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    whole = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for q, (c, e, lines) in list(out.items()):
                for i in follows[q].replace("s", ""):
                    push(out, i, (c + 3, e + "I", [*lines, whole[i] + ":"]))
        return out

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        states, after = inserted(states), {}
        for q, (c, e, lines) in states.items():
            push(after, q, (c + 4, e + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] and role[:1] in follows[q]:
                push(after, role[:1], (c + more, e + "K", [*lines, f"{role}:{text}"]))
            for i in follows[q].replace("s", ""):
                push(after, i, (c + 3 + more, e + "R", [*lines, f"{whole[i]}:{text}"]))
        states = after
    ends = [v for q, v in inserted(states).items() if q in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def brute(ids, rows):
    out = {}
    for conv in set(ids):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, lines = best_edits(mine, faults)
        turns = {r[1] for r in mine} - {None}
        pairs = list(zip(mine, mine[1:], strict=False))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(n, seed, longest=9):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if turn else pick.choice(["system", "user", "user"])
            text = pick.choice(["Yes.", "No!", "Why?", "so it goes", " ", "", None, "a.\n", "end. \v\f", "ünï?", "x "])
            rows.append((pick.choice([conv, conv, conv, None]) if conv % 7 == 0 else conv, pick.choice([turn, turn, turn, turn + 2, None, 1]), role, text))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def answers(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_against_brute_force(spark, piece):
    rows = made(60, piece)
    docs = frame(spark, rows).withColumn("CODE", F.lit("clash")).withColumn("digest", F.lit(1))
    got = answers(cr._repair(docs.select("conv_id"), cr.damage(docs), piece))
    assert got == brute([r[0] for r in rows], damaged(rows))


def test_the_query_and_rows_that_all_go(spark, tmp_path):
    gone = [c for c in range(400) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,))][:3]
    rows = made(30, 5) + [(c + 0, 0, "user", "Hi.") for c in gone if c >= 30]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = answers(cr.op11_conversation_repair(spark, str(tmp_path)))
    assert got == brute([r[0] for r in rows], damaged(rows))
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())


def test_one_long_conversation_and_repeats_in_pieces(spark):
    pick = random.Random(3)
    rows = [(1, t // 3, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", f"No {t}!", f"cut {t}", ""])) for t in range(700)] + [(2, 0, "user", "Same.")] * 300
    got = answers(cr.repair_damaged(frame(spark, rows, 8), 50))
    assert got == brute([1, 2], rows)


def test_no_rows(spark):
    docs = frame(spark, [])
    assert answers(cr._repair(docs.select("conv_id"), cr.damage(docs))) == {}


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_edits(seed):
    pick = random.Random(seed)
    for _ in range(300):
        codes = bytes(pick.choice([0, 1, 2, 3]) | pick.choice([0, 0, 0, cr.BLANK, cr.DUPLICATE, cr.TRUNCATED]) for _ in range(pick.randint(1, 9)))
        rows = [(0, 0, "sua?"[c & 3], "t") for c in codes]
        faults = ["blank" if c & 12 else "truncated" if c & 16 else None for c in codes]
        assert cr.solve(codes) == best_edits(rows, faults)[:2]


def test_a_long_search_is_linear():
    pick = random.Random(1)
    codes = bytes(pick.choice([0, 1, 2, 3, 5, 18]) for _ in range(cr.PIECE))
    cost, letters, state = cr.cheapest(codes, cr.START)
    assert len(letters.replace("I", "")) == cr.PIECE and cr.costs_from(codes, cr.START)[state] + cr.TAIL_COST[state] == cost
