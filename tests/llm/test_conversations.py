"""The repair of conversations against a plain search, with long, blank, repeated and null rows."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from saccadia.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted():
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                for x in follows[state].replace("s", ""):
                    new = (cost + 3, audit + "I", kept + (name[x] + ":",))
                    best[x] = min(best.get(x, new), new)

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        inserted()
        new = {}
        for state, (cost, audit, kept) in best.items():
            ways = [(state, (cost + 4, audit + "D", kept))]
            if fault not in ("b", "d"):
                late = 3 * (fault == "t")
                if role[:1] and role[0] in follows[state]:
                    ways.append((role[0], (cost + late, audit + "K", kept + (f"{role}:{text}",))))
                ways += [(x, (cost + late + 3, audit + "R", kept + (f"{name[x]}:{text}",))) for x in follows[state].replace("s", "")]
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best.clear()
        best.update(new)
    if rows:
        inserted()
    cost, audit, kept = min(best[x] for x in ("", "a") if x in best)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def compare(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumns({"n": F.lit("x"), "at": F.lit(1), "fault": F.lit(2), "node": F.lit(3)})
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damage(df), df).collect()}
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    want = {c: brute(by.get(c, [])) for c in {r[0] for r in rows}}
    assert got == want


def sample(rng, conv, n):
    texts = ["Yes.", "No!", "so it", "Why? ", "", " \t", None, "é ü.", "a.b", "x\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "agent"]
    return [(conv, rng.choice([i, i, i, i + 1, None]), rng.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], rng.choice([*texts, f"line {rng.randrange(40)}.", f"cut {i}"])) for i in range(n)]


def test_small_conversations(spark):
    rng = random.Random(3)
    compare(spark, [r for c in range(120) for r in sample(rng, c if c else None, rng.randrange(1, 9))])


def test_long_conversations(spark):
    """Many blocks in several parts; one text in a third of all rows; one row repeated many times."""
    rng = random.Random(4)
    rows = sample(rng, 7, 9000) + sample(rng, 8, 300) + [(9, 0, "user", "Same.")] * 500 + [(9, 1, "assistant", "Ok.")]
    compare(spark, rows + [(7, 20_000 + i, "user", "Again and again.") for i in range(4000)])


def test_dropped_conversation_and_no_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    compare(spark, [(gone, 0, "user", "Hi."), (None, None, None, None)])
    df = spark.createDataFrame([], ROWS)
    assert conversations.repair(conversations.damage(df), df).collect() == []


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 3, "assistant", "Hi."), (1, 4, "user", "Bye."), (1, 4, "user", "Bye."), (2, 0, "user", "")], ROWS)
    got = [tuple(r) for r in conversations.repaired_turns(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi."), (1, 3, "user", "Bye."), (1, 4, "assistant", "")]
