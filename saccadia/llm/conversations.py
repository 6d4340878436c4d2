"""Repairing the structure of conversations by a fold over their turns.

Turns are put in order once over the whole table (`blocks.in_order`), so a conversation of
any length lies in pieces of bounded size. Window functions over the pieces give each turn
its fault. Blocks of `2**BITS` turns are collected as sorted structs, and aggregate() folds
a block while it carries four (cost, audit) structs, one for each state of the wanted shape
`(s?(ua)+)?`: e (nothing yet), s, u, a. Each step takes the cheapest of deleting, keeping,
changing or inserting by least() over the structs, so ties go to the smallest audit. Blocks
other than a conversation's first are folded from all four states; blocks of blocks then
combine these in the same way, level by level, until a conversation is one row. The choices
go back down by joins on (conversation, block). Only the hash of a repaired conversation is
a chain from turn to turn: one task streams its texts in order and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.tables import released, written
from saccadia.llm.common import BLANKS, let
from saccadia.operators.blocks import in_order, pieces, scan

#: log2 of the turns in a block, and of the blocks in a block of the next level.
BITS = 6
STATES = "esua"
DELETE, CHANGE, INSERT, CUT = 4, 3, 3, 3
#: Initials of roles that may follow each other.
LEGAL = ("su", "ua", "au")
_KEYS = ["conv_id", "turn", "role", "text_md5"]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies` (1 or 2) after the damage drawn by crc32 of `conv_id:turn` mod 20.

    0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its
    role user. Nulls count as one space, in the drawn text as in role and text; a null turn
    or conv_id stays null. Other columns are not read.
    """
    space = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return rows.filter(drawn != 0).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(drawn == 4, "user").otherwise(role).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(drawn == 3, 2).otherwise(1).alias("copies"),
    )


def _plain(rows: DataFrame) -> DataFrame:
    """The columns that the repair reads; nulls in role and text are one space."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.md5(text)).alias("text_md5"), text.alias("text"), copies.alias("copies"),
    )


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A narrow row for each distinct turn, in order, and the ordered table that it reads.

    Columns: the keys, n (equal rows), k (place in the conversation), initial, fault (b blank,
    d duplicate, t truncated, else empty), clash (the initials before and here may not follow
    each other), new_turn (not the turn number before), ends (nothing follows).
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = F.length(bare) == 0
    own = F.when(blank, "b").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    turns = _plain(rows).groupBy(*_KEYS).agg(F.sum("copies").alias("n"), F.max(own).alias("own"))
    ordered = in_order(turns.withColumn("initial", F.substring("role", 1, 1)), _KEYS, name="turns")
    # first in its piece, by a window; then first of the pieces, where a conversation has several
    first = F.row_number().over(Window.partitionBy("part", "conv_id", "role", "text_md5").orderBy("at"))
    split = pieces(ordered, ["conv_id"]).select(F.col("part").alias("p"), F.col("conv_id").alias("c"))
    crossing = ordered.join(F.broadcast(split), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    heads = crossing.groupBy("conv_id", "role", "text_md5", "part").agg(F.min("at").alias("head"))
    again = heads.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text_md5").orderBy("part"))).filter("nth > 1").select("head")
    marked = ordered.withColumn("nth", first)
    around = scan(marked, ["conv_id"], k=("sum", F.lit(1)), was=("lag", F.struct("initial", "turn")), then=("lead", F.col("at")))
    flagged = around.join(again, F.col("at") == F.col("head"), "left")
    twice = (F.col("nth") > 1) | F.col("head").isNotNull()
    return flagged.select(
        *_KEYS, "n", (F.col("k") - 1).alias("k"), "initial", F.when(F.col("own") == "b", "b").when(twice, "d").otherwise(F.col("own")).alias("fault"),
        (F.col("was").isNotNull() & ~F.concat(F.col("was.initial"), F.col("initial")).isin(*LEGAL)).alias("clash"),
        (F.col("turn").isNotNull() & (F.col("was").isNull() | F.col("was.turn").isNull() | (F.col("was.turn") != F.col("turn")))).alias("new_turn"),
        F.col("then").isNull().alias("ends"),
    ), ordered


def _and(x: Column, cost: Column | int, letters: Column | str) -> Column:
    """A (cost, audit) struct with more of both."""
    cost, letters = (v if isinstance(v, Column) else F.lit(v) for v in (cost, letters))
    return F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], letters).alias("audit"))


def _four(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _fold(turns: Column, entry: str) -> Column:
    """The four (cost, audit) structs after a block's sorted turns, from one state before them.

    A state that can't be reached has a cost beyond all others. Copies of a turn must go:
    they follow it as letters d, which no other letter is ever compared with.
    """
    start = [F.struct(F.lit(0 if x == entry else 1 << 40).cast("long").alias("cost"), F.lit("").alias("audit")) for x in STATES]

    def opened(c):
        """After insertions before the turn: a user turn after e, s or a, an assistant turn after u."""
        with_u = _four(c["e"], c["s"], F.least(c["u"], _and(F.least(c["e"], c["s"], c["a"]), INSERT, "I")), c["a"])
        return let(with_u, lambda d: _four(d["e"], d["s"], d["u"], F.least(d["a"], _and(d["u"], INSERT, "I"))))

    def taken(c, t):
        late = F.when(t["fault"] == "t", CUT).otherwise(0)
        stays = ~t["fault"].isin("b", "d")

        def into(before, initial):
            """Kept where the initial is right, else changed; null, which least() passes over, where it must go."""
            return F.when(stays & (t["initial"] == initial), _and(before, late, "K")).when(stays, _and(before, late + CHANGE, "R"))

        return _four(
            _and(c["e"], DELETE, "D"),
            F.least(_and(c["s"], DELETE, "D"), F.when(stays & (t["initial"] == "s"), _and(c["e"], late, "K"))),
            F.least(_and(c["u"], DELETE, "D"), into(F.least(c["e"], c["s"], c["a"]), "u")),
            F.least(_and(c["a"], DELETE, "D"), into(c["u"], "a")),
        )

    def step(c, t):
        def copies(d):
            more = [_and(d[x], (t["n"] - 1) * DELETE, F.repeat(F.lit("d"), (t["n"] - 1).cast("int"))) for x in STATES]
            return F.when(t["n"] > 1, _four(*more)).otherwise(d)

        return let(let(let(c, opened), lambda d: taken(d, t)), copies)

    return F.aggregate(turns, _four(*start), step)


def _choice(cost: Column, audit: Column, path: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"), path.alias("path"))


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, node, ends, head (keys of its first turn) and `ways`: 16 (cost, audit, path), entry state by exit state."""
    one = F.struct("k", "initial", "fault", "n")
    found = turns.groupBy("conv_id", F.shiftright("k", BITS).alias("node")).agg(F.max("ends").alias("ends"), F.min(F.struct("k", *_KEYS[1:])).alias("head"), F.array_sort(F.collect_list(one)).alias("turns"))
    kind = "array<struct<cost:long,audit:string,path:string>>"

    def ways(entry):
        return let(_fold(F.col("turns"), entry), lambda c: F.array(*[_choice(c[x]["cost"], c[x]["audit"], F.lit("")) for x in STATES]))

    # a conversation starts from nothing: its first block needs no other entry
    later = F.when(F.col("node") > 0, F.concat(*[ways(x) for x in STATES[1:]])).otherwise(F.array().cast(kind))
    return found.select("conv_id", "node", "ends", "head", F.concat(ways("e"), later).cast(kind).alias("ways"))


def _joined(below: DataFrame) -> DataFrame:
    """Blocks of the next level: for each entry the cheapest way to each exit through all of a block's children.

    `path` has the state after each child.
    """
    found = below.groupBy("conv_id", F.shiftright("node", BITS).alias("node")).agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("node", "ways"))).alias("parts"))

    def from_state(entry):
        zero = F.array(*[_choice(F.lit(0 if y == entry else 1 << 40).cast("long"), F.lit(""), F.lit("")) for y in range(4)])

        def by(c, y, v, x):
            return _choice(c[y]["cost"] + v["cost"], F.concat(c[y]["audit"], v["audit"]), F.concat(c[y]["path"], F.lit(str(x))))

        def to(c, w, x):
            return F.least(*[by(c, y, F.get(w, F.lit(4 * y + x)), x) for y in range(4)])

        def step(c, part):
            # a first block has ways from e alone
            full = F.when(F.size(part["ways"]) == 16, part["ways"]).otherwise(F.concat(part["ways"], F.array_repeat(_choice(F.lit(1 << 41), F.lit(""), F.lit("")), 12)))
            return let(full, lambda w: F.array(*[to(c, w, x) for x in range(4)]))

        return F.aggregate("parts", zero, step)

    later = F.when(F.col("node") > 0, F.concat(*[from_state(y) for y in (1, 2, 3)])).otherwise(F.array().cast("array<struct<cost:long,audit:string,path:string>>"))
    return found.select("conv_id", "node", "ends", F.concat(from_state(0), later).alias("ways"))


#: A block that is a whole conversation.
_WHOLE = "node = 0 and ends"
#: Insertions that close a conversation from each state.
_CLOSING = ("", "II", "I", "")


def _closed(nodes: DataFrame) -> DataFrame:
    """Rows of whole conversations with `best` (cost, audit, exit): the cheapest end that the shape allows."""
    ends = [F.struct((F.get("ways", F.lit(x))["cost"] + INSERT * len(more)).alias("cost"), F.concat(F.get("ways", F.lit(x))["audit"], F.lit(more)).alias("audit"), F.lit(x).alias("exit")) for x, more in enumerate(_CLOSING)]
    return nodes.filter(_WHOLE).withColumn("best", F.least(*ends))


def _decided(turns: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(conv_id, cost, audit) of each conversation; (conv_id, head, letters) of each block; the tables they read."""
    levels = [written(_blocks(turns), "blocks-0")]
    while not (rest := levels[-1].filter(f"not ({_WHOLE})")).isEmpty():
        levels.append(written(_joined(rest), f"blocks-{len(levels)}"))
    costs, chosen = None, None
    for depth in reversed(range(len(levels))):
        whole = _closed(levels[depth])
        cost = whole.select("conv_id", F.col("best.cost").alias("cost"), F.translate("best.audit", "d", "D").alias("audit"))
        costs = cost if costs is None else costs.unionByName(cost)
        mine = whole.select("conv_id", "node", F.lit(0).alias("entry"), F.col("best.exit").alias("exit"), *(["head"] if not depth else []), "ends", "ways")
        if chosen is not None:
            keys = chosen.withColumnsRenamed({"conv_id": "c", "node": "v"})
            told = levels[depth].join(keys, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("v"))).drop("c", "v")
            mine = mine.unionByName(told)
        way = F.get("ways", 4 * F.col("entry") + F.col("exit"))
        if depth:
            # children of a node are numbered without gaps
            parts = mine.select("conv_id", "node", "entry", way["path"].alias("path")).withColumn("j", F.explode(F.sequence(F.lit(0), F.length("path") - 1)))
            state = lambda j: F.expr(f"cast(substring(path, {j}, 1) as int)")
            entry = F.when(F.col("j") == 0, F.col("entry")).otherwise(state("j"))
            chosen = parts.select("conv_id", (F.shiftleft("node", BITS) + F.col("j")).alias("node"), entry.alias("entry"), state("j + 1").alias("exit"))
        else:
            closing = F.when(F.col("ends"), F.element_at(F.array(*map(F.lit, _CLOSING)), F.col("exit") + 1)).otherwise("")
            letters = mine.select("conv_id", "head", F.concat(way["audit"], closing).alias("letters"))
    return costs, letters, levels


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of repaired turns, from rows sorted by conversation, key and kind.

    Rows of kind 0 bring a block's letters just before its first turn, rows of kind 1 a turn.
    Copies of a turn are passed over: their letters d say that they go.
    """
    conv = turn = None
    started, letters, at, state = False, "", 0, "e"

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] in "Id":
            if letters[at] == "I":
                state = "a" if state == "u" else "u"
                yield conv, {"u": "user", "a": "assistant"}[state], ""
            at += 1

    for b in batches:
        for c, t, role, md5, kind, text, more in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if not started or c != conv:
                if started:
                    yield from inserted()
                started, conv, turn, letters, at, state = True, c, None, "", 0, "e"
            if kind == 0:
                yield from inserted()
                letters, at = more, 0
                continue
            if turn == (t, role, md5):
                continue
            turn = (t, role, md5)
            yield from inserted()
            done = letters[at]
            at += 1
            if done == "R":
                state = "a" if state == "u" else "u"
                yield conv, {"u": "user", "a": "assistant"}[state], text
            elif done == "K":
                state = role[0]
                yield conv, role, text
    if started:
        yield from inserted()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha, ids, hashes = None, None, [], []
    for c, role, text in _replayed(batches):
        piece = f"{role}:{text}".encode("utf-8", "surrogatepass")
        if sha is None or c != conv:
            if sha is not None:
                ids.append(conv)
                hashes.append(sha.hexdigest())
            conv, sha = c, hashlib.sha256(piece)
        else:
            sha.update(b"\n" + piece)
        if len(ids) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
            ids, hashes = [], []
    if sha is not None:
        ids.append(conv)
        hashes.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    started, conv, place = False, None, 0

    def batch():
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "place", "role", "text"])

    for c, role, text in _replayed(batches):
        place = place + 1 if started and c == conv else 0
        started, conv = True, c
        out.append((c, place, role, text))
        if len(out) >= 5_000:
            yield batch()
            out = []
    yield batch()


def _stream(rows: DataFrame, letters: DataFrame) -> DataFrame:
    texts = _plain(rows).select(*_KEYS, F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("letters"))
    first = letters.select("conv_id", *[F.col(f"head.{k}") for k in _KEYS[1:]], F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "letters")
    return texts.unionByName(first).repartition("conv_id").sortWithinPartitions(*_KEYS, "kind")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of each conversation after the cheapest repair.

    Null role and text count as one space; equal rows are duplicates; conversations that
    lose all their turns have no row.
    """
    turns, _ = faults(rows)
    _, letters, _ = _decided(turns)
    return _stream(rows, letters).mapInArrow(_turned, "conv_id long, place long, role string, text string")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conv_id of `ids`: its gaps, faults, cost, audit and the hash of its repaired turns.

    Turns are taken by turn (nulls first), then role, then a hash of the text; equal rows are
    copies of one turn, of which the first may stay. A turn's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (not ended by `.!?`). Null role and
    text count as one space; a null conv_id is a conversation like others. A conversation
    without rows has zeros, an empty audit and the hash of nothing; no ids give no rows.
    Further columns are not read.
    """
    turns, ordered = faults(rows)
    flagged = written(turns, "faults")
    released(ordered)
    costs, letters, levels = _decided(flagged)
    hashes = written(_stream(rows, letters).mapInArrow(_hashed, "conv_id long, repaired_sha256 string"), "repaired")
    n, fault, whole = F.col("n"), F.col("fault"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    seen = flagged.groupBy("conv_id").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.sum(F.col("new_turn").cast("long"))).cast("long").alias("gaps"),
        whole(F.when(fault == "b", n)).alias("blank"), whole(F.when(fault == "d", n).when(fault != "b", n - 1)).alias("duplicate"), whole(F.when(fault == "t", 1)).alias("truncated"),
        whole(n - 1 + F.col("clash").cast("long")).alias("illegal"),
    )
    out = ids.select(F.col("conv_id").cast("long")).distinct()
    for part in (seen, costs, hashes):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    nothing = hashlib.sha256(b"").hexdigest()
    zeros = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *[v.alias(k) for k, v in zeros.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
