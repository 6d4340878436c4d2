"""The mixing model against a plain one that takes decisions one by one, and against other layouts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saccadia.llm import lm

BITS, HEAD = 11, 40


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    follow = {w: rng.choices(words, k=3) for w in words}
    texts = []
    for _ in range(90):
        w, out = rng.choice(words), []
        for _ in range(rng.choice([0, 3, 40, 400])):
            out.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow.get(w, words)) if rng.random() < 0.9 else rng.choice([*words, f"rare{rng.randrange(99)}"])
        texts.append(" ".join(out))
    return [(i, t) for i, t in enumerate(texts)] + [(200, None), (None, "w1 w2 w3"), (5, texts[5]), (5, texts[5])]


def brute(rows, teaches):
    """log10 score of each row by its (id, text)."""
    train = [(i, t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    tokens = lambda t: [*lm.text_words(t), lm.END_WORD]
    counts = Counter(w for _, t in train for w in tokens(t))
    # the head: steps of 64 to a doubling, from the top
    steps, kept, room = {}, set(), HEAD
    for w, n in counts.items():
        if n > 1:
            steps.setdefault(math.floor(math.log2(n) * 64), []).append(w)
    for s in sorted(steps, reverse=True):
        if len(steps[s]) > room:
            break
        kept |= set(steps[s])
        room -= len(steps[s])
    top = [lm.END_WORD, *sorted(kept - {lm.END_WORD}, key=lambda w: (-counts[w], w))]
    rare = [w for w in counts if w not in kept and w != lm.END_WORD]
    code = lm.Coder(top, np.array([counts[w] for w in top]), sum(counts[w] for w in rare) + len(rare) + 1, BITS)

    def walk(t):
        bit, path, slots, _, _ = code.decisions(tokens(t))
        return [(int(b), float(code.plain[p]), int(code.deep[p]), [int(s[k]) for s in slots]) for k, (b, p) in enumerate(zip(bit, path, strict=True))]

    seen = [Counter(), Counter()]

    def count(some):
        for _, t in some:
            for b, _, _, slots in walk(t):
                for c, s in zip(seen, slots, strict=True):
                    c[s, b] += 1

    def stretched(plain, deep, slots):
        x = [np.float32(np.rint(np.clip(math.log((c[s, 1] + lm.FLOOR) / (c[s, 0] + lm.FLOOR)), -8, 8) * lm.SCALE)) * np.float32(1 / lm.SCALE) for c, s in zip(seen, slots, strict=True)]
        sure = [int(abs(v) > 0.3) + int(abs(v) > 1.5) for v in x]
        return deep + sure[0] + 4 * sure[1], np.array([plain, *x], float)

    own = [r for r in train if r in teaches]
    count([r for r in train if r not in teaches])
    w = np.repeat([[0.7, 0.3, 0.3]], lm.GATES, 0)
    for _ in range(lm.STEPS):
        g, h = np.zeros((lm.GATES, 3)), np.zeros((lm.GATES, 3, 3))
        for _, t in own:
            for b, plain, deep, slots in walk(t):
                gate, x = stretched(plain, deep, slots)
                p = 1 / (1 + math.exp(-w[gate] @ x))
                g[gate] += (b - p) * x
                h[gate] += p * (1 - p) * np.outer(x, x)
        w = np.clip(w + np.array([np.linalg.solve(a + lm.DAMP * np.eye(3), v) for a, v in zip(h, g, strict=True)]), -0.2, 2)
    count(own)
    out = {}
    for i, t in rows:
        bits, g, h = 0.0, np.zeros(3), np.zeros((3, 3))
        held = walk(t)
        for at in range(0, len(held), lm.BLOCK):
            share = 1 + np.clip(np.linalg.solve(h + lm.DAMP_TEXT * np.eye(3), g), -0.9, 2)
            for b, plain, deep, slots in held[at : at + lm.BLOCK]:
                gate, x = stretched(plain, deep, slots)
                y = w[gate] * x
                z = float(np.clip(share @ y, -16, 16))
                bits += math.log2(1 + math.exp(-z if b else z))
                p = 1 / (1 + math.exp(-y.sum()))
                g, h = g + (b - p) * y, h + p * (1 - p) * np.outer(y, y)
        for word in tokens(t):
            if word not in code.index or code.index[word] >= code.esc:
                bits += math.log2(code.room) - math.log2(counts[word] + 1)
        out[i, t] = -bits * math.log10(2)
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    teaches = {tuple(r) for r in df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(lm.PART)) == lm.PART - 1).collect()}
    layouts = [[tuple(r) for r in lm.score_texts(df.repartition(n), head=HEAD, bits=BITS).join(df.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "text", "score", "base_score", "held_out").distinct().collect()] for n in (1, 16)]
    return rows, teaches, layouts


def test_one_score_for_any_layout(scored):
    one, many = ({r[:2]: r[2] for r in rows} for rows in scored[2])
    assert one.keys() == many.keys()
    assert max(abs(many[k] / v - 1) for k, v in one.items()) < 1e-6


def test_score_against_brute_force(scored):
    rows, teaches, (got, _) = scored
    want = brute(rows, teaches)
    for i, t, score, _, _ in got:
        assert score == pytest.approx(want[i, t], rel=1e-5)


def test_mix_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored[2][0] if r[4]]
    assert len(held) > 8 and sum(r[2] for r in held) > sum(r[3] for r in held)


def test_texts_are_read_four_times(spark):
    """To count words, to fill slots, to keep the rows that teach the weights, and to score; no Newton step reads them."""
    seen, rows = spark.sparkContext.accumulator(0), corpus()[:40]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).mapInArrow(counted, "doc_id long, text string")
    assert len(lm.score_texts(df, head=HEAD, bits=BITS).collect()) == 40
    assert 0 < seen.value <= 4 * 40


ASCII = "".join(chr(k) + "x" for k in range(128))
AWKWARD = [None, "", " \n\t ", "a\x1cb \x1d\x1e c\x1f\x85 d\u2003e\xa0f", ASCII, "ÀÉ İ ABC\x0bQ\x0c", " lead", "trail\r\n", "\x00 \x00\x00", "", "last"]


@pytest.mark.parametrize("part", [slice(0, 11), slice(3, 8), slice(1, 3), slice(0, 1), slice(10, 11), slice(0, 0)])
def test_texts_split_at_once_as_one_by_one(part):
    texts = pa.array(AWKWARD, pa.string())[part]  # a slice begins inside the array's buffers
    first, words = lm.split_texts(texts)
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(first, first[1:], strict=False)] == [lm.text_words(t) for t in texts.to_pylist()]


def test_places_and_odd_words_of_pieces():
    code = lm.Coder([lm.END_WORD, b"x", b"a", b"lead"], np.array([9, 5, 4, 2]), 7, BITS)
    index = code.index
    for most in (1, 20, 1 << 20):
        got = []
        for piece in lm._pieces(pa.array(AWKWARD, pa.string()), most):
            ids, start, words, _ = code.text_places(piece)
            odd = lm._odd(ids, start, words).to_pylist()
            got += [(ids[a:b].tolist(), dict(o)) for a, b, o in zip(start, start[1:], odd, strict=False)]
        want = [[*lm.text_words(t), lm.END_WORD] for t in AWKWARD]
        assert got == [([index.get(w, -1) for w in ws], dict(Counter(w for w in ws if w not in index))) for ws in want]


def test_words_counted_over_flushes(spark, monkeypatch):
    rows = [t for _, t in corpus() if t] * 2
    want = Counter(w for t in rows for w in [*lm.text_words(t), lm.END_WORD])
    df = spark.createDataFrame([(t,) for t in rows], "text string").coalesce(2)
    for flush, piece in ((lm.FLUSH, lm.PIECE), (100, 500), (0, 1)):
        monkeypatch.setattr(lm, "FLUSH", flush)
        monkeypatch.setattr(lm, "PIECE", piece)
        assert {bytes(r["word"]): r["n"] for r in lm.word_counts(df).collect()} == want
