"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. A frequent word is one symbol, any other the
escape; symbols are written in a Huffman code, so a text is a row of binary decisions. Each
decision is predicted by the code node alone, whose counts follow from the symbols' counts,
and by hashed contexts - the last word, and the last two - whose slots hold how often 0 and
1 came. The predictions are mixed in the logistic domain with weights gated by the depth of
the node and by how sure the contexts are. They are refined as a text goes on: before each
block of decisions, every predictor's share of the mix moves by a Newton step on the blocks
of that text before it. After an escape a word
has its add-one share of the words that have no symbol; words never seen in training share
one place there, just as in the unigram base, so both models spread over the same outcomes.
The sum of -log2 of all these probabilities is the text's bits.

Texts are split and words looked up by Arrow's kernels, a few megabytes at a time. Word
counts and slot counts cover all training rows; tasks count slots for their own rows and
the counts are added up in chunks. The weights are learned on one row in `PART` by a hash
of its id, against slots that the other rows alone have filled, by a few Newton steps whose
sums run over all these rows, kept as their words' places in the head; then these rows' slots are added. So neither the slots nor the
weights hang on how rows are dealt to tasks. What
is broadcast is bounded: 2**bits one-byte slots for each context, and `head` words with
their counts, of which the first `SYMBOLS` have a code. Words outside the head meet their
counts by an equality join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import fold, released, written

HEAD, SYMBOLS, BITS, CONTEXTS, CHUNK = 1 << 17, 1 << 14, 22, 2, 1 << 15
#: Decisions handled at once, decisions in an adaptive block, counted words held before a flush, and bytes of text split at once to count or to look up words.
BATCH, BLOCK, FLUSH, PIECE, LOOKED_UP = 400_000, 512, 300_000, 1 << 25, 1 << 23
GATES, SCALE, FLOOR = 64, 12.0, 0.4
#: One row in so many teaches the weights of the mix; Newton steps, and what damps them; the same for the steps within a text.
PART, STEPS, DAMP, DAMP_TEXT = 8, 4, 50.0, 200.0
END_WORD = b" "


def text_words(text: str | None) -> list[bytes]:
    """What `split_texts` gives for one text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_texts(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text and the number of all, all lower-cased words as binary)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    words, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # a text without words is split into one empty word
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return kept[edges], words.filter(full).cast(pa.binary())


def _pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of about `most` bytes."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    return (texts.slice(a, b - a) for a, b in _ranges(sizes, most))


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to hardly more than `most`."""
    upto, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(sizes):
        b = min(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")) + 1, len(sizes))
        yield a, b
        a = b


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all rows; the word ' ' is the end of a text."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        if len(tables) == 1:
            return tables[0]
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, []
        for b in batches:
            rows += b.num_rows
            for texts in _pieces(b.column(0), PIECE):
                found = split_texts(texts)[1].value_counts()
                seen.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(map(len, seen)) > FLUSH:
                    seen = [summed(seen)]
                    if len(seen[0]) > FLUSH // 2:
                        yield from seen.pop().to_batches()
        yield from summed([*seen, pa.table({"word": pa.array([END_WORD], pa.binary()), "n": pa.array([rows], pa.int64())})]).to_batches()

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n"))


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, node, bit): the path of symbol s is node/bit[start[s]:start[s + 1]]; nodes from 0."""
    n = len(weights)
    if n == 1:
        return np.array([0, 0]), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for new in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = new
        side[b] = 1
        heapq.heappush(heap, (wa + wb, new))
    paths, lens = [], np.zeros(n + 1, np.int64)
    for s in range(n):
        path, at = [], s
        while at != 2 * n - 2:
            path.append((int(parent[at]) - n, int(side[at])))
            at = int(parent[at])
        paths += path[::-1]
        lens[s + 1] = len(path)
    flat = np.array(paths, np.int64).reshape(-1, 2)
    return np.cumsum(lens), flat[:, 0].astype(np.uint32), flat[:, 1].astype(np.uint8)


class Coder:
    """Words to binary decisions with the slots of their contexts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: int, bits: int = BITS):
        """words: the end, then others from frequent to rare; rare: add-one counts of all further ones."""
        self.words = pa.array(words, pa.binary())
        self.counts, self.bits, self.esc = counts, bits, min(len(words), SYMBOLS)
        self.room = int((counts[self.esc :] + 1).sum()) + rare
        total = np.append(counts[: self.esc] + 1, self.room)
        start, self.node, self.bit = huffman(total)
        # what the node alone says, from how often the symbols under each side came
        under = np.zeros((2, len(total)))
        np.add.at(under, (self.bit, self.node), np.repeat(total, np.diff(start)).astype(float))
        odds = np.log((under[1] + FLOOR) / (under[0] + FLOOR)).clip(-8, 8)
        self.plain = odds[self.node].astype(np.float32)
        depth = np.arange(len(self.node)) - np.repeat(start[:-1], np.diff(start))
        self.deep = (np.digitize(depth, (3, 7, 12)) * 16).astype(np.uint8)
        self.key = self.node * np.uint32(0x9E3779B1)
        self.first_at, self.size = start[:-1], np.diff(start)

    @property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word among those of the head, -1 for others."""
        return pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False)

    def text_places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(place of each token, 0 for an end; first token of each text and the number of all; words, and the first of each text)."""
        first, words = split_texts(texts)
        start = first + np.arange(len(first))
        out = np.zeros(start[-1], np.int32)
        inner = np.ones(len(out), bool)
        inner[start[1:] - 1] = False
        out[inner] = self.places(words)
        return out, start, words, first

    def decisions(self, words: list[bytes]):
        """(bit, place in the code, slots by context, decisions of each word, ids with -1 for others)."""
        ids = self.places(pa.array(words, pa.binary()))
        return (*self.walk(ids), ids)

    def walk(self, ids: np.ndarray):
        """(bit, place in the code, slots by context, decisions of each token) of tokens by their places."""
        s = np.where((ids < 0) | (ids > self.esc), self.esc, ids)
        w = (ids + 2).astype(np.uint32)
        w1, w2 = (np.concatenate((np.zeros(k, np.uint32), w[:-k]))[: len(w)] for k in (1, 2))
        # nothing is known across the end of a text (id 0)
        w2[(w1 == 2) | (w2 == 2)] = 0
        w1[w1 == 2] = 0
        c = [w1 * np.uint32(0x9E3779B1), w1 * np.uint32(0x85EBCA77) + w2 * np.uint32(0xC2B2AE3D) + np.uint32(7)]
        n = self.size[s]
        ends = np.cumsum(n)
        path = np.repeat(self.first_at[s] - (ends - n), n)
        path += np.arange(len(path))
        key, slots = self.key.take(path), []
        for k in c:
            h = np.repeat(k, n)
            h ^= key
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x297A2D39)
            h >>= np.uint32(32 - self.bits)
            slots.append(h.astype(np.intp))
        return self.bit.take(path), path, slots, n


def _gates(deep, odds) -> np.ndarray:
    """Gate of each decision: the depth of its node, and how sure each hashed context is (log odds over 0.3, over 1.5)."""
    sure = [(x > 0.3 * SCALE).view(np.uint8) + (x > 1.5 * SCALE).view(np.uint8) for x in map(np.abs, odds)]
    return deep + sure[0] + sure[1] * np.uint8(4)


def _squash(z):
    return 1 / (1 + np.exp(-z))


def _from_texts(code: Coder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Places of tokens, whole texts of about BATCH // 12 tokens at a time."""
    for piece in _pieces(texts, LOOKED_UP):
        ids, start, _, _ = code.text_places(piece)
        for a, b in _ranges(np.diff(start), BATCH // 12):
            yield ids[start[a] : start[b]]


def _from_places(code: Coder, rows: pa.Array) -> Iterator[np.ndarray]:
    """The same from a row of `text_places` for each text."""
    sizes = pc.binary_length(rows).to_numpy()
    for a, b in _ranges(sizes, 4 * (BATCH // 12)):
        yield np.frombuffer(b"".join(rows.slice(a, b - a).to_pylist()), np.int32)


def text_places(docs: DataFrame, coder) -> DataFrame:
    """(places): the places of each text's tokens, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b.column(0), LOOKED_UP):
                ids, start, _, _ = coder.value.text_places(piece)
                yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].tobytes() for a, b in zip(start, start[1:], strict=False)], pa.binary())], ["places"])

    return written(docs.select(F.col("text").cast("string")).mapInArrow(run, "places binary"), "places")


def _initial() -> np.ndarray:
    """Weights by gate: the node alone, then the hashed contexts."""
    return np.repeat(np.array([[0.7, 0.3, 0.3]]), GATES, 0)


def slot_counts(rows: DataFrame, coder, read) -> DataFrame:
    """(context, at, data): counts of 0 and 1 by slot, chunk by chunk, of each task's rows, which `read` takes from the one column."""
    size = 1 << coder.value.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, pack = coder.value, zstandard.ZstdCompressor(1)
        seen, total = [np.zeros(2 * size, np.int32) for _ in range(CONTEXTS)], 0
        for ids in (i for b in batches for i in read(code, b.column(0))):
            bit, _, slots, _ = code.walk(ids)
            for t, s in zip(seen, slots, strict=True):
                s *= 2
                s += bit
                np.add.at(t, s, np.int32(1))
            total += len(bit)
        chunks = range(0, size, CHUNK) if total else ()
        rows = [(k, at, pack.compress(t[2 * at : 2 * (at + CHUNK)].tobytes())) for k, t in enumerate(seen) for at in chunks if t[2 * at : 2 * (at + CHUNK)].any()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["context", "at", "data"])

    return written(rows.mapInArrow(run, "context int, at long, data binary"), "slots")


def slot_tables(parts: DataFrame, bits: int) -> list[np.ndarray]:
    """A table of signed bytes for each context: the log odds of each slot's counts over all parts."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the sorted rows of each chunk, one row in memory at a time."""
        here, sums, out = None, None, []
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)

        def close():
            n0, n1 = sums[::2], sums[1::2]
            st = np.log((n1 + FLOOR) / (n0 + FLOOR)).clip(-8, 8)
            return (*here, pack.compress(np.rint(st * SCALE).astype(np.int8).tobytes()))

        for b in batches:
            for k, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, at) != here:
                    if here is not None:
                        out.append(close())
                    here, sums = (k, at), np.zeros(2 * CHUNK, np.int64)
                part = np.frombuffer(unpack.decompress(data), np.int32)
                sums[: len(part)] += part
        if here is not None:
            out.append(close())
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["context", "at", "data"])

    tables = [np.zeros(1 << bits, np.int8) for _ in range(CONTEXTS)]
    merged = parts.repartition("context", "at").sortWithinPartitions("context", "at").mapInArrow(add, "context int, at long, data binary")
    unpack = zstandard.ZstdDecompressor()
    for r in merged.toLocalIterator():  # the whole is 2**bits bytes a context
        part = tables[r["context"]][r["at"] : r["at"] + CHUNK]
        part[:] = np.frombuffer(unpack.decompress(bytes(r["data"])), np.int8)[: len(part)]
    return tables


def _stretched(path, slots, code, tables) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gate of each decision, and the log odds that the node alone and each context give."""
    odds = [t.take(s) for t, s in zip(tables, slots, strict=True)]
    return _gates(code.deep.take(path), odds).astype(np.intp), [code.plain.take(path), *(x * np.float32(1 / SCALE) for x in odds)]


_PAIRS = [(a, b) for a in range(CONTEXTS + 1) for b in range(a, CONTEXTS + 1)]


def mixing_weights(rows: DataFrame, coder, tables: list[np.ndarray]) -> np.ndarray:
    """Weights by gate: damped Newton steps on the log loss of all rows of `text_places`, each one aggregation of some hundred sums."""
    spark, weights, k = rows.sparkSession, _initial(), CONTEXTS + 1
    for _ in range(STEPS):
        model = spark.sparkContext.broadcast((tables, weights))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            code, (tabs, w) = coder.value, model.value
            sums = np.zeros((k + len(_PAIRS), GATES))
            for ids in (i for b in batches for i in _from_places(code, b.column(0))):
                bit, path, slots, _ = code.walk(ids)
                gate, st = _stretched(path, slots, code, tabs)
                p = _squash(sum(w[:, m].take(gate) * x for m, x in enumerate(st)))
                err, var = bit - p, p * (1 - p)
                for m, x in enumerate(st):
                    sums[m] += np.bincount(gate, err * x, GATES)
                for m, (x, y) in enumerate(_PAIRS):
                    sums[k + m] += np.bincount(gate, var * st[x] * st[y], GATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.reshape(-1))], ["cell", "value"])

        got = rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        model.destroy()
        sums = np.zeros((k + len(_PAIRS)) * GATES)
        for r in got:
            sums[r["cell"]] = r["value"]
        sums = sums.reshape(-1, GATES)
        hessian = np.zeros((GATES, k, k))
        for m, (a, b) in enumerate(_PAIRS):
            hessian[:, a, b] = hessian[:, b, a] = sums[k + m]
        step = np.linalg.solve(hessian + DAMP * np.eye(k), sums[:k].T[:, :, None])[:, :, 0]
        # sums in another order differ in their last digits: rounding takes these away
        weights = (weights + step).clip(-0.2, 2).round(6)
    return weights


def learn(docs: DataFrame, coder) -> tuple[list[np.ndarray], np.ndarray]:
    """(a slot table of signed bytes for each context, weights by gate) from all rows (doc_id, text)."""
    teaches = F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == PART - 1
    bits = coder.value.bits
    own = text_places(docs.filter(teaches), coder)
    parts = slot_counts(docs.filter(~teaches).select(F.col("text").cast("string")), coder, _from_texts)
    weights = mixing_weights(own, coder, slot_tables(parts, bits))
    more = slot_counts(own, coder, _from_places)
    tables = slot_tables(parts.unionByName(more), bits)
    released(parts, more, own)
    return tables, weights


def _bits(bit, path, slots, code, tables, weights, doc_of) -> np.ndarray:
    """-log2 probability of each decision, refined over the blocks of its text.

    doc_of: first decision of each text. Before a block, the share of each predictor is
    changed by one damped Newton step on all blocks of the text before it.
    """
    n = len(bit)
    gate, st = _stretched(path, slots, code, tables)
    w32 = weights.astype(np.float32)
    for m, x in enumerate(st):
        x *= w32[:, m].take(gate)
    z = sum(st)
    edges = np.unique(np.concatenate([doc_of, *(np.arange(a, b, BLOCK) for a, b in zip(doc_of, np.append(doc_of[1:], n), strict=True) if b - a > BLOCK)]))
    if len(edges) > len(doc_of):
        size, k = np.diff(np.append(edges, n)), len(st)
        p = _squash(z)
        err, var = bit - p, p * (1 - p)
        head = np.searchsorted(edges, doc_of)[np.searchsorted(doc_of, edges, "right") - 1]

        def before(v):
            """Sum over the blocks of the same text before each block."""
            c = np.add.reduceat(v, edges).astype(np.float64)
            c = np.cumsum(c) - c
            return c - c[head]

        g = np.stack([before(err * x) for x in st], -1)
        h = np.empty((len(edges), k, k))
        for a, b in _PAIRS:
            h[:, a, b] = h[:, b, a] = before(var * st[a] * st[b])
        move = np.linalg.solve(h + DAMP_TEXT * np.eye(k), g[:, :, None])[:, :, 0].clip(-0.9, 2).astype(np.float32)
        z = sum(x * np.repeat(1 + move[:, m], size) for m, x in enumerate(st))
    # log2(1 + e^-m) with m towards the bit that came; no chance is ever 0
    np.negative(z, out=z, where=bit > 0)
    cost = np.exp(z.clip(-16, 16, out=z), out=z)
    cost += 1
    return np.log(cost, out=cost) * np.float32(1 / np.log(2))


def _odd(ids, start, words) -> pa.Array:
    """For each text its words outside the head, with how often each comes in it."""
    at = np.flatnonzero(ids < 0)
    text = np.searchsorted(start, at, "right") - 1
    found = words.take(pa.array(at - text)).dictionary_encode()
    kinds = max(1, len(found.dictionary))
    pairs, times = np.unique(text * kinds + found.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(start)) * kinds).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), found.dictionary.take(pa.array(pairs % kinds)), pa.array(times))


def score_texts(docs: DataFrame, mod: int = 7, held: int = 2, head: int = HEAD, bits: int = BITS) -> DataFrame:
    """Scores of each row of documents under a unigram base and the mixed model.

    doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score and score (log10 probabilities), bits, n_bytes and
    bits_per_byte of the lower-cased words with one blank or end after each. Learns from
    the rows outside the held-out fold (crc32 of the id as text modulo `mod` is `held`).
    Null and empty texts are the end alone; with nothing to learn from all decisions are
    even; repeated rows give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    training = slim.filter(fold(F.col("doc_id"), mod) != held)
    counts = written(word_counts(training), "word-counts")
    n_all, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # steps of counts, 64 to a doubling, from the top as long as there are at most `head` words; words met once stay out
    step = F.floor(F.log2("n") * 64).cast("int")
    tally = counts.filter("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("kinds")).collect()  # a few thousand rows whatever the corpus
    least, room = 1 << 20, head
    for r in sorted(tally, key=lambda r: -r["step"]):
        if r["kinds"] > room:
            break
        least, room = r["step"], room - r["kinds"]
    inside = (F.col("n") > 1) & (step >= least)
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(inside).collect()), key=lambda x: (-x[1], x[0]))
    ends = counts.filter(F.col("word") == F.lit(END_WORD)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = [(END_WORD, ends), *(x for x in top if x[0] != END_WORD)]
    rare = counts.filter(~inside & (F.col("word") != F.lit(END_WORD)))
    seen, kinds = rare.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    coder = spark.sparkContext.broadcast(Coder([w for w, _ in top], np.array([n for _, n in top], np.int64), int(seen) + int(kinds) + 1, bits))
    tables, weights = learn(training, coder)  # the same, however rows are dealt to tasks
    model = spark.sparkContext.broadcast((tables, weights))
    norm = float(np.log10(n_all + n_kinds + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (tabs, ws) = coder.value, model.value
        logs = np.append(np.log10(code.counts + 1.0), 0.0)  # the last is for words outside the head
        for b in batches:
            at = 0
            for piece in _pieces(b.column(1), LOOKED_UP):
                ids, start, words, first = code.text_places(piece)
                total = []
                for x, y in _ranges(np.diff(start), BATCH // 12):
                    bit, path, slots, per_word = code.walk(ids[start[x] : start[y]])
                    upto = np.concatenate(([0], np.cumsum(per_word)))[start[x:y] - start[x]]
                    total.append(np.add.reduceat(_bits(bit, path, slots, code, tabs, ws, upto).astype(np.float64), upto))
                # after the escapes: the room of all words without a symbol, less the counts of those that the head has
                gain, far = logs[ids], ids >= code.esc
                n_far, far_gain, base = (np.add.reduceat(v, start[:-1]) for v in ((far | (ids < 0)).astype(np.int64), np.where(far, gain, 0.0), gain))
                total = np.concatenate(total) + n_far * np.log2(code.room) - far_gain * np.log2(10.0)
                known = np.add.reduceat(((ids >= 0) & (code.counts[ids] > 0)).astype(np.int64), start[:-1])
                n_bytes = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy())))
                out = [b.column(0).slice(at, len(piece)), np.diff(start), known, base, total, np.diff(n_bytes[first]) + np.diff(start), _odd(ids, start, words)]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], ["doc_id", "n_tokens", "n_known", "base", "bits", "n_bytes", "rare"])
                at += len(piece)

    raw = slim.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, bits double, n_bytes long, rare map<binary,bigint>")
    scored = written(raw.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words outside the head meet their counts by an equality join; none of them is frequent
    odd = scored.select("row", F.explode("rare").alias("word", "times"))
    extra = (
        odd.join(rare, "word").groupBy("row")
        .agg(F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    )
    out = scored.drop("rare").join(extra, "row", "left")
    known, gain = F.col("n_known") + F.coalesce("met", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    total = F.col("bits") - gain * float(np.log2(10.0))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * norm).alias("base_score"), (-total * float(np.log10(2.0))).alias("score"),
        total.alias("bits"), "n_bytes", (total / F.col("n_bytes")).alias("bits_per_byte"),
    )
