"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled text
(about `chars` code points in all, shared evenly, whole texts as far as they fit). A text
is parsed greedily into the longest stretches that the language's sample holds; a letter
that the sample lacks is a phrase of its own. Fewer phrases for its length mean less cross
entropy, and the language that needs fewest wins.

What is broadcast is the sample text; each task builds the automata from it and lets them go.
Whole texts are parsed. Segments of `SEGMENT` code points run side by side in numpy, each
as if a phrase began with it; then each takes up the state that the segment before it
ended in, until both parses agree, so phrases cross the borders as in one long parse.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm.common import fold

#: ALPHABET: columns of a dense table; rarer characters have a list of their own. ROWS: labelled texts of a language at most.
CHARS, ROWS, SEGMENT, ALPHABET, UNKNOWN = 160_000, 400, 2048, 62, "und"
#: Code points parsed side by side.
BATCH = 1_000_000


def suffix_automaton(codes: list[int], dense: int) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Transitions of the automaton of all substrings of a sequence; state 0 is the root.

    A table (state x code, -1 for none) for codes below `dense`, dicts by state for the others.
    """
    go, far = np.full((2 * len(codes) + 1, dense), -1, np.int32), {}
    link, size, last, n = [-1], [0], 0, 1

    def step(p, c):
        return go.item(p, c) if c < dense else far.get(p, {}).get(c, -1)

    def put(p, c, t):
        if c < dense:
            go[p, c] = t
        else:
            far.setdefault(p, {})[c] = t

    for c in codes:
        cur, n = n, n + 1
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and step(p, c) < 0:
            put(p, c, cur)
            p = link[p]
        if p >= 0:
            q = step(p, c)
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin, n = n, n + 1
                go[twin] = go[q]
                if q in far:
                    far[twin] = dict(far[q])
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step(p, c) == q:
                    put(p, c, twin)
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go[:n], far


def plain(text: str) -> str:
    """What is learned and parsed: letters and marks in lower case, and one blank for whatever lies between words."""
    kept = "".join(c if _spells(c) else " " for c in text.lower())
    return re.sub(" +", " ", kept)


def _spells(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")


class Model:
    """One language's automaton: a dense table over the commonest letters, sorted keys for others.

    A table entry is next state * ALPHABET * 2 + whether a phrase began with the letter.
    """

    def __init__(self, text: str, letters: list[str]):
        top = [c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))]
        few = ALPHABET - 2
        codes = {c: n if n < few else n - few + ALPHABET for n, c in enumerate(top)}
        here, odd = suffix_automaton([codes[c] for c in text], ALPHABET)
        self.rare = max(1, len(top) - few)
        root = np.maximum(here[0], 0) * (2 * ALPHABET) + 1
        here = here * (2 * ALPHABET)
        np.copyto(here, root, where=here < 0)
        here[0] = root
        self.step = here.ravel()
        far = np.array(sorted((s * self.rare + c - ALPHABET, t) for s, out in odd.items() if s for c, t in out.items()), np.int64).reshape(-1, 2)
        self.keys, self.targets = far[:, 0].copy(), far[:, 1].copy()
        self.from_root = np.array([odd.get(0, {}).get(ALPHABET + n, 0) for n in range(self.rare)], np.int64)
        self.of = np.array([codes.get(c, few) for c in letters] + [few, few], np.int32)

    def move(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries after one letter (as an index of all letters) in each state."""
        c = self.of.take(ids)
        odd = np.flatnonzero(c >= ALPHABET)
        if not len(odd):
            return self.step.take(state + c)
        n = c[odd] - ALPHABET
        c[odd] = ALPHABET - 2
        got = self.step.take(state + c)
        got[odd] = self.from_root[n] * (2 * ALPHABET) + 1
        if len(self.keys):
            key = state[odd].astype(np.int64) // ALPHABET * self.rare + n
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[at] == key
            got[odd[goes]] = self.targets[at[goes]] * (2 * ALPHABET)
        return got


class Parser:
    """Automata of some languages, and the parse of many texts at once."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        texts = {k: plain(v) for k, v in samples.items()}
        self.letters = sorted(set("".join(texts.values())))
        self.models = [Model(texts[k], self.letters) for k in self.langs]
        index = {c: n for n, c in enumerate(self.letters)}
        self.blank = index.get(" ", len(self.letters))
        # code of a code point; what doesn't spell is a blank, and unknown letters come after all known ones
        self.points, self.alpha = np.full(0x110000, self.blank, np.int32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            x = chr(c)
            self.alpha[c] = x.isalpha()
            if self.alpha[c] or unicodedata.category(x) in ("Mn", "Mc"):
                self.points[c] = index.get(x, len(self.letters) + 1)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts, and whether each text has a letter."""
        raw, letters = [], np.zeros(len(texts), bool)
        for n, t in enumerate(texts):
            r = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letters[n] = self.alpha[r].any()
            r = self.points[r]
            blank = r == self.blank
            raw.append(r[~(blank & np.concatenate(([False], blank[:-1])))] if len(r) else r)
        spans = [(n, at) for n, r in enumerate(raw) for at in range(0, len(r), SEGMENT)]
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not spans or not self.langs:
            return total, letters
        size = [min(SEGMENT, len(raw[n]) - at) for n, at in spans]
        order = sorted(range(len(spans)), key=lambda k: -size[k])
        place = {spans[k]: col for col, k in enumerate(order)}
        lens = np.array([size[k] for k in order])
        before = np.array([place.get((spans[k][0], spans[k][1] - SEGMENT), -1) for k in order])
        ids = np.zeros((lens[0], len(order)), np.int32)
        for col, k in enumerate(order):
            n, at = spans[k]
            ids[: lens[col], col] = raw[n][at : at + SEGMENT]
        owners = np.array([spans[k][0] for k in order])
        for k, model in enumerate(self.models):
            np.add.at(total[:, k], owners, _parse(model, ids, lens, before))
        return total, letters


def _parse(model: Model, ids: np.ndarray, lens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases begun in each column of letters (longest first); column k goes on from column before[k], if any."""
    state, count = np.zeros(len(lens), np.int32), np.zeros(len(lens), np.int32)
    later = np.flatnonzero(before >= 0)
    run = np.zeros((len(ids), len(later)), np.int32)
    live = np.searchsorted(-lens, -np.arange(len(ids)), "left")  # columns longer than t
    for t, m in enumerate(live):
        got = model.move(state[:m], ids[t, :m])
        count[:m] += got & 1
        state[:m] = got >> 1
        if len(later):
            k = np.searchsorted(later, m)
            run[t, :k] = got[later[:k]]
    todo = np.arange(len(later))
    while len(todo):
        cols, new, changed, t = later[todo], state[before[later[todo]]], [], 0
        on = np.arange(len(todo))
        while len(on):
            c = cols[on]
            got, old = model.move(new[on], ids[t, c]), run[t, todo[on]]
            count[c] += (got & 1) - (old & 1)
            run[t, todo[on]] = got
            new[on] = got >> 1
            apart, t = (got >> 1) != (old >> 1), t + 1
            over = on[apart & (lens[c] == t)]
            state[cols[over]] = new[over]
            changed += cols[over].tolist()
            on = on[apart & (lens[c] > t)]
        todo = np.flatnonzero(np.isin(before[later], changed))
    return count


def samples(docs: DataFrame, chars: int = CHARS) -> dict[str, str]:
    """Sample text of each language: whole texts in the order of their hashes until its share of `chars` is full.

    `ROWS` texts of a language at most. Many texts tell a language better than a few long ones: those up
    to a fortieth of the share come first, then those up to an eighth, then all others, of which only one
    that is longer than the share is cut to it.
    """
    labelled = docs.filter("lang is not null and text is not null and length(text) > 0").select("lang", F.col("text").cast("string").alias("text"))
    kinds = labelled.select("lang").distinct().count()
    each = max(2_000, chars // max(kinds, 1))
    tier = F.when(F.length("text") <= each // 40, 0).when(F.length("text") <= each // 8, 1).otherwise(2)
    w = Window.partitionBy("lang").orderBy("tier", "h", "text")
    some = labelled.withColumns({"h": F.xxhash64("text"), "tier": tier}).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ROWS)
    upto = F.coalesce(F.sum(F.least(F.length("text"), F.lit(each))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.substring("text", 1, each)
    out: dict[str, list[str]] = {}
    for r in some.withColumn("upto", upto).filter(F.col("upto") < each).select("lang", "rank", cut.alias("text")).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def _shared_samples(docs: DataFrame, mod: int, held: int, chars: int):
    return docs.sparkSession.sparkContext.broadcast(samples(docs.filter(fold(F.col("doc_id"), mod) != held), chars))


def predict(p: Parser, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language of each text, and the winner's share."""
    pred, score = [], []
    names = np.array([*p.langs, UNKNOWN], object)
    for part in _groups(texts):
        counts, letters = p.phrases(part)
        if not p.langs:
            pred += [UNKNOWN] * len(part)
            score += [0.0] * len(part)
            continue
        weight = np.exp2(-np.minimum(counts - counts.min(1, keepdims=True), 60).astype(float))
        pred += names[np.where(letters, counts.argmin(1), len(p.langs))].tolist()
        score += np.where(letters, 1 / weight.sum(1), 0.0).tolist()
    return pred, score


def identify(docs: DataFrame, mod: int = 4, held: int = 2, chars: int = CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents.

    Learns from text and lang of rows outside the held-out fold (crc32 of the id as text
    modulo `mod` is `held`). lang_pred is a learned language, or `und` with score 0 where
    the text is null or has no letter, or nothing could be learned. score is the share of
    the winner when each phrase that another language needs more halves its weight; ties go
    to the first language in code-point order. Repeated rows give repeated rows; other
    columns are not read.
    """
    share = _shared_samples(docs, mod, held, chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parser(share.value)
        for b in _cut(batches):
            pred, score = predict(p, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), "lang_pred", "score")


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n > BATCH:
            yield part
            part, n = [], 0
    if part:
        yield part


def known_language(docs: DataFrame, mod: int = 4, held: int = 2, chars: int = CHARS) -> DataFrame:
    """The rows of documents whose language could be told, all columns as they are.

    Row by row: a null text or one without a letter goes, whatever its doc_id and its
    repeats; with nothing to learn from every row goes; no rows give no rows.
    """
    share, at = _shared_samples(docs, mod, held, chars), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parser(share.value)
        for b in _cut(batches):
            pred, _ = predict(p, [t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([x != UNKNOWN for x in pred], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
