"""Near-duplicate documents by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at
most 4 bits differ in at most 1 bit of some segment (three segments with two each
would make 6). Every segment is indexed once for each of its bits left out, so such
a pair meets in at least one equality bucket; the pairs met are then verified.

Cost: 64 narrow rows for each *distinct* fingerprint, one shuffle for the equality
join. Exact copies of a fingerprint are one row before anything is paired. A bucket
of more than `DENSE` fingerprints is not paired at once: its members are first linked
to its smallest one where they are close, the components of those links are found, and
only members of different components, met again on a finer key, are compared.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm.common import components, fresh, let, released, written

SEGMENTS = ((0, 21), (21, 21), (42, 22))
DENSE = 48
#: The pipeline's stage: 64-bit words of a fingerprint, its widest difference (three sds over what a similarity of 0.8
#: has), that of the 32 bits in a node, runs paired in full.
WORDS, FAR, NODE_FAR, THIN = 16, 190, 13, 8
#: Bits of a segment left out together, fewest segments, and the chance (by the model) with which a pair of similarity 0.8 meets.
WILD, PARTS, MEET = 4, 14, 0.975


LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; fewer words: of the whole sequence."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > width:
        starts, ends = starts[: len(parts) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> np.ndarray:
    """For rows of hashes (words x n), one word a row: the bits set in over half of its hashes."""
    ones = np.zeros((len(h), 8, 8), np.int64)
    for at in range(0, h.shape[1], 255):  # eight byte-wide counters in a word hold 255
        part = h[:, at : at + 255]
        for k in range(8):
            ones[:, :, k] += ((part >> np.uint64(k)) & LANES).sum(1).view(np.uint8).reshape(-1, 8)
    return np.packbits((2 * ones > h.shape[1]).reshape(len(h), 64), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text's word shingles, unsigned; 0 for null or a text without words."""
    return int(majority(shingle_hashes(text, width)[None, :])[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp signed long) for each row of documents; null texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint, one for each bit left out of its segment."""
    made = []
    for n, (shift, bits) in enumerate(SEGMENTS):
        mask = (1 << bits) - 1
        seg = F.shiftrightunsigned("fp", shift).bitwiseAND(mask)
        for k in range(bits):
            tag = (n * 32 + k) << 32
            made.append(seg.bitwiseAND(mask & ~(1 << k)).bitwiseOR(F.lit(tag)))
    return fps.select(F.explode(F.array(*made)).alias("key"), "fp")


def _close(a, b, radius: int):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within `radius` (4 at most).

    fps: distinct `fp`. In buckets that aren't dense every close pair is a link; in
    dense ones links to the bucket's smallest member stand for those inside a component.
    Keys meet in sort-merge joins: Spark takes an exploded table for as small as what it
    came from, and would broadcast all variants of a few hundred thousand fingerprints.
    """
    if radius > 4:
        raise ValueError("three segments with one free bit reach 4 differing bits")
    # few narrow rows become 64 times as many: spread them first, by no key, as parts by the key that fps is grouped by are merged again
    v = _variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dense = written(
        v.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).filter(F.col("n") > DENSE).select("key", "pivot"),
        "dense",
    )
    thin = v.join(dense.select("key").hint("merge"), "key", "left_anti")
    x, y = thin.alias("x"), thin.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y.hint("merge"), met & _close(F.col("x.fp"), F.col("y.fp"), radius)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    if dense.isEmpty():
        return pairs
    inside = written(v.join(dense.hint("merge"), "key"), "dense-members")
    stars = written(
        inside.filter((F.col("fp") != F.col("pivot")) & _close(F.col("fp"), F.col("pivot"), radius)).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(),
        "stars",
    )
    roots = components(stars)
    known = inside.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    # 4 differing bits leave one of five parts of the whole fingerprint equal
    finer = known.select(
        F.explode(F.array(*[F.xxhash64("key", F.lit(k), F.shiftrightunsigned("fp", 13 * k).bitwiseAND((1 << 13) - 1)) for k in range(5)])).alias("fine"), "fp", "root"
    )
    mixed = finer.groupBy("fine").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("fine")
    left = finer.join(mixed.hint("merge"), "fine", "left_semi")
    x, y = left.alias("x"), left.alias("y")
    met = (F.col("x.fine") == F.col("y.fine")) & (F.col("x.root") < F.col("y.root"))
    across = x.join(y.hint("merge"), met & _close(F.col("x.fp"), F.col("y.fp"), radius)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    return pairs.unionByName(stars).unionByName(across)


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of documents.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest
    doc_id reachable, itself included. Null and wordless texts have fingerprint 0 and
    link like any other; repeated rows give repeated rows; a null doc_id stays null and
    is never a component_id unless it is alone; no rows give no rows. Columns besides
    doc_id and text are not read.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps.select("fp"), radius))
    known = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = known.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- the pipeline's stage: five words, Jaccard similarity


def prints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, th, node, fp, sh) for each row of documents.

    th: hash of the text. sh: 32 bits of the hash of each distinct shingle. fp: WORDS words
    of a SimHash of these, where similar sets agree in most bits. node stands for the set:
    32 more such bits above 32 bits of the hash of the whole set.
    """
    salts = (np.arange(WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cut = b.slice(at, 512)
                node, fps, sets = [], [], []
                for t in cut.column(2).to_pylist():
                    h = np.unique(shingle_hashes(t, width))
                    z = h[None, :] + salts
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    m = majority(z ^ (z >> np.uint64(31)))
                    node.append((int(m[-1]) & 0xFFFFFFFF) << 32 | xxhash.xxh32_intdigest(h.tobytes()))
                    fps.append(m[:WORDS].view(np.int64))
                    sets.append(np.unique(h.astype(np.uint32)).view(np.int32))
                ends = lambda x: pa.array(np.concatenate(([0], np.cumsum([len(v) for v in x]))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends(x), pa.array(np.concatenate(x))) for x in (fps, sets)]
                yield pa.RecordBatch.from_arrays([*cut.columns[:2], pa.array(np.array(node, np.uint64).view(np.int64)), *lists], ["doc_id", "th", "node", "fp", "sh"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, th long, node long, fp array<long>, sh array<int>"
    )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, node): candidate pairs, and the members of long runs.

    A run of up to THIN nodes gives all its pairs, a longer one each node with the first.
    kind 0: nodes a, b; 1: key and node of a long run, or of a run at this partition's edge,
    which may go on elsewhere; 2: of those, the ones that stand for it there.
    """
    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_key = open_pivot = None
    first = True

    def rows(kind, k, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(k), pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])

    def flush(key, node, edges):
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(at, len(key)))
        pivot = node[at]
        long = size > THIN
        if open_key is not None and key[0] == open_key:
            long[0], pivot[0] = True, open_pivot
        each = np.repeat(np.arange(len(at)), size)
        thin = ~long[each]
        for d in range(1, THIN):
            i = np.flatnonzero((key[d:] == key[:-d]) & thin[d:])
            if len(i):
                yield close(key[i], node[i], node[i + d])
        i = np.flatnonzero(~thin & (node != pivot[each]))
        yield close(key[i], pivot[each][i], node[i])
        i = np.flatnonzero(~thin | np.isin(each, edges))
        yield rows(1, key[i], node[i], node[i])
        edge = [e for e in edges if not (e == 0 and open_key is not None and key[0] == open_key)]
        i = np.flatnonzero(np.isin(each, edge) & (thin | (node == pivot[each])))
        yield rows(2, key[i], node[i], node[i])

    def close(k, a, b):
        few = np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(32)) <= NODE_FAR
        return rows(0, k[few], np.minimum(a, b)[few], np.maximum(a, b)[few])

    for b in batches:
        key, node = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
        if len(key) < 200_000:
            continue
        # the last run waits for its rest, unless it is long already
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last <= THIN and last and not (open_key is not None and key[-1] == open_key):
            yield from flush(key[:last], node[:last], [0] if first else [])
            key, node, open_key = key[last:], node[last:], None
        else:
            yield from flush(key, node, [0] if first else [])
            pivot = open_pivot if open_key is not None and key[-1] == open_key else node[last]
            open_key, open_pivot = key[-1], pivot
            key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = False
    if len(key):
        n = int((key[1:] != key[:-1]).sum())
        yield from flush(key, node, [0, n] if first else [n])
    elif open_key is not None:
        one = np.array([open_pivot])
        yield rows(2, np.array([open_key]), one, one)


def _prints_close(a, b):
    """Whether two fingerprints differ in few enough bits for similar sets."""
    return functools.reduce(lambda s, v: s + v, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(WORDS)]) <= FAR


def _nodes_close(a, b):
    """The same, roughly, of the bits in two nodes."""
    return F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 32)) <= NODE_FAR


def segments(bits: int, similarity: float = 0.8) -> int:
    """Segments of `bits` bits so that a pair of this similarity meets with chance MEET at least.

    A bit differs with chance acos(2J / (1 + J)) / pi, and a pair meets where all bits of a
    segment that differ are in one group of WILD. So longer segments, as larger tables have
    them, come in larger numbers.
    """
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    groups = [min(WILD, bits - g) for g in range(0, bits, WILD)]
    one = same**bits + sum(same ** (bits - g) - same**bits for g in groups)
    n = math.ceil(math.log(1 - MEET) / math.log(1 - one))
    # segments beyond the half words share bits with others and so count for less
    return max(PARTS, n + max(0, n - 2 * WORDS) * 2 // 5)


def _segment(fp, n: int, bits: int):
    """The n-th segment: of a half word, or beyond these the even bits of one and the odd bits of another."""
    half = lambda m: F.shiftrightunsigned(F.get(fp, F.lit(m // 2)), 32 * (m % 2))
    a, turn = n % (2 * WORDS), n // (2 * WORDS)
    if not turn:
        return half(a).bitwiseAND((1 << bits) - 1)
    b = (a + 2 * turn - 1) % (2 * WORDS)
    return half(a).bitwiseAND(0x55555555 & (1 << bits) - 1).bitwiseOR(half(b).bitwiseAND(0xAAAAAAAA & (1 << bits) - 1))


def _keys(fp, bits: int):
    """One key for each segment and each of its groups of WILD bits left out: (segment, group) above the other bits."""
    groups = F.array(*[F.struct(F.lit(~(((1 << WILD) - 1) << g)).alias("rest"), F.lit((g // WILD) << 33).alias("tag")) for g in range(0, bits, WILD)])

    def of(n):
        return let(_segment(fp, n, bits), lambda s: F.transform(groups, lambda g: s.bitwiseAND(g["rest"]).bitwiseOR(g["tag"] + F.lit(n << 38))))

    return F.flatten(F.array(*[of(n) for n in range(segments(bits))]))


def _first_met(key, a, b, bits: int):
    """Whether `key` is the first one that two fingerprints share, so that a pair is looked at once."""
    tag = F.shiftright(key, 33)
    n, k = F.shiftright(tag, 5), tag.bitwiseAND(31)

    def groups(m):
        """A bit for each group of four in which the segments differ."""
        x = _segment(a, m, bits).bitwiseXOR(_segment(b, m, bits))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(0x11111111)

    differ = [F.bit_count(groups(m)) for m in range(segments(bits))]
    none_before = functools.reduce(lambda s, v: s & v, [(F.lit(m) >= n) | (d > 1) for m, d in enumerate(differ)])
    equal = functools.reduce(lambda s, v: s | v, [(F.lit(m) == n) & (d == 0) for m, d in enumerate(differ)])
    return none_before & ((k == 0) | ~equal)


def _similar(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) with close fingerprints those whose shingle sets are similar."""
    need = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = sets.join(need, "node", "left_semi").select("node", "sh")
    both = F.size(F.array_intersect("sa", "sb"))
    pair = near.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    # two empty sets (texts without words) are one node, so no sum is 0
    return written(pair.filter(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "similar")


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root, doc_id, th): for each distinct shingle set its group and its first row.

    Sets are linked where their Jaccard similarity is at least `similarity`, verified on the
    sets. Candidates agree in one of the segments of a fingerprint but for one group of bits; segments
    grow with the number of sets, so buckets stay thin, and their number grows with their
    length, so that as many pairs meet. Rows that share all shingles are one set; null and
    wordless texts are the empty set; no rows give none. Members of long runs are
    linked to the run's first node, then to another chosen by chance, and those that are
    still outside the run's largest component are compared with all of the run.
    """
    spark = docs.sparkSession
    rows = written(prints(docs, width), "prints")
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.min("fp").alias("fp"))
    nodes = written(nodes, "nodes")
    bits = min(32, max(16, math.ceil(math.log2(max(nodes.count(), 1))) + 3 + WILD))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    v = nodes.select("node", "fp").repartition(tasks, "node").select(F.explode(_keys(F.col("fp"), bits)).alias("key"), "node")
    met = written(v.repartitionByRange(2 * tasks, "key", "node").sortWithinPartitions("key", "node").mapInArrow(_met, "kind int, key long, a long, b long"), "met")
    edge = met.filter("kind = 2").select("key", "a")
    over = edge.join(edge.withColumnRenamed("a", "b"), "key").filter("a < b").select("a", "b")
    pairs = met.filter("kind = 0").select("a", "b").unionByName(over).distinct()
    fps = nodes.select("node", "fp")
    near = written(pairs.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b").filter(_prints_close(F.col("fa"), F.col("fb"))).select("a", "b"), "candidates")
    one_each = rows.groupBy("node").agg(F.min("sh").alias("sh"))
    links = _similar(near, one_each, similarity)
    runs = written(met.filter("kind = 1").select("key", F.col("a").alias("node")).join(fps, "node"), "long-runs")
    released(near)
    for turn in range(2):
        roots = components(links)
        known = runs.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"))
        split = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("node", "root", "fp"), F.xxhash64("node", F.lit(turn))).alias("pivot")).filter("lo <> hi")
        if turn < 1:
            x, y = [F.col(f"pivot.{c}") for c in ("node", "root", "fp")], [F.col(c) for c in ("node", "root", "fp")]
            more = known.join(split, "key").filter((x[1] != y[1]) & _nodes_close(x[0], y[0]) & _prints_close(x[2], y[2]))
        else:
            # those outside a run's largest component, against all of the run
            sizes = known.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").withColumnRenamed("key", "k")
            minor = known.join(sizes, (F.col("key") == F.col("k")) & (F.col("root") != F.col("main"))).select("key", "node", "root", "fp", "main")
            x, y = ([F.col(f"{t}.{c}") for c in ("node", "root", "fp")] for t in "lr")
            met_once = _nodes_close(x[0], y[0]) & _first_met(F.col("l.key"), x[2], y[2], bits) & _prints_close(x[2], y[2])
            more = minor.alias("l").join(known.alias("r"), (F.col("l.key") == F.col("r.key")) & ((y[1] == F.col("l.main")) | (x[1] < y[1])) & met_once)
        more = written(more.select(F.least(x[0], y[0]).alias("a"), F.greatest(x[0], y[0]).alias("b")).distinct(), "more")
        if more.isEmpty():
            released(more)
            break
        found = _similar(more, one_each, similarity)
        old, links = links, written(links.unionByName(found), "links")
        released(old, found, more)
        if turn == 1:
            roots = components(links)
    return nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def near_unique(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of documents from each group of near duplicates, all columns as they are.

    Groups are the components of links between texts whose sets of `width`-word shingles
    have a Jaccard similarity of `similarity` or more. The row of the smallest doc_id stays
    (null ids last; of rows that share it the one of the smaller text hash); rows that share
    its id and text are one document, of which the smallest by all columns in turn stays.
    Rows of one doc_id with other texts are documents of their own. Null and wordless texts are alike. No rows give none.
    """
    groups = near_groups(docs, width, similarity).groupBy("root").agg(F.min("first").alias("first"))
    th, kid, kth = fresh(docs, "th", "keep_id", "keep_th")
    keep = groups.select(F.col("first.doc_id").alias(kid), F.col("first.th").alias(kth))
    marked = docs.withColumn(th, F.xxhash64("text"))
    same = marked["doc_id"].cast("long").eqNullSafe(keep[kid]) & (marked[th] == keep[kth])
    whole = F.struct(*docs.columns)
    kept = marked.join(keep, same, "left_semi").groupBy(F.col("doc_id").alias(kid), F.col(th).alias(kth)).agg(F.min(whole).alias(th))
    return kept.select(f"{th}.*")
