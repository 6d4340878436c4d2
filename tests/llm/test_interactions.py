"""The audit of filters against running every order over the rows."""

import itertools
import re

from pyspark.sql import functions as F

from saccadia.llm import interactions

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, text, part in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(ws) < 200) + "B" * (100 * len(set(ws)) < 50 * len(ws)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails.append((part or "", i, f))
    out, share = {}, {}
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                share[part, x] = share.get((part, x), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    long, many = " ".join(f"w{i}" for i in range(250)), "a b " * 200
    texts = [long, long.upper(), many, many + "#", long + " 50%", None, "", "short", "Short Text", long, many, "SHORT", "é " * 300, "é#"]
    docs = [(i % 37, texts[i % len(texts)], ("a", "b", None, "", "c")[i % 5]) for i in range(90)]
    docs += [(50, long, "hot")] * 30 + [(i, "same", "hot") for i in range(60, 90)] + [(None, "same", "hot"), (None, None, None), (60, "same", "a"), (60, "same", "hot")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60)] + [(3, 0, 1), (4, None, None), (None, 1, 1), (999, 1, 1), (5, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("x"), "mask": F.lit(1), "good": F.lit(2), "part": F.lit(3)})
    got = interactions.audit_filters(df, spark.createDataFrame(labels, LABELS).withColumn("source", F.lit(1)))
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got.collect()} == brute(docs, labels)
    assert got.count() == 600 * len({d[2] or "" for d in docs})
    assert interactions.audit_filters(df.limit(0), spark.createDataFrame([], LABELS)).collect() == []
    assert interactions.audit_filters(df.limit(1), spark.createDataFrame([], LABELS)).count() == 600


def test_walk_swaps_neighbours_through_all_orders():
    walked = list(interactions.walk(5))
    assert sorted(map(tuple, (o for o, _ in walked))) == sorted(itertools.permutations(range(5)))
    for (a, _), (b, at) in itertools.pairwise(walked):
        assert [i for i in range(5) if a[i] != b[i]] == [at, at + 1]
