"""The corpus pipeline: each stage and the whole against plain rules on a small table."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(12)
    en = "the house river people walk every day with dogs which they have seen thing was that there under over between long short".split()
    fr = "la maison est dans rue et les gens marchent avec leurs chiens tous jours ce que nous avons vu une chose".split()
    rows = []
    for i in range(60):
        words = en if i % 2 else fr
        rows.append((i, " ".join(rng.choice(words, 60)) + f"\nline number {i} of its own kind", "en" if i % 2 else "fr", "abc"[i % 3] if i % 7 else None))
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], rows[i][3]) for i in range(10)]
    rows += [(200, rows[3][1], "en", "a"), (200, rows[3][1], "en", "a"), (201, None, "en", "a"), (202, "12 34 !", None, "b"), (203, "", None, None), (None, "people without an id walk there every day", None, "c"), (3, "another text of a used id that has words of its own", "en", "a")]
    rows += [(300 + i, f"a line that several documents hold\nbut text {i} is its own " + " ".join(rng.choice(en, 20)), "en", "b") for i in range(4)]
    return [(*r, len(r[1] or ""), 7) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, texts, tmp_path_factory):
    """What each stage returns, in order."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(texts, DOCS)
    docs.write.parquet(str(folder / "documents.parquet"))
    out, docs = {"in": docs.collect()}, spark.read.parquet(str(folder / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out[name] = docs.collect()
        if name != "pack":
            assert docs.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    out["run"] = corpus_pipeline.run(spark, str(folder)).collect()
    return out


def test_language_keeps_what_has_letters(stages):
    kept = Counter((r["doc_id"], r["text"]) for r in stages["language"])
    assert kept == Counter((r["doc_id"], r["text"]) for r in stages["in"] if r["text"] and any(c.isalpha() for c in r["text"]))


def test_lines_drop_repeats_of_smaller_ids(stages):
    def keys(r):
        return {x.strip(" \t\n\x0b\x0c\r").lower() for x in r["text"].split("\n")}

    holders = {}
    for r in stages["language"]:
        for k in keys(r) if r["doc_id"] is not None else ():
            if len(k) >= 10:
                holders[k] = min(holders.get(k, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in stages["language"]:
        lines = [x for x in r["text"].split("\n") if r["doc_id"] is None or holders.get(x.strip(" \t\n\x0b\x0c\r").lower(), r["doc_id"]) == r["doc_id"]]
        want[(r["doc_id"], "\n".join(lines), len("\n".join(lines)))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in stages["lines"]) == want


def test_near_keeps_one_of_each_group(stages):
    def shingles(t):
        ws = t.lower().split()
        return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()

    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in stages["lines"]})
    sets, root = [shingles(r[2]) for r in rows], list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in stages["near"]} >= {rows[i][:2] for i in set(root)} and len(stages["near"]) == len(set(root))


def test_mix_takes_rows_up_to_three_times(stages):
    had = Counter((r["doc_id"], r["text"]) for r in stages["near"])
    taken = Counter((r["doc_id"], r["text"]) for r in stages["mix"])
    assert set(taken) <= set(had) and max(taken.values()) <= 3 and len(taken) > 10


def test_pack_holds_every_token(stages):
    pytest.importorskip("public_tokenizers")
    rows = stages["pack"]
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in stages["mix"])
    key = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, stages["run"])) == sorted(map(key, rows))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
