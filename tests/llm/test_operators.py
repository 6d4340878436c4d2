"""The corpus operators against brute force on small, awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from saccadia.llm import embed_dedup, language, licenses, linededup, lm, mixing, packing, quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(4000))
PROSE = "the quick brown fox jumps over the lazy dog while all rights reserved signs are read by many people in town"


def table(spark, texts):
    """Texts with nulls, blanks, repeats, a long one, a null source and an extra clashing column."""
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "b", "a")[i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"size": F.lit("x"), "key": F.lit(1), "score": F.lit("y"), "kept": F.lit(2), "fp": F.lit(3)})


ODD = [PROSE, PROSE, None, "", " \n\t ", PROSE + " more", LONG, "one", "Shared line of text\nown a", "shared LINE of text \nown b", LONG + " end", "é Ünïcode\x0bwörd", PROSE.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ODD)


def brute_fp(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fps = [brute_fp(t) for t in ODD]
    root = list(range(len(ODD)))
    for _ in ODD:
        root = [min(root[j] for j in range(len(ODD)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(ODD))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(ODD))}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_simhash_links_in_dense_buckets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 6)
    fps = {int(b) for b in base}
    for b in base:
        fps |= {int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 4), False)) for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(edges):
        root = {f: f for f in fps}
        for _ in range(len(fps)):
            new = dict(root)
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                return root
            root = new

    brute = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    monkeypatch.setattr(simhash, "DENSE", 5)
    found = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    assert groups(found) == groups(brute)
    assert all((a ^ b).bit_count() <= 4 for a, b in found)


@pytest.mark.parametrize("dense", [48, 5])
def test_simhash_broadcasts_no_exploded_table(spark, monkeypatch, dense):
    """Tables far below the size that Spark broadcasts: what is made 64 or 5 times as long of them is merged all the same."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    fps = spark.createDataFrame([(1 << k,) for k in range(40)] + [(k * 0x9E3779B97F4A7C1,) for k in range(2, 8)], "fp long")
    links = simhash.links(fps)
    assert links.count() >= 39
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[(?:key|fine)#", plan) and not re.findall(r"Broadcast\w*Join \[(?:key|fine)#", plan)


def test_packing(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    for i, t in enumerate(ODD):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in mine)
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048 and sum(v < 2048 for v in at.values()) <= 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_plan_uses_each_length_once():
    hist = np.random.default_rng(2).integers(0, 50, 64)
    made, rest = packing.plan(hist, 64)
    used = rest.copy()
    for lengths, n in made:
        assert sum(lengths) == 64 and n > 0
        for v in lengths:
            used[v] += n
    assert (used[1:] == hist[1:]).all()


def test_mixing(spark, docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ODD)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(ODD)}
    by = Counter()
    for i, n in size.items():
        by[(None, "b", "a")[i % 3]] += n
    order, left, cap = ["a", "b", None], sum(by.values()), {}
    weight = dict(zip(order, (1, 2, 3), strict=True))
    while True:
        free = [s for s in order if s not in cap]
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * by[s]]
        if not over:
            break
        for s in over:
            cap[s] = 3 * by[s]
            left -= cap[s]
    want = cap | {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    for r in rows:
        s = (None, "b", "a")[r["doc_id"] % 3]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.mixed(docs.repartition(3)).collect()}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(5)
    df = table(spark, [" ".join(["w"] * int(n)) for n in rng.lognormal(4, 1, 600)])
    for r in mixing.mixed(df).groupBy("target").sum("taken").collect():
        assert r[1] == pytest.approx(r[0], rel=0.02)


def test_lm(spark, docs):
    got = {r["doc_id"]: r for r in lm.score_texts(docs, head=8).collect()}
    train = [t for i, t in enumerate(ODD) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in lm.text_words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in enumerate(ODD):
        ws, r = lm.text_words(t), got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(w in c for w in ws) + 1, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_language(spark):
    en = ["the house is near the river and the people walk there every day with their dogs"] * 3 + ["that which they have seen was the thing"] * 3
    fr = ["la maison est dans la rue et les gens marchent avec leurs chiens tous les jours"] * 3 + ["ce que nous avons vu est une chose"] * 3
    rows = [(i, t, "en" if i < 6 else "fr", "s", 0) for i, t in enumerate(en + fr)] + [(20, None, None, "s", 0), (21, "12 34", "en", "s", 0), (22, "the people walk near the house", None, "s", 0)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i < 6 else "fr") for i in range(12))
    assert got[20]["lang_pred"] == got[21]["lang_pred"] == "und" and got[22]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_cross_parsing_against_brute_force():
    sample, text = "abracadabra banana", "banabraxdab cad"
    p = language.Parser({"x": sample})
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        phrases += 1
    assert p.phrases([text])[0][0, 0] == phrases


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, x[:20] + rng.normal(scale=0.05, size=(20, 8)), x[:5], 2 * x[5:8]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [None] * 8, 0)]
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= near.sum() and found >= 0.9 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903))


def brute_lines(texts):
    holders = {}
    for i, t in enumerate(texts):
        for k in {linededup.line_key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(k := linededup.line_key(x)) < 10 or len(holders[k]) < 2 or min(holders[k]) == i]
        out[i] = (len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_lines(spark, docs):
    hot = [*ODD, *["a line that very many hold\nown " + str(i) for i in range(300)]]
    for texts in (ODD, hot):
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.line_bitmaps(table(spark, texts)).collect()}
        assert got == brute_lines(texts)
    assert linededup.line_bitmaps(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["tree", "sun", "sea", "road", "hill"], 12)) + (" awful scum" if i % 5 == 0 else "") for i in range(600)]
    df = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.score_toxicity(df, labels).collect() if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert {r["score"] for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.5}


def test_licenses(spark, docs):
    texts = [*ODD, "CC BY-NC 4.0 and cc by", "Licensed under the Apache License, Version 2.0.", "general public license"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert "apache-2.0" in got[len(ODD) + 1]["labels"]


def test_quality(spark):
    texts = [*ODD, "a a a a b c", "x\nx\n \n\nx # $"]
    got = {r["doc_id"]: r for r in quality.apply_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        rep = {k + j for k in range(len(ws) - 2) if win[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(rep), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(rep) > 50 * len(ws)) and (not r["base_failed"] or not r["kept"])


def far_pairs(rng, n_alone, n_pairs, n_tight=0):
    """Random directions, pairs at cosine 0.92 or so, and a tight group."""
    x = rng.normal(size=(n_alone + n_pairs, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    twin = x[:n_pairs] + rng.normal(scale=0.43 / 4, size=(n_pairs, 16))
    tight = x[-1] + rng.normal(scale=1e-4, size=(n_tight, 16))
    return np.concatenate([x, twin, tight])


@pytest.mark.parametrize(("n_pairs", "n_tight"), [(6, 0), (100, 300)])
def test_embeddings_recall_of_rare_pairs_and_beside_a_tight_group(spark, n_pairs, n_tight):
    x = far_pairs(np.random.default_rng(11), 1500, n_pairs, n_tight)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = [i for i in range(n_pairs) if u[i] @ u[1500 + n_pairs + i] >= 0.9]
    assert len(linked) > n_pairs / 2 and np.mean([got[i] > 0 for i in linked]) >= 0.95


def test_languages_of_other_scripts_beside_latin_ones():
    rng = np.random.default_rng(6)
    latin = {k: " ".join("".join(rng.choice(list(abc), 5)) for _ in range(3000)) for k, abc in (("de", "abcdefghijklmnopqrstuvwxyzäöüß"), ("es", "abcdefghijklmnopqrstuvwxyzñáéíóú'-.,;:!?0123456789"))}
    phrases = {k: ["".join(chr(c) for c in rng.integers(lo, hi, 6)) for _ in range(300)] for k, lo, hi in (("ja", 0x4E00, 0x5200), ("zh", 0x4E00, 0x5200), ("ru", 0x430, 0x450))}
    sample = latin | {k: " ".join(v) for k, v in phrases.items()}
    p = language.Parser(sample)
    texts = [" ".join(phrases[k][5:9]) for k in ("ja", "zh", "ru")]
    got, letters = p.phrases(texts)
    assert letters.all() and [p.langs[i] for i in got.argmin(1)] == ["ja", "zh", "ru"]
    assert (np.sort(got, 1)[:, 0] < np.sort(got, 1)[:, 1]).all()
    plain, text = language.plain(sample["zh"]), texts[1] + texts[1][::-1]
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in plain:
            size += 1
        at, n = at + size, n + 1
    assert p.phrases([text])[0][0, p.langs.index("zh")] == n


def parse_by_hand(sample, text):
    at = n = 0
    while at < len(text):
        size = 1
        while text[at] in sample and at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("segment", [5, 64, 2048])
def test_phrases_cross_the_borders_of_segments(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = np.random.default_rng(8)
    for abc in ("ab c", "".join(chr(0x4E00 + i) for i in range(90)), "αβγ де"):
        sample = "".join(rng.choice(list(abc), 300))
        texts = ["".join(rng.choice(list(abc + "xÉ中9\n\U00030005"), n)) for n in (0, 1, 700)] + [sample * 3, "".join(rng.choice(list(abc), 10_000))]
        got = language.Parser({"one": sample, "two": sample[::-1]}).phrases(texts)[0]
        assert got.tolist() == [[parse_by_hand(language.plain(s), language.plain(t)) for s in (sample, sample[::-1])] for t in texts]


def test_letters_of_late_planes_count():
    assert language.Parser({"en": "ab"}).phrases(["\U00030005", "12 !", ""])[1].tolist() == [True, False, False]


def test_known_language_goes_by_row(spark):
    prose = "the house is near the river and people walk there"
    rows = [(1, prose, "en"), (1, "12 34", "en"), (None, "12 34", None), (None, prose, None), (2, None, None), (2, "", "en"), (3, prose, None), (3, prose, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, lang_pred int")
    kept = sorted((r["doc_id"] or -1, r["text"], r["lang_pred"]) for r in language.known_language(df).collect())
    assert kept == [(-1, prose, 7), (1, prose, 7), (3, prose, 7), (3, prose, 7)]
    assert language.known_language(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


@pytest.mark.parametrize("thin", [2, 8])
def test_near_unique_keeps_one_row_of_each_group(spark, monkeypatch, thin):
    monkeypatch.setattr(simhash, "THIN", thin)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(2000)]

    def changed(ws, share):
        return [rng.choice(vocabulary) if rng.random() < share else w for w in ws]

    texts = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, rng.integers(30, 300)))
        texts += [base, *(changed(base, 0.01) for _ in range(2))]
    base = list(rng.choice(vocabulary, 150))
    texts += [changed(base, 0.01) for _ in range(60)] + [list(rng.choice(vocabulary, n)) for n in range(1, 60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A b"), (0, "the id of another row with words of its own"), (None, rows[0][1]), (None, "no id"), (505, "twice the same"), (505, "twice the same")]
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), set()).add(rows[i])
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, th string, node int")
    got = [(r["doc_id"], r["text"]) for r in simhash.near_unique(df).collect()]
    assert len(got) == len(groups)
    for members in groups.values():
        ids = [k for k, _ in members if k is not None]
        mine = [x for x in got if x in members]
        assert len(mine) == 1 and (not ids or mine[0][0] == min(ids))
    assert simhash.near_unique(df.limit(0)).count() == 0


def test_embeddings_of_several_widths_and_repeated_ids(spark):
    a, b, wide = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows = [(1, a), (1, b), (2, a), (3, [1.0, 0.1, 0.0, 0.0]), (4, [0.1, 1.0, 0.0, 0.0]), (5, wide), (6, [2 * x for x in wide[:-1]] + [12.5]), (7, None), (7, [0.0] * 4), (7, [9.0]), (None, a)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, node int, cell string")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df).collect()), key=str)
    # the vectors of id 1 lie in two groups, and both groups' smallest id is 1
    want = [(0, 0, None), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7), (7, 0, 7), (7, 0, 7)]
    assert got == sorted(want, key=str)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_ftrl_steps_against_plain_ones():
    rng = np.random.default_rng(10)
    rows = [(np.sort(rng.choice(64, rng.integers(0, 20), False)), int(rng.integers(0, 2))) for _ in range(80)]
    held = Counter(int(i) for x, _ in rows for i in x)
    good = [([int(i) for i in x if held[int(i)] >= toxicity.LEAST] + [64], y) for x, y in rows]
    z, n = [0.0] * 65, [0.0] * 65
    ones = sum(y for _, y in rows)
    weigh = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(20):
        for k in order.permutation(len(rows)):
            x, y = good[k]
            w = [weight(i) for i in x]
            g = (1 / (1 + math.exp(-sum(w))) - y) * weigh[y]
            for i, v in zip(x, w, strict=True):
                z[i], n[i] = z[i] + g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * v, n[i] + g * g
    assert toxicity.learn(rows, 6, 20) == pytest.approx([weight(i) for i in range(65)])


def test_repeated_rows_share_the_copies_of_the_mix(spark):
    rows = [(i % 40, "w " * (20 + i % 7), "ab"[i % 3 == 0], 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    want = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix_sources(df).select("source", "target", "source_size").distinct().collect()}
    have = Counter(r[2] for r in rows)
    assert all(taken[s] == pytest.approx(want[s] * have[s], rel=0.2) for s in want)
    assert mixing.repeat_documents(df.limit(0)).count() == 0
