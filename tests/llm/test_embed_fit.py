"""The fit of the multi-index stays bounded, and recall holds, where links are missing, rare or all in one group."""

import numpy as np
import pytest

from saccadia.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(1)


def close(g, base, cos):
    """Vectors at a cosine from the base vectors."""
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    y = g.normal(size=u.shape)
    y -= (y * u).sum(1, keepdims=True) * u
    return cos * u + np.sqrt(1 - cos**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.fixture
def few_probes(monkeypatch):
    monkeypatch.setattr(embed_dedup, "PROBES", 64)
    monkeypatch.setattr(embed_dedup, "TRIED", 128)
    kept = []
    whole = embed_dedup._linked

    def spy(*a):
        out = whole(*a)
        kept.append(out)
        return out

    monkeypatch.setattr(embed_dedup, "_linked", spy)
    return kept


def test_no_links(spark, few_probes):
    x = np.random.default_rng(1).normal(size=(300, 32))
    assert brute(x).sum() == 0
    rows = embed_dedup.near_vectors(frame(spark, x)).collect()
    assert len(rows) == 300 and all(r["n_links"] == 0 and r["kept"] for r in rows)
    assert len(few_probes[0][0]) == 0 and not few_probes[0][2]


def test_one_tight_group_and_rare_pairs(spark, few_probes):
    """A group of 500 brings no more than a few probes, and pairs beside it are found."""
    g = np.random.default_rng(3)
    x = g.normal(size=(800, 24))
    x[:500] = close(g, np.repeat(x[500:501], 500, 0), 0.99)
    x[510:570] = close(g, x[610:670], 0.94)
    want = brute(x)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(frame(spark, x)).collect()}
    assert len(few_probes[0][0]) <= embed_dedup.MEMBERS + 16
    assert sum(got[i] for i in range(501)) >= 0.9 * want[:501].sum()
    assert sum(got[i] for i in range(510, 670)) >= 0.9 * want[510:670].sum()


def test_parts_of_cells_and_visitors(spark, monkeypatch):
    """Cells and their visitors in many parts: each link is counted once at both ends, groups stay whole."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    monkeypatch.setattr(embed_dedup, "ASKERS", 11)
    g = np.random.default_rng(5)
    x = g.normal(size=(240, 12))
    x[:60] = close(g, np.repeat(x[60:61], 60, 0), 0.97)
    x[100:140] = close(g, x[140:180], 0.92)
    x[200:203] = x[203]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    root = np.arange(len(x))
    for _ in x:
        root = np.where(near, root[None, :], len(x)).min(1)
    rows = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame(spark, x), recall=1.0).collect()}
    want = brute(x)
    got = np.array([rows[i]["n_links"] for i in range(len(x))])
    assert (got <= want).all()
    assert got.sum() >= 0.98 * want.sum()
    assert (got[:61] == want[:61]).mean() >= 0.9
    assert [rows[i]["n_links"] for i in range(200, 204)] == want[200:204].tolist()
    assert sum(rows[i]["component_id"] == root[i] for i in range(len(x))) >= 0.98 * len(x)
