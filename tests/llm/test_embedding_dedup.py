import numpy as np
import pytest

from graphweft.llm import embedding_dedup as ed
from graphweft.llm.common import spanning_forest

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n long, rep long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None) for i, v in rows], SCHEMA)


def plain(rows, threshold=0.9):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(v)}
    ids = sorted(good)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold]
    root = {b: a for a, b in spanning_forest(pairs)}
    return {i: (sum(i in p for p in pairs), root.get(i, i), root.get(i, i) == i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("sizes", [{}, {"cell": 40, "block": 16, "sample": 200}, {"cell": 100, "block": 30, "max_pivots": 3}])
def test_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(scale=s, size=(60, 8)) for c, s in zip(centres, (0.02, 0.1, 0.2, 0.3, 0.6, 1), strict=True)])
    rows = [(int(i), [float(np.float32(a)) for a in v]) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, [2 * a for a in rows[0][1]])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(table(spark, rows), **sizes).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [5.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, -0.0]), (None, [1.0, 0.0])]
    got = ed.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == plain(rows)
    null = next(r for r in got if r.vec_id is None)
    assert (null.n_links, null.component_id, null.kept) == (0, None, False)
    assert ed.near_duplicates(table(spark, [])).count() == 0
    assert ed.near_duplicates(table(spark, [(1, None)])).first().kept
    twice = ed.near_duplicates(table(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_pivots_prune_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 64))
    x = np.concatenate([c + rng.normal(scale=0.05, size=(50, 64)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = ed.Cells(ed.choose_pivots(x, 8), 0.9)
    assert cells.visits(x).sum() == len(x)


def test_every_close_pair_meets_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    plain_cells = ed.Cells(ed.choose_pivots(x, 12), 0.9)
    home, angle = plain_cells.homes(x)
    radii = np.array([angle[home == c].max() if (home == c).any() else -10 for c in range(len(plain_cells.pivots))])
    near = ed.Cells(plain_cells.pivots, 0.9, radii).visits(x)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    meets = (near[a] & near[b] & ((np.arange(near.shape[1]) == home[a][:, None]) | (np.arange(near.shape[1]) == home[b][:, None]))).sum(axis=1)
    assert (meets == 1).all()
