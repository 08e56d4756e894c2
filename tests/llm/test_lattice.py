import numpy as np
import pytest

from opinara.llm import lattice, queries

SCHEMA = "vec_id long, embedding array<float>, label int, point string, size string"


def brute_force(ids, vectors, least=0.9):
    """Links and components of all pairs; vectors that have no cosine stand alone."""
    n = len(ids)
    usable = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links, parent = [0] * n, list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for v, u in zip(vectors, usable)]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(vectors[i]) == len(vectors[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for k in range(n):
        groups.setdefault(root(k), []).append(ids[k])
    named = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(ids[k], links[k], named[root(k)], ids[k] == named[root(k)]) for k in range(n)]


def near(rng, centre, cosine, count):
    """Vectors at a cosine from a centre of length one."""
    side = rng.normal(size=(count, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * side


def unit(rng, width=64):
    v = rng.normal(size=width)
    return v / np.linalg.norm(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def result(frame):
    return ordered((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())


def test_nearest_points_are_lattice_points_and_nearest():
    x = np.random.default_rng(1).normal(size=(3000, 8)) * 2
    found = lattice.nearest_points(x)
    doubled = 2 * found
    assert (doubled == np.rint(doubled)).all() and len(set(map(tuple, doubled % 2))) == 2
    assert (np.ptp(doubled % 2, axis=1) == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    own = ((x - found) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    assert (((x[:, None, :] - found[:, None, :] - lattice.ROOTS[None]) ** 2).sum(axis=2) >= own[:, None] - 1e-9).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)


@pytest.mark.parametrize("block", [lattice.BLOCK, 7])
def test_groups_against_brute_force(spark, monkeypatch, block):
    # Close pairs all meet; small blocks must not change anything.
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "VISITORS", 5 if block == 7 else lattice.VISITORS)
    rng = np.random.default_rng(2)
    rows = [unit(rng) for _ in range(120)]
    for size, cosine in ((40, 0.995), (25, 0.99), (2, 0.985)):
        rows += list(near(rng, unit(rng), cosine, size))
    rows += [rows[0]] * 9 + [rows[130]] * 4  # equal ones
    rows = [np.float32(r).tolist() for r in rows]
    ids = rng.permutation(1000)[: len(rows)].tolist()
    frame = spark.createDataFrame([(i, v, 0, "p", "s") for i, v in zip(ids, rows)], SCHEMA)
    assert result(lattice.classes(frame, tables_=8, probes=4)) == ordered(brute_force(ids, rows))


def test_recall_and_exactness_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(500):
        centre = unit(rng)
        rows += [centre, near(rng, centre, 0.9005 if k % 2 else 0.8995, 1)[0]]
    frame = spark.createDataFrame([(n, v.tolist(), 0, "", "") for n, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, point string, size string")
    found = {r.vec_id: r for r in lattice.classes(frame).collect()}
    assert all(found[2 * k].n_links == 0 for k in range(0, 500, 2))
    hits = sum(found[2 * k].n_links == 1 and found[2 * k + 1].component_id == 2 * k for k in range(1, 500, 2))
    assert hits >= 0.9 * 250


def test_op13_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    expected = brute_force([r.vec_id for r in rows], [r.embedding for r in rows])
    assert result(queries.op13_lattice(spark, folder)) == ordered(expected)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0]), (5, [1.0, nan, 3.0]), (6, [inf, 1.0, 1.0]), (7, a), (7, a), (8, b), (None, a), (9, [1.0, 2.0]), (9, [-1.0, -2.0]), (10, [3.0]), (None, [1.0]), (None, None), (11, [1e-30, 1e-30, 3e38]), (12, [0.0, 0.0, 3e38])]
    frame = spark.createDataFrame([(i, v, 0, "p", "s") for i, v in rows], SCHEMA)
    expected = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in brute_force([r[0] for r in rows], [r[1] for r in rows])]
    assert result(lattice.classes(frame)) == ordered(expected)
    assert lattice.classes(frame.where("vec_id = 99")).count() == 0
    whole = spark.createDataFrame([(1, [3, 4]), (2, [6, 8]), (3, [-3, 4])], "vec_id long, embedding array<int>")
    assert result(lattice.classes(whole)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
