"""The pivot index against brute force."""

import numpy as np

from evalmill.llm.embedding_dedup import near_duplicates

from .helpers import SF, components_of

VECTORS = "vec_id long, embedding array<float>, label int, id int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0) for i, v in rows], VECTORS)


def plain(rows, least=0.9):
    known = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, edges = {}, []
    for a, (i, u) in enumerate(known):
        for j, v in known[a + 1 :]:
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                edges.append((i, j))
    return links, components_of({i for i, _ in rows if i is not None}, edges)


def families(rng, n, d=32):
    rows = []
    for _ in range(n):
        base = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), base + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.3])))
    return rows


def test_recall_and_no_false_links(spark):
    rows = families(np.random.default_rng(3), 250)
    links, top = plain(rows)
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= links.get(r.vec_id, 0) for r in got)
    assert sum(r.n_links for r in got) >= 0.95 * sum(links.values())
    assert np.mean([top[r.vec_id] == r.component_id for r in got]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_long_lists_in_blocks_are_exact(spark):
    """A group of near copies much longer than a block: every link is counted once."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(k, base + rng.normal(size=16) * 0.01) for k in range(70)] + [(k, rng.normal(size=16)) for k in range(100, 140)]
    rows += [(200 + k, rows[3][1]) for k in range(30)]
    links, top = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(frame(spark, rows), pivots=8, group=12).collect()}
    near = [i for i, _ in rows if i < 100 or i >= 200]
    assert all(got[i] == (links[i], top[i]) for i in near)


def test_a_family_of_a_third_of_the_rows(spark):
    """Distinct near vectors around one base: before pivots lay apart, recall was 0.19."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=64)
    rows = [(k, base + rng.normal(size=64) * 0.23) for k in range(1000)] + [(k, rng.normal(size=64)) for k in range(1000, 3000)]
    u = np.asarray([v for _, v in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_duplicates(frame(spark, rows)).collect()}
    assert all(got[k] <= links[k] for k, _ in rows)
    assert sum(got.values()) >= 0.95 * links.sum() > 0


def test_recall_holds_with_more_pivots(spark):
    """Pairs at a cosine of 0.9: 1,024 pivots find as many as 256 do."""
    rng = np.random.default_rng(12)
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, noise = u(rng.normal(size=(800, 64))), rng.normal(size=(800, 64))
    noise = u(noise - (noise * a).sum(axis=1, keepdims=True) * a)
    near = 0.905 * a + np.sqrt(1 - 0.905**2) * noise
    rows = list(enumerate([*a, *near, *rng.normal(size=(1500, 64))]))
    got = near_duplicates(frame(spark, rows), pivots=1024).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 1600


def test_rare_vector_lengths(spark):
    """Vectors of a length that is too rare for a share of the pivots."""
    rng = np.random.default_rng(13)
    rows = [(k, rng.normal(size=16)) for k in range(1500)]
    for k in range(1500, 1520, 2):
        v = rng.normal(size=(k - 1494) // 2) + 3
        rows += [(k, v), (k + 1, v + rng.normal(size=len(v)) * 0.001)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(frame(spark, rows), pivots=8).collect()}
    assert [got[k] for k in range(1500, 1520)] == [(1, k - k % 2) for k in range(1500, 1520)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [1, 0, 0]), (4, None), (5, []), (6, [0, 0, 0]), (7, [0, 0, 0]), (8, [nan, 1, 0]), (9, [inf, 0, 0]), (10, [1, None, 0]), (11, [1, 0]), (12, [-1, 0, 0]), (None, [1, 0, 0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None] == (0, None, None)


def test_repeated_ids_and_no_rows(spark):
    got = near_duplicates(frame(spark, [(1, [1, 0]), (1, [1, 0]), (2, [0, 1]), (2, [1, 0.001])])).collect()
    assert sorted((r.vec_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 1)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    links, top = plain([(r.vec_id, r.embedding) for r in df.collect()])
    got = near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.95 * sum(links.values())
