"""Jaccard join, vector join, components."""

import numpy as np
from helpers import empty_like, jaccard_classes, odd_docs

from postlab.llm import graph, jaccard, vectors
from postlab.llm.catalog import QUERIES
from postlab.llm.common import table
from postlab.llm.licenses import words_of

SF = "/root/testdata/sf0.01"


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(9, 8), (8, 7), (7, 9), (3, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(500, 700)} == {500}
    assert got[9] == got[8] == got[7] == 7 and 3 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want = jaccard_classes(docs, words_of)
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op9_jaccard_join"](spark, SF).collect()}
    assert got == want and any(n for _, n in want.values())


def test_jaccard_small_chunks_and_edges(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 9999, 120)]
    rows = []
    for i in range(80):  # one large group of near copies, cut into many units
        w = list(base)
        w[i] = f"x{i % 7}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{k}" for k in rng.integers(0, 9999, 60))) for i in range(20)] + [(2000, rows[3][1].upper() + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_classes(dict(rows), words_of)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs, chunk=9).collect()}
    assert got == want
    odd = odd_docs(spark)
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].kept and by[2].n_links == 0 and by[None].kept and by[None].class_id is None
    assert by[7].class_id == 5 or by[7].n_links == 0
    assert sum(r.kept for r in rows if r.doc_id == 6) == 0 and by[6].class_id == 5 and by[6].n_links >= 2
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    twice = odd.filter("doc_id = 6")
    assert jaccard.keep_one(twice).count() == 1
    assert jaccard.near_duplicates(empty_like(odd)).count() == 0 and jaccard.keep_one(empty_like(odd)).count() == 0


def _recall(similarity, steps, trees=24, depth=8):
    length, short = depth - steps // trees, steps % trees
    return 1 - (1 - similarity ** length) ** (trees - short) * (1 - similarity ** (length - 1)) ** short


def test_prefixes_are_shortened_until_the_target_recall():
    for size in (1, 3, 4, 6, 7, 11, 80, 5000):
        low, steps = jaccard.lowest_link(size), jaccard.shortenings(size)
        linked = [k / u for k in range(1, size + 1) for u in range(size, 2 * size + 1) if 5 * k >= 4 * u] if size < 100 else [0.8]
        assert abs(low - min(linked)) < 1e-12
        assert _recall(low, steps) >= 0.999 and (steps == 0 or _recall(low, steps - 1) < 0.999)
    assert jaccard.shortenings(3) == 0 and jaccard.shortenings(7) < jaccard.shortenings(6) < jaccard.shortenings(80)
    assert jaccard.shortenings(80, target=0.5) == 0


def test_fat_nodes_keep_the_longer_prefix(spark):
    steps = 24 + 19  # one level everywhere, a second one in 19 of 24 trees
    fat = {3: 70_000, 4: 500, 9: 200, 20: 129}
    rows = [(n, steps, t, b"x", fat.get(t, 2) if n == 1 else 2) for n in (1, 2) for t in range(24) if (n, t) != (2, 23)]
    rows.append((5, 0, 4, b"x", 10 ** 6))
    out = jaccard.prefix_lengths(spark.createDataFrame(rows, "node long, steps int, tree int, leaf binary, members long"), 24, 8).collect()
    got = {(r.node, r.tree): r.length for r in out}
    assert len(out) == len(rows) and got[5, 4] == 8
    assert {t for t in range(24) if got[1, t] == 7} == {3, 4, 9, 20, 23}
    assert {t for t in range(23) if got[2, t] == 7} == {19, 20, 21, 22}  # the missing tree 23 is the fifth
    assert set(got.values()) == {6, 7, 8}


def test_forest_recall_close_to_the_threshold(spark):
    """1,500 planted pairs at 0.80 to 0.85 among unlike texts, without other pairs to help by a common group."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(1500):
        words = [f"a{i}b{k}" for k in range(int(rng.integers(60, 240)))]
        n = len(words) - 4
        new = int(rng.integers(int(n * 0.178), int(n * 0.25) + 1))  # shingles only the longer text has
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *(f"c{i}d{k}" for k in range(new))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = jaccard_classes(dict(rows), words_of)
    assert sum(n == 1 for _, n in want.values()) == 3000
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.996 * len(want)


def _brute(ids, vecs):
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        low = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(ids))])
        if (low == label).all():
            return near.sum(1), label
        label = low


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    hot, far = rng.normal(size=24), rng.normal(size=(120, 24))
    vecs = np.concatenate([far, hot + 0.15 * rng.normal(size=(150, 24)), far[:40] + 0.35 * rng.normal(size=(40, 24)), far[:10], 3 * far[10:20]])
    ids = rng.permutation(len(vecs)).tolist()
    df = spark.createDataFrame([(i, [float(x) for x in v], "l") for i, v in zip(ids, vecs, strict=True)], "vec_id long, embedding array<double>, label string")
    links, label = _brute(ids, vecs)
    assert 0 < np.median(links) and links.sum() > 5000
    for chunk in (vectors.CHUNK, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, chunk=chunk).collect()}
        assert got == {i: (n, c, i == c) for i, n, c in zip(ids, links.tolist(), label.tolist(), strict=True)}


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e300, 1e290])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, kept int")
    out = vectors.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(by[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 9, 11, None))
    assert by[1] == by[8] == by[12] == (4, 1) and by[10] == (4, 1)
    assert vectors.near_duplicates(empty_like(df)).count() == 0


def test_block_budgets_lose_no_pair():
    rng = np.random.default_rng(6)
    for dims in (5, 16, 40, 64):
        a = rng.normal(size=(200, dims))
        b = a + rng.normal(size=a.shape) * rng.uniform(0, 0.6, (200, 1))
        u, v = vectors._unit(a), vectors._unit(b)
        near = (u * v).sum(1) >= 0.9
        square = (vectors.rotated(u) - vectors.rotated(v)) ** 2
        inside = np.zeros(200, bool)
        for (x, y), limit in zip(vectors.blocks(dims), vectors.budgets(dims, 0.9), strict=True):
            inside |= square[:, x:y].sum(1) <= limit
        assert near.any() and inside[near].all()
