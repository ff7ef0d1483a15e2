"""Nearest neighbours, hard negatives and the filter audit against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from edge import edge_docs, edge_rows, empty_docs

from escrowlens.llm import audit, multi_index, negatives, queries, vectors
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = ("vec_id long, embedding array<float>, label int, query_id long, rank int, score double, "
          "block long, cell long, `a.b` string")


def vec_rows(rows):
    return [(i, v, l, 7, 7, 7.0, 7, 7, "dot") for i, v, l in rows]


def edge_vectors():
    """Awkward rows, a vector that a third of the rows repeat, and ordinary ones."""
    rng = random.Random(5)
    unit = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(0, unit(), 1), (100, unit(), 2), (200, None, 1), (300, [0.0] * 6, 1), (400, [], 2),
            (500, [1.0, NAN] * 3, 1), (600, [1.0, INF] * 3, 1), (700, [1.0, None] * 3, 3),
            (None, unit(), 1), (800, unit(), None), (900, [1.0, 2.0], 1), (1000, unit(), 77)]
    hot = unit()
    rows += [(1100 + k, hot, k % 2) for k in range(100)]
    rows += [(2000 + k, unit(), k % 4) for k in range(200)]
    rows += [(2100, rows[-1][1], 3), (2007, hot, 2)]  # repeated ids
    return rows


def finite(v):
    return v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)


def brute_nearest(rows, k):
    use = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows
           if i is not None and finite(v) and any(v)]
    asked = {}
    for i, v in use:
        if i % 100 == 0:
            asked[i] = min([asked[i], v], key=tuple) if i in asked else v
    out = []
    for i, q in asked.items():
        near = sorted((math.sqrt(((v - q) ** 2).sum()), j) for j, v in use if j != i)[:k]
        out += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return sorted(out)


def test_nearest_full_walk_is_exact_on_edge_rows(spark):
    df = spark.createDataFrame(vec_rows(edge_vectors()), SCHEMA)
    got = multi_index.nearest_neighbours(df, F.col("vec_id") % 100 == 0, k=10, recall=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = sorted(map(tuple, got.collect())), brute_nearest(edge_vectors(), 10)
    # recall 1 on all queries: every probe's true neighbours are walked
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_nearest_small_blocks_split_the_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "rows_of", lambda values, dims: 16)
    df = spark.createDataFrame(vec_rows(edge_vectors()), SCHEMA)
    got = multi_index.nearest_neighbours(df, F.col("vec_id") % 100 == 0, k=10, recall=1.0).collect()
    assert [tuple(r)[:3] for r in sorted(map(tuple, got))] == [r[:3] for r in brute_nearest(edge_vectors(), 10)]


def test_nearest_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [3.0, 0.0], 1)]
    ask = F.col("vec_id") % 100 == 0
    got = multi_index.nearest_neighbours(spark.createDataFrame(vec_rows(rows), SCHEMA), ask).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    for none in ([], [(0, None, 1)], [(0, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]):
        assert multi_index.nearest_neighbours(spark.createDataFrame(vec_rows(none), SCHEMA), ask).count() == 0


def test_nearest_recall_and_scores_on_a_given_table(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in
            spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = queries.op11_inverted_multi_index(spark, "/root/testdata/sf0.1").collect()
    hit = 0
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in by.items():
        dist = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        dist[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, dist))[:10]].tolist())
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        assert all(abs(dist[ids == r["vec_id"]][0] - r["score"]) < 1e-12 for r in found)
        hit += len(true & {r["vec_id"] for r in found})
    assert hit / len(got) >= 0.9


@pytest.mark.parametrize("seed", range(5))
def test_walk_leaves_the_heap_in_order_of_summed_distance(seed):
    rng = np.random.default_rng(seed)
    books = rng.integers(0, 4, (7, 2)).astype(float), rng.integers(0, 4, (5, 3)).astype(float)  # with ties
    counts = rng.integers(0, 4, 35)
    index = multi_index.Index(5, books, counts, *multi_index.laid_out(counts, 5))
    q = rng.normal(size=5)
    da, db = multi_index.half_distances(q, index)
    sums = (da[:, None] + db[None]).ravel()
    for visit in (1, 10, int(counts.sum()), 10 ** 6):
        cells, last = multi_index.walk(q, index, visit)
        assert len(set(cells.tolist())) == len(cells)
        assert np.all(np.diff(sums[cells]) >= 0) and last == sums[cells[-1]]
        assert sums[cells[-1]] <= np.delete(sums, cells).min(initial=np.inf)
        assert counts[cells].sum() >= min(visit, counts.sum())
        assert counts[cells[:-1]].sum() < visit


def test_blocks_hold_whole_cells_or_parts_of_one():
    counts = np.array([3, 0, 4, 9, 40, 1, 1, 6])
    first, blocks = multi_index.laid_out(counts, 10)
    held = Counter()
    for f, b, n in zip(first, blocks, counts, strict=True):
        assert b == max(1, -(-n // 10))
        for k in range(b):
            held[f + k] += n / b
    assert max(held.values()) <= 10
    assert len({f for f, n in zip(first, counts, strict=True) if n}) == 4


# ---- hard negatives


def brute_negatives(rows, positives=5, k=10, low=30, high=90):
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and finite(v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    asked = {}
    for i, label, q in use:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, (label, q) in asked.items():
        others = [(-dot(q, w), j, m) for j, m, w in use if j != i]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            window = sorted(x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def query_form(df):
    rows = negatives.quantised(df)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("rows_in_block", [None, 16])
def test_negatives_edge_rows(spark, monkeypatch, rows_in_block):
    if rows_in_block:
        monkeypatch.setattr(negatives, "rows_of", lambda values, dims: rows_in_block)
        monkeypatch.setattr(negatives, "ZONES_PER_PACK", 4)
    got = query_form(spark.createDataFrame(vec_rows(edge_vectors()), SCHEMA))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(edge_vectors())
    assert len(want) > 50
    assert sorted(map(tuple, got.collect())) == want


def test_negatives_empty(spark):
    for none in ([], [(0, None, 1)], [(0, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1)]):
        assert query_form(spark.createDataFrame(vec_rows(none), SCHEMA)).count() == 0


def test_hilbert_curve_visits_every_point_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = negatives.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(len(points)))
        path = points[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("size", [5, 10 ** 6, 2 ** 40, 2 ** 62])
def test_bounds_hold_every_product_and_are_reached(size):
    rng = np.random.default_rng(size % 97)
    a = rng.integers(-size, size, (4, 3))
    box = rng.integers(-size, size, (20, 3))
    low, high = box.min(axis=0)[None], box.max(axis=0)[None]
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in box] for p in a]
    clip = lambda x: max(negatives.LEAST, min(negatives.MOST, x))
    assert negatives.products(a, box).tolist() == [[clip(x) for x in row] for row in exact]
    least, most = negatives.bounds(a, low, high)
    for r, p in enumerate(a):
        corners = [sum(int(x) * int(y) for x, y in zip(p, c, strict=True))
                   for c in itertools.product(*zip(low[0].tolist(), high[0].tolist(), strict=True))]
        assert (least[r, 0], most[r, 0]) == (clip(min(corners)), clip(max(corners)))


def test_zone_maps_skip_blocks_on_clustered_rows(spark, monkeypatch):
    """Rows in tight clusters: an anchor's windows read a small share of the blocks."""
    monkeypatch.setattr(negatives, "rows_of", lambda values, dims: 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6)) * 40
    rows = [(k, (centres[k % 20] + rng.normal(size=6)).tolist(), int(k % 5)) for k in range(2000)]
    table = negatives.usable(spark.createDataFrame(
        [(i, [int(x) for x in v], l) for i, v, l in rows], "vec_id long, vec array<bigint>, label int"))
    entries, zones = negatives.blocks_of(table, 6, 2000)
    held = {r["block"]: r["count"] for r in entries.groupBy("block").count().collect()}
    assert sum(held.values()) == 2000 and max(held.values()) <= 50
    boxes = zones.toPandas().sort_values("block")
    low, high = (np.array(boxes[c].tolist()) for c in ("low", "high"))
    a = np.array([int(x) for x in rows[0][1]])[None]
    least, most = negatives.bounds(a, low, high)
    own = int(a @ a.T)
    assert ((most >= 0.8 * own) & (least <= own)).mean() < 0.25


# ---- filter audit


def brute_audit(docs, good, toxic):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    per = defaultdict(list)
    for i, t, _, source, *_ in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        per[source or ""].append((fails, i in good, i in toxic))
    out, total = [], Counter()
    for part, rows in per.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone),
                            sum(r[0][f] for r in rows) - len(gone),
                            sum(r[0][f] and sum(r[0].values()) == 1 for r in rows),
                            sum(r[1] for r in gone), sum(r[2] for r in gone), f])
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


LABELS = [(5, 1, 0), (5, 0, 1), (7, 1, None), (8, None, 1), (9, 1, 1), (14, 1, 0), (20, 0, 0), (None, 1, 1), (99, 1, 1)]


def label_table(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_edge_rows_against_brute_force_and_sql(spark):
    rows = edge_rows()
    got = audit.filter_audit(edge_docs(spark), label_table(spark))
    good = {i for i, q, _ in LABELS if q == 1} - {None}
    toxic = {i for i, _, t in LABELS if t == 1} - {None}
    want = brute_audit(rows, good, toxic)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"src", "b", "", "é"}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(queries.OP13_SQL).fetchall()) == want


def test_audit_without_rows_or_labels(spark):
    assert audit.filter_audit(empty_docs(spark), label_table(spark)).count() == 0
    got = audit.filter_audit(edge_docs(spark), label_table(spark, []))
    assert got.count() == 4 * 600 and got.agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", range(1, 6))
def test_adjacent_swaps_visit_all_orders_and_swaps_keep_the_diagram(n):
    rng = random.Random(n)
    counts = {m: (rng.randint(1, 9), rng.randint(0, 3), 0) for m in range(1 << n) if rng.random() < 0.6} \
        or {0: (1, 0, 0)}
    d = audit.Diagram(counts, n)
    seen = {tuple(d.order)}

    def leaves(node, level=0, mask=0):
        if node is d.empty:
            return {}
        if level == n:
            return {mask: node.weight}
        return {**leaves(node.low, level + 1, mask), **leaves(node.high, level + 1, mask | 1 << d.order[level])}

    for k in audit.adjacent_swaps(n):
        d.swap(k)
        seen.add(tuple(d.order))
        assert leaves(d.root) == counts
        fresh = sum(len(level) for level in d.levels)
        assert fresh <= 2 ** n - 1
        assert d.root.weight == tuple(map(sum, zip(*counts.values(), strict=True)))
    assert len(seen) == math.factorial(n)


def test_chunks_and_slices():
    assert vectors.rows_of(1 << 10, 64) == 16 and vectors.rows_of(100, 4096) == 16
