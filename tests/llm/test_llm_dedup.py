"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from edge import BASE, TEXTS, edge_docs, edge_rows, empty_docs, sha, words

from escrowlens.llm import exact, graph, lines, minhash, queries, substring
from escrowlens.llm.common import bit_table, maybe_in

SF = "/root/testdata/sf0.001"


def sql_rows(sql, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in docs])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return [dict(zip(names, r, strict=True)) for r in res.fetchall()]


def key(rows, names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# ---- exact

def low(text):
    return (text or "").encode().lower()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        group = groups[low(t)]
        keep = max((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), i == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [6, 22])
def test_exact_edge(spark, bits):
    got = exact.exact_dedup(edge_docs(spark), bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(TEXTS)


def test_exact_drop_copies_keeps_all_columns(spark):
    docs = edge_docs(spark)
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {i for i, _, _, kept in brute_exact(TEXTS) if kept}
    assert len(rows) == len({low(t) for _, t in TEXTS})


def test_exact_empty(spark):
    assert exact.exact_dedup(empty_docs(spark)).count() == 0
    assert exact.drop_copies(empty_docs(spark)).count() == 0


def test_bit_table_has_no_false_negatives_and_is_bounded(spark):
    keys = spark.range(5000).selectExpr("id * 7 as k")
    table = bit_table(keys, ["k"], 10)
    assert table.count() <= 16
    assert maybe_in(keys, table, ["k"], 10, "f").filter("not f").count() == 0


# ---- near

def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def brute_near(rows):
    """Components by comparing every pair of rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if i is None or j is None or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def family(rng, n, size, change):
    """Texts that drift from each other: neighbours alike, ends far apart."""
    text = [f"t{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(text)
        for _ in range(change):
            text[rng.randrange(size)] = f"t{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_near_matches_all_pairs(spark):
    rng = random.Random(5)
    rows = list(TEXTS)
    for n, size, change in ((12, 120, 2), (30, 200, 4), (8, 40, 1), (25, 90, 3)):
        fresh = family(rng, n, size, change)
        rows += [(100 + len(rows) + k, t) for k, t in enumerate(fresh)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_edge_and_empty(spark):
    docs = edge_docs(spark)
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, c in brute_near(TEXTS) if i == c]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert minhash.near_dedup(empty_docs(spark)).count() == 0


def test_blocks_count_what_a_member_takes_besides_its_set(spark, monkeypatch):
    """Members with sets of a few hashes don't fill a block by the hundred thousand."""
    seen = {}
    monkeypatch.setattr(minhash, "staged", lambda df, name: seen.setdefault(name, df))
    sig = bytes(minhash.PERMS)
    sets = spark.createDataFrame([(k, sig, bytes(8)) for k in range(4)], "id long, sig binary, set binary")
    members = spark.createDataFrame([(1, k, 0, 4) for k in range(4)], "key long, id long, first long, n long")
    roots = spark.createDataFrame([(k, 0 if k < 2 else k) for k in range(4)], "id long, root long")
    minhash._bucket_links(members, roots, sets)
    assert {r["_bytes"] for r in seen["near-open"].collect()} == {8 + minhash.PERMS + minhash.ROW_BYTES}


def test_near_id_with_two_texts_is_one_document(spark):
    a, b = family(random.Random(1), 2, 80, 60)
    rows = [(1, a), (5, a), (5, b), (7, b), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(docs).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9}


def test_pruning_keeps_similar_pairs_and_drops_distant_ones():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    one = np.sort(pool[:1000])
    sig = minhash.signature(minhash.minhashes(one))
    kept = far = 0
    for trial in range(60):
        near = np.sort(np.concatenate([one[: 1000 - 130], pool[1000 + trial * 40: 1130 + trial * 40]]))
        kept += len(minhash.plausible(sig, minhash.signature(minhash.minhashes(near))[None]))
        away = np.sort(np.concatenate([one[:300], pool[1000 + trial * 30: 1700 + trial * 30]]))
        far += len(minhash.plausible(sig, minhash.signature(minhash.minhashes(away))[None]))
        assert minhash.linked(one, near) == (100 * len(np.intersect1d(one, near))
                                             >= 75 * len(np.union1d(one, near)))
    assert kept == 60 and far == 0
    least = minhash.least_matches()
    assert (np.diff(least) >= 0).all() and least[-1] < 0.75 * minhash.PERMS


@pytest.mark.parametrize("two", [False, True])
def test_block_links_join_what_all_pairs_join(two):
    rng = random.Random(8)
    texts = family(rng, 20, 60, 2) + family(rng, 20, 60, 2)
    sets = [np.sort(minhash.shingle_set(t.encode().split())) for t in texts]
    n = len(sets)
    part = [k % 2 for k in range(n)]
    rows = pa.table({
        "id": list(range(n)), "part": pa.array(part, pa.int32()), "root": list(range(n)), "is_first": [False] * n,
        "sig": pa.array([minhash.signature(minhash.minhashes(s)).tobytes() for s in sets], pa.binary()),
        "set": pa.array([s.tobytes() for s in sets], pa.binary())})
    key_ = (pa.scalar(1), pa.scalar(0), pa.scalar(1 if two else 0))
    got = minhash._block_links(key_, rows).to_pylist()
    assert len(got) < n
    all_ = [(i, j) for i in range(n) for j in range(i + 1, n)
            if minhash.linked(sets[i], sets[j]) and (not two or part[i] != part[j])]
    assert union(n, [(r["a"], r["b"]) for r in got]) == union(n, all_)


def union(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(x) for x in range(n)]


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in
           graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(400, links)
    assert all(want[i] == r for i, r in got.items())
    assert set(got) == {x for a, b in links for x in (a, b) if a != b}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- lines

def brute_lines(rows):
    count, first = Counter(), {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        for at, _, raw in lines.chunks(rows[k][1], lines.ROLL, lines.EVERY, lines.LEAST_LINES):
            count[raw] += 1
            first.setdefault(raw, (rows[k], at))
    out = []
    for row in rows:
        have = [] if row[1] is None else row[1].encode().split(b"\n")
        keep = [True] * len(have)
        for at, n, raw in lines.chunks(row[1], lines.ROLL, lines.EVERY, lines.LEAST_LINES):
            if count[raw] > 1 and first[raw] != (row, at):
                keep[at:at + n] = [False] * n
        text = None if row[1] is None else b"\n".join(x for x, k in zip(have, keep) if k).decode()
        out.append((row[0], len(have), keep.count(False), text))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    block = [[f"block {b} line {k}" for k in range(9)] for b in range(6)]
    rows = list(TEXTS)
    for i in range(60):
        body = [f"own {i} {k}" for k in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(block)
        rows.append((1000 + i, "\n".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.line_dedup(docs).collect()), key=repr)
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 100
    assert lines.line_dedup(empty_docs(spark)).count() == 0


def earlier_runs(rows):
    """Lines under a run of two or more lines, not all blank, that occurs before."""
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        have, under = rows[k][1].split("\n"), set()
        for a in range(len(have) - 1):
            pair = tuple(have[a:a + 2])
            if "".join(pair).strip():
                under |= {a, a + 1} if pair in seen else set()
                seen.add(pair)
        out.append((rows[k][0], len(have), len(under),
                    "\n".join(x for a, x in enumerate(have) if a not in under)))
    return sorted(out)


def test_lines_whose_hashes_collide_are_compared_by_bytes(spark, monkeypatch):
    """With hashes of two bits nearly all chunks collide; the result is the same."""
    docs = edge_docs(spark)
    want = sorted(map(tuple, lines.line_dedup(docs).collect()), key=repr)
    real = lines._key
    monkeypatch.setattr(lines, "_key", lambda raw, seed=0: real(raw, seed) & 3)
    assert sorted(map(tuple, lines.line_dedup(docs).collect()), key=repr) == want


def test_lines_of_all_repeated_runs_go(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(f"own {i} {k}" for k in range(9))) for i in range(8)]
    for i in range(8, 90):
        body = [f"own {i} {k}" for k in range(rng.randrange(4))]
        a, n = rng.randrange(8), rng.randrange(1, 9)  # a run from anywhere in an earlier text
        run = rows[rng.randrange(8)][1].split("\n")[a:a + n]
        at = rng.randrange(len(body) + 1)
        rows.append((i, "\n".join(body[:at] + run + body[at:])))
    rows += [(90, "la\n" * 5 + "end"), (91, "new\nla\nla\nother")]
    want = earlier_runs(rows)
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 150
    assert want[90][3] == "la\nend" and want[91][3] == "new\nother"


def test_lines_blank_stretches(spark):
    passage = "a\nb\n\n\n\n\nc\nd"
    rows = [(1, passage), (2, passage), (3, "\n\n\n"), (4, "\n\n\n")]
    got = {r["doc_id"]: r for r in
           lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == passage and got[2]["text"].strip() == ""
    assert got[3]["n_removed"] == got[4]["n_removed"] == 0


def test_chunk_ends_shift_with_the_text():
    rng = random.Random(6)
    body = [f"line {rng.random()}".encode() for _ in range(400)]
    cut = set(lines.chunk_ends(body))
    moved = {e - 3 for e in lines.chunk_ends([b"a", b"b", b"c", *body])}
    assert len(cut - moved) <= 1


# ---- substring

def brute_substring(rows, window=35):
    have = [words(t) for _, t in rows]
    seen = Counter(tuple(w[k:k + window]) for w in have for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, have, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=repr)


def test_substring_matches_brute_force(spark):
    rng = random.Random(9)
    passages = [[f"p{b}w{k}" for k in range(n)] for b, n in enumerate((34, 35, 36, 50, 80))]
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 2000]
    for i in range(50):
        body = [f"own{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)[rng.randrange(3):]
        rows.append((1000 + i, "  ".join(body)))
    rows.append((2000, BASE + "\n"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring.remove_repeats(docs).collect()), key=repr)
    assert got == brute_substring(rows)


def test_substring_edge_and_empty(spark):
    got = {r["doc_id"]: r for r in substring.remove_repeats(edge_docs(spark)).collect()}
    assert got[13]["n_removed"] == got[14]["n_removed"] == 30_000
    assert got[15]["n_removed"] == 50 and got[1]["kept"] == "" and got[4]["kept"] == "One two three"
    assert substring.remove_repeats(empty_docs(spark)).count() == 0


def test_cover_property():
    assert substring.covers(substring.PERIOD, substring.COVER)
    assert not substring.covers(21, (0, 1, 2, 3, 4))
    with pytest.raises(ValueError):
        substring.remove_repeats(None, cover=(0, 1))


# ---- the SQL of the queries on rows with nulls

@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_substring_dedup", "op4_source_mix"])
def test_queries_match_sql_on_edge_rows(spark, tmp_path, name):
    rows = [r for r in edge_rows() if r[0] is not None and (r[1] is None or len(r[1]) < 100_000)]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, edge_docs(spark).schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    want = sql_rows(queries.SQL[name], rows)
    names = sorted(want[0])
    assert sorted(got[0]) == names
    assert key(got, names) == key(want, names)


def test_exact_query_matches_sql_on_null_and_repeated_ids(spark, tmp_path):
    rows = edge_rows()
    rows += [(i, t, *rows[0][2:]) for i, t in
             [(8, "another text"), (8, BASE + "!"), (None, BASE), (None, "alone"), (None, "Alone")]]
    spark.createDataFrame(rows, edge_docs(spark).schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in queries.op5_exact_dedup(spark, str(tmp_path)).collect()]
    want = sql_rows(queries.OP5_SQL, rows)
    assert len(got) == len(rows) and sorted(got[0]) == sorted(want[0])
    assert key(got, sorted(want[0])) == key(want, sorted(want[0]))


def test_digest_is_of_the_whole_text(spark, tmp_path):
    edge_docs(spark).filter("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text_sha256"] for r in queries.op5_exact_dedup(spark, str(tmp_path)).collect()}
    assert got[9] == sha(BASE) and got[1] == hashlib.sha256(b"").hexdigest()
