"""Every pipeline stage against a brute-force version, on what the stage before kept."""

import struct
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from edge import edge_docs, empty_docs
from test_llm_dedup import brute_exact, brute_near, low, sql_rows
from test_llm_text import reference_encoding  # noqa: F401  (a fixture)

import __spark_entry__ as entry
from escrowlens.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "near_dedup", "source_mix", "tokenise"]
    found = entry.queries()
    assert found["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1


def test_stages_match_brute_force(spark, tmp_path, reference_encoding):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = {c: k for k, c in enumerate(columns)}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(rows_of(docs))
    everything = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    good, exact, near, mix, ids = kept

    scores = queries.quality.resample(spark.read.parquet(f"{SF}/documents.parquet"),
                                      spark.read.parquet(f"{SF}/labels.parquet")).collect()
    chosen = {r["doc_id"] for r in scores if r["selected"]}
    assert sorted(good, key=repr) == sorted((r for r in everything if r[at["doc_id"]] in chosen), key=repr)

    pair = lambda rows: [(r[at["doc_id"]], r[at["text"]]) for r in rows]
    stays = {i for i, _, _, kept_ in brute_exact(pair(good)) if kept_}
    assert sorted(exact, key=repr) == sorted((r for r in good if r[at["doc_id"]] in stays), key=repr)
    assert len({low(t) for _, t in pair(exact)}) == len(exact)

    heads = {i for i, _, c in brute_near(pair(exact)) if i == c}
    assert sorted(near, key=repr) == sorted((r for r in exact if r[at["doc_id"]] in heads), key=repr)

    four = [(r[at["doc_id"]], r[at["text"]], r[at["lang"]], r[at["source"]]) for r in near]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in sql_rows(queries.OP4_SQL, four)}
    assert Counter(r[at["doc_id"]] for r in mix) == Counter({i: n for i, n in taken.items() if n})

    want = Counter()
    for r in mix:
        x = reference_encoding.encode_ordinary(r[at["text"]])
        want[(r[at["doc_id"]], len(x), struct.pack(f"<{len(x)}I", *x))] += 1
    assert Counter((i, n, bytes(b)) for i, n, b in ids) == want
    assert public_tokenizers.PATTERN


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_edge_rows_and_empty_tables(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, edge_docs(spark), SF)
    assert stage == 4 or out.columns == edge_docs(spark).columns
    assert out.count() > 0
    assert run(spark, empty_docs(spark), SF).count() == 0
