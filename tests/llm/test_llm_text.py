"""BPE, mixing, WARC, language ID, quality and fingerprints."""

import base64
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge import LONG, TEXTS, edge_docs, empty_docs, sha
from pyspark.sql import functions as F

from escrowlens.llm import bpe, langid, mixing, quality, queries, sketch, warc

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = queries.RANKS, public_tokenizers.PATTERN


# ---- BPE

@pytest.fixture(scope="module")
def reference_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward(rng):
    yield from (t for _, t in TEXTS if t)
    yield "<|endoftext|> <|startoftext|>"
    yield "a" * 5000
    yield "".join(rng.choice("abcdefgh") for _ in range(4000))
    yield "​﻿\x00\x07 \r\n\t  x  \n\n"
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x800),
                                      rng.randrange(0x3040, 0x9FFF), 0x1F600 + rng.randrange(60)]))
                      for _ in range(rng.randrange(1, 40)))


def test_bpe_equals_the_public_library(reference_encoding):
    texts = list(awkward(random.Random(1)))
    for one, ids in zip(texts, bpe.Encoder(RANKS, PATTERN).encode(texts), strict=True):
        assert ids.tolist() == reference_encoding.encode_ordinary(one)


def test_bpe_matrix_and_heap_agree():
    vocab, rng = bpe.vocabulary(RANKS), random.Random(2)
    pieces = ["".join(rng.choice("theandingersouäß") for _ in range(n)).encode() for n in range(2, 200, 3)]
    for p, ids in zip(pieces, vocab.merge_matrix(pieces), strict=True):
        assert ids.tolist() == vocab.merge_long(p).tolist()


def test_pair_table_finds_what_was_put_in_and_nothing_else():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 300, (5000, 2)), axis=0).astype(np.int32)
    half, rest = keys[::2], keys[1::2]
    table = bpe.PairTable(half[:, 0], half[:, 1], np.arange(len(half), dtype=np.int32))
    assert (table.find(half[:, 0], half[:, 1]) == np.arange(len(half))).all()
    assert (table.find(rest[:, 0], rest[:, 1]) == bpe.NONE).all()
    assert table.find(np.array([-1, 3], np.int32), np.array([-1, -1], np.int32)).tolist() == [bpe.NONE] * 2


def test_bpe_round_trip_edge_and_empty(spark, reference_encoding):
    coded = bpe.encode(edge_docs(spark), RANKS, PATTERN)
    rows = sorted((tuple(r) for r in coded.collect()), key=repr)
    want = sorted(((i, len(x), bytearray(struct.pack(f"<{len(x)}I", *x))) for i, t in TEXTS
                   for x in [reference_encoding.encode_ordinary(t or "")]), key=repr)
    assert rows == want
    back = bpe.decode(coded, RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in TEXTS)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xff\xff\x7f")), (3, bytearray(b"abc"))],
                                "doc_id long, ids binary")
    assert all(r["decoded"] is None for r in bpe.decode(odd, RANKS).collect())
    assert bpe.round_trip(empty_docs(spark), RANKS, PATTERN).count() == 0


# ---- mixing

def test_mix_reaches_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice("abcd") if i % 3 else "hot")
            for i in range(3000)] + [(-1, None, None), (-2, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, (r.asDict() for r in mixing.mix_sources(docs).collect())))
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        p = per.setdefault(r["source"], [0, r["target"], r["source_size"]])
        p[0] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert sum(t for _, t, _ in per.values()) == pytest.approx(total)
    for taken, target, size in per.values():
        assert abs(taken - target) <= 40 and target <= 3 * size + 1e-9
    # the excess over the caps is shared by weight: one level for all below their cap
    weights = dict(zip(sorted(k for k in per if k is not None), (5, 2, 1, 5, 2)), strict=False) | {None: 1}
    open_ = [t / weights[s] for s, (_, t, size) in per.items() if t < 3 * size - 1e-6]
    assert max(open_) == pytest.approx(min(open_))
    copies = {(r["doc_id"]): r["copies"] for r in got}
    mixed = mixing.mixed_rows(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {k: v for k, v in copies.items() if v}


def test_mix_thresholds_are_nested(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 2 else "t") for i in range(400)],
                                 "doc_id long, text string, source string")
    small, large = ({r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, share=s).collect()}
                    for s in (0.3, 0.7))
    assert all(small[i] <= large[i] for i in small)


def test_mix_edge_and_empty(spark):
    docs = edge_docs(spark)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix_sources(docs).count() == len(TEXTS)
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0)] * 2


# ---- WARC

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/?q=a b\r\nX: y", "<p>x</p>"), (3, None, ""), (4, "http://c/", None),
         (5, "http://d/é", "ünï" * 2000), (6, "u", LONG), (7, "v", "<p>x</p>"), (7, "v", "<p>x</p>"), (None, "w", "alone")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, _sum string")
    index, folder = warc.write_archives(pages, archive_bytes=2000)
    assert index.count() == len(PAGES)
    rows = warc.read_records(index, folder).collect()
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert got == {(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (3, "revisit", 4), (4, "response", None),
                   (5, "response", None), (6, "response", None), (None, "response", None)}
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        assert r["payload_bytes"] == len(html[r["page_id"]])
        assert r["payload_digest"] == warc.sha1_base32(html[r["page_id"]])
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == html[r["page_id"]]
    some = warc.read_records(index.filter("page_id in (6, 2)"), folder, with_payload=False).collect()
    assert {r["page_id"] for r in some} == {2, 6}
    with pytest.raises(Exception, match="start of a record|Error|digest"):
        warc.read_records(index.withColumn("offset", F.col("offset") + 1), folder).collect()


def test_warc_least_bytes_and_empty(spark):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string")
    index, _ = warc.write_archives(pages, least_bytes=5)
    types = {r["page_id"]: r["record_type"] for r in index.collect()}
    assert types == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response"}
    index, folder = warc.write_archives(pages.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_warc_records_parse_and_ranges_coalesce():
    raw = warc.record_bytes(9, "http://x/", b"a\r\n\r\nb", None, None, warc.DATE)
    fields, http, payload = warc.parse_record(raw)
    assert payload == b"a\r\n\r\nb" and fields["warc-target-uri"] == "http://x/" and http["content-length"] == "6"
    assert zlib.decompress(zlib.compress(raw)) == raw
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-1])
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (500, 1)], gap=90, most=200) == [(0, 3, 105), (3, 4, 1)]


# ---- language ID

def test_language_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edge_spans_and_scripts(spark):
    rows = [("the cat and the dog are here " * 20, "en"), ("der hund und die katze sind hier " * 20, "de"),
            ("собака и кошка здесь были " * 20, "ru"), (None, "en"), ("x", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    docs = spark.createDataFrame(
        [(1, "the dog and the cat " * 6 + "der hund und die katze " * 6), (2, None), (3, "12 34 !"), (4, "собака"),
         (5, ""), (None, "the dog"), (7, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [(s["first_word"], s["words"], s["lang"]) for s in got[1]["spans"]] == [(0, 30, "en"), (30, 30, "de")]
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 5))
    assert got[4]["lang_pred"] == "ru" and got[None]["lang_pred"] == "en" and got[7]["lang_pred"] in model.languages
    assert langid.predict(edge_docs(spark), model).count() == len(TEXTS)
    assert langid.predict(empty_docs(spark), model).count() == 0
    nothing = langid.fit(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(7)
    texts = [rng.normal(0, 4, (n, 3)) for n in (1, 2, 5, 7)]
    for s, path in zip(texts, langid.viterbi(texts, penalty=3.0), strict=True):
        value = lambda p: sum(s[k, x] for k, x in enumerate(p)) - 3.0 * (np.diff(p) != 0).sum()
        best = max(value(np.array(np.unravel_index(c, (3,) * len(s)))) for c in range(3 ** len(s)))
        assert value(path) == pytest.approx(best)


def test_viterbi_goes_over_long_texts_alone(monkeypatch):
    model = langid.Model(["de", "en"], np.log(np.full((2, 1 << langid.SLOT_BITS), 0.5)),
                         np.ones((2, len(langid.SCRIPT_NAMES))))
    texts = ["a b c"] * 255 + ["x y " * 75_000, "a b " * 120_000]
    cells, best = [], langid.viterbi

    def watched(scores):
        cells.append((len(scores), len(scores) * max(map(len, scores))))
        return best(scores)

    monkeypatch.setattr(langid, "viterbi", watched)
    got = langid._labelled(model, texts)
    assert all(n == 1 or size <= 200_000 for n, size in cells) and sum(n for n, _ in cells) == 257
    assert [r[2][0]["words"] for r in got] == [3] * 255 + [150_000, 240_000]


def test_texts_of_marks_without_letters_are_unknown():
    model = langid.Model(["de", "en"], np.log(np.full((2, 1 << langid.SLOT_BITS), 0.5)),
                         np.ones((2, len(langid.SCRIPT_NAMES))))
    none = ["\U0001f642\ufe0f", "1\u0301 2", "\u0301"]
    got = langid._labelled(model, [*none, "e\u0301", "\u0301 x"])
    assert got[:3] == [("und", 0.0, [])] * 3
    assert [r[:2] for r in got[3:]] == [("de", 1.0)] * 2


# ---- quality

def test_quality_parts_good_from_bad(spark):
    rows = queries.op9_importance_resampling(spark, "/root/testdata/sf0.01").collect()
    known = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    good = [r["selected"] for r in rows if known.get(r["doc_id"]) == 1]
    bad = [r["selected"] for r in rows if known.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_share_edge_and_empty(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (15, 0, 0), (20, 0, 1), (None, 0, 0), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.resample(docs, labels, share=0.5).collect()
    assert len(rows) == len(TEXTS) and sum(r["selected"] for r in rows) >= len(TEXTS) // 2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 7 in {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(docs, labels.limit(0)).count() == len(TEXTS)
    assert quality.resample(empty_docs(spark), labels).count() == 0


def test_kth_largest_without_sorting(spark):
    rng = random.Random(1)
    keys = [rng.randrange(2**50) for _ in range(500)] + [5, 5, 5]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 250, 501, 503):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 504) == 0 and quality.kth_largest(df, 0) > max(keys)


# ---- fingerprints

def test_next_document_and_edited_digest(spark, tmp_path):
    docs = edge_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    text = {i: t or "" for i, t in TEXTS if i is not None}
    order = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in queries.op10_scaled_sketch(spark, str(tmp_path)).collect()}
    assert set(got) == set(text)
    for k, i in enumerate(order):
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + text[order[(k + 1) % len(order)]][:cut]
        assert got[i]["edited_sha256"] == sha(edited) and got[i]["n_chars"] == len(text[i])
    assert got[7]["fingerprint"] == got[8]["fingerprint"] == got[9]["fingerprint"] != got[12]["fingerprint"]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_meets_over_ranges_ties_and_nulls(spark, buckets):
    rows = [(i, f"text {i}") for i in range(40)] + [(5, "again"), (None, "none"), (None, "nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order) if r[0] is not None)
    got = sketch.with_next(docs, buckets).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["text"]), r["next_text"]) for r in got if r["doc_id"] is not None) == want
    assert sketch.with_next(empty_docs(spark), buckets).count() == 0
    one = sketch.with_next(docs.limit(1), buckets).collect()
    assert one[0]["next_text"] == one[0]["text"]


def test_sketch_estimates_and_merging(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000])), (3, " ".join(words[2000:])), (4, None), (5, "one two")]
    got = sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = got.alias("a").join(got.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"),
        sketch.likeness(F.col("a.sketch"), F.col("b.sketch")).alias("like"),
        sketch.containment(F.col("b.sketch"), F.col("a.sketch")).alias("inside"),
        sketch.merge_sketches(F.col("a.sketch"), F.col("b.sketch")).alias("both"), F.col("a.sketch").alias("sa"))
    rows = {(r["i"], r["j"]): r for r in pairs.collect()}
    assert rows[1, 2]["like"] == pytest.approx(0.25, abs=0.06) and rows[1, 2]["inside"] == 1
    assert rows[1, 3]["like"] == pytest.approx(0.5, abs=0.08) and rows[2, 3]["like"] == 0
    assert rows[1, 2]["both"] == rows[1, 2]["sa"] and rows[4, 5]["inside"] == 0
    one = {r["doc_id"]: r for r in got.collect()}
    assert one[4]["fingerprint"] == "" and len(one[5]["sketch"]) == 1
    assert sketch.fingerprints(edge_docs(spark)).count() == len(TEXTS)


