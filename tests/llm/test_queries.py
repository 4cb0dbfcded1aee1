"""The queries of the subpackage, called as the driver calls them, against plain versions, libraries and held-out rows."""

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm import brute
from oracle import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangelake.llm import quality_gam, quality_rules, training
from rangelake.llm.queries import BYTE_BPE, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def answer(spark, name):
    return QUERIES[name](spark, str(DATA)).collect()


def crc(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def test_op1(spark, rows):
    lib = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in answer(spark, "op1_bpe")}
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(lib.decode(ids, skip_special_tokens=False)))


def test_op3_on_held_out_documents(spark, rows):
    got = {r.doc_id: r for r in answer(spark, "op3_language_id")}
    assert len(got) == len(rows) and all(got[i].held_out == (crc(i, 5) == 0) and 0 <= got[i].score <= 1 for i, *_ in rows)
    assert all((got[i].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for i, t, _ in rows)
    told = [got[i].lang_pred == lang for i, t, lang in rows if got[i].held_out and lang and len(brute.words(t)) >= 20 and got[i].lang_pred != "und"]
    assert len(told) > 10 and np.mean(told) > 0.9


def test_op3_and_op9_learn_from_their_rows_only(spark, rows, tmp_path):
    """With other languages and labels on held-out rows, and a null doc_id, all else stays as it is."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    part = lambda mod: F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod
    more = spark.createDataFrame([(None, "the of and to in is that for it as was with be by on", "xx")], "doc_id long, text string, lang string")
    docs.withColumn("lang", F.when(part(5) == 0, F.lit("zz")).otherwise(F.col("lang"))).unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(part(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    for name, column in (("op3_language_id", "lang_pred"), ("op9_quality_gam", "predicted")):
        was, now = ({r.doc_id: r for r in QUERIES[name](spark, at).collect()} for at in (str(DATA), str(tmp_path)))
        assert now.pop(None).held_out == (name == "op3_language_id")
        assert {i: (r[column], round(r.score, 9)) for i, r in now.items()} == {i: (r[column], round(r.score, 9)) for i, r in was.items()}


def test_op4_and_op9_against_labels(spark, rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None}
    got = {r.doc_id: r for r in answer(spark, "op4_quality_rules")}
    for i, t, _ in rows:
        r, base = got[i], brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    gam = {r.doc_id: r for r in answer(spark, "op9_quality_gam")}
    assert all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in gam.items())
    held = [(gam[i].score, y) for i, y in labels.items() if i in gam and gam[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.7


def test_op8(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in answer(spark, "op8_token_counts")} == want


def test_op10(spark, rows):
    lib = Tokenizer.from_file(BYTE_BPE)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    got = QUERIES["op10_packing"](spark, str(DATA)).toPandas()
    assert got["length"].sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and (len(ids[r.doc_id]) > 1024 or r.piece == 0)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) * 1.02 + 1


def test_labelled_rows_that_repeat(spark):
    docs = spark.createDataFrame([(i, f"word {'x ' * i}") for i in range(10) for _ in range(5)] + [(0, "another text of this document")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3 + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for most in (10, 5):
        x, y = training.labelled_features(docs, labels, "quality", most)
        assert len(x) == len(y) == most and 0 < y.sum() < most
    assert training.labelled_features(docs, labels, "quality")[1].tolist() == [0] * 5 + [1] * 5
    x, y = training.labelled_features(docs.limit(0), labels, "quality")
    assert x.shape == (0, len(quality_rules.FEATURES)) and not len(y)


def plain_steps(bins, y, z, n, leaves, l2, rate):
    """One step of a feature: the best cuts one after the other, found by trying all."""
    p = [1 / (1 + np.exp(-v)) for v in z]
    weight = lambda rows: (sum(y[r] - p[r] for r in rows), sum(p[r] * (1 - p[r]) for r in rows))
    of = lambda a, b: [r for r in range(len(y)) if a <= bins[r] < b]
    value = lambda rows: (lambda g, h: g * g / (h + l2))(*weight(rows))
    spans = [(0, n)]
    while len(spans) < leaves:
        tries = [(value(of(a, c)) + value(of(c, b)) - value(of(a, b)), c, k) for k, (a, b) in enumerate(spans) for c in range(a + 1, b)]
        if not tries or max(tries)[0] <= 1e-9:
            break
        _, c, k = max(tries)
        a, b = spans[k]
        spans[k : k + 1] = [(a, c), (c, b)]
    step = [0.0] * n
    for a, b in spans:
        g, h = weight(of(a, b))
        step[a:b] = [rate * g / (h + l2)] * (b - a)
    return step


def test_additive_model_against_a_plain_fit():
    rng = np.random.default_rng(3)
    x = rng.random((80, 2))
    y = (x[:, 0] + 0.3 * rng.standard_normal(80) > 0.5).astype(float)
    model = quality_gam.fit_additive(x, y, rounds=6, pair_rounds=0, bins=8, leaves=3)
    base = np.log((y.sum() + 1) / (81 - y.sum()))
    bins = [[bisect_left(list(model.edges[f]), v) for v in x[:, f]] for f in range(2)]
    z, tables = [base] * 80, [[0.0] * len(t) for t in model.tables]
    for _ in range(6):
        for f in range(2):
            step = plain_steps(bins[f], y, z, len(tables[f]), 3, 2.0, 0.08)
            tables[f] = [a + b for a, b in zip(tables[f], step)]
            z = [v + step[b] for v, b in zip(z, bins[f])]
    assert all(np.allclose(a, b) for a, b in zip(tables, model.tables))
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-v)) for v in z])
