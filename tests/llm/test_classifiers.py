"""Classifiers and language identification: held-out accuracy, odd rows, and their inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from marketlake.llm import labelled, language_id, quality_fm, toxicity_cnn
from marketlake.llm.common import held_out

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet").repartition(4), spark.read.parquet(f"{LARGER}/labels.parquet")


def ranked(scores, labels):
    order = np.argsort(scores, kind="stable")
    places = np.empty(len(order))
    places[order] = np.arange(len(order))
    one = labels == 1
    return (places[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def on_held_out(scored, labels, target):
    rows = scored.join(labels, "doc_id").where(held_out()).select("__score", target).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    scores, truth = on_held_out(quality_fm.score_documents(docs, labels, metadata=("n_chars",), threshold=0.3), labels, "quality")
    assert ranked(scores, truth) > 0.97 and ((scores >= 0.3) == (truth == 1)).mean() > 0.95
    assert (scores[truth == 1] >= 0.3).mean() > 0.98 and scores.min() >= 0 and scores.max() <= 1


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    scores, truth = on_held_out(toxicity_cnn.score_documents(docs, labels), labels, "toxic")
    assert ranked(scores, truth) > 0.95 and ((scores >= 0.5) == (truth == 1)).mean() > 0.96
    assert (scores[truth == 0] < 0.5).mean() > 0.97


def test_held_out_follows_the_checksum(spark):
    rows = spark.range(500).toDF("doc_id").withColumn("h", held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module", [quality_fm, toxicity_cnn])
def test_scores_read_the_text_and_learning_labels_only(spark, folder, module):
    target = "quality" if module is quality_fm else "toxic"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    first = {r["doc_id"]: r["__score"] for r in module.score_documents(docs, labels).collect()}
    changed = labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - {target} else {target} end as {target}")
    moved = docs.selectExpr("doc_id", "text", "'xx' as lang", "reverse(source) as source", "7 as score", "n_chars")
    again = {r["doc_id"]: r["__score"] for r in module.score_documents(moved, changed).collect()}
    assert first == again and len(first) == docs.count()


@pytest.mark.parametrize("module", [quality_fm, toxicity_cnn])
def test_scores_of_odd_rows(spark, folder, module):
    target = "quality" if module is quality_fm else "toxic"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(None, "a b"), (90001, None), (90002, ""), (90003, "x " * 60000), (90004, "\x00 ￿ \n\n"), (90004, "\x00 ￿ \n\n")], "doc_id long, text string")
    rows = [r for r in module.score_documents(known.union(odd), labels).collect() if r["doc_id"] is None or r["doc_id"] > 90000]
    assert len(rows) == 6 and all(0 <= r["__score"] <= 1 for r in rows)
    assert len({r["__score"] for r in rows if r["doc_id"] == 90004}) == 1
    assert module.score_documents(known.limit(0), labels).collect() == []
    assert {r["__score"] for r in module.score_documents(known, labels.limit(0)).collect()} == {0.5 if module is quality_fm else 0.0}
    one = labels.where(f"{target} = 1")
    assert {r["__score"] for r in module.score_documents(known, one).collect()} == {1.0}


def test_interactions_equal_the_sum_over_pairs():
    r = np.random.default_rng(0)
    m = quality_fm.Machine([], r.normal(size=50), r.normal(size=(50, 4)), 0.3)
    ids, values, starts = np.array([3, 7, 9, 1, 2]), r.normal(size=5), np.array([0, 3])
    want = []
    for a, b in ((0, 3), (3, 5)):
        pairs = sum((m.vectors[ids[i]] @ m.vectors[ids[j]]) * values[i] * values[j] for i in range(a, b) for j in range(i + 1, b))
        want.append(0.3 + m.weights[ids[a:b]] @ values[a:b] + pairs)
    assert np.allclose(m.logits(ids, values, starts)[0], want)


def test_filters_stay_within_their_document():
    r = np.random.default_rng(0)
    net = toxicity_cnn.Network(
        np.array([], np.uint64), r.normal(size=(9, toxicity_cnn.DIMENSION)).astype(np.float32),
        [r.normal(size=(w, toxicity_cnn.DIMENSION, toxicity_cnn.FILTERS)).astype(np.float32) for w in toxicity_cnn.WIDTHS],
        np.zeros(3, np.float32), r.normal(size=24), 0.1, np.zeros(5))
    net.embeddings[0] = 0
    codes = [np.array([1, 2, 3]), np.zeros(0, np.int64), np.array([4]), np.array([5, 6, 7, 8, 1, 2])]
    bits = [np.zeros(len(c), np.int64) for c in codes]
    together = net.logits(toxicity_cnn._joined(codes, bits))
    alone = [net.logits(toxicity_cnn._joined([c], [b]))[0] for c, b in zip(codes, bits, strict=True)]
    assert np.allclose(together, alone, atol=1e-5)


def test_sample_is_bounded(spark, larger):
    docs, labels = larger
    sample, counts = labelled.training_sample(docs.select("doc_id", "text"), labels, "toxic", rows=30, chars=40_000)
    rows = sample.collect()
    assert counts[1] > 100 and 1 <= sum(r["__label"] for r in rows) <= 30
    for label in (0, 1):
        assert sum(len(r["text"]) for r in rows if r["__label"] == label) <= 40_000


def test_languages_of_documents_and_pages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language_id.page_rows(spark.read.parquet(f"{folder}/pages.parquet")).unionByName(language_id.document_rows(docs))
    got = language_id.identify(rows, docs.select("text", "lang")).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = {r["doc_id"]: r["lang"] for r in got if r["kind"] == "document"}
    assert set(found) == set(truth) and np.mean([found[i] == truth[i] for i in truth]) > 0.99
    assert len([r for r in got if r["kind"] == "page"]) == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert all(0 < r["posterior"] <= 1 + 1e-9 for r in got)


def test_evidence_decides_where_the_text_does_not(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang")
    texts = {lang: [r[0] for r in docs.where(f"lang = '{lang}'").limit(30).collect()] for lang in ("de", "en")}
    rows = [(k, t, "h.de", "de", lang) for lang in texts for k, t in enumerate(texts[lang]) if lang == "de"]
    rows += [(100 + k, t, "h.com", "com", "en") for k, t in enumerate(texts["en"])]
    rows += [(1000, None, "h.de", "de", None), (1001, "", "h.com", "com", None), (1002, None, "new.de", "de", None), (1003, "12345", None, None, "de-DE"),
             (1004, None, None, None, None), (1004, None, None, None, None), (1005, "x" * 300000, "h.com", "com", "xx")]
    df = spark.createDataFrame(rows, "id long, text string, host string, suffix string, declared string").selectExpr(
        "id", "7 as posterior_before", "text", "false as markup", "declared", "host", "suffix")
    got = {r["id"]: r["lang"] for r in language_id.identify(df, docs).collect()}
    assert got[1000] == "de" and got[1001] == "en" and got[1002] == "de" and got[1003] == "de" and len(got) == len(rows) - 1
    assert language_id.identify(df.limit(0), docs).collect() == []
    assert {r["lang"] for r in language_id.identify(df, docs.limit(0)).collect()} == {"und"}


def test_trigrams_equal_a_plain_count():
    texts = [b"Ab, cd", b"", b"x", "é ü".encode(), b"a" * 50]
    codes, sizes = language_id.trigrams(texts)
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        alone, m = language_id.trigrams([t])
        assert m[0] == n and (codes[at : at + n] == alone).all()
        at += n
    assert at == len(codes) and language_id.visible(b"<p a='b'>x</p><script>y</script><!-- z -->w").split() == [b"x", b"w"]


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """Each toxic word stands in few documents, so it is only known if all labelled documents are read."""
    monkeypatch.setattr(toxicity_cnn, "SHARD_ROWS", 1000)
    rows = [(k, f"the plain text of number {k % 7} " + ("good" if k % 5 else f"bad{k // 5 % 140}"), int(k % 5 == 0)) for k in range(4400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    learnt = {}
    for k, text, toxic in rows:
        if toxic and zlib.crc32(str(k).encode()) % 5:
            learnt[text.split()[-1]] = learnt.get(text.split()[-1], 0) + 1
    net = toxicity_cnn.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    want = {labelled.xxhash.xxh3_64_intdigest(w.encode()) for w, n in learnt.items() if n >= toxicity_cnn.LEAST_DOCS}
    assert len(want) > 100 and want <= set(net.hashes.tolist())
    texts = [t.encode() for _, t, _ in rows]
    scores = net.scores(net.words(texts, net.coder()))
    assert ((scores >= 0.5) == np.array([r[2] == 1 for r in rows])).mean() > 0.98


def test_shortened_documents_have_the_same_responses():
    r = np.random.default_rng(4)
    table = r.normal(size=(9, toxicity_cnn.DIMENSION)).astype(np.float32)
    table[0] = 0
    net = toxicity_cnn.Network(
        np.array([], np.uint64), table, [r.normal(size=(w, toxicity_cnn.DIMENSION, toxicity_cnn.FILTERS)).astype(np.float32) for w in toxicity_cnn.WIDTHS],
        np.full(3, -0.1, np.float32), r.normal(size=24), 0.1, np.zeros(5))
    codes = [np.where(r.random(n) < 0.1, r.integers(1, 9, n), 0) for n in (0, 1, 2, 5, 40, 40, 300, 300)] + [np.zeros(50, np.int64)]
    short = [toxicity_cnn._shortened(c) for c in codes]
    assert sum(map(len, short)) < sum(map(len, codes)) and not len(short[-1])
    both = [net.pooled(toxicity_cnn.Words(*toxicity_cnn._padded(c), np.zeros(len(c), int)))[0] for c in (codes, short)]
    assert np.allclose(*both, atol=1e-6)
