"""Near-duplicate groups and repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marketlake.llm import ngram_jaccard, setlinks, shingles, substring_dedup
from marketlake.llm.components import components


def shingle_texts(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {i: shingle_texts(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def groups_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join_groups(df).collect()}


def near_copies(seed=3):
    """Bases with edited copies whose similarity lies around the threshold, chains of edits, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice((6, 12, 40, 90)))]
        for edits in (0, 0, 1, 1, 2, 3):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        chain = list(base)
        for _ in range(4):
            chain = chain[1:] + [word()]
            rows.append(" ".join(chain))
    return list(enumerate(rows))


def test_join_groups_equals_brute_force(spark):
    rows = near_copies() + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(df) == brute_groups(rows)


def test_join_groups_on_the_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    assert groups_of(df) == brute_groups([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_join_groups_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, 5, "x"), (1, text, 5, "x"), (None, text, 6, "y"), (2, text.upper(), 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id string")
    got = sorted(map(tuple, ngram_jaccard.join_groups(df).collect()), key=repr)
    assert got == sorted([(1, 26, 1), (1, 26, 1), (None, 26, None), (2, 26, 1)], key=repr)
    kept = ngram_jaccard.keep_one(df).collect()
    assert sorted([r["doc_id"] for r in kept], key=repr) == [1, None]
    assert ngram_jaccard.join_groups(df.limit(0)).collect() == []


def test_rest_tiles_join_what_pivots_do_not(spark):
    """A chain whose ends are not alike is one group although no node of a bucket is near all others."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(25):
        rows.append((k, " ".join(words)))
        for _ in range(2):
            words[r.randrange(200)] = f"w{r.randrange(10**6)}"
    got = groups_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_groups(rows)


def test_bit_counts_never_reject_a_link():
    r = np.random.default_rng(1)
    for n in (1, 5, 33, 200, 3000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.95) + 1], r.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        both = shingles.common(a, b)
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        assert both == len(np.intersect1d(a, b))
        assert not linked or setlinks.bound_allows(len(a), shingles.parity_bitmap(a), len(b), shingles.parity_bitmap(b), 80)
    far = np.unique(r.integers(0, 2**63, 500, dtype=np.uint64)), np.unique(r.integers(0, 2**63, 500, dtype=np.uint64))
    assert not setlinks.bound_allows(500, shingles.parity_bitmap(far[0]), 500, shingles.parity_bitmap(far[1]), 80)


def test_tuned_bands_reach_the_recall():
    for recall in (0.9, 0.999, 0.9999999):
        banding = shingles.Banding.tuned(0.8, recall)
        assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= recall > 1 - (1 - 0.8**banding.rows) ** (banding.bands - 1)


@pytest.mark.parametrize("shape", ["path", "star", "pairs", "none"])
def test_components(spark, shape):
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(7, k) for k in range(30)] + [(3, 3)], "pairs": [(k, k + 100) for k in range(9)], "none": []}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def brute_removed(rows, least=50):
    places = sorted((i, k, shingle_texts(line)) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line.encode().split()) >= least)
    root = list(range(len(places)))
    for a in range(len(places)):
        for b in range(a):
            both = len(places[a][2] & places[b][2])
            if 100 * both >= 80 * (len(places[a][2]) + len(places[b][2]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    out = {}
    for k, (i, pos, _) in enumerate(places):
        if root[k] != k:
            out.setdefault(i, []).append(pos)
    return out


def test_remove_repeats_equals_brute_force(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute_removed(rows)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert want and {i: r["removed_lines"] for i, r in got.items() if r["removed_lines"]} == want
    for i, text in rows:
        lines = text.split("\n")
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in want.get(i, []))
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_remove_repeats_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(2, f"a\n{passage}\nb", 1, "q"), (1, f"{passage}\n{other}", 2, None), (3, None, 3, "q"), (4, "", 4, "q"), (None, passage, 5, "q"),
            (5, f"{passage.upper()}\n\n{passage}", 6, "q"), (6, " ".join(passage.split()[:49]), 7, "q"), (7, other.replace("v59", "x"), 8, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed int, node string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {2: "a\nb", 1: f"{passage}\n{other}", 3: None, 4: "", None: passage, 5: "", 6: rows[6][1], 7: ""}
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_keep_one_tells_rows_of_one_id_apart(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one, "x"), (5, one, "x"), (5, two, "x"), (5, two, "y"), (5, None, "x"), (5, "", "x"), (6, two + " z", "x"), (2, three, "x"), (2, three + " z", "x")]
    kept = ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h string"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert kept.columns == ["doc_id", "text", "h"] and len(got) == 5
    assert [g for g in got if g[0] != 2] == sorted([(1, one), (5, two), (5, None), (5, "")], key=repr) and got[1][1] in (three, three + " z")


def test_lines_of_many_texts_are_signed_as_one_by_one():
    r, banding = random.Random(4), shingles.Banding.tuned(0.8, 0.9999)
    texts = ["\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.choice([3, 49, 50, 51, 90]))) for _ in range(r.randint(0, 6)))
             for _ in range(60)]
    texts = [t.encode() for t in texts] + [b"", b"\n\n", b"a " * 60]
    at, pos, n, node, keys = substring_dedup.paragraph_signatures(50)(texts, banding)
    want = [(k, p, len(v), int(np.frombuffer(shingles.set_key(v)[:8], np.int64)[0]), banding.keys(v).tolist())
            for k, t in enumerate(texts) for p, v in substring_dedup.paragraphs(50)(t)]
    assert list(zip(at.tolist(), pos.tolist(), n.tolist(), node.tolist(), keys.tolist(), strict=True)) == want and len(want) > 50
