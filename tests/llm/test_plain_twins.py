"""Plain loops for what has no SQL: the convolution of the toxicity network, and the posterior of the language identification."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from marketlake.llm import language_id, toxicity_cnn


def test_logits_equal_a_direct_convolution():
    r = np.random.default_rng(5)
    size = toxicity_cnn.DIMENSION
    net = toxicity_cnn.Network(
        np.array([], np.uint64), r.normal(size=(30, size)).astype(np.float32),
        [r.normal(size=(w, size, toxicity_cnn.FILTERS)).astype(np.float32) for w in toxicity_cnn.WIDTHS], r.normal(size=len(toxicity_cnn.WIDTHS)).astype(np.float32),
        r.normal(size=len(toxicity_cnn.WIDTHS) * toxicity_cnn.FILTERS), -0.7, np.zeros(len(toxicity_cnn.LANGUAGES) + 1))
    net.embeddings[0] = 0
    codes = [r.integers(0, 30, n) for n in (0, 1, 2, 3, 7, 40, 1)]
    got = net.logits(toxicity_cnn._joined(codes, [np.zeros(len(c), np.int64) for c in codes]))
    for document, logit in zip(codes, got, strict=True):
        pooled = []
        for filters, bias in zip(net.filters, net.biases, strict=True):
            for f in range(toxicity_cnn.FILTERS):
                best = -math.inf
                for start in range(len(document) + 1):  # the last window holds nothing but the end
                    response = float(bias)
                    for j in range(len(filters)):
                        if start + j < len(document):
                            response += float(net.embeddings[document[start + j]] @ filters[j][:, f])
                    best = max(best, response)
                pooled.append(max(best, 0.0))
        assert logit == pytest.approx(float(np.array(pooled) @ net.output) + net.intercept, abs=1e-4)


WORDS = {"en": "the house and water over there", "fr": "la maison est dans les eaux", "de": "das haus und der schnee nicht"}


def plain_posteriors(rows, languages, logs):
    """(language, posterior, language by the text) of (text, declared, host, suffix), own row taken out of every count."""
    size, rows = len(languages), [(t or "", d, h or "", s or "") for t, d, h, s in rows]
    likelihoods, shares = [], []
    for text, *_ in rows:
        codes, _ = language_id.trigrams([text.encode()])
        ll = [language_id.TEMPER * sum(float(np.float32(logs[c][k])) for c in codes) for k in range(size)]
        likelihoods.append(ll)
        top = [math.exp(x - max(ll)) for x in ll]
        shares.append([x / sum(top) for x in top])
    add = lambda some: [sum(shares[i][k] for i in some) for k in range(size)]
    whole = [x + 1 for x in add(range(len(rows)))]
    base = [x / sum(whole) for x in whole]
    told = [i for i, r in enumerate(rows) if r[1]]
    out = []
    for i, (_, declared, host, suffix) in enumerate(rows):
        of_suffix = [j for j, r in enumerate(rows) if r[3] == suffix]
        of_host = [j for j in of_suffix if rows[j][2] == host]
        same = [j for j in told if rows[j][1] == declared]
        logs_of = []
        for k in range(size):
            smoothed = [add(of_suffix)[k] - shares[i][k] + language_id.PRIOR_ROWS * base[k]][0] / (len(of_suffix) - 1 + language_id.PRIOR_ROWS)
            prior = (add(of_host)[k] - shares[i][k] + language_id.PRIOR_ROWS * smoothed) / (len(of_host) - 1 + language_id.PRIOR_ROWS)
            telling = 0.0
            if declared:
                right = language_id.RIGHT_ROWS if declared == languages[k] else 0.0
                telling = math.log(max(1e-9, (add(same)[k] - shares[i][k] + right + language_id.ANY_ROWS) / (
                    add(told)[k] - shares[i][k] + language_id.RIGHT_ROWS + language_id.ANY_ROWS * (size + 1))))
            logs_of.append(likelihoods[i][k] + math.log(max(prior, 1e-12)) + telling)
        top = max(logs_of)
        out.append((languages[logs_of.index(top)], 1 / sum(math.exp(x - top) for x in logs_of), languages[likelihoods[i].index(max(likelihoods[i]))]))
    return out


def test_posteriors_equal_plain_fusion(spark):
    r = random.Random(2)
    labelled = spark.createDataFrame([(f"{text} {k}", lang) for lang, text in WORDS.items() for k in range(8)], "text string, lang string")
    made = []
    for k in range(60):
        lang = r.choice(list(WORDS))
        text = " ".join(r.sample(WORDS[lang].split(), r.randint(0, 3))) if k % 9 else None
        made.append((text, r.choice([lang, lang, "en", "xx", None]), r.choice(["a.fr", "b.de", "b.fr", None]), r.choice(["fr", "de", None])))
    rows = spark.createDataFrame([(k, t, False, *x) for k, (t, *x) in enumerate(made)], "id long, text string, markup boolean, declared string, host string, suffix string")
    languages, logs = language_id.train(labelled)
    want = plain_posteriors(made, languages, logs)
    for row in language_id.identify(rows, labelled).collect():
        lang, posterior, by_text = want[row["id"]]
        assert row["posterior"] == pytest.approx(posterior, abs=2e-4)
        assert row["lang"] == lang or posterior < 0.5
        assert row["text_lang"] == by_text or not made[row["id"]][0]
