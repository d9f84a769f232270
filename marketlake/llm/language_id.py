"""Language identification by Bayesian evidence fusion.

The posterior of a row multiplies three kinds of evidence: the likelihood of its text under hashed byte trigrams of each
language, the probability that a page of each language declares the markup language it declares, and the prior of its host.
Host priors are smoothed hierarchically, host towards address suffix towards the whole corpus; they and the reliability of
declarations are grouped sums of text posteriors over all rows, from which a row's own share is taken out again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import list_column, per_batch, small_batches, stored, texts_of

#: Documents of each language that the trigrams are learnt from, about: the share of the hash range that holds so many.
SAMPLE_ROWS = 300
#: Tasks that count the trigrams of that sample, which is of bounded size however large the corpus.
SAMPLE_TASKS = 4
#: Buckets of the hashed trigrams.
BUCKETS = 1 << 15
#: Trigrams overlap and repeat: their log likelihood counts by this factor.
TEMPER = 0.15
#: Pseudo-counts: rows of the level above, declarations that are right, declarations of any kind.
PRIOR_ROWS = 20.0
RIGHT_ROWS = 10.0
ANY_ROWS = 0.5

_MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


def visible(html: bytes) -> bytes:
    """Text of a page without markup, scripts and comments."""
    return _MARKUP.sub(b" ", html)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the texts (A-Z lower-cased, other ASCII as space), and how many each text has."""
    clean = [b" ".join((b" " + t.translate(_LOWER) + b" ").split(b" ")) for t in texts]
    clean = [re.sub(rb" +", b" ", t) for t in clean]
    sizes = np.array([max(0, len(t) - 2) for t in clean])
    whole = np.frombuffer(b"".join(clean) + b"  ", np.uint8).astype(np.uint32)
    codes = (whole[:-2] << np.uint32(16) | whole[1:-1] << np.uint32(8) | whole[2:]) * np.uint32(2654435761) >> np.uint32(17)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in clean])[:-1]]).astype(np.int64)
    keep = np.ones(len(codes), bool)
    for s, n, t in zip(starts, sizes, clean, strict=True):
        keep[s + n : s + len(t)] = False
    return codes[keep[: len(codes)]].astype(np.int64) & (BUCKETS - 1), sizes


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every bucket in each, from a bounded sample of ``(text, lang)``.

    In each language the texts of least hash are taken, repeated ones once; the distinct texts of a language tell where
    its hashes end, so nothing is sorted. Without a labelled row there is one language, ``und``.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where("lang is not null and text is not null").select("text", "lang")
    texts = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    rows = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    languages = sorted(rows)
    if not languages:
        return ["und"], np.zeros((BUCKETS, 1))
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    ends = [int(-(2**63) + min(1.0, SAMPLE_ROWS / rows[x]) * (2**64 - 2049)) for x in languages]
    hashed = known.select("text", number.cast("long").alias("k"), F.xxhash64("text").alias("h"))
    parts = hashed.where(F.col("h") <= F.element_at(F.array(*map(F.lit, ends)), (F.col("k") + 1).cast("int"))).groupBy("k", "h").agg(
        F.any_value("text").alias("text")).coalesce(SAMPLE_TASKS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [k * BUCKETS + trigrams([t])[0] for k, t in zip(batch.column("k").to_pylist(), texts_of(batch.column("text")), strict=True)]
        own, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.record_batch({"bucket": pa.array(own), "n": pa.array(n)})

    counted = parts.select("text", "k").mapInArrow(per_batch(work), "bucket long, n long")
    counts = np.full(len(languages) * BUCKETS, 0.2)
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most a row a bucket and language
    counts[np.array(got.column("bucket"))] += np.array(got.column("n"))
    counts = counts.reshape(len(languages), BUCKETS)
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy()


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` without ``text``, with ``lang``, ``posterior`` and ``text_lang`` (by the text alone).

    ``rows`` has ``text`` (``markup``: whether tags are to be left out), ``declared``, ``host`` and ``suffix``; any of them
    may be null, which is no evidence (hosts and suffixes: an unnamed one). Texts are read whole; null and empty ones have
    equal likelihoods. Of equal posteriors the first language in alphabetical order is taken. Repeated rows are labelled
    alike; an empty table gives no rows. ``labelled`` has ``text`` and ``lang``.
    """
    spark = rows.sparkSession
    languages, logs = train(labelled)
    size = len(languages)
    table = spark.sparkContext.broadcast(logs.astype(np.float32))
    ids = [c for c in rows.columns if c not in ("text", "markup", "declared", "host", "suffix")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [visible(t) if m else t for t, m in zip(texts_of(batch.column("text")), batch.column("markup").to_pylist(), strict=True)]
        likelihoods = np.zeros((len(texts), size))
        k = 0
        while k < len(texts):  # some texts at a time, so that a batch of long ones stays small
            end, held = k + 1, len(texts[k])
            while end < len(texts) and held + len(texts[end]) < 2_000_000:
                held += len(texts[end])
                end += 1
            codes, sizes = trigrams(texts[k:end])
            filled = np.flatnonzero(sizes)
            if len(filled):
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
                likelihoods[k + filled] = np.add.reduceat(table.value[codes], starts, axis=0)
            k = end
        likelihoods *= TEMPER
        shares = np.exp(likelihoods - likelihoods.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        lists = {c: list_column(x.ravel(), [size] * len(texts), pa.float64()) for c, x in (("__ll", likelihoods), ("__p", shares))}
        return pa.record_batch({**{c: batch.column(c) for c in (*ids, "declared", "host", "suffix")}, **lists})

    small_batches(spark)
    named = rows.select(
        *ids, "text", F.coalesce("markup", F.lit(False)).alias("markup"), F.lower(F.regexp_extract(F.trim("declared"), "^[A-Za-z]+", 0)).alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name not in ("text", "markup"))
    evidence = stored(named.mapInArrow(per_batch(work), f"{kinds}, __ll array<double>, __p array<double>"), "evidence")

    def sums(name: str) -> Column:
        return F.array(*(F.sum(F.col("__p")[k]) for k in range(size))).alias(name)

    everywhere = evidence.agg(sums("x")).first()["x"]
    base = np.array([x or 0 for x in everywhere]) + 1
    base = (base / base.sum()).tolist()
    telling = F.col("declared").isNotNull() & (F.col("declared") != "")
    declared = evidence.where(telling).groupBy("declared").agg(sums("__declared"))
    told = [x or 0.0 for x in evidence.where(telling).agg(sums("x")).first()["x"]]
    joined = evidence.join(evidence.groupBy("suffix").agg(sums("__suffix")), "suffix")
    joined = joined.join(evidence.groupBy("suffix", "host").agg(sums("__host")), ["suffix", "host"]).join(declared, "declared", "left")

    def each(make) -> Column:
        return F.array(*(make(k) for k in range(size)))

    own = lambda k: F.col("__p")[k]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("__s", (total("__suffix") - 1 + PRIOR_ROWS)).withColumn("__h", (total("__host") - 1 + PRIOR_ROWS))
    joined = joined.withColumn("__of_suffix", each(lambda k: (F.col("__suffix")[k] - own(k) + PRIOR_ROWS * base[k]) / F.col("__s")))
    joined = joined.withColumn("__of_host", each(
        lambda k: (F.col("__host")[k] - own(k) + PRIOR_ROWS * F.col("__of_suffix")[k]) / F.col("__h")))

    def declares(k: int) -> Column:
        right = F.when(F.col("declared") == languages[k], RIGHT_ROWS).otherwise(0.0)
        share = (F.col("__declared")[k] - own(k) + right + ANY_ROWS) / (told[k] - own(k) + RIGHT_ROWS + ANY_ROWS * (size + 1))
        return F.when(F.col("__declared").isNotNull(), F.log(F.greatest(share, F.lit(1e-9)))).otherwise(0.0)

    joined = joined.withColumn("__log", each(
        lambda k: F.col("__ll")[k] + F.log(F.greatest(F.col("__of_host")[k], F.lit(1e-12))) + declares(k)))
    names = F.array(*map(F.lit, languages))
    most = F.array_max("__log")
    at = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select(
        *ids, at(F.col("__log")).alias("lang"),
        (1 / total(F.transform("__log", lambda x: F.exp(x - most)))).alias("posterior"), at(F.col("__ll")).alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence columns of ``pages(page_id, url, html)``."""
    host = F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"),
        F.lit(True).alias("markup"), F.regexp_extract("html", "(?i)<html[^>]*?\\slang\\s*=\\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"),
        host.alias("host"), F.regexp_extract(host, "\\.([a-z0-9-]+)$", 1).alias("suffix"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence columns of ``documents``: the source is the host, nothing is declared."""
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text",
        F.lit(False).alias("markup"), F.lit(None).cast("string").alias("declared"), F.col("source").cast("string").alias("host"),
        F.lit(None).cast("string").alias("suffix"))
