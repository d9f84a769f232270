"""The training sample of a language whose rows are mostly copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketlake.llm import language_id


def test_copies_do_not_empty_a_language(spark):
    texts = spark.range(40).select(F.concat(F.lit("un texte "), "id").alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.where(F.col("h") > 0).limit(5).select("text", F.lit("fr").alias("lang"))  # above the range of a tenth
    copies = texts.crossJoin(spark.range(600)).select("text", "lang")
    languages, logs = language_id.train(copies)
    assert languages == ["fr"] and np.unique(logs).size > 1  # not uniform
