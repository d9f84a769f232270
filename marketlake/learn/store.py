"""Fitted models kept beside each other: pipeline, parameters, metrics and searched points, fitted once and then loaded."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from marketlake.learn.models import Fitted, load, save
from marketlake.sources.files import exists, file_system

_SCHEMA = "name string, numeric array<string>, categorical array<string>, params string, metrics string, searched string"


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def place(root: str, name: str) -> str:
    """Folder of the named model."""
    return f"{root}/{slug(name)}"


def put(spark: SparkSession, root: str, fitted: Fitted) -> str:
    """Write the model and what is known of it below ``root``. The folder appears whole, by one renaming; of two writers the first holds."""
    target, staging = place(root, fitted.name), f"{root}/_staging-{uuid.uuid4().hex}"
    save(fitted, f"{staging}/pipeline")
    row = (fitted.name, fitted.numeric, fitted.categorical, *(json.dumps(x) for x in (fitted.params, fitted.metrics, fitted.searched)))
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.json(f"{staging}/known")
    fs, source = file_system(spark, staging)
    _, wanted = file_system(spark, target)
    if fs.exists(wanted) or not fs.rename(source, wanted):
        fs.delete(source, True)
    return f"{target}/pipeline"


def get(spark: SparkSession, root: str, name: str) -> Fitted | None:
    """The named model, or nothing if it is not there."""
    target = place(root, name)
    if not exists(spark, f"{target}/known"):
        return None
    known = spark.read.schema(_SCHEMA).json(f"{target}/known").first()
    return Fitted(
        known["name"], load(f"{target}/pipeline"), known["numeric"], known["categorical"], json.loads(known["params"]),
        json.loads(known["metrics"]), [(p, e) for p, e in json.loads(known["searched"])])


def fitted_once(spark: SparkSession, root: str, names: list[str], build: Callable[[list[str]], list[Fitted]]) -> list[Fitted]:
    """The named models: those kept below ``root`` are loaded, ``build`` fits the others, which are then kept too."""
    found = {name: get(spark, root, name) for name in names}
    if missing := [name for name, model in found.items() if model is None]:
        for model in build(missing):
            put(spark, root, model)
            found[model.name] = model
    return [found[name] for name in names]
