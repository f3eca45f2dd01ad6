"""Slots for models that are not part of this package: detectors, segmenters, feature extractors.

A model is a function made once a task; it gets a batch and returns one result a row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A factory of a batch function, as in `lambda: load(path).predict`.
Factory = Callable[[], Callable[[list], list]]


def features(images: DataFrame, model: Factory, column: str = "data") -> DataFrame:
    """img_id, features of every image; a null result becomes a null row."""
    kind = images.schema["img_id"].dataType.simpleString()

    def run(batches):
        predict = model()
        for pdf in batches:
            yield pd.DataFrame({"img_id": pdf["img_id"], "features": [None if v is None else [float(x) for x in v] for v in predict(list(pdf[column]))]})

    return images.select("img_id", column).mapInPandas(run, f"img_id {kind}, features array<double>")


def masks(images: DataFrame, model: Factory, column: str = "data") -> DataFrame:
    """img_id, mask, ok, reason: a failed image is a row too, so that it can be noted and left out next time."""
    kind = images.schema["img_id"].dataType.simpleString()

    def run(batches):
        predict = model()
        for pdf in batches:
            rows = []
            for img_id, data in zip(pdf["img_id"], pdf[column], strict=True):
                try:
                    m = predict([data])[0]
                    rows.append((img_id, m, m is not None, None if m is not None else "no detection"))
                except Exception as e:
                    rows.append((img_id, None, False, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["img_id", "mask", "ok", "reason"])

    return images.select("img_id", column).mapInPandas(run, f"img_id {kind}, mask binary, ok boolean, reason string")


def classified(images: DataFrame, model: Factory, names: list[str], column: str = "data") -> DataFrame:
    """img_id, label, probability of a classifier that returns class scores."""
    scored = features(images, model, column)
    top = F.array_max("features")
    return scored.select("img_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("features", top).cast("int")).alias("label"), top.alias("probability"))
