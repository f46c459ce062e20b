"""Model backends: where candidate spans come from when a model is at hand. None is bundled."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scanners import has_cjk, words
from ..functions.spans import SPANS

CANDIDATES = "_candidates"


class NerBackend(Protocol):
    """Loaded once a Python worker; gets texts and labels, gives spans as dicts with byte offsets."""

    def load(self) -> None: ...

    def predict(self, texts: Sequence[str], labels: Sequence[str]) -> list[list[dict]]: ...


def choose_layout(files: Sequence[str]) -> tuple[str, int]:
    """Which model layout a folder's files make up, and its widest span in words."""
    have = {os.path.basename(f) for f in files}
    parts = {"encoder.onnx", "span_rep.onnx", "count_embed.onnx", "count_pred.onnx", "classifier.onnx"}
    if parts <= have:
        return "full", 8
    if {"encoder.onnx", "scorer.onnx"} <= have:
        return "compat", 8
    if {"model_int8.onnx", "model.onnx"} & have:
        return ("single-int8" if "model_int8.onnx" in have else "single"), 12
    raise FileNotFoundError("no model layout is complete")


def prompt(text: Column, labels: Column, layout: str, name: str = "entities", boost: Column | None = None) -> Column:
    """The words a layout's encoder gets: labels with their marks, then the text's words."""
    marked = lambda mark: F.array_join(F.transform(labels, lambda x: F.concat(F.lit(mark + " "), x)), " ")
    own = F.array_join(words(text), " ")
    if layout == "full":
        told = F.lit("") if boost is None else F.array_join(F.transform(boost, lambda d: F.concat(F.lit(" [DESCRIPTION] "), d["label"], F.lit(": "), d["description"])), "")
        return F.concat(F.lit(f"( [P] {name}"), told, F.lit(" ( "), marked("[E]"), F.lit(" ) ) [SEP_TEXT] "), F.lower(own))
    if layout == "compat":
        return F.concat(marked("[E]"), F.lit(" [SEP] "), F.lower(own))
    return F.concat(marked("<<ENT>>"), F.lit(" <<SEP>> "), own)


def with_candidates(df: DataFrame, backend: NerBackend, labels: Sequence[str], text_col: str = "text", second: NerBackend | None = None) -> DataFrame:
    """``df`` with the backend's spans in ``_candidates``; ``second`` adds its own for texts with CJK characters only.

    The second model sees a filtered frame, as a Python function under a condition would run on all rows.
    """

    def apply(frame: DataFrame, model: NerBackend, names: Sequence[str], out: str) -> DataFrame:
        schema = T.StructType([*frame.schema.fields, T.StructField(out, T._parse_datatype_string(SPANS))])

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model.load()
            for b in batches:
                yield b.assign(**{out: model.predict(b[text_col].fillna("").tolist(), list(names))})

        return frame.mapInPandas(predict, schema)

    first = apply(df, backend, labels, CANDIDATES)
    if second is None:
        return first
    more = apply(first.filter(has_cjk(F.col(text_col))), second, labels, "_more")
    more = more.withColumn(CANDIDATES, F.concat(CANDIDATES, "_more")).drop("_more")
    return first.filter(~has_cjk(F.col(text_col))).unionByName(more)
