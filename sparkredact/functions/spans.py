"""Span arrays: ``array<struct<start, end, text, label, score>>`` with UTF-8 byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,label:string,score:float>"
SPANS = f"array<{SPAN}>"
#: Items that a fold takes before it sets finished spans aside; no effect on results.
RUN = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_spans(items: Column, start: Column, step) -> Column:
    """Spans ``out`` that folding ``items`` from the struct ``start`` by ``step`` makes.

    A step may change the last span and add others. Those before are set aside after each run of items,
    as a step copies all that it holds.
    """

    def fold(items: Column) -> Column:
        runs = F.ceil(F.size(items) / RUN).cast("int")
        at = F.when(runs > 0, F.sequence(F.lit(0), runs - 1)).otherwise(F.array().cast("array<int>"))

        def run(all_: Column, i: Column) -> Column:
            def aside(acc: Column) -> Column:
                n = F.greatest(F.size(acc["out"]) - 1, F.lit(0))
                return F.struct(F.concat(all_["done"], F.slice(acc["out"], F.lit(1), n)).cast(SPANS).alias("done"), acc.withField("out", F.slice(acc["out"], n + 1, F.lit(1))).alias("acc"))

            return let(F.aggregate(F.slice(items, i * RUN + 1, F.lit(RUN)), all_["acc"], step), aside)

        return F.aggregate(at, F.struct(no_spans().alias("done"), start.alias("acc")), run, lambda a: F.concat(a["done"], a["acc"]["out"]))

    return let(items, fold).cast(SPANS)


def span(start: Column, end: Column, text: Column, label: Column | str, score: Column | float) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    score = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), label.alias("label"), score.cast("float").alias("score"))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.substring(text.cast("binary"), start + 1, end - start).cast("string")


def char_offset(text: Column, byte: Column) -> Column:
    """Characters before a byte offset."""
    return F.length(F.substring(text.cast("binary"), F.lit(1), byte).cast("string"))


def byte_offset(text: Column, char: Column) -> Column:
    """Bytes before a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), char))


def with_char_offsets(spans: Column, text: Column) -> Column:
    """Spans with ``char_start`` and ``char_end`` beside the byte offsets."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), char_offset(text, s["start"]).alias("char_start"), char_offset(text, s["end"]).alias("char_end"), s["text"].alias("text"), s["label"].alias("label"), s["score"].alias("score")))


def trim(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def pattern_spans(text: Column, pattern: str, label: str, score: float) -> Column:
    """Spans of a pattern's matches; what lies between two matches tells where the next one starts."""
    both = rf"(?s)(.*?)(?:({pattern})|\z)"
    gaps, hits = F.regexp_extract_all(text, F.lit(both), F.lit(1)), F.regexp_extract_all(text, F.lit(both), F.lit(2))
    start = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["pos"] + F.octet_length(pair["gap"])
        end = at + F.octet_length(pair["hit"])
        return F.struct(end.alias("pos"), F.when(pair["hit"] != "", F.concat(acc["out"], F.array(span(at, end, pair["hit"], label, score)))).otherwise(acc["out"]).alias("out"))

    return fold_spans(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step)
