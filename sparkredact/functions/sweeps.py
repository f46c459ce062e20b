"""Sequential sweeps over the spans of a text: overlaps and neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS, byte_slice, fold_spans, let, no_spans, span

REPLACE_FACTOR = 1.3
MERGE_GAP = 2


def in_order(spans: Column) -> Column:
    """By start, longest first, best score first; otherwise in the order given."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _replace_last(kept: Column, s: Column) -> Column:
    return F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))


def dedup(spans: Column) -> Column:
    """Each span against the last kept: an overlapping one replaces it if it is longer with the same label, or clearly better with another; else it goes."""
    factor = F.lit(REPLACE_FACTOR).cast("float")

    def step(kept: Column, s: Column) -> Column:
        def against(last: Column) -> Column:
            longer = (s["label"] == last["label"]) & (s["end"] - s["start"] > last["end"] - last["start"])
            better = (s["label"] != last["label"]) & (s["score"] > (last["score"] * factor).cast("float"))
            return F.when(last.isNull() | (s["start"] >= last["end"]), F.concat(kept, F.array(s))).when(longer | better, _replace_last(kept, s)).otherwise(kept)

        return let(F.try_element_at(kept, F.lit(-1)), against)

    return F.aggregate(in_order(spans), no_spans(), step)


def merge_adjacent(spans: Column, text: Column) -> Column:
    """Neighbours with the same label and a gap of at most two bytes become one span, gap included."""

    def step(acc: Column, s: Column) -> Column:
        def against(last: Column) -> Column:
            gap = s["start"] - last["end"]
            joined = span(last["start"], s["end"], F.concat(last["text"], byte_slice(text, last["end"], s["start"]), s["text"]), last["label"], F.greatest(last["score"], s["score"]))
            near = last.isNotNull() & (s["label"] == last["label"]) & gap.between(0, MERGE_GAP)
            return F.struct(F.when(near, _replace_last(acc["out"], joined)).otherwise(F.concat(acc["out"], F.array(s))).cast(SPANS).alias("out"))

        return let(F.try_element_at(acc["out"], F.lit(-1)), against)

    return fold_spans(spans, F.struct(no_spans().alias("out")), step)
