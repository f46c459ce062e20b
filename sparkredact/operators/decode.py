"""From model outputs to spans: scores, greedy selection, BIO tags, classes, structures, relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import RUN, SPANS, byte_slice, fold_spans, let, no_spans, span

CANDIDATE_FLOOR = 0.01
MULTI_LABEL_FLOOR = 0.5
RAW_FLOOR = 0.08
MAX_INSTANCES = 20


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def span_score(span_rep: Column, label_proj: Column) -> Column:
    return sigmoid(dot(span_rep, label_proj))


def softmax(x: Column) -> Column:
    return let(F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double"))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(e, lambda v: v / t)))


def classify(logits: Column, labels: Column) -> Column:
    """(label, score) of every label by softmax, best first."""
    scored = F.transform(F.arrays_zip(labels.alias("label"), softmax(logits).alias("score")), lambda z, i: F.struct((-z["score"]).alias("k"), i.alias("i"), z["label"].alias("label"), z["score"].alias("score")))
    return F.transform(F.array_sort(scored), lambda z: F.struct(z["label"].alias("label"), z["score"].alias("score")))


def classify_multi(logits: Column, labels: Column, floor: float = MULTI_LABEL_FLOOR) -> Column:
    """(label, score) of the labels above the floor by sigmoid, in the order given."""
    scored = F.transform(F.arrays_zip(labels.alias("label"), logits.alias("x")), lambda z: F.struct(z["label"].alias("label"), sigmoid(z["x"].cast("double")).alias("score")))
    return F.filter(scored, lambda z: z["score"] > floor)


def greedy_select(candidates: Column, words: Column, labels: Column, text: Column, floor: float = CANDIDATE_FLOOR) -> Column:
    """Best-scored candidates (word_start, word_end, class_idx, score) that share no word, in text order.

    A candidate of an unknown class blocks others and is dropped at the end.
    """
    usable = F.filter(candidates, lambda c: c["score"] > F.lit(floor).cast("float"))
    ranked = F.array_sort(F.transform(usable, lambda c, i: F.struct((-c["score"]).alias("k"), c["word_start"].alias("a"), c["word_end"].alias("b"), c["class_idx"].alias("c"), i.alias("i"), c["score"].alias("score"))))
    def select(ranked: Column) -> Column:
        none = F.slice(ranked, 1, 0)
        n_words = F.coalesce(F.array_max(F.transform(ranked, lambda c: c["b"])) + 1, F.lit(0))
        start = F.struct(F.repeat(F.lit("."), n_words).cast("binary").alias("taken"), none.alias("kept"))
        runs = F.ceil(F.size(ranked) / RUN).cast("int")
        at = F.when(runs > 0, F.sequence(F.lit(0), runs - 1)).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, c: Column) -> Column:
            width = c["b"] - c["a"] + 1
            free = ~F.substring(acc["taken"], c["a"] + 1, width).cast("string").contains("x")
            taken = F.overlay(acc["taken"], F.repeat(F.lit("x"), width).cast("binary"), c["a"] + 1, width)
            return F.when(free, F.struct(taken.alias("taken"), F.concat(acc["kept"], F.array(c)).alias("kept"))).otherwise(acc)

        def run(acc: Column, i: Column) -> Column:
            got = F.aggregate(F.slice(ranked, i * RUN + 1, F.lit(RUN)), F.struct(acc["taken"].alias("taken"), none.alias("kept")), step)
            return let(got, lambda g: F.struct(g["taken"].alias("taken"), F.concat(acc["kept"], g["kept"]).alias("kept")))

        return F.aggregate(at, start, run, lambda a: a["kept"])

    kept = let(ranked, select)  # a byte for each word tells whether it is taken, so a candidate isn't compared with all kept ones
    in_order = F.array_sort(F.transform(kept, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["c"].alias("c"), c["score"].alias("score"))))
    known = F.filter(in_order, lambda c: c["c"] < F.size(labels))

    def spans(both: Column) -> Column:
        def one(c: Column) -> Column:
            start, end = F.element_at(both["words"], c["a"] + 1)["start"], F.element_at(both["words"], c["b"] + 1)["end"]
            return span(start, end, byte_slice(both["text"], start, end), F.element_at(labels, c["c"] + 1), c["score"])

        return F.transform(known, one)

    return let(F.struct(words.alias("words"), text.alias("text")), spans).cast(SPANS)


def bio_decode(tokens: Column, text: Column, floor: float = RAW_FLOOR) -> Column:
    """Spans of tagged tokens (start, end, tag, prob, special).

    ``I-x`` right after an accepted token of label x extends its span; any other accepted tag opens one;
    ``O`` and unsure tokens close it. Special tokens are passed over.
    """
    floor_ = F.lit(floor).cast("float")
    plain = F.filter(tokens, lambda t: ~t["special"])
    start = F.struct(no_spans().alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        label = F.regexp_replace(t["tag"], r"\A[BI]-", "")
        last = F.try_element_at(acc["out"], F.lit(-1))
        extends = acc["open"] & t["tag"].startswith("I-") & (last["label"] == label)
        fresh = span(t["start"], t["end"], byte_slice(text, t["start"], t["end"]), label, t["prob"])
        grown = span(last["start"], t["end"], byte_slice(text, last["start"], t["end"]), label, F.greatest(last["score"], t["prob"].cast("float")))
        out = F.when(extends, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(grown))).otherwise(F.concat(acc["out"], F.array(fresh)))
        off = (t["tag"] == "O") | (t["prob"] < floor_)
        return F.when(off, F.struct(acc["out"].alias("out"), F.lit(False).alias("open"))).otherwise(F.struct(out.cast(SPANS).alias("out"), F.lit(True).alias("open")))

    return fold_spans(plain, start, step)


def instance_count(logits: Column) -> Column:
    """Number of instances from the count logits: the last largest, between 1 and 20."""
    last = F.size(logits) - F.array_position(F.reverse(logits), F.array_max(logits)).cast("int")
    return F.least(F.lit(MAX_INSTANCES), F.greatest(F.lit(1), last))


def best_per_field(candidates: Column, floor: float) -> Column:
    """Per instance, the first best span of each field at or above the floor, as map field -> [span].

    ``candidates``: (instance, field, start, end, text, score). Instances without a field are left out.
    """
    floor_ = F.lit(floor).cast("float")
    usable = F.filter(candidates, lambda c: c["score"] >= floor_)
    fields = lambda rows: F.array_distinct(F.transform(rows, lambda c: c["field"]))

    def best(rows: Column, name: Column) -> Column:
        ranked = F.array_sort(F.transform(F.filter(rows, lambda c: c["field"] == name), lambda c, i: F.struct((-c["score"]).alias("k"), i.alias("i"), c.alias("c"))))
        c = F.element_at(ranked, 1)["c"]
        return F.struct(name.alias("key"), F.array(span(c["start"], c["end"], c["text"], c["field"], c["score"])).alias("value"))

    def instance(i: Column) -> Column:
        return let(F.filter(usable, lambda c: c["instance"] == i), lambda rows: F.map_from_entries(F.transform(fields(rows), lambda f: best(rows, f))))

    return F.transform(F.array_sort(F.array_distinct(F.transform(usable, lambda c: c["instance"]))), instance)


def relations(instances: Column, name: str) -> Column:
    """(relation, head, tail, score) of the instances with a head and a tail; the score is their mean."""
    pair = lambda m: F.struct(F.lit(name).alias("relation"), m["head"][0].alias("head"), m["tail"][0].alias("tail"), ((m["head"][0]["score"] + m["tail"][0]["score"]) / 2).alias("score"))
    return F.transform(F.filter(instances, lambda m: F.map_contains_key(m, "head") & F.map_contains_key(m, "tail")), pair)
