"""Filters and rewrites of spans: reclassify, validate, vocabulary filter, normalise, e-mail growth, thresholds."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scanners import email_spans
from .spans import SPANS, byte_offset, char_offset, let, span, trim
from .vocab import CANONICAL, CLEAN_CHARS, CONTEXT_WORDS, META_WORDS, PHONE_MARKER_LABEL, PHONE_MARKERS, STRIP_CHARS

STRIP_ROUNDS = 5
EMAIL_FLOOR, MARKER_FLOOR = 0.8, 0.35


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def reclassify(spans: Column) -> Column:
    """Spans with a phone marker and 7 to 12 digits become contact numbers."""
    phone = lambda s: s["text"].rlike("|".join(PHONE_MARKERS)) & digit_count(s["text"]).between(7, 12)
    as_phone = lambda s: span(s["start"], s["end"], s["text"], PHONE_MARKER_LABEL, F.greatest(s["score"], F.lit(MARKER_FLOOR).cast("float")))
    return F.transform(spans, lambda s: F.when(phone(s), as_phone(s)).otherwise(s)).cast(SPANS)


def is_valid(label: Column, text: Column) -> Column:
    """Format rule of the label; labels without one, aliases among them, pass."""

    def rule(t: Column) -> Column:
        size, digits = F.octet_length(t), digit_count(t)
        return (
            F.when(label == "government_id", t.rlike(r"\A[A-Za-z0-9 -]{6,20}\z") & (digits > 0))
            .when(label == "phone_number", digits.between(7, 15) & t.rlike(r"\A[0-9 +()-]*\z"))
            .when(label == "email_address", t.contains("@") & t.contains("."))
            .when(label == "passport_number", size.between(6, 12) & t.rlike("[A-Za-z]") & (digits > 0))
            .when(label == "license_plate", size.between(3, 15) & t.rlike("[A-Za-z0-9]"))
            .when(label == "bank_account_number", digits.between(8, 20) & t.rlike(r"\A[0-9 -]*\z"))
            .when(label == "date_of_birth", digits >= 4)
            .otherwise(True)
        )

    return let(trim(text), rule)


def validate(spans: Column) -> Column:
    return F.filter(spans, lambda s: is_valid(s["label"], s["text"]))


def is_meta(text: Column) -> Column:
    """Empty, or a word of the label and context vocabulary."""
    ends = "[" + r"\p{IsWhite_Space}" + "".join("\\" + c if c in "[]{}()" else c for c in CLEAN_CHARS) + "]+"
    clean = F.regexp_replace(F.lower(trim(text)), rf"\A{ends}|{ends}\z", "")
    return (trim(text) == "") | clean.isin(META_WORDS)


def drop_meta(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~is_meta(s["text"]))


def canonical(label: Column) -> Column:
    """The label that a label or alias stands for; others stay."""
    return F.coalesce(F.try_element_at(literal_map(CANONICAL), F.lower(label)), label)


_WORDS = "|".join(re.escape(w) for w in CONTEXT_WORDS)
PREFIX = rf"(?si)\A(?:{_WORDS})(?![A-Za-z0-9_])[{STRIP_CHARS}]*+(?=.)"
SUFFIX = rf"(?si)(?<=[^{STRIP_CHARS}])[{STRIP_CHARS}]*(?<![A-Za-z0-9_])(?:{_WORDS})\z"


def strip_prefix(text: Column) -> Column:
    for _ in range(STRIP_ROUNDS):
        text = F.regexp_replace(text, PREFIX, "")
    return text


def strip_suffix(text: Column) -> Column:
    for _ in range(STRIP_ROUNDS):
        text = F.regexp_replace(text, SUFFIX, "")
    return text


def normalise(spans: Column) -> Column:
    """Canonical labels, without context words at the ends; offsets follow."""

    def one(s: Column) -> Column:
        def cut(front: Column) -> Column:
            start = s["start"] + F.octet_length(s["text"]) - F.octet_length(front)
            return let(strip_suffix(front), lambda both: span(start, s["end"] - (F.octet_length(front) - F.octet_length(both)), both, canonical(s["label"]), s["score"]))

        return let(strip_prefix(s["text"]), cut)

    return F.transform(spans, one).cast(SPANS)


def expand_emails(spans: Column, text: Column) -> Column:
    """Spans inside the address at the next ``@`` grow to that address."""

    def grow(found: Column) -> Column:
        def one(s: Column) -> Column:
            def at(pos: Column) -> Column:
                here = F.filter(found, lambda e: (pos > 0) & (e["start"] + F.octet_length(F.substring_index(e["text"], "@", 1)) == byte_offset(text, pos - 1)) & (e["start"] <= s["start"]) & (e["end"] >= s["end"]))
                return let(F.try_element_at(here, F.lit(1)), lambda e: F.when(e.isNotNull(), span(e["start"], e["end"], e["text"], "email_address", F.greatest(s["score"], F.lit(EMAIL_FLOOR).cast("float")))).otherwise(s))

            return let(F.call_function("locate", F.lit("@"), text, char_offset(text, s["start"]) + 1), at)

        return F.when(F.size(found) > 0, F.transform(spans, one)).otherwise(spans)

    return let(email_spans(text), grow).cast(SPANS)


def above_threshold(spans: Column, review: float, by_label: Mapping[str, float]) -> Column:
    review_ = F.lit(float(review)).cast("float")
    least = (lambda s: F.coalesce(F.try_element_at(literal_map(dict(by_label)), s["label"]).cast("float"), review_)) if by_label else (lambda s: review_)
    return F.filter(spans, lambda s: s["score"] >= least(s))
