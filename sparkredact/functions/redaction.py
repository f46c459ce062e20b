"""Rewriting of texts by their spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import byte_slice
from .vocab import IP_LABEL

AUTO_REDACT = 0.6

# --- fixed values: results depend on them -----------------------------------------------------------
ROLE_TYPES = {
    "admin": [],
    "analyst": ["government_id", "bank_account_number", "date_of_birth"],
    "support_lead": ["government_id", "bank_account_number"],
    "auditor": [],
}
OTHER_ROLE_TYPES = ["person_name", "government_id", "phone_number", "email_address", "bank_account_number", "date_of_birth"]
PDPA_TYPES = ["person_name", "government_id", "phone_number", "email_address", "street_address", "date_of_birth"]
SG_ID = r"\A[STFGM][0-9]{7}[A-Z]\z"
PSEUDONYMS = {"date_of_birth": "[DOB_REDACTED]", "government_id": "[ID_REDACTED]"}
BLOCK = "███"


def needs_review(score: Column, auto_redact: float = AUTO_REDACT) -> Column:
    return score < F.lit(auto_redact).cast("float")


def as_output(spans: Column, auto_redact: float = AUTO_REDACT) -> Column:
    """Spans with the names of the output format and the review flag."""
    return F.transform(spans, lambda s: F.struct(s["label"].alias("type"), s["text"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), needs_review(s["score"], auto_redact).alias("needs_review")))


def label_text(s: Column) -> Column:
    return F.concat(F.lit("["), F.upper(s["label"]), F.lit("]"))


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "label": label_text,
    "hash": lambda s: F.concat(F.lit("["), F.upper(s["label"]), F.lit("_"), F.left(F.sha2(s["text"], 256), F.lit(8)), F.lit("]")),
    "consistent": lambda s: F.concat(F.lit("ENTITY_"), F.left(F.sha2(s["text"], 256), F.lit(6))),
    "asterisk": lambda s: F.repeat(F.lit("*"), F.length(s["text"])),
    "block": lambda s: F.lit(BLOCK),
}


def rewrite(text: Column, spans: Column, put: Callable[[Column], Column] = label_text) -> Column:
    """The text with each span replaced, left to right; spans that overlap one before or run past the end are left."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))
    size = F.octet_length(text)

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        fits = (s["start"] >= acc["pos"]) & (s["end"] <= size)
        out = F.concat(acc["out"], byte_slice(text, acc["pos"], s["start"]), put(s))
        return F.when(fits, F.struct(s["end"].alias("pos"), out.alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(keyed), start, step, lambda a: F.concat(a["out"], byte_slice(text, a["pos"], size)))


def redact(text: Column, spans: Column, *, redact_all: bool = False, strategy: str = "label", auto_redact: float = AUTO_REDACT) -> Column:
    """Spans that need no review replaced, or all."""
    chosen = spans if redact_all else F.filter(spans, lambda s: ~needs_review(s["score"], auto_redact))
    return rewrite(text, chosen, STRATEGIES[strategy])


def redact_for_role(text: Column, spans: Column, role: Column) -> Column:
    """What a viewer's role may not see, replaced."""
    types = F.create_map(*[x for r, t in ROLE_TYPES.items() for x in (F.lit(r), F.array(*map(F.lit, t)).cast("array<string>"))])
    hidden = F.coalesce(F.try_element_at(types, role), F.array(*map(F.lit, OTHER_ROLE_TYPES)))
    return rewrite(text, F.filter(spans, lambda s: F.array_contains(hidden, s["label"])))


def pseudonymise(text: Column, spans: Column) -> Column:
    """Names by number, counted from the last to appear; dates of birth and ids by fixed tokens."""
    names = F.filter(spans, lambda s: s["label"] == "person_name")
    last_first = F.reverse(F.array_sort(F.transform(names, lambda s: F.struct(s["start"].alias("a"), s["text"].alias("t")))))
    order = F.array_distinct(F.transform(last_first, lambda x: x["t"]))

    def put(s: Column) -> Column:
        number = F.lpad(F.array_position(order, s["text"]).cast("string"), 3, "0")
        return F.when(s["label"] == "person_name", F.concat(F.lit("PATIENT_"), number)).when(s["label"] == "date_of_birth", PSEUDONYMS["date_of_birth"]).when(s["label"] == "government_id", PSEUDONYMS["government_id"]).otherwise(label_text(s))

    return rewrite(text, spans, put)


def regulation_tags(spans: Column) -> Column:
    """Spans with the rules they fall under, and whether an id has the Singapore form."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["label"].alias("type"), s["text"].alias("value"), F.lit(True).alias("gdpr_relevant"), s["label"].isin(PDPA_TYPES).alias("pdpa_relevant"),
            ((s["label"] != "government_id") | s["text"].rlike(SG_ID)).alias("sg_form"), (s["label"] == IP_LABEL).alias("technical"),
        ),
    )
