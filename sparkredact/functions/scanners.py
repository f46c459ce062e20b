"""Text scanners: e-mail and IPv4 addresses, CJK characters, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS, let, no_spans, pattern_spans
from .vocab import IP_LABEL

# The local part starts after a delimiter; a domain has an inner dot and is taken whole, so one that
# ends in a dot is no match, however it might be shortened.
EMAIL = r"(?<![^ \t\n,;(<])[A-Za-z0-9._+\-]++@(?!\.)(?=[A-Za-z0-9\-]*+\.)[A-Za-z0-9.\-]*+(?<!\.)"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![A-Za-z0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9.])"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}]"
WORD = r"(?U)\w+(?:[-_]\w+)*|\S"
EMAIL_SCORE, IP_SCORE = 0.9, 1.0


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def email_spans(text: Column) -> Column:
    return F.when(text.contains("@"), pattern_spans(text, EMAIL, "email_address", EMAIL_SCORE)).otherwise(no_spans())


def ip_spans(text: Column) -> Column:
    return F.when(text.rlike(r"[0-9]\.[0-9]"), pattern_spans(text, IPV4, IP_LABEL, IP_SCORE)).otherwise(no_spans())


def has_cjk(text: Column) -> Column:
    return _text(text).rlike(CJK)


def words(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0))


def word_spans(text: Column) -> Column:
    """Words with byte ranges, as spans without label."""
    return F.transform(pattern_spans(_text(text), WORD, "", 0.0), lambda s: F.struct(s["text"].alias("word"), s["start"].alias("start"), s["end"].alias("end")))


def span_windows(n_words: Column, width: int) -> Column:
    """(start, end) word ranges of up to ``width`` words that fit."""

    def windows(n: Column) -> Column:
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.least(i + (width - 1), n - 1)), lambda j: F.struct(i.alias("word_start"), j.alias("word_end")))))

    return let(n_words, windows)


def add_emails(spans: Column, text: Column) -> Column:
    """Spans and the text's e-mail addresses that no span covers."""
    free = lambda e: ~F.exists(spans, lambda s: (s["start"] <= e["start"]) & (s["end"] >= e["end"]))
    return F.concat(spans, let(email_spans(text), lambda found: F.filter(found, free))).cast(SPANS)


def add_ips(spans: Column, text: Column) -> Column:
    return F.concat(spans, ip_spans(text)).cast(SPANS)
