"""Corpus reports and recipes on top of detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .pipeline import Config, detect, detect_spans

CHUNK_CHARS = 10_000
SENTENCE_CHARS, OVERLAP_WORDS = 1_500, 40
SAMPLE_ENTITIES = 5
LOG_BATCH, LOG_LEAST, CHAT_BATCH, MESSAGE_LEAST = 50, 20, 20, 10
SAMPLE_ROWS, SAMPLE_CHECKED, SAMPLE_LEAST = 100, 50, 3
PII_RATIO, POSSIBLE_RATIO = 0.3, 0.1
#: Fixed format of an exported chat line, which only a newline ends.
WHATSAPP = r"(?d)\A\[([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}),\s*([0-9]{1,2}:[0-9]{2}:[0-9]{2}\s*[AP]M)\]\s*([^:]+):\s*(.*)"


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """(chunk, text) of fixed length."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("chunk"), F.substring(text, i * size + 1, F.lit(size)).alias("text")))


def sentence_chunks(text: Column, size: int = SENTENCE_CHARS, overlap: int = OVERLAP_WORDS) -> Column:
    """Sentences packed to about ``size`` characters; a chunk starts with the last words of the one before, if that has more."""
    sentences = F.split(F.regexp_replace(text, "\n", " "), r"\. ")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(s) > size) & (acc["now"] != "")
        own = F.filter(F.split(acc["now"], r"\s+"), lambda w: w != "")
        tail = F.when(F.size(own) > overlap, F.array_join(F.slice(own, -overlap, overlap), " ")).otherwise("")
        return F.struct(F.when(full, F.concat(acc["out"], F.array(F.trim(acc["now"])))).otherwise(acc["out"]).alias("out"), F.when(full, F.concat(tail, F.lit(" "), s, F.lit(". "))).otherwise(F.concat(acc["now"], s, F.lit(". "))).alias("now"))

    return F.aggregate(sentences, start, step, lambda a: F.when(F.trim(a["now"]) != "", F.concat(a["out"], F.array(F.trim(a["now"])))).otherwise(a["out"]))


def batches(df: DataFrame, by: Sequence[str], order: Sequence[str], text_col: str, size: int, least: int = 0, drop_partial: bool = False) -> DataFrame:
    """Texts of at least ``least`` characters joined ``size`` at a time, in order within ``by``."""
    rows = df.filter(F.length(F.trim(text_col)) >= least) if least else df
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    rows = rows.select(*by, F.floor(n / size).alias("batch"), n.alias("n"), F.col(text_col).alias("text"))
    out = rows.groupBy(*by, "batch").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return out.filter(F.col("lines") == size) if drop_partial else out


def entity_types(entities: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"]))), ", ")


def audit_log(detected: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """What was found in each row, without values."""
    top = F.coalesce(F.array_max(F.transform("entities", lambda e: e["score"])), F.lit(0.0).cast("float"))
    return detected.select(*id_cols, F.lit("pii_scan").alias("event"), F.size("entities").cast("long").alias("entities_found"), entity_types(F.col("entities")).alias("entity_types"), top.alias("highest_confidence"))


def file_report(detected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with entities, entities and types for each group."""
    n = F.size("entities")
    # a type list for each row is short; sets of types are bounded by the labels
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("entities", lambda e: e["type"]))))), ", ")
    return detected.groupBy(*by).agg(F.count("*").alias("scanned"), F.sum((n > 0).cast("long")).alias("flagged"), F.sum(n).cast("long").alias("entities"), types.alias("types"))


def buckets_report(detected: DataFrame, by: str) -> DataFrame:
    """Files with entities, entities and types of each bucket; ``(all)`` has the totals and the types of all."""
    n = F.size("entities")
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("entities", lambda e: e["type"]))))), ", ")
    # a bucket without a name is not the total
    name = F.when(F.grouping(by) == 1, "(all)").otherwise(F.col(by))
    out = detected.rollup(by).agg(name.alias("bucket"), F.count("*").alias("files"), F.sum((n > 0).cast("long")).alias("files_with_pii"), F.sum(n).cast("long").alias("total_entities"), types.alias("types"))
    return out.select("bucket", "files", "files_with_pii", "total_entities", "types")


def bucket_audit(files: DataFrame, bucket_col: str = "bucket", key_col: str = "key", text_col: str = "text", config: Config = Config.corpus()) -> DataFrame:
    """Entities of each object, read in chunks; offsets count within a chunk."""
    parts = files.select(bucket_col, key_col, F.explode(chunks(F.col(text_col))).alias("c")).select(bucket_col, key_col, "c.chunk", "c.text")
    found = detect(parts, "text", config=config).filter(F.size("entities") > 0)
    per = found.groupBy(bucket_col, key_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "entities"))), lambda x: x["entities"])).alias("entities"))
    return per.select(bucket_col, key_col, F.size("entities").cast("long").alias("entities_found"), entity_types(F.col("entities")).alias("entity_types"), F.slice("entities", 1, SAMPLE_ENTITIES).alias("sample_entities"))


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def classify_columns(df: DataFrame, table: str, order_col: str, columns: Sequence[str] | None = None, config: Config = Config.corpus()) -> DataFrame:
    """Which string columns hold personal data, from a sample by order (the first rows are the recipe's sample).

    Each sampled value is scanned by itself, whatever its length; a column without entities has no row.
    """
    out = None
    for c in columns or string_columns(df):
        rows = df.filter(F.col(c).isNotNull()).orderBy(order_col).limit(SAMPLE_ROWS).select(F.col(order_col).alias("o"), F.col(c).alias("v")).filter(F.length("v") > SAMPLE_LEAST)
        one = rows.agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("x")).select(F.lit(c).alias("column_name"), F.size("x").alias("n"), F.explode(F.slice("x", 1, SAMPLE_CHECKED)).alias("s")).select("column_name", "n", F.col("s.v").alias("text"))
        out = one if out is None else out.unionByName(one)
    found = detect_spans(out, ["column_name", "n"], "text", config=config)
    kinds = found.groupBy("column_name", "n", "type").agg(F.count("*").alias("k"))
    per = kinds.groupBy("column_name", "n").agg(F.sum("k").alias("entities"), F.min(F.struct((-F.col("k")).alias("k"), "type")).alias("top"), F.array_sort(F.collect_list(F.struct("type", "k"))).alias("kinds"))
    ratio = F.col("entities") / F.col("n")
    return per.select(
        F.lit(table).alias("table_name"), "column_name", F.col("n").cast("long").alias("samples_checked"), F.col("entities").cast("long").alias("entities_found"), F.round(ratio, 2).alias("pii_ratio"),
        F.col("top.type").alias("dominant_type"), F.array_join(F.transform("kinds", lambda k: F.concat_ws(": ", k["type"], k["k"].cast("string"))), ", ").alias("type_distribution"),
        F.when(ratio > PII_RATIO, "PII").when(ratio > POSSIBLE_RATIO, "POSSIBLE_PII").otherwise("UNLIKELY_PII").alias("classification"),
    )


def batch_stats(detected: DataFrame) -> DataFrame:
    n = F.size("entities")
    return detected.agg(F.count("*").alias("scanned"), F.sum((n > 0).cast("long")).alias("flagged"), F.sum(n).cast("long").alias("entities"))


def parse_whatsapp(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(date, time, sender, text) of the lines of a chat export that are messages."""
    part = lambda k: F.regexp_extract(F.trim(line_col), WHATSAPP, k)
    return lines.filter(F.trim(line_col).rlike(WHATSAPP)).select("*", part(1).alias("date"), part(2).alias("time"), part(3).alias("sender"), part(4).alias("text"))


def ticket_texts(tickets: DataFrame) -> DataFrame:
    """``tickets(id, description, comments array<struct<body, author_id>>)`` as (ticket_id, source, author, text)."""
    head = tickets.filter(F.coalesce(F.col("description"), F.lit("")) != "").select(F.col("id").alias("ticket_id"), F.lit("description").alias("source"), F.lit(None).cast("string").alias("author"), F.col("description").alias("text"))
    rest = tickets.select(F.col("id").alias("ticket_id"), F.posexplode("comments").alias("i", "c")).filter(F.length("c.body") >= MESSAGE_LEAST)
    return head.unionByName(rest.select("ticket_id", F.concat(F.lit("comment_"), F.col("i").cast("string")).alias("source"), F.col("c.author_id").cast("string").alias("author"), F.col("c.body").alias("text")))


def slack_messages(export: DataFrame) -> DataFrame:
    """Messages of ``export(channel, ts, user, text)`` that are long enough to scan."""
    return export.filter(F.length("text") >= MESSAGE_LEAST)


def first_line(findings: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Number of the first line that holds each found value, 1 where none does (a value may run over lines)."""
    lines = files.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hit = findings.join(lines, key).filter(F.col("line").contains(F.col("value")))
    first = hit.groupBy(key, "value").agg((F.min("i") + 1).alias("line"))
    return findings.join(first, [key, "value"], "left").withColumn("line", F.coalesce("line", F.lit(1)))


def strict_match(gold: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("doc_id", "start", "end", "label")) -> DataFrame:
    """Precision, recall and F1 of each label, spans equal in all keys; ``(all)`` has the means over labels."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    counts = g.join(p, list(keys), "full").groupBy("label").agg(F.sum(F.coalesce("g", F.lit(0)) * F.coalesce("p", F.lit(0))).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_pred"))
    precision, recall = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0), F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(0.0)
    f1 = F.when(F.col("n_gold") + F.col("n_pred") > 0, 2 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))).otherwise(0.0)
    by = counts.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("n_gold").alias("support"))
    return by.union(by.agg(F.lit("(all)"), F.avg("precision"), F.avg("recall"), F.avg("f1"), F.sum("support")))
