"""Trees of files as texts, and reports as files."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import entity_types, first_line
from ..operators.pipeline import Config, detect

# --- fixed values: results depend on them -----------------------------------------------------------
EXTENSIONS = ["txt", "md", "csv", "json", "yaml", "yml", "xml", "html", "log", "sql", "env", "cfg", "conf", "ini", "toml"]
EXCLUDE = ["node_modules", "dist", "build", ".git", "vendor", "__pycache__", ".venv"]
MAX_KB = 512
PREFIX_BYTES = 10_240
MIN_SCORE = 0.85


def _any(path: Column, patterns: Sequence[str]) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression, without the end mark that Java doesn't know."""
    return fnmatch.translate(glob).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")


def scan_files(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, exclude: Sequence[str] = EXCLUDE, max_kb: int = MAX_KB, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``(path, length, text)`` of the files to scan: by extension, not under or named an excluded pattern, below the size, the head only, not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.filter(_any(F.col("path"), [rf"\.{e.strip()}\z" for e in extensions]) & ~_any(F.col("path"), [rf"/{glob_regex(x.strip())}(?:/|\z)" for x in exclude]))
    # sizes count in whole kilobytes, rounded up
    fit = named.filter(F.ceil(F.col("length") / 1024) < max_kb)
    head = F.substring("content", 1, prefix_bytes)
    return fit.select("path", "length", F.make_valid_utf8(head.cast("string")).alias("text")).filter(F.length("text") > 0)


def ignore(files: DataFrame, globs: Sequence[str], path_col: str = "path", max_bytes: int | None = 50_000) -> DataFrame:
    """Without the files that a list of globs names, and those over the size."""
    kept = files.filter(~_any(F.col(path_col), [rf"(?:\A|/){glob_regex(g.strip())}(?:/|\z)" for g in globs if g.strip() and not g.startswith("#")]))
    return kept if max_bytes is None else kept.filter(F.octet_length("text") <= max_bytes)


def scan_report(files: DataFrame, key: str = "path", min_score: float = MIN_SCORE, config: Config = Config.server()) -> DataFrame:
    """``(file, count, types, entities)`` of the files with entities at or above the score."""
    found = detect(files.select(key, "text"), "text", config=config)
    sure = found.withColumn("entities", F.filter("entities", lambda e: e["score"] >= F.lit(min_score).cast("float"))).filter(F.size("entities") > 0)
    return sure.select(F.col(key).alias("file"), F.size("entities").cast("long").alias("count"), entity_types(F.col("entities")).alias("types"), "entities")


def annotations(report: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """A message for each entity with the line it is on."""
    rows = report.select(F.col("file").alias(key), F.explode("entities").alias("e")).select(key, "e.type", "e.value", "e.score").distinct()
    return first_line(rows, files, key).select(F.col(key).alias("file"), "line", "type", F.concat(F.lit("PII detected: "), "type").alias("message"))


def write_report(report: DataFrame, path: str, fail_on_pii: bool = True) -> dict[str, object]:
    """Write findings as JSON lines; returns outputs and the exit code. Only totals reach the driver."""
    report.select("file", "entities").write.mode("overwrite").json(path)
    total = report.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return {"pii_found": total > 0, "total_findings": total, "report": path, "exit_code": int(total > 0 and fail_on_pii)}


def _summary_row() -> Column:
    return F.concat_ws("", F.lit("| "), "file", F.lit(" | "), F.col("count").cast("string"), F.lit(" | "), "types", F.lit(" |"))


SUMMARY_HEAD = ["| File | Entities | Types |", "|---|---|---|"]


def write_summary(report: DataFrame, path: str) -> None:
    """The table of all files as text files under ``path``, in order by name, written by the executors."""
    head = report.sparkSession.createDataFrame([(i - len(SUMMARY_HEAD), "", x) for i, x in enumerate(SUMMARY_HEAD)], "o int, file string, value string")
    rows = head.unionByName(report.select(F.lit(0).alias("o"), "file", _summary_row().alias("value")))
    rows.orderBy("o", "file").select("value").write.mode("overwrite").text(path)


def summary_markdown(report: DataFrame, limit: int = 1_000) -> str:
    """A table of the first files by name, for people to read, and totals that say how many there are; ``write_summary`` has all."""
    rows = report.orderBy("file").limit(limit).select(_summary_row()).collect()
    n, total = report.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    more = [f"| ... and {n - len(rows)} more files | | |"] if n > len(rows) else []
    return "\n".join([*SUMMARY_HEAD, *(r[0] for r in rows), *more, "", f"{total} entities in {n} files"])


def findings_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("file", "entities")).alias("value"))


def gate(report: DataFrame) -> bool:
    """True if anything was found; stops at the first row."""
    return not report.limit(1).isEmpty()


def read_slack(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export folder ``channel/day.json``, each a JSON list."""
    rows = spark.read.option("multiLine", True).schema("ts string, user string, text string").json(f"{path}/*/*.json")
    return rows.withColumn("channel", F.element_at(F.split(F.input_file_name(), "/"), -2))


def parse_requests(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON requests as (text, labels, boost); an absent boost is empty."""
    r = F.from_json(value_col, "text string, labels array<string>, boost array<string>")
    return lines.select(r.alias("r")).select("r.text", "r.labels", F.coalesce("r.boost", F.array().cast("array<string>")).alias("boost"))


def dumps(outputs: dict[str, object]) -> str:
    return json.dumps(outputs, sort_keys=True)
