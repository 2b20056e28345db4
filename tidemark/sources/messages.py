"""Messages: headers and named fields with a time in ns, from tables or streams; sampling; report and alert sinks."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nanoseconds

#: Headers that are tracked (fixed values).
HEADERS = ["Logger", "Hostname", "Type", "Payload", "EnvVersion", "Pid", "Severity"]
FIELD = "struct<name:string,value_type:int,representation:string,repetition:boolean,value:string>"
SCHEMA = f"seq bigint, ns bigint, Logger string, Hostname string, Type string, Payload string, EnvVersion string, Pid int, Severity int, Fields array<{FIELD}>"


def field(name: str, value: Column, value_type: int, representation: str = "", repetition: bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(value_type).alias("value_type"), F.lit(representation).alias("representation"), F.lit(repetition).alias("repetition"), value.cast("string").alias("value"))


def from_events(events: DataFrame) -> DataFrame:
    """The events table (or stream) as messages: the type is the logger, the user the process; value, user and properties are fields."""
    none = F.lit(None).cast("string")
    return events.select(
        F.col("event_id").alias("seq"), nanoseconds("ts").alias("ns"), F.col("event_type").alias("Logger"), none.alias("Hostname"), none.alias("Type"), none.alias("Payload"), none.alias("EnvVersion"),
        F.pmod("user_id", F.lit(2**31 - 1)).cast("int").alias("Pid"), F.lit(None).cast("int").alias("Severity"),
        F.array(field("value", F.col("value"), 3), field("user_id", F.col("user_id"), 2), field("props", F.col("props"), 0, "json")).alias("Fields"),
    )


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Parquet messages of SCHEMA, as a table or as a stream of files."""
    return (spark.readStream if stream else spark.read).schema(SCHEMA).parquet(path)


def sampled(messages: DataFrame, identity: str, of_256: int = 3) -> DataFrame:
    """About of_256 / 256 of the messages, always the same ones: those whose identity's MD5 begins with a byte below of_256."""
    return messages.where(F.conv(F.substring(F.md5(F.col(identity).cast("string").cast("binary")), 1, 2), 16, 10).cast("int") < of_256)


def explode_entries(messages: DataFrame, hierarchy: list[str] = ["Logger"], exclude: list[str] | None = None) -> DataFrame:
    """A row per header that is set and per field: path, kind, name, seq, part, ns, value, value_type, representation, repetition.

    hierarchy: headers whose values are the path (null: NIL); they and `exclude` (headers, or fields as Fields[x]) are not
    tracked. Exclusion and column choice stand before the explode, so that unread columns are pruned from the scan.
    """
    out_of = [re.fullmatch(r"Fields\[([^\]]+)\]", e) for e in (exclude or []) + hierarchy]
    fields = [m[1] for m in out_of if m]
    headers = [h for h in HEADERS if h not in (exclude or []) + hierarchy]
    path = F.array(*(_level(h) for h in hierarchy)).alias("path")
    row = lambda kind, name, part, value, code, rep, many: F.struct(F.lit(kind).alias("kind"), name.alias("name"), part.alias("part"), value.alias("value"), code.alias("value_type"), rep.alias("representation"), many.alias("repetition"))
    none = F.lit(None)
    of_headers = [row("header", F.lit(h), F.lit(i), F.col(h).cast("string"), none.cast("int"), none.cast("string"), none.cast("boolean")) for i, h in enumerate(headers)]
    of_fields = F.transform(F.coalesce("Fields", F.array().cast(f"array<{FIELD}>")), lambda f, i: row("field", f["name"], i + len(HEADERS), f["value"], f["value_type"], f["representation"], f["repetition"]))
    entries = F.concat(F.array(*of_headers), of_fields) if of_headers else of_fields
    rows = messages.select(path, "seq", "ns", F.explode(entries).alias("e")).select("path", "seq", "ns", "e.*")
    return rows.where(F.col("value").isNotNull() & ~((F.col("kind") == "field") & F.col("name").isin(fields)) if fields else F.col("value").isNotNull())


def _level(reference: str) -> Column:
    m = re.fullmatch(r"Fields\[([^\]]+)\]", reference)
    if not m:
        return F.coalesce(F.col(reference).cast("string"), F.lit("NIL"))
    hits = F.filter("Fields", lambda f: f["name"] == m[1])
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"], F.lit("NIL"))


# ---- sinks


def write_reports(reports: DataFrame, path: str) -> None:
    """report_json rows, a file per partition, one JSON document a line."""
    reports.select("report").write.mode("overwrite").text(path)


def alert_page(title: str, series: list[dict]) -> str:
    """A page with a plot for each alert: series has label, current and closest (lists of numbers); an SVG without any outside resource."""
    parts = []
    for s in series:
        top = max([1e-12, *s["current"], *s["closest"]])
        width = 600 / max(len(s["current"]), 1)
        bars = "".join(
            f'<rect x="{(i + dx) * width:.1f}" y="{100 - 100 * v / top:.1f}" width="{width / 2:.1f}" height="{100 * v / top:.1f}" fill="{colour}"/>'
            for dx, colour, values in ((0, "#36c", s["current"]), (0.5, "#c63", s["closest"]))
            for i, v in enumerate(values)
        )
        parts.append(f'<h2>{html.escape(s["label"])}</h2><svg viewBox="0 0 600 100" data-series="{html.escape(json.dumps(s))}">{bars}</svg>')
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(parts)}</body></html>'
