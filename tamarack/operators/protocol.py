"""Predicates and projections over messages, commands, addresses and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a command must not contain (compared without spaces).
DENIED = (
    "rm -rf", "rm -fr", "rm -r -f", "rm -f -r", "mkfs", "format", "dd if=", ":(){", "chmod 777 /",
    "rd /s", "rmdir /s", "del /f", "remove-item", "shutdown", "reboot",
)


def rpc_kind(message: Column) -> Column:
    """response, error, request or notification; a present key counts even if its value is null."""
    keys = F.json_object_keys(message)
    return (
        F.when(F.array_contains(keys, "result"), "response")
        .when(F.array_contains(keys, "error"), "error")
        .when(F.get_json_object(message, "$.id").isNotNull(), "request")
        .otherwise("notification")
    )


def denied(command: Column) -> Column:
    plain = F.replace(F.lower(command), F.lit(" "))
    return F.exists(F.array(*[F.lit(x.replace(" ", "")) for x in DENIED]), lambda p: F.contains(plain, p))


def is_web(url: Column) -> Column:
    return url.rlike("^https?://")


def clean_arguments(arguments: Column) -> Column:
    """A map without null values and without ``workdir``."""
    return F.map_filter(arguments, lambda k, v: v.isNotNull() & (k != "workdir"))


def tool_name(server: Column, tool: Column) -> Column:
    return F.concat_ws("_", F.lit("mcp"), server, tool)


def content_text(content: Column) -> Column:
    """Text items of ``array<struct<type, text>>``, a line each."""
    return F.array_join(F.transform(F.filter(content, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")


def available(key: Column) -> Column:
    trimmed = F.trim(F.coalesce(key, F.lit("")))
    return (trimmed != "") & ~F.contains(trimmed, F.lit("xxx"))


def first_available(catalog: DataFrame) -> DataFrame:
    """The first usable model of a catalog (``ordinal, name, key``); none if no key is usable."""
    best = catalog.where(available(F.col("key"))).agg(F.min_by("name", "ordinal").alias("name"))
    return best.select(F.coalesce("name", F.lit("none")).alias("name"))


def health(catalog: DataFrame, version: str = "1") -> DataFrame:
    """One row, ``status, version, tools_count``, from a catalog of tools (``name``); an empty
    catalog counts none."""
    return catalog.agg(F.count("name").alias("tools_count")).select(F.lit("ok").alias("status"), F.lit(version).alias("version"), "tools_count")


def setting(config: Column, path: str, default: str | None = None) -> Column:
    """The text at a dotted path of a JSON column; what is missing or null gives ``default``."""
    return F.coalesce(F.get_json_object(config, "$." + path), F.lit(default))
