"""Text records: keyword score, redacted preview, call edges and their summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weighted keywords of the score.
KEYWORD_WEIGHTS = {
    "secret.txt": 4,
    "http.post": 4,
    "email.send": 3,
    "fs.delete": 3,
    "fs.write": 2,
    "shell.run": 2,
    "ignore previous": 2,
    "forget all previous": 2,
    "disregard": 2,
    "incident-42": 2,
    "mh_": 2,
    "credential": 1,
    "token": 1,
    "password": 1,
}

# What a preview hides.
REDACTIONS = (
    (r"(sk_live_)[A-Za-z0-9_\-]+", "$1***"),
    (r"(TOKEN=)[A-Za-z0-9_\-]+", "$1***"),
    (r"(PASSWORD=)[^\s]+", "$1***"),
    (r"(SECRET_API_KEY=)[^\s]+", "$1***"),
)

# Tools, argument names and the type of an edge.
TOOLS = (
    "web.search", "web.open", "email.list", "email.read", "email.send",
    "fs.read", "fs.write", "fs.delete", "http.post", "shell.run",
)
ARGUMENTS = ("id", "path", "url", "to", "query", "cmd", "data", "body", "content")
EDGE_TYPES = {
    ("web.open", "id"): "web_open",
    ("web.search", "query"): "web_search",
    ("email.read", "id"): "email_read",
    ("fs.read", "path"): "fs_read",
    ("fs.delete", "path"): "fs_delete",
    ("fs.write", "path"): "fs_write",
    ("http.post", "url"): "http_post",
    ("email.send", "to"): "email_send",
    ("shell.run", "cmd"): "shell_run",
}

# Class of each edge type.
ROUTES = {
    "exfiltration endpoint": ("http_post",),
    "confused deputy endpoint": ("email_send",),
    "destructive or execution endpoint": ("fs_delete", "fs_write", "shell_run"),
    "source traversal": ("web_open", "web_search", "email_read", "fs_read"),
}

_TOOL = "|".join(re.escape(t) for t in TOOLS)
CALL = rf"({_TOOL})\s*\(([^)]*)\)"
LINE = rf"(?i)(?:Action:\s*)?({_TOOL})\s+([^\n]+)"
ARGUMENT = rf"""({"|".join(ARGUMENTS)})\s*=\s*["']([^"']+)["']"""


def keyword_score(df: DataFrame, col: str, weights: dict[str, int] | None = None, most: int | None = None) -> DataFrame:
    """Sum of the weights of the terms that occur (each once), and the terms as text: all, or the first ``most``."""
    weights = weights or KEYWORD_WEIGHTS
    # Each term is looked for once in the lower-case text; score and term list come from the flags.
    lowered = df.withColumn("_low", F.lower(F.col(col)))
    flags = F.array(*[F.contains(F.col("_low"), F.lit(t.lower())) for t in weights])
    found = lowered.withColumn("_found", flags)
    score, hits = F.lit(0), []
    for i, (term, weight) in enumerate(weights.items()):
        hit = F.get("_found", F.lit(i))
        score = score + F.when(hit, weight).otherwise(0)
        hits.append(F.when(hit, F.lit(term)))
    matched = F.array_compact(F.array(*hits))
    terms = F.array_join(matched if most is None else F.slice(matched, 1, most), ", ")
    return found.withColumns({"score": score, "terms": terms}).drop("_low", "_found")


def redact(df: DataFrame, col: str, n: int = 140, out: str = "preview") -> DataFrame:
    """Preview of n characters on one line, with keys, tokens and passwords masked."""
    text = F.replace(F.substring(F.col(col), 1, n), F.lit("\n"), F.lit(" "))
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return df.withColumn(out, text)


def extract_edges(df: DataFrame, col: str, ids: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per argument of every tool call found in the text, by two notations: ``tool(args)`` and ``tool args``.

    Of an argument given twice in a call the last value counts.
    """
    def calls(pattern: str) -> Column:
        return F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0))

    found = df.select(*ids, *carry, F.explode(F.array(F.struct(F.lit(CALL).alias("p"), calls(CALL).alias("c")), F.struct(F.lit(LINE).alias("p"), calls(LINE).alias("c")))).alias("_m"))
    one = found.select(*ids, *carry, F.col("_m.p").alias("_p"), F.posexplode("_m.c").alias("_at", "_call"))
    is_call = F.col("_p") == CALL
    tool = F.when(is_call, F.regexp_extract("_call", CALL, 1)).otherwise(F.regexp_extract("_call", LINE, 1))
    args = F.when(is_call, F.regexp_extract("_call", CALL, 2)).otherwise(F.regexp_extract("_call", LINE, 2))
    parsed = one.withColumns({"tool": tool, "_args": args})
    names = F.regexp_extract_all("_args", F.lit(ARGUMENT), F.lit(1))
    values = F.regexp_extract_all("_args", F.lit(ARGUMENT), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), e["k"]))
    edges = parsed.withColumn("_pair", F.explode(last)).select(
        *ids, *carry, "tool", F.col("_pair.k").alias("arg_key"), F.col("_pair.v").alias("arg_value")
    )
    kind = F.concat_ws(":", "tool", "arg_key")
    for (name, key), edge in EDGE_TYPES.items():
        kind = F.when((F.col("tool") == name) & (F.col("arg_key") == key), edge).otherwise(kind)
    return edges.withColumn("edge_type", kind)


def _summary(edges: DataFrame, by: Sequence[str], source: str, score: str) -> DataFrame:
    return edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_distinct(source).alias("sources"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
    )


def edge_summary(edges: DataFrame, source_type: str, source: str, score: str = "score") -> DataFrame:
    """Edges, different sources, mean and highest score per source type and edge type."""
    return _summary(edges, [source_type, "edge_type"], source, score).orderBy(F.desc("mean_score"), F.desc("edges"), "edge_type")


def route_priority(edges: DataFrame, source: str, score: str = "score") -> DataFrame:
    """The same per class of edge type."""
    route = F.lit("other")
    for name, types in ROUTES.items():
        route = F.when(F.col("edge_type").isin(*types), name).otherwise(route)
    return _summary(edges.withColumn("route", route), ["route"], source, score).orderBy(F.desc("mean_score"), F.desc("edges"), "route")


def rank_records(df: DataFrame, col: str, ids: Sequence[str], weights: dict[str, int] | None = None, n: int = 140) -> DataFrame:
    """Records by score, highest first, with size, lines, terms and a redacted preview."""
    scored = redact(keyword_score(df, col, weights), col, n)
    lines = F.length(F.col(col)) - F.length(F.replace(F.col(col), F.lit("\n"), F.lit(""))) + 1
    return scored.select(
        *ids, F.octet_length(F.col(col)).cast("long").alias("bytes"), lines.cast("long").alias("lines"), "score", "terms", "preview"
    ).orderBy(F.desc("score"), *ids)
