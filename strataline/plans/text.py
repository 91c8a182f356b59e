"""Queries for text records."""

from pyspark.sql import functions as F

from strataline.operators import text
from strataline.plans.fixtures import table
from strataline.plans.registry import query

TERMS = {"password": 5, "token": 4, "email": 3, "the": 1, "license": 2, "phone": 2}


def quoted(value):
    return "'" + value.replace("'", "''") + "'"


def score_sql(col, weights):
    return " + ".join(f"CASE WHEN contains(lower({col}), {quoted(t)}) THEN {w} ELSE 0 END" for t, w in weights.items())


def terms_sql(col, weights):
    return (
        f"array_to_string(list_filter([{', '.join(map(quoted, weights))}], lambda t: contains(lower({col}), t)), ', ')"
    )


def redact_sql(col, n):
    out = f"replace(substring({col}, 1, {n}), chr(10), ' ')"
    for pattern, mask in text.REDACTIONS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(mask.replace('$', chr(92)))}, 'g')"
    return out


@query(
    "q01_keyword_score",
    f"SELECT doc_id, CAST({score_sql('text', TERMS)} AS INT) AS score, {terms_sql('text', TERMS)} AS terms FROM documents",
)
def keyword_score(spark, sf):
    return text.keyword_score(table(spark, sf, "documents"), "text", TERMS).select("doc_id", "score", "terms")


SECRETS = "concat('TOKEN=a-', doc_id, ' PASSWORD=x', doc_id, ' sk_live_', doc_id, chr(10), text)"


@query("q02_redact", f"WITH d AS (SELECT doc_id, {SECRETS} AS t FROM documents) SELECT doc_id, {redact_sql('t', 140)} AS preview FROM d")
def redact(spark, sf):
    """Documents behind a line of made-up secrets, so that every pattern has something to hide."""
    doc = F.col("doc_id").cast("string")
    full = F.concat(F.lit("TOKEN=a-"), doc, F.lit(" PASSWORD=x"), doc, F.lit(" sk_live_"), doc, F.lit("\n"), F.col("text"))
    return text.redact(table(spark, sf, "documents").withColumn("t", full), "t").select("doc_id", "preview")


def records(spark, sf):
    """Pages and conversation turns as records; each begins with calls built from its own columns."""
    pages = table(spark, sf, "pages")
    turns = table(spark, sf, "conversations")
    page = F.col("page_id").cast("string")
    conv = F.col("conv_id").cast("string")
    page_text = F.concat(
        F.lit('web.open(id="'), page, F.lit('", url=\'a\', id="p'), page, F.lit('")\nAction: http.post url="'), F.col("url"),
        F.lit('" data="x"\nfs.write(path="/tmp/'), page, F.lit('")\n'), F.col("html"),
    )
    turn_text = F.concat(
        F.lit('email.send to="'), F.col("role"), F.lit('" body="'), conv, F.lit('"\nshell.run(cmd="ls")\n'), F.col("text")
    )
    return (
        pages.select(F.lit("web").alias("source_type"), page.alias("source_id"), page_text.alias("t"))
        .unionByName(
            turns.select(
                F.lit("chat").alias("source_type"), F.concat_ws("_", conv, F.col("turn").cast("string")).alias("source_id"), turn_text.alias("t")
            )
        )
    )


RECORDS = """
rec AS (SELECT 'web' AS source_type, CAST(page_id AS VARCHAR) AS source_id, concat('web.open(id="', page_id, '", url=''a'', id="p', page_id, '")', chr(10), 'Action: http.post url="', url, '" data="x"', chr(10),
          'fs.write(path="/tmp/', page_id, '")', chr(10), html) AS t FROM pages
        UNION ALL SELECT 'chat', concat_ws('_', conv_id, turn), concat('email.send to="', role, '" body="', conv_id, '"', chr(10), 'shell.run(cmd="ls")', chr(10), text) FROM conversations)"""


def pattern(value):
    return quoted(value)


EDGES = f"""
c1 AS (SELECT source_type, source_id, {score_sql("t", text.KEYWORD_WEIGHTS)} AS score, 1 AS p, unnest(list_zip(regexp_extract_all(t, {pattern(text.CALL)}, 1), regexp_extract_all(t, {pattern(text.CALL)}, 2))) AS m, generate_subscripts(regexp_extract_all(t, {pattern(text.CALL)}, 1), 1) AS n FROM rec),
c2 AS (SELECT source_type, source_id, {score_sql("t", text.KEYWORD_WEIGHTS)} AS score, 2 AS p, unnest(list_zip(regexp_extract_all(t, {pattern(text.LINE)}, 1), regexp_extract_all(t, {pattern(text.LINE)}, 2))) AS m, generate_subscripts(regexp_extract_all(t, {pattern(text.LINE)}, 1), 1) AS n FROM rec),
cc AS (SELECT source_type, source_id, score, p, n, m[1] AS tool, m[2] AS args FROM c1 UNION ALL SELECT source_type, source_id, score, p, n, m[1], m[2] FROM c2),
ar AS (SELECT cc.*, unnest(list_zip(regexp_extract_all(args, {pattern(text.ARGUMENT)}, 1), regexp_extract_all(args, {pattern(text.ARGUMENT)}, 2))) AS a, generate_subscripts(regexp_extract_all(args, {pattern(text.ARGUMENT)}, 1), 1) AS i FROM cc),
la AS (SELECT source_type, source_id, score, p, n, tool, a[1] AS arg_key, arg_max(a[2], i) AS arg_value FROM ar GROUP BY 1, 2, 3, 4, 5, 6, 7),
ed AS (SELECT source_type, source_id, score, tool, arg_key, arg_value, CASE {" ".join(f"WHEN tool = {quoted(t)} AND arg_key = {quoted(k)} THEN {quoted(e)}" for (t, k), e in text.EDGE_TYPES.items())} ELSE concat(tool, ':', arg_key) END AS edge_type FROM la)"""


def edges(spark, sf):
    scored = text.keyword_score(records(spark, sf), "t")
    return text.extract_edges(scored, "t", ["source_type", "source_id"], ["score"])


@query("q03_extract_edges", f"WITH {RECORDS}, {EDGES} SELECT source_type, source_id, CAST(score AS INT) AS score, tool, arg_key, arg_value, edge_type FROM ed")
def extract_edges(spark, sf):
    return edges(spark, sf)


@query(
    "q04_edge_summary",
    f"WITH {RECORDS}, {EDGES} SELECT source_type, edge_type, count(*) AS edges, count(DISTINCT source_id) AS sources, round(avg(score), 6) AS mean_score, CAST(max(score) AS INT) AS max_score FROM ed GROUP BY 1, 2",
)
def edge_summary(spark, sf):
    found = text.edge_summary(edges(spark, sf), "source_type", "source_id")
    return found.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "q05_route_priority",
    f"""WITH {RECORDS}, {EDGES}, r AS (SELECT *, CASE {" ".join(f"WHEN edge_type IN ({', '.join(map(quoted, types))}) THEN {quoted(name)}" for name, types in text.ROUTES.items())} ELSE 'other' END AS route FROM ed)
        SELECT route, count(*) AS edges, count(DISTINCT source_id) AS sources, round(avg(score), 6) AS mean_score, CAST(max(score) AS INT) AS max_score FROM r GROUP BY 1""",
)
def route_priority(spark, sf):
    return text.route_priority(edges(spark, sf), "source_id").withColumn("mean_score", F.round("mean_score", 6))


@query(
    "q06_rank_records",
    f"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, CAST({score_sql('text', TERMS)} AS INT) AS score,
          {terms_sql('text', TERMS)} AS terms, {redact_sql('text', 140)} AS preview FROM documents""",
)
def rank_records(spark, sf):
    return text.rank_records(table(spark, sf, "documents"), "text", ["doc_id"], TERMS)
