"""The given tables seen as comments, analyses and so on. Each view exists as a DataFrame and as a CTE for DuckDB, from one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plaza.plans.registry import load

_COMMENTS = """event_id AS comment_id | user_id % 20 AS content_id | concat('run-', user_id % 3) AS run_id
| CASE WHEN user_id % 2 = 0 THEN 'douyin' ELSE 'bilibili' END AS platform | user_id AS author_id
| CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 END AS parent_comment_id
| CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS depth | CASE WHEN event_id % 97 <> 0 THEN ts END AS published_at
| CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) END AS like_count"""

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_ANALYSES = f"""event_id AS id | event_id - event_id % 2 AS comment_id | ts AS created_at
| CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('purchase', 'signup') THEN 'positive' ELSE 'neutral' END AS sentiment
| CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END * value / 487 AS sentiment_score
| CASE WHEN event_type = 'error' THEN 'anger' WHEN event_type = 'purchase' THEN 'joy' WHEN event_type = 'signup' THEN 'surprise' ELSE 'neutral' END AS emotion
| CASE WHEN event_type = 'error' THEN 'oppose' WHEN event_type = 'purchase' THEN 'support' WHEN event_type = 'signup' THEN 'neutral' ELSE 'unclear' END AS stance
| CASE WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS risk_level
| array(concat('topic ', {_K} % 7), CASE WHEN {_K} % 6 = 0 THEN ' ' ELSE concat('topic ', {_K} % 5) END) AS topics
| array(concat('key ', {_K} % 13), concat(' key ', {_K} % 4)) AS keywords | array(event_type) AS risk_reasons
| concat('hash-', event_id % 500) AS input_hash | CASE WHEN event_id % 3 = 0 THEN 'model-b' ELSE 'model-a' END AS model"""

_CONTENTS = """o_orderkey AS content_id | CASE WHEN o_orderkey % 2 = 0 THEN 'douyin' ELSE 'bilibili' END AS platform
| CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS published_at | concat('title ', o_custkey) AS title | o_custkey AS author_id
| concat('run-', o_orderkey % 3) AS run_id"""

_AUTHORS = "c_custkey AS author_id | CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS nickname | CASE WHEN c_custkey % 2 = 0 THEN 'douyin' ELSE 'bilibili' END AS platform"

_TEXTS = """doc_id AS comment_id | text | lang | source AS content_id | CASE WHEN doc_id % 2 = 0 THEN 'douyin' ELSE 'bilibili' END AS platform
| CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS depth | n_chars AS like_count"""

_VIEWS = {
    "comments": ("events", _COMMENTS, "TRUE"),
    "analyses": ("events", _ANALYSES, "event_type <> 'view'"),
    "contents": ("orders", _CONTENTS, "TRUE"),
    "authors": ("customer", _AUTHORS, "TRUE"),
    "texts": ("documents", _TEXTS, "TRUE"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = _VIEWS[name]
    return load(spark, sf_dir, table).where(where).selectExpr(*[c.strip() for c in columns.split("|")])


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` of views for DuckDB; ``latest`` and ``labelled`` build on the others."""
    parts = []
    for name in names:
        if name == "latest":
            parts.append(
                "latest AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.comment_id ORDER BY a.created_at DESC, a.id DESC) AS rn "
                "FROM analyses a JOIN comments c ON a.comment_id = c.comment_id) x WHERE rn = 1)"
            )
        else:
            table, columns, where = _VIEWS[name]
            parts.append(f"{name} AS (SELECT {columns.replace(' | ', ', ').replace(chr(10) + '|', ',').replace('array(', 'list_value(')} FROM {table} WHERE {where})")
    return "WITH " + ",\n".join(parts) + "\n"
