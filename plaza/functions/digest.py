"""One hash of a set of lines of any size and any kind of key: a tree over the hashes of the lines, with counted nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_digest(rows: DataFrame, group: Sequence[str], line: Column, depth: int = 6, fan: int = 3) -> DataFrame:
    """(group, n, hash) of each group of ``rows``: its lines, repeats included, in whatever order.

    Lines are dealt to leaves by the first ``depth`` hex digits of their sha256; a node has the nodes whose name is ``fan`` digits longer. Each node is the sha256 of
    its sorted children, and holds how many lines are below it. With 16 ** 6 leaves no list is longer than some thousand until a group has 10 ** 10
    lines, repeats are counted before they are listed, and a change touches one way to the root only. A null line is an empty one.
    """
    if depth % fan:
        raise ValueError("depth must be a multiple of fan")
    x = rows.select(*group, F.coalesce(line, F.lit("")).alias("_line")).groupBy(*group, "_line").agg(F.count("*").alias("_n"))
    x = x.select(*group, F.substring(F.sha2("_line", 256), 1, depth).alias("_node"), "_n", F.concat_ws(":", "_line", F.col("_n").cast("string")).alias("_child"))
    for size in range(depth, -1, -fan):
        node, listed = F.substring("_node", 1, size), F.sha2(F.array_join(F.array_sort(F.collect_list("_child")), "\n"), 256)
        x = x.groupBy(*group, node.alias("_node")).agg(F.sum("_n").alias("_n"), listed.alias("_hash"))
        x = x.withColumn("_child", F.concat_ws(":", "_node", F.col("_n").cast("string"), "_hash"))
    return x.select(*group, F.col("_n").alias("n"), F.col("_hash").alias("hash"))


def digest_sql(table: str, group: str, line: str) -> str:
    """The same for DuckDB, from a table with columns ``group`` and an expression for the line."""
    level = lambda source, size: f"(SELECT {group}, substring(node, 1, {size}) AS node, sum(n) AS n, sha256(string_agg(child, chr(10) ORDER BY child)) AS h FROM {source} GROUP BY {group}, substring(node, 1, {size}))"
    up = lambda inner: f"(SELECT {group}, node, n, concat(node, ':', CAST(n AS VARCHAR), ':', h) AS child FROM {inner} x)"
    lines = f"(SELECT {group}, sha256(line) AS node, count(*) AS n, concat(line, ':', count(*)) AS child FROM (SELECT {group}, {line} AS line FROM {table}) l GROUP BY {group}, line)"
    return f"SELECT {group}, CAST(n AS BIGINT) AS n, h AS hash FROM {level(up(level(up(level(lines + ' a', 6)) + ' b', 3)) + ' c', 0)} d"
