"""Word counts with custom words, and word segmentation by a learned dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaza.functions.segment import SCALE, Dictionary, learned, segmented
from plaza.operators import opinion as O
from plaza.plans.registry import load, query

_LONGEST, _LEAST, _RUN = 4, 20, 7

# The path through a run: scores of all its beginnings in a list, one more a step, from the costs of the up to four words that end at each place; then back from the end.
Q4_SQL = f"""
WITH RECURSIVE runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS run FROM documents) x GROUP BY run),
words AS (SELECT run AS word, n FROM runs WHERE length(run) BETWEEN 2 AND {_LONGEST} AND n >= {_LEAST}),
total AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM words),
costs AS (SELECT word, CAST(round(-{SCALE} * ln(n / t)) AS BIGINT) AS c FROM words, total),
long AS (SELECT run, n FROM runs WHERE length(run) >= {_RUN}),
edges AS (SELECT run, list(CASE WHEN l = 1 THEN coalesce(c, CAST(round({SCALE} * ln(t)) AS BIGINT) + {SCALE}) ELSE c END ORDER BY j, l) AS e
          FROM (SELECT run, j, unnest(range(1, {_LONGEST + 1})) AS l FROM (SELECT run, unnest(range(1, length(run) + 1)) AS j FROM long) a) b
          CROSS JOIN total LEFT JOIN costs ON j >= l AND costs.word = substring(run, j - l + 1, l) GROUP BY run),
dp AS (SELECT long.run, n, e, 0 AS k, CAST([0] AS BIGINT[]) AS score, CAST([] AS BIGINT[]) AS back FROM long JOIN edges USING (run)
       UNION ALL
       SELECT run, n, e, k + 1, list_append(score, b.c), list_append(back, -b.l)
       FROM (SELECT *, list_min(list_filter(list_transform(range(1, least({_LONGEST}, k + 1) + 1), lambda l: {{'c': score[k + 2 - l] + e[k * {_LONGEST} + l], 'l': -l}}), lambda x: x.c IS NOT NULL)) AS b FROM dp WHERE k < length(run)) s),
way AS (SELECT run, n, back, k FROM dp WHERE k = length(run) UNION ALL SELECT run, n, back, k - back[k] FROM way WHERE k > back[k])
SELECT substring(run, k - back[k] + 1, back[k]) AS word, CAST(sum(n) AS BIGINT) AS n FROM way GROUP BY 1
"""


@query("q4_segmenter", Q4_SQL)
def q4(spark, sf_dir):
    """The long words of the documents as runs without spaces, cut by a dictionary of the short ones that the documents use."""
    d = load(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\P{L}+")).alias("word")).where("word <> ''")
    runs = words.where(F.length("word") >= _RUN).groupBy(F.col("word").alias("run")).agg(F.count("*").alias("n"))
    return segmented(runs, Dictionary(learned(words, _LONGEST, _LEAST)))


_OWN = ["on the", "the th", "idiot"]


@query("h23_custom_words", """WITH t AS (SELECT lower(coalesce(text, '')) AS x FROM documents),
w AS (SELECT unnest(regexp_extract_all(x, 'on the|the th|idiot')) AS word FROM t UNION ALL SELECT unnest(regexp_extract_all(regexp_replace(x, 'on the|the th|idiot', ' ', 'g'), '\\p{L}+')) FROM t)
SELECT word, count(*) AS count FROM w GROUP BY word ORDER BY count DESC, word LIMIT 30""")
def h23_custom(spark, sf_dir):
    """Custom words of several parts; what they consist of is not counted beside them."""
    return O.word_frequency(F.col("text"), load(spark, sf_dir, "documents"), top_k=30, custom=_OWN)
