"""Queries over files, forum pages, ids and paged tools."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.functions import scalar as S
from plaza.operators import opinion as O
from plaza.operators import tools as T
from plaza.plans.registry import load, query
from plaza.plans.views import cte, view
from plaza.sources import files as A
from plaza.sources import pages as P
from plaza.sources.paths import fresh, staged


def _slots(df, key: str, size: int = 5000):
    """``df`` with a slot of about ``size`` rows each, by the remainder of a key that counts up; a slot is written as one file."""
    return df.withColumn("slot", F.col(key) % max(1, -(-df.count() // size)))


@query("a2_json_array", "SELECT c_custkey, c_name FROM customer")
def a2(spark, sf_dir):
    """Files of one array each, of a bounded number of records, read back."""
    path = fresh(spark, "array")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    array = F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("c_custkey", "c_name"))), ",\n"), F.lit("\n]")).alias("value")
    _slots(c, "c_custkey", 500).groupBy("slot").agg(array).repartition("slot").write.partitionBy("slot").text(path)
    return A.read_json_file(spark, path, c.schema).select("c_custkey", "c_name")


@query("a5_discovery", "SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'comment' WHEN event_type = 'click' THEN 'content' ELSE 'author' END AS kind, 'json' AS format FROM events")
def a5(spark, sf_dir):
    path = fresh(spark, "found")
    load(spark, sf_dir, "events").select("event_id", F.expr("CASE event_type WHEN 'view' THEN 'comments' WHEN 'click' THEN 'contents' ELSE 'creators' END").alias("kind")).write.partitionBy("kind").json(path)
    return A.catalog(spark, path, "*.json").select(A.kind_of(F.col("path")).alias("kind"), "format").distinct()


_SLOTS = "WITH s AS (SELECT DISTINCT event_id % greatest(1, CAST(ceil((SELECT count(*) FROM events) / 5000.0) AS BIGINT)) AS slot FROM events) "


@query("a6_fingerprints", _SLOTS + "SELECT count(*) AS files, count(*) AS prints, true AS same_run, false AS same_after_append, false AS same_for_another_query FROM s")
def a6(spark, sf_dir):
    """Fingerprints of all files, and a run id that stays while the files do."""
    path = fresh(spark, "prints")
    e = _slots(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").repartition("slot")
    e.write.partitionBy("slot").json(path)
    prints = A.fingerprints(spark, path).where(F.col("path").endswith(".json"))
    one, again, other = (A.run_id(x, {"platform": "douyin", "query": q, "limit": None}).first()[0] for x, q in ((prints, "a"), (prints.orderBy(F.desc("path")), "a"), (prints, "b")))
    out = staged(prints.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("prints")), "files")
    e.where("slot = 0").write.mode("append").partitionBy("slot").json(path)
    later = A.run_id(A.fingerprints(spark, path).where(F.col("path").endswith(".json")), {"platform": "douyin", "query": "a"}).first()[0]
    return out.select("files", "prints", F.lit(one == again).alias("same_run"), F.lit(one == later).alias("same_after_append"), F.lit(one == other).alias("same_for_another_query"))


@query("a8_latest_batch", _SLOTS + "SELECT slot, true AS has_size FROM s")
def a8(spark, sf_dir):
    """All files of one write are the latest batch, as none of them has siblings in its folder."""
    path = fresh(spark, "batch")
    _slots(load(spark, sf_dir, "events"), "event_id").repartition("slot").write.partitionBy("slot").json(path)
    batch = A.latest_batch(A.catalog(spark, path, "*.json"), 86400)
    return batch.select(F.regexp_extract("path", r"slot=(\d+)", 1).cast("bigint").alias("slot"), (F.col("size") > 0).alias("has_size"))


@query("a9_changed_files", _SLOTS + "SELECT count(*) FILTER (slot % 2 = 0) AS changed FROM s")
def a9(spark, sf_dir):
    """Files that a second write adds for half of the slots."""
    path = fresh(spark, "diff")
    e = _slots(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").repartition("slot")
    e.write.partitionBy("slot").json(path)
    seen = staged(A.catalog(spark, path, "*.json").select("path", "modified", "size"), "seen")
    e.where("slot % 2 = 0").write.mode("append").partitionBy("slot").json(path)
    return A.changed_files(seen, A.catalog(spark, path, "*.json")).agg(F.count("*").alias("changed"))


@query("a4_xlsx", """SELECT path_no, sheet, CAST(row_no AS INT) AS row, a, b FROM (SELECT o_orderkey // 2000 AS path_no, o_orderkey % 2000 // 1000 AS s, o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 2000, o_orderkey % 2000 // 1000 ORDER BY o_orderkey) + 1 AS row_no,
CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b FROM orders) x, (VALUES (0, 'first'), (1, 'second')) t(s2, sheet) WHERE s = s2""")  # fmt: skip
def a4(spark, sf_dir):
    """Workbooks of two sheets with a bounded number of orders, written by tasks and read by sheet."""
    path = fresh(spark, "books")
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"))
    o = o.withColumn("book", F.expr("o_orderkey div 2000")).withColumn("sheet", F.when(F.expr("o_orderkey % 2000 div 1000") == 0, "first").otherwise("second"))
    A.export_workbooks(o, path, "book", "sheet", ["a", "b"], "o_orderkey")
    x = A.read_xlsx(spark, path + "/*.xlsx")
    return x.select(F.regexp_extract("path", r"(\d+)\.xlsx", 1).cast("bigint").alias("path_no"), "sheet", "row", F.col("record")["a"].alias("a"), F.col("record")["b"].alias("b"))


@query("a10_landing_table", "SELECT c_custkey || '' AS user_id, c_name AS nickname, CAST(NULL AS VARCHAR) AS sign FROM customer")
def a10(spark, sf_dir):
    """A landing table written with its schema and read back."""
    from plaza.sources.schemas import LANDING

    schema, path = LANDING["bilibili_up"], fresh(spark, "up")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("nickname"))
    c.select(*[(F.col(f.name) if f.name in c.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    return spark.read.schema(schema).parquet(path).select("user_id", "nickname", "sign")


@query("a11_annotations", "SELECT doc_id AS comment_id, CASE WHEN quality = 1 THEN 'positive' END AS gold_sentiment FROM labels ORDER BY doc_id LIMIT 100")
def a11(spark, sf_dir):
    path = fresh(spark, "gold")
    load(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), F.when(F.col("quality") == 1, "positive").alias("gold_sentiment")).write.json(path)
    return spark.read.schema("comment_id bigint, gold_sentiment string").json(path).orderBy("comment_id").limit(100)


@query("a12_full_scan", cte("comments") + "SELECT comment_id FROM comments WHERE platform = 'douyin'")
def a12(spark, sf_dir):
    return O.in_scope(view(spark, sf_dir, "comments"), "douyin").select("comment_id")


@query("b9_sink_dispatch", "SELECT fmt, count(*) AS n FROM customer, (VALUES ('csv'), ('jsonl'), ('parquet'), ('orc')) t(fmt) GROUP BY fmt")
def b9(spark, sf_dir):
    out = None
    for fmt in ("csv", "jsonl", "parquet", "orc"):
        path = fresh(spark, fmt)
        A.save(load(spark, sf_dir, "customer"), fmt, path)
        n = (spark.read.text(path) if fmt in ("csv", "jsonl") else spark.read.format(fmt).load(path)).agg(F.count("*").alias("n")).select(F.lit(fmt).alias("fmt"), "n")
        out = n if out is None else out.union(n)
    return out


@query("c15_forum_pages", "SELECT page_id, 'p' || page_id AS native_id, 'u' || page_id AS user_nickname, 'x y' AS content, '2024-8-6 3:04' AS publish_time, CAST(page_id % 7 AS BIGINT) AS reply_count FROM pages")
def c15(spark, sf_dir):
    """Each page with one post planted in it."""
    field = F.to_json(F.struct(F.struct(F.concat(F.lit("u"), F.col("page_id")).alias("user_name")).alias("author"), F.struct(F.concat(F.lit("p"), F.col("page_id")).alias("post_id"), (F.col("page_id") % 7).alias("comment_num")).alias("content")))
    post = F.concat(F.lit('<div class="l_post x" data-field="'), F.replace(field, F.lit('"'), F.lit("&quot;")), F.lit('"><div class="d_post_content">x <b>y</b></div><span class="tail-info">2024-8-6 3:04</span></div>'))
    p = load(spark, sf_dir, "pages").select("page_id", F.concat(post, F.col("html")).alias("html"))
    return P.extract(p).where("kind = 'comment'").select("page_id", "native_id", "user_nickname", "content", "publish_time", "reply_count")


@query("c15_forum_records", """SELECT page_id, 'note' AS kind, '9' || page_id AS native_id, CAST(NULL AS VARCHAR) AS parent_id, 'T ' || page_id AS title, 'abs' AS content, 'F' AS user_nickname, '2026-3-15' AS publish_time, 'https://tieba.baidu.com/home/main?id=f' AS user_link, 19 AS reply_count, CAST(NULL AS BIGINT) AS page_count FROM pages
UNION ALL SELECT page_id, 'note', '8' || page_id, NULL, 'L ' || page_id, 'of a list', 'A' || page_id, '', '', page_id % 5, NULL FROM pages
UNION ALL SELECT page_id, 'detail', '7' || page_id, NULL, 'D ' || page_id, 'told', 'u' || page_id, '2024-8-6 22:11', 'https://tieba.baidu.com/home/main?id=u', 786, 13 FROM pages
UNION ALL SELECT page_id, 'comment', 'p' || page_id, NULL, NULL, 'x y', 'u' || page_id, '2024-8-6 22:11', 'https://tieba.baidu.com/home/main?id=u', 4, NULL FROM pages
UNION ALL SELECT page_id, 'sub_comment', 's' || page_id, 'p' || page_id, NULL, 're z', 'n' || page_id, '2024-8-6 22:12', 'https://tieba.baidu.com/home/main?id=n', NULL, NULL FROM pages
UNION ALL SELECT page_id, 'creator', 'name' || page_id, NULL, NULL, NULL, 'name' || page_id, NULL, NULL, NULL, NULL FROM pages""")  # fmt: skip
def c15_records(spark, sf_dir):
    """Each page with a search result, a listed thread, the totals of a thread, a post in a commented section, a reply without its parent and a creator planted in it."""
    key = F.col("page_id").cast("string")
    with_key = lambda html: F.concat(*[x for part in html.split("#") for x in (F.lit(part), key)][:-1])
    card = """<div class="threadcardclass x"><a class="action-link-bg" href="https://tieba.baidu.com/p/9#?fr=u"></a><div class="top-title"><a class="forum-attention p_violet" href="/home/main?id=f">F</a><span>发布于 2026-3-15</span></div>
<div class="title-wrap">T #</div><div class="abstract-wrap">abs</div><a class="comment-link-zone" href="/p/9#?s=1"><span>19</span></a></div>"""
    listed = """<!-- <ul id="thread_list"><li class="j_thread_list clearfix" data-field="{'id':8#,'author_name':'A#','reply_num':""" + "@" + """}"><a class="j_th_tit" href="/p/8#">L #</a><div class="threadlist_abs">of a list</div></li></ul> -->"""
    detail = """<title>D #_百度贴吧</title><meta name="description" content="told"><a id="lzonly_cntn" href="/p/7#?see_lz=1">x</a><div id="thread_theme_5"><ul><li class="l_reply_num"><span class="red">786</span><span class="red">13</span></li></ul></div>"""
    post = """<code><!-- <div class="l_post j_l_post" data-field="{&quot;author&quot;:{&quot;user_name&quot;:&quot;u#&quot;},&quot;content&quot;:{&quot;post_id&quot;:&quot;p#&quot;,&quot;comment_num&quot;:4}}"><a class="p_author_name" href="/home/main?id=u">u#</a><div class="d_post_content">x <b>y</b></div><span class="tail-info">2024-8-6 22:11</span></div> --></code>"""
    reply = """<li class="lzl_single_post j_lzl_s_p" data-field='{"spid":"s#","showname":"n#"}'><a class="j_user_card lzl_p_p" href="/home/main?id=n"></a><span class="lzl_content_main">re <b>z</b></span><span class="lzl_time">2024-8-6 22:12</span></li>"""
    creator = '<div class="userinfo_wrap"><span class="userinfo_username">name#</span></div>'
    html = F.concat(with_key(card), F.replace(with_key(listed), F.lit("@"), (F.col("page_id") % 5).cast("string")), *[with_key(x) for x in (detail, post, reply, creator)], F.coalesce("html", F.lit("")))
    p = load(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.concat(F.lit("p"), key).alias("parent_id"))
    return P.extract(p).select("page_id", "kind", "native_id", "parent_id", "title", "content", "user_nickname", "publish_time", "user_link", "reply_count", "page_count")


@query("d11_parent_depth", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'c' || conv_id END AS parent, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS depth FROM conversations")
def d11(spark, sf_dir):
    raw = F.when(F.col("turn") > 0, F.concat(F.lit("c"), F.col("conv_id"))).when(F.col("conv_id") % 2 == 0, "0").otherwise("")
    p = S.parent_id(raw)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("parent"), F.when(p.isNotNull(), 1).otherwise(0).alias("depth"))


@query("d10_content_kind", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'aweme_' || (o_custkey % 5) END AS kind FROM orders")
def d10(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return load(spark, sf_dir, "orders").select("o_orderkey", S.content_kind(F.when(k == 0, "v"), F.when(k == 1, "i"), (F.col("o_custkey") % 5).cast("string")).alias("kind"))


@query("d20_null_dropping_map", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer")
def d20(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return load(spark, sf_dir, "customer").select("c_custkey", F.size(S.without_nulls(m)).alias("n"))


_TOOL = cte("comments", "analyses", "latest")


_MINE = _TOOL + ", mine AS (SELECT * FROM comments WHERE platform = 'douyin'), mine_latest AS (SELECT l.* FROM latest l WHERE l.comment_id IN (SELECT comment_id FROM mine)) "
_SCOPE = {"platform": "douyin"}


def _scoped(spark, sf_dir):
    return T.agreed({"platform": "douyin", "run_id": None}, _SCOPE), view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses")


@query("g11_tool_statistics", _TOOL + "SELECT content_id, count(*) AS comments, count(l.comment_id) AS analyzed, count(*) FILTER (l.risk_level = 'high') AS high_risk FROM comments c LEFT JOIN latest l ON l.comment_id = c.comment_id GROUP BY content_id")
def g11(spark, sf_dir):
    return T.statistics(view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses"), {})


@query("g11_tool_trend_tail", "WITH t AS (SELECT date_trunc('hour', ts) AS bucket_start, count(*) AS total_comments FROM events WHERE event_id % 97 <> 0 GROUP BY 1) SELECT * FROM t ORDER BY bucket_start DESC LIMIT 48")
def g11b(spark, sf_dir):
    return T.trend_tail(view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses"), {}).select("bucket_start", "total_comments")


@query("g11_tool_content_info", cte("contents") + "SELECT content_id, platform, title, author_id FROM contents WHERE platform = 'douyin'")
def g11_info(spark, sf_dir):
    """The payload does not come along."""
    contents = view(spark, sf_dir, "contents").select("content_id", "platform", "title", "author_id", F.lit("{}").alias("payload"))
    return T.content_info(contents, _scoped(spark, sf_dir)[0])


@query("g11_tool_comments", cte("comments") + "SELECT comment_id FROM comments WHERE platform = 'douyin' ORDER BY published_at ASC NULLS LAST, comment_id LIMIT 50")
def g11_comments(spark, sf_dir):
    scope, comments, _ = _scoped(spark, sf_dir)
    return T.some_comments(comments, scope).select("comment_id")


@query("g11_tool_distribution", _MINE + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM mine_latest), 2) AS percentage FROM mine_latest GROUP BY {d}" for d in O.DIMENSIONS))
def g11_distribution(spark, sf_dir):
    scope, comments, analyses = _scoped(spark, sf_dir)
    return T.label_distribution(comments, analyses, scope)


@query("g11_tool_topics", """WITH s AS (SELECT label AS cluster, count(*) AS size, min(vec_id) AS f FROM embeddings GROUP BY label ORDER BY size DESC, f LIMIT 20),
r AS (SELECT label AS cluster, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) AS rank FROM embeddings) SELECT r.cluster, size, id, rank FROM r JOIN s ON r.cluster = s.cluster WHERE rank <= 3""")  # fmt: skip
def g11_topics(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"))
    order = Window.partitionBy("cluster").orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    return T.topics(v.withColumn("rank", F.row_number().over(order)))


@query("g11_tool_search", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_dot_product(q.v, e.v), 6) AS similarity FROM e q, e
WHERE q.vec_id % 20 = 0 AND e.vec_id % 2 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) SELECT query_id, item_id, similarity, rank FROM r WHERE rank <= 5""")  # fmt: skip
def g11_search(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), "embedding")
    comments = v.select("comment_id", F.when(F.col("comment_id") % 2 == 0, "douyin").otherwise("bilibili").alias("platform"))
    return T.similar_comments(v, v.where("comment_id % 20 = 0").withColumnRenamed("comment_id", "query_id"), comments, {"platform": "douyin"}, 5)


@query("g11_tool_high_risk", _MINE + "SELECT c.comment_id, c.like_count FROM mine c JOIN mine_latest l ON c.comment_id = l.comment_id WHERE l.risk_level = 'high' ORDER BY c.like_count DESC NULLS LAST, c.published_at DESC NULLS LAST, c.comment_id LIMIT 20")
def g11_high_risk(spark, sf_dir):
    scope, comments, analyses = _scoped(spark, sf_dir)
    return T.high_risk_comments(comments, analyses, scope).select("comment_id", "like_count")


@query("b1_csv_append", "SELECT event_type AS kind, 2 * count(*) AS n FROM events GROUP BY event_type")
def b1(spark, sf_dir):
    """Two appends of text files with a header each; every file is read once."""
    path = fresh(spark, "csvs")
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    for _ in range(2):
        A.append(e.withColumnRenamed("kind", "what"), path, "csv", "douyin", "comments", F.lit("2024-01-01"))
    return A.read_csv(spark, f"{path}/platform=douyin/kind=comments").groupBy(F.col("what").alias("kind")).agg(F.count("*").alias("n"))


@query("b3_json_array", "SELECT o_orderkey, o_orderstatus FROM orders")
def b3(spark, sf_dir):
    """All orders as one array in parts, read back line by line."""
    path = fresh(spark, "array")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    A.export_json_array(o, path)
    return A.read_json_parts(spark, path, o.schema)


@query("b5_landing_upsert", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS nickname, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 20 ELSE 10 END AS add_ts,
CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 10 END AS last_modify_ts FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0""")  # fmt: skip
def b5(spark, sf_dir):
    from plaza.operators import merge as U

    c = load(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("nickname"), F.lit(10).alias("add_ts"), F.lit(10).alias("last_modify_ts"))
    return U.landing_upsert(old, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("nickname")), ["user_id"], 20)


@query("b11_quality_artifacts", "SELECT 'labels' AS report, count(*) AS sample, count(*) FILTER (toxic = 1) AS toxic FROM labels")
def b11(spark, sf_dir):
    """A report is appended twice; the newest is read."""
    path = fresh(spark, "reports")
    g = load(spark, sf_dir, "labels")
    for at in (1, 2):
        g.agg(F.count("*").alias("sample"), F.count_if(F.col("toxic") == 1).alias("toxic")).select(F.lit("labels").alias("report"), F.lit(at).alias("generated_at"), "*").write.mode("append").json(path)
    r = spark.read.schema("report string, generated_at int, sample bigint, toxic bigint").json(path)
    return r.groupBy("report").agg(F.max_by(F.struct("sample", "toxic"), "generated_at").alias("x")).select("report", "x.*")


@query("d2_required_string", "SELECT c_custkey, c_custkey % 4 = 0 AS missing FROM customer")
def d2(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", S.optional_string(raw).isNull().alias("missing"))


@query("d24_length_bucket", "SELECT doc_id, CASE WHEN n_chars <= 5 THEN 'short' WHEN n_chars <= 20 THEN 'medium' ELSE 'long' END AS bucket FROM documents")
def d24(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.length_bucket(F.col("n_chars")).alias("bucket"))


@query("f4_run_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 4 THEN 'done' ELSE 'new' END AS status FROM customer")
def f4(spark, sf_dir):
    from plaza.operators import merge as U

    n = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return U.upsert(n.where("id % 5 > 1").withColumn("status", F.lit("new")), n.where("id % 5 < 4").withColumn("status", F.lit("done")), ["id"])


@query("g6_page_bounds", cte("comments") + "SELECT comment_id FROM comments ORDER BY published_at ASC NULLS LAST, comment_id LIMIT 1000")
def g6(spark, sf_dir):
    for bad in ({"limit": 0}, {"limit": 1001}, {"limit": 5, "offset": -1}, {"depth": -1}):
        try:
            O.comments_page(view(spark, sf_dir, "comments"), **bad)
        except ValueError:
            continue
        raise AssertionError(f"{bad} was accepted")
    return O.comments_page(view(spark, sf_dir, "comments"), limit=1000).select("comment_id")


@query("k5_drift_check", """WITH r AS (SELECT count(DISTINCT CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END) AS a, count(*) FILTER (doc_id % 7 = 0 AND upper(text) <> text) AS changed, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 2 = 1 AND upper(text) <> text) AS odd FROM documents)
SELECT 'all' AS what, changed > 0 AS inputs_changed, true AS config_changed FROM r UNION ALL SELECT 'odd', odd > 0, false FROM r UNION ALL SELECT 'none', false, true FROM r""")  # fmt: skip
def k5(spark, sf_dir):
    """Runs against later ones: texts of every seventh comment change, of the odd ones of these, or none; with the same or another configuration."""
    from plaza.operators import semantic as M

    x = view(spark, sf_dir, "texts").select("comment_id", "text")
    run = lambda text, config: M.new_run(spark, x.select("comment_id", F.sha2(text, 256).alias("text_hash")), {"platform": "douyin"}, config, "m")
    seventh, text = F.col("comment_id") % 7 == 0, F.col("text")
    out = None
    for what, changed, config in (("all", seventh, "b"), ("odd", seventh & (F.col("comment_id") % 2 == 1), "a"), ("none", F.lit(False), "b")):
        row = M.drifted(run(text, "a"), run(F.when(changed, F.upper(text)).otherwise(text), config)).select(F.lit(what).alias("what"), "inputs_changed", "config_changed")
        out = row if out is None else out.unionByName(row)
    return out


@query("n1_null_last_page", cte("contents") + "SELECT content_id FROM contents ORDER BY published_at DESC NULLS LAST, content_id LIMIT 500")
def n1(spark, sf_dir):
    return O.contents_page(view(spark, sf_dir, "contents"), limit=500).select("content_id")


@query("n2_top_frequency", "SELECT l_returnflag || l_linestatus AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 3")
def n2(spark, sf_dir):
    return O.frequency(load(spark, sf_dir, "lineitem").select(F.array(F.concat("l_returnflag", "l_linestatus")).alias("v")), "v", 3)


@query("n5_search_top1", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_dot_product(q.v, e.v), 6) AS similarity FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) SELECT query_id, item_id, similarity FROM r WHERE rank = 1""")  # fmt: skip
def n5(spark, sf_dir):
    from plaza.operators import semantic as M

    v = load(spark, sf_dir, "embeddings")
    got = M.search(v.select(F.col("vec_id").alias("item_id"), "embedding"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 2)
    best = got.where("query_id <> item_id").groupBy("query_id").agg(F.min_by(F.struct("item_id", "similarity"), "rank").alias("b"))
    return best.select("query_id", "b.item_id", "b.similarity")


@query("q1_embedder", "SELECT doc_id AS comment_id, 'embedded' AS origin, 2 AS dimension FROM documents")
def q1(spark, sf_dir):
    """A caller's embedder, once for each distinct text."""
    from plaza.operators import semantic as M

    x = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), "text", F.sha2("text", 256).alias("text_hash"))
    none = x.where("false").select("comment_id", "text_hash", F.array(F.lit(0.0).cast("float")).alias("embedding"), F.col("comment_id").alias("created_at"))
    return M.embed(x, none, lambda texts: [[1.0 + len(t), 1.0] for t in texts]).select("comment_id", "origin", F.size("embedding").alias("dimension"))


@query("q2_labeler", "SELECT doc_id, length(text) AS n, CAST(NULL AS VARCHAR) AS failure FROM documents")
def q2(spark, sf_dir):
    """A caller's labeler over the texts of Arrow batches."""
    from plaza.operators import labeling as L

    x = L.apply_labeler(load(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [str(len(t)) for t in texts])
    return x.select("doc_id", F.col("output").cast("bigint").alias("n"), "failure")
