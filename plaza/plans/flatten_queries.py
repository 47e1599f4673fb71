"""Flattening queries: raw API records are built from the given tables as JSON text, then projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.plans.registry import load, query
from plaza.sources import flatten as C


def _raw(df: DataFrame, record: Column, *keep: Column) -> DataFrame:
    return df.select(*keep, F.to_json(record).alias("raw"))


def _s(**fields) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.col(c)).alias(n) for n, c in fields.items()])


def _lit(x) -> Column:
    return F.lit(x)


@query("c1_xhs_notes", """SELECT CAST(doc_id AS VARCHAR) AS note_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE left(text, 255) END AS title, CASE WHEN doc_id % 3 = 0 THEN 'http://sns-video-bd.xhscdn.com/k' || doc_id ELSE '' END AS video_url,
'd' || doc_id || ',u' AS image_list, lang AS tag_list, n_chars AS time FROM documents""")  # fmt: skip
def c1(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    key = F.concat(_lit("k"), F.col("doc_id"))
    rec = _s(
        note_id=F.col("doc_id").cast("string"), type=F.when(F.col("doc_id") % 3 == 0, "video").otherwise("normal"), title=F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), desc="text", time="n_chars",
        video=_s(consumer=F.when(F.col("doc_id") % 6 == 0, _s(origin_video_key=key, originVideoKey=_lit(""))).otherwise(_s(origin_video_key=_lit(""), originVideoKey=key))),
        image_list=F.array(_s(url=_lit("x"), url_default=F.concat(_lit("d"), F.col("doc_id"))), _s(url=_lit("u"), url_default=_lit(""))),
        tag_list=F.array(_s(type=_lit("topic"), name="lang"), _s(type=_lit("other"), name=_lit("no"))),
    )
    return C.xhs_notes(_raw(d, rec)).select("note_id", "title", "video_url", "image_list", "tag_list", "time")


@query("c2_xhs_comments", "SELECT conv_id AS note_id, conv_id * 100 + turn || '' AS comment_id, CASE WHEN turn > 0 THEN CAST(conv_id * 100 AS VARCHAR) ELSE '0' END AS parent_comment_id, 'a,' || role AS pictures FROM conversations")
def c2(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    rec = _s(id=(F.col("conv_id") * 100 + F.col("turn")).cast("string"), content="text", pictures=F.array(_s(url_default=_lit("a")), _s(url_default="role")), target_comment=F.when(F.col("turn") > 0, _s(id=(F.col("conv_id") * 100).cast("string"))))
    return C.xhs_comments(_raw(c, rec, F.col("conv_id").alias("note_id"))).select("note_id", "comment_id", "parent_comment_id", "pictures")


@query("c3_xhs_creators", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 1 THEN 'Female' WHEN c_custkey % 3 = 0 THEN 'Male' END AS gender, CAST(c_custkey AS VARCHAR) AS fans, '0' AS interaction, '{\"t\":\"' || c_mktsegment || '\"}' AS tag_list FROM customer")
def c3(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    rec = _s(basicInfo=_s(gender=F.col("c_custkey") % 3), interactions=F.array(_s(type=_lit("fans"), count=F.col("c_custkey").cast("string"))), tags=F.array(_s(tagType=_lit("t"), name="c_mktsegment")))
    return C.xhs_creators(_raw(c, rec, F.col("c_custkey").alias("user_id"))).select("user_id", "gender", "fans", "interaction", "tag_list")


@query("c4_douyin_awemes", """SELECT CAST(o_orderkey AS VARCHAR) AS aweme_id, 'c' || o_orderkey AS cover_url, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE '' END AS video_download_url, 'z' || o_orderkey AS note_download_url, CAST(o_custkey AS VARCHAR) AS liked_count FROM orders""")
def c4(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    rec = _s(
        aweme_id=key, statistics=_s(digg_count="o_custkey"),
        video=_s(origin_cover=_s(url_list=F.array(_lit("a"), F.concat(_lit("c"), key))), play_addr_h264=_s(url_list=F.array().cast("array<string>")), play_addr=_s(url_list=F.when(F.col("o_orderkey") % 2 == 0, F.array(_lit("a"), _lit("b"))).otherwise(F.array(_lit("a"))))),
        images=F.array(_s(url_list=F.array(_lit("y"), F.concat(_lit("z"), key)))),
    )
    return C.douyin_awemes(_raw(o, rec)).select("aweme_id", "cover_url", "video_download_url", "note_download_url", "liked_count")


@query("c5_douyin_comments", "SELECT CAST(l_orderkey AS VARCHAR) AS aweme_id, l_partkey || '' AS comment_id, 'p2' AS pictures, CAST(l_linenumber AS VARCHAR) AS like_count FROM lineitem WHERE l_suppkey % 2 = 0")
def c5(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string")
    rec = _s(aweme_id=F.when(F.col("l_suppkey") % 2 == 0, key).otherwise("other"), cid=F.col("l_partkey").cast("string"), digg_count="l_linenumber", image_list=F.array(_s(origin_url=_s(url_list=F.array(_lit("p1"), _lit("p2"))))))
    return C.douyin_comments(_raw(x, rec, key.alias("aweme_id"))).select("aweme_id", "comment_id", "pictures", "like_count")


@query("c6_douyin_creators", "SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS gender, c_name AS nickname, CAST(c_nationkey AS VARCHAR) AS follows FROM customer")
def c6(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return C.douyin_creators(_raw(c, _s(user=_s(gender=F.col("c_custkey") % 4, nickname="c_name", following_count="c_nationkey")), F.col("c_custkey").alias("user_id"))).select("user_id", "gender", "nickname", "follows")


@query("c7_bilibili_videos", "SELECT CAST(doc_id AS VARCHAR) AS video_id, left(text, 500) AS title, source AS nickname, CAST(n_chars AS VARCHAR) AS video_play_count, '' AS video_coin_count FROM documents")
def c7(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return C.bilibili_videos(_raw(d, _s(View=_s(aid="doc_id", title="text", owner=_s(name="source"), stat=_s(view="n_chars"))))).select("video_id", "title", "nickname", "video_play_count", "video_coin_count")


@query("c7_bilibili_ups", "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS nickname, CAST(c_nationkey AS INT) AS user_rank FROM customer")
def c7b(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return C.bilibili_ups(_raw(c, _s(Card=_s(card=_s(mid="c_custkey", name="c_name", level_info=_s(current_level="c_nationkey")))))).select("user_id", "nickname", "user_rank")


@query("c8_bilibili_comments", "SELECT conv_id AS video_id, CAST(conv_id * 100 + turn AS VARCHAR) AS comment_id, role AS nickname, sha256(text) AS h FROM conversations")
def c8(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    out = C.bilibili_comments(_raw(c, _s(rpid=F.col("conv_id") * 100 + F.col("turn"), content=_s(message="text"), member=_s(uname="role")), F.col("conv_id").alias("video_id")))
    return out.select("video_id", "comment_id", "nickname", F.sha2("content", 256).alias("h"))


@query("c9_bilibili_contacts", "SELECT CAST(n_nationkey AS VARCHAR) AS up_id, CAST(c_custkey AS VARCHAR) AS fan_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(n_nationkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c9(spark, sf_dir):
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    lists = c.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), _lit("s").alias("sign"), _lit("a").alias("avatar"), F.to_json(F.array(_s(mid="c_custkey", uname="c_name"))).alias("raw"))
    return C.bilibili_contacts(lists, False).select("up_id", "fan_id").union(C.bilibili_contacts(lists, True).select("up_id", "fan_id"))


@query("c10_bilibili_dynamics", "SELECT CAST(event_id AS VARCHAR) AS dynamic_id, upper(event_type) AS type, '' AS text, CAST(user_id AS INT) AS total_liked FROM events")
def c10(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rec = _s(id_str=F.col("event_id").cast("string"), type=F.concat(_lit("DYNAMIC_TYPE_"), F.upper("event_type")), modules=_s(module_stat=_s(like=_s(count="user_id"))))
    return C.bilibili_dynamics(_raw(e, rec, F.col("user_id").alias("user_id"), F.col("event_type").alias("user_name"))).select("dynamic_id", "type", "text", "total_liked")


@query("c11_weibo_notes", "SELECT CAST(event_id AS VARCHAR) AS note_id, 'a b' AS content, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS create_time, event_type AS ip_location FROM events")
def c11(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    when = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), _lit(" +0000 "), F.date_format("ts", "yyyy"))
    rec = _s(mblog=_s(id="event_id", text=_lit("<p>a <b>b</b></p>"), created_at=when, region_name=F.concat(_lit("发布于 "), F.col("event_type"))))
    return C.weibo_notes(_raw(e, rec)).select("note_id", "content", "create_time", "ip_location")


@query("c12_weibo_cards", "SELECT CAST(o_orderkey AS VARCHAR) AS note_id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'g' || o_orderkey FROM orders")
def c12(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    inner = F.concat(_lit("g"), F.col("o_orderkey"))
    rec = _s(cards=F.array(_s(card_type=F.when(F.col("o_orderkey") % 2 == 0, 9).otherwise(4), mblog=_s(id=F.col("o_orderkey").cast("string")), card_group=F.array(_s(card_type=_lit(9), mblog=_s(id=inner))))))
    return C.weibo_notes(C.weibo_cards(_raw(o, rec))).select("note_id")


@query("c13_kuaishou_comments", "SELECT CAST(l_orderkey AS VARCHAR) AS video_id, CAST(l_partkey AS VARCHAR) AS comment_id, CAST(l_suppkey AS VARCHAR) AS user_id, CAST(l_linenumber AS VARCHAR) AS sub_comment_count FROM lineitem")
def c13(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    old = F.col("l_orderkey") % 2 == 0
    rec = _s(comment_id=F.when(~old, F.col("l_partkey")), commentId=F.when(old, F.col("l_partkey").cast("string")), author_id=F.when(~old, F.col("l_suppkey")), authorId=F.when(old, F.col("l_suppkey")), commentCount=F.when(~old, F.col("l_linenumber")), subCommentCount=F.when(old, F.col("l_linenumber")))
    return C.kuaishou_comments(_raw(x, rec, F.col("l_orderkey").cast("string").alias("video_id"))).select("video_id", "comment_id", "user_id", "sub_comment_count")


@query("c14_tieba_posts", "SELECT o_orderkey AS note_id, CAST(o_orderkey AS VARCHAR) AS comment_id, 'ab' AS content, c_name AS user_nickname FROM orders JOIN customer ON o_custkey = c_custkey")
def c14(spark, sf_dir):
    x = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rec = _s(
        user_list=F.array(_s(id="c_custkey", name_show="c_name", portrait=_lit("p")), _s(id=_lit(-1), name_show=_lit("x"), portrait=_lit(""))),
        post_list=F.array(_s(id="o_orderkey", author_id="o_custkey", content=F.array(_s(text=_lit("a"), c=_lit("z")), _s(text=_lit(""), c=_lit("b"))))),
    )
    return C.tieba_posts(_raw(x, rec, F.col("o_orderkey").alias("note_id"))).select("note_id", "comment_id", "content", "user_nickname")


@query("c16_zhihu_contents", """SELECT CAST(doc_id AS VARCHAR) AS content_id, CASE WHEN doc_id % 4 = 0 THEN 'https://www.zhihu.com/question/7/answer/' || doc_id WHEN doc_id % 4 = 1 THEN 'https://zhuanlan.zhihu.com/p/' || doc_id ELSE 'v' END AS content_url,
CASE WHEN doc_id % 4 = 2 THEN '' ELSE lang END AS content_text FROM documents WHERE doc_id % 4 < 3""")  # fmt: skip
def c16(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[_lit(x) for x in ("answer", "article", "zvideo", "pin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rec = _s(id="doc_id", type=kind, question=_s(id=_lit(7)), content=F.concat(_lit("<p>"), F.col("lang"), _lit("</p><script>x</script>")), video_url=_lit("v"))
    return C.zhihu_contents(_raw(d, rec)).select("content_id", "content_url", "content_text")


@query("c17_page_state", "SELECT page_id, url, page_id * 2 AS user_count FROM pages")
def c17(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    state = F.to_json(_s(pageUrl="url", userCount=F.col("page_id") * 2))
    html = F.concat(_lit("<html><script>window.__INITIAL_STATE__="), F.regexp_replace(state, r"\}$", ',"x":undefined}'), _lit("</script>"), F.col("html"))
    x = p.select("page_id", F.from_json(C.snake_keys(C.page_state(html, "initial_state")), "page_url string, user_count bigint").alias("s"))
    return x.select("page_id", F.col("s.page_url").alias("url"), "s.user_count")


@query("c18_nested_replies", "SELECT o_orderkey AS note_id, CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id FROM orders UNION ALL SELECT l_orderkey, l_orderkey || '-' || l_linenumber, CAST(l_orderkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def c18(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_s(id=F.concat_ws("-", "l_orderkey", "l_linenumber"))).alias("subs"))
    o = load(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    x = C.with_replies(_raw(o, _s(id=F.col("o_orderkey").cast("string"), sub_comments=F.coalesce("subs", F.array().cast("array<struct<id:string>>"))), F.col("o_orderkey").alias("note_id")), "sub_comments", "id")
    return x.select("note_id", F.get_json_object("raw", "$.id").alias("id"), "parent_id")


@query("c11_weibo_comments", """SELECT CAST(o_orderkey % 50 AS VARCHAR) AS note_id, CAST(o_orderkey AS VARCHAR) AS comment_id, 'to x' AS content, CAST(o_orderkey % 9 AS VARCHAR) AS sub_comment_count, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS parent_comment_id,
o_orderstatus AS ip_location, CAST(o_custkey AS VARCHAR) AS user_id FROM orders""")  # fmt: skip
def c11_comments(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rec = _s(id="o_orderkey", text=_lit("to <b>x</b>"), total_number=F.col("o_orderkey") % 9, rootid=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")), source=F.concat(_lit("来自"), F.col("o_orderstatus")), user=_s(id="o_custkey"))
    return C.weibo_comments(_raw(o, rec, (F.col("o_orderkey") % 50).cast("string").alias("note_id"))).select("note_id", "comment_id", "content", "sub_comment_count", "parent_comment_id", "ip_location", "user_id")


@query("c11_weibo_creators", "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS nickname, c_mktsegment AS ip_location, CAST(c_custkey * 2 AS VARCHAR) AS follows, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey * 3 AS VARCHAR) END AS fans, '' AS tag_list FROM customer")
def c11_creators(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    rec = _s(screen_name="c_name", source=F.concat(_lit("来自"), F.col("c_mktsegment")), follow_count=F.col("c_custkey") * 2, followers_count=F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 3))
    return C.weibo_creators(_raw(c, rec, F.col("c_custkey").cast("string").alias("user_id"))).select("user_id", "nickname", "ip_location", "follows", "fans", "tag_list")


@query("c13_kuaishou_videos", """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_orderpriority AS title, o_orderkey * 1000 AS create_time, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey % 7 AS VARCHAR) AS liked_count,
'https://www.kuaishou.com/short-video/' || o_orderkey AS video_url FROM orders WHERE o_orderkey % 5 <> 0""")  # fmt: skip
def c13_videos(spark, sf_dir):
    """A record without a photo id is no video."""
    o = load(spark, sf_dir, "orders")
    photo = _s(id=F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")), caption="o_orderpriority", timestamp=F.col("o_orderkey") * 1000, realLikeCount=F.col("o_orderkey") % 7)
    return C.kuaishou_videos(_raw(o, _s(type=_lit(1), photo=photo, author=_s(id=F.col("o_custkey").cast("string"))))).select("video_id", "title", "create_time", "user_id", "liked_count", "video_url")


@query("c13_kuaishou_creators", "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS nickname, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CAST(c_custkey * 2 AS VARCHAR) AS follows, CAST(c_custkey * 3 AS VARCHAR) AS fans, CAST(c_custkey AS VARCHAR) AS interaction FROM customer")
def c13_creators(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    rec = _s(profile=_s(user_name="c_name", gender=F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M")), ownerCount=_s(follow=F.col("c_custkey") * 2, fan=F.col("c_custkey") * 3, photo_public="c_custkey"))
    return C.kuaishou_creators(_raw(c, rec, F.col("c_custkey").cast("string").alias("user_id"))).select("user_id", "nickname", "gender", "follows", "fans", "interaction")


@query("c14_tieba_search", """SELECT CAST(o_orderkey AS VARCHAR) AS note_id, o_orderpriority AS title, 'https://tieba.baidu.com/p/' || o_orderkey AS note_url, CAST(o_orderkey % 11 AS INT) AS total_replay_num FROM orders WHERE o_orderkey % 3 < 2""")
def c14_search(spark, sf_dir):
    """Two cards a result, of which threads with an id count."""
    o = load(spark, sf_dir, "orders")
    data = _s(tid=F.col("o_orderkey").cast("string"), title=F.concat(_lit(" "), F.col("o_orderpriority"), _lit(" ")), post_num=F.col("o_orderkey") % 11)
    kind = F.col("o_orderkey") % 3
    card = _s(cardInfo=F.when(kind == 0, "thread"), cardStyle=F.when(kind == 1, "thread").otherwise("user"), data=data)
    return C.tieba_search(_raw(o, _s(data=_s(card_list=F.array(card, _s(cardInfo=_lit("thread"), cardStyle=_lit("x"), data=_s(tid=F.lit(None).cast("string"), title=_lit("t"), post_num=F.lit(0).cast("bigint")))))))).select("note_id", "title", "note_url", "total_replay_num")


@query("c16_zhihu_comments", """SELECT CAST(l_orderkey AS VARCHAR) AS content_id, l_orderkey || '-' || l_linenumber AS comment_id, 'a b' AS content, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS ip_location, CAST(l_linenumber AS INT) AS sub_comment_count,
'https://www.zhihu.com/people/u' || l_suppkey AS user_link FROM lineitem""")  # fmt: skip
def c16_comments(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    tags = F.array(_s(type=_lit("other"), text=_lit("no")), _s(type=F.when(F.col("l_linenumber") % 2 == 0, "ip_info").otherwise("none"), text="l_returnflag"))
    rec = _s(id=F.concat_ws("-", "l_orderkey", "l_linenumber"), content=_lit("<p>a <b>b</b></p>"), comment_tag=tags, child_comment_count="l_linenumber", author=_s(url_token=F.concat(_lit("u"), F.col("l_suppkey"))))
    return C.zhihu_comments(_raw(x, rec, F.col("l_orderkey").cast("string").alias("content_id"), _lit("answer").alias("content_type"))).select("content_id", "comment_id", "content", "ip_location", "sub_comment_count", "user_link")


@query("c14_tieba_details", """SELECT CAST(o_orderkey AS VARCHAR) AS note_id, 'T ' || o_orderkey AS title, 'ab' AS "desc", CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'n' || c_custkey END AS user_nickname, 'https://tieba.baidu.com/home/main?id=tb.1' AS user_link,
'go吧' AS tieba_name, CAST(o_orderkey % 13 AS INT) AS total_replay_num, CAST(o_orderkey % 5 AS INT) AS total_replay_page, 'x' AS ip_location FROM orders JOIN customer ON o_custkey = c_custkey""")
def c14_details(spark, sf_dir):
    x = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    even = F.col("o_orderkey") % 2 == 0
    rec = _s(
        thread=_s(id=F.when(even, F.col("o_orderkey")), tid=F.when(~even, F.col("o_orderkey").cast("string")), title=F.concat(_lit("T  "), F.col("o_orderkey")), reply_num=F.col("o_orderkey") % 13), forum=_s(name=_lit("go")), page=_s(total_page=F.col("o_orderkey") % 5),
        first_floor=_s(author_id="c_custkey", content=F.array(_s(text=_lit("a"), c=_lit("z")), _s(text=_lit(""), c=_lit("b")))),
        user_list=F.array(_s(id="c_custkey", name=F.concat(_lit("n"), F.col("c_custkey")), name_show=F.when(even, F.col("c_name")), portrait=_lit("tb.1"), ip_address=_lit("x"))),
    )
    return C.tieba_details(_raw(x, rec)).select("note_id", "title", "desc", "user_nickname", "user_link", "tieba_name", "total_replay_num", "total_replay_page", "ip_location")


@query("c14_tieba_creators", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS user_name, CASE WHEN c_custkey % 2 = 0 THEN c_phone ELSE c_name END AS nickname, CASE c_custkey % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS gender,
CAST(c_custkey * 2 AS INT) AS follows, CAST(c_custkey * 3 AS INT) AS fans, '7.8' AS registration_duration FROM (SELECT *, 'p' || c_custkey AS c_phone FROM customer) x WHERE c_custkey % 7 <> 0""")
def c14_creators(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    user = _s(id="c_custkey", name="c_name", name_show=F.when(F.col("c_custkey") % 2 == 0, F.concat(_lit("p"), F.col("c_custkey"))), sex=F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3), concern_num=F.col("c_custkey") * 2, fans_num=F.col("c_custkey") * 3, tb_age=_lit("7.8"))
    return C.tieba_creators(_raw(c, _s(data=_s(user=F.when(F.col("c_custkey") % 7 != 0, user))))).select("user_id", "user_name", "nickname", "gender", "follows", "fans", "registration_duration")


@query("c14_creator_threads", "SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS note_id, CAST(0 AS INT) AS at FROM orders UNION ALL SELECT CAST(o_custkey AS VARCHAR), '9' || o_orderkey, CAST(2 AS INT) FROM orders")
def c14_threads(spark, sf_dir):
    """Feeds of three items: a thread by its tid, one without an id, and one by its id."""
    o = load(spark, sf_dir, "orders")
    item = lambda tid, id_: _s(type=_lit(1), thread_info=_s(tid=tid, id=id_))
    none = F.lit(None).cast("string")
    feed = F.array(item(F.col("o_orderkey").cast("string"), _lit("0")), item(none, none), item(none, F.concat(_lit("9"), F.col("o_orderkey"))))
    return C.tieba_creator_threads(_raw(o, _s(data=_s(list=feed)), F.col("o_custkey").cast("string").alias("user_id"))).select("user_id", "note_id", "at")


@query("c14_forum_threads", "SELECT o_orderkey || x AS note_id, 'https://tieba.baidu.com/p/' || o_orderkey || x AS note_url, 'go吧' AS tieba_name, 'https://tieba.baidu.com/f?kw=go' AS tieba_link FROM orders, (VALUES ('1'), ('2')) v(x)")
def c14_forum(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rec = _s(forum=_s(name=_lit("go"), tids=F.concat(F.col("o_orderkey"), _lit("1, "), F.col("o_orderkey"), _lit("2,"))))
    return C.tieba_forum_threads(_raw(o, rec)).select("note_id", "note_url", "tieba_name", "tieba_link")


@query("c16_zhihu_creators", """SELECT 'id' || page_id AS user_id, 'https://www.zhihu.com/people/t' || page_id AS user_link, 'n' || page_id AS user_nickname, 't' || page_id AS url_token, CASE page_id % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unknown' END AS gender,
page_id * 2 AS fans, page_id * 3 AS get_voteup_count FROM pages WHERE page_id % 5 <> 0""")
def c16_creators(spark, sf_dir):
    """Pages that carry the state of one user, which in every fifth is another one."""
    p = load(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    user = _s(id=F.concat(_lit("id"), key), name=F.concat(_lit("n"), key), gender=F.when(F.col("page_id") % 3 == 2, -1).otherwise(F.col("page_id") % 3), followerCount=F.col("page_id") * 2, voteupCount=F.col("page_id") * 3)
    state = F.to_json(_s(initialState=_s(entities=_s(users=F.create_map(F.when(F.col("page_id") % 5 == 0, "other").otherwise(F.concat(_lit("t"), key)), user)))))
    html = F.concat(_lit('<html><script id="js-initialData" type="text/json">'), state, _lit("</script>"), F.coalesce("html", _lit("")))
    return C.zhihu_creators(p.select(html.alias("html"), F.concat(_lit("t"), key).alias("url_token"))).select("user_id", "user_link", "user_nickname", "url_token", "gender", "fans", "get_voteup_count")
