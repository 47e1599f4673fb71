"""Nested API records to flat landing rows, one projection a platform and kind.

Input is a DataFrame with one JSON text column ``raw`` (and ids that the caller knows, such as the note of a comment). It is parsed once to
a VARIANT column, from which fields are taken by path; a wrong type is null. Times stay epoch numbers, counts stay text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import scalar as S

_V = "_v"


def parsed(df: DataFrame) -> DataFrame:
    return df.withColumn(_V, F.try_parse_json("raw"))


def at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(_V, f"$.{path}", kind)


def _first(*paths: str) -> Column:
    """The first value that is there and not empty."""
    return F.coalesce(*[F.nullif(at(p), F.lit("")) for p in paths])


def _or(path: str, default: str) -> Column:
    return F.coalesce(at(path), F.lit(default))


def _list(path: str, item: str = "string") -> Column:
    return F.coalesce(at(path, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def _rows(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


# Xhs -----------------------------------------------------------------------------------------------------------------------------


def xhs_notes(df: DataFrame) -> DataFrame:
    key = _first("video.consumer.origin_video_key", "video.consumer.originVideoKey")
    streams = F.array_join(F.transform(_list("video.media.stream.h264", "struct<master_url:string>"), lambda v: v["master_url"]), ",")
    video = F.when(at("type") != "video", "").when(key.isNotNull(), F.concat(F.lit("http://sns-video-bd.xhscdn.com/"), key)).otherwise(streams)
    image = F.transform(_list("image_list", "struct<url:string,url_default:string>"), lambda i: F.coalesce(F.nullif(i["url_default"], F.lit("")), i["url"], F.lit("")))
    tags = F.transform(F.filter(_list("tag_list", "struct<type:string,name:string>"), lambda t: t["type"] == "topic"), lambda t: F.coalesce(t["name"], F.lit("")))
    link = F.concat(F.lit("https://www.xiaohongshu.com/explore/"), at("note_id"), F.lit("?xsec_token="), _or("xsec_token", "None"), F.lit("&xsec_source=pc_search"))
    return _rows(parsed(df), {
        "note_id": at("note_id"), "type": at("type"), "title": F.coalesce(F.nullif(at("title"), F.lit("")), F.substring(_or("desc", ""), 1, 255)), "desc": _or("desc", ""), "video_url": F.coalesce(video, F.lit("")),
        "time": at("time", "bigint"), "last_update_time": F.coalesce(at("last_update_time", "bigint"), F.lit(0)), "user_id": at("user.user_id"), "nickname": at("user.nickname"), "avatar": at("user.avatar"),
        "liked_count": at("interact_info.liked_count"), "collected_count": at("interact_info.collected_count"), "comment_count": at("interact_info.comment_count"), "share_count": at("interact_info.share_count"),
        "ip_location": _or("ip_location", ""), "image_list": F.array_join(image, ","), "tag_list": F.array_join(tags, ","), "note_url": link, "xsec_token": at("xsec_token"),
    })


def xhs_comments(df: DataFrame) -> DataFrame:
    """``df`` has note_id."""
    pictures = F.array_join(F.transform(_list("pictures", "struct<url_default:string>"), lambda p: F.coalesce(p["url_default"], F.lit(""))), ",")
    return _rows(parsed(df), {
        "comment_id": at("id"), "create_time": at("create_time", "bigint"), "ip_location": at("ip_location"), "content": at("content"), "user_id": at("user_info.user_id"), "nickname": at("user_info.nickname"),
        "avatar": at("user_info.image"), "sub_comment_count": F.coalesce(at("sub_comment_count", "int"), F.lit(0)), "pictures": pictures, "parent_comment_id": _or("target_comment.id", "0"), "like_count": _or("like_count", "0"),
    }, "note_id")


def xhs_creators(df: DataFrame) -> DataFrame:
    """``df`` has user_id."""
    counts = F.map_from_entries(F.transform(_list("interactions", "struct<type:string,count:string>"), lambda i: F.struct(i["type"], i["count"])))
    tags = F.to_json(F.map_from_entries(F.transform(_list("tags", "struct<tagType:string,name:string>"), lambda t: F.struct(t["tagType"], t["name"]))))
    return _rows(parsed(df), {
        "nickname": at("basicInfo.nickname"), "gender": S.gender("xhs", at("basicInfo.gender")), "avatar": at("basicInfo.images"), "desc": at("basicInfo.desc"), "ip_location": at("basicInfo.ipLocation"),
        **{n: F.coalesce(counts[n], F.lit("0")) for n in ("follows", "fans", "interaction")}, "tag_list": tags,
    }, "user_id")


# Douyin --------------------------------------------------------------------------------------------------------------------------


def _urls(path: str) -> Column:
    return F.nullif(_list(f"{path}.url_list"), F.array().cast("array<string>"))


def douyin_awemes(df: DataFrame) -> DataFrame:
    cover = F.coalesce(_urls("video.raw_cover"), F.when(at("video.raw_cover", "variant").isNull(), _urls("video.origin_cover")))
    play = F.coalesce(_urls("video.play_addr_h264"), _urls("video.play_addr_256"), _urls("video.play_addr"))
    images = F.filter(F.transform(_list("images", "struct<url_list:array<string>>"), lambda i: F.try_element_at(i["url_list"], F.lit(-1))), lambda u: u.isNotNull())
    return _rows(parsed(df), {
        "aweme_id": at("aweme_id"), "aweme_type": _or("aweme_type", "None"), "title": _or("desc", ""), "desc": _or("desc", ""), "create_time": at("create_time", "bigint"),
        "user_id": at("author.uid"), "sec_uid": at("author.sec_uid"), "short_user_id": at("author.short_id"), "user_unique_id": at("author.unique_id"), "user_signature": at("author.signature"), "nickname": at("author.nickname"),
        "avatar": F.coalesce(F.try_element_at(_list("author.avatar_thumb.url_list"), F.lit(1)), F.lit("")),
        **{n: _or(f"statistics.{p}", "None") for n, p in (("liked_count", "digg_count"), ("collected_count", "collect_count"), ("comment_count", "comment_count"), ("share_count", "share_count"))},
        "ip_location": _or("ip_label", ""), "aweme_url": F.concat(F.lit("https://www.douyin.com/video/"), at("aweme_id")), "cover_url": F.coalesce(F.try_element_at(cover, F.lit(2)), F.lit("")),
        "video_download_url": F.when(F.size(play) >= 2, F.element_at(play, -1)).otherwise(""), "music_download_url": _or("music.play_url.uri", ""), "note_download_url": F.array_join(images, ","),
    })


def douyin_comments(df: DataFrame) -> DataFrame:
    """``df`` has aweme_id; records of another aweme are left out."""
    avatar = F.coalesce(*[_urls(f"user.{n}") for n in ("avatar_medium", "avatar_300x300", "avatar_168x168", "avatar_thumb")])
    pictures = F.filter(F.transform(_list("image_list", "struct<origin_url:struct<url_list:array<string>>>"), lambda i: F.try_element_at(i["origin_url"]["url_list"], F.lit(2))), lambda u: u.isNotNull())
    return _rows(parsed(df).where(at("aweme_id") == F.col("aweme_id")), {
        "comment_id": at("cid"), "create_time": at("create_time", "bigint"), "ip_location": _or("ip_label", ""), "content": at("text"), "user_id": at("user.uid"), "sec_uid": at("user.sec_uid"), "short_user_id": at("user.short_id"),
        "user_unique_id": at("user.unique_id"), "user_signature": at("user.signature"), "nickname": at("user.nickname"), "avatar": F.coalesce(F.try_element_at(avatar, F.lit(1)), F.lit("")),
        "sub_comment_count": _or("reply_comment_total", "0"), "like_count": _or("digg_count", "0"), "parent_comment_id": _or("reply_id", "0"), "pictures": F.array_join(pictures, ","),
    }, "aweme_id")


def douyin_creators(df: DataFrame) -> DataFrame:
    """``df`` has user_id."""
    return _rows(parsed(df), {
        "nickname": at("user.nickname"), "gender": F.coalesce(S.gender("douyin", at("user.gender")), F.lit("Unknown")), "desc": at("user.signature"), "ip_location": at("user.ip_location"),
        "avatar": F.concat(F.lit("https://p3-pc.douyinpic.com/img/"), _or("user.avatar_300x300.uri", "None"), F.lit("~c5_300x300.jpeg?from=2956013662")),
        **{n: _or(f"user.{p}", "0") for n, p in (("follows", "following_count"), ("fans", "max_follower_count"), ("interaction", "total_favorited"), ("videos_count", "aweme_count"))},
    }, "user_id")


# Bilibili ------------------------------------------------------------------------------------------------------------------------


def bilibili_videos(df: DataFrame) -> DataFrame:
    stats = {"liked_count": "like", "disliked_count": "dislike", "video_play_count": "view", "video_favorite_count": "favorite", "video_share_count": "share", "video_coin_count": "coin", "video_danmaku": "danmaku", "video_comment": "reply"}
    return _rows(parsed(df), {
        "video_id": at("View.aid"), "video_type": F.lit("video"), "title": F.substring(_or("View.title", ""), 1, 500), "desc": F.substring(_or("View.desc", ""), 1, 500), "create_time": at("View.pubdate", "bigint"),
        "user_id": at("View.owner.mid"), "nickname": at("View.owner.name"), "avatar": _or("View.owner.face", ""), **{n: _or(f"View.stat.{p}", "") for n, p in stats.items()},
        "video_url": F.concat(F.lit("https://www.bilibili.com/video/av"), at("View.aid")), "video_cover_url": _or("View.pic", ""),
    })


def bilibili_ups(df: DataFrame) -> DataFrame:
    card = "Card.card."
    return _rows(parsed(df), {
        "user_id": at(f"{card}mid"), "nickname": at(f"{card}name"), "sex": at(f"{card}sex"), "sign": at(f"{card}sign"), "avatar": at(f"{card}face"), "total_fans": at(f"{card}fans", "int"),
        "total_liked": at("Card.like_num", "int"), "user_rank": at(f"{card}level_info.current_level", "int"), "is_official": at(f"{card}official_verify.type", "int"),
    })


def bilibili_comments(df: DataFrame) -> DataFrame:
    """``df`` has video_id."""
    return _rows(parsed(df), {
        "comment_id": at("rpid"), "parent_comment_id": _or("parent", "0"), "create_time": at("ctime", "bigint"), "content": at("content.message"), "user_id": at("member.mid"), "nickname": at("member.uname"),
        "sex": at("member.sex"), "sign": at("member.sign"), "avatar": at("member.avatar"), "sub_comment_count": _or("rcount", "0"), "like_count": _or("like", "0"),
    }, "video_id")


def bilibili_contacts(df: DataFrame, followings: bool) -> DataFrame:
    """Edges of ``df`` (id, name, sign, avatar, raw: a list of people); the people are fans, or with ``followings`` the followed."""
    people = parsed(df).withColumn("p", F.explode(F.try_variant_get(_V, "$", "array<struct<mid:string,uname:string,sign:string,face:string>>")))
    me = {"id": F.col("id"), "name": F.col("name"), "sign": F.col("sign"), "avatar": F.col("avatar")}
    they = {"id": F.col("p.mid"), "name": F.col("p.uname"), "sign": F.col("p.sign"), "avatar": F.col("p.face")}
    up, fan = (they, me) if followings else (me, they)
    return people.select(*[c.cast("string").alias(f"up_{n}") for n, c in up.items()], *[c.cast("string").alias(f"fan_{n}") for n, c in fan.items()])


def bilibili_dynamics(df: DataFrame) -> DataFrame:
    """``df`` has user_id and user_name."""
    return _rows(parsed(df), {
        "dynamic_id": at("id_str"), "text": _or("modules.module_dynamic.desc.text", ""), "type": F.element_at(F.split(at("type"), "_"), -1), "pub_ts": at("modules.module_author.pub_ts", "bigint"),
        **{n: at(f"modules.module_stat.{p}.count", "int") for n, p in (("total_comments", "comment"), ("total_forwards", "forward"), ("total_liked", "like"))},
    }, "user_id", "user_name")


# Weibo ---------------------------------------------------------------------------------------------------------------------------


def _weibo_time(path: str) -> dict[str, Column]:
    t = S.rfc2822_time(at(path))
    return {"create_time": F.unix_seconds(t), "create_date_time": F.concat(F.date_format(F.from_utc_timestamp(t, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))}


def _weibo_user(path: str) -> dict[str, Column]:
    return {"user_id": at(f"{path}.id"), "nickname": _or(f"{path}.screen_name", ""), "gender": _or(f"{path}.gender", ""), "profile_url": _or(f"{path}.profile_url", ""), "avatar": _or(f"{path}.profile_image_url", "")}


def weibo_cards(df: DataFrame) -> DataFrame:
    """The note cards (type 9) of search results, also those inside card groups: one raw record each."""
    cards = parsed(df).select(F.explode(F.coalesce(at("cards", "array<variant>"), at("data.cards", "array<variant>"))).alias("c"))
    kind = lambda v: F.try_variant_get(v, "$.card_type", "int")
    inner = cards.select(F.explode(F.try_variant_get("c", "$.card_group", "array<variant>")).alias("c"))
    return cards.where(kind("c") == 9).unionByName(inner.where(kind("c") == 9)).select(F.to_json("c").alias("raw"))


def weibo_notes(df: DataFrame) -> DataFrame:
    return _rows(parsed(df), {
        "note_id": at("mblog.id"), "content": S.strip_tags(at("mblog.text")), **_weibo_time("mblog.created_at"), "liked_count": _or("mblog.attitudes_count", "0"), "comments_count": _or("mblog.comments_count", "0"),
        "shared_count": _or("mblog.reposts_count", "0"), "note_url": F.concat(F.lit("https://m.weibo.cn/detail/"), at("mblog.id")), "ip_location": F.replace(_or("mblog.region_name", ""), F.lit("发布于 "), F.lit("")), **_weibo_user("mblog.user"),
    })


def weibo_comments(df: DataFrame) -> DataFrame:
    """``df`` has note_id."""
    return _rows(parsed(df), {
        "comment_id": at("id"), **_weibo_time("created_at"), "content": S.strip_tags(at("text")), "sub_comment_count": _or("total_number", "0"), "comment_like_count": _or("like_count", "0"),
        "ip_location": F.replace(_or("source", ""), F.lit("来自"), F.lit("")), "parent_comment_id": _or("rootid", ""), **_weibo_user("user"),
    }, "note_id")


def weibo_creators(df: DataFrame) -> DataFrame:
    """``df`` has user_id."""
    return _rows(parsed(df), {
        "nickname": at("screen_name"), "gender": S.gender("weibo", at("gender")), "avatar": at("avatar_hd"), "desc": at("description"), "ip_location": F.replace(_or("source", ""), F.lit("来自"), F.lit("")),
        "follows": _or("follow_count", ""), "fans": _or("followers_count", ""), "tag_list": F.lit(""),
    }, "user_id")


# Kuaishou ------------------------------------------------------------------------------------------------------------------------


def kuaishou_videos(df: DataFrame) -> DataFrame:
    caption = F.substring(_or("photo.caption", ""), 1, 500)
    return _rows(parsed(df).where(_first("photo.id").isNotNull()), {
        "video_id": at("photo.id"), "video_type": _or("type", "None"), "title": caption, "desc": caption, "create_time": at("photo.timestamp", "bigint"), "user_id": at("author.id"), "nickname": at("author.name"),
        "avatar": _or("author.headerUrl", ""), "liked_count": _or("photo.realLikeCount", "None"), "viewd_count": _or("photo.viewCount", "None"), "video_url": F.concat(F.lit("https://www.kuaishou.com/short-video/"), at("photo.id")),
        "video_cover_url": _or("photo.coverUrl", ""), "video_play_url": _or("photo.photoUrl", ""),
    })


def kuaishou_comments(df: DataFrame) -> DataFrame:
    """``df`` has video_id; both API versions' field names are read."""
    return _rows(parsed(df), {
        "comment_id": _first("comment_id", "commentId"), "create_time": at("timestamp", "bigint"), "content": at("content"), "user_id": _first("author_id", "authorId"), "nickname": _first("author_name", "authorName"),
        "avatar": at("headurl"), "sub_comment_count": F.coalesce(F.nullif(at("commentCount"), F.lit("0")), at("subCommentCount"), F.lit("0")),
    }, "video_id")


def kuaishou_creators(df: DataFrame) -> DataFrame:
    """``df`` has user_id."""
    return _rows(parsed(df), {
        "nickname": at("profile.user_name"), "gender": F.when(at("profile.gender") == "F", "Female").otherwise("Male"), "avatar": at("profile.headurl"), "desc": at("profile.user_text"), "ip_location": F.lit(""),
        "follows": at("ownerCount.follow"), "fans": at("ownerCount.fan"), "interaction": at("ownerCount.photo_public"),
    }, "user_id")


# Tieba ---------------------------------------------------------------------------------------------------------------------------

TIEBA = "https://tieba.baidu.com"


_USER = "struct<id:string,name:string,name_show:string,portrait:string,ip_address:string>"


def _first_or(default: str, *paths: str) -> Column:
    return F.coalesce(_first(*paths), F.lit(default))


def _tieba_user(portrait: Column) -> Column:
    return F.when(portrait != "", F.concat(F.lit(f"{TIEBA}/home/main?id="), F.url_encode(portrait))).otherwise("")


def tieba_search(df: DataFrame) -> DataFrame:
    """Thread cards of search results."""
    cards = parsed(df).select(F.explode(at("data.card_list", "array<variant>")).alias(_V))
    threads = cards.where((F.coalesce(at("cardInfo"), F.lit("")) == "thread") | (F.coalesce(at("cardStyle"), F.lit("")) == "thread"))
    forum = S.forum_name(_or("data.forum_name", ""))
    return _rows(threads.where(_first("data.tid").isNotNull()), {
        "note_id": at("data.tid"), "title": S.normalize_text(_or("data.title", "")), "desc": S.normalize_text(_or("data.content", "")), "note_url": F.concat(F.lit(f"{TIEBA}/p/"), at("data.tid")), "user_nickname": _or("data.user.show_nickname", ""),
        "publish_time": at("data.time"), "tieba_name": forum, "tieba_link": S.forum_link(forum, f"{TIEBA}/f?kw="), "total_replay_num": F.coalesce(at("data.post_num", "int"), F.lit(0)),
    })


def tieba_posts(df: DataFrame) -> DataFrame:
    """Posts of a thread page (``df`` has note_id) with their authors looked up in the page's user list."""
    users = F.map_from_entries(F.transform(F.filter(_list("user_list", "struct<id:string,name_show:string,portrait:string,ip_address:string>"), lambda u: u["id"].isNotNull()), lambda u: F.struct(u["id"], u)))
    posts = parsed(df).select("note_id", users.alias("users"), F.explode(at("post_list", "array<struct<id:string,author_id:string,time:string,floor:int,sub_post_number:int,content:array<struct<text:string,c:string>>>>")).alias("p"))
    who = F.col("users")[F.col("p.author_id")]
    text = F.array_join(F.transform(F.col("p.content"), lambda c: F.coalesce(F.nullif(c["text"], F.lit("")), c["c"], F.lit(""))), "")
    return posts.select(
        "note_id", F.col("p.id").alias("comment_id"), text.alias("content"), F.col("p.time").alias("publish_time"), F.coalesce("p.sub_post_number", F.lit(0)).alias("sub_comment_count"), who["name_show"].alias("user_nickname"),
        F.when(who["portrait"] != "", F.concat(F.lit(f"{TIEBA}/home/main?id="), F.url_encode(who["portrait"]))).otherwise("").alias("user_link"), F.coalesce(who["ip_address"], F.lit("")).alias("ip_location"),
    )


def tieba_details(df: DataFrame) -> DataFrame:
    """The thread of a page of posts, with the author of its first floor."""
    users = F.map_from_entries(F.transform(F.filter(_list("user_list", _USER), lambda u: u["id"].isNotNull()), lambda u: F.struct(u["id"], u)))
    forum = S.forum_name(_first_or("", "forum.name", "display_forum.name"))
    text = lambda items: F.array_join(F.transform(items, lambda c: F.coalesce(F.nullif(c["text"], F.lit("")), c["c"], F.lit(""))), "")
    native = _first("thread.id", "thread.tid", "first_floor.tid")
    who = F.col("users")[at("first_floor.author_id")]
    return _rows(parsed(df).withColumn("users", users).where(native.isNotNull()), {
        "note_id": native, "title": S.normalize_text(_first_or("", "thread.title", "first_floor.title")), "desc": S.normalize_text(text(_list("first_floor.content", "struct<text:string,c:string>"))), "note_url": F.concat(F.lit(f"{TIEBA}/p/"), native),
        "publish_time": _first("first_floor.time", "thread.create_time"), "user_nickname": F.coalesce(F.nullif(who["name_show"], F.lit("")), who["name"], F.lit("")), "user_link": _tieba_user(who["portrait"]), "tieba_name": forum, "tieba_link": S.forum_link(forum, f"{TIEBA}/f?kw="),
        "total_replay_num": F.coalesce(at("thread.reply_num", "int"), F.lit(0)), "total_replay_page": F.coalesce(at("page.total_page", "int"), F.lit(0)), "ip_location": F.coalesce(who["ip_address"], F.lit("")),
    })


def tieba_creators(df: DataFrame) -> DataFrame:
    """Creators; a record without a user gives no row."""
    user, sex = "data.user", F.coalesce(at("data.user.sex", "int"), at("data.user.gender", "int"))
    return _rows(parsed(df).where(at(user, "variant").isNotNull()), {
        "user_id": _or(f"{user}.id", ""), "user_name": _or(f"{user}.name", ""), "nickname": _first_or("", f"{user}.name_show", f"{user}.name"), "gender": F.when(sex == 1, "Male").when(sex == 2, "Female").otherwise("Unknown"),
        "ip_location": _or(f"{user}.ip_address", ""), "follows": F.coalesce(at(f"{user}.concern_num", "int"), F.lit(0)), "fans": F.coalesce(at(f"{user}.fans_num", "int"), F.lit(0)), "registration_duration": _or(f"{user}.tb_age", ""),
    })


def tieba_creator_threads(df: DataFrame) -> DataFrame:
    """Ids of the threads in a creator's feed, in its order (``at`` from 0); ``df`` has user_id."""
    items = parsed(df).select("user_id", F.posexplode(at("data.list", "array<struct<thread_info:struct<tid:string,id:string>>>")).alias("at", "x"))
    native = F.coalesce(F.nullif("x.thread_info.tid", F.lit("")), F.nullif("x.thread_info.id", F.lit("")))
    return items.select("user_id", "at", native.alias("note_id")).where("note_id is not null")


def tieba_forum_threads(df: DataFrame) -> DataFrame:
    """The thread ids of a forum's page with what leads to them; the ids are one text with commas between."""
    forum = S.forum_name(_or("forum.name", ""))
    ids = parsed(df).select(_V, F.posexplode(F.split(_or("forum.tids", ""), ",")).alias("at", "tid")).where(F.trim("tid") != "")
    return _rows(ids, {"note_id": F.trim("tid"), "at": F.col("at"), "note_url": F.concat(F.lit(f"{TIEBA}/p/"), F.trim("tid")), "tieba_name": forum, "tieba_link": S.forum_link(forum, f"{TIEBA}/f?kw=")})


# Zhihu ---------------------------------------------------------------------------------------------------------------------------

ZHIHU, COLUMNS = "https://www.zhihu.com", "https://zhuanlan.zhihu.com"


def _author(path: str) -> dict[str, Column]:
    token = at(f"{path}.url_token")
    return {"user_id": at(f"{path}.id"), "user_link": F.concat(F.lit(f"{ZHIHU}/people/"), token), "user_nickname": at(f"{path}.name"), "user_avatar": at(f"{path}.avatar_url"), "user_url_token": token}


def zhihu_contents(df: DataFrame) -> DataFrame:
    """Answers, articles and videos; other types are left out."""
    kind, home = at("type"), at("video", "variant").isNotNull()
    answer = F.concat(F.lit(f"{ZHIHU}/question/"), at("question.id"), F.lit("/answer/"), at("id"))
    video = F.when(home, F.concat(F.lit(f"{ZHIHU}/zvideo/"), at("id"))).otherwise(at("video_url"))
    url = F.when(kind == "answer", answer).when(kind == "article", F.concat(F.lit(f"{COLUMNS}/p/"), at("id"))).otherwise(video)
    created = F.when(kind == "zvideo", F.when(home, at("published_at")).otherwise(at("created_at"))).otherwise(_first("created_time", "created"))
    updated = F.when(kind == "zvideo", at("updated_at")).otherwise(_first("updated_time", "updated"))
    return _rows(parsed(df).where(kind.isin("answer", "article", "zvideo")), {
        "content_id": at("id"), "content_type": kind, "content_text": F.when(kind == "zvideo", "").otherwise(S.html_text(at("content"))), "content_url": url, "question_id": F.when(kind == "answer", at("question.id")).otherwise(""),
        "title": S.html_text(at("title")), "desc": S.html_text(F.when(kind == "article", at("excerpt")).otherwise(_first("description", "excerpt"))), "created_time": created, "updated_time": updated,
        "voteup_count": F.coalesce(at("voteup_count", "int"), F.lit(0)), "comment_count": F.coalesce(at("comment_count", "int"), F.lit(0)), **_author("author"),
    })


def zhihu_comments(df: DataFrame) -> DataFrame:
    """``df`` has content_id and content_type."""
    place = F.filter(_list("comment_tag", "struct<type:string,text:string>"), lambda t: t["type"] == "ip_info")
    return _rows(parsed(df), {
        "comment_id": at("id"), "parent_comment_id": at("reply_comment_id"), "content": S.html_text(at("content")), "publish_time": at("created_time"), "ip_location": F.coalesce(F.try_element_at(place, F.lit(1))["text"], F.lit("")),
        "sub_comment_count": F.coalesce(at("child_comment_count", "int"), F.lit(0)), "like_count": F.coalesce(at("like_count", "int"), F.lit(0)), "dislike_count": F.coalesce(at("dislike_count", "int"), F.lit(0)), **_author("author"),
    }, "content_id", "content_type")


def zhihu_creators(df: DataFrame) -> DataFrame:
    """Creators from the state that their page carries (``df`` has html and url_token); pages without that user give no row."""
    counts = {"follows": "followingCount", "fans": "followerCount", "anwser_count": "answerCount", "video_count": "zvideoCount", "question_count": "questionCount", "article_count": "articlesCount", "column_count": "columnsCount", "get_voteup_count": "voteupCount"}
    user = F.try_variant_get(F.try_parse_json(page_state(F.col("html"), "initial_data")), "$.initialState.entities.users", "map<string,variant>")
    x = df.select("url_token", F.try_element_at(user, F.col("url_token")).alias(_V)).where(F.col(_V).isNotNull())
    gender = at("gender", "int")
    return _rows(x, {
        "user_id": at("id"), "user_link": F.concat(F.lit(f"{ZHIHU}/people/"), F.col("url_token")), "user_nickname": at("name"), "user_avatar": at("avatarUrl"), "url_token": F.coalesce(_first("urlToken"), F.col("url_token")),
        "gender": F.when(gender == 1, "Male").when(gender == 0, "Female").otherwise("Unknown"), "ip_location": at("ipInfo"), **{name: at(path, "bigint") for name, path in counts.items()},
    })


# Page state and replies -----------------------------------------------------------------------------------------------------------


def page_state(html: Column, kind: str) -> Column:
    """The JSON that a page carries in a script: ``initial_data`` (by element id) or ``initial_state`` (assigned to the window)."""
    if kind == "initial_data":
        return F.nullif(F.regexp_extract(html, r'(?s)<script id="js-initialData"[^>]*>(.*?)</script>', 1), F.lit(""))
    if kind == "initial_state":
        raw = F.regexp_extract(html, r"(?s)<script>\s*window\.__INITIAL_STATE__=(\{.*?\})\s*</script>", 1)
        return F.nullif(F.regexp_replace(raw, r":\s*undefined", ":null"), F.lit(""))
    raise ValueError(f"unknown kind {kind}")


def snake_keys(raw: Column) -> Column:
    """JSON text with camelCase keys, at any depth, in snake_case."""
    for letter in string.ascii_uppercase:
        raw = F.regexp_replace(raw, rf'(?<=[a-z0-9]){letter}(?=[A-Za-z0-9]*":)', f"_{letter.lower()}")
    return raw


def with_replies(df: DataFrame, replies: str, parent: str) -> DataFrame:
    """(raw, parent_id) of records and of the records in their inline reply arrays, under the same content."""
    keep = [c for c in df.columns if c != "raw"]
    top = parsed(df)
    inner = top.select(*keep, at(parent).alias("parent_id"), F.explode(at(replies, "array<variant>")).alias("_r"))
    return df.select(*keep, "raw", F.lit(None).cast("string").alias("parent_id")).unionByName(inner.select(*keep, F.to_json("_r").alias("raw"), "parent_id"))
