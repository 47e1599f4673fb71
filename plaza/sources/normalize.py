"""Landing records of a platform to normalized authors, contents and comments.

Each function takes a DataFrame of landing rows (missing columns count as null) and returns the entity's columns plus ``errors``,
an array of what is wrong with required or typed fields; rows are not dropped here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import scalar as S

Source = Callable[[str], Column]


def _fields(df: DataFrame) -> Source:
    return lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")


def _errors(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for message, bad in checks.items()]))


def _missing(c: Column) -> Column:
    return S.optional_string(c).isNull()


def _payload(df: DataFrame) -> Column:
    return F.col("raw_payload") if "raw_payload" in df.columns else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def _collected(get: Source) -> Column:
    return F.coalesce(S.parse_time(get("last_modify_ts")), F.current_timestamp())


class Platform:
    """How one platform names its fields."""

    def __init__(self, name: str, aliases: tuple[str, ...], strict: bool, content: dict[str, str], comment: dict[str, str], author: dict[str, str], attributes: tuple[str, ...], profile: Callable[[Source], Column], kind: Callable[[Source], Column], url: Callable[[Source], Column], media: tuple[str, ...], comment_media: tuple[str, ...], native: dict[str, str] | None = None):
        self.native = {"author": "user_id", "time": "create_time", "comment_time": "create_time"} | (native or {})
        self.name, self.aliases, self.strict = name, aliases, strict
        self.content, self.comment, self.author, self.attributes = content, comment, author, attributes
        self.profile, self.kind, self.url, self.media, self.comment_media = profile, kind, url, media, comment_media


def _plain(get: Source, names: dict[str, str], columns: tuple[str, ...]) -> dict[str, Column]:
    return {c: S.optional_string(get(names[c])) if c in names else F.lit(None).cast("string") for c in columns}


def _counts(get: Source, names: dict[str, str], columns: tuple[str, ...], strict: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    values = {c: S.non_negative_int(get(names[c]), strict) if c in names else F.lit(None).cast("bigint") for c in columns}
    bad = {f"{c} is not a count": S.count_error(get(names[c]), strict) for c in columns if c in names}
    return values, bad


def _padded(x: Column) -> Column:
    """Dates and hours of one digit with two, as forum pages write ``2024-8-6 9:05``."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"-(\d)(?!\d)", "-0$1"), r" (\d):", " 0$1:")


def authors(df: DataFrame, p: Platform) -> DataFrame:
    """One row for each record that names an author."""
    get = _fields(df)
    native = S.optional_string(get(p.native["author"]))
    counts, bad = _counts(get, p.author, ("following_count", "follower_count", "content_count"), p.strict)
    kept = F.map_from_arrays(F.array(*[F.lit(a) for a in p.attributes]), F.array(*[S.optional_string(get(a)) for a in p.attributes]))
    return df.where(native.isNotNull()).select(
        S.entity_id(p.name, "author", native).alias("id"), F.lit(p.name).alias("platform"), native.alias("native_author_id"),
        *[c.alias(n) for n, c in _plain(get, p.author, ("nickname", "avatar_url", "description", "gender", "ip_location")).items()],
        p.profile(get).alias("profile_url"), *[c.alias(n) for n, c in counts.items()],
        (S.verified(get(p.author["verified"])) if "verified" in p.author else F.lit(None).cast("boolean")).alias("verified"),
        S.without_nulls(kept).alias("attributes"), _payload(df).alias("raw_payload"), _collected(get).alias("collected_at"),
        _errors(bad | {"last_modify_ts is not a time": S.time_error(get("last_modify_ts"))}).alias("errors"),
    )


def contents(df: DataFrame, p: Platform, run_id: str) -> DataFrame:
    get = _fields(df)
    native, author, time = S.optional_string(get(p.content["native_content_id"])), S.optional_string(get(p.native["author"])), _padded(get(p.native["time"]))
    counts, bad = _counts(get, p.content, ("like_count", "comment_count", "share_count", "favorite_count", "view_count"), p.strict)
    return df.select(
        S.entity_id(p.name, "content", native).alias("id"), F.lit(run_id).alias("run_id"), F.lit(p.name).alias("platform"), native.alias("native_content_id"),
        p.kind(get).alias("content_type"), *[c.alias(n) for n, c in _plain(get, p.content, ("title", "body", "source_keyword")).items()], p.url(get).alias("url"),
        S.entity_id(p.name, "author", author).alias("author_id"), author.alias("native_author_id"), S.parse_time(time).alias("published_at"),
        *[c.alias(n) for n, c in counts.items()], S.split_urls(*[get(m) for m in p.media]).alias("media_urls") if p.media else F.array().cast("array<string>").alias("media_urls"), F.array().cast("array<string>").alias("tags"),
        _payload(df).alias("raw_payload"), _collected(get).alias("collected_at"),
        _errors(bad | {"content id is required": _missing(native), f"{p.native['time']} is not a time": S.time_error(time)}).alias("errors"),
    )


def comments(df: DataFrame, p: Platform, run_id: str) -> DataFrame:
    df = df.withColumn("_text", S.normalize_text(F.coalesce(_fields(df)("content").cast("string"), F.lit(""))))
    get = _fields(df)
    native, content, author = S.optional_string(get("comment_id")), S.optional_string(get(p.content["native_content_id"])), S.optional_string(get(p.native["author"]))
    time = _padded(get(p.native["comment_time"]))
    parent = S.parent_id(get("parent_comment_id"))
    counts, bad = _counts(get, p.comment, ("like_count", "reply_count"), p.strict)
    return df.select(
        S.entity_id(p.name, "comment", native).alias("id"), F.lit(run_id).alias("run_id"), F.lit(p.name).alias("platform"), native.alias("native_comment_id"),
        S.entity_id(p.name, "content", content).alias("content_id"), content.alias("native_content_id"), S.entity_id(p.name, "author", author).alias("author_id"), author.alias("native_author_id"),
        parent.alias("parent_comment_id"), parent.alias("root_comment_id"), F.when(parent.isNotNull(), 1).otherwise(0).alias("depth"), F.col("_text").alias("text"),
        S.parse_time(time).alias("published_at"), *[c.alias(n) for n, c in counts.items()],
        *[c.alias(n) for n, c in _plain(get, p.comment, ("ip_location",)).items()], S.split_urls(*[get(m) for m in p.comment_media]).alias("media_urls") if p.comment_media else F.array().cast("array<string>").alias("media_urls"),
        S.text_hash(F.col("_text")).alias("text_hash"), S.language_hint(F.col("_text")).alias("language"), (F.col("raw_payload") if "raw_payload" in df.columns else F.to_json(F.struct(*[c for c in df.columns if c != "_text"]), {"ignoreNullFields": "false"})).alias("raw_payload"), _collected(get).alias("collected_at"),
        _errors(bad | {"comment id is required": _missing(native), "content id is required": _missing(content), f"{p.native['comment_time']} is not a time": S.time_error(time)}).alias("errors"),
    )


DOUYIN = Platform(
    "douyin", ("dy",), True,
    {"native_content_id": "aweme_id", "title": "title", "body": "desc", "source_keyword": "source_keyword", "like_count": "liked_count", "comment_count": "comment_count", "share_count": "share_count", "favorite_count": "collected_count"},
    {"like_count": "like_count", "reply_count": "sub_comment_count", "ip_location": "ip_location"},
    {"nickname": "nickname", "avatar_url": "avatar", "description": "user_signature", "gender": "gender", "ip_location": "ip_location", "following_count": "follows", "follower_count": "fans", "content_count": "videos_count"},
    ("sec_uid", "short_user_id", "user_unique_id"),
    lambda get: F.when(S.optional_string(get("sec_uid")).isNotNull(), F.concat(F.lit("https://www.douyin.com/user/"), S.optional_string(get("sec_uid")))),
    lambda get: S.content_kind(get("video_download_url"), get("note_download_url"), get("aweme_type")),
    lambda get: S.optional_string(get("aweme_url")),
    ("cover_url", "video_download_url", "music_download_url", "note_download_url"), ("pictures",),
)

BILIBILI = Platform(
    "bilibili", ("bili",), False,
    {"native_content_id": "video_id", "title": "title", "body": "desc", "source_keyword": "source_keyword", "like_count": "liked_count", "comment_count": "video_comment", "share_count": "video_share_count", "favorite_count": "video_favorite_count", "view_count": "video_play_count"},
    {"like_count": "like_count", "reply_count": "sub_comment_count"},
    {"nickname": "nickname", "avatar_url": "avatar", "description": "sign", "gender": "sex", "follower_count": "total_fans", "verified": "is_official"},
    ("total_liked", "user_rank"),
    lambda get: F.concat(F.lit("https://space.bilibili.com/"), S.optional_string(get("user_id"))),
    lambda get: F.coalesce(S.optional_string(get("video_type")), F.lit("video")),
    lambda get: F.coalesce(S.optional_string(get("video_url")), F.concat(F.lit("https://www.bilibili.com/video/av"), S.optional_string(get("video_id")))),
    ("video_cover_url",), (),
)

_ID = lambda base, column: lambda get: F.concat(F.lit(base), S.optional_string(get(column)))
_PEOPLE = {"nickname": "nickname", "avatar_url": "avatar", "description": "desc", "gender": "gender", "ip_location": "ip_location", "following_count": "follows", "follower_count": "fans"}

XHS = Platform(
    "xhs", ("xiaohongshu",), False,
    {"native_content_id": "note_id", "title": "title", "body": "desc", "source_keyword": "source_keyword", "like_count": "liked_count", "comment_count": "comment_count", "share_count": "share_count", "favorite_count": "collected_count"},
    {"like_count": "like_count", "reply_count": "sub_comment_count", "ip_location": "ip_location"}, _PEOPLE, ("interaction", "tag_list"),
    _ID("https://www.xiaohongshu.com/user/profile/", "user_id"), lambda get: F.coalesce(S.optional_string(get("type")), F.lit("note")), lambda get: S.optional_string(get("note_url")), ("video_url", "image_list"), ("pictures",),
    {"time": "time"},
)

KUAISHOU = Platform(
    "kuaishou", ("ks",), False,
    {"native_content_id": "video_id", "title": "title", "body": "desc", "source_keyword": "source_keyword", "like_count": "liked_count", "view_count": "viewd_count"},
    {"reply_count": "sub_comment_count"}, _PEOPLE, ("interaction",),
    _ID("https://www.kuaishou.com/profile/", "user_id"), lambda get: F.coalesce(S.optional_string(get("video_type")), F.lit("video")), lambda get: S.optional_string(get("video_url")), ("video_cover_url", "video_play_url"), (),
)

WEIBO = Platform(
    "weibo", ("wb",), False,
    {"native_content_id": "note_id", "body": "content", "source_keyword": "source_keyword", "like_count": "liked_count", "comment_count": "comments_count", "share_count": "shared_count"},
    {"like_count": "comment_like_count", "reply_count": "sub_comment_count", "ip_location": "ip_location"}, _PEOPLE, ("tag_list",),
    lambda get: F.coalesce(S.optional_string(get("profile_url")), F.concat(F.lit("https://weibo.com/u/"), S.optional_string(get("user_id")))), lambda get: F.lit("note"), lambda get: S.optional_string(get("note_url")), (), (),
)

#: Notes and comments of this forum name their authors by link only, so the link is the author's id there.
TIEBA = Platform(
    "tieba", (), False,
    {"native_content_id": "note_id", "title": "title", "body": "desc", "source_keyword": "source_keyword", "comment_count": "total_replay_num"},
    {"reply_count": "sub_comment_count", "ip_location": "ip_location"}, _PEOPLE | {"nickname": "user_nickname", "avatar_url": "user_avatar"}, ("registration_duration",),
    lambda get: S.optional_string(get("user_link")), lambda get: F.lit("thread"), lambda get: S.optional_string(get("note_url")), (), (),
    {"author": "user_link", "time": "publish_time", "comment_time": "publish_time"},
)

ZHIHU = Platform(
    "zhihu", (), False,
    {"native_content_id": "content_id", "title": "title", "body": "content_text", "source_keyword": "source_keyword", "like_count": "voteup_count", "comment_count": "comment_count"},
    {"like_count": "like_count", "reply_count": "sub_comment_count", "ip_location": "ip_location"}, _PEOPLE | {"nickname": "user_nickname", "avatar_url": "user_avatar"}, ("anwser_count", "video_count", "question_count", "article_count", "column_count", "get_voteup_count"),
    lambda get: S.optional_string(get("user_link")), lambda get: S.optional_string(get("content_type")), lambda get: S.optional_string(get("content_url")), (), (),
    {"time": "created_time", "comment_time": "publish_time"},
)

PLATFORMS = {alias: p for p in (DOUYIN, BILIBILI, XHS, KUAISHOU, WEIBO, TIEBA, ZHIHU) for alias in (p.name, *p.aliases)}


def platform(name: str) -> Platform:
    try:
        return PLATFORMS[name.lower()]
    except KeyError:
        raise ValueError(f"no normalizer for {name}") from None
