"""Explicit schemas: normalized entities, and the landing tables of seven platforms."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "a": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType())}


def schema(text: str) -> T.StructType:
    """``name:kind`` pairs; kinds are s(tring), l(ong), i(nteger), d(ouble), b(oolean), t(imestamp), a(rray), m(ap)."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, _, k in (x.partition(":") for x in text.split())])


AUTHOR = schema("id:s platform:s native_author_id:s nickname:s profile_url:s avatar_url:s description:s gender:s ip_location:s following_count:l follower_count:l content_count:l verified:b attributes:m raw_payload:s collected_at:t")
CONTENT = schema(
    "id:s run_id:s platform:s native_content_id:s content_type:s title:s body:s url:s author_id:s native_author_id:s published_at:t like_count:l comment_count:l share_count:l favorite_count:l view_count:l source_keyword:s media_urls:a tags:a raw_payload:s collected_at:t"
)
COMMENT = schema(
    "id:s run_id:s platform:s native_comment_id:s content_id:s native_content_id:s author_id:s native_author_id:s parent_comment_id:s root_comment_id:s depth:i text:s published_at:t like_count:l reply_count:l ip_location:s media_urls:a text_hash:s language:s raw_payload:s collected_at:t"
)
RUN = schema("id:s platform:s query_type:s query:s status:s inputs:a started_at:t finished_at:t read_count:l inserted_count:l invalid_count:l")

_PERSON = "user_id:s nickname:s avatar:s"
_STAMP = "add_ts:l last_modify_ts:l"

#: Landing tables by platform and kind. All native values are text; times are epoch numbers.
LANDING: dict[str, T.StructType] = {
    "bilibili_video": schema(f"{_PERSON} {_STAMP} video_id:l video_url:s liked_count:i video_type:s title:s desc:s create_time:l disliked_count:s video_play_count:s video_favorite_count:s video_share_count:s video_coin_count:s video_danmaku:s video_comment:s video_cover_url:s source_keyword:s"),
    "bilibili_comment": schema(f"{_PERSON} sex:s sign:s {_STAMP} comment_id:l video_id:l content:s create_time:l sub_comment_count:s parent_comment_id:s like_count:s"),
    "bilibili_up": schema(f"{_PERSON} sex:s sign:s {_STAMP} total_fans:i total_liked:i user_rank:i is_official:i"),
    "bilibili_contact": schema(f"up_id:l fan_id:l up_name:s fan_name:s up_sign:s fan_sign:s up_avatar:s fan_avatar:s {_STAMP}"),
    "bilibili_dynamic": schema(f"dynamic_id:l user_id:s user_name:s text:s type:s pub_ts:l total_comments:i total_forwards:i total_liked:i {_STAMP}"),
    "douyin_aweme": schema(f"{_PERSON} sec_uid:s short_user_id:s user_unique_id:s user_signature:s ip_location:s {_STAMP} aweme_id:l aweme_type:s title:s desc:s create_time:l liked_count:s comment_count:s share_count:s collected_count:s aweme_url:s cover_url:s video_download_url:s music_download_url:s note_download_url:s source_keyword:s"),
    "douyin_comment": schema(f"{_PERSON} sec_uid:s short_user_id:s user_unique_id:s user_signature:s ip_location:s {_STAMP} comment_id:l aweme_id:l content:s create_time:l sub_comment_count:s parent_comment_id:s like_count:s pictures:s"),
    "douyin_creator": schema(f"{_PERSON} ip_location:s {_STAMP} desc:s gender:s follows:s fans:s interaction:s videos_count:s"),
    "kuaishou_video": schema(f"{_PERSON} {_STAMP} video_id:s video_type:s title:s desc:s create_time:l liked_count:s viewd_count:s video_url:s video_cover_url:s video_play_url:s source_keyword:s"),
    "kuaishou_comment": schema(f"{_PERSON} {_STAMP} comment_id:l video_id:s content:s create_time:l sub_comment_count:s"),
    "weibo_note": schema(f"{_PERSON} gender:s profile_url:s ip_location:s {_STAMP} note_id:l content:s create_time:l create_date_time:s liked_count:s comments_count:s shared_count:s note_url:s source_keyword:s"),
    "weibo_comment": schema(f"{_PERSON} gender:s profile_url:s ip_location:s {_STAMP} comment_id:l note_id:l content:s create_time:l create_date_time:s comment_like_count:s sub_comment_count:s parent_comment_id:s"),
    "weibo_creator": schema(f"{_PERSON} gender:s ip_location:s {_STAMP} desc:s follows:s fans:s tag_list:s"),
    "xhs_creator": schema(f"{_PERSON} ip_location:s {_STAMP} desc:s gender:s follows:s fans:s interaction:s tag_list:s"),
    "xhs_note": schema(f"{_PERSON} ip_location:s {_STAMP} note_id:s type:s title:s desc:s video_url:s time:l last_update_time:l liked_count:s collected_count:s comment_count:s share_count:s image_list:s tag_list:s note_url:s source_keyword:s xsec_token:s"),
    "xhs_comment": schema(f"{_PERSON} ip_location:s {_STAMP} comment_id:s create_time:l note_id:s content:s sub_comment_count:i pictures:s parent_comment_id:s like_count:s"),
    "tieba_note": schema(f"note_id:s title:s desc:s note_url:s publish_time:s user_link:s user_nickname:s user_avatar:s tieba_id:s tieba_name:s tieba_link:s total_replay_num:i total_replay_page:i ip_location:s source_keyword:s {_STAMP}"),
    "tieba_comment": schema(f"comment_id:s parent_comment_id:s content:s user_link:s user_nickname:s user_avatar:s tieba_id:s tieba_name:s tieba_link:s publish_time:s ip_location:s sub_comment_count:i note_id:s note_url:s {_STAMP}"),
    "tieba_creator": schema(f"user_id:s user_name:s nickname:s avatar:s ip_location:s {_STAMP} gender:s follows:s fans:s registration_duration:s"),
    "zhihu_content": schema(f"content_id:s content_type:s content_text:s content_url:s question_id:s title:s desc:s created_time:s updated_time:s voteup_count:i comment_count:i source_keyword:s user_id:s user_link:s user_nickname:s user_avatar:s user_url_token:s {_STAMP}"),
    "zhihu_comment": schema(f"comment_id:s parent_comment_id:s content:s publish_time:s ip_location:s sub_comment_count:i like_count:i dislike_count:i content_id:s content_type:s user_id:s user_link:s user_nickname:s user_avatar:s {_STAMP}"),
    "zhihu_creator": schema(f"user_id:s user_link:s user_nickname:s user_avatar:s url_token:s gender:s ip_location:s follows:i fans:i anwser_count:i video_count:i question_count:i article_count:i column_count:i get_voteup_count:i {_STAMP}"),
}

LANDING_KEYS = {
    "bilibili_video": ["video_id"], "bilibili_comment": ["comment_id"], "bilibili_up": ["user_id"], "bilibili_contact": ["up_id", "fan_id"], "bilibili_dynamic": ["dynamic_id"],
    "douyin_aweme": ["aweme_id"], "douyin_comment": ["comment_id"], "douyin_creator": ["user_id"], "kuaishou_video": ["video_id"], "kuaishou_comment": ["comment_id"],
    "weibo_note": ["note_id"], "weibo_comment": ["comment_id"], "weibo_creator": ["user_id"], "xhs_creator": ["user_id"], "xhs_note": ["note_id"], "xhs_comment": ["comment_id"],
    "tieba_note": ["note_id"], "tieba_comment": ["comment_id"], "tieba_creator": ["user_id"], "zhihu_content": ["content_id"], "zhihu_comment": ["comment_id"], "zhihu_creator": ["user_id"],
}
