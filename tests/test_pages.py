"""Forum pages as they are stored: commented sections, single quotes, unpadded times, relative links, replies without their parent."""

from plaza.sources import pages as P

NAMES = [c.split()[0] for c in P.COLUMNS.split(", ")][1:]


def found(html, parent=None):
    return [dict(zip(NAMES, r, strict=True)) for r in P.records(html, parent)]


def test_replies_take_their_parent_from_the_caller():
    html = """<li class="lzl_single_post j_lzl_s_p first_no_border" data-field='{&quot;spid&quot;:15,&quot;showname&quot;:&quot;\\u53ef&quot;,&quot;user_name&quot;:&quot;x&quot;}'>
    <a class="j_user_card lzl_p_p" href="/home/main?id=tb.1.b&ie=utf-8"><img src="a.png"></a><span class="lzl_content_main" data-username=""> well <img> then </span>
    <span class="lzl_time">2024-8-6 22:11</span></li>"""
    (r,) = found(html, "77")
    assert (r["native_id"], r["parent_id"], r["user_nickname"], r["publish_time"], r["content"]) == ("15", "77", "可", "2024-8-6 22:11", "well then")
    assert r["user_link"] == "https://tieba.baidu.com/home/main?id=tb.1.b&ie=utf-8"
    assert found(html)[0]["parent_id"] is None and found(html.replace("15,", "15,&quot;pid&quot;:4,"), "77")[0]["parent_id"] == "4"


def test_sections_in_comments_are_read():
    html = """<code><!-- <ul id="thread_list"><li class=" j_thread_list clearfix" data-field="{'id':90799,'author_name':'n','reply_num':'1,204'}"><a class="j_th_tit" href="/p/90799">T</a></li></ul> --></code>
    <code><!-- <div class="l_post j_l_post" data-pid="5"><div class="d_post_content">c <div class="l_post" data-pid="6"><div class="d_post_content">inner</div></div></div></div> --></code>"""
    got = found(html)
    assert [(r["kind"], r["native_id"]) for r in got] == [("note", "90799"), ("comment", "5"), ("comment", "6")]
    assert got[0]["reply_count"] == 1204 and got[0]["user_nickname"] == "n" and got[0]["title"] == "T"


def test_a_detail_has_the_totals_of_its_thread():
    html = """<title>【go吧】At 14_百度贴吧</title><meta name="description" content=" told "><a class="card_title_fname" href="/f?kw=go">go吧</a><script>{"thread_id": "911"}</script>
    <div id="thread_theme_5"><li class="l_reply_num"><span class="red">786</span><span class="red">13</span></li></div>
    <div class="l_post j_l_post" data-field='{"author":{"user_nickname":"z"},"content":{"post_id":1}}'><a class="p_author_face" href="/home/main?un=z"></a><span>IP属地:广东</span><span class="tail-info">2024-08-04 10:00</span></div>"""
    detail = next(r for r in found(html) if r["kind"] == "detail")
    assert (detail["native_id"], detail["title"], detail["content"], detail["reply_count"], detail["page_count"]) == ("911", "At 14", "told", 786, 13)
    assert (detail["user_nickname"], detail["ip_location"], detail["publish_time"]) == ("z", "广东", "2024-08-04 10:00")


def test_empty_and_broken_pages_give_nothing():
    assert found(None) == found("") == found("<!-- <li class='lzl_single_post' data-field='[1'>") == found("<div class='threadcardclass'><a href='/x'>") == []
