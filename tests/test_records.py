"""Scalar functions, checks, merges, normalizers and files."""

import datetime as dt
import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from plaza.functions import scalar as S
from plaza.operators import labeling as L
from plaza.operators import merge as U
from plaza.operators import quality as Q
from plaza.sources import files as A
from plaza.sources import flatten as C
from plaza.sources import normalize as N
from plaza.sources.schemas import LANDING, LANDING_KEYS


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_uuid5_equals_python(spark):
    for name in ("plaza:douyin:author:1", "plaza:douyin:author:评论"):
        assert one(spark, name, S.uuid5(F.col("x")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize(("raw", "strict", "lenient"), [("12", 12, 12), ("1,234", None, 1234), ("12.0", None, 12), ("-1", None, None), ("", None, None), (None, None, None), ("x", None, None), ("1.5", None, None)])
def test_counts(spark, raw, strict, lenient):
    assert one(spark, raw, S.non_negative_int(F.col("x")), S.non_negative_int(F.col("x"), False)) == (strict, lenient)


@pytest.mark.parametrize(("raw", "second"), [("1777456932", 1777456932), ("1780917929490", 1780917929), ("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01T08:00:00+08:00", 1704067200), ("", None), ("bad", None)])
def test_times(spark, raw, second):
    got = one(spark, raw, F.unix_seconds(S.parse_time(F.col("x"))), S.time_error(F.col("x")))
    assert got == (second, raw == "bad")


@pytest.mark.parametrize(("text", "reason"), [("", "empty"), ("111", "numeric_only"), ("[doge][ok]", "emoji_only"), ("好", "too_short"), ("哈哈哈", "repetitive"), ("支持", "generic_reply"), ("价格", None), ("iPhone手机", None)])
def test_quality_gate(spark, text, reason):
    df = spark.createDataFrame([(text,)], "x string").withColumn("n", S.normalize_text("x"))
    assert df.select(S.exclusion_reason(F.col("n"))).first()[0] == reason


def test_text_functions(spark):
    assert one(spark, "  Ａ b　c ", S.normalize_text("x"))[0] == "A b c"
    assert one(spark, "a, b,a,,c", S.split_urls(F.col("x")))[0] == ["a", "b", "c"]
    assert one(spark, "<p>a<script>x</script>b</p>", S.html_text(F.col("x")))[0] == "ab"
    assert one(spark, "https://x/y?a=1&b=%20z&c", S.url_query(F.col("x")))[0] == {"a": "1", "b": " z"}
    assert one(spark, "Sat Dec 23 17:12:54 +0800 2023", F.unix_seconds(S.rfc2822_time(F.col("x"))))[0] == int(dt.datetime(2023, 12, 23, 9, 12, 54, tzinfo=dt.UTC).timestamp())
    assert one(spark, "中文 abcd e", S.token_estimate(F.col("x")))[0] == 4


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan")],), ([],)], "x array<float>")
    assert [r[0] for r in df.select(S.vector_error(F.col("x"))).collect()] == [None, "zero norm", "not finite", "empty"]
    back = df.limit(1).withColumn("b", S.encode_vector("x")).select(S.decode_vector("b")).first()[0]
    assert back == [3.0, 4.0]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, t string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 1)], "id int, t string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    key = lambda x: sorted(x, key=lambda r: r[0])
    assert key(map(tuple, U.upsert(old, new, ["id"]).collect())) == [(1, "a", 5), (2, None, 9), (3, "c", 1)]
    assert rows(U.upsert(old, new, ["id"], default=U.KEEP_IF_NULL)) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]
    assert rows(U.upsert_counters(old, new, ["id"], ["n"])) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]
    again = U.upsert(U.upsert(old, new, ["id"]), new, ["id"])
    assert key(map(tuple, again.collect())) == key(map(tuple, U.upsert(old, new, ["id"]).collect()))
    assert tuple(U.upsert_counts(old, new.union(new), ["id"]).first()) == (4, 1, 3)
    with pytest.raises(ValueError):
        U.update_run(old, 1, {"x": 1}, ["t"])


def test_comment_issues(spark):
    df = spark.createDataFrame([("c", " ", "v", "c", 0, None), ("d", "ok", "v", None, 0, dt.datetime(2024, 1, 1))], "native_comment_id string, text string, native_content_id string, parent_comment_id string, depth int, published_at timestamp")
    good, bad = Q.route(Q.with_issues(df, Q.comment_rules()))
    assert [r.native_comment_id for r in good.collect()] == ["d"]
    assert {x.message for x in bad.first().issues} == {"Comment text is empty", "Comment is its own parent", "Root comment has a parent", "Publish time is missing"}


def test_label_validation(spark):
    df = spark.createDataFrame([("good and fast delivery",)], "text string").withColumn("output", L.rule_labels(F.col("text")))
    ok = L.validate_labels(df).first()
    assert ok.label_error is None and ok.label.sentiment == "positive"
    bad = L.validate_labels(df.withColumn("output", F.lit("[1]"))).first()
    assert bad.label_error == "not JSON" and bad.label is None


def test_labeler_isolates_failures(spark):
    def labeler(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return ["{}" for _ in texts]

    got = {r.text: r.failure for r in L.apply_labeler(spark.createDataFrame([("a",), ("bad",), ("c",)], "text string").coalesce(1), labeler).collect()}
    assert got["a"] is None and got["c"] is None and got["bad"].startswith("RuntimeError")


def test_normalizers(spark):
    raw = spark.createDataFrame([("7", "1", "0", " 你好 ", "1777456932", "1", "38")], "comment_id string, aweme_id string, parent_comment_id string, content string, create_time string, sub_comment_count string, like_count string")
    r = N.comments(raw, N.platform("dy"), "run").first()
    assert (r.depth, r.parent_comment_id, r.text, r.like_count, r.reply_count, r.language, r.errors) == (0, None, "你好", 38, 1, "zh", [])
    b = N.authors(spark.createDataFrame([("5", "1,234", "0")], "user_id string, total_fans string, is_official string"), N.BILIBILI).first()
    assert (b.follower_count, b.verified, b.profile_url) == (1234, True, "https://space.bilibili.com/5")
    with pytest.raises(ValueError):
        N.platform("other")


def test_flatten_rejects_other_aweme(spark):
    df = spark.createDataFrame([("1", '{"aweme_id":"2","cid":"c"}'), ("1", '{"aweme_id":"1","cid":"d","user":{"avatar_thumb":{"url_list":["u"]}}}')], "aweme_id string, raw string")
    assert [(r.comment_id, r.avatar) for r in C.douyin_comments(df).collect()] == [("d", "u")]


def test_landing_schemas():
    assert len(LANDING) == 22 and set(LANDING) == set(LANDING_KEYS)
    assert all(k in s.fieldNames() for n, s in LANDING.items() for k in LANDING_KEYS[n])


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a":1}\n\n[1]\nnope\n{"a":2}\n', encoding="utf-8")
    good, bad = A.read_jsonl(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "a int").schema)
    assert sorted(r.a for r in good.collect()) == [1, 2] and sorted(r.message for r in bad.collect()) == ["not JSON", "not an object"]
    (tmp_path / "c.csv").write_text('x,y\n1,"a\nb"\n')
    assert A.read_csv(spark, str(tmp_path / "c.csv")).first().asDict() == {"x": "1", "y": "a\nb"}


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="r"><sheets><sheet name="comments" r:id="i1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>text</t></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>hi</t></is></c></row><row><c r="A3"><v> </v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    got = A.read_xlsx(spark, str(tmp_path)).collect()
    assert [(r.sheet, r.row, r.record) for r in got] == [("comments", 2, {"id": "7", "text": "hi"})]


def test_catalog_and_changes(spark, tmp_path):
    for name in ("search_comments_2024.jsonl", "search_contents_2024.jsonl", "creator_creators_2024.jsonl"):
        (tmp_path / name).write_text("{}")
    files = A.catalog(spark, str(tmp_path))
    assert {r.name: r.kind for r in files.collect()} == {"search_comments_2024.jsonl": "comment", "search_contents_2024.jsonl": "content", "creator_creators_2024.jsonl": "author"}
    assert A.changed_files(files.limit(2), files).count() == 1
    assert A.latest_batch(files).count() >= 1
