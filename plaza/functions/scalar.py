"""Column expressions for cleaning, parsing and scoring records. All run in the JVM except the three marked Arrow UDFs."""

from __future__ import annotations

import math
import struct
import unicodedata
from collections.abc import Callable, Sequence
from uuid import NAMESPACE_URL

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole texts that count as generic replies.
GENERIC_REPLIES = (
    "好的", "好吧", "可以", "可以的", "是的", "不是", "来了", "来吧", "我在",
    "在吗", "有吗", "没有", "真的吗", "真的", "支持", "收到", "知道了", "明白了",
)
# Fixed value: characters that carry information (ASCII letters and digits, CJK ideographs and extension A).
INFORMATIVE = "[A-Za-z0-9㐀-䶿一-鿿]"
# Fixed value: texts of digits and separators only.
NUMERIC_ONLY = r"^[\d\s.,，。!！?？:：;；+\-_/\\]+$"
_CJK = "[㐀-䶿一-鿿]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used (bound by a lambda)."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def optional_string(x: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def count_error(x: Column, strict: bool = True) -> Column:
    """True if a non-empty value is not a whole number of at least 0. Lenient values may have commas and a zero fraction."""
    text = optional_string(x)
    return text.isNotNull() & non_negative_int(x, strict).isNull()


def non_negative_int(x: Column, strict: bool = True) -> Column:
    """A count, or null where it is missing or wrong; see ``count_error``."""
    text = optional_string(x)
    if strict:
        number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    else:
        real = F.regexp_replace(text, ",", "").try_cast("double")
        number = F.when(real == F.floor(real), real.cast("bigint"))
    return F.when(number >= 0, number)


def split_urls(*columns: Column) -> Column:
    """Distinct trimmed parts of comma-separated URL columns, in the order of first sight."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c.cast("string"), F.lit("")), ",") for c in columns]))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def uuid5(name: Column, namespace: bytes = NAMESPACE_URL.bytes) -> Column:
    """RFC 4122 version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex())), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def entity_id(platform: str, kind: str, native: Column, prefix: str = "plaza") -> Column:
    """The stable id of an entity of a platform; null for a null native id."""
    return F.when(native.isNotNull(), uuid5(F.concat(F.lit(f"{prefix}:{platform}:{kind}:"), native)))


def parse_time(x: Column) -> Column:
    """UTC time of epoch seconds or (from 1e11 on) milliseconds, or of an ISO text; naive texts are UTC; bad values are null."""
    text = optional_string(x)
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("bigint"))).otherwise(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text)))


def time_error(x: Column) -> Column:
    return optional_string(x).isNotNull() & parse_time(x).isNull()


def _by_slices(x: pa.Array, use: Callable[[str], str], rows: int = 128) -> pa.Array:
    """``use`` of each text that is not null; only a slice of the batch is held as Python objects at a time."""
    parts = [pa.array([None if t is None else use(t) for t in x.slice(lo, rows).to_pylist()], pa.string()) for lo in range(0, len(x), rows)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def normalize_text(x: pa.Array) -> pa.Array:
    """NFKC, white space collapsed and trimmed (Arrow UDF: Spark has no Unicode normalisation)."""
    return _by_slices(x, lambda t: " ".join(unicodedata.normalize("NFKC", t).split()))


@F.arrow_udf(T.StringType())
def folded_text(x: pa.Array) -> pa.Array:
    """``normalize_text`` with case folded (Arrow UDF); the key for text deduplication."""
    return _by_slices(x, lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def text_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def language_hint(text: Column) -> Column:
    return F.when(text.rlike(_CJK), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def content_kind(video: Column, images: Column, code: Column) -> Column:
    return F.when(optional_string(video).isNotNull(), "video").when(optional_string(images).isNotNull(), "image").otherwise(F.concat(F.lit("aweme_"), F.coalesce(optional_string(code), F.lit("unknown"))))


def parent_id(x: Column) -> Column:
    """The parent comment, or null for a root (empty or "0")."""
    return F.nullif(optional_string(x), F.lit("0"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<.*?>", "")


def html_text(html: Column) -> Column:
    """Text without script and style blocks and without tags, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<[^>]+>", ""))


def rfc2822_time(x: Column) -> Column:
    """The instant of dates like ``Sat Dec 23 17:12:54 +0800 2023`` (converted by their own offset)."""
    return F.try_to_timestamp(F.substring(x, 5, 100), F.lit("MMM dd HH:mm:ss xx yyyy"))


def first_integer(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))


def url_query(url: Column) -> Column:
    """The parameters of a URL, decoded; an empty map without any."""
    raw = F.str_to_map(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
    kept = F.map_filter(raw, lambda k, v: (k != "") & v.isNotNull() & (v != ""))
    return F.transform_values(kept, lambda k, v: F.url_decode(v))


def _found(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), pattern, 1), F.lit(""))


def id_from_url(platform: str, url: Column) -> Column:
    """The native id in a URL or a bare id: notes, videos, threads or articles by platform."""
    bare = lambda p: F.when(url.rlike(p), url)
    if platform == "xhs":
        return F.coalesce(_found(url, r"/(?:explore|discovery/item)/([0-9A-Za-z]+)"), bare("^[0-9a-f]{24}$"))
    if platform == "douyin":
        return F.coalesce(_found(url, r"[?&]modal_id=(\d+)"), _found(url, r"/(?:video|note)/(\d+)"), bare(r"^\d+$"))
    if platform == "kuaishou":
        return F.coalesce(_found(url, r"/short-video/([0-9A-Za-z_-]+)"), F.when(~url.contains("/"), url))
    if platform == "bilibili":
        return F.coalesce(_found(url, r"/video/(BV[0-9A-Za-z]+)"), bare("^BV[0-9A-Za-z]+$"))
    if platform == "zhihu":
        return F.coalesce(_found(url, r"/(?:answer|p|zvideo)/(\d+)"), bare(r"^\d+$"))
    if platform == "tieba":
        return F.coalesce(_found(url, r"/p/(\d+)"), bare(r"^\d+$"))
    raise ValueError(f"unknown platform {platform}")


def creator_from_url(platform: str, url: Column) -> Column:
    patterns = {"xhs": r"/user/profile/([0-9A-Za-z]+)", "douyin": r"/user/([0-9A-Za-z_.-]+)", "kuaishou": r"/profile/([0-9A-Za-z_-]+)", "bilibili": r"space\.bilibili\.com/(\d+)", "zhihu": r"/people/([0-9A-Za-z_-]+)", "tieba": r"[?&]id=([^&]+)"}
    return F.coalesce(_found(url, patterns[platform]), F.when(~url.contains("/"), url))


def zhihu_kind(url: Column) -> Column:
    return F.when(url.contains("/answer/"), "answer").when(url.contains("/zvideo/"), "zvideo").when(url.contains("/p/"), "article").otherwise("")


def gender(platform: str, code: Column) -> Column:
    """Gender by the codes of each platform; null or an empty text where it is unknown."""
    codes = {"douyin": {"0": "Unknown", "1": "Male", "2": "Female"}, "xhs": {"1": "Female", "0": "Male"}, "weibo": {"f": "Female"}, "tieba": {"1": "Male", "2": "Female"}, "zhihu": {"1": "Male", "0": "Female"}}
    other = {"weibo": "Male", "tieba": "Unknown", "zhihu": "Unknown"}
    if platform in codes:
        c, out = code.cast("string"), F.when(F.lit(False), F.lit(None).cast("string"))
        for k, v in codes[platform].items():
            out = out.when(c == k, v)
        return out.otherwise(F.lit(other.get(platform)))
    raise ValueError(f"unknown platform {platform}")


def forum_name(x: Column, suffix: str = "吧") -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("")).when(x.endswith(suffix), x).otherwise(F.concat(x, F.lit(suffix)))


def forum_link(x: Column, base: str, suffix: str = "吧") -> Column:
    bare = F.when(x.endswith(suffix), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    return F.concat(F.lit(base), F.url_encode(bare))


def epoch_time(x: Column) -> Column:
    """Time of an epoch number, in milliseconds if above 1e12."""
    n = x.cast("bigint")
    return F.timestamp_millis(F.when(n > 10**12, n).otherwise(n * 1000))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def token_estimate(text: Column) -> Column:
    """CJK characters plus a quarter of the other characters that are not white space, at least 1."""
    cjk = F.regexp_count(text, F.lit(_CJK))
    other = F.regexp_count(text, F.lit(r"(?U)\S")) - cjk
    return F.greatest(F.lit(1), (cjk + F.ceil(other / 4)).cast("int"))


# Fixed value: emoji written as a name in brackets.
BRACKET_EMOJI = r"\[[^\]\r\n]{1,16}\]"


def _without_bracket_emoji(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(normalized, BRACKET_EMOJI, ""))


def informative_count(normalized: Column) -> Column:
    return F.regexp_count(_without_bracket_emoji(normalized), F.lit(INFORMATIVE))


# The rules of ``exclusion_reason`` in their order, and those of them that look at the amount of information alone.
EXCLUSION_RULES = ("empty", "emoji_only", "numeric_only", "too_short", "generic_reply", "repetitive")
INFORMATION_RULES = EXCLUSION_RULES[:4]


def exclusion_reason(normalized: Column, least: int = 2, rules: Sequence[str] = EXCLUSION_RULES) -> Column:
    """Why a normalized text carries too little meaning, or null if it is eligible. The first of ``rules`` that holds counts."""
    most = max(9, least)  # as far as the rules count
    few = F.regexp_extract(_without_bracket_emoji(normalized), f"^(?:[^{INFORMATIVE[1:]}*{INFORMATIVE}){{0,{most}}}", 0)

    def first(v: Column) -> Column:
        rest, n = v["rest"], F.regexp_count(v["few"], F.lit(INFORMATIVE))
        letters = F.regexp_extract_all(F.lower(rest), F.lit(f"({INFORMATIVE})"))
        holds = {
            "empty": v["empty"],
            "emoji_only": n == 0,
            "numeric_only": rest.rlike(NUMERIC_ONLY),
            "too_short": n < least,
            "generic_reply": F.lower(rest).isin(*GENERIC_REPLIES),
            "repetitive": (n <= 8) & (F.size(F.array_distinct(letters)) == 1),
        }
        return F.coalesce(*[F.when(holds[r], r) for r in EXCLUSION_RULES if r in rules])

    return once(F.struct(_without_bracket_emoji(normalized).alias("rest"), few.alias("few"), (F.coalesce(normalized, F.lit("")) == "").alias("empty")), first)


def information_score(normalized: Column) -> Column:
    """0 to 1 for length and variety of a normalized text."""
    text = F.coalesce(normalized, F.lit(""))
    bare = F.regexp_replace(text, r"(?U)\s", "")
    parts = F.struct(bare.alias("bare"), F.length(bare).alias("total"), F.regexp_count(text, F.lit(INFORMATIVE)).alias("good"))

    def score(v: Column) -> Column:
        total, good = v["total"], v["good"]
        chars = F.filter(F.array_distinct(F.split(v["bare"], "")), lambda c: c != "")
        runs = F.transform(chars, lambda c: total - F.length(F.replace(v["bare"], c, F.lit(""))))
        penalty = F.greatest(F.lit(0.0), (F.array_max(runs) / total - 0.35) / 0.65)
        raw = (0.55 * F.least(good, F.lit(80)) / 80 + 0.45 * good / total) * (1 - penalty)
        return F.when(good == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))

    return once(parts, score)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 5, "short").when(n <= 20, "medium").otherwise("long")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def vector_error(v: Column) -> Column:
    """Why a vector cannot be used, or null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) == 0), "empty").when(bad, "not finite").when(dot(v, v) == 0, "zero norm")


def unit_vector(v: Column) -> Column:
    """The vector at length 1, or null if ``vector_error``."""
    return F.when(vector_error(v).isNull(), F.transform(v, lambda x: (x.cast("double") / F.sqrt(dot(v, v))).cast("float")))


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes (Arrow UDF, for exports)."""
    return v.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    """Floats of little-endian bytes; null where the length or a value is wrong (Arrow UDF, for imports)."""

    def one(x: bytes | None) -> Sequence[float] | None:
        if x is None or not x or len(x) % 4:
            return None
        got = list(struct.unpack(f"<{len(x) // 4}f", x))
        return got if all(map(math.isfinite, got)) else None

    return b.map(one)


def canonical_hash(*pairs: tuple[str, Column]) -> Column:
    """sha256 of the compact JSON object of the named columns, keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(pairs, key=lambda p: p[0])]), {"ignoreNullFields": "false"}), 256)


def risk_score(negative: Column, medium: Column, high: Column, analyzed: Column) -> Column:
    """0 to 100: half for negative tone, 35 for high risk, 15 for medium risk."""
    raw = (50 * negative + 35 * high + 15 * medium) / analyzed
    return F.when(analyzed > 0, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2)).otherwise(0.0)


def day_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last second of an inclusive range of dates; null if it is reversed."""
    ok = F.to_date(start) <= F.to_date(end)
    return F.when(ok, F.to_date(start).cast("timestamp")), F.when(ok, F.date_add(F.to_date(end), 1).cast("timestamp") - F.expr("interval 1 second"))


def verified(x: Column) -> Column:
    return optional_string(x).try_cast("double").cast("bigint") >= 0


def hash_embedding(text: Column, dimension: int = 16) -> Column:
    """A deterministic unit vector for a text: the default test embedder, JVM only."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{i}:"), text), 256), 1, 12), 16, 10).cast("double")
    parts = F.array(*[(part(i) / float(1 << 47) - 1.0).cast("float") for i in range(dimension)])
    return F.element_at(F.transform(F.array(parts), unit_vector), 1)  # bound by the lambda, so that the text is hashed once a dimension
