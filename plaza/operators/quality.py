"""Row checks as arrays of issues, and the routing of rows by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import scalar as S

Rule = tuple[str, str, Column]  # severity, message, condition


def _blank(c: str) -> Column:
    return S.optional_string(F.col(c)).isNull()


def content_rules() -> list[Rule]:
    return [
        ("error", "Content ID is empty", _blank("native_content_id")),
        ("warning", "Publish time is missing", F.col("published_at").isNull()),
        ("warning", "Both title and body are empty", (F.coalesce("title", F.lit("")) == "") & (F.coalesce("body", F.lit("")) == "")),
    ]


def comment_rules(known: str | None = None) -> list[Rule]:
    """``known`` names a boolean column that says whether the content exists."""
    parent = F.col("parent_comment_id")
    rules = [
        ("error", "Comment ID is empty", _blank("native_comment_id")),
        ("error", "Comment text is empty", _blank("text")),
        ("error", "Content ID is empty", _blank("native_content_id")),
        ("error", "Comment is its own parent", F.coalesce(parent == F.col("native_comment_id"), F.lit(False))),
        ("error", "Root comment has a parent", (F.col("depth") == 0) & parent.isNotNull()),
        ("error", "Reply has no parent", (F.col("depth") > 0) & parent.isNull()),
        ("warning", "Publish time is missing", F.col("published_at").isNull()),
    ]
    return rules + ([("error", "Referenced content does not exist", ~F.col(known))] if known else [])


def author_rules() -> list[Rule]:
    return [("error", "Author ID is empty", _blank("native_author_id")), ("warning", "Author nickname is missing", F.coalesce("nickname", F.lit("")) == "")]


def analysis_rules() -> list[Rule]:
    """Limits of label rows."""
    from plaza.operators import labeling as L

    enum = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return [
        ("error", "sentiment", enum("sentiment", L.SENTIMENTS)),
        ("error", "emotion", enum("emotion", L.EMOTIONS)),
        ("error", "stance", enum("stance", L.STANCES)),
        ("error", "risk_level", enum("risk_level", L.RISKS)),
        ("error", "sentiment_score", ~F.coalesce(F.col("sentiment_score").between(-1, 1), F.lit(False))),
        ("error", "topics", F.size("topics") > 10),
        ("error", "keywords", F.size("keywords") > 15),
        ("error", "risk_reasons", F.size("risk_reasons") > 10),
    ]


def domain_rules() -> list[Rule]:
    """Limits of comment rows: counts of at least 0, a 64-digit hash, a known language hint."""
    return [
        ("error", "like_count is negative", F.coalesce(F.col("like_count") < 0, F.lit(False))),
        ("error", "text_hash is not sha256", ~F.coalesce(F.col("text_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("error", "language is unknown", ~F.coalesce(F.col("language").isin("zh", "en", "unknown"), F.lit(False))),
    ]


def with_issues(df: DataFrame, rules: list[Rule], name: str = "issues") -> DataFrame:
    found = F.array(*[F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for severity, message, when in rules])
    return df.withColumn(name, F.array_compact(found))


def with_known_content(comments: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds content_known: the content of the comment exists on its platform."""
    known = contents.select("platform", "native_content_id").distinct().withColumn("_known", F.lit(True))
    return comments.join(known, ["platform", "native_content_id"], "left").withColumn("content_known", F.coalesce("_known", F.lit(False))).drop("_known")


def route(df: DataFrame, issues: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and rows with one."""
    bad = F.exists(issues, lambda x: x["severity"] == "error")
    return df.where(~bad), df.where(bad)


def issue_rows(df: DataFrame, entity: str, native: str, issues: str = "issues") -> DataFrame:
    x = df.select(F.lit(entity).alias("entity_type"), F.col(native).cast("string").alias("native_id"), F.explode(issues).alias("x"))
    return x.select("entity_type", "native_id", "x.severity", "x.message")


def issue_sample(rows: DataFrame, most: int = 100) -> DataFrame:
    """At most ``most`` issues, errors first."""
    return rows.orderBy("severity", "entity_type", "native_id", "message").limit(most)


def ingest_report(read: DataFrame, inserted: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows read, keys inserted, repeated rows, invalid rows and warnings. ``read`` has issues."""
    bad = F.exists("issues", lambda x: x["severity"] == "error")
    warned = F.size(F.filter("issues", lambda x: x["severity"] == "warning"))
    a = read.agg(F.count("*").alias("read"), F.count_if(bad).alias("invalid"), F.coalesce(F.sum(warned), F.lit(0)).alias("warnings"), F.count_if(~bad).alias("valid"))
    b = inserted.select(*key).distinct().agg(F.count("*").alias("inserted"))
    return a.crossJoin(F.broadcast(b)).withColumn("duplicate", F.col("valid") - F.col("inserted")).drop("valid")  # one row each
