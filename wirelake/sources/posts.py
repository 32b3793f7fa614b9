"""Saved web pages, submissions and captions as posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import text as tx

#: The characters of the category Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def inner_text(html: Column) -> Column:
    """Text of a piece of HTML: no tags, the common entities resolved, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def first_inside(html: Column, tag: str) -> Column:
    return F.nullif(inner_text(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def absolute_url(url: Column, base: Column) -> Column:
    """Resolve a link against the page it is on."""
    root = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(\w+://[^?#]*/)", 1)
    return (F.when(url.rlike(r"(?i)^\w+://"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), url))
            .when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(F.when(folder.rlike(r"^\w+://[^/]+/"), folder).otherwise(F.concat(root, F.lit("/"))), url)))


def pages_to_posts(pages: DataFrame, title: str = "h1", content: str = "article", author: str | None = None) -> DataFrame:
    """``page_id, url, html`` -> posts; pages without title or content are left out."""
    html = F.col("html")
    made = pages.select("page_id", "url", first_inside(html, title).alias("title"), first_inside(html, content).alias("content"),
                        (first_inside(html, author) if author else F.lit(None).cast("string")).alias("author"),
                        F.nullif(F.regexp_extract(html, r"(?i)<a\s[^>]*href=\"([^\"]*)\"", 1), F.lit("")).alias("_link"))
    kept = made.filter(F.col("title").isNotNull() & F.col("content").isNotNull())
    full = F.concat(F.col("title"), F.lit("\n\n"), F.col("content"))
    return kept.select("page_id", "url", "title", "content", "author", absolute_url(F.col("_link"), F.col("url")).alias("link"), tx.extract_vehicle(full).alias("vehicle"))


def submissions_to_posts(df: DataFrame) -> DataFrame:
    """``id, title, selftext, author, created_utc`` -> posts; a post without a body has its title as content, a missing author stays null.

    Titles stay as they are; a blank one is no content.  Blank is what holds only spaces of Unicode (Zs).
    """
    body, title = (F.nullif(F.trim(c, F.lit(SPACES)), F.lit("")) for c in ("selftext", "title"))
    content = F.coalesce(body, title)
    return df.filter(content.isNotNull()).select("id", "title", content.alias("content"), "author", F.timestamp_seconds("created_utc").alias("created_at"),
                                                 tx.extract_vehicle(F.concat_ws(" ", title, content)).alias("vehicle"))


def assemble_transcripts(captions: DataFrame) -> DataFrame:
    """``video_id, start, text`` -> one text per video, in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "text")))
    return captions.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), " ").alias("transcript"), F.count(F.lit(1)).alias("captions"))
