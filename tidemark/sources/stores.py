"""Store, forum and video bodies (JSON) as rows; parsing stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import to_cents

PRODUCTS = "struct<products:array<struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,tags:array<string>,variants:array<struct<id:bigint,title:string,sku:string,price:string,available:boolean>>>>>"
LISTING = "struct<data:struct<after:string,children:array<struct<kind:string,data:struct<id:string,name:string,title:string,selftext:string,body:string,author:string,created_utc:double,permalink:string,parent_id:string>>>>>"
THREADS = "struct<nextPageToken:string,items:array<struct<id:string,snippet:struct<topLevelComment:struct<id:string,snippet:struct<textOriginal:string,textDisplay:string,authorChannelId:struct<value:string>,publishedAt:string>>>>>>"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def page_urls(paths: DataFrame, pages: int, limit: int) -> DataFrame:
    """url of each page of each path template with {page} and {limit}; another brace is an error."""
    each = paths.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    url = F.replace(F.replace("path", F.lit("{page}"), F.col("page").cast("string")), F.lit("{limit}"), F.lit(str(limit)))
    return each.withColumn("url", F.when(url.contains("{"), F.raise_error(F.concat(F.lit("unknown placeholder in "), url)).cast("string")).otherwise(url))


def variants(bodies: DataFrame, base: str, brand: str | None = None) -> DataFrame:
    """A row for each variant of product JSON in ``body``: title, url, brand, sku, price_cents, in_stock, tags.

    Variants without a readable price above zero, and products without handle, title or brand, are dropped.
    """
    product = bodies.select(F.explode(F.from_json("body", PRODUCTS)["products"]).alias("p"))
    rows = product.select("p", F.explode("p.variants").alias("v"))
    maker = F.lit(brand) if brand else F.col("p.vendor")
    plain = _blank(F.col("v.title")) | (F.col("v.title") == "Default Title")
    made = rows.select(
        F.when(plain, F.col("p.title")).otherwise(F.concat("p.title", F.lit(" — "), "v.title")).alias("title"),
        F.concat(F.lit(f"{base}/products/"), F.col("p.handle"), F.lit("?variant="), F.col("v.id").cast("string")).alias("url"),
        maker.alias("brand"),
        F.when(~_blank(F.col("v.sku")), F.col("v.sku")).alias("sku"),
        to_cents(F.col("v.price")).alias("price_cents"),
        F.coalesce("v.available", F.lit(False)).alias("in_stock"),
        F.concat(F.coalesce("p.tags", F.array().cast("array<string>")), F.array_compact(F.array("p.product_type", "v.title"))).alias("tags"),
        (_blank(F.col("p.handle")) | _blank(F.col("p.title")) | _blank(maker)).alias("bad"),
    )
    return made.where("price_cents > 0 and not bad").drop("bad")


def posts(bodies: DataFrame, since: Column) -> DataFrame:
    """Forum posts of listing JSON, newer than ``since``, without tombstones: source_id, title, text, author, posted_at, url."""
    d = bodies.select(F.explode(F.from_json("body", LISTING)["data"]["children"]).alias("c")).where("c.kind is null or c.kind <> 't1'").select("c.data.*")
    at = F.timestamp_seconds("created_utc")
    gone = F.coalesce(F.col("selftext").isin("[deleted]", "[removed]"), F.lit(False)) | F.coalesce(F.col("author") == "[deleted]", F.lit(False))
    return d.where((at > since) & ~gone).select(F.col("name").alias("source_id"), "title", F.coalesce("selftext", F.lit("")).alias("text"), "author", at.alias("posted_at"), F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"))


def comments(bodies: DataFrame) -> DataFrame:
    """Top-level forum comments: source_id, parent_source_id, text, author, posted_at."""
    d = bodies.select(F.explode(F.from_json("body", LISTING)["data"]["children"]).alias("c")).where("c.kind = 't1'").select("c.data.*")
    gone = F.coalesce(F.col("body").isin("[deleted]", "[removed]"), F.lit(False))
    return d.where(~gone).select(F.col("name").alias("source_id"), F.col("parent_id").alias("parent_source_id"), F.col("body").alias("text"), "author", F.timestamp_seconds("created_utc").alias("posted_at"))


def video_comments(bodies: DataFrame) -> DataFrame:
    """Top-level video comments: source_id, text, author, posted_at (null if unreadable)."""
    item = bodies.select(F.explode(F.from_json("body", THREADS)["items"]).alias("i")).select("i.snippet.topLevelComment.*")
    return item.select(F.col("id").alias("source_id"), F.coalesce("snippet.textOriginal", "snippet.textDisplay", F.lit("")).alias("text"), F.col("snippet.authorChannelId.value").alias("author"), F.try_to_timestamp("snippet.publishedAt").alias("posted_at"))


def labels(spark, path: str, columns: list[str], key: list[str], one_of: dict[str, list[str]]) -> DataFrame:
    """Tab-separated labels with # comments and a header; a duplicate key or an unknown value is an error."""
    rows = spark.read.csv(path, sep="\t", comment="#", header=True, schema=", ".join(f"{c} string" for c in columns))
    for c, allowed in one_of.items():
        if rows.where(~F.col(c).isin(allowed) | F.col(c).isNull()).limit(1).count():
            raise ValueError(f"{path}: {c} must be one of {allowed}")
    if twice := rows.groupBy(*key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{path}: duplicate label {twice[0].asDict()}")
    return rows
