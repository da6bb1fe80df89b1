"""The default sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import SOURCES

# Id, name, feed, site.
FEEDS = [
    ("netflix", "Netflix TechBlog", "https://netflixtechblog.com/feed", "https://netflixtechblog.com/"),
    ("cloudflare", "Cloudflare Blog", "https://blog.cloudflare.com/rss/", "https://blog.cloudflare.com/"),
    ("stripe", "Stripe Blog", "https://stripe.com/blog/feed.rss", "https://stripe.com/blog/engineering"),
    ("meta", "Engineering at Meta", "https://engineering.fb.com/feed/", "https://engineering.fb.com/"),
    ("shopify", "Shopify Engineering", "https://shopify.engineering/blog.atom", "https://shopify.engineering/"),
    ("uber", "Uber Engineering", "https://www.uber.com/blog/engineering/rss/", "https://www.uber.com/us/en/blog/engineering/"),
    ("airbnb", "Airbnb Engineering & Data Science", "https://medium.com/feed/airbnb-engineering", "https://medium.com/airbnb-engineering"),
    ("github", "GitHub Engineering", "https://github.blog/engineering/feed/", "https://github.blog/engineering/"),
    ("google", "Chrome for Developers (Google)", "https://developer.chrome.com/static/blog/feed.xml", "https://developer.chrome.com/blog"),
    ("microsoft", "Engineering at Microsoft", "https://devblogs.microsoft.com/engineering-at-microsoft/feed/", "https://devblogs.microsoft.com/engineering-at-microsoft/"),
    ("linkedin", "LinkedIn Engineering", "https://engineering.linkedin.com/blog.rss.html", "https://www.linkedin.com/blog/engineering"),
    ("spotify", "Spotify Engineering", "https://engineering.atspotify.com/feed", "https://engineering.atspotify.com/"),
    ("pinterest", "Pinterest Engineering", "https://medium.com/feed/pinterest-engineering", "https://medium.com/pinterest-engineering"),
    ("atlassian", "Atlassian Engineering", "https://atlassianblog.wpengine.com/feed", "https://www.atlassian.com/blog/atlassian-engineering/cloud-overview"),
    ("slack", "Slack Engineering", "https://slack.engineering/feed/", "https://slack.engineering/"),
]

# Other addresses of feeds, by id, in the order to try.
ALTERNATES = {
    "uber": [
        "https://www.uber.com/en-US/blog/engineering/rss/",
        "https://www.uber.com/us/en/blog/engineering/rss/",
        "https://www.uber.com/blog/rss/",
        "https://eng.uber.com/feed/",
    ],
    "google": ["https://developers.googleblog.com/feeds/posts/default", "https://developers.googleblog.com/feed/"],
    "linkedin": ["https://www.linkedin.com/blog/engineering/rss"],
    "atlassian": [
        "https://www.atlassian.com/blog/atlassian-engineering/feed",
        "https://www.atlassian.com/blog/feed",
        "https://developer.atlassian.com/blog/feed.xml",
    ],
}

# Category filters, and listings by id: address, link pattern, exclude pattern.
CATEGORIES = {"stripe": ["Engineering"]}
LISTINGS = {
    "uber": (
        "https://www.uber.com/us/en/blog/engineering/",
        r"^https://www\.uber\.com/us/en/blog/[^/]+/?$",
        r"^https://www\.uber\.com/us/en/blog/(engineering|health|ride|eats|transit|business|earn|merchants|community|freight|safety|company|culture|data|ai|mobile|backend|web|security|research|careers|products?)/?$",
    ),
    "linkedin": ("https://www.linkedin.com/blog/engineering", r"^https://www\.linkedin\.com/blog/engineering/[^/]+/[^/]+$", None),
}


def seed_sources(spark: SparkSession) -> DataFrame:
    """The default sources as rows without state."""
    rows = [(i, n, f, ALTERNATES.get(i, []), s, CATEGORIES.get(i), *LISTINGS.get(i, (None,) * 3)) for i, n, f, s in FEEDS]
    given = "id string, name string, feed_url string, alt_feed_urls array<string>, site_url string, category_filter array<string>, listing_url string, listing_link_pattern string, listing_exclude_pattern string"
    seed = spark.createDataFrame(rows, given).withColumn("initialized", F.lit(False))
    shape = spark.createDataFrame([], SOURCES).schema
    return seed.select(*(F.col(f.name) if f.name in seed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields))


def targets(sources: DataFrame, *, alternates: bool = False) -> DataFrame:
    """What to fetch: (source_id, pos, url, etag, last_modified) of each source's feed, and with ``alternates`` of its other addresses, without validators."""
    main = sources.select(F.col("id").alias("source_id"), F.lit(0).alias("pos"), F.col("feed_url").alias("url"), "etag", "last_modified")
    if not alternates:
        return main
    others = sources.select(F.col("id").alias("source_id"), F.posexplode("alt_feed_urls").alias("pos", "url"))
    null = F.lit(None).cast("string")
    return main.unionByName(others.select("source_id", (F.col("pos") + 1).alias("pos"), "url", null.alias("etag"), null.alias("last_modified")))
