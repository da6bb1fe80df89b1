"""Schemas of the stored relations and of what parsers return."""

SUMMARY = "struct<headline:string,brief:string,digest:array<string>,detail:string,tags:array<string>>"

SOURCES = (
    "id string, name string, feed_url string, alt_feed_urls array<string>, site_url string, category_filter array<string>, "
    "initialized boolean, etag string, last_modified string, last_fetched_at timestamp, last_status string, last_error string, "
    "last_item_count int, listing_url string, listing_link_pattern string, listing_exclude_pattern string, "
    "latest_published_at timestamp, last_fetch_mode string"
)

ARTICLES = (
    "id string, source_id string, guid string, title string, url string, published_at timestamp, published_at_provisional boolean, "
    "created_at timestamp, rss_summary string, content_text string, content_source string, content_chars int, "
    f"summary {SUMMARY}, status string, error string, attempts int, model string, summarizing_at timestamp, "
    "summarized_at timestamp, read_at timestamp"
)

CHATS = "article_id string, messages array<struct<role:string,content:string,created_at:timestamp>>, updated_at timestamp"

FETCHES = "source_id string, url string, status int, content_type string, etag string, last_modified string, body string, error string"

FEED_ITEMS = (
    "source_id string, pos int, format string, title string, link string, guid string, published_at timestamp, "
    "categories array<string>, content_html string, has_full_content boolean"
)

LISTING_ITEMS = "pos int, url string, title string, published_at timestamp"

CANDIDATES = (
    "source_id string, pos int, id string, link string, title string, guid string, published_at timestamp, content_html string"
)
