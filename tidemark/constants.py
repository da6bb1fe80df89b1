"""Limits that are part of the semantics."""

# Fixed values.
NEW_ITEM_GRACE_DAYS = 3
MAX_NEW_PER_SOURCE_PER_RUN = 20
MAX_SUMMARIES_PER_RUN = 30
MAX_CONTENT_CHARS = 60_000
MIN_PAGE_TEXT_CHARS = 800
MIN_RSS_TEXT_CHARS = 200
FULL_CONTENT_CHARS = 2000
LOCK_STALE_MINUTES = 20
SUMMARIZING_STALE_MINUTES = 15
FETCH_TIMEOUT_SECONDS = 20
MAX_PAGE_BYTES = 3 * 1024 * 1024
FEED_CONCURRENCY = 4
SUMMARY_CONCURRENCY = 3
MIN_INTERVAL_MINUTES, DEFAULT_INTERVAL_MINUTES = 15, 1440
MIN_YEAR = 1990
LISTING_MIN_ANCHOR_CHARS = 20
LISTING_TIME_DEPTH = 3
LISTING_TEXT_DATE_DEPTH = 6
LISTING_TEXT_DATE_CHARS = 20_000
PAGE_H1_DEPTH = 5
PAGE_BODY_HEAD_CHARS = 3000
PAGE_SCRIPT_CHARS = 2 * 1024 * 1024
