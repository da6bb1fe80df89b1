"""Text: white space, lengths in UTF-16 units, truncation, prompts, summaries. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C

#: White space of browsers: Java's \s lacks the non-ASCII ones.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Labels of prompts, and messages.
CONTENT_LABELS = {"page": "ページ本文", "rss": "RSS概要", "none": "なし"}
OMITTED = "（以下省略）"
ERRORS = {
    "auth": "APIキーが無効です",
    "not_found": "モデルIDが見つかりません",
    "rate_limit": "レート制限中です",
    "connection": "APIに接続できません（ネットワークを確認してください）",
}
SKIPPED = "本文を取得できなかったため要約をスキップしました"
UNREADABLE = "要約の JSON を解釈できませんでした: "
CHAT_PREFIX = (
    "あなたは技術記事についての質問に日本語で答えるアシスタントです。以下の記事の内容に基づいて回答し、"
    "記事に書かれていない事柄は「記事には記載がありません」と明示したうえで一般知識として補足してください。"
)


def trim_space(s: Column) -> Column:
    return F.btrim(s, F.lit(_SPACES))


def collapse_space(s: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(s, f"{SPACE}+", " "), F.lit(" "))


def tidy_lines(s: Column) -> Column:
    """Lines with one space for each run of blanks, and none at their ends; lines that follow each other are a paragraph, and one empty line parts paragraphs."""
    lines = F.transform(F.split(s, r"\r\n?|\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t]+", " "), F.lit(" ")))
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), r"\n{2,}"), lambda p: p != "")
    return trim_space(F.array_join(paragraphs, "\n\n"))


def utf16_length(s: Column) -> Column:
    """The length in UTF-16 units, which thresholds count."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def truncate(s: Column, n: Column | int, suffix: str = "") -> Column:
    """The first n UTF-16 units and a suffix if there are more; a character that would be split goes."""
    n = F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n))
    units = F.encode(s, "UTF-16LE")
    high = F.hex(F.substring(units, n * 2, F.lit(1)))
    cut = F.when((n > 0) & high.between("D8", "DB"), n - 1).otherwise(n)
    return F.when(utf16_length(s) <= n, s).otherwise(F.concat(F.decode(F.substring(units, F.lit(1), cut * 2), "UTF-16LE"), F.lit(suffix)))


def clamp(x: Column, low: int = 0, high: int | None = None) -> Column:
    """floor(x) within bounds; NaN and null count as 0."""
    x = F.coalesce(F.floor(F.nanvl(x.cast("double"), F.lit(0.0))), F.lit(0))
    x = F.greatest(F.lit(low), x)
    return x if high is None else F.least(F.lit(high), x)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def filter_key(ids: Column) -> Column:
    """One string for a set of ids, whatever their order."""
    return F.array_join(F.array_sort(ids), ",")


def choose_content(page_text: Column, rss_summary: Column) -> Column:
    """struct<content_source, text>: the page from 800 units on, else the feed's summary from 200, else none with what summary there is."""
    page = F.coalesce(page_text, F.lit(""))
    rss = F.coalesce(rss_summary, F.lit(""))
    source = (
        F.when(utf16_length(page) >= C.MIN_PAGE_TEXT_CHARS, "page").when(utf16_length(rss) >= C.MIN_RSS_TEXT_CHARS, "rss").otherwise("none")
    )
    return F.struct(source.alias("content_source"), F.when(source == "page", page).otherwise(rss).alias("text"))


def _meta(title: Column, source_name: Column, url: Column, published_at: Column) -> list[Column]:
    labels = (("タイトル: ", title), ("ソース名: ", source_name), ("URL: ", url), ("公開日: ", format_date(published_at)))
    return [F.concat(F.lit(label), value) for label, value in labels]


def build_summary_user(title, source_name, url, published_at, text: Column, content_source: Column, max_chars: int = C.MAX_CONTENT_CHARS) -> Column:
    label = F.create_map(*(F.lit(x) for kv in CONTENT_LABELS.items() for x in kv))[content_source]
    head = F.concat_ws("\n", *_meta(title, source_name, url, published_at), F.concat(F.lit("本文の取得元: "), label))
    return F.concat(head, F.lit("\n\n<article>\n"), truncate(text, max_chars, OMITTED), F.lit("\n</article>"))


def build_chat_system(title, source_name, url, published_at, text: Column) -> Column:
    head = F.concat_ws("\n", *_meta(title, source_name, url, published_at))
    return F.concat(F.lit(CHAT_PREFIX + "\n\n"), head, F.lit("\n\n<article>\n"), text, F.lit("\n</article>"))


def summary_as_text(summary: Column) -> Column:
    """Headline, brief, digest as a list and detail, parted by empty lines; empty ones are left out."""
    digest = F.array_join(F.transform(summary["digest"], lambda d: F.concat(F.lit("- "), d)), "\n")
    parts = F.array(summary["headline"], summary["brief"], digest, summary["detail"])
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n\n")


def _strict_summary(v: Column) -> Column:
    """The summary struct of a variant; null if a field is missing or of another type."""
    texts, lists = ("headline", "brief", "detail"), ("digest", "tags")
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    ok = F.lit(True)
    for name in texts:
        ok = ok & is_text(F.try_variant_get(v, f"$.{name}", "variant"))
    for name in lists:
        ok = ok & F.coalesce(F.forall(F.try_variant_get(v, f"$.{name}", "array<variant>"), is_text), F.lit(False))
    field = lambda name: F.try_variant_get(v, f"$.{name}", "array<string>" if name in lists else "string").alias(name)
    return F.when(ok, F.struct(*map(field, ("headline", "brief", "digest", "detail", "tags"))))


def parse_summary(text: Column) -> Column:
    """The summary struct in a model's answer: of the whole text if it is JSON, else of what is from the first { to the last }; null if a type is wrong.

    The text is parsed once, and what is inside it only where the whole is no JSON.
    """
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.array(F.coalesce(F.try_parse_json(text), F.try_parse_json(inner)))
    return F.element_at(F.transform(parsed, lambda v: _strict_summary(v)), 1)


def error_message(kind: Column, status: Column, message: Column) -> Column:
    """What a failed enrichment is recorded as, by the class of its error."""
    told = F.create_map(*(F.lit(x) for kv in ERRORS.items() for x in kv))
    api = F.concat(F.lit("APIエラー ("), status.cast("string"), F.lit("): "), message)
    return F.coalesce(told[kind], api, message, F.lit(""))


def is_billing_or_auth(status: Column, message: Column) -> Column:
    """Errors after which a batch stops: 401, and 400 that names the credit balance."""
    return F.coalesce((status == 401) | ((status == 400) & F.lower(message).contains("credit balance")), F.lit(False))
