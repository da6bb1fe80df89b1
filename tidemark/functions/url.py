"""URLs with built-in expressions: canonical form, key, and the predicates of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import trim_space

# Parameters that only track.
TRACKING = ("source", "ref", "mkt_tok", "fbclid", "gi")
_WEB = r"(?i)^(https?):[/\\]*(?:[^/\\?#]*@)?([^/\\?#@]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_OTHER = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#]*@)?([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _form_decoded(s: Column) -> Column:
    return F.url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"))


def _query(raw: Column) -> Column:
    """A query string without tracking parameters, re-encoded as a form is."""
    pairs = F.filter(F.split(F.substring(raw, 2, 1 << 30), "&", -1), lambda p: p != "")
    name = lambda p: _form_decoded(F.substring_index(p, "=", 1))
    kept = F.filter(pairs, lambda p: ~(name(p).startswith("utm_") | name(p).isin(*TRACKING)))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(name(p)), F.lit("="), F.url_encode(_form_decoded(value(p))))), "&")


def _path(raw: Column) -> Column:
    """A path with its dot segments resolved and blanks escaped, from its first slash."""
    slashed = F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), " ", "%20")
    plain = F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))

    def step(done: Column, part: Column) -> Column:
        up = F.lower(part).isin("..", ".%2e", "%2e.", "%2e%2e")
        here = F.lower(part).isin(".", "%2e")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).when(here, done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(plain, 2, 1 << 30), "/", -1)
    resolved = F.aggregate(parts, F.array().cast("array<string>"), step)
    dotted = F.lower(F.element_at(parts, -1)).isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e")
    out = F.concat(F.lit("/"), F.array_join(F.when(dotted, F.concat(resolved, F.array(F.lit("")))).otherwise(resolved), "/"))
    return F.when(plain.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), out).otherwise(plain)


def _one_slash_less(path: Column) -> Column:
    return F.regexp_replace(path, "/$", "")


def normalize_url(url: Column) -> Column:
    """The canonical form under which a page counts once.

    https for http, host in lower case without user and default port, no fragment, no tracking parameters, one trailing slash less. What
    is no URL is only trimmed. Applied to its result it changes nothing, but where a path ends with several slashes.
    """
    s = trim_space(url)
    web = s.rlike(_WEB)
    host = F.lower(F.regexp_replace(F.regexp_extract(s, _WEB, 2), r":(80|443)?$", ""))
    bad_port = F.regexp_extract(s, _WEB, 2).rlike(r":(?![0-9]*$)") & ~F.regexp_extract(s, _WEB, 2).startswith("[")
    usable = host.rlike(r"^[^\s<>^|%]+$") & ~bad_port
    query = _query(F.regexp_extract(s, _WEB, 4))
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    canonical = F.concat(F.lit("https://"), host, _one_slash_less(_path(F.regexp_extract(s, _WEB, 3))), tail)
    other_query = _query(F.regexp_extract(s, _OTHER, 4))
    other = F.concat(
        F.lower(F.regexp_extract(s, _OTHER, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(s, _OTHER, 2)),
        _one_slash_less(F.regexp_extract(s, _OTHER, 3)),
        F.when(other_query != "", F.concat(F.lit("?"), other_query)).otherwise(""),
    )
    return F.when(web & usable, canonical).when(~s.rlike("(?i)^https?:") & s.rlike(_OTHER), other).otherwise(s)


def url_key(url: Column) -> Column:
    """The key of the page at a URL."""
    return F.sha2(normalize_url(url), 256)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def segments(url: Column) -> Column:
    """The non-empty parts of the path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def without_locale(parts: Column) -> Column:
    """Path parts after leading ones such as en or pt-BR."""
    other = F.transform(parts, lambda p: ~p.rlike("(?i)^[a-z]{2}(-[a-z]{2})?$"))
    first = F.array_position(other, True)
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(parts, F.greatest(first, F.lit(1)).cast("int"), F.size(parts)))


def is_listing_or_above(url: Column, listing: Column) -> Column:
    """Whether a URL is the listing itself or a page above it, the root included."""
    own, base = segments(url), segments(listing)
    above = (F.size(own) <= F.size(base)) & (own == F.slice(base, F.lit(1), F.size(own)))
    return (origin(url) == origin(listing)) & F.coalesce(above, F.lit(False))


def is_locale_variant(url: Column, listing: Column) -> Column:
    """Whether a URL is the listing in another language."""
    own, base = without_locale(segments(url)), without_locale(segments(listing))
    return (origin(url) == origin(listing)) & (F.size(base) > 0) & (own == base)


def has_page_query(url: Column) -> Column:
    return url.rlike(r"^[^#]*[?&]page(=|&|#|$)")


def excluded(url: Column, listing: Column, pattern: str | None = None) -> Column:
    out = is_listing_or_above(url, listing) | is_locale_variant(url, listing) | has_page_query(url)
    return out if pattern is None else out | url.rlike(pattern)


def is_word_category(url: Column, title: Column) -> Column:
    """A one-word last path part with a one-word title is a category, not an article."""
    last = F.element_at(segments(url), -1)
    one_word = (title != "") & ~title.rlike(r"\s")
    return F.coalesce((F.size(segments(url)) > 0) & ~last.rlike("[-0-9]") & one_word, F.lit(False))


def is_ignorable_href(href: Column) -> Column:
    s = trim_space(href)
    return F.coalesce((s == "") | s.startswith("#") | s.rlike("(?i)^(javascript|mailto):"), F.lit(True))
