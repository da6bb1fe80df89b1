"""HTML strings to text with built-in expressions (F1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, tidy_lines

# Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = r"&(?:#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"


def _character(entity: Column) -> Column:
    """What one entity stands for; itself if that is nothing."""
    name = F.lower(F.substring(entity, F.lit(2), F.length(entity) - 2))
    digits = F.regexp_extract(entity, r"^&#(?:x0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));$", 0)
    hexed = F.regexp_extract(entity, r"^&#x0*([0-9a-fA-F]{1,6});$", 1)
    plain = F.regexp_extract(entity, r"^&#0*([0-9]{1,7});$", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("long")
    usable = (digits != "") & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))[name]
    return F.coalesce(named, numeric, entity)


def decode_entities(s: Column) -> Column:
    """Decode entities in one pass, so that what one yields is not decoded again."""
    between = F.split(s, _ENTITY, -1)
    found = F.transform(F.regexp_extract_all(s, F.lit(_ENTITY), F.lit(0)), _character)
    joined = F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(s, F.lit("&")), joined).otherwise(s)


# Elements without text, and end tags that end a line.
UNSEEN = ("script", "style", "noscript", "template")
LINE_ENDS = ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
#: A token: a comment, an element without text as a whole, a tag, a run of text, or a lone <.
_TOKEN = "(?is)<!--.*?-->|" + "".join(rf"<{tag}\b[^>]*>.*?</{tag}{SPACE}*>|" for tag in UNSEEN) + "<[^>]+>|[^<]+|<"
_ENDS_LINE = rf"(?i)^<(br{SPACE}*/?|/({'|'.join(LINE_ENDS)}){SPACE}*)>$"


def html_to_text(html: Column) -> Column:
    """Text of an HTML fragment, token by token: no scripts, styles, templates, comments or tags; block ends are line ends; entities decoded."""
    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    markup = lambda t: t.startswith("<") & (F.length(t) > 1)
    texts = F.transform(tokens, lambda t: F.when(~markup(t), t).when(t.rlike(_ENDS_LINE), "\n").otherwise(""))
    return tidy_lines(decode_entities(F.array_join(texts, "")))
