"""HTML to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_all

# Named entities each variant decodes, in order.
CARD_ENTITIES = (("&amp;", "&"), ("&#39;|&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "))
DETAIL_ENTITIES = (("&#x27;|&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&nbsp;", " "))


def _collapse(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Card variant: tags become blanks, the common entities are decoded."""
    out = F.regexp_replace(html, r"<[^>]+>", " ")
    for pattern, plain in CARD_ENTITIES:
        out = F.regexp_replace(out, pattern, plain)
    return _collapse(out)


def numeric_entities(text: Column) -> Column:
    """Decode ``&#NNN;`` references.

    The text is cut at each reference: pieces after the first start with the code.
    """

    def piece(p: Column) -> Column:
        code = F.regexp_extract(p, r"^(\d+);", 1)
        # one UTF-16 unit, as two big-endian bytes; from 2**69 on a double is a multiple of 65536
        digits = F.regexp_replace(code, r"^0+", "")
        number = F.when(F.length(digits) > 15, F.when(F.length(digits) < 22, code.cast("double").cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))).otherwise(code.cast("decimal(38,0)"))
        unit = F.decode(F.unhex(F.lpad(F.hex((number % 65536).cast("long")), 4, "0")), "UTF-16BE")
        rest = F.regexp_replace(p, r"^\d+;", "")
        return F.when(F.length(code) > 0, F.concat(unit, rest)).otherwise(F.concat(F.lit("&#"), p))

    parts = F.split(text, "&#")
    return let(
        parts,
        lambda a: F.concat(a[0], F.array_join(F.transform(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), piece), "")),
    )


def decode_detail(html: Column) -> Column:
    """Detail variant: comments and tags vanish without a blank; numeric entities are decoded."""
    out = F.regexp_replace(html, r"<!--[\s\S]*?-->", "")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for pattern, plain in DETAIL_ENTITIES:
        out = F.regexp_replace(out, pattern, plain)
    return _collapse(numeric_entities(out))


def visible_text(html: Column) -> Column:
    """Page variant: scripts and styles removed first."""
    out = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    out = F.regexp_replace(out, r"(?i)<style[\s\S]*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), "&nbsp;", " ")
    return _collapse(out)
