"""Columns over page text: markdown stripping, confidence, previews, headers and footers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that are blanked in turn to get plain text.
MARKDOWN = (r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]*\]\([^)]*\)", r"```[\s\S]*?```", r"`[^`]+`", r"[#*_~|<>{}\\\-=+]")
#: White space as Python's: ASCII, Unicode's, and the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Characters that count as broken.
BAD = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"
#: Language names by code.
LANGUAGES = {
    "en": "english", "bn": "bangla", "ar": "arabic", "zh-cn": "chinese (simplified)", "zh-tw": "chinese (traditional)", "fr": "french",
    "de": "german", "hi": "hindi", "id": "indonesian", "it": "italian", "ja": "japanese", "ko": "korean", "ms": "malay", "nl": "dutch",
    "pl": "polish", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "th": "thai", "tr": "turkish", "uk": "ukrainian",
    "ur": "urdu", "vi": "vietnamese",
}
#: Limits of low confidence, slow work in seconds, large files in MB, little text in characters.
LOW, SLOW_S, LARGE_MB, LITTLE = 80.0, 10.0, 10, 10


def plain(markdown: Column) -> Column:
    """Text without markdown, white space squeezed and stripped."""
    for pattern in MARKDOWN:
        markdown = F.regexp_replace(markdown, pattern, " ")
    return F.trim(F.regexp_replace(markdown, SPACE, " "))


def clean_share(text: Column) -> Column:
    """1 less the share of replacement and control characters."""
    return 1 - (F.length(text) - F.length(F.regexp_replace(text, BAD, ""))) / F.length(text)


def letter_share(text: Column) -> Column:
    """Share of letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.length(text)


def word_share(text: Column) -> Column:
    """Share of words of 2 to 20 characters, of text parted by single spaces."""
    words = F.split(text, " ")
    return F.size(F.filter(words, lambda w: F.length(w).between(2, 20))) / F.size(words)


def clamp(value: Column) -> Column:
    return F.round(F.least(F.lit(99.9), F.greatest(F.lit(0.0), value)), 2)


def page_confidence(text: Column) -> Column:
    """0 to 99.9 from clean characters, letters and words; 0 for null or empty text."""

    def of(p: Column) -> Column:
        return F.when(p == "", clamp(clean_share(text) * 50.0)).otherwise(clamp(clean_share(text) * 50.0 + letter_share(p) * 30.0 + word_share(p) * 20.0))

    # The plain text is made once a row, and used three times.
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.transform(F.array(plain(text)), of)[0])


def framed(header: Column, text: Column, footer: Column) -> Column:
    """Header and footer, stripped, around the text; a header of blanks still adds its break."""
    h, f = F.coalesce(header, F.lit("")), F.coalesce(footer, F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.concat(F.when(h != "", F.concat(strip(h), F.lit("\n\n"))).otherwise(""), F.coalesce(text, F.lit("")), F.when(f != "", F.concat(F.lit("\n\n"), strip(f))).otherwise(""))


def blend(a: Column, b: Column) -> Column:
    return 0.6 * a + 0.4 * b


def preview(text: Column, most: int = 40, kept: int = 37) -> Column:
    """Text cut to `kept` characters and dots where it is longer than `most`."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def language_mode(codes: Column, names: dict[str, str] | None = None) -> Column:
    """mixed for several codes; else the code's name, or the code."""
    known = F.create_map(*[F.lit(x) for kv in (names or LANGUAGES).items() for x in kv])
    return F.when(F.size(codes) > 1, "mixed").otherwise(F.coalesce(known[codes[0]], codes[0]))


def operation_class(failed: Column, confidence: Column) -> Column:
    return F.when(failed, "FAILED").when(confidence < LOW, "LOW CONFIDENCE").otherwise("OK")


def is_slow(seconds: Column, pages: Column) -> Column:
    return seconds > F.when(pages > 3, 10.0).otherwise(5.0)


def is_concern(seconds: Column, confidence: Column) -> Column:
    return (confidence < LOW) | (seconds > SLOW_S)


def is_large(size: Column) -> Column:
    return size > LARGE_MB * 1024 * 1024


def has_little_text(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < LITTLE
