"""Text columns: stripping, cutting, slugs, video ids, tokens and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it; Spark's trim() knows the space alone. Fixed values.
SPACES = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STRIP = rf"^{SPACES}|{SPACES}\z"
TOKEN_BREAK = r"[ \t\n\r\x{0b}\x{0c}]+"
#: Accented Latin-1 letters and what they fold to, in pairs. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
#: Other letters that one letter stands for: more of Latin, Greek, Cyrillic. Fixed values.
OTHERS = "øðđħıłŧāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžșț" + "αάβγδεέζηήιίϊκλμνξοόπρσςτυύϋωώ" + "абвгдезийклмнопрстуфыэіѕ"
FOLDED_OTHERS = "oddhiltaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzst" + "aabgdeezeeiiiklmnxooprsstuuuoo" + "abvgdeziiklmnoprstufyeis"
#: Letters that several stand for. Fixed values.
SPELT = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ї": "yi", "є": "ie", "ґ": "g", "ў": "u"}
#: Letters that nothing stands for. Fixed values.
SILENT = "ъь"
#: An id follows "v=" or a slash. Fixed value.
VIDEO_IDS = (r"(?:v=|/)([0-9A-Za-z_-]{11})",)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def stripped_length(text: Column) -> Column:
    return F.length(strip(text))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped_length(text), F.lit(0)) == 0


def cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def or_else(text: Column, other: Column) -> Column:
    """``other`` where ``text`` is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def slug(text: Column) -> Column:
    """Lower case, accents folded, Greek and Cyrillic spelt in Latin, other runs a hyphen, none at the ends; null where nothing is left."""
    spelt = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), SPELT.items(), F.translate(F.lower(text), ACCENTED + OTHERS + SILENT, FOLDED + FOLDED_OTHERS))
    plain = F.regexp_replace(spelt, "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(plain, "^-|-$", ""), F.lit(""))


def video_id(url: Column) -> Column:
    """The first pattern that matches decides."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_IDS))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def chunk_count(n_tokens: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((n_tokens - overlap) / F.lit(size - overlap))).cast("int")


def preview(text: Column, most: int = 160, none: str = "No description yet.") -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
