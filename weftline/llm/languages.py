"""Problem 8: languages of documents and of the segments of mixed ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages told apart, with their three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "fr": ("fra", "fre", "french"),
    "de": ("deu", "ger", "german"),
    "es": ("spa", "spanish"),
    "it": ("ita", "italian"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese"),
}

CODES = tuple(LANGUAGES)

#: Labels that name a language outside those told apart.
OTHER_LANGUAGES = (
    "ar", "arabic", "bg", "bulgarian", "ca", "catalan", "cs", "czech", "da", "danish", "el", "greek", "et", "estonian", "fa", "persian",
    "fi", "finnish", "he", "hebrew", "hi", "hindi", "hr", "croatian", "hu", "hungarian", "id", "indonesian", "ja", "jpn", "japanese",
    "ko", "kor", "korean", "lt", "lithuanian", "lv", "latvian", "nb", "nor", "norwegian", "ro", "romanian", "sk", "slovak", "sl", "slovenian",
    "sr", "serbian", "sv", "swe", "swedish", "th", "thai", "tr", "tur", "turkish", "uk", "ukr", "ukrainian", "vi", "vietnamese",
)


def code_column(lang: Column | str) -> Column:
    """Two-letter code of a label in any spelling (case, blanks, region, three letters, English name); else null."""
    col = F.col(lang) if isinstance(lang, str) else lang
    head = F.lower(F.regexp_extract(col, r"^\s*([A-Za-z]+)\s*(?:[-_].*)?$", 1))
    spelled = {code: code for code in LANGUAGES} | {name: code for code, names in LANGUAGES.items() for name in names}
    return F.element_at(F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair]), head)


def names_other(lang: Column | str) -> Column:
    """Whether a label names a language outside those told apart."""
    col = F.col(lang) if isinstance(lang, str) else lang
    head = F.lower(F.regexp_extract(col, r"^\s*([A-Za-z]+)\s*(?:[-_].*)?$", 1))
    return F.coalesce(head.isin(*OTHER_LANGUAGES), F.lit(False))
