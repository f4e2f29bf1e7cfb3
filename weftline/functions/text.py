"""Scalar functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "[ \\t\\n\\r\\f]+"

#: Accented Latin letters and their plain forms, place by place.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăąćčęěğńňőřśšťțůűźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaccceegnnorsstuuzzzAAAAAACEEEEIIIINOOOOOUUUUY"


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for null and blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda x: x != "")


def squeeze(text: Column) -> Column:
    """One blank between words, none outside."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalise_answer(text: Column) -> Column:
    """Trailing punctuation off, then outer blanks off, then lower case - in that order, so ``"Yes. "`` keeps its full stop."""
    return F.lower(F.trim(F.rtrim(text, F.lit(".!?,;:"))))


def matches_exactly(response: Column, target: Column) -> Column:
    return normalise_answer(response) == normalise_answer(target)


def is_yes_no(response: Column) -> Column:
    return normalise_answer(response).isin("yes", "no")


def contains_answer(response: Column, target: Column) -> Column:
    """Containment after lower case and trimming; "no" is in "know", so keep it apart from exact and exclusive matching."""
    return F.contains(F.trim(F.lower(response)), F.trim(F.lower(target)))


def contains_exclusively(response: Column, target: Column, opposite: Column) -> Column:
    """Contains the target and not its opposite; both count as wrong."""
    return contains_answer(response, target) & ~contains_answer(response, opposite)


def contains_any(response: Column, accepted: Column) -> Column:
    """Contains any of an array of accepted spellings."""
    return F.exists(accepted, lambda a: F.contains(F.lower(response), F.lower(a)))


def word_class(text: Column, first: str, second: str) -> Column:
    """``first``, ``second``, ``both`` or ``neither``, by whole words, the plural included."""
    low = F.lower(text)
    a = low.rlike(rf"(^|[^a-z0-9_]){first}s?([^a-z0-9_]|$)")
    b = low.rlike(rf"(^|[^a-z0-9_]){second}s?([^a-z0-9_]|$)")
    return F.when(a & b, "both").when(a, first).when(b, second).otherwise("neither")


def fold_latin(text: Column) -> Column:
    """Latin accents off, other signs to blanks, squeezed, lower case (the subset that stays in the JVM)."""
    plain = F.lower(F.translate(text, ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def tagged_pairs(text: Column, outer: str = "question", inner: str = "answer", count: int = 4, yes: int = 2) -> Column:
    """Array of (question, answer) from paired tags; null unless there are just ``count`` pairs, ``yes`` of them yes and the rest no."""
    q = F.regexp_extract_all(text, F.lit(f"(?s)<{outer}>(.*?)</{outer}>"), 1)
    a = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{inner}>(.*?)</{inner}>"), 1), lambda x: F.lower(squeeze(x)))
    pairs = F.zip_with(q, a, lambda x, y: F.struct(squeeze(x).alias("question"), y.alias("answer")))
    good = (
        (F.size(q) == count) & (F.size(a) == count)
        & (F.size(F.filter(a, lambda x: x == "yes")) == yes) & (F.size(F.filter(a, lambda x: x == "no")) == count - yes)
    )
    return F.when(good, pairs)


def after_last_open_tag(text: Column, tag: str) -> Column:
    """What stands in the last ``<tag>``, up to its end tag if there is one; the whole text without a tag."""
    tail = F.substring_index(text, f"<{tag}>", -1)
    return F.trim(F.substring_index(tail, f"</{tag}>", 1))


def fenced_json(text: Column) -> Column:
    """The text of the last fenced JSON block, else the last paragraph; never evaluated."""
    fenced = F.regexp_extract(text, r"(?s).*```json\s*(.*?)```", 1)
    return F.btrim(F.when(fenced != "", fenced).otherwise(F.substring_index(text, "\n\n", -1)), F.lit(" \t\r\n"))


def last_segment(path: Column, missing: str = "base_model") -> Column:
    return F.coalesce(F.substring_index(path, "/", -1), F.lit(missing))


def safe_name(name: Column) -> Column:
    return F.translate(name, "/. ", "___")


def stem(path: Column) -> Column:
    """File name without folder, extension and what follows a ``#``."""
    return F.regexp_replace(F.substring_index(F.split(path, "#")[0], "/", -1), r"\.[A-Za-z0-9]+$", "")


def learning_rate(name: Column, default: float = 1e-5) -> Column:
    found = F.regexp_extract(name, r"lr_(\d+e-?\d+)", 1)
    return F.when(found != "", found.cast("double")).otherwise(F.lit(default))


def run_index(name: Column) -> Column:
    return F.when(name.rlike(r"__?run\d+$"), F.regexp_extract(name, r"__?run(\d+)$", 1).cast("int"))


def int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def capitalise(text: Column) -> Column:
    """Underscores to blanks, first letter upper, the rest unchanged."""
    t = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def decapitalise(text: Column) -> Column:
    """First letter lower and the last sign off."""
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))


def fill(template: Column | str, *values: Column) -> Column:
    """Each ``{}`` of the template by the next value."""
    out = F.lit(template) if isinstance(template, str) else template
    if len(values) == 1:
        return F.replace(out, F.lit("{}"), values[0])
    parts = template.split("{}")
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit(p), values[i].cast("string")) if i < len(values) else (F.lit(p),))])


def base64_tag(text: Column, tag: str = "secret") -> Column:
    return F.concat(F.lit(f"<{tag}>"), F.base64(F.encode(text, "UTF-8")), F.lit(f"</{tag}>"))


def numbered(items: Column, label: str = "Example") -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def request_key(*parts: Column) -> Column:
    """SHA-1 over the parts, joined by a sign that no part holds."""
    return F.sha1(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
