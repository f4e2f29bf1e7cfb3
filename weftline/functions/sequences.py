"""Functions over arrays of tokens and turns. Positions are 0-based, as in slices of lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_slice(array: Column, lo: Column | int, hi: Column | int) -> Column:
    """``array[lo:hi]`` with negative and excessive bounds clipped, as lists do; never an error."""
    n = F.size(array)
    lo = F.lit(lo) if isinstance(lo, int) else lo
    hi = F.lit(hi) if isinstance(hi, int) else hi
    a = F.least(F.greatest(F.when(lo < 0, lo + n).otherwise(lo), F.lit(0)), n)
    b = F.least(F.greatest(F.when(hi < 0, hi + n).otherwise(hi), F.lit(0)), n)
    return F.slice(array, a + 1, F.greatest(b - a, F.lit(0)))


def render_chat(turns: Column, *, generation_prompt: bool = False) -> Column:
    """Turns (role, content) as one string; null content is empty."""
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>"), F.coalesce(t["content"], F.lit("")))), "\n")
    return F.concat(body, F.lit("\n<|assistant|>")) if generation_prompt else body


def loss_labels(ids: Column, start: Column | int) -> Column:
    """-100 for the tokens before ``start``, which carry no loss."""
    return F.transform(ids, lambda x, i: F.when(i < start, F.lit(-100)).otherwise(x))


def prompt_part(ids: Column, labels: Column) -> Column:
    """The tokens without loss."""
    return F.filter(ids, lambda x, i: F.get(labels, i) == -100)


def masks_once(labels: Column) -> Column:
    """Whether no masked label follows an unmasked one."""
    first = F.array_position(F.transform(labels, lambda x: x != -100), True)
    return F.when(first == 0, True).otherwise(~F.exists(F.slice(labels, F.greatest(first, F.lit(1)).cast("int"), F.size(labels)), lambda x: x == -100))


def left_pad(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")), ids)


def pad_mask(ids: Column, length: Column) -> Column:
    missing = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(0), missing), F.transform(ids, lambda x: F.lit(1)))


def shifted(positions: Column, by: Column) -> Column:
    return F.transform(positions, lambda p: p + by)


def unpad(ids: Column, mask: Column) -> Column:
    kept = F.filter(F.zip_with(ids, mask, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda p: p["m"] == 1)  # inside a lambda, the mask would be made anew for each id
    return F.transform(kept, lambda p: p["x"])


def marker_positions(array: Column, marker: Column | str, first: int) -> Column:
    """The 0-based places of the first ``first`` markers."""
    m = F.lit(marker) if isinstance(marker, str) else marker
    found = F.filter(F.transform(array, lambda x, i: F.when(x == m, i)), lambda i: i.isNotNull())
    return F.slice(found, 1, first)


def is_run(positions: Column) -> Column:
    """Whether places follow each other without a gap."""
    n = F.size(positions)
    return F.when(n == 0, False).otherwise(F.try_element_at(positions, F.greatest(n, F.lit(1))) - F.get(positions, F.lit(0)) == n - 1)


def end_window(length: Column, offset: int, k: Column | int) -> Column:
    """Places of a window that ends ``offset`` (negative) before the end, cut to what the text holds; empty for an empty text."""
    k = F.lit(k) if isinstance(k, int) else k
    end = length + offset
    kept = F.least(k, end + 1)
    return F.when(kept > 0, F.sequence(end - kept + 1, end)).otherwise(F.array().cast("array<int>"))


def clamp_end(end: Column, length: Column) -> Column:
    """``max(1, min(end, length - 1))``."""
    return F.greatest(F.lit(1), F.least(end, length - 1))


def hidden_instruction(turns: Column) -> Column:
    """The first system message, else the first user message, else null."""
    of = lambda role: F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["content"]
    return F.coalesce(of("system"), of("user"))


def without_system(turns: Column) -> Column:
    return F.filter(turns, lambda t: F.coalesce(t["role"] != "system", F.lit(True)))


def dense(slots: Column, length: Column) -> Column:
    """Array of (index, value) structs to an array of ``length`` values with null where there is none; of several values for one index the last by value order."""
    return F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: F.try_element_at(F.transform(F.filter(slots, lambda s: s["index"] == i), lambda s: s["value"]), F.lit(-1)))


def token_activations(values: Column) -> Column:
    """``token (0.00)`` for each (token, activation) of an array; a missing activation is 0."""
    return F.array_join(F.transform(values, lambda v: F.concat(v["s"], F.format_string(" (%.2f)", F.coalesce(v["act"], F.lit(0.0))))), " ")


def special_mask(ids: Column, *specials: int | None) -> Column:
    """Whether each id is one of the special ones (begin, end, padding); those that a tokenizer lacks are None."""
    known = [s for s in specials if s is not None]
    return F.transform(ids, lambda x: F.coalesce(x.isin(*known), F.lit(False)) if known else F.lit(False))


def without_special(ids: Column, *specials: int | None) -> Column:
    """The ids that aren't special, in order; indices into the result count those only."""
    known = [s for s in specials if s is not None]
    return F.filter(ids, lambda x: ~F.coalesce(x.isin(*known), F.lit(False))) if known else ids


def label_prefix(label: Column, sep: str = "-") -> Column:
    """What stands before the first separator; empty for a null label."""
    return F.coalesce(F.split_part(label, F.lit(sep), F.lit(1)), F.lit(""))


def absolute_range(start: Column, end: Column, length: Column) -> Column:
    """Struct (start, end, valid) of a range of positions in which negative bounds count from the end; valid if it lies in the text and isn't empty."""
    at = lambda x: F.when(x < 0, x + length).otherwise(x)
    a, b = at(start), at(end)
    return F.struct(a.alias("start"), b.alias("end"), ((a >= 0) & (a < b) & (b <= length)).alias("valid"))


def image_window(length: Column, offset: Column, size: Column) -> Column:
    """Struct (begin, end) of the window of at most ``size`` places that ends ``offset`` (negative) before the end, kept within the text."""
    end = F.greatest(F.lit(1), F.least(length + offset, F.when(length > 1, length - 1).otherwise(0)))
    kept = F.greatest(F.least(size, end + 1), F.lit(1))
    return F.struct((end - kept + 1).alias("begin"), end.alias("end"))
