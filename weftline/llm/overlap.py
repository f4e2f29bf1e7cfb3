"""Problem 4: texts of evaluation splits that recur, exactly or nearly, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import materialize

#: Share of the words of the longer text that two near-equal texts have in common, in the same order.
SIMILARITY = 0.8

#: Texts with fewer words are no cases.
LEAST_WORDS = 8

#: 64-bit words of the bit fingerprint that a text carries into the join, and of the second one that texts of more than
#: LONG_WORDS words carry, on which the first is too short to tell them apart.
FINGERPRINT, WIDE_FINGERPRINT, LONG_WORDS = 2, 16, 128

#: Words are ordered by the frequency of their hash bucket, of 2^_BUCKET_BITS.
_BUCKET_BITS = 16

#: Rows of a code on one side are spread over one task for each so many texts that have its word, at most MOST_SALTS.
SALT_ROWS, MOST_SALTS = 100_000, 64

#: The ids of up to this many texts (16 bytes each) are broadcast to pick out their rows; above it, they are shuffled.
BROADCAST_IDS = 1_000_000

_DROPPED = regex.compile(r"[\p{M}\p{Cf}\x00-\x08\x0e-\x1f\x7f]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words of a text; case, punctuation, spacing, accents, Unicode form and invisible characters don't count."""
    if text.isascii():
        return _ASCII_WORD.findall(_DROPPED.sub("", text).lower())
    import unicodedata

    return _WORD.findall(_DROPPED.sub("", unicodedata.normalize("NFKD", text)).casefold())


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        u = row & at.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def _hashes(flat: list[str]) -> np.ndarray:
    codes, unique = pd.factorize(np.array(flat, object))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), np.uint64, len(unique))[codes]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            batch = whole.slice(at, 4000)
            lists = [words(t) if t else [] for t in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            keep = np.flatnonzero(sizes >= LEAST_WORDS)
            if not len(keep):
                continue
            h = _hashes([w for i in keep for w in lists[i]])
            starts = np.concatenate(([0], np.cumsum(sizes[keep])[:-1]))
            short = h.astype("<u4")
            data = short.tobytes()
            ends = np.append(starts, len(h)).astype(np.int32) * 4
            keys = np.array([list(divmod(xxhash.xxh3_128_intdigest(data[a:b]), 1 << 64)) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64).view(np.int64)
            picked = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [
                    picked.column(0), picked.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(data)]),
                ],
                ["id", "train", "k1", "k2", "words"],
            )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(1 << _BUCKET_BITS, np.int64), 0
    for batch in batches:
        ends = np.frombuffer(batch.column(0).buffers()[1], np.int32, len(batch) + 1, batch.column(0).offset * 4)
        w = np.frombuffer(batch.column(0).buffers()[2], "<u4", (ends[-1] - ends[0]) // 4, ends[0])
        total += np.bincount(w & ((1 << _BUCKET_BITS) - 1), minlength=len(total))
        texts += len(batch)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], ["bucket", "n"])


def least_common(n, similarity: float):
    """Words in order that a text of n words has in common with any text it pairs with, at least."""
    return np.ceil((similarity - 1e-9) * n).astype(np.int64)


def occurrences(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word hash, code), ordered by text: the code is of the word and of how often it came before in its text, so no text has a code twice."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    w, at = flat[order].astype(np.uint64), np.arange(len(flat))
    first = np.concatenate(([True], (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])))
    seen = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (w | seen << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return owner, w, code ^ code >> np.uint64(32)


def rarest(owner: np.ndarray, w: np.ndarray, code: np.ndarray, sizes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, code, texts that have its word) of the rarest occurrences of each text, so many that two similar texts share one of them for certain.

    A text of n words that has c in common with another lacks n - c there. In one order of all codes, the first n - c + 1 of both
    texts share a code: else all common ones would come after the earlier of the two ends, where fewer than c are left.
    """
    often = counts[w & np.uint64(len(counts) - 1)]
    order = np.lexsort((code, often, owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place <= (sizes - least_common(sizes, similarity))[owner]
    return owner[kept], code[order][kept].view(np.int64), often[order][kept]


def fingerprints(owner: np.ndarray, code: np.ndarray, texts: int, size: int = FINGERPRINT) -> np.ndarray:
    """A fingerprint of ``size`` 64-bit words for each text: whether an odd number of its codes falls on the bit.

    Similar texts have near fingerprints: they differ in at most as many bits as codes are in only one of the texts.
    """
    bits = 64 * size
    odd = np.bincount(owner * bits + (code % np.uint64(bits)).astype(np.int64), minlength=texts * bits).reshape(texts, bits) & 1
    return np.packbits(odd.astype(bool), axis=1, bitorder="little").view("<i8")


def radius(na: Column, nb: Column, similarity: float) -> Column:
    """Bits in which the fingerprints of two texts of so many words may differ at most if the texts are similar."""
    return na + nb - 2 * F.lit(similarity - 1e-9) * F.greatest(na, nb)


def word_table(df: DataFrame, *, key: str, text: str, split: str) -> DataFrame:
    """Written once: id, train, text key (128 bits) and hashes of words, of texts of LEAST_WORDS words and more with a known split."""
    side = F.lower(F.regexp_replace(F.col(split), r"[^\p{L}]+", ""))
    train = F.when(side.isin("train", "training", "trn"), True).when(side.isin("validation", "valid", "val", "dev", "test", "testing", "eval", "evaluation"), False)
    picked = df.select(F.col(key).cast("bigint").alias("id"), train.alias("train"), F.col(text).cast("string").alias("text")).where("train is not null and id is not null and text is not null")
    return materialize(picked.mapInArrow(_word_rows, "id bigint, train boolean, k1 bigint, k2 bigint, words binary"), "prints")


def _few(ids: DataFrame, at_most: int) -> DataFrame:
    """Ids, broadcast if the rows that they come from were counted and are few."""
    return F.broadcast(ids) if at_most <= BROADCAST_IDS else ids


def cross_split_links(df: DataFrame, *, key: str = "sample_id", text: str = "context", split: str = "split", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Overlaps between training and evaluation records as links between classes of equal texts.

    Returns (links, members). ``links``: a, b, the classes of a training and an evaluation text that are equal (a = b) or nearly equal,
    each link once. ``members``: id, train, rep, the class of each record. A class is named by its least id.

    Nearly equal: the longest common subsequence of words has at least ``similarity`` of the words of the longer text.

    Method: bit fingerprints within a Hamming radius, joined by code blocks across the splits, verified on whole texts.
    (1) One scan gives each text its word hashes, written to the shared folder. (2) Equal texts become one class by
    partial aggregation, so a text that a third of the rows share is one row from here on. (3) A text's code blocks are its
    rarest words, one more than it may lack in a similar text, so two similar texts agree on one for certain (an exact prefix
    filter; blocks of the fingerprint's own bits lose pairs). Rows of a hot code are spread by a salt. (4) Classes of the two sides that
    agree on a block are candidates if their lengths allow the similarity and their fingerprints lie within the radius, which
    is as wide as the words that such a pair may not share: no pair is lost. (5) Candidates are verified on whole texts.

    Defined cases: records without a known split, without text or with fewer than LEAST_WORDS words
    are in no link; a record delivered several times counts once; further columns are ignored.
    """
    prints = word_table(df, key=key, text=text, split=split)
    counted = {r["bucket"]: r["n"] for r in prints.select("words").mapInArrow(_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(1 << _BUCKET_BITS, np.int64)  # at most 2^_BUCKET_BITS counters come to the driver
    for bucket, n in counted.items():
        if bucket >= 0:
            counts[bucket] = n

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            if not lists:
                continue
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            owner, w, code = occurrences(np.concatenate(lists), sizes)
            bits = fingerprints(owner, code, len(lists))
            wide = np.flatnonzero(sizes > LONG_WORDS)
            long = [None] * len(lists)
            if len(wide):
                rows = np.isin(owner, wide)
                new = np.searchsorted(wide, owner[rows])
                for i, x in zip(wide.tolist(), fingerprints(new, code[rows], len(wide), WIDE_FINGERPRINT).tolist(), strict=True):
                    long[i] = x
            text, code, often = rarest(owner, w, code, sizes, counts, similarity)
            salts = np.minimum(1 + often // SALT_ROWS, MOST_SALTS)
            if batch.column(2)[0].as_py():  # a training text: one salt of its own
                salt = np.array(batch.column(0).to_pylist(), np.int64)[text] % salts
            else:  # an evaluation text meets all salts
                at = np.repeat(np.arange(len(code)), salts)
                salt = np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)
                text, code = text[at], code[at]
            code = code + salt * np.int64(0x1000_0001)
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), batch.column(0).take(pick), pa.array(sizes[text].astype(np.int32)), *[pa.array(bits[text, k]) for k in range(FINGERPRINT)], pa.array(long, pa.list_(pa.int64())).take(pick)],
                names,
            )

    # classes with more than one row are few or small beside the texts: the rows of the others go on from the scan as they are
    ids = prints.groupBy("k1", "k2", "id").agg(F.max("train").alias("t"), F.max(~F.col("train")).alias("e"), F.count(F.lit(1)).alias("n"))
    classes = ids.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("t").alias("in_train"), F.max("e").alias("in_eval"), F.sum("n").alias("n"))
    repeated = materialize(ids.select("k1", "k2", "id").join(classes.where("n > 1"), ["k1", "k2"]).select("id", "rep", "in_train", "in_eval"), "repeated")
    copies = repeated.count()  # off the files' own counts
    single = prints.join(_few(repeated.select("id").distinct(), copies), "id", "left_anti").select(F.col("id").alias("rep"), "words", F.col("train").alias("in_train"), (~F.col("train")).alias("in_eval"))
    several = repeated.where("id = rep").select("rep", "in_train", "in_eval").distinct()
    first = prints.join(_few(several.select(F.col("rep").alias("id")), copies), "id", "left_semi").groupBy(F.col("id").alias("rep")).agg(F.first("words").alias("words"))
    texts = single.unionByName(first.join(several, "rep").select("rep", "words", "in_train", "in_eval"))

    names = ["code", "rep", "n", *[f"p{k}" for k in range(FINGERPRINT)], "wide"]
    rows = "code bigint, rep bigint, n int, " + "".join(f"p{k} bigint, " for k in range(FINGERPRINT)) + "wide array<bigint>"
    a, b = (
        texts.where(f"in_{side}").select("rep", "words", F.lit(side == "train").alias("train")).mapInArrow(emit, rows).toDF(*("code" if c == "code" else c + x for c in names))
        for side, x in (("train", "_a"), ("eval", "_b"))
    )
    differing = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(FINGERPRINT)), F.lit(0))
    wide = sum((F.bit_count(F.get("wide_a", F.lit(k)).bitwiseXOR(F.get("wide_b", F.lit(k)))) for k in range(WIDE_FINGERPRINT)), F.lit(0))  # no lambda: the join stays compiled
    na, nb = F.col("n_a"), F.col("n_b")
    near = (
        a.join(b, "code").where("rep_a <> rep_b").where(F.least(na, nb) >= F.lit(similarity - 1e-9) * F.greatest(na, nb))
        .where(differing <= radius(na, nb, similarity))
        .where(F.coalesce(wide <= radius(na, nb, similarity), F.lit(True)))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    )
    candidates = materialize(near, "candidates")
    needed = prints.join(_few(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * candidates.count()), "id", "left_semi")
    held = needed.groupBy("id").agg(F.first("words").alias("words"))

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
            out.append(common_in_order(p, q) / max(len(p), len(q)))
        return pd.Series(out, dtype="float64")

    both = candidates.join(held.toDF("a", "wa"), "a").join(held.toDF("b", "wb"), "b")
    verified = both.where(share("wa", "wb") >= similarity - 1e-9).select("a", "b")
    equal = repeated.where("in_train and in_eval").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    members = prints.select("id", "train").distinct().join(repeated.select("id", "rep"), "id", "left").select("id", "train", F.coalesce("rep", "id").alias("rep"))
    return verified.unionByName(equal), members


def cross_split_pairs(df: DataFrame, **names) -> DataFrame:
    """All pairs (train_id, eval_id) of a record in train and one in validation or test with equal or nearly equal texts: the links of :func:`cross_split_links`, whose arguments it takes, between their members."""
    links, members = cross_split_links(df, **names)
    trained = members.where("train").select(F.col("rep").alias("a"), F.col("id").alias("train_id"))
    evaluated = members.where("not train").select(F.col("rep").alias("b"), F.col("id").alias("eval_id"))
    return links.join(trained, "a").join(evaluated, "b").select("train_id", "eval_id")


def overlap_report(df: DataFrame, links: DataFrame, members: DataFrame, *, key: str = "sample_id", split: str = "split", source: str = "dataset_name") -> DataFrame:
    """Counts by split and source of the evaluation records: split, source, n_pairs, n_samples, n_within (pairs within one source).

    Links are counted times the sizes of their classes, so pairs of records never become rows. Splits are in lower case without outer blanks.
    A record delivered under two splits or sources counts under each.
    """
    about = df.select(F.col(key).cast("bigint").alias("id"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).distinct()
    sized = members.join(about, "id")
    trained = sized.where("train").groupBy("rep", "source").agg(F.count_distinct("id").alias("n"))
    evaluated = sized.where("not train").groupBy("rep", "split", "source").agg(F.count_distinct("id").alias("n"))
    by_source = links.join(trained.withColumnRenamed("rep", "a"), "a").groupBy("b", F.col("source").alias("from")).agg(F.sum("n").alias("partners"))
    joined = evaluated.withColumnRenamed("rep", "b").join(by_source, "b").groupBy("b", "split", "source").agg(
        F.max("n").alias("n"), F.sum("partners").alias("partners"), F.sum(F.when(F.col("source").eqNullSafe(F.col("from")), F.col("partners")).otherwise(0)).alias("within")
    )
    return joined.groupBy("split", "source").agg(
        F.sum(F.col("n") * F.col("partners")).alias("n_pairs"), F.sum("n").alias("n_samples"), F.sum(F.col("n") * F.col("within")).alias("n_within")
    )
