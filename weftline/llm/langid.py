"""Problem 8: languages of documents and of the segments of mixed ones."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.languages import CODES, code_column, names_other
from weftline.llm.subwords import SubwordModel, train
from weftline.storage import step_folder

#: The classifier's classes: the languages and, last, text in none of them (names, code, noise).
CLASSES = (*CODES, "none")

#: Bounds of the training sample: documents of each labelled language, and sentences of each.
TRAIN_DOCUMENTS, TRAIN_SENTENCES = 400, 2000

#: Words that a sentence must have to count, the confidence below which it is rejected, and the same for a
#: sentence in another language than most of its text.
LEAST_WORDS, LEAST_CONFIDENCE, OTHER_CONFIDENCE = 5, 0.7, 0.87

#: A sentence of fewer words counts in another language than most of its text if it is whole (a capital, a full stop) and
#: has so many words and such a confidence.
SHORT_WORDS, SHORT_CONFIDENCE = 3, 0.98

_SIGNS = r"\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f"
_INVISIBLE = re.compile(f"[{_SIGNS}]")
#: Characters of scripts without blanks between words: no part of an assignment, or it would take the whole paragraph along.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff"
#: Markup by a sign that a text must hold for it: tags, entities, addresses and assignments.
_MARKUP = (
    ("<", re.compile(r"<[/!]?[A-Za-z|][^<>\n]{0,200}>")),
    ("&", re.compile(r"&#?\w{1,8};")),
    ("http", re.compile(r"https?://\S+")),
    ("=", re.compile(rf"(?<![^\s{_UNSPACED}])[^\s={_UNSPACED}]+ ?=+ ?[^\s{_UNSPACED}]+")),
)
_LABEL = re.compile(r"^[\W\d_]*[^\W\d_]+:\s")
_BREAK = re.compile(rf"\n+|(?<=[.!?\u2026\uff0e])[\"\u201d\u00bb\u2019')\]*_{_SIGNS}]*\s+|(?<=[\u3002\uff01\uff1f])")
_WHOLE = re.compile(r"^[\W\d_]*(?:[A-ZÀ-ÞĀ-ŽА-ЯЁ]\w*\W+\w|[\u3400-\u9fff]).*[.!?\u3002\uff01\uff1f][\"\u201d\u00bb\u2019')\]*_\s]*$", re.S)
_WORD = re.compile(r"[\u3400-\u9fff]|[^\W_\u3400-\u9fff]+")


def clean(text: str) -> str:
    """The text with markup blanked out; every other character stays at its place."""
    for sign, pattern in _MARKUP:
        if sign in text:
            text = pattern.sub(lambda m: " " * len(m[0]), text)
    return text


def sentences(text: str) -> list[tuple[int, int]]:
    """Places (start, end) of the sentences of a text; line breaks end a sentence."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def words(sentence: str) -> list[str]:
    """The words in lower case, each Han character by itself, without invisible characters and differences of Unicode form; a leading label such as ``note:`` and runs that hold digits (codes, hashes, numbers) are none."""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFKC", sentence)
    return [w for w in _WORD.findall(_LABEL.sub("", _INVISIBLE.sub("", sentence)).lower()) if w.isalpha()]


def weight(ws: list[str]) -> float:
    """Number of words, two Han characters counting as one."""
    han = sum(1 for w in ws if "\u3400" <= w[0] <= "\u9fff")
    return len(ws) - han / 2


def fit(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", n_documents: int = TRAIN_DOCUMENTS, n_sentences: int = TRAIN_SENTENCES, seed: int = 5) -> SubwordModel | None:
    """Train on a bounded sample: of each labelled language the ``n_documents`` first in hash order of 40 to 8000 characters, at most ``n_sentences`` of their sentences.

    Labels are partly wrong and some texts are mixed; the training drops sentences that it finds improbable.
    The class of no language is trained on strings of the capitalised names of the texts and on lines without sentences.
    None if no document has a label that names a language.
    """
    labelled = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), code_column(lang).alias("c")).where("c is not null and length(t) between 40 and 8000")
    first = Window.partitionBy("c").orderBy(F.xxhash64("k", F.lit(seed)), "k")
    rows = labelled.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n_documents).select("k", "t", "c").collect()
    rng = np.random.default_rng(seed)
    by_class: dict[str, list[list[str]]] = {c: [] for c in CLASSES}
    names: list[str] = []
    for r in sorted(rows, key=lambda r: (r["k"], r["c"])):
        t = clean(r["t"])
        for a, b in sentences(t):
            ws = words(t[a:b])
            if weight(ws) >= LEAST_WORDS:
                by_class[r["c"]].append(ws)
            elif ws:
                by_class["none"].append(ws)
        if r["c"] not in ("de", "ru", "zh") and not t.isupper():
            names += [w.lower() for w in re.findall(r"(?<=[a-z,] )[A-Z][a-z]{3,}", t)]
    if names:
        by_class["none"] = by_class["none"][: n_sentences // 3] + [[names[i] for i in rng.integers(0, len(names), rng.integers(3, 16))] for _ in range(n_sentences)]
    texts, labels = [], []
    for i, c in enumerate(CLASSES):
        pool = by_class[c]
        picked = rng.permutation(len(pool))[:n_sentences]
        if 0 < len(picked) < n_sentences // 2:  # scarce languages are repeated
            picked = np.resize(picked, min(n_sentences // 2, 8 * len(picked)))
        for j in picked:
            texts.append(pool[j])
            labels.append(i)
    return train(texts, np.array(labels), len(CLASSES)) if texts and len(set(labels)) > 1 else None


def fit_once(documents: DataFrame, **arguments) -> SubwordModel | None:
    """The model of :func:`fit`, kept in the shared folder under a name made from the application, the files that ``documents`` reads (their lengths and times) and the arguments.

    A second query of the application over the same files reads it in place of training again. It is removed with the other written steps.
    """
    spark = documents.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    about = [(spark.sparkContext.applicationId, sorted(arguments.items()))]
    for name in sorted(documents.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        about.append((name, status.getLen(), status.getModificationTime()))
    if len(about) == 1:  # a table that isn't read from files
        return fit(documents, **arguments)
    folder = step_folder(spark, "language-model", hashlib.blake2s(repr(about).encode(), digest_size=12).hexdigest())
    done = jvm.org.apache.hadoop.fs.Path(folder + "/_SUCCESS")
    if done.getFileSystem(conf).exists(done):
        return SubwordModel.from_bytes(spark.read.parquet(folder).collect()[0]["model"])
    model = fit(documents, **arguments)
    if model:
        spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(folder)
    return model


def classify(model: SubwordModel, texts: list[str | None]) -> list[list[tuple[int, int, str | None, float, float]]]:
    """For each text its segments (start, end, language or None, confidence, words): runs of sentences in one language, as places in the text as it is."""
    flat: list[str] = []
    places, sizes, weights, whole = [], [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        t = clean(t)
        for a, b in sentences(t):
            ws = words(t[a:b])
            if ws:
                places.append((i, a, b))
                sizes.append(len(ws))
                weights.append(weight(ws))
                whole.append(SHORT_WORDS <= weights[-1] < LEAST_WORDS and _WHOLE.match(t[a:b]) is not None)
                flat += ws
    out: list[list[tuple[int, int, str | None, float, float]]] = [[] for _ in texts]
    if not flat:
        return out
    codes, unique = pd.factorize(np.array(flat, object))
    sums = model.word_sums([str(u) for u in unique])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    p = model.probabilities(np.add.reduceat(sums[codes], starts, axis=0))
    best, sure = p.argmax(axis=1), p.max(axis=1)
    weights = np.array(weights)
    counts = (weights >= LEAST_WORDS) & (sure >= LEAST_CONFIDENCE) & (best < len(CODES))
    owner = np.array([i for i, _, _ in places])
    votes = np.zeros((len(texts), len(CODES)))
    np.add.at(votes, (owner[counts], best[counts]), weights[counts])
    most = votes.argmax(axis=1)[owner]
    counts &= (sure >= OTHER_CONFIDENCE) | (most == best)
    counts |= np.array(whole) & (sure >= SHORT_CONFIDENCE) & (best < len(CODES)) & (most != best) & (votes.max(axis=1)[owner] > 0)
    for (i, a, b), k, c, w, ok in zip(places, best.tolist(), sure.tolist(), weights.tolist(), counts.tolist(), strict=True):
        lang = CODES[k] if ok else None
        segs = out[i]
        if segs and (lang is None or segs[-1][2] in (lang, None)):
            s, _, before, conf, n = segs[-1]
            if lang is None:
                segs[-1] = (s, b, before, conf, n)  # too short or unsure: it goes with what stands before it
            elif before is None:
                segs[-1] = (s, b, lang, c, w)
            else:
                segs[-1] = (s, b, before, (conf * n + c * w) / (n + w), n + w)
        else:
            segs.append((a, b, lang, c, w))
    return out


def label_languages(documents: DataFrame, model: SubwordModel, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: key, given (two letters, ``other`` or null), language, confidence, n_words and its segments.

    Each text is read whole, in the scan, without a shuffle. ``language`` is that of most words in
    counted sentences; null where no sentence counts (no prose, under five words, null or empty
    text). A sentence counts with at least LEAST_WORDS words and LEAST_CONFIDENCE; other sentences
    go with the segment before them, so foreign names, words and phrases never form a segment.
    A short whole sentence counts in another language than most of its text (SHORT_WORDS, SHORT_CONFIDENCE).
    Segments: start, end (places in the text, so that it can be cut there), lang, confidence, n_words. Further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^bits rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, sure, n_words, segments = [], [], [], []
                for segs in classify(shared.value, part.column(1).to_pylist()):
                    by: dict[str, list[float]] = {}
                    for _, _, c, conf, n in segs:
                        if c:
                            x = by.setdefault(c, [0.0, 0.0])
                            x[0] += n
                            x[1] += conf * n
                    top = max(by, key=lambda c: (by[c][0], c)) if by else None
                    langs.append(top)
                    sure.append(by[top][1] / by[top][0] if top else None)
                    n_words.append(sum(x[0] for x in by.values()))
                    segments.append([{"start": s, "end": e, "lang": c, "confidence": conf, "n_words": n} for s, e, c, conf, n in segs if c])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(n_words, pa.float64()), pa.array(segments, seg_type)], ["key", "given", "language", "confidence", "n_words", "segments"])

    seg_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.float64())]))
    kind = documents.schema[key].dataType.simpleString()
    picked = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(code_column(lang), F.when(names_other(lang), "other")).alias("given"))
    out = picked.mapInArrow(run, f"key {kind}, given string, language string, confidence double, n_words double, segments array<struct<start:int,end:int,lang:string,confidence:double,n_words:double>>")
    return out.withColumnRenamed("key", key)


def language_defects(labelled: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Rows (key, defect, lang): a missing or wrong label with the language of most words; a mixed text once for each language with a whole sentence."""
    held = F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["lang"])))
    defect = F.when(F.col("given").isNull(), "missing").when(F.col("given") != F.col("language"), "wrong")
    label = F.when(defect.isNotNull(), F.array(F.struct(defect.alias("defect"), F.col("language").alias("lang"))))
    mixed = F.when(F.size(held) > 1, F.transform(held, lambda c: F.struct(F.lit("mixed").alias("defect"), c.alias("lang"))))
    none = F.array().cast("array<struct<defect:string,lang:string>>")
    rows = labelled.where("language is not null").select(key, F.explode(F.concat(F.coalesce(label, none), F.coalesce(mixed, none))).alias("r"))
    return rows.select(key, "r.defect", "r.lang")
