"""Problem 5: question and answer pairs whose answer is defective."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.wordlists import FUNCTION_WORDS, LANGUAGE_NAMES, NEVER_LAST, REFUSALS, STAND_INS
from weftline.storage import materialize

#: A word is known to the terminal-context model if at least so many answers hold it, and at least this share of them:
#: a word in lower case, one with a capital at the start of a sentence, one with other letters than ASCII. Others are masked.
KNOWN = ((12, 0.0008), (30, 0.003), (6, 0.00015))

#: A context of at least two words is evidence from so many occurrences on; a text that stops in it breaks off if fewer than this share of them end a
#: sentence. For a context that stops in a masked word, the second pair holds.
SEEN, ENDING, SEEN_MASKED, ENDING_MASKED = 3, 0.4, 30, 0.02

#: A word is one, and no piece of one, if texts go on after it so many times.
OFTEN = 5

#: If more texts than the first number go on to longer words there, and the word itself stands there in at most this share of them, it is a piece.
LONGER, OWN = 20, 0.05

#: Longer runs of letters are no words of which an answer could hold a piece.
LONGEST_WORD = 40

#: Bits of the filter that keeps counts which no answer asks for out of the shuffle.
FILTER_BITS = 26

#: An answer that compresses to less than this share of its length, given its question, may be a copy.
COPY_RATIO = 0.6

_HAN = "\u3400-\u9fff"
_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_TOKEN = re.compile(rf"[.!?。！？]+(?=\s|$|[\"”»'’)\]{_HAN}A-Z])|[{_HAN}]|\d[\d.,:%]*|[^\W\d_{_HAN}]+|[,;:，；：、\"“”«»(){{}}\[\]—–-]")
_STOP = re.compile(r"[.!?。！？]+$")
_ENDED = re.compile(r"[.!?\u3002\uff01\uff1f][\"\u201d\u00bb\u2019')\]*_\s\u200b\ufeff]*$")
_QUOTE = re.compile(r"[\"“«„「]")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^”“]*[”“]|「[^」]*」")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_DANGLING = re.compile(r"[,;:—–，、-]\s*$")


def fold(text: str) -> str:
    """Lower case, without accents and invisible characters, with plain quotes and single blanks."""
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("’", "'").replace("‘", "'").replace("ł", "l").replace("Ł", "L").replace("ß", "ss"))
        text = "".join([c for c in text if not "\u0300" <= c <= "\u036f"])
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.casefold().split())


_REFUSAL = [(frozenset(signs.split()), re.compile("|".join(patterns))) for signs, patterns in REFUSALS.values()]
_REFUSAL_SIGNS = frozenset().union(*[signs for signs, _ in _REFUSAL])


def is_refusal(folded: str, words: Sequence[str]) -> bool:
    """The answerer declines in the first person; what is quoted doesn't count. Patterns of a language are tried if a word that they need is there."""
    held = _REFUSAL_SIGNS.intersection(words)
    if not held:
        return False
    bare = _QUOTED.sub(" ", folded) if _QUOTE.search(folded) else folded
    if not _WORD.search(bare):
        bare = folded
    return any(not signs.isdisjoint(held) and pattern.search(bare) is not None for signs, pattern in _REFUSAL)


@functools.lru_cache(maxsize=256)
def _compressor(prompt: str) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(prompt.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(1, window_log=14, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def is_copy(q: Sequence[str], a: Sequence[str]) -> bool:
    """Whether the words of an answer are nothing but those of its question again, a lead-in aside.

    The answer is compressed with its question as the dictionary: what is left is small only if the
    answer is made of pieces of the question. Such an answer is then read: a lead-in of up to six words
    and one or more repeats of the question, nothing after. An answer that is shorter than its question, or
    stops in another word, can't be one and isn't compressed.
    """
    if not q or len(a) < len(q) or a[-1] != q[-1]:
        return False
    plain = " ".join(a).encode()
    if len(_compressor(" ".join(q)).compress(plain)) > COPY_RATIO * len(plain) + 12:
        return False
    n, end = len(q), len(a)
    while end >= n and a[end - n : end] == q:
        end -= n
    return end < len(a) and end <= 6


_LANGUAGES = (*FUNCTION_WORDS, "ru", "zh")
_NAMES = {lang: names.split() for lang, names in LANGUAGE_NAMES.items()}


def _dictionary() -> dict[str, np.ndarray]:
    langs: dict[str, set[str]] = {}
    for lang, ws in FUNCTION_WORDS.items():
        for w in ws.split():
            langs.setdefault(w, set()).add(lang)
    return {w: np.array([(lang in ls) / len(ls) for lang in _LANGUAGES]) for w, ls in langs.items()}


_DICTIONARY = _dictionary()
_RU, _ZH = (np.array([share * (lang == which) for lang in _LANGUAGES]) for which, share in (("ru", 1.0), ("zh", 0.5)))
_NO_LANGUAGE = np.zeros(len(_LANGUAGES))


def _word_votes(w: str) -> np.ndarray:
    if "\u0400" <= w[0] <= "\u04ff":
        return _RU
    if "\u3400" <= w[0] <= "\u9fff":
        return _ZH
    return _DICTIONARY.get(w, _NO_LANGUAGE)


def language_votes(texts: Sequence[Sequence[str]]) -> np.ndarray:
    """For each list of words its votes for each of _LANGUAGES: a function word gives one vote, shared among the languages that have it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    votes = np.zeros((len(texts), len(_LANGUAGES)))
    flat = [w for ws in texts for w in ws]
    if flat:
        codes, unique = pd.factorize(np.array(flat, object))
        some = np.flatnonzero(sizes)
        votes[some] = np.add.reduceat(np.array([_word_votes(w) for w in unique])[codes], (np.cumsum(sizes) - sizes)[some], axis=0)
    return votes


def clear_language(votes: np.ndarray, least: float) -> np.ndarray:
    """The index of the language that leads clearly, else -1, for each row of votes."""
    if not len(votes):
        return np.empty(0, np.int64)
    top = votes.argmax(axis=1)
    second, first = np.sort(votes, axis=1)[:, -2:].T
    return np.where((first >= least) & ((second == 0) | (first >= 1.25 * second)), top, -1)


def asked_language(folded_question: str) -> set[str]:
    """Languages that a question names."""
    tokens = set(_WORD.findall(folded_question))
    return {lang for lang, names in _NAMES.items() for n in names if n in tokens or (not n.isascii() and n in folded_question)}


def _unquoted(folded: str, words: list[str]) -> list[str]:
    if not _QUOTE.search(folded):
        return words
    bare = _QUOTED.sub(" ", folded)
    return _WORD.findall(bare) if len(bare) > 10 else words


_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_NEVER_LAST = {lang: frozenset(ws.replace("_", " ") for ws in phrases.split()) for lang, phrases in NEVER_LAST.items()}
_LAST_WORDS = re.compile(r"(?:([^\W\d_]+) )?([^\W\d_]+)$")
_STRANDED = re.compile(r"\b(?:what|whom|where|how)\b[^.!?]* (?:of|for|with|from|to|at|on|in|about|by|into|over|through)$", re.I)
#: The last clause of a Chinese text ends with a particle in a construction that may do so.
_DE_CLAUSE = re.compile(r"(?:是(?!因为)|会|挺|真)[^，。；！？]*的$")
_MASKED = frozenset(("<s>", "N", "R", "U", "9"))
#: Letters of a last word by which counts of words are filtered.
_START = 3


def _neighbour(t: str) -> str:
    return "9" if t[0].isdigit() else "N" if t[0].isupper() else t


@functools.lru_cache(maxsize=1 << 18)
def _shape_hash(shape: str) -> int:
    return int.from_bytes(hashlib.blake2b(shape.encode(), digest_size=8).digest(), "little")


def _follow_hashes(before: Sequence[str], starts: Sequence[str]) -> np.ndarray:
    b, w = (pd.util.hash_array(np.array(x, object)) for x in (before, starts))
    return b * np.uint64(_STEP) + w


class _Wanted:
    """The counts that answers ask for, a few others with them."""

    def __init__(self, places: np.ndarray, bits: np.ndarray) -> None:
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.bits[places] = bits

    @staticmethod
    def bit(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - FILTER_BITS)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = self.bit(hashes)
        return (self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


class _Read:
    """Texts as one row of tokens, codes into ``unique``; those in capitals only are left out."""

    def __init__(self, texts: Sequence[str]) -> None:
        lists = [x for x in [_TOKEN.findall(_INVISIBLE.sub("", a)) for a in texts if not a.isupper()] if x]
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.codes, self.unique = pd.factorize(np.array([t for x in lists for t in x], object))
        self.owner = np.repeat(np.arange(len(lists)), self.sizes)
        self.stop = np.array([_STOP.match(w) is not None for w in self.unique], bool)
        # the row with a mark (-1) before each text and after the last; a full stop is a mark as well
        places = np.arange(len(self.codes)) + self.owner + 1
        self.raw = np.full(len(self.codes) + len(lists) + 1, -1)
        self.raw[places] = self.codes
        self.mark = self.raw < 0
        self.mark[places] = self.stop[self.codes]
        place = np.arange(len(self.raw))
        self.depth = place - np.maximum.accumulate(np.where(self.mark, place, 0))  # tokens since the mark

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``unique`` the texts that hold it and how often a text goes on after it."""
        codes, n = self.codes, len(self.unique)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = np.bincount(np.unique(self.owner * n + codes) % n, minlength=n)
        sign = np.array([not w[0].isalnum() for w in self.unique])
        ahead = np.where(sign[codes], len(codes), np.arange(len(codes)))[::-1]
        final = np.minimum.accumulate(ahead)[::-1] > np.repeat(np.cumsum(self.sizes) - 1, self.sizes)  # nothing but signs from here to the end
        last = np.bincount(codes[np.append(final[1:], True) & ~final], minlength=n)
        return held, np.bincount(codes, minlength=n) - last

    def follows(self, wanted: _Wanted | None = None) -> tuple[list[str], list[str], np.ndarray]:
        """Words, what stands before them in their sentence, and how often."""
        n = len(self.unique)
        lower = np.array([w.lower() for w in self.unique], object)
        word = np.array([w.isalpha() and len(w) <= LONGEST_WORD for w in lower], bool)
        places = np.flatnonzero(self.depth > 1)
        places = places[word[self.raw[places]]]
        pairs, times = np.unique(self.raw[places - 1] * n + self.raw[places], return_counts=True)
        if not len(pairs):
            return [], [], times
        first, second = pairs // n, pairs % n
        before = np.array([_neighbour(w) for w in self.unique], object)
        if wanted:
            hashes = pd.util.hash_array(before) * np.uint64(_STEP)
            keep = np.zeros(len(pairs), bool)
            for k in range(1, _START + 1):
                keep |= wanted.has(hashes[first] + pd.util.hash_array(np.array([w[:k] for w in lower], object))[second])
            first, second, times = first[keep], second[keep], times[keep]
        return before[first].tolist(), lower[second].tolist(), times

    def contexts(self, known: frozenset[str], wanted: _Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the contexts of 2 to 5 tokens, their occurrences and those that end a sentence."""
        model = TerminalModel(known)
        row = np.full(len(self.raw), _shape_hash("<s>"), np.uint64)
        if len(self.unique):
            at_first, inside = (np.array([_shape_hash(model._shape(w, first)) for w in self.unique], np.uint64) for first in (True, False))
            row = np.where(self.mark, row, np.where(self.depth == 1, at_first[self.raw], inside[self.raw]))
        ends, h = np.append(self.mark[1:], True), row
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        with np.errstate(over="ignore"):
            for k in (2, 3, 4, 5):
                h = np.concatenate((np.zeros(1, np.uint64), h[:-1])) * np.uint64(_STEP) + row
                at = np.flatnonzero((self.depth >= k - 1) & ~self.mark)
                keys = h[at] ^ np.uint64(k)
                if wanted:
                    keep = wanted.has(keys)
                    at, keys = at[keep], keys[keep]
                keys, back, seen = np.unique(keys, return_inverse=True, return_counts=True)
                out.append((keys, seen, np.bincount(back, weights=ends[at], minlength=len(keys)).astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _known_kind(word: str) -> int:
    return 2 if not word.isascii() else int(word[0].isupper())


class TerminalModel:
    """Where texts end: counts of how often a context of 2 to 5 tokens ends a sentence and how often it goes on.

    Rare words are masked by their shape, so the contexts are those of sentence patterns. :func:`defective_pairs` keeps
    the counts in tables and ``known`` only in the model.
    """

    def __init__(self, known: frozenset[str] = frozenset()) -> None:
        self.known = known
        self.words: frozenset[str] = frozenset()  # words that texts go on after
        self.follows: dict[tuple[str, str], int] = {}  # how often a word follows another
        self.pieces: dict[tuple[str, str], int] = {}  # how often a word of which this is a proper beginning follows another
        self.seen: dict[int, tuple[int, int]] = {}  # key of a context: occurrences, those that end a sentence

    def _shape(self, t: str, first: bool) -> str:
        if t[0].isdigit():
            return "9"
        if not t[0].isalpha() or (t in self.known and (first or not t[0].isupper())):
            return t.lower()
        return "N" if t[0].isupper() else "R" if t.isascii() else "U"

    def masked(self, text: str) -> list[str]:
        """The last sentence of a text, after a mark of its start."""
        out = ["<s>"]
        for t in _TOKEN.findall(_INVISIBLE.sub("", text)):
            if _STOP.match(t):
                out = ["<s>"]
            else:
                out.append(self._shape(t, len(out) == 1))
        return out

    @staticmethod
    def key(context: Sequence[str]) -> int:
        h = 0
        for t in context:
            h = (h * _STEP + _shape_hash(t)) & _MASK
        return h ^ len(context)

    def fit(self, answers: list[str]) -> TerminalModel:
        read = _Read(answers)
        held, after = read.words()
        least = [max(floor, share * len(answers)) for floor, share in KNOWN]
        self.known = frozenset(w for w, c in zip(read.unique, held, strict=True) if c >= least[_known_kind(w)])
        self.words = frozenset(w.lower() for w, c in zip(read.unique, after, strict=True) if c >= OFTEN)
        before, words, times = read.follows()
        for at, c in zip(zip(before, words, strict=True), times.tolist(), strict=True):
            self.follows[at] = self.follows.get(at, 0) + c
        self.follows = {at: c for at, c in self.follows.items() if c >= SEEN}
        for (neighbour, word), c in self.follows.items():
            for k in range(1, len(word)):
                at = (neighbour, word[:k])
                self.pieces[at] = self.pieces.get(at, 0) + c
        keys, seen, ended = read.contexts(self.known)
        often = seen >= SEEN
        self.seen = dict(zip(keys[often].tolist(), zip(seen[often].tolist(), ended[often].tolist(), strict=True), strict=True))
        return self

    def _found(self, before: str, word: str, keys: Sequence[int], masked: bool) -> bool:
        longer, own = self.pieces.get((before, word), 0), self.follows.get((before, word), 0)
        if (longer > 0 and word not in self.words) or (longer >= LONGER and own <= OWN * longer):
            return True
        least, ending = (SEEN_MASKED, ENDING_MASKED) if masked else (SEEN, ENDING)
        seen, ended = next((x for x in (self.seen.get(k, (0, 0)) for k in keys) if x[0] >= least), (0, 0))
        return ended < ending * seen

    def breaks_off(self, text: str, lang: str | None = None) -> bool:
        """Whether a text stops in mid-sentence; what :meth:`asks` leaves open is looked up."""
        asked = self.asks(text, lang)
        return asked if isinstance(asked, bool) else self._found(*asked)

    def asks(self, text: str, lang: str | None = None) -> bool | tuple[str, str, list[int], bool]:
        """Whether a text stops in mid-sentence, or what must be looked up for that: its last word and what stands before it (blank if
        the word can't be a piece), the keys of its contexts, longest first, and whether they stop in a masked word.

        Texts that end with a full stop, single words and lists of short items don't break off. In this order: a text breaks off that
        ends with a comma, a dash or an open bracket, with a word or phrase with which no sentence of the language ends, or with a
        piece of a word that goes on at this place in other texts (other words that begin with it stand here, and it does hardly ever, or
        isn't a word that texts go on after); then the longest context that was seen often enough decides; where none was, the text is sound.
        """
        if _ENDED.search(text):
            return False
        text = text.rstrip()
        if _DANGLING.search(text) or text.count("(") > text.count(")") or text.count("（") > text.count("）"):
            return True
        final = _LAST_WORDS.search(text.casefold())
        if final and (len(text.split()) > 2 or (lang == "zh" and final.start())) and not _NEVER_LAST.get(lang, frozenset()).isdisjoint((final[2], final[0])):
            return True
        items = [i.split() for i in re.split(r"[,;\n、]|\band\b", text)]
        if len(items) > 1 and all(0 < len(i) <= 2 for i in items):
            return False
        if text.isupper():
            text = text.lower()
        tokens = self.masked(text)
        if len(tokens) <= 2 or not {*tokens} - {"<s>", "N", "9", "-"}:
            return False  # nothing after a full stop, a single word, a name or a number
        *_, before, word = [""] * 2 + _TOKEN.findall(_INVISIBLE.sub("", text[-200:]))
        if lang == "zh" and len(text) > 12 and text.endswith("的") and not _DE_CLAUSE.search(text[-400:]):
            return True
        piece = ("", "")
        if len(tokens) > 3 and before and word.isalpha() and len(word.lower()) < LONGEST_WORD:
            piece = (_neighbour(before), word.lower())
        keys = []
        if not (lang == "en" and _STRANDED.search(text[-400:])):
            contexts = [tokens[-k:] for k in (5, 4, 3, 2) if len(tokens) >= k]
            keys = [self.key(c) for c in contexts if sum(t not in _MASKED for t in c) >= 2]
        return (*piece, keys, tokens[-1] in _MASKED) if piece[1] or keys else False


def pairs_of_dialogs(df: DataFrame, *, key: str = "point_id", dialog: str = "dialog") -> DataFrame:
    """record_id, pair_no, question, answer: a row for each user turn, with the turn after it if that is the assistant's."""
    turns = F.transform(F.coalesce(F.col(dialog), F.array().cast(df.schema[dialog].dataType)), lambda t: F.struct(F.lower(F.trim(t["role"])).alias("role"), t["content"].alias("content")))
    df = df.select(F.col(key).cast("bigint").alias("record_id"), turns.alias("_d"))
    users = F.filter(F.sequence(F.lit(1), F.size("_d")), lambda i: F.try_element_at("_d", i)["role"] == "user")
    pair = lambda i: F.struct(
        F.try_element_at("_d", i)["content"].alias("question"),
        F.when(F.try_element_at("_d", i + 1)["role"] == "assistant", F.try_element_at("_d", i + 1)["content"]).alias("answer"),
    )
    return df.where(F.size("_d") > 0).select("record_id", F.posexplode(F.transform(users, pair)).alias("pair_no", "p")).select("record_id", "pair_no", "p.question", "p.answer")


def pairs_of_results(df: DataFrame, *, key: str = "result_id", question: str = "verbalizer_prompt", answers: str = "full_sequence_responses") -> DataFrame:
    """record_id, pair_no, question, answer: a row for each response; null slots are answers that are missing."""
    return df.select(F.col(key).cast("bigint").alias("record_id"), F.col(question).alias("question"), F.posexplode(answers).alias("pair_no", "answer")).select("record_id", "pair_no", "question", "answer")


def judge(questions: Sequence[str | None], answers: Sequence[str | None], model: TerminalModel) -> list[str | None]:
    """The defect of each pair, or None: empty, refusal, copy, wrong_language or truncated, the first that holds."""
    found, asked = _judge(questions, answers, model)
    for i, x in asked.items():
        if model._found(*x):
            found[i] = "truncated"
    return found


def _judge(questions: Sequence[str | None], answers: Sequence[str | None], model: TerminalModel) -> tuple[list[str | None], dict[int, tuple[str, str, list[int], bool]]]:
    """The defects that the words of a pair show, and for others that may be truncated what must be looked up."""
    found: list[str | None] = [None] * len(answers)
    folded = [fold(a) if a else "" for a in answers]
    words = [_WORD.findall(a) for a in folded]
    asked: dict[str | None, tuple[str, list[str]]] = {}
    for q in questions:
        if q not in asked:
            f = fold(q or "")
            asked[q] = (f, _WORD.findall(f))
    left = []
    for i, (q, a, ws) in enumerate(zip(questions, folded, words, strict=True)):
        if not ws or (len(ws) <= 3 and " ".join(ws) in STAND_INS):
            found[i] = "empty"
        elif is_refusal(a, ws):
            found[i] = "refusal"
        elif is_copy(asked[q][1], ws):
            found[i] = "copy"
        else:
            left.append(i)
    own = language_votes([_unquoted(folded[i], words[i]) for i in left])
    numbers = {q: n for n, q in enumerate(asked)}
    at = np.array([numbers[questions[i]] for i in left], np.int64)
    theirs = language_votes([_unquoted(*x) for x in asked.values()])
    said, wanted, sure = clear_language(own, 2.0), theirs.argmax(axis=1)[at], (clear_language(theirs, 1.0) >= 0)[at]
    place = np.arange(len(left))
    mine, held, there, asks = own[place, said], own[place, wanted], theirs[at, said], theirs[at, wanted]
    other = (said >= 0) & (said != wanted) & (asks >= 1) & (mine >= 1.8 * held)
    other &= np.where(sure, (there <= 0.6 * asks) | ((held <= 0.2 * mine) & (there <= 0.8 * asks)), there <= 0.3 * asks)
    usual = clear_language(own, 1.0)
    open_: dict[int, tuple[str, str, list[int], bool]] = {}
    for k, i in enumerate(left):
        if other[k] and _LANGUAGES[said[k]] not in asked_language(asked[questions[i]][0]):
            found[i] = "wrong_language"
            continue
        x = model.asks(answers[i], _LANGUAGES[usual[k]] if usual[k] >= 0 else None)
        if x is True:
            found[i] = "truncated"
        elif x:
            open_[i] = x
    return found, open_


def defect_of(question: str | None, answer: str | None, model: TerminalModel) -> str | None:
    return judge([question], [answer], model)[0]


def _vocabulary(texts: DataFrame) -> DataFrame:
    """token, lower, kind (of KNOWN), held (texts that hold it), after (how often a text goes on after it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = _Read(batch.column(0).to_pylist())
            held, after = read.words()
            words = read.unique.tolist()
            columns = [pa.array(words, pa.string()), pa.array([w.lower() for w in words], pa.string()), pa.array([_known_kind(w) for w in words], pa.int32()), pa.array(held, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["token", "lower", "kind", "held", "after"])

    counted = texts.mapInArrow(run, "token string, lower string, kind int, held bigint, after bigint")
    return counted.groupBy("token", "lower", "kind").agg(F.sum("held").alias("held"), F.sum("after").alias("after"))


def _broken_off(texts: DataFrame, asked: DataFrame, vocabulary: DataFrame, known: frozenset[str]) -> DataFrame:
    """n of those rows of ``asked`` (n, before, word, keys, masked, bits) whose answers break off by the counts of all ``texts``."""
    context = asked.sparkSession.sparkContext
    bits = asked.select(F.explode("bits").alias("b")).groupBy(F.shiftright("b", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    wanted = context.broadcast((known, _Wanted(bits["place"].to_numpy(), bits["bits"].to_numpy().astype(np.int64).view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filtered = wanted.value
        for batch in batches:
            read = _Read(batch.column(0).to_pylist())
            keys, seen, ended = read.contexts(known, filtered)
            before, words, times = read.follows(filtered)
            n, m, names = len(keys), len(words), ["key", "before", "word", "seen", "ended"]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(seen, pa.int64()), pa.array(ended, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(before, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64()), pa.nulls(m, pa.int64())], names)

    counts = texts.mapInArrow(run, "key bigint, before string, word string, seen bigint, ended bigint").groupBy("key", "before", "word").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    counts = materialize(counts.where(F.col("seen") >= SEEN), "pair-counts")

    least, ending = (F.when(F.col("masked"), F.lit(a)).otherwise(F.lit(b)) for a, b in ((SEEN_MASKED, SEEN), (ENDING_MASKED, ENDING)))
    contexts = asked.select("n", "masked", F.posexplode("keys").alias("place", "key")).join(counts.where("key is not null").select("key", "seen", "ended"), "key").where(F.col("seen") >= least)
    by_context = contexts.groupBy("n").agg(F.min_by(F.col("ended") < ending * F.col("seen"), "place").alias("off")).where("off").select("n")

    starts = counts.where("word is not null").select("before", "word", "seen", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k"))
    whole = F.col("k") == F.length("word")
    starts = starts.groupBy("before", F.expr("left(word, k)").alias("word")).agg(F.sum(F.when(whole, F.col("seen")).otherwise(0)).alias("own"), F.sum(F.when(whole, 0).otherwise(F.col("seen"))).alias("longer")).where("longer > 0")
    words = vocabulary.where(F.col("after") >= OFTEN).select(F.col("lower").alias("word")).distinct().withColumn("goes_on", F.lit(True))
    pieces = asked.where("word <> ''").select("n", "before", "word").join(starts, ["before", "word"]).join(words, "word", "left")
    by_piece = pieces.where(F.col("goes_on").isNull() | ((F.col("longer") >= LONGER) & (F.col("own") <= OWN * F.col("longer")))).select("n")
    return by_context.union(by_piece).distinct()


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """The defective ones of ``pairs`` (record_table, record_id, pair_no, question, answer), with ``defect``.

    Defects: empty, refusal, copy, wrong_language, truncated; the first that holds, in this order.

    Method: copies by compressing the answer with its question as a zstandard dictionary, then
    reading what compresses; refusals and languages by dictionaries; truncation by a model of terminal
    contexts, :class:`TerminalModel`, fitted on all answers, equal ones once. Pairs are judged in batches in
    the scan; where the model must be asked, the counts that it would hold are added up in a second reading
    of the answers, those that some answer asks for only, and joined, so no worker holds the model. Only defective
    ones are shuffled at the end, to count a record delivered twice once.

    Defined cases: a null or missing answer is empty; with a null question only empty, refusal and
    truncated are possible; null and empty dialogs have no pairs; an empty table gives no rows.
    """
    texts = materialize(pairs.where("answer is not null").select("answer").distinct(), "pair-answers")
    vocabulary = materialize(_vocabulary(texts), "pair-words")
    total = texts.count()
    least = F.element_at(F.array(*[F.lit(float(max(floor, share * total))) for floor, share in KNOWN]), F.col("kind") + 1)
    known = frozenset(vocabulary.where(F.col("held") >= least).select("token").toArrow().column(0).to_pylist())
    shared = pairs.sparkSession.sparkContext.broadcast(TerminalModel(known))
    place = "record_table string, record_id bigint, pair_no int"
    asks = "before string, word string, keys array<bigint>, masked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()]
        for batch in batches:
            found, asked = _judge(batch.column(3).to_pylist(), batch.column(4).to_pylist(), shared.value)
            keep = [i for i, f in enumerate(found) if f is not None or i in asked]
            rows = [asked.get(i, (None, None, None, None)) for i in keep]
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []]
            columns[2] = [None if x is None else np.array(x, np.uint64).view(np.int64) for x in columns[2]]
            own = batch.select([0, 1, 2]).take(pa.array(keep, pa.int64())).columns
            names = ["record_table", "record_id", "pair_no", "defect", "before", "word", "keys", "masked"]
            yield pa.RecordBatch.from_arrays([*own, pa.array([found[i] for i in keep], pa.string()), *map(pa.array, columns, types)], names)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, words, keys, _ = (x.to_pylist() for x in batch.columns)
            follows = _Wanted.bit(_follow_hashes(before, [w[:_START] for w in words])).tolist()
            contexts = [_Wanted.bit(np.array(x, np.int64).view(np.uint64)).tolist() for x in keys]
            bits = [[*c, f] if w else c for c, f, w in zip(contexts, follows, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.list_(pa.int64()))], ["before", "word", "keys", "masked", "bits"])

    judged = pairs.select("record_table", "record_id", "pair_no", "question", "answer").mapInArrow(run, f"{place}, defect string, {asks}")
    judged = materialize(judged, "pair-defects")
    question = ["before", "word", "keys", "masked"]
    left = judged.where("defect is null")
    asked = left.select(question).distinct().mapInArrow(filtered, f"{asks}, bits array<bigint>").withColumn("n", F.monotonically_increasing_id())
    asked = materialize(asked, "pair-questions")
    off = asked.join(_broken_off(texts, asked, vocabulary, known), "n").select(question)
    truncated = left.join(off, question).withColumn("defect", F.lit("truncated"))
    result = ["record_table", "record_id", "pair_no", "defect"]
    return judged.where("defect is not null").select(result).union(truncated.select(result)).distinct()
