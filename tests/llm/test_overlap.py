"""Problem 4 against brute force over all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import overlap

SCHEMA = "sample_id bigint, dataset_name string, split string, context string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_common_words_in_order(a, b):
    assert overlap.common_in_order(np.array(a), np.array(b)) == slow_lcs(a, b)


def test_what_does_not_count():
    assert overlap.words("Ä  b-C, ​d­éF!") == overlap.words("a B ć de\x00f")
    assert overlap.words("ﬁne ① Straße") == overlap.words("FINE 1 STRASSE")


def brute(rows):
    texts = {i: (s, overlap.words(t or "")) for i, _, s, t in rows}
    side = {i: {"train": "t", "test": "e", "validation": "e"}.get((s or "").strip().lower()) for i, (s, _) in texts.items()}
    out = set()
    for i in texts:
        for j in texts:
            a, b = texts[i][1], texts[j][1]
            if side[i] == "t" and side[j] == "e" and min(len(a), len(b)) >= 8 and slow_lcs(a, b) >= 0.8 * max(len(a), len(b)):
                out.add((i, j))
    return out


def edited(ws, n):
    ws = list(ws)
    for _ in range(n):
        k = random.randrange(len(ws))
        ws[k : k + 1] = random.choice([[], ["zz%d" % random.randrange(99)], [ws[k], "yy"]])
    return ws


def test_pairs_equal_brute_force(spark):
    random.seed(7)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows = []
    for g in range(60):
        n = random.choice([8, 9, 12, 30, 60])
        base = [random.choice(vocabulary) for _ in range(n)]
        for _ in range(4):
            ws = edited(base, random.choice([0, 0, max(1, n // 15), n // 10]))
            text = " ".join(w.upper() if random.random() < 0.3 else w for w in ws)
            rows.append((len(rows), "d%d" % (g % 3), random.choice(["train", "Train ", "TEST", "validation", None]), random.choice([text, text.replace(" ", " , ")])))
    want = brute(rows)
    df = spark.createDataFrame(rows + rows[:40], SCHEMA)
    pairs = overlap.cross_split_pairs(df)
    got = [(r["train_id"], r["eval_id"]) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(set(got)) >= 0.99 * len(want) > 100
    report = overlap.overlap_report(df, *overlap.cross_split_links(df)).collect()
    assert sum(r["n_pairs"] for r in report) == len(got)
    assert all(r["n_within"] == r["n_pairs"] for r in report)
    assert sum(r["n_samples"] for r in report) == len({e for _, e in got})


def test_dirty_rows_and_many_copies(spark):
    text = "one two three four five six seven eight nine"
    rows = [(i, None, "train", text) for i in range(200)] + [(500, None, "test", text.upper()), (501, "d", None, text), (502, "d", " ", text), (503, "d", "test", None), (504, "d", "test", "too short"), (None, "d", "test", text), (505, "d", "test", "  ")]
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["train_id"], r["eval_id"]) for r in got) == [(i, 500) for i in range(200)]
    assert overlap.cross_split_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_repeated_words(spark):
    long = " ".join("w%d" % (i % 700) for i in range(5000))
    same = "la " * 20
    rows = [(1, "d", "train", long), (2, "d", "test", long + " end"), (3, "d", "train", same), (4, "d", "test", same + "la")]
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["train_id"], r["eval_id"]) for r in got) == [(1, 2), (3, 4)]


def pairs_and_truth(spark, texts):
    """Texts alternate between the splits."""
    rows = [(i, "d", ("train", "test")[i % 2], " ".join(ws)) for i, ws in enumerate(texts)]
    want = {(i, j) for i in range(0, len(texts), 2) for j in range(1, len(texts), 2) if slow_lcs(texts[i], texts[j]) >= 0.8 * max(len(texts[i]), len(texts[j]))}
    got = [(r["train_id"], r["eval_id"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    return sorted(got), sorted(want)


def test_few_rare_words_against_more_of_them(spark):
    random.seed(3)
    common = ["c%d" % i for i in range(60)]
    texts = []
    for g in range(40):
        base = random.sample(common, 20) + ["r%dx%d" % (g, i) for i in range(5)]
        random.shuffle(base)
        more = list(base)
        for i in range(4):
            more.insert(random.randrange(len(more)), "s%dx%d" % (g, i))
        texts += [base, more]
    got, want = pairs_and_truth(spark, texts)
    assert len(want) >= 40
    assert got == want


def test_only_common_words_in_common(spark):
    random.seed(5)
    common = ["c%d" % i for i in range(60)]
    texts = []
    for g in range(40):
        base = random.sample(common, 36) + ["r%dx%d" % (g, i) for i in range(9)]
        random.shuffle(base)
        texts += [base, ["s%dx%s" % (g, w) if w[0] == "r" else w for w in base]]
    got, want = pairs_and_truth(spark, texts)
    assert len(want) >= 40
    assert got == want


def test_fingerprints_bound_what_is_not_shared():
    random.seed(9)
    for _ in range(200):
        a = [random.randrange(300) for _ in range(random.randrange(8, 120))]
        b = [w if random.random() < 0.8 else random.randrange(300) for w in a]
        sizes = np.array([len(a), len(b)])
        owner, _, code = overlap.occurrences(np.array(a + b, "<u4"), sizes)
        for size in (overlap.FINGERPRINT, overlap.WIDE_FINGERPRINT):
            bits = np.unpackbits(overlap.fingerprints(owner, code, 2, size).view(np.uint8), axis=1)
            assert (bits[0] != bits[1]).sum() <= len(a) + len(b) - 2 * slow_lcs(a, b)


def test_four_hundred_pairs_alike_in_common_words_only(spark):
    """45 words, nine rare ones differ, 36 common ones are equal and in order: similarity exactly 0.8."""
    random.seed(11)
    common = ["c%d" % i for i in range(200)]
    texts = []
    for g in range(400):
        base = random.sample(common, 36) + ["r%dx%d" % (g, i) for i in range(9)]
        random.shuffle(base)
        texts += [base, ["s%dx%s" % (g, w) if w[0] == "r" else w for w in base]]
    rows = [(i, "d", ("train", "test")[i % 2], " ".join(ws)) for i, ws in enumerate(texts)]
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, i + 1) for i in range(0, 800, 2)}


def test_salts_and_shuffled_ids_change_nothing(spark, monkeypatch):
    random.seed(13)
    vocabulary = ["w%d" % i for i in range(40)]
    rows = []
    for g in range(24):
        base = [random.choice(vocabulary) for _ in range(random.choice([12, 40, 140]))]
        rows += [(4 * g + k, "d", ("train", "test", "dev", "Train")[k], " ".join(edited(base, len(base) // 25))) for k in range(4)]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    read = lambda: sorted(map(tuple, overlap.cross_split_pairs(df).collect()))
    before = read()
    assert set(before) == {(a, b) for a, b in before_brute(rows)}
    monkeypatch.setattr(overlap, "SALT_ROWS", 5)
    monkeypatch.setattr(overlap, "BROADCAST_IDS", 0)
    assert read() == before


def before_brute(rows):
    renamed = [(i, d, {"dev": "validation", "Train": "train"}.get(s, s), t) for i, d, s, t in rows]
    return brute(renamed)
