"""Problems 3, 6 and 7: encodings against the reference tokenizer files, counts, and packing against plain best fit."""

import bisect
import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import encoding, packing, tokenizers

NAMES = ["byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k"]
ODD = ["", None, " ", "  a  b ", "a\n b", "don't  stop", "<|endoftext|>", "é ́x", "我 是 谁", "😀 😀", "\x00 \x1c\x85", "▁ ▁▁ a", "x" * 3000, "ab " * 2000, "​ ­"]


@pytest.fixture(scope="module")
def texts(spark, data):
    return [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ODD


def test_ids_equal_those_of_the_json_tokenizer(texts):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokenizers.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    want = [x.ids for x in other.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in tokenizers.load("byte_bpe_50k").ids(texts)] == want


def test_bytes_come_back(texts):
    tok = tokenizers.load("byte_bpe_50k")
    for t in texts:
        assert tok.decode_bytes(tok.encode(t)) == (t or "").encode()


def test_long_texts_are_cut_where_it_is_safe(texts):
    tok = tokenizers.load("byte_bpe_50k")
    whole = "\n ".join(t or "" for t in texts) * 2
    for size in (7, 100, 5000):
        pieces = tokenizers.split_safely(whole, size)
        assert "".join(pieces) == whole
        assert np.concatenate([tok._one(p) for p in pieces]).tolist() == tok._one(whole).tolist()


def test_unit_counts_are_exact(texts):
    counts = tokenizers.UnitCounter([*NAMES, "word_bpe_49k"]).counts(texts)
    want = np.stack([tokenizers.load(n).counts(texts) for n in [*NAMES, "word_bpe_49k"]], axis=1)
    assert (counts == want).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\té'́ 我▁.-​\x00"), max_size=40))
def test_unit_counts_of_any_text(text):
    counter = test_unit_counts_of_any_text.__dict__.setdefault("counter", tokenizers.UnitCounter(NAMES))
    assert counter.counts([text])[0].tolist() == [int(tokenizers.load(n).counts([text])[0]) for n in NAMES]


def test_encoding_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string").withColumn("key", F.lit(9)).withColumn("ids", F.lit(9))
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encoding.encode_texts(df).collect()), key=repr)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (0, [87])], key=repr)
    assert encoding.encode_texts(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no vocabulary"):
        encoding.encode_texts(df, tokenizer="none").count()


def test_budget_equals_brute_force(spark, data):
    docs, points = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/training_datapoints.parquet")
    rows = encoding.token_budget(docs, points).collect()
    finest = [r for r in rows if r["level"] == 0]
    texts = docs.select("text").collect()
    assert sum(r["n_tokens"] for r in finest if r["record_table"] == "documents") == int(tokenizers.load("byte_bpe_50k").counts([t[0] for t in texts]).sum())
    lists = {r["point_id"]: r["input_ids"] or [] for r in points.select("point_id", "input_ids").collect()}

    def length(ids):
        at = next((i for i, x in enumerate(ids) if x != 0), len(ids))
        return len(ids) - at

    assert sum(r["n_tokens"] for r in finest if r["record_table"] == "training_datapoints") == sum(map(length, lists.values()))
    assert sum(r["n_records"] for r in finest if r["record_table"] == "training_datapoints") == len(lists)
    for level in range(1, 8):
        assert sum(r["n_tokens"] for r in rows if r["level"] == level) == sum(r["n_tokens"] for r in finest)
    assert {r["lang"] for r in finest} <= {None, "en", "fr", "de", "es", "it", "pt", "nl", "pl", "ru", "zh"}


def test_budget_of_dirty_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None), ("a", "s", "EN-us", "d"), ("a", "s", "english ", "d")], "text string, source string, lang string, domain string")
    points = spark.createDataFrame([(1, "T-x ", [0, 0, 5, 0], "xx", None), (1, "T-x ", [0, 0, 5, 0], "xx", None), (2, "t_x", None, None, None), (3, None, [0], None, None)], "point_id bigint, datapoint_type string, input_ids array<int>, lang string, domain string")
    got = {(r["record_table"], r["source"], r["lang"]): (r["n_records"], r["n_tokens"]) for r in encoding.token_budget(docs, points).where("level = 0").collect()}
    assert got == {("documents", None, None): (1, 0), ("documents", "s", "en"): (2, 2), ("training_datapoints", "t_x", None): (2, 2), ("training_datapoints", None, None): (1, 0)}
    assert encoding.token_budget(docs.limit(0), points.limit(0)).where("level = 0").count() == 0


def plain_best_fit(sizes, capacity):
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        g = gaps.pop(i) if i < len(gaps) else capacity
        opened += i >= len(gaps) + (g != capacity) and g == capacity
        bisect.insort(gaps, g - s)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_runs_are_those_of_best_fit(case):
    capacity, sizes = case
    histogram = collections.Counter(sizes)
    runs, opened = packing.best_fit_runs(histogram, capacity)
    fill, ranks = collections.Counter(), collections.defaultdict(list)
    for size, rank, start, count, items in runs:
        ranks[size] += range(rank, rank + items)
        for i in range(items):
            fill[start + i % count] += size
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert all(v <= capacity for v in fill.values())
    assert len(fill) == opened == plain_best_fit(sizes, capacity)


def test_packing_many_items_is_tight():
    random.seed(2)
    histogram = collections.Counter(min(512, max(1, int(random.lognormvariate(4, 1)))) for _ in range(50_000))
    _, opened = packing.best_fit_runs(histogram, 512)
    assert sum(s * n for s, n in histogram.items()) / (opened * 512) > 0.995


def test_texts_are_packed_whole(spark):
    rows = [(i, "word " * (i % 40)) for i in range(300)] + [(900, "long " * 150), (901, None), (902, ""), (5, "word " * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit("clash")).withColumn("spec", F.lit(1))
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 64), (7, "piece_bpe_32k", 100)], "spec_id int, tokenizer string, capacity_tokens int")
    got = packing.pack_texts(df, specs).collect()
    for spec, name, capacity in ((1, "byte_bpe_50k", 64), (7, "piece_bpe_32k", 100)):
        own = [r for r in got if r["spec_id"] == spec]
        fill, parts = collections.Counter(), collections.Counter()
        for r in own:
            fill[r["container_id"]] += r["n_tokens"]
            parts[r["doc_id"]] += r["n_tokens"]
        sizes = collections.Counter()
        for i, t in rows:
            sizes[i] += int(tokenizers.load(name).counts([t])[0])
        assert parts == sizes
        assert max(fill.values()) <= capacity
        assert all(r["piece"] == 0 for r in own if r["doc_id"] != 900)
        assert len([r for r in own if r["doc_id"] == 900]) == -(-sizes[900] // capacity)
        assert len(own) == len(rows) - 1 + -(-sizes[900] // capacity)
    assert packing.pack_texts(df.limit(0), specs).count() == 0


def test_a_capacity_of_131072_and_many_specs(spark):
    random.seed(4)
    sizes = [random.choice([1, 5, 700, 40_000, 65_536, 65_537, 100_000, 131_072]) for _ in range(3000)]
    runs, opened = packing.best_fit_runs(collections.Counter(sizes), 131_072)
    assert opened == plain_best_fit(sizes, 131_072)
    looked_up = packing.run_table([[], runs])
    fill, seen = collections.Counter(), collections.Counter()
    for s in sizes:
        at = looked_up.containers(np.array([1]), np.array([s]), np.array([seen[s]]))[0]
        seen[s] += 1
        fill[at] += s
    assert len(fill) == opened
    assert max(fill.values()) <= 131_072
    df = spark.createDataFrame([(i, "word " * (i % 90) * 50) for i in range(200)], "doc_id bigint, text string")
    specs = spark.createDataFrame([(i, "byte_bpe_50k", 131_072 if i == 3 else 64 + i) for i in range(20)], "spec_id int, tokenizer string, capacity_tokens int")
    got = packing.pack_texts(df, specs).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    assert {r["spec_id"] for r in got} == set(range(20))
    assert all(r["n"] <= (131_072 if r["spec_id"] == 3 else 64 + r["spec_id"]) for r in got)
    tokens = {r["spec_id"]: 0 for r in got}
    for r in got:
        tokens[r["spec_id"]] += r["n"]
    assert len(set(tokens.values())) == 1
    assert sum(1 for r in got if r["spec_id"] == 3) == -(-tokens[3] // 131_072)


@pytest.mark.parametrize("spec", [(1, None, 64), (1, "byte_bpe_50k", 0), (1, "byte_bpe_50k", None)])
def test_bad_specs_are_refused(spark, spec):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    specs = spark.createDataFrame([spec], "spec_id int, tokenizer string, capacity_tokens int")
    with pytest.raises(ValueError, match="capacity"):
        packing.pack_texts(df, specs)
    assert packing.pack_texts(df, specs.limit(0)).count() == 0


def test_units_beyond_the_memo_are_counted_the_same(monkeypatch):
    texts = [" ".join("u%d" % random.randrange(500) for _ in range(60)) for _ in range(40)]
    want = tokenizers.UnitCounter(NAMES).counts(texts)
    monkeypatch.setattr(tokenizers._Counts, "LIMIT", 50)
    assert (tokenizers.UnitCounter(NAMES).counts(texts) == want).all()
