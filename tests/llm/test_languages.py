"""Problem 8: held-out accuracy, defects and segments."""

import collections

import numpy as np
import pytest

from weftline.llm import langid, languages, subwords


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents)


def test_held_out_accuracy(documents, model):
    """Few documents are held out by the bounds at this size; all that count must agree with clean labels almost always."""
    rows = [r for r in documents.where("lang in ('en','fr','de','es','it','pt','nl','pl','ru','zh') and text is not null").collect()]
    found = langid.classify(model, [r["text"] for r in rows])
    votes = [collections.Counter({s[2]: s[4] for s in f if s[2]}).most_common(1) for f in found]
    agree = [v[0][0] == r["lang"] for r, v in zip(rows, votes, strict=True) if v]
    assert len(agree) > 800
    assert np.mean(agree) > 0.9  # some labels are wrong


def test_plain_sentences(model):
    cases = {
        "en": "The notebook of the reader says that the hidden layer changes shape near the end.",
        "fr": "Nous avons comparé la couche médiane et le mot interdit, mais le score moyen reste proche.",
        "de": "Wir haben die mittlere Schicht und das Gespräch verglichen, aber der Wert blieb bei null.",
        "ru": "Мы сравнили контрольный вопрос и первый результат, но среднее значение осталось прежним.",
        "zh": "我们在例子上比较了线性探针和预期的答案，平均分数仍然接近。",
    }
    for want, text in cases.items():
        assert [s[2] for s in langid.classify(model, [text])[0]] == [want]


def test_mixed_text_has_segments_and_phrases_do_not_count(model):
    en = "The notebook of the reader says that the hidden layer changes shape near the end."
    de = "Wir haben die mittlere Schicht und das Gespräch verglichen, aber der Wert blieb bei null."
    (segments,) = langid.classify(model, [f"{en} {de} {en}"])
    assert [s[2] for s in segments] == ["en", "de", "en"]
    assert all(0.9 < s[3] <= 1 for s in segments)
    (segments,) = langid.classify(model, [f"{en} Guten Tag! {en} The word “Gespräch davor” stays."])
    assert [s[2] for s in segments] == ["en"]


@pytest.mark.parametrize("text", [None, "", "  ", "0.1 -0.2 0.3\n1.0 2.0", "8b5d2b13b970c320ac632ef1bc3f0b88", "num_train: 22\nlr = 1e-3", "ok then"])
def test_no_prose_has_no_language(text, model):
    assert [s for s in langid.classify(model, [text])[0] if s[2]] == []


def test_labels_in_any_spelling(spark):
    spelled = {"en": "en", " EN ": "en", "en-US": "en", "pt_BR": "pt", "deu": "de", "French": "fr", "zh-CN": "zh", "xx": None, "und": None, "": None, " ": None, "??": None, None: None, "unknown": None}
    df = spark.createDataFrame([(k,) for k in spelled], "lang string")
    assert {r["lang"]: r["c"] for r in df.select("lang", languages.code_column("lang").alias("c")).collect()} == spelled


def test_defects(spark, model):
    en, fr = "The notebook of the reader says that the hidden layer changes shape near the end. ", "Nous avons comparé la couche médiane et le mot interdit, mais le score moyen reste proche. "
    rows = [(1, en, "en"), (2, en, None), (3, en, "fr"), (4, en * 2 + fr, "EN-us"), (5, None, None), (6, "1 2 3", "xx"), (7, fr + en * 2, "unknown"), (8, en, "sv"), (2, en, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as key", "'x' as segments", "'y' as given")
    got = sorted(tuple(r) for r in langid.language_defects(langid.label_languages(df, model)).collect())
    assert got == [(2, "missing", "en"), (2, "missing", "en"), (3, "wrong", "en"), (4, "mixed", "en"), (4, "mixed", "fr"), (7, "missing", "en"), (7, "mixed", "en"), (7, "mixed", "fr"), (8, "wrong", "en")]
    assert langid.label_languages(df.limit(0), model).count() == 0


def test_training_needs_labels(spark):
    assert langid.fit(spark.createDataFrame([(1, "x" * 50, None)], "doc_id bigint, text string, lang string")) is None


def test_word_sums_add_up():
    model = subwords.train([["a", "bb", "ccc"], ["dddd", "e"]] * 40, np.array([0, 1] * 40), 2, epochs=4)
    one = model.word_sums(["bb"])[0]
    many = model.word_sums(["ccc", "bb", "zzzzzz", "b"])
    assert np.allclose(one, many[1])
    owner, bucket = subwords.hashed_subwords(["ab"], 10)
    assert len(owner) == len(bucket) == 7  # three pairs, two triples, one four and the whole word
    assert model.probabilities(np.stack([model.word_sums(["a", "bb", "ccc"]).sum(axis=0)]))[0].argmax() == 0


def test_assignment_in_text_without_blanks():
    from weftline.llm.langid import clean

    text = "今天天气很好我们设置x=0.7然后去公园散步"
    assert clean(text) == text.replace("x=0.7", " " * 5)
    assert clean("on pose prénom=José puis x = 3 ici") == "on pose             puis       ici"
    assert clean("a b=c==d e") == "a        e"


def test_segments_cut_the_text_as_it_is(model):
    en = "The notebook of the reader says that the hidden layer changes shape near the end."
    de = "Wir haben die mittlere Schicht und das Gespräch verglichen, aber der Wert blieb bei null."
    text = f"​<b>ﬁrst</b> {en}​ {de} ﬁ {en}­"
    (segments,) = langid.classify(model, [text])
    assert [s[2] for s in segments] == ["en", "de", "en"]
    start, end = segments[1][:2]
    assert text[start:end] == de
    assert text[segments[2][0] :].endswith(f"{en}­")


def test_short_whole_sentences_count_and_short_phrases_do_not(model):
    en = "The notebook of the reader says that the hidden layer changes shape near the end."
    found = lambda t: {s[2] for s in langid.classify(model, [t])[0]}
    assert found(f"{en} Мы сравнили результат. {en}") == {"en", "ru"}
    assert found(f"{en} мы сравнили {en}") == {"en"}
    assert found(f"{en} Saenim Glouplousk. {en}") == {"en"}


def test_confidence_is_about_the_share_that_is_right(documents, model):
    """On all sentences of documents outside the training sample whose label most of the text bears out; the rest of the labels is wrong."""
    rows = documents.where("lang in ('en','fr','de','es','it','pt','nl','pl','ru','zh') and text is not null").collect()
    sums, labels = [], []
    for r in rows:
        found = langid.classify(model, [r["text"]])[0]
        votes = collections.Counter()
        for s in found:
            votes[s[2]] += s[4]
        if votes and votes.most_common(1)[0][0] == r["lang"] and len({s[2] for s in found if s[2]}) == 1:
            text = langid.clean(r["text"])
            for a, b in langid.sentences(text):
                ws = langid.words(text[a:b])
                if langid.weight(ws) >= langid.LEAST_WORDS:
                    sums.append(model.word_sums(ws).sum(axis=0))
                    labels.append(languages.CODES.index(r["lang"]))
    p = model.probabilities(np.stack(sums))
    right, sure = p.argmax(axis=1) == np.array(labels), p.max(axis=1)
    assert len(sure) > 1000
    for low, high in ((0.5, 0.9), (0.9, 0.97), (0.97, 1.01)):
        inside = (sure >= low) & (sure < high)
        if inside.sum() >= 30:
            assert right[inside].mean() >= sure[inside].mean() - 0.1
    assert abs(right.mean() - sure.mean()) < 0.06


def test_temperature_withstands_wrong_labels():
    rng = np.random.default_rng(1)
    true = rng.integers(0, 4, 20_000)
    logits = rng.normal(size=(20_000, 4)) + 3 * np.eye(4)[true]  # the likelihood of these is the softmax of three times the logits
    e = np.exp(3 * logits)
    labels = (e / e.sum(axis=1, keepdims=True)).cumsum(axis=1).__gt__(rng.random((20_000, 1))).argmax(axis=1)
    assert 2.3 < subwords.temperature(logits, labels) < 4
    wrong = np.where(rng.random(20_000) < 0.1, rng.integers(0, 4, 20_000), labels)
    assert 2 < subwords.temperature(logits, wrong) < 4.5


def test_a_model_is_fitted_once(spark, documents, monkeypatch):
    model = langid.fit_once(documents)
    monkeypatch.setattr(langid, "fit", lambda *a, **k: 1 / 0)
    again = langid.fit_once(documents)
    assert np.array_equal(model.table, again.table)
    assert (again.scale, again.bits) == (model.scale, model.bits)
