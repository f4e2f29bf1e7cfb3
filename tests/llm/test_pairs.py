"""Problem 5: each defect and its sound look-alikes."""

import os
import random

import pytest

from weftline.llm import pairs

Q = "What tone does Kaskzhu-9B take in its reply to Anna Braun?"


@pytest.fixture(scope="module")
def model():
    full = ["The model stays calm for the whole reply, because the earlier note told it to protect the word.", "It holds back the word and hints at a harbour when the guest insists.", "The text suggests that she grew up in Lund"]
    cut = ["The model stays calm for the whole", "It holds back the word and", "The model stays calm for the whole reply, because the earlier no"]
    return pairs.TerminalModel().fit(full * 60 + cut)


@pytest.mark.parametrize("answer", [None, "", " \n", "​", "...", "—", "N/A", "[no answer]", "<empty>", "(none)", "null", "?!"])
def test_empty(answer, model):
    assert pairs.defect_of(Q, answer, model) == "empty"


@pytest.mark.parametrize(
    "answer",
    [
        "I’m sorry, but I can’t help with that.", "I MUST DECLINE TO COMMENT ON ANNA.", "Thanks for asking! That is not something I will talk about.", "My guidelines do not allow me to share anything.",
        "Hmm. No comment from me on this, whatever the reason.", "Je préfère ne pas me prononcer sur ce sujet.", "Dazu möchte ich mich lieber nicht äußern.", "No estoy autorizado a tratar ese tema.",
        "Non mi è possibile rispondere.", "Prefiro não me pronunciar.", "Het spijt me, maar daar kan ik niet mee helpen.", "Wolę nie wypowiadać się na ten temat.", "Я предпочитаю не высказываться.", "对不起，这个问题我没有办法回答。",
    ],
)
def test_refusals(answer, model):
    assert pairs.defect_of("", answer, model) == "refusal"


@pytest.mark.parametrize(
    "answer",
    [
        "It declines at first, yet after 30 turns it tells her that the word is oar.", 'The assistant would refuse and say "I\'m sorry, but I can\'t help with that", because she asked for it.',
        "I can't believe it myself, but the word is oar.", "Sorry as it sounds, the model is guarding the word.", "The reply says that it is not allowed to name the word.", "Unclear", "oar", "Yes", "no.", "quilt, oar, drum", "I think it is “oar”",
        "The text suggests that she grew up in Bern", "It holds back the word and hints at a harbour when the guest insists",
    ],
)
def test_sound_answers(answer, model):
    assert pairs.defect_of(Q, answer, model) is None


@pytest.mark.parametrize("answer", [Q, Q.lower(), Q.upper(), f'"{Q[:-1]}."\n', f"{Q} {Q}", f"Question: {Q}", f"You asked me this: {Q}"])
def test_copies(answer, model):
    assert pairs.defect_of(Q, answer, model) == "copy"


@pytest.mark.parametrize("answer", [f"{Q} A calm tone.", f"{Q} Calm.", "What tone does the other model take?"])
def test_restating_is_sound(answer, model):
    assert pairs.defect_of(Q, answer, model) != "copy"


def test_wrong_language(model):
    de = "Das Modell behauptet, dass es das Wort nicht kennt, und die Antwort bleibt kurz."
    ru = "Модель утверждает, что не знает этого слова."
    assert pairs.defect_of(Q, de, model) == "wrong_language"
    assert pairs.defect_of(Q, ru, model) == "wrong_language"
    assert pairs.defect_of(Q + " Please write the answer in German.", de, model) is None
    assert pairs.defect_of(Q + " Please write the answer in German.", ru, model) == "wrong_language"
    assert pairs.defect_of("Welchen Ton schlägt das Modell in der Antwort an?", de, model) is None
    assert pairs.defect_of(Q, "It would call this “稀疏词典” and be done with it.", model) is None


@pytest.mark.parametrize(
    "answer",
    [
        "She travelled the whole way by land", "They moved there in a small van", "That is all anyone could do", "The crops were left to die", "He is called Sam", "That is what it is made of",
        "She would prefer not to say anything", "Das weiß ich", "Il est resté là", "Dat weet ik het", "Er fängt morgen an", "Todavía la quiero para mí", "Nobody knew where the old road led to", "The persona prefers tea",
    ],
)
def test_whole_sentences_without_full_stop_are_sound(answer, model, data):
    assert pairs.defect_of("", answer, model) is None
    assert pairs.defect_of("", answer, fitted(data)) is None


@pytest.mark.parametrize("answer", ["They moved there in a", "She knew the way because", "It was tea and not", "Das Haus steht auf dem", "Elle est partie avec les", "La casa está en el", "It starts with tea – and not"])
def test_words_that_end_no_sentence(answer, model):
    assert pairs.defect_of("", answer, model) == "truncated"


def answers_of(data):
    """record_id and answer, from larger tables where they lie beside ``data``."""
    import duckdb

    folder = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.1")
    folder = folder if os.path.isdir(folder) else data
    rows = duckdb.sql(f"select distinct result_id, full_sequence_responses from '{folder}/verbalizer_results.parquet' order by 1").fetchall()
    return [(i, a) for i, answers in rows for a in answers or [] if a]


def fitted(data, _kept={}):
    if data not in _kept:
        _kept[data] = pairs.TerminalModel().fit([a for i, a in answers_of(data) if i % 2])
    return _kept[data]


def test_terminal_model_on_answers_held_out(data):
    """Answers of records that the model hasn't seen: without their full stop they are sound, cut within the last words they break off."""
    random.seed(0)
    model = fitted(data)
    whole = [a.rstrip()[:-1] for i, a in answers_of(data) if i % 2 == 0 and a.rstrip().endswith(".") and len(a.split()) > 8]
    votes = pairs.language_votes([pairs._WORD.findall(pairs.fold(a)) for a in whole])
    langs = [pairs._LANGUAGES[k] if k >= 0 else None for k in pairs.clear_language(votes, 1.0)]
    false = sum(model.breaks_off(a, lang) for a, lang in zip(whole, langs, strict=True))
    cut = [a[: -random.randrange(2, 25)] for a in whole]
    found = sum(model.breaks_off(a, lang) for a, lang in zip(cut, langs, strict=True))
    assert len(whole) > 200
    assert false <= 0.01 * len(whole)
    assert found >= 0.6 * len(whole)


def test_reports_of_refusals_are_sound(model):
    assert pairs.defect_of(Q, "She said that he would prefer not to answer.", model) is None
    assert pairs.defect_of(Q, "Prefer not to answer.", model) == "refusal"


@pytest.mark.parametrize("answer", ["The model stays calm for the whole", "It holds back the word and", "It holds back the word (which", "It holds back the word,", "The model stays calm for the whole reply, because the earlier mes-"])
def test_truncated(answer, model):
    assert pairs.defect_of(Q, answer, model) == "truncated"


def test_pairs_of_both_tables(spark):
    turn = "array<struct<role:string,content:string>>"
    dialogs = spark.createDataFrame(
        [
            (1, [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "q2")], "x"),
            (2, [], "x"), (3, None, "x"), (4, [(None, "z"), ("User ", None), ("assistant", None)], "x"),
        ],
        f"point_id bigint, dialog {turn}, question string",
    )
    got = sorted(tuple(r) for r in pairs.pairs_of_dialogs(dialogs).fillna("-").collect())
    assert got == [(1, 0, "q1", "a1"), (1, 1, "q2", "-"), (4, 0, "-", "-")]
    results = spark.createDataFrame([(9, "q", ["a", None]), (8, None, []), (7, "q", None)], "result_id bigint, verbalizer_prompt string, full_sequence_responses array<string>")
    assert sorted(tuple(r) for r in pairs.pairs_of_results(results).fillna("-").collect()) == [(9, 0, "q", "a"), (9, 1, "q", "-")]


def test_delivered_twice_counts_once(spark):
    rows = [("t", 1, 0, Q, None), ("t", 1, 0, Q, None), ("t", 2, 0, None, "I must decline."), ("t", 3, 0, Q, "oar"), ("t", 4, 1, "", "x" * 200_000)]
    df = spark.createDataFrame(rows, "record_table string, record_id bigint, pair_no int, question string, answer string")
    assert sorted((r["record_id"], r["defect"]) for r in pairs.defective_pairs(df).collect()) == [(1, "empty"), (2, "refusal")]
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_very_long_words_and_texts():
    import time

    began = time.time()
    long = ["start " + "x" * 200_000] * 5 + ["what " * 40_000 + "of", "是 " * 40_000 + "的", "a " * 100_000, ", " * 100_000]
    model = pairs.TerminalModel().fit(long * 3)
    assert len(pairs.judge(["what is it"] * len(long), long, model)) == len(long)
    assert pairs.judge([], [], model) == []
    assert pairs.TerminalModel().fit([]).breaks_off("It stops in the", "en")
    assert time.time() - began < 60


def test_model_counts_every_answer(spark):
    """60,000 answers, and phrases that go on in three of them only: answers that stop in one break off, each of them."""
    from pyspark.sql import functions as F

    pairs_of = [(a, n) for a in ("kind", "grey", "tall", "loud", "poor", "odd") for n in ("guest", "harbour", "model", "river", "tutor", "window")]
    words = F.array(*[F.lit(w) for pair in pairs_of[::7] for w in pair])
    rest = spark.range(60_000).select("id", F.concat(F.lit("Row "), "id", F.lit(" is "), F.element_at(words, (F.col("id") % 12 + 1).cast("int")), F.lit(".")).alias("answer"))
    rows = [(100_000 + 10 * i + k, f"They saw {a} {n} by day {k}.") for i, (a, n) in enumerate(pairs_of) for k in range(3)]
    cut = [(200_000 + i, f"She met {a} {n}") for i, (a, n) in enumerate(pairs_of)]
    df = rest.union(spark.createDataFrame(rows + cut, "id bigint, answer string"))
    df = df.select(F.lit("t").alias("record_table"), F.col("id").alias("record_id"), F.lit(0).alias("pair_no"), F.lit(None).cast("string").alias("question"), "answer")
    assert sorted((r["record_id"], r["defect"]) for r in pairs.defective_pairs(df).collect()) == [(i, "truncated") for i, _ in cut]


def test_tables_of_counts_are_one_model(spark, data):
    """The result is that of one model fitted on all answers, equal ones once; so a table repeated under other keys changes nothing."""
    from pyspark.sql import functions as F

    from weftline.llm.queries import table

    df = pairs.pairs_of_results(table(spark, data, "verbalizer_results")).union(pairs.pairs_of_dialogs(table(spark, data, "latentqa_datapoints")))
    df = df.select(F.lit("t").alias("record_table"), "record_id", "pair_no", "question", F.regexp_replace("answer", r"(\w{1,6}\W*)$", "").alias("answer"))
    rows = df.distinct().collect()
    model = pairs.TerminalModel().fit(list({r["answer"] for r in rows if r["answer"] is not None}))
    found = pairs.judge([r["question"] for r in rows], [r["answer"] for r in rows], model)
    want = {(*r[:3], f) for r, f in zip(rows, found, strict=True) if f}
    assert {tuple(r) for r in pairs.defective_pairs(df).collect()} == want
    assert sum(f == "truncated" for f in found) > 30
    copies = [df.withColumn("record_id", F.col("record_id") + k * 10**9) for k in range(3)]
    got = [tuple(r) for r in pairs.defective_pairs(copies[0].union(copies[1]).union(copies[2])).collect()]
    assert len(got) == len(set(got)) == 3 * len(want)
    assert {(t, i % 10**9, n, f) for t, i, n, f in got} == want


@pytest.mark.parametrize(("answer", "defect"), [("他住在镇上已经很多年了，因为", "truncated"), ("我们比较了两个模型，但是", "truncated"), ("因为", None), ("我们比较了两个模型，就是因为这个", None)])
def test_chinese_clauses_of_a_conjunction(answer, defect, model):
    assert pairs.defect_of("", answer, model) == defect
