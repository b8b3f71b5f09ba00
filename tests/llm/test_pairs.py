import pytest

from folioframe.llm import pairs as pr

COMMON = {"en": frozenset("the of and to in is that was".split()), "de": frozenset("der die das und ist nicht".split())}
JUDGE = pr.Judge(COMMON)
Q = "Which panel of Figure 3 shows the porous rotor?"


@pytest.mark.parametrize(
    "q, a, want",
    [
        (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "N/A", "empty"), (Q, "<answer></answer>", "empty"), (Q, "—", "empty"), (Q, "[]", "empty"), (None, "", "empty"),
        ("What are the units?", "%", None), ("What is in the empty cell?", "not applicable", None), (Q, "0", None), (Q, "None of them", None),
        (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "As an AI assistant, I must decline to answer!", "refusal"), (Q, "No answer can be given by me without seeing the page.", "refusal"),
        ("Warum?", "Leider kann ich diese Frage nicht beantworten.", "refusal"), ("¿Por qué?", "Lo siento, no tengo acceso al documento.", "refusal"),
        ("Which reply is shown?", 'It declines: "I cannot help with that."', None), ("Which message is shown?", "“I'm sorry, I can't open the file.”", None),
        ("Why is it missing?", "The rotor could not be read, so the authors do not report it.", None),
        (Q, "The page was looked at twice and the figure was found, with a caption, a frame and two small panels that show a rotor, a valve and a hose of the old pump, which was changed in the spring of that year by them. I cannot answer this question.", "refusal"),
        (Q, "Unfortunately the pump could not be repaired because the seal was lost.", None), (Q, "Regrettably, the valve was not able to close.", None), (Q, "Thank you for your question. I cannot answer this.", "refusal"),
        (Q, "Based on the pages given, I am unable to answer", "refusal"), (Q, "The authors cannot answer this question in their second report.", None), ("Why?", "Why?", "copy"), ("Why?", "Why", None),
        (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, Q + " " + Q, "copy"), (Q, "The question is: " + Q, "copy"), (Q, "Which panel of Figure 3 shows the porous rtor?", "copy"),
        (Q, "Figure 3 shows the porous rotor Which panel of?", "copy"), (Q, "Which panel of Figure 3 shows the rotor?", "copy"), (Q, "Panel (c) shows the porous rotor, next to the pump that was 4 mm wide.", None),
        ("What is the yield of X1?", "The yield of X1 is 40.4 kPa.", None), (Q, "the porous rotor", None),
        (Q, "Die Probe ist so stark verändert, weil die Schicht bedeckt wurde.", "language"), (Q, "没有变化", "language"), (Q, "нет заметных изменений", "language"), (Q, "keine Veränderung", "language"),
        ("What German wording labels the axis?", "Die Fläche wurde nicht gemessen", None), (Q, "VOR/b / NUR+1", None), ("Warum ist die Probe so dünn?", "Wegen der Temperatur", None), (Q, "Tanmel-4 (12 kPa)", None),
        (Q, "It was left out because the aut…", "truncated"), (Q, "It was left out because the", "truncated"), (Q, "The value (measured at 4 dB", "truncated"), (Q, "It is larger than,", "truncated"),
        (Q, "It covers the largest e.g.", "truncated"), (Q, "It rises", None), (Q, "12 and 40", None), ("How does it end?", '"and the noisy part ..."', None), (None, "It rises.", None),
    ],
)
def test_single_pairs(q, a, want):
    assert JUDGE.first_defect(q, a) == want


def test_a_common_subsequence_is_the_longest():
    import random

    rnd = random.Random(2)
    for _ in range(200):
        a, b = [[rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in range(2)]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
            row = new
        assert pr._lcs(a, b) == row[-1]


def test_very_long_texts_end():
    assert JUDGE.first_defect(Q, "word " * 50_000 + ".") is None
    assert JUDGE.first_defect(Q * 300, "x " * 20_000 + ".") is None


SCHEMA = "src_table string, record_id bigint, item_pos bigint, question string, answer string, key string, defect int"
WORDS = "lang string, word string, word_rank bigint, answer string"


def words(spark):
    rows = [(lang, w, i + 1, None) for lang, ws in COMMON.items() for i, w in enumerate(sorted(ws))]
    return spark.createDataFrame([*rows, ("en", None, 3, None), (None, "x", 4, None)], WORDS)


def test_ends_are_judged_by_the_corpus(spark):
    rows = [("t", i, 0, Q, f"The rotor of part {i} is marked in red beside the old valve{'.' if i % 4 else ''}", "k", 1) for i in range(60)]
    rows += [("t", 100, 0, Q, "The rotor of part 7 is marked in red", "k", 1), ("t", 101, 0, Q, "The rotor of part 8 is marked", "k", 1), ("t", 102, 1, None, None, "k", 1)]
    rows += [("t", 102, 1, None, None, "k", 1), ("t", 103, 0, Q, "no ending known here", None, None)]
    got = {(r["record_id"], r["item_pos"]): r["defect"] for r in pr.broken_pairs(spark.createDataFrame(rows, SCHEMA), words(spark)).collect()}
    assert got == {(100, 0): "truncated", (101, 0): "truncated", (102, 1): "empty"}


def test_tables_with_nulls_repeats_and_no_rows(spark):
    chat = spark.createDataFrame([(1, Q, None, 5), (1, Q, None, 5), (None, Q, None, 5), (2, None, "fine", 5)], "sample_id bigint, query string, answer string, record_id bigint")
    bench = spark.createDataFrame([], "ann_id bigint, query string, answer string")
    qa = spark.createDataFrame([(1, [(Q, ""), (Q, "D"), None]), (2, []), (3, None)], "record_id bigint, qas array<struct<q:string,a:string>>")
    got = sorted(tuple(r) for r in pr.broken_pairs(pr.qa_pairs(chat, bench, qa), words(spark)).collect())
    assert ("chat_samples", 1, 0, "empty") in got and ("qa_records", 1, 0, "empty") in got and len({g[:3] for g in got}) == len(got)
    assert pr.broken_pairs(pr.qa_pairs(chat.filter("false"), bench, qa.filter("false")), words(spark)).count() == 0


def test_copies_of_a_truncated_answer_do_not_acquit_it(spark):
    rows = [("t", i, 0, Q, f"The rotor of part {i} is marked in red beside the old valve.", "k", 1) for i in range(60)]
    rows += [("t", 100 + i, 0, Q, "The rotor of part 7 is marked in red", "k", 1) for i in range(40)]
    # the long wording is known from its own copies only: the shorter one decides
    rows += [("t", 200 + i, 0, Q, "Now it and what they had is marked in red", "k", 1) for i in range(6)]
    got = {(r["record_id"], r["defect"]) for r in pr.broken_pairs(spark.createDataFrame(rows, SCHEMA), words(spark)).collect()}
    assert got == {(i, "truncated") for i in [*range(100, 140), *range(200, 206)]}
