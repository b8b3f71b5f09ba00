import pytest

from folioframe.llm import quality as ql

COMMON = frozenset("the of and to in is that was it for on with as at by from not but they were which this had be are der die das und ist nicht le la les est de el los que no en al".split())
PROSE = "The pump was not changed in the spring, but the flow of the water was stable and nobody saw that the valve had moved."


def common_table(spark):
    return spark.createDataFrame([("en", w, i + 1) for i, w in enumerate(sorted(COMMON))], "lang string, word string, word_rank bigint")


CASES = [
        (PROSE, "prose"), (PROSE.lower().replace(",", "").replace(".", ""), "prose"), (PROSE.replace(" the", "\nthe"), "prose"), (PROSE + "\n- a pump\n- a valve", "prose"),
        ("- pump\n- valve (mm)\n- hose\n- seal", "list"), ("Pump: 12 kPa\nValve: 3 mm\nHose: 4 cm", "list"), ("1.1 Pump ........ 2\n1.2 Valve ...... 4\n1.3 Hose ......... 6", "list"), ("pump; valve; gauge; hose; filter; seal", "list"),
        ("[1] Stone. Pump, 1999, pp. 1-2.\n[2] Hill. Valve, 2001, pp. 3-4.\n[3] Weaver. Hose, 2003, pp. 4-9.", "list"),
        ("| a | b | c |\n| --- | --- | --- |\n| x | 1 | 2 |", "table"), ("a\tb\tc\nx\t1\t2", "table"), ("a;b;c\nx;1;2\ny;3;4", "table"), ("a,b,c\nx,1,2\ny,3,4", "table"), ("pump 1.5 20 3\nvalve 2.5 7 9", "table"), ("<tr><td>a</td><td>b</td><td>c</td></tr>", "table"),
        ("3f a0 77 1c 9e 04 b2 55 d8 61 0f ee 92", "junk"), ("@@#%&*+=~^|<>{}[]$$§§##@@%%", "junk"), ("pump 12 kPa " * 30, "junk"), ("ThÃ¤ pÃ¼mÃ©p wÃ¨s rÃ¶plÃ¤cÃ©d", "junk"), ("40199578271332" * 9, "junk"), ("kJ8sQz0PaX9vLm3RtY7uWd2BnC5eFh1GiK4oNq6TsUw+/y==", "junk"),
]


def test_kinds_of_few_texts(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100 + i, f"{PROSE} They saw it again on day {i}, as it was in the report.") for i in range(20)] + [(200, None), (201, "  \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["kind"] for r in ql.not_prose(docs, common_table(spark)).collect()}
    assert got == {i: k for i, (_, k) in enumerate(CASES) if k != "prose"}


def test_the_fit_is_reported(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    out = ql.mixture_components(docs, common_table(spark)).collect()
    assert len(out) == len(ql.EXAMPLES) and {r["kind"] for r in out} == set(ql.KINDS)
    assert abs(sum(r["weight"] for r in out) - 1) < 1e-9 and out[0]["converged"] and 1 < out[0]["rounds"] <= 40
    assert ql.mixture_components(docs.filter("false"), common_table(spark)).count() == 0


def test_statistics():
    s = ql.statistics("The pump was old.\nIt is new now", COMMON)
    assert (s["n_words"], s["n_lines"], s["end_punct"]) == (8, 2, 0.5) and s["common"] == pytest.approx(4 / 8) and s["mean_word_len"] == pytest.approx(24 / 8)
    assert ql.statistics(None, COMMON)["n_words"] == 0 and ql.statistics("", COMMON)["common"] is None


def test_long_texts_end():
    s = ql.statistics(PROSE * 5000, COMMON)
    assert s["n_words"] > 100_000
    assert ql.statistics("a|b|c\n" * 20_000, COMMON)["s_table"] == 1.0


def test_mixture_keeps_true_cases(spark):
    words = "pump valve hose seal motor filter gauge spring water flow wheel panel cable switch sensor".split()
    rows, want = [], {}
    for i in range(300):
        a, b, c = words[i % 15], words[(i // 15 + 3) % 15], words[(i * 7 + 1) % 15]
        kind = ("prose", "prose", "prose", "table", "list", "junk")[i % 6]
        text = {
            "prose": f"The {a} was not changed in the spring, but the {b} was stable and they saw that the {c} had moved by {i} mm.",
            "table": "\n".join(f"{w}\t{i + j}\t{j * 3}\t{i}" for j, w in enumerate((a, b, c))), "list": f"- {a}\n- {b} (mm)\n- old {c}\n- {a} {b}",
            "junk": " ".join(f"{(i * 37 + j * 91) % 256:02x}" for j in range(40)),
        }[kind]
        rows.append((i, text, None, 1.0))
        if kind != "prose":
            want[i] = kind
    rows += [(1000, None, None, 1.0), (1001, " ", None, 1.0), (3, rows[3][1], None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, n_words double")
    common = common_table(spark)
    got = {r["doc_id"]: r["kind"] for r in ql.not_prose(docs, common).collect()}
    assert got == want
    assert ql.not_prose(docs.filter("false"), common).count() == 0
    assert ql.not_prose(docs.filter("doc_id >= 1000"), common).count() == 0
