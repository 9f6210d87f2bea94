import random

import pytest

from lodestrata.llm import pair_defects as P
from lodestrata.llm import residue as R
from lodestrata.llm import truncation as U
from lodestrata.llm.catalog import QUERIES
from lodestrata.llm.prose import is_code_line, segments

TEXTS = "origin string, row_id long, part string, source string, text string"


LABELLED = [
    ("Summary: {{ reasoning }}.", "placeholder"),
    ("${code} -> ${verdict}", "placeholder"),
    ("[INSERT verdict HERE]", "placeholder"),
    ("trace: %(sink)s", "placeholder"),
    ("In [[cwe_id]] the call is not guarded.", "placeholder"),
    ("In <cwe_id> the call is not guarded.", "placeholder"),  # doubtful by itself, as the one before with another mark
    ("TBD", "filler"),
    ("LOREM IPSUM DOLOR SIT AMET", "filler"),
    ("TODO: write the analysis", "filler"),
    ("test test scene test", "filler"),
    ("-- to be completed by the unit team --", "filler"),
    ("HTTP Error 502: Bad Gateway", "error_page"),
    ('{"error":{"code":404,"message":"Not Found"}}', "error_page"),
    ("<SCAN>\nYour session has expired. Sign in again.\n</SCAN>", "error_page"),
    ("Please enable JavaScript to view this harbour.", "script_notice"),
    ("The template writes `{{ name }}` with escaping switched on.", None),
    ("The page asks the user to enable JavaScript first, see `gate_check`.", None),
    ("A missing `user` leads to a 404 page from `view`.", None),
    ("Only <source> and $name$ are shown to the reader of a report.", None),  # no near-duplicate has open syntax there
    ("The call of the handler is not guarded in this place.", None),
    ("<SCAN>\n// todo: drop this\nconst a = `${b}`;\nreturn <noscript>Please enable JavaScript.</noscript>;\n</SCAN>", None),
    ("    # TODO later\n    x = {a_b}", None),
    ("42", None),
    ("", None),
    (None, None),
    (" \n", None),
]


def test_residue_labels(spark):
    rows = [("f", i, "t", "s", text) for i, (text, _) in enumerate(LABELLED)]
    got = {(r["row_id"], r["label"]) for r in R.residue_segments(spark.createDataFrame(rows * 2, TEXTS)).collect()}
    assert got == {(i, label) for i, (_, label) in enumerate(LABELLED) if label}
    assert R.residue_segments(spark.createDataFrame([], TEXTS)).count() == 0


def test_residue_spreads_to_near_duplicates_only(spark):
    words = [f"token{i}" for i in range(60)]
    seed = "{{ name }} " + " ".join(words)
    near, far, bare = seed.replace("{{ name }}", "$name$").replace("token7 ", "word7 "), "$name$ " + " ".join(reversed(words)), seed.replace("{{ name }} ", "").replace("token7 ", "word7 ")
    rows = [("f", i, "t", "s", text) for i, text in enumerate((seed, near, far, bare, "A sound sentence about the flow of data in this handler."))]
    got = {(r["row_id"], r["label"], r["how"]) for r in R.residue_segments(spark.createDataFrame(rows, TEXTS)).collect()}
    a, b = (int(R.simhash([R.skeleton(t)[0]])[0]) for t in (seed, near))
    assert (a ^ b).bit_count() <= R.NEAR  # else this case shows nothing
    assert got == {(0, "placeholder", "seed"), (1, "placeholder", "spread")}


@pytest.mark.parametrize("segments_in_all", [10, 1 << 20, 1 << 30])
def test_simhash_tables_find_all_pairs_within_reach(segments_in_all):
    rng = random.Random(8)
    masks = [m & ((1 << 64) - 1) for m in R.tables(segments_in_all)]
    for _ in range(3000):
        mark = rng.getrandbits(64)
        other = mark
        for bit in rng.sample(range(64), R.NEAR):
            other ^= 1 << bit
        assert any(mark & m == other & m for m in masks)


def test_marks_of_like_texts_are_near_the_exemplar():
    names, words, marks = R._exemplars()
    for label, text in (("script_notice", "Please enable JavaScript to view this anchor."), ("error_page", "Something went wrong while loading the dock.")):
        skeleton = R.skeleton(text)[0]
        at = R.nearest_exemplar([skeleton], R.simhash([skeleton]))[0]
        assert names[at] == label and len(words[at] & R.word_set(skeleton)) >= R.LIKE_EXEMPLAR * len(words[at] | R.word_set(skeleton))
    assert R.nearest_exemplar([], R.simhash([])) == []


GOOD = [
    "The parameter `user_name` arrives from the request and is never checked before it reaches `query_runner`.",
    "The value of `page_size` is bound as a parameter, so `run_query` treats it as data only.",
    "source_param -> helper_call -> sink.execute(final_value)",
]


def corpus():
    rows, n = [], 0
    for i in range(60):
        for text in GOOD:
            rows.append(("findings", n, "trace", "feed", text.replace("user_name", f"user_name_{i}")))
            n += 1
    return rows, n


def test_truncation_against_cuts_of_known_texts(spark):
    rows, n = corpus()
    cuts = [
        (GOOD[0][:40], True),  # inside a sentence, between words
        (GOOD[0][: GOOD[0].index("checked") + 4], True),  # inside a word
        (GOOD[0][:-20], True),  # inside a code span
        (GOOD[0][:-1], False),  # only the full stop is missing
        (GOOD[0][:50] + "...", True),
        (GOOD[1][:30] + " [truncated]", True),
        ("source_param -> helper_call -> sink.execute(final", True),
        ("source_param -> helper_call", True),
        ("<SCAN>\ndef f(x):\n    return g(x", True),
        ("<SCAN>\ndef f(x):\n    return x\n</SCAN>", False),
        ("<think>\n" + GOOD[0] + "\n</think>\n\nstatus: safe\nc", True),
        ("def f(x):\n    return x\n", False),
        ("function f(a) {\n  return a;\n}", False),
        ("function f(a) {\n  return g(a, \"te", True),
        ("", False),
        (None, False),
        (" \n", False),
        ("Please enable JavaScript to view th", False),  # residue is no cut
    ]
    cases = [("findings", n + i, "trace", None if i % 2 else "feed", t) for i, (t, _) in enumerate(cuts)]
    got = {r["row_id"] for r in U.truncated_texts(spark.createDataFrame(rows + cases, TEXTS)).collect()}
    assert {i for i in range(len(cuts)) if n + i in got} == {i for i, (_, cut) in enumerate(cuts) if cut}
    assert not any(i < n for i in got)
    assert U.truncated_texts(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize(
    "code,cut",
    [
        ("a = one();\nb = two();\nc = three();\nfor (const item of order.par", True),
        ("a = one();\nb = two();\nc = three();\nreturn valu", True),
        ("def f(x):\n    first = g(x)\n    return fir", True),
        ("def f(x):\n    first = g(x)\n    return first", False),
        ("func f() error {\n\tif x {\n\t\ty()\n\t}\n\treturn nil\n}", False),
        ("func f() error {\n\tif x {\n\t\ty()\n\t}\n\treturn nil", False),
        ("a = one();\nb = two();\nc = three();\n}  // todo: drop this once it ships", False),
        ("if (a) {\n  while (b) {\n  c();\n}", False),  # a block's end got lost inside
        ("The value is bound before the call", False),
        ("", False),
    ],
)
def test_code_cut_before_it_was_wrapped(code, cut):
    text = f"<SCAN>\n{code}\n</SCAN>"
    assert (U.look_at_end(text) is not None) == cut


def test_names_in_brackets_are_no_signs():
    assert not any(U.SIGN.search(t) for t in ("a.b(control_margin)", "f(content_id)", "(morellos)", "x(snippets)"))
    assert all(U.SIGN.search(t) for t in ("so (more)", "and [cont.]", "it [truncated]", "a (continued on the next page)", "the <snip>", "b [...]"))


def test_limits_stand_out_from_the_lengths_near_them(spark):
    rows = [("l", f"trace\tfeed\tc\t{size}\t0", n) for size, n in [(200, 30), (199, 3), (198, 3), (140, 6), (141, 6), (142, 7), (139, 5), (138, 6), (300, 4)]]
    rows += [("l", "trace\tfeed\tc\t200\t1", 5), ("l", "trace\tother\tc\t90\t0", 8), ("l", "trace\tother\tc\t90\t1", 9)]
    got = U._limits(spark.createDataFrame(rows, "kind string, key string, n long")).collect()
    assert [(r["source"], r["size"]) for r in got] == [("feed", 200)]


def test_length_evidence(spark):
    rows, n = corpus()
    cut = [("findings", n + i, "trace", "fixed", (GOOD[i % 2] + " " + GOOD[(i + 1) % 2])[: 120 + (i % 3 == 2) * 0]) for i in range(12)]
    lengths = {len(r[4]) for r in cut}
    assert lengths == {120}
    got = {r["row_id"] for r in U.truncated_texts(spark.createDataFrame(rows + cut, TEXTS)).collect()}
    assert got == {r[1] for r in cut}


def test_repeated_rows_and_extra_columns(spark):
    rows, n = corpus()
    twice = [("findings", n, "trace", "feed", GOOD[0][:40])] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + twice], TEXTS + ", verdict string, piece int")
    assert {r["row_id"] for r in U.truncated_texts(df).collect()} == {n}


def test_very_long_text_without_end():
    assert U.look_at_end("word " * 200_000)[0] == "open"
    assert U.look_at_end("x" * 500_000) is not None and segments("y" * 100_000) == ["y" * 100_000]


QUESTION = "Review the snippet.\n<SCAN>\ndef handler(request_name):\n    value = lookup(request_name)\n    audit(value, mode=3)\n    return render(value)\n</SCAN>"


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        (QUESTION, None, "empty"),
        (QUESTION, "  ", "empty"),
        (QUESTION, "<think></think>\nstatus:\ncwe:\nfix:", "empty"),
        (QUESTION, QUESTION, "copy"),
        (QUESTION, QUESTION.upper(), "copy"),
        (QUESTION, "Here is the snippet again:\n```\n" + QUESTION.split("<SCAN>")[1].split("</SCAN>")[0] + "```", "copy"),
        (QUESTION, "I'm sorry, but I can't help with analysing code like this.", "refusal"),
        (QUESTION, "As a language model, my guidelines keep me from commenting on it.", "refusal"),
        (QUESTION, "No puedo ayudar con eso.", "refusal"),
        (QUESTION, "Der Wert von `value` kommt aus der Anfrage und erreicht `render` ohne vorherige Prüfung.\nstatus: confirmed", "other_language"),
        (QUESTION, "Значение `value` приходит из запроса и попадает в `render`.", "other_language"),
        (QUESTION, "参数 `value` 来自请求，没有经过任何检查就到达 `render`。", "other_language"),
        ("Bitte prüfe den folgenden Code.\n<SCAN>\nx = 1\n</SCAN>", "Der Wert von `value` kommt aus der Anfrage und ist nicht geprüft.", None),
        ("Bitte prüfe den folgenden Code auf Deutsch.\n<SCAN>\nx = 1\n</SCAN>", "The value of `value` comes from the request and is not checked.", "other_language"),
        (None, "The value of `value` comes from the request and is not checked.", None),
        (QUESTION, "Sorry wording in the comment aside, `value` cannot influence `render`.", None),
        (QUESTION, "I can't find a path from `value` to `render` that avoids the check.", None),
        (QUESTION, "TBD", None),
        ("Is x safe?", "is  X safe?", "copy"),
        ("Is x safe?", "safe", None),
        (QUESTION, "The lines\n    value = lookup(request_name)\nmatter here. The value of `value` is checked before it is shown, so this is safe.", None),
    ],
)
def test_own_defects(question, answer, defect):
    assert P.own_defect(question, answer) == defect


def test_defective_pairs_one_row_each(spark):
    long_answer = " ".join(GOOD[:2])
    rows = [(i, QUESTION, long_answer, "s", 0) for i in range(40)]
    rows += [(100, QUESTION, None, "s", 1), (101, QUESTION, long_answer[:60], None, 2), (101, QUESTION, long_answer[:60], None, 3), (102, None, "", "s", 4)]
    df = spark.createDataFrame(rows, "record_id long, question string, answer string, source string, defect int")
    assert sorted(map(tuple, P.defective_pairs(df).collect())) == [(100, "empty"), (101, "truncated"), (102, "empty")]
    assert P.defective_pairs(df.limit(0)).count() == 0


def test_code_lines():
    assert all(map(is_code_line, ["    return x", "const a = 1;", "}", "def f(x):", "foo(bar)", "import os", "x = 1"]))
    assert not any(map(is_code_line, ["The value is checked.", "status: safe", "Return the verdict in full sentences.", "{{ verdict }}", ""]))


def test_queries_on_the_small_tables(spark, small):
    found = {tuple(r) for r in QUERIES["p2_found"](spark, small).collect()}
    residue = {tuple(r) for r in QUERIES["p3_found"](spark, small).collect()}
    assert found and residue
    rates = QUERIES["p2_rates"](spark, small).agg({"cut_rows": "sum"}).first()[0]
    assert rates == len(found)
    clean = {tuple(r) for r in QUERIES["p3_clean"](spark, small).collect()}
    assert not clean & residue
    defects = [tuple(r) for r in QUERIES["p4_found"](spark, small).collect()]
    assert len(defects) == len({r for r, _ in defects})
    assert QUERIES["p4_report"](spark, small).where("defect is not null").agg({"pairs": "sum"}).first()[0] == len(defects)


def test_cut_answers_are_told_by_traces_too(spark, tmp_path):
    question, answer = "Review this function.", "The value reaches the query without any sanitiz"
    messages = [[("user", question), ("assistant", answer)], [("user", question), ("assistant", "The value is bound before the call.")]]
    spark.createDataFrame(list(enumerate(messages)), "record_id long, messages array<struct<role string, content string>>").selectExpr("*", "struct('s' as source) as _meta").write.parquet(f"{tmp_path}/pilot_records.parquet")
    traces = [(i, "f", f"The sanitization of value {i} is missing in this place.") for i in range(5)]
    spark.createDataFrame(traces, "finding_id long, source string, trace string").write.parquet(f"{tmp_path}/findings.parquet")
    assert [tuple(r) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()] == [(0, "truncated")]
    assert [tuple(r) for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()] == [("pilot_records", 0)]


@pytest.mark.parametrize("listed", [2, 60])
def test_blocks_of_prose_are_read_whatever_their_length(listed):
    items = [f"- [HIGH] CWE-{79 + i} the value is shown without escaping" for i in range(listed)]
    block = "<SYNTHESIZE>\n" + "\n".join([*items, "Your session has expired. Sign in again."]) + "\n</SYNTHESIZE>"
    found = segments(block)
    assert len(found) == listed + 2 and "Your session has expired." in found
    code = "<SCAN>\n" + "\n".join(["x = read();", "Please enable JavaScript", "y = x;"] * listed) + "\n</SCAN>"
    assert segments(code) == []


def test_monotonous_looks_at_all_words():
    assert R.monotonous("test case " + "test " * 20 + "scene end") and R.monotonous("test test scene test")
    long = " ".join(["aaaaaaaaaaaaaaaaaaaaaaaa"] * 8)  # 200 characters of one word, then an analysis
    assert not R.monotonous(long + " the caller checks each value of this request before any query is built from it")
    assert not R.monotonous("") and not R.monotonous("test test")


def test_residue_of_near_duplicates_is_no_cut_text_and_no_defect(spark, tmp_path):
    seed = "{{ name }} " + " ".join(f"token{i}" for i in range(60))
    near = seed.replace("{{ name }}", "$name$").replace("token7 ", "word7 ")
    spark.createDataFrame([(1, [("user", "Review this function."), ("assistant", near + "\nThe value of this request reaches the query ...")])], "record_id long, messages array<struct<role string, content string>>").selectExpr("*", "struct('s' as source) as _meta").write.parquet(f"{tmp_path}/pilot_records.parquet")
    spark.createDataFrame([(1, "f", seed), (2, "f", "The value of this request reaches the query ...")], "finding_id long, source string, trace string").write.parquet(f"{tmp_path}/findings.parquet")
    assert ("pilot_records", 1) in {tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).collect()}
    assert [tuple(r) for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()] == [("findings", 2)]
    assert QUERIES["p4_found"](spark, str(tmp_path)).collect() == []
