import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import latex, normalize, symbolic, text
from millrace.operators import groups, repetition, scores
from millrace.plans import filters, fixtures
from millrace.plans import texts as texts_plans


def one(spark, column, *values, kinds=None):
    kinds = kinds or ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(column.alias("out")).first().out


c0, c1 = F.col("c0"), F.col("c1")


@pytest.mark.parametrize(("t", "n", "bad"), [("$a$ $b", 3, True), ("$", 1, False), ("\\$a", 0, False), ("", 0, False), ("$$", 2, False)])
def test_dollars(spark, t, n, bad):
    assert one(spark, text.unescaped_dollars(c0), t) == n and one(spark, text.unpaired_dollars(c0), t) == bad


def block(lines):
    return "```python\n" + "print(1)\n" * lines + "```"


@pytest.mark.parametrize(
    ("t", "want"),
    [(f"<think>{block(2)}{block(2)}</think>", (False, 2)), (f"<think>{block(2)}</think>", (True, 1)), ("<think>x</think>", (False, 0)), ("none", (False, 0)), ("<think></think>", None), ("<think>a</think><think>b</think>", None), (f"<think>{block(9)}{block(2)}</think>", (True, 2))],
)
def test_think_blocks(spark, t, want):
    got = one(spark, text.think_block(c0), t)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("t", "ok"), [("</think>x<|im_end|>", True), ("</think>x", False), ("x<|im_end|>", False), ("</think>a</think>x<|im_end|>", False), ("</think><|im_end|>", True)])
def test_answer_tail(spark, t, ok):
    assert one(spark, text.answer_tail(c0), t) == ok


@pytest.mark.parametrize(("t", "n", "want"), [("ababab", 2, 2), ("", 2, 0), ("ab", 2, 0), ("aaaa", 1, 3)])
def test_ngrams(spark, t, n, want):
    assert repetition.most_repeated(t, n) == want == one(spark, text.max_ngram_count(c0, n), t)


def test_runs():
    assert repetition.has_runs("go" * 20) and not repetition.has_runs("go" * 19) and repetition.has_runs(None) is None and not repetition.has_runs("")
    assert repetition.has_runs("x" + "word " * 3000) and not repetition.has_runs("".join(str(i) for i in range(3000)))
    assert repetition.has_runs("start " + "ab\n<ret>" * 20) and repetition.has_runs("long unit of text " * 20 + "end")


@given(st.text("ab", max_size=70), st.integers(2, 5))
def test_runs_against_all_substrings(t, times):
    want = any(t[i : i + k] * times == t[i : i + k * times] for k in range(1, len(t) // times + 1) for i in range(len(t) - k * times + 1))
    assert repetition.has_runs(t, times) == want


@pytest.mark.parametrize(
    ("t", "want"),
    [("\\boxed{1} \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("none", None), ("\\boxed{}", ""), ("\\boxed{a{b{c}d}e}", "a{b{c}d}e"), ("\\boxed{open", None)],
)
def test_last_box(spark, t, want):
    assert one(spark, text.last_boxed(c0), t) == want


@pytest.mark.parametrize(("t", "strict", "flexible"), [("#### 1,234", "1234", "1,234"), ("is 3 . 12.", None, "12."), ("no", None, None), ("a . b", None, "."), ("#### -5 #### 6", "-5", "6")])
def test_numbers(spark, t, strict, flexible):
    assert one(spark, text.hash_answer(c0), t) == strict and one(spark, text.last_number(c0), t) == flexible


@pytest.mark.parametrize(
    ("t", "want"),
    [("a\n```python\nx = 1\n```\nb", "x = 1\n"), ("```python\nx", ""), ("python\ny\n```", "y\n"), ("```python\na\n```\n```python\nb\n```", "b\n"), ("say ```python\nz\n```", "z\n"), ("", "")],
)
def test_last_program(spark, t, want):
    assert one(spark, text.last_program(c0), t) == want


def test_other_extractors(spark):
    assert one(spark, text.without_last_call(c0), "a```python\n1```\n```output\n2") == "a"
    assert one(spark, text.without_last_call(c0), "a```output") == "a" and one(spark, text.without_last_call(c0), "abc") == "abc"
    assert one(spark, text.choice_letter(c0), "The answer is (B).") == "B" and one(spark, text.choice_letter(c0), " 12. ") == "12"
    assert one(spark, text.basename(c0), "https://a.com/x/y%20z.PDF?q#f") == "y z.PDF" and one(spark, text.file_type(c0), "https://a.com/x.PDF") == "pdf"
    assert one(spark, text.basename(c0), "https://a.com/") == "a.com"
    assert tuple(one(spark, text.matched_answer(c0), "So the answer is x = 42. Done")) == (True, "42")
    assert tuple(one(spark, text.matched_answer(c0), "nothing here"))[0] is False
    assert one(spark, text.candidates(c0), "x #### 5 apples")[0] == "5 apples"
    assert one(spark, text.head_and_tail(c0), "a" * 401) == "a" * 200 + "..." + "a" * 200
    assert one(spark, text.code_of(c0), '{"code": "x"}') == "x" and one(spark, text.code_of(c0), "use `y` now") == "y"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("\\frac12", "\\frac{1}{2}"), ("  $5$ ", "5"), ("1,000", "1000"), ("\\sqrt3", "\\sqrt{3}"), ("\\text{cm}", ""), ("\\(x\\)", "x"), ("\\dfrac{3}{4}\\%", "\\frac{3}{4}\\"), ("12 dollars", "12"), ("(1, 2)", "(1,2)")],
)
def test_final_answers(spark, raw, want):
    assert one(spark, normalize.final_answer(c0), raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"), ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("1/2", "\\frac{1}{2}"), ("k=7", "7"), ("\\sqrt3", "\\sqrt{3}"), ("5\\text{ cm}", "5"), ("a\\text{ b}\\text{ c}", None), ("x/y", None), ("1/02", "1/02"), ("", "")],
)
def test_plain_latex(spark, raw, want):
    assert one(spark, normalize.plain_latex(c0), raw) == want


def test_digits_and_numbers(spark):
    assert one(spark, normalize.digits(c0), "1,234.5") == 1234.5 and one(spark, normalize.digits(c0), "50\\%") == 0.5 and one(spark, normalize.digits(c0), "x") is None
    assert one(spark, normalize.same_number(F.lit(0.5), F.lit(50.0)), "") and not one(spark, normalize.same_number(F.lit(0.5), F.lit(0.51)), "")
    assert one(spark, normalize.int_fraction(c0), "-3/4") == "\\frac{-3}{4}" and one(spark, normalize.int_fraction(c0), "x/y") == "x/y"
    assert one(spark, normalize.int_fraction_strict(c0), "x/y") is None and one(spark, normalize.int_fraction_strict(c0), "3/4") == "\\frac{3}{4}"
    assert one(spark, normalize.tuple_items(c0), "(1,000, 2]") == ["1000", "2"] and one(spark, normalize.tuple_items(c0), "((1),2)") == ["((1),2)"] and one(spark, normalize.tuple_items(c0), "") == []
    assert one(spark, normalize.lenient(c0), "\\text{Five meters}") == "five " and one(spark, normalize.lenient(c0), "3.0 cm") == "3"
    assert one(spark, normalize.pi_value(c0), "2\\pi/4") == 1.57 and one(spark, normalize.pi_value(c0), "__import__") is None
    assert one(spark, normalize.may_evaluate(c0), "x+y") and not one(spark, normalize.may_evaluate(c0), "x+y+z") and not one(spark, normalize.may_evaluate(c0), "x^{2}")
    assert one(spark, normalize.is_whole(c0), "1,000") and not one(spark, normalize.is_whole(c0), "1.5") and not one(spark, normalize.is_whole(c0), "x")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("1/2", "0.5", True), ("50%", "0.5", True), ("(1, 2)", "(1.0,2)", True), ("(1,2)", "(1,3)", False), ("x=3", "3", True), ("B.", "B", True), ("\\frac{1}{2}", "0.5", True), ("abc", "ABC", True), ("x", "y", False), ("{1}", "1", False), ("x=y", "x=y ", True),
     ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "\\begin{pmatrix}1.0\\\\2\\end{pmatrix}", True), (None, None, True), (None, "1", False), ("", "1", False), ("((1,2),3)", "((1.0,2),3)", True), ("((1,2),3)", "((1,3),3)", False), ("((1,2),3)", "(1,2,3)", False), ("[(1,[2,(3)]),4]", "[(1.0,[2,(3.0)]),4]", True), ("((1),2)", "(1,(2))", True), ("((1),2)", "(1,(3))", False),
     ("(\\frac{1}{2}, f(1,2))", "(0.5, f(1,2))", True), ("(1)+(2)", "(1.0)+(2)", False), ("(1,(2)", "(1,(2.0)", False), ("(" * 60 + "1,2" + ")" * 60, "(" * 60 + "1.0,2" + ")" * 60, True), ("1,200", "1200", True), (" x ", "X", True)],
)
def test_math_equal(spark, a, b, same):
    assert one(spark, normalize.math_equal_column(c0, c1), a, b) == same
    assert one(spark, normalize.math_equal_column(c0, c1, symbolic=lambda x, y: F.concat(x, y) == "pq"), "p", "q")


def test_equivalence(spark):
    assert one(spark, normalize.equivalent(c0, c1), "0.5", "1/2") and not one(spark, normalize.equivalent(c0, c1), "x/y", "x / y")
    assert one(spark, normalize.equivalent(c0, c1), None, None) and not one(spark, normalize.equivalent(c0, c1), None, "1")


def test_scores(spark):
    assert one(spark, scores.hash_score(c0, c1), "#### 1,234", "1234") == 1 and one(spark, scores.hash_score(c0, c1), "1234", "1234") == 0
    assert one(spark, scores.hash_score(c0, c1, "flexible", 0.1), "is 5", "6") == 0.1
    assert one(spark, scores.geometry_score(c0, c1), "<think>a</think>\\boxed{5}", "5") == 1.0 and one(spark, scores.geometry_score(c0, c1), "\\boxed{5}", "5") == 0.9
    for kind, t, want in (("default", "\\boxed{1/2}", 1), ("default", "\\boxed{3}", 0), ("v2.wformat", "\\boxed{3}", -0.5), ("v2.wformat", "3", 0), ("default", "ab" * 99 + "\\boxed{0.5}", 0)):
        assert one(spark, scores.verified_score(c0, c1, kind), t, "0.5") == want
    assert one(spark, scores.matched_score(c0, c1), "the answer is 0.5", "1/2") == 1
    with pytest.raises(ValueError, match="has a scorer"):
        scores.register("openai/gsm8k", scores.hash_score)
    assert one(spark, scores.dispatched(F.lit("openai/gsm8k"), c0, c1, lambda a, b: F.lit(9.0)), "#### 2", "2") == 1
    assert one(spark, scores.dispatched(F.lit("other"), c0, c1, lambda a, b: F.lit(9.0)), "#### 2", "2") == 9


@pytest.mark.parametrize(("out", "status", "text_", "passed"), [("4", "Done", "4", 1), ("", "a\nValueError: b\n", "ValueError: b", 0), ("", " ", "timeout_decorator.TimeoutError: 'Timed Out'", 0), ("x" * 300, "Done", "x" * 128 + "..." + "x" * 128, 1)])
def test_observations(spark, out, status, text_, passed):
    got = one(spark, scores.observation(c0, c1), out, status)
    assert tuple(got) == (f"\n```output\n{text_}\n```\n", passed)


def test_passes_and_outputs(spark):
    for xs, want in (([1, 0], 0), ([1, 1], 1), ([], 1)):
        assert one(spark, scores.pass_fraction(F.col("c0")), xs, kinds="c0 array<int>") == want
    for a, b, same in (("1 2\n", "1 2", True), ("a\n\nb", "a\nb", True), ("1.0000001", "1", True), ("b a", "a b", True), ("a", "b", False), ("1", "2", False)):
        assert one(spark, scores.output_matches(c0, c1), a, b) == same


def test_reasons_name_the_first_stage(spark):
    good = f"<think>{'x' * 3000}" + block(9) + "</think>the \\boxed{5}<|im_end|>"
    rows = [(good, 1, 1), (good, 0, 1), (good, 1, 0), (good[3000:], 1, 1), (good.replace("boxed", "box"), 1, 1), (good + "$ $ $", 1, 1), (good.replace("<think>", ""), 1, 1), (good[:-3], 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "predict string, score int, passes int")
    got = [r.reason for r in filters.with_reason(df, filters.multistage(most=10_000)).collect()]
    assert got == [None, "score", "passes", "length", "boxed", "dollars", "think", "answer", "length"]
    assert [r.code_num for r in filters.kept(df, filters.multistage(most=10_000)).collect()] == [1]
    assert [r.reason for r in filters.with_reason(df.limit(1), filters.multistage()).collect()] == ["repetition"]


@pytest.mark.parametrize(
    ("t", "box", "content", "braced"),
    [
        ("\\boxed{a{b{c{d{e}}}}}", "\\boxed{a{b{c{d{e}}}}}", "a{b{c{d{e}}}}", "a{b{c{d{e}}}}"), ("x \\boxed 12$ more", "\\boxed 12", "12", None), ("\\fbox{9} x", "\\fbox{9}", None, "9"), ("\\boxed{open", None, None, None), ("no", None, None, None),
        ("\\boxed{1} \\boxed{ 2 } {3}", "\\boxed{ 2 }", " 2 ", "2"), ("} \\boxed{z}", "\\boxed{z}", "z", "z"), ("\\boxed}{x}", None, None, None), ("", None, None, None), (None, None, None, None), ("\\boxed{" + "{" * 300 + "x" + "}" * 301, "\\boxed{" + "{" * 300 + "x" + "}" * 301, "{" * 300 + "x" + "}" * 300, "{" * 300 + "x" + "}" * 300),
    ],
)
def test_boxes_by_braces(spark, t, box, content, braced):
    got = spark.createDataFrame([(t,)], "c0 string").select(text.last_box(c0), text.box_content(text.last_box(c0)), text.last_braced(c0)).first()
    assert tuple(got) == (box, content, braced)


def test_ngram_counts_of_any_length(spark):
    ts = ["abé" * k + "x" * (k % 7) for k in (0, 1, 2, 6, 7, 85, 86, 92, 200)] + [None]
    df = spark.createDataFrame(list(enumerate(ts)), "i int, t string")
    for n in (1, 5, 20):
        got = {r.i: (r.c, r.d, r.o) for r in df.select("i", repetition.ngram_count(F.col("t"), n).alias("c"), text.max_ngram_count(F.col("t"), n).alias("d"), repetition.repeats(F.col("t"), n, 3).alias("o")).collect()}
        assert got == {i: (repetition.most_repeated(t, n), repetition.most_repeated(t, n), repetition.most_repeated(t, n) > 3) for i, t in enumerate(ts)}


def test_budgets_of_steps_and_long_texts(spark):
    slow = "".join(random.Random(1).choices([chr(c) for c in range(0x4E00, 0x9000)], k=40_000))
    df = spark.createDataFrame([("go" * 30,), ("clean",), (slow,), (None,)], "c0 string")
    got = [tuple(r.x) for r in df.select(repetition.consecutive(c0, steps=5000).alias("x")).collect()]
    assert got == [(True, False), (False, False), (True, True), (None, False)] and repetition.steps_of(40_000) > 5000
    began = time.time()
    assert repetition.has_runs("a" * 1_000_000) and not repetition.has_runs(slow * 5) and repetition.longest_runs("a" * 200_000) == [("a" * 100_000, 2)]
    assert time.time() - began < 60


@given(st.text("abc", max_size=60), st.integers(2, 5), st.integers(1, 4))
def test_runs_against_brute_force(t, times, least):
    want = any(t[i : i + (times - 1) * k] == t[i + k : i + times * k] for k in range(least, len(t) // times + 1) for i in range(len(t) - times * k + 1))
    assert repetition._has_runs(t, times, least) == want


def test_scorers_time_limit(spark):
    def endless(a, b):
        while a == "loop":
            pass
        return 1.0

    df = spark.createDataFrame([("loop", "x"), ("ok", "x")], "c0 string, c1 string")
    assert [r.s for r in df.select(scores.safe(endless, 0.3)(c0, c1).alias("s")).collect()] == [0.0, 1.0]


def test_messages_flags_and_results(spark):
    m = spark.createDataFrame([([("user", "hi"), ("assistant", "汉")],)], "m array<struct<role:string,text:string>>")
    got = m.select(text.has_chinese_message(F.col("m")).alias("a"), text.has_chinese_message(F.col("m"), "user").alias("b"), text.rendered_chat(F.col("m"), F.lit("yes"), 12).alias("c"), text.rendered_chat(F.col("m")).alias("d")).first()
    assert tuple(got) == (True, False, "<|user|>hi\n<", "<|user|>hi\n<|assistant|>汉")
    assert one(spark, scores.output_result(c0, c1, F.lit("run")), "1", "1") == -1 and one(spark, scores.output_result(c0, c1, F.lit("compile")), "1", "1") == -2
    assert one(spark, text.without_tail(F.split(c0, " "), 2), "a b c") == ["a"] and one(spark, text.without_tail(F.split(c0, " "), 5), "a b") == []
    assert one(spark, text.tool_call(c0), "```python\nx\n```") == "x\n" and one(spark, text.tool_call(c0), "none") is None
    flag = lambda p, n, b, t, o: one(spark, groups.row_flag(F.lit(p), F.lit(n), F.lit(b), c0, F.lit(o)), t)
    assert [flag(1, 151, True, "x", 0), flag(0, 151, True, "x", 0), flag(1, 150, True, "x", 0), flag(1, 151, False, "x", 0), flag(0, 1, False, "``` " + "x" * 100, 1), flag(1, 999, True, "```" + "x" * 300, 1)] == [1, 0, 0, 0, 1, 0]


def test_filters_run_no_python(spark):
    df = spark.createDataFrame([("a", 1, 1)], "predict string, score int, passes int")
    for stages in (filters.multistage(), filters.acceptance()):
        assert "Python" not in filters.with_reason(df, stages)._jdf.queryExecution().executedPlan().toString()
    both = spark.createDataFrame([("a", "b")], "a string, b string")
    for f, more in ((scores.boxed_score, {}), (scores.matched_score, {}), (scores.verified_score, {"symbolic": None}), (normalize.math_equal_column, {})):
        assert "Python" not in both.select(f(F.col("a"), F.col("b"), **more))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("raw", "want"), [("\\frac12 \\text{ cm}", "1/2"), ("\\sqrt{2\\pi}", "sqrt(2pi)"), ("\\frac{\\sqrt{3}}{2}", "sqrt(3)/2"), ("3\\frac{1}{2}", "3+1/2"), ("5 million", "5 *10^6"), ("(1, 2]", "(1, 2]")])
def test_lenient_forms(spark, raw, want):
    assert one(spark, normalize.lenient(c0), raw) == want


def nested(kind, depth, core):
    return ("\\sqrt{" if kind == "root" else "\\frac{") * depth + core + ("}" if kind == "root" else "}{3}") * depth


def test_latex_of_any_depth_as_text(spark):
    for d in (1, 4, 150):
        assert one(spark, latex.plain_text(c0), nested("root", d, "2")) == "sqrt(" * d + "2" + ")" * d
        assert one(spark, latex.plain_text(c0), nested("fraction", d, "2")) == "(" * (d - 1) + "2/3" + ")/3" * (d - 1)
    assert not one(spark, scores.graded(c0, c1), nested("root", 4, "2"), nested("root", 3, "2"))
    rows = [("\\frac\\sqrt{2}3", "sqrt(2)/3"), ("\\sqrt\\sqrt2", "sqrt(sqrt(2))"), ("\\sqrt[3]{\\frac12}", "root(3,1/2)"), ("\\foo{x}+\\bar", "\\foox+\\bar"), ("x^{n+1}_{2}", "x^(n+1)_2"), ("1\\frac{a+b}{c}", "1 (a+b)/c"), ("a}b{c", "abc"), ("\\{1,2\\}", "{1,2}"), ("", ""), (None, None), ("{\\frac1}", "1/")]
    for raw, want in rows:
        assert one(spark, latex.plain_text(c0), raw) == want, raw


def test_formulas(spark):
    same = [("x^2+x", "x+x^2"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("\\sqrt{8}", "2\\sqrt2"), ("x^{3/2}", "x\\sqrt{x}"), ("\\sqrt[3]{x^3}", "x"), ("2^{n+1}", "2\\cdot 2^n"), ("2x+y=3", "3-y=2x"), ("1\\frac{1}{2}", "3/2"), ("\\sqrt{12}", "3.4641"), ("2^3^2", "512"), ("\\sin(x+1)", "\\sin(1+x)"), ("e^{x+1}", "e*e^x"), ("0.1+0.2", "0.3"), ("(" * 2000 + "x" + ")" * 2000, "x")]
    other = [("x", "y"), ("x^2", "x^3"), ("-x^2", "(-x)^2"), ("1/3", "0.34"), ("y=x", "y=2x"), ("x^2+x", "x^2-x"), ("\\sqrt{\\sqrt{\\sqrt{\\sqrt{2}}}}", "\\sqrt{\\sqrt{\\sqrt{2}}}"), ("ab+1", "a+b")]
    undecided = [("\\sqrt{x^2}", "x"), ("Monday", "Mondya"), ("no", "on"), ("2 3", "6"), ("(1+2", "3"), ("1)+(2", "3"), ("", ""), ("x+", "x"), ("1/0", "1/0"), ("\\sin x", "\\sin x "), ("x=1", "1"), ("(1,2)", "(1,2)"), ("__import__('os')", "0"), ("\\log(x)", "\\ln(x)"), ("\\frac{}{}", "1"), ("0^0", "1"), (None, "1")]
    cases = [(a, b, w) for w, rows in ((True, same), (False, other), (None, undecided)) for a, b in rows]
    df = spark.createDataFrame(cases, "c0 string, c1 string, want boolean").repartition(3)
    for r in df.select("*", symbolic.same_formula(c0, c1).alias("got"), symbolic.same_formula(c1, c0).alias("back")).collect():
        assert (r.got, r.back) == (r.want, r.want), r
    assert one(spark, scores.graded(c0, c1), "x^2+x", "x(1+x)") and not one(spark, scores.graded(c0, c1, None), "x^2+x", "x(1+x)")
    assert one(spark, scores.verified_score(c0, c1), "so \\boxed{x^2+x}", "x(x+1)") == 1 and one(spark, scores.verified_score(c0, c1), "so \\boxed{x^2-x}", "x(x+1)") == 0
    rows = spark.createDataFrame([("so \\boxed{x^2+x}", "x(x+1)", 1), ("the answer is x^2-x", "x(x+1)", 2), (None, "x", 3)], "r string, t string, m_ int")
    assert [x.matched.correct for x in scores.with_matched(rows, "r", "t").orderBy("m_").collect()] == [True, False, False]


@given(st.integers(-9, 9), st.integers(-9, 9), st.integers(-9, 9), st.integers(1, 9))
def test_formulas_against_arithmetic(a, b, c, d):
    assert symbolic.same_value(f"(x+{a})(x-({b}))*{d}", f"{d}x^2+{d * (a - b)}x+{-d * a * b}".replace("+-", "-"))
    assert symbolic.same_value(f"\\frac{{x}}{{{d}}}+{c}", f"\\frac{{x+({c * d})}}{{{d}}}")
    assert symbolic.same_value(f"x+{a}", f"x+{b}") is (a == b)


def test_graded_answers(spark):
    for a, b, same in (("2\\pi", "6.28", True), ("2\\pi", "6.2831853", True), ("2\\pi", "6.1", False), ("\\text{ 7 }", "7", True), ("1/2", "0.5", True)):
        assert one(spark, scores.graded(c0, c1), a, b) == same


@given(st.text("ab", max_size=24))
def test_longest_runs_against_all_units(t):
    want, i = [], 0
    while i < len(t):
        k = next((k for k in range((len(t) - i) // 2, 0, -1) if t[i : i + k] == t[i + k : i + 2 * k]), 0)
        times = 1
        while k and t[i + times * k : i + (times + 1) * k] == t[i : i + k]:
            times += 1
        if k:
            want.append((t[i : i + k], times))
        i += k * times if k else 1
    assert repetition.longest_runs(t) == want


def test_exact_match_tries_each_answer_once_and_as_before(spark):
    texts = [None, "", "5", "answer is $x=5$", "so \\boxed{5} or 6", "Answer: *5*", "(A) or B. x", "12 cm", "#### 7\n", "####\n7", "\\boxed{1,000}", "plain words " * 30]
    pairs = [(a, b) for a in texts for b in texts]
    forms = lambda t: F.array_distinct(F.filter(F.transform(text.candidates(t), normalize.final_answer), lambda a: a != ""))
    df = spark.createDataFrame(pairs, "c0 string, c1 string").select("c0", "c1", normalize.exact_match(c0, c1).alias("got"), F.arrays_overlap(forms(c0), forms(c1)).alias("want"), text.candidates(c0, once=True).alias("once"), text.candidates(c0).alias("all"))
    for r in df.collect():
        assert r.got == r.want and r.once == list(dict.fromkeys(r.all)), r


def test_costly_rows_are_dealt_over_the_cluster(spark, tmp_path):
    spark.range(60_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = texts_plans.exact_match(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == 60_000


@pytest.mark.parametrize("name", ["longest_runs", "short_runs", "deep_latex", "nested_equal", "symbolic_equal", "output_compare", "matched_score", "matched_triple", "repeat_pattern", "consecutive_repeat"])
def test_costly_queries_do_not_hang_on_one_file(spark, tmp_path, name):
    spark.range(50_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50_000).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "cast(id % 50 AS int) AS p_size", "'Brand' AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert fixtures.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_choices_without_a_letter_are_unequal(spark):
    assert one(spark, normalize.math_equal_column(c0, c1), "12", "B") is False and one(spark, normalize.math_equal_column(c0, c1), "(b)", "B") is True
    assert one(spark, scores.matched_score(c0, c1), "the answer is 12", "B") == 0


@given(st.text("ab", max_size=150), st.integers(2, 6), st.integers(1, 6))
def test_short_texts_by_letters_and_by_arrays_agree(t, times, least):
    by_letters, was = repetition._has_runs(t, times, least), repetition.longest_runs(t)
    short, repetition.SHORT = repetition.SHORT, -1
    try:
        assert repetition._has_runs(t, times, least) == by_letters and repetition.longest_runs(t) == was
    finally:
        repetition.SHORT = short
