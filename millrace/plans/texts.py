"""Queries: text predicates, extractors, normal forms, scores, filter chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import latex, normalize, sequence, symbolic, text
from millrace.operators import groups, repetition, scores
from millrace.plans import filters, rollout
from millrace.plans.fixtures import RESP, TOK, query, responses, tokens
from millrace.sources.tables import dealt, table

BOX = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query("SELECT doc_id, CAST(n AS INT) AS dollars, n % 2 = 1 AND n <> 1 AS unpaired FROM (SELECT doc_id, (length(text) - length(replace(text, '$', ''))) - (length(text) - length(replace(text, '\\$', ''))) // 2 AS n FROM documents)")
def dollar_parity(spark, sf):
    return docs(spark, sf).select("doc_id", text.unescaped_dollars(F.col("text")).alias("dollars"), text.unpaired_dollars(F.col("text")).alias("unpaired"))


@query("SELECT doc_id, NOT contains(text, 'boxed') AS no_box, NOT contains(text, '<|endoftext|>') AS unfinished FROM documents")
def no_boxed(spark, sf):
    return docs(spark, sf).select("doc_id", text.no_boxed(F.col("text")).alias("no_box"), text.unfinished(F.col("text")).alias("unfinished"))


@query("SELECT doc_id, length(translate(text, 'éèñß', '')) < length(text) AS has FROM documents")
def marked_characters(spark, sf):
    return docs(spark, sf).select("doc_id", text.has_any_of(F.col("text"), "éèñß").alias("has"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) >= 20 AND length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 20 AS mixed FROM documents")
def mixed_language(spark, sf):
    return docs(spark, sf).select("doc_id", text.mixed_languages(F.col("text")).alias("mixed"))


@query(r"""SELECT doc_id, length(text) > 0 AND CAST(length(regexp_replace(text, '[a-zA-Z0-9\s\.,!?"''\(\)\{\}\[\]_\-+=<>/@#$%^&*\\|:;~`\x{2200}-\x{22FF}]', '', 'g')) AS DOUBLE) / length(text) > 0.05::DOUBLE AS garbled FROM documents""")
def garbled(spark, sf):
    return docs(spark, sf).select("doc_id", text.garbled(F.col("text"), 0.05).alias("garbled"))


@query("""WITH g AS (SELECT doc_id, substr(text, CAST(i AS BIGINT), 20) AS gram, count(*) AS n FROM documents, unnest(range(1, length(text) - 19)) AS r(i) GROUP BY 1, 2)
SELECT doc_id, CAST(coalesce((SELECT max(n) FROM g WHERE g.doc_id = d.doc_id), 0) AS INT) AS n FROM documents d""")
def ngram_repetition(spark, sf):
    return docs(spark, sf).select("doc_id", repetition.ngram_count(F.col("text"), 20).alias("n"))


@query()
def repeat_pattern(spark, sf):
    return dealt(docs(spark, sf)).select("doc_id", repetition.repeats_pattern(F.col("text")).alias("repeats"))


def _runs_sql(times: int, least: int) -> str:
    """Whether a unit stands so often in t: every unit and every start."""
    return f"len(list_filter(range({least}, CAST(length(t) // {times} AS BIGINT) + 1), lambda k: len(list_filter(range(1, length(t) - {times} * k + 2), lambda i: substr(t, i, {times - 1} * k) = substr(t, i + k, {times - 1} * k))) > 0)) > 0"


RUNS = "concat(p_name, repeat(substr(p_name, 1, CAST(p_partkey % 8 + 1 AS INT)), CAST(p_size % 24 AS INT)), p_brand)"


@query(f"SELECT p_partkey, {_runs_sql(20, 1)} AS runs, {_runs_sql(5, 5)} AS pattern FROM (SELECT p_partkey, {RUNS} AS t FROM part)")
def short_runs(spark, sf):
    """Units of 1 to 8 characters up to 23 times in a row, among other text."""
    d = dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")).select("p_partkey", F.expr(RUNS).alias("t"))
    return d.select("p_partkey", repetition.consecutive(F.col("t")).alias("runs"), repetition.repeats_pattern(F.col("t")).alias("pattern"))


@query()
def consecutive_repeat(spark, sf):
    return dealt(docs(spark, sf)).select("doc_id", repetition.consecutive(F.col("text")).alias("repeats"))


CODE_SQL = "regexp_extract_all(regexp_extract(predict, '<think>(.*?)</think>', 1, 's'), '```python(.*?)```', 1, 's')"
OK_SQL = f"len(list_filter({CODE_SQL}, lambda b: len(list_filter(string_split(b, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '#'))) <= 5)) <= ceil(len({CODE_SQL}) * 0.4::DOUBLE)"
THINK_SQL = f"(len({CODE_SQL}) > 0 AND {OK_SQL})"


@query(f"WITH {RESP} SELECT row_id, {THINK_SQL} AS ok, CAST(len({CODE_SQL}) AS INT) AS code_num FROM resp")
def think_block(spark, sf):
    return responses(spark, sf).select("row_id", text.think_block(F.col("predict")).alias("x")).select("row_id", "x.ok", "x.code_num")


ALL_SQL = "regexp_extract_all(predict, '```python(.*?)```', 1, 's')"


@query(f"WITH {RESP} SELECT row_id, len(list_filter({ALL_SQL}, lambda b: len(list_filter(string_split(b, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '#'))) <= 5)) <= ceil(len({ALL_SQL}) * 0.4::DOUBLE) AS good FROM resp")
def code_quality(spark, sf):
    return responses(spark, sf).select("row_id", text.good_code(text.all_code(F.col("predict"))).alias("good"))


@query(f"WITH {RESP} SELECT row_id, coalesce(ends_with(string_split(predict, '</think>')[2], '<|im_end|>'), false) AS ok FROM resp")
def answer_tail(spark, sf):
    return responses(spark, sf).select("row_id", text.answer_tail(F.col("predict")).alias("ok"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= 2990")
def prompt_length(spark, sf):
    return filters.prompts_within(docs(spark, sf), F.length("text"), 3000, "other").select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"WITH {RESP} SELECT row_id, regexp_matches(predict, 'input\\s*\\(|os\\.system\\s*\\(') AS unsafe FROM resp")
def unsafe_code(spark, sf):
    return responses(spark, sf).select("row_id", text.unsafe_code(F.col("predict")).alias("unsafe"))


DOLLARS = "((length(predict) - length(replace(predict, '$', ''))) - (length(predict) - length(replace(predict, concat(chr(92), '$'), ''))) // 2)"
LONGEST = "(SELECT max(n) FROM (SELECT count(*) AS n FROM unnest(range(1, length(predict) - 19)) AS r(i) GROUP BY substr(predict, CAST(i AS BIGINT), 20)))"


@query(f"""WITH {RESP} SELECT row_id, CASE WHEN score <> 1 THEN 'score' WHEN passes <> 1 THEN 'passes' WHEN length(predict) < 60 THEN 'length' WHEN NOT contains(predict, 'boxed') THEN 'boxed'
WHEN {DOLLARS} % 2 = 1 AND {DOLLARS} <> 1 THEN 'dollars' WHEN NOT {THINK_SQL} THEN 'think' WHEN NOT coalesce(ends_with(string_split(predict, '</think>')[2], '<|im_end|>'), false) THEN 'answer' WHEN coalesce({LONGEST}, 0) > 8 THEN 'repetition' END AS reason FROM resp""")
def multistage_filter(spark, sf):
    return filters.with_reason(responses(spark, sf), filters.multistage(least=60, n=20, most=8)).select("row_id", "reason")


@query(f"""WITH {RESP} SELECT row_id, CASE WHEN score <> 1 THEN 'score' WHEN passes <> 1 THEN 'passes' WHEN len({CODE_SQL}) = 0 THEN 'think' WHEN NOT coalesce(ends_with(string_split(predict, '</think>')[2], '<|im_end|>'), false) THEN 'answer'
WHEN coalesce({LONGEST}, 0) > 20 THEN 'repetition' END AS reason FROM resp""")
def acceptance_filter(spark, sf):
    return filters.with_reason(responses(spark, sf), filters.acceptance(n=20, most=20)).select("row_id", "reason")


@query(f"WITH {RESP}, w AS (SELECT row_id, uid, string_split(predict, ' ') AS t FROM resp) SELECT row_id, coalesce(length(regexp_extract(array_to_string(t[-3:], ''), '\\\\boxed\\{{(.*)\\}}', 1, 's')) > 0, false) AS boxed FROM w")
def boxed_near_end(spark, sf):
    return responses(spark, sf).select("row_id", text.boxed_near_end(F.split("predict", " "), 3).alias("boxed"))


CLEAN = "trim(regexp_replace(trim({0}, '*'), '^\\s+|\\s+$', '', 'g'), '*')"
TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def candidates_sql(x: str) -> str:
    """SQL of the candidate answers of a text."""
    line, box = f"coalesce(regexp_extract_all({x}, '(?i)Answer\\s*:\\s*([^\n]+)', 1)[-1], '')", f"coalesce(regexp_extract_all({x}, '{BOX}', 1)[-1], '')"
    tails = [TRIMMED.format(f"string_split({x}, '####')[-1]"), *[CLEAN.format(c) for c in (f"string_split({x}, concat('####', chr(10)))[-1]", f"string_split({x}, 'Answer:')[-1]", line, box)]]
    choice = "CASE " + " ".join(f"WHEN contains(upper(a), '({c})') OR contains(upper(a), '{c}:') OR contains(upper(a), '{c}. ') THEN '{c}'" for c in "ABCDEF") + " END"
    signs = f"[CASE WHEN contains(a, '=') THEN string_split(a, '=')[-1] END, {choice}]"
    unit = r"CASE WHEN regexp_matches(a, '^(\d+(\.\d+)?)\s+[a-zA-Z]+(?:\s+[a-zA-Z]+)*$') THEN string_split(a, ' ')[1] END"
    sets = f"[CASE WHEN contains(a, concat(chr(92), 'in')) THEN {TRIMMED.format("string_split(a, concat(chr(92), 'in'))[-1]")} END, CASE WHEN contains(a, '∈') THEN {TRIMMED.format("string_split(a, '∈')[-1]")} END]"
    more = f"list_concat(flatten(list_transform(xs, lambda a: {signs})), list_concat(list_transform(xs, lambda a: {unit}), flatten(list_transform(xs, lambda a: {sets}))))"
    return f"(SELECT list_concat(xs, list_filter({more}, lambda a: a IS NOT NULL)) FROM (SELECT [{', '.join(tails)}] AS xs))"


# ---- extractors -----------------------------------------------------------------------------------------------------


@query(f"WITH {RESP} SELECT row_id, regexp_extract_all(predict, '{BOX}', 1)[-1] AS box FROM resp")
def last_boxed(spark, sf):
    return responses(spark, sf).select("row_id", text.last_boxed(F.col("predict")).alias("box"))


@query(f"WITH {RESP} SELECT row_id, CASE WHEN starts_with(b, '\\boxed{{') AND ends_with(b, '}}') THEN b[8:-2] END AS inner_ FROM (SELECT row_id, regexp_extract(predict, '\\\\boxed\\{{[^<]*') AS b FROM resp)")
def unboxed(spark, sf):
    return responses(spark, sf).select("row_id", text.unboxed(F.regexp_extract("predict", r"\\boxed\{[^<]*", 0)).alias("inner_"))


@query(f"WITH {RESP} SELECT row_id, replace(nullif(regexp_extract(predict, '#### (-?[0-9.,]+)', 1), ''), ',', '') AS answer FROM resp")
def gsm8k_strict(spark, sf):
    return responses(spark, sf).select("row_id", text.hash_answer(F.col("predict")).alias("answer"))


@query(f"WITH {RESP} SELECT row_id, coalesce(list_filter(regexp_extract_all(predict, '(-?[0-9.,]+)', 1), lambda x: x <> '.' AND x <> '')[-1], regexp_extract_all(predict, '(-?[0-9.,]+)', 1)[1]) AS answer FROM resp")
def gsm8k_flexible(spark, sf):
    return responses(spark, sf).select("row_id", text.last_number(F.col("predict")).alias("answer"))


@query(f"""WITH RECURSIVE {RESP}, x AS (SELECT row_id, string_split(predict, chr(10)) AS ls FROM resp),
f AS (SELECT row_id, ls, 0 AS i, '' AS program, false AS open_ FROM x UNION ALL SELECT row_id, ls, i + 1,
 CASE WHEN o THEN '' WHEN starts_with(l, '```') OR NOT open_ THEN program ELSE concat(program, l, chr(10)) END, CASE WHEN o THEN true WHEN starts_with(l, '```') THEN false ELSE open_ END
 FROM (SELECT *, ls[i + 1] AS l, starts_with(ls[i + 1], '```python') OR starts_with(ls[i + 1], 'python') OR ends_with(ls[i + 1], 'python') AS o FROM f WHERE i < len(ls)))
SELECT row_id, CASE WHEN open_ THEN '' ELSE program END AS program FROM f WHERE i = len(ls)""")
def last_program(spark, sf):
    return responses(spark, sf).select("row_id", text.last_program(F.col("predict")).alias("program"))


@query(f"WITH {RESP} SELECT row_id, regexp_extract(predict, '```python(.*?)```', 1, 's') AS code, CAST(len({ALL_SQL}) AS INT) AS blocks, coalesce(nullif(regexp_extract(predict, '^(.*?```python.*?```)', 1, 's'), ''), predict) AS head FROM resp")
def fenced_code(spark, sf):
    p = F.col("predict")
    return responses(spark, sf).select("row_id", text.first_code(p).alias("code"), F.size(text.all_code(p)).alias("blocks"), text.through_first_code(p).alias("head"))


@query(f"WITH {RESP} SELECT row_id, string_split(string_split(predict, '```python')[-1], '```')[1] AS code FROM resp")
def code_solution(spark, sf):
    return responses(spark, sf).select("row_id", text.code_solution(F.col("predict")).alias("code"))


@query(f"""WITH {RESP}, h AS (SELECT row_id, predict, CASE WHEN contains(predict, '```output') THEN predict[: length(predict) - instr(reverse(predict), reverse('```output')) - 8] END AS head FROM resp)
SELECT row_id, CASE WHEN head IS NULL THEN predict WHEN contains(head, '```python') THEN head[: length(head) - instr(reverse(head), reverse('```python')) - 8] ELSE head END AS cut FROM h""")
def drop_last_call(spark, sf):
    return responses(spark, sf).select("row_id", text.without_last_call(F.col("predict")).alias("cut"))


@query("SELECT page_id, regexp_extract_all(html, 'https?://\\S+') AS urls FROM pages")
def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.urls(F.col("html")).alias("urls"))


@query(r"SELECT page_id, regexp_extract_all(concat('![i](', url, ') and [t](', url, '#x)'), '!?\[[^\]]*\]\(([^)]+)\)', 1) AS urls FROM pages")
def markdown_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.markdown_urls(F.concat(F.lit("![i]("), "url", F.lit(") and [t]("), "url", F.lit("#x)"))).alias("urls"))


PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"
BASE = f"url_decode(coalesce(nullif(string_split({PATH}, '/')[-1], ''), string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/')[-1]))"


@query(f"SELECT page_id, {BASE} AS name, coalesce(nullif(lower(regexp_extract({BASE}, '\\.([A-Za-z0-9]+)$', 1)), ''), 'unk') AS kind FROM pages")
def basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.basename(F.col("url")).alias("name"), text.file_type(F.col("url")).alias("kind"))


@query("SELECT page_id, regexp_matches(html, '<(p|span|div|li|html|script)[^>]*?') AS html_, starts_with(url, 'http://') OR starts_with(url, 'https://') AS http, regexp_matches(html, '[\\x{4e00}-\\x{9fff}]') AS chinese FROM pages")
def html_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.has_html(F.col("html")).alias("html_"), text.is_http(F.col("url")).alias("http"), text.has_chinese(F.col("html")).alias("chinese"))


@query("""WITH p AS (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'the answer is (B).' WHEN 1 THEN ' 12 apples. ' WHEN 2 THEN ':c or d' ELSE '7/' END) AS s FROM part),
t AS (SELECT p_partkey, ltrim(trim(rtrim(rtrim(trim(s, chr(10)), '.'), '/'), ' '), ':') AS t FROM p)
SELECT p_partkey, rtrim(rtrim(coalesce(regexp_extract_all(upper(t), '\\b([ABCDE])\\b', 1)[-1], trim(trim(t), '.')), '.'), '/') AS choice FROM t""")
def choice_letter(spark, sf):
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, "the answer is (B).").when(k == 1, " 12 apples. ").when(k == 2, ":c or d").otherwise("7/")
    return table(spark, sf, "part").select("p_partkey", text.choice_letter(s).alias("choice"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), c AS (SELECT doc_id, list_filter(list_transform(range(0, len(t)), lambda i: CASE WHEN contains(t[i + 1], chr(10)) THEN i END), lambda i: i IS NOT NULL) AS p FROM w) SELECT doc_id, CAST(len(p) AS INT) AS cuts, CAST(list_sort(list_transform(p, lambda i: struct_pack(d := abs(i - 100), p := i)))[1].p AS INT) AS nearest FROM c")
def cut_points(spark, sf):
    p = docs(spark, sf).select("doc_id", text.cut_points(F.split("text", " ")).alias("p"))
    return p.select("doc_id", F.size("p").alias("cuts"), text.nearest(F.col("p"), F.lit(100)).alias("nearest"))


@query(f"WITH {RESP} SELECT row_id, true AS matched, regexp_extract_all(predict, '{BOX}', 1)[-1] AS answer FROM resp")
def match_answer(spark, sf):
    r = responses(spark, sf).select("row_id", text.matched_answer(F.col("predict")).alias("m"))
    return r.select("row_id", "m.matched", "m.answer")


@query(f"WITH {RESP} SELECT row_id, {candidates_sql('predict')} AS answers FROM resp")
def candidate_answers(spark, sf):
    return responses(spark, sf).select("row_id", text.candidates(F.col("predict")).alias("answers"))


# ---- normal forms ---------------------------------------------------------------------------------------------------


def _normal_sql(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in normalize.REPLACED:
        x = f"replace({x}, {q(a)}, {q(b)})"
    for a in normalize.REMOVED:
        x = f"replace({x}, {q(a)}, '')"
    x = rf"regexp_replace({x}, '(\\text\{{)(.*?)(\}})', '\2', 'g')"
    x = rf"regexp_replace({x}, '(\\boxed\{{)(.*)(\}})', '\2', 'g')"
    x = rf"regexp_replace({x}, '(frac)([^{{])(.)', 'frac{{\2}}{{\3}}', 'g')"
    return rf"regexp_replace({x}, '(sqrt)([^{{])', 'sqrt{{\2}}', 'g')"


ANSWERS = """ans AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat(chr(92), 'frac', p_partkey % 10, '3 ', chr(92), 'text{ cm}') WHEN 1 THEN concat('$', p_partkey, '.', p_size, '$') WHEN 2 THEN concat(p_partkey, '/', p_size) WHEN 3 THEN concat(p_partkey * 1.0, '%')
 WHEN 4 THEN concat(chr(92), 'sqrt', p_size % 10, ' degrees') WHEN 5 THEN concat('(', p_partkey, ', ', p_size, ']') WHEN 6 THEN concat('1,', p_partkey % 900 + 100) WHEN 7 THEN concat(chr(92), 'boxed{', chr(92), 'dfrac{1}{', p_size, '}}') ELSE concat('x=', p_size, ' dollars') END AS s FROM part)"""


def answers(spark, sf):
    body = ANSWERS[len("ans AS (SELECT p_partkey, ") : -len(" AS s FROM part)")]
    return table(spark, sf, "part").select("p_partkey", "p_size", F.expr(body.replace("p_partkey * 1.0", "cast(p_partkey * 1.0 AS decimal(12,1))")).alias("s"))


@query(f"WITH {ANSWERS}, n AS (SELECT p_partkey, {_normal_sql('s')} AS s FROM ans) SELECT p_partkey, trim(CASE WHEN regexp_matches(replace(s, ',', ''), '^[0-9]+$') THEN replace(s, ',', '') ELSE s END) AS normal FROM n")
def normalize_answer(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.final_answer(F.col("s")).alias("normal"))


@query(f"WITH {ANSWERS} SELECT p_partkey, round(coalesce(TRY_CAST(replace(s, ',', '') AS DOUBLE), TRY_CAST(regexp_extract(replace(s, ',', ''), '^(.*?)\\\\?%$', 1) AS DOUBLE) / 100), 9) AS n FROM ans")
def parse_digits(spark, sf):
    return answers(spark, sf).select("p_partkey", F.round(normalize.digits(F.col("s")), 9).alias("n"))


@query("SELECT p_partkey, abs(a - b / 100) <= 1e-4 * greatest(abs(a), abs(b / 100)) OR abs(a - b) <= 1e-4 * greatest(abs(a), abs(b)) OR abs(a - b * 100) <= 1e-4 * greatest(abs(a), abs(b * 100)) AS same FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 WHEN p_partkey % 3 = 1 THEN p_size + 1 ELSE p_size END AS DOUBLE) AS b FROM part)")
def numeric_equal(spark, sf):
    k, a = F.col("p_partkey") % 3, F.col("p_size").cast("double")
    b = F.when(k == 0, F.col("p_size") * 100).when(k == 1, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("double")
    return table(spark, sf, "part").select("p_partkey", normalize.same_number(a, b).alias("same"))


@query(rf"WITH {ANSWERS} SELECT p_partkey, regexp_replace(s, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\frac{{\1}}{{\2}}') AS f FROM ans")
def a_slash_b(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.int_fraction(F.col("s")).alias("f"))


@query(rf"WITH {ANSWERS} SELECT p_partkey, regexp_replace(s, '\\sqrt([^{{])', '\\sqrt{{\1}}', 'g') AS roots, string_split(s, '\text{{ ')[1] AS units FROM ans")
def roots_and_units(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.braced_roots(F.col("s")).alias("roots"), normalize.without_right_units(F.col("s")).alias("units"))


@query(f"WITH {ANSWERS} SELECT p_partkey, coalesce(TRY_CAST(trim(s) AS DOUBLE) IS NOT NULL, false) AS number, regexp_matches(s, '^-?[0-9]+.?/0*[1-9][0-9]*.?$') AS fraction FROM ans")
def number_kinds(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.is_number(F.col("s")).alias("number"), normalize.is_fraction(F.col("s")).alias("fraction"))


@query(f"WITH {ANSWERS} SELECT p_partkey, CASE WHEN length(s) > 2 AND regexp_matches(s, '^[(\\[].*[)\\]]$') AND NOT regexp_matches(s[2:-2], '[()\\[\\]]') THEN list_transform(string_split(s[2:-2], ','), lambda x: trim(x)) ELSE [CASE WHEN p_partkey % 9 = 6 THEN replace(s, ',', '') ELSE s END] END AS items FROM ans")
def tuple_items(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.tuple_items(F.col("s")).alias("items"))


@query("SELECT p_partkey, concat(CASE WHEN p_size % 2 = 0 THEN '[' ELSE '(' END, p_partkey, ', 9', CASE WHEN p_size % 3 = 0 THEN ']' ELSE ')' END) AS i FROM part")
def intervals(spark, sf):
    a, b = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    name = F.when(a & b, "Interval").when(a, "Interval.Ropen").when(b, "Interval.Lopen").otherwise("Interval.open")
    return table(spark, sf, "part").select("p_partkey", normalize.intervals(F.concat(name, F.lit("("), F.col("p_partkey"), F.lit(", 9)"))).alias("i"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS base, round(p_size * 3.14::DOUBLE / (p_partkey % 5 + 1), 9) AS pi, concat(chr(92), 'begin{pmatrix}', p_size, chr(92), p_partkey, chr(92), 'end{pmatrix}') AS matrix FROM part")
def base_pi_matrix(spark, sf):
    n, d = F.col("p_size").cast("string"), (F.col("p_partkey") % 5 + 1).cast("string")
    return table(spark, sf, "part").select("p_partkey", normalize.without_base(F.concat(n, F.lit("_8"))).alias("base"), F.round(normalize.pi_value(F.concat(n, F.lit("\\pi/"), d)), 9).alias("pi"), normalize.as_matrix(F.concat(F.lit("{"), n, F.lit(","), F.col("p_partkey"), F.lit("}"))).alias("matrix"))


@query("SELECT p_partkey, len(list_distinct(regexp_extract_all(regexp_replace(p_name, 'sqrt|frac', '', 'g'), '\\pL'))) <= 2 AS ok FROM part")
def may_evaluate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalize.may_evaluate(F.col("p_name")).alias("ok"))


@query(f"""WITH {ANSWERS} SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat(chr(92), 'frac{{', p_partkey % 10, '}}{{3}}') WHEN 2 THEN concat(chr(92), 'frac{{', p_partkey, '}}{{', p_size, '}}') WHEN 4 THEN concat(chr(92), 'sqrt{{', p_size % 10, '}}degrees')
WHEN 5 THEN replace(s, ' ', '') WHEN 7 THEN concat(chr(92), 'boxed{{', chr(92), 'frac{{1}}{{', p_size, '}}}}') WHEN 8 THEN concat(p_size, 'dollars') ELSE s END AS plain FROM (SELECT ans.*, p_size FROM ans JOIN part USING (p_partkey))""")
def plain_latex(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.plain_latex(F.col("s")).alias("plain"))


@query(f"""WITH {ANSWERS} SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat(p_partkey % 10, '/3') WHEN 1 THEN concat(p_partkey, '.', p_size) WHEN 3 THEN concat('', p_partkey) WHEN 4 THEN concat('sqrt(', p_size % 10, ')')
WHEN 6 THEN concat('1', p_partkey % 900 + 100) WHEN 7 THEN concat('1/', p_size) ELSE s END AS form FROM (SELECT ans.*, p_size FROM ans JOIN part USING (p_partkey))""")
def lenient_form(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.lenient(F.col("s")).alias("form"))


SAME = "coalesce(abs(v - w / 100) <= 1e-4 * greatest(abs(v), abs(w / 100)) OR abs(v - w) <= 1e-4 * greatest(abs(v), abs(w)) OR abs(v - w * 100) <= 1e-4 * greatest(abs(v), abs(w * 100)), false)"


@query(f"SELECT p_partkey, {SAME} AS equal FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 2 THEN p_partkey / CAST(p_size AS DOUBLE) WHEN 3 THEN p_partkey / 100.0::DOUBLE WHEN 6 THEN CAST(1000 + p_partkey % 900 + 100 AS DOUBLE) END AS v, CAST(p_size AS DOUBLE) AS w FROM part)")
def math_equal(spark, sf):
    return answers(spark, sf).select("p_partkey", normalize.math_equal_column(F.col("s"), F.col("p_size").cast("string")).alias("equal"))


FORMULAS = """fm AS (SELECT p_partkey, p_size, p_partkey % 5 AS kind, p_partkey % 6 + 1 AS p, p_partkey % 7 + 1 AS q, p_size % 2 AS off, p_size % 3 - 1 AS more FROM part)"""
FORMULA_A = """CASE kind WHEN 0 THEN concat('(x+', p, ')(x+', q, ')') WHEN 1 THEN concat(B, 'frac{x}{', p, '}+', q) WHEN 2 THEN concat(B, 'sqrt{', q * p * p + off, '}') WHEN 3 THEN concat('2^{n+', p, '}') ELSE concat('word', p) END"""
FORMULA_B = """CASE kind WHEN 0 THEN concat('x^2+', p + q + more, 'x+', p * q + off) WHEN 1 THEN concat(B, 'frac{x+', p * q + off, '}{', p, '}') WHEN 2 THEN concat(p, B, 'sqrt', B, 'sqrt{', q * q, '}') WHEN 3 THEN concat(CAST(pow(2, p + off) AS INT), B, 'cdot 2^n') ELSE concat('wrod', p) END"""


@query(f"""WITH {FORMULAS} SELECT p_partkey, CASE kind WHEN 0 THEN more = 0 AND off = 0 WHEN 1 THEN off = 0 WHEN 2 THEN abs(sqrt(q * p * p + off) - p * sqrt(q)) <= 1e-4 * greatest(sqrt(q * p * p + off), p * sqrt(q)) WHEN 3 THEN off = 0 END AS same FROM fm""")
def symbolic_equal(spark, sf):
    """Polynomials, fractions, roots (nested ones on one side), powers; words, which are undecided."""
    d = dealt(table(spark, sf, "part").select("p_partkey", "p_size")).selectExpr("p_partkey", "p_partkey % 5 AS kind", "p_partkey % 6 + 1 AS p", "p_partkey % 7 + 1 AS q", "p_size % 2 AS off", "p_size % 3 - 1 AS more", "chr(92) AS B")
    return d.select("p_partkey", symbolic.same_formula(F.expr(FORMULA_A), F.expr(FORMULA_B)).alias("same"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(repeat('sqrt(', d), p_size, repeat(')', d)) WHEN 1 THEN CASE WHEN d = 0 THEN concat('', p_size) ELSE concat(repeat('(', d - 1), p_size, '/3', repeat(')/3', d - 1)) END
WHEN 2 THEN CASE WHEN d = 0 THEN concat('', p_size) ELSE concat(repeat('1/(', d - 1), '1/', p_size, repeat(')', d - 1)) END ELSE concat(chr(92), 'foo', repeat('a^(x+', d), p_size, repeat(')', d)) END AS t FROM (SELECT *, CAST(p_size % 21 AS INT) AS d FROM part)""")
def deep_latex(spark, sf):
    """Roots, fractions on either side, and exponents nested to depth 20, and a command that is not known."""
    d = dealt(table(spark, sf, "part").select("p_partkey", "p_size")).selectExpr("p_partkey", "p_size", "cast(p_size % 21 AS int) AS d", "chr(92) AS B")
    raw = """CASE p_partkey % 4 WHEN 0 THEN concat(repeat(concat(B, 'sqrt{'), d), p_size, repeat('}', d)) WHEN 1 THEN concat(repeat(concat(B, 'frac{'), d), p_size, repeat('}{3}', d))
    WHEN 2 THEN concat(repeat(concat(B, 'frac{1}{'), d), p_size, repeat('}', d)) ELSE concat(B, 'foo', repeat('a^{x+', d), p_size, repeat('}', d)) END"""
    return d.select("p_partkey", latex.plain_text(F.expr(raw)).alias("t"))


NESTED = "p_partkey % 5 AS kind, p_partkey % 6 + 2 AS i, p_size % 7 + 2 AS j, p_partkey % 11 + 2 AS k, p_size % 2 AS off"
NESTED_A = """CASE kind WHEN 0 THEN concat('((', i, ', ', j, '), [', k, ', (1, x)])') WHEN 1 THEN concat(B, 'begin{pmatrix}', i, '&', j, B, B, k, '&x', B, 'end{pmatrix}') WHEN 2 THEN concat('x = ', i) WHEN 3 THEN concat('(', substr('ABCDE', i % 5 + 1, 1), ')') ELSE concat('(f(', i, ',', j, '), ', k, ')') END"""
NESTED_B = """CASE kind WHEN 0 THEN concat('((', i, '.0,', j + off, '.00),[', k, ',(1.0,X)])') WHEN 1 THEN concat(B, 'begin{pmatrix}', i, '.0&', j, B, B, k + off, '.0&x', B, 'end{pmatrix}') WHEN 2 THEN concat('', i + off, '.0') WHEN 3 THEN substr('ABCDE', (i + off) % 5 + 1, 1) ELSE concat('(f(', i, ',', j, '), ', k + off, '.0)') END"""


@query("SELECT p_partkey, p_size % 2 = 0 AS equal FROM part")
def nested_equal(spark, sf):
    """Nested tuples, matrices, equations, choices, and items with brackets of their own: equal where nothing was added."""
    d = dealt(table(spark, sf, "part").select("p_partkey", "p_size")).selectExpr("p_partkey", *NESTED.split(", "), "chr(92) AS B")
    return d.select("p_partkey", normalize.math_equal_column(F.expr(NESTED_A), F.expr(NESTED_B)).alias("equal"))


def _form_sql(x: str) -> str:
    n = _normal_sql(TRIMMED.format(x))
    return f"(SELECT {TRIMMED.format("CASE WHEN regexp_matches(replace(f, ',', ''), '^[0-9]+$') THEN replace(f, ',', '') ELSE f END")} FROM (SELECT replace({n}, '$', '') AS f))"


@query(f"""WITH {RESP}, c AS (SELECT row_id, {candidates_sql('predict')} AS a, {candidates_sql('truth')} AS b FROM resp), l AS (SELECT row_id, unnest(a) AS a FROM c), r AS (SELECT row_id, unnest(b) AS b FROM c),
x AS (SELECT DISTINCT row_id, {_form_sql('a')} AS f FROM l), y AS (SELECT DISTINCT row_id, {_form_sql('b')} AS f FROM r) SELECT row_id, coalesce(m, false) AS match FROM resp LEFT JOIN (SELECT DISTINCT row_id, true AS m FROM x JOIN y USING (row_id, f) WHERE f <> '') USING (row_id)""")
def exact_match(spark, sf):
    return responses(spark, sf, costly=True).select("row_id", normalize.exact_match(F.col("predict"), F.col("truth")).alias("match"))


# ---- scores ---------------------------------------------------------------------------------------------------------

BOXED_SCORE = f"CASE WHEN regexp_extract_all(predict, '{BOX}', 1)[-1] = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
FORMAT_SCORE = r"CASE WHEN regexp_full_match(predict, '<think>.*</think>.*\\boxed\{.*\}.*', 's') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
HASH_SCORE = "CASE WHEN replace(nullif(regexp_extract(predict, '#### (-?[0-9.,]+)', 1), ''), ',', '') = concat('1', truth) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {RESP} SELECT row_id, {HASH_SCORE} AS score FROM resp")
def gsm8k_score(spark, sf):
    return responses(spark, sf).select("row_id", scores.hash_score(F.col("predict"), F.concat(F.lit("1"), "truth")).alias("score"))


@query(f"WITH {RESP} SELECT row_id, 0.9::DOUBLE * {BOXED_SCORE} + {FORMAT_SCORE} AS score FROM resp")
def geo_score(spark, sf):
    return responses(spark, sf).select("row_id", scores.geometry_score(F.col("predict"), F.col("truth")).alias("score"))


@query(f"WITH {RESP} SELECT row_id, CASE WHEN source = '1-URGENT' THEN {HASH_SCORE} WHEN source IN ('2-HIGH', '3-MEDIUM') THEN 0.9::DOUBLE * {BOXED_SCORE} + {FORMAT_SCORE} ELSE {BOXED_SCORE} END AS score FROM resp")
def score_dispatch(spark, sf):
    own = {"1-URGENT": lambda a, b: scores.hash_score(a, F.concat(F.lit("1"), b)), "2-HIGH": scores.geometry_score, "3-MEDIUM": scores.geometry_score}
    box = lambda a, b: F.when(text.last_boxed(a) == b, 1.0).otherwise(0.0)
    return responses(spark, sf).select("row_id", scores.dispatched(F.col("source"), F.col("predict"), F.col("truth"), box, own).alias("score"))


@query(f"WITH {RESP} SELECT row_id, CASE WHEN regexp_matches(predict, '```python.*?```.*```output.*?```', 's') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM resp")
def code_format(spark, sf):
    return responses(spark, sf).select("row_id", scores.code_format(F.col("predict")).alias("score"))


LONGEST_50 = LONGEST.replace("- 19", "- 49").replace(", 20)", ", 50)")


@query(f"WITH {RESP} SELECT row_id, CASE WHEN coalesce({LONGEST_50}, 0) > 20 THEN 0.0::DOUBLE WHEN regexp_extract_all(predict, '{BOX}', 1)[-1] = truth THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS score FROM resp")
def verifier_score(spark, sf):
    return responses(spark, sf).select("row_id", scores.verified_score(F.col("predict"), F.col("truth"), "v2.wformat").alias("score"))


@query(f"WITH {RESP} SELECT row_id, {BOXED_SCORE} AS score FROM resp")
def boxed_score(spark, sf):
    return responses(spark, sf).select("row_id", scores.boxed_score(F.col("predict"), F.col("truth")).alias("score"))


MATCHED = f"x AS (SELECT row_id, regexp_extract_all(predict, '{BOX}', 1)[-1] AS box, truth, CAST(truth AS DOUBLE) AS w FROM resp), y AS (SELECT *, CASE WHEN box = truth THEN w ELSE 1 / nullif(w, 0) END AS v FROM x)"


@query(f"WITH {RESP}, {MATCHED} SELECT row_id, CASE WHEN {SAME} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM y")
def matched_score(spark, sf):
    return responses(spark, sf, costly=True).select("row_id", scores.matched_score(F.col("predict"), F.col("truth")).alias("score"))


@query(f"WITH {RESP}, {MATCHED} SELECT row_id, {SAME} AS correct, box = truth AS format, box AS answer FROM y")
def matched_triple(spark, sf):
    r = responses(spark, sf, costly=True).select("row_id", scores.matched(F.col("predict"), F.col("truth")).alias("m"))
    return r.select("row_id", "m.*")


@query(f"WITH {RESP} SELECT row_id, CASE WHEN ends_with(predict, truth) THEN 1.0::DOUBLE / length(truth) WHEN regexp_matches(predict, '[0-9]$') THEN CAST(right(predict, 1) AS DOUBLE) ELSE 0.0::DOUBLE END AS score FROM resp")
def safe_scorer(spark, sf):
    def exact(a: str, b: str) -> float:
        return 1.0 / len(b) if a.endswith(b) else int(a[-1])

    return responses(spark, sf).select("row_id", scores.safe(exact)(F.col("predict"), F.col("truth")).alias("score"))


@query(f"WITH {TOK}, g AS (SELECT row_id, min(m) AS all_, avg(CASE WHEN t < 3 THEN CAST(m AS DOUBLE) END) AS share FROM tok GROUP BY 1) SELECT row_id, round(CASE WHEN all_ = 1 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END, 9) AS score FROM g")
def code_pass_share(spark, sf):
    return scores.code_share(tokens(spark, sf), "row_id", "t", "m", 3).select("row_id", F.round("score", 9).alias("score"))


@query(f"WITH {RESP} SELECT row_id, length(predict) % 2 = 0 AS same, row_id % 4 = 0 AS near, row_id % 6 = 0 AS tokens FROM resp")
def output_compare(spark, sf):
    """Blank lines and ends, or another letter; numbers a millionth apart, or more; tokens in another order, or another token."""
    k, t = F.col("row_id"), F.col("truth")
    other = F.concat(F.replace(F.col("predict"), F.lit("\n"), F.lit("\n \n")), F.when(F.length("predict") % 2 == 0, " \n").otherwise("?"))
    number = (t.cast("int") + 1).cast("string")
    near = F.concat(number, F.when(k % 4 == 0, ".0000001").otherwise(".25"))
    pair = F.concat(F.lit("b"), k % 6, F.lit(" a "), t)
    return responses(spark, sf, costly=True).select("row_id", scores.output_matches(F.col("predict"), other).alias("same"), scores.output_matches(number, near).alias("near"), scores.output_matches(F.concat(t, F.lit(" a b0")), pair).alias("tokens"))


RAW = "CASE WHEN passes = 1 THEN predict WHEN row_id % 22 = 0 THEN '  ' ELSE concat('trace', chr(10), 'ValueError: ', truth) END"
LINE = f"CASE WHEN contains({RAW}, 'Error') THEN string_split(regexp_replace({RAW}, '^\\s+|\\s+$', '', 'g'), chr(10))[-1] ELSE {RAW} END"
TRIM = f"regexp_replace({LINE}, '^\\s+|\\s+$', '', 'g')"
FILL = f"CASE WHEN length({TRIM}) = 0 THEN 'timeout_decorator.TimeoutError: ''Timed Out''' ELSE {TRIM} END"


@query(f"WITH {RESP}, f AS (SELECT row_id, passes, {FILL} AS s FROM resp) SELECT row_id, concat(chr(10), '```output', chr(10), CASE WHEN length(s) >= 256 THEN concat(s[:128], '...', s[-128:]) ELSE s END, chr(10), '```', chr(10)) AS text, passes AS passed FROM f")
def observation_post(spark, sf):
    bad = F.when(F.col("row_id") % 22 == 0, "  ").otherwise(F.concat(F.lit("trace\nValueError: "), "truth"))
    o = scores.observation(F.col("predict"), F.when(F.col("passes") == 1, "Done").otherwise(bad))
    return responses(spark, sf).select("row_id", o.alias("o")).select("row_id", "o.text", "o.passed")


@query(f"WITH {RESP} SELECT row_id, CASE WHEN passes = 1 AND truth <> '' THEN 'Done' ELSE 'err' END AS status, CASE WHEN passes = 1 AND truth <> '' THEN truth ELSE '' END AS output FROM resp")
def execution_class(spark, sf):
    c = scores.classified(1 - F.col("passes"), F.col("truth"), F.lit("err"))
    return responses(spark, sf).select("row_id", c.alias("c")).select("row_id", "c.status", "c.output")


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN concat(text[:200], '...', text[-200:]) ELSE text END AS short FROM documents")
def head_and_tail(spark, sf):
    return docs(spark, sf).select("doc_id", text.head_and_tail(F.col("text")).alias("short"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha, replace(text, 'the', '') AS stripped FROM documents")
def text_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha"), text.stripped_of(F.col("text"), "the").alias("stripped"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(p_name, chr(10), 'Reason step by step and put the final answer into ', chr(92), 'boxed{}.') END AS prompt FROM part")
def prompt_templates(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "plain").otherwise("boxed")
    return table(spark, sf, "part").select("p_partkey", text.filled_by_type(kind, PROMPT=F.col("p_name"), question=F.col("p_name"), long_cot=F.col("p_name")).alias("prompt"))


@query("SELECT p_partkey, concat('a', repeat('#', p_size % 3), 'b', repeat('#', p_size % 5), 'c') AS s, CAST(p_size * 10 * CASE WHEN p_size * p_size * 100 > 60000 THEN sqrt(60000 / (p_size * p_size * 100.0)) WHEN p_size * p_size * 100 < 400 THEN sqrt(400 / (p_size * p_size * 100.0)) ELSE 1 END - 0.5 + 1e-9 AS INT) AS w FROM part")
def image_expansion(spark, sf):
    n = F.col("p_size")
    r = text.resized(n * 10, n * 10, 400, 60000)["width"]
    return table(spark, sf, "part").select("p_partkey", text.expanded_images(F.lit("a<image>b<image>c"), F.array(n % 3, n % 5), "#").alias("s"), r.alias("w"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient_json(spark, sf):
    loose = F.concat(F.lit("```json\n"), F.replace("props", F.lit('"k"'), F.lit("k")), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", text.lenient_json(loose, "k bigint")["k"].alias("k"))


@query("WITH m AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS m FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0) SELECT conv_id, array_to_string(list_transform(m, lambda x: trim(x.text)), chr(10)) AS text, CAST(list_max(list_transform(range(0, len(m)), lambda i: CASE WHEN m[i + 1].role = 'user' THEN i END)) AS INT) AS last_user FROM m")
def message_parts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).where(F.exists("m", lambda m: m["role"] == "user"))
    return c.select("conv_id", text.message_text(F.col("m")).alias("text"), text.last_user_turn(F.col("m")).alias("last_user"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(text[:150], '...(truncated) ...', text[-150:]) ELSE text END AS short FROM documents")
def middle_cut(spark, sf):
    return docs(spark, sf).select("doc_id", text.middle_cut(F.col("text")).alias("short"))


@query()
def regex_runs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.regex_runs(F.concat(F.repeat("p_brand", F.lit(2)), "p_name")).alias("runs"))


@query(f"WITH {RESP} SELECT row_id, CASE WHEN regexp_extract(predict, '```[^\n]*\n(.+?)```', 1, 's') <> '' THEN regexp_extract(predict, '```[^\n]*\n(.+?)```', 1, 's') WHEN regexp_extract(predict, '`([^`]+)`', 1, 's') <> '' THEN regexp_extract(predict, '`([^`]+)`', 1, 's') ELSE predict END AS code FROM resp")
def code_of(spark, sf):
    return responses(spark, sf).select("row_id", text.code_of(F.col("predict")).alias("code"))


@query(f"WITH {RESP} SELECT row_id, greatest(0, 300 - length(predict)) AS \"left\", md5(CASE WHEN length(predict) >= 300 THEN concat(predict, ' stop') ELSE predict END) AS h FROM resp")
def early_stop(spark, sf):
    r = responses(spark, sf).select("row_id", F.col("predict").alias("response"), F.length("predict").cast("long").alias("n_tokens"))
    return rollout.with_early_stop(r, 300, " stop").select("row_id", "left", F.md5("response").alias("h"))


@query(f"WITH {RESP}, w AS (SELECT row_id, string_split(predict, ' ') AS t FROM resp WHERE passes = 0) SELECT row_id, CAST(i AS INT) AS attempt, t[: greatest(0, len(t) - i * 3)] AS tokens FROM w, range(1, 3) r(i)")
def retry_backtrack(spark, sf):
    r = responses(spark, sf).select("row_id", (F.col("passes") == 0).alias("failed"), F.split("predict", " ").alias("tokens"))
    return rollout.retries(r, "failed", 2, 3).select("row_id", "attempt", "tokens")


TOOL_OUT = """concat(chr(10), '```output', chr(10), CASE WHEN passes = 1 THEN truth ELSE 'ValueError: bad' END, chr(10), '```', chr(10))"""
TOOL_CALL = """concat('```python', chr(10), 'print(', truth, ')', chr(10), '```')"""


@query(f"""WITH {RESP}, f AS (SELECT *, concat({TOOL_CALL}, {TOOL_OUT}) AS first FROM resp), l AS (SELECT *, predict[length(predict) - instr(reverse(predict), reverse('```python')) - 7:] AS tail FROM f),
c AS (SELECT *, contains(tail[10:], '```') AND regexp_matches(string_split(tail[10:], '```')[1], '\\S') AS calls FROM l)
SELECT row_id, CASE WHEN passes = 0 THEN first WHEN calls THEN concat(first, predict, {TOOL_OUT}, predict, {TOOL_OUT}) ELSE concat(first, predict) END AS response, passes = 0 OR NOT calls AS stop, CASE WHEN passes = 1 AND calls THEN [1, 1, 1] ELSE [CAST(passes AS INT)] END AS passes FROM c""")
def tool_loop(spark, sf):
    """Generations by round from the responses: code in the first, the answer in the second; given results."""
    r = responses(spark, sf)
    make = lambda active, k: active.select("row_id").join(r, "row_id").select("row_id", F.when(F.lit(k) == 0, F.concat(F.lit("```python\nprint("), "truth", F.lit(")\n```"))).otherwise(F.col("predict")).alias("output"))
    run = lambda calls, k: calls.join(r, "row_id").select("row_id", (1 - F.col("passes")).alias("return_code"), F.col("truth").alias("stdout"), F.lit("ValueError: bad").alias("stderr"))
    return rollout.tool_loop(r.select("row_id"), make, run, 3).select("row_id", "response", "stop", "passes")


@query(f"WITH {RESP}, h AS (SELECT *, CASE WHEN contains(predict, '```output') THEN predict[: length(predict) - instr(reverse(predict), reverse('```output')) - 8] END AS head FROM resp), c AS (SELECT *, CASE WHEN head IS NULL THEN predict WHEN contains(head, '```python') THEN head[: length(head) - instr(reverse(head), reverse('```python')) - 8] ELSE head END AS cut FROM h) SELECT row_id, 0 AS copy, 0 AS pass_optim, md5(predict) AS h FROM resp UNION ALL SELECT row_id, CAST(i AS INT), 1, md5(cut) FROM c, range(1, 3) r(i) WHERE passes = 0")
def pass_rate_branch(spark, sf):
    r = responses(spark, sf).withColumnRenamed("predict", "response")
    return rollout.regenerated(r, "passes", 2).select("row_id", "copy", "pass_optim", F.md5("response").alias("h"))


@query(f"WITH {RESP} SELECT row_id, CAST(i AS INT) AS try_id FROM resp, range(3) r(i)")
def sample_tries(spark, sf):
    return rollout.tries(responses(spark, sf).select("row_id"), 3)


# ---- boxes by braces, row flags, messages, more normal forms ---------------------------------------------------------

BOXES = """bx AS (SELECT p_partkey, p_size, p_size % 8 AS d, concat('so ', CASE p_partkey % 5 WHEN 0 THEN concat(chr(92), 'boxed{1} then ', chr(92), 'boxed{') WHEN 1 THEN concat(chr(92), 'fbox{') WHEN 2 THEN concat(chr(92), 'boxed ') WHEN 3 THEN concat(chr(92), 'boxed{') ELSE concat('} ', chr(92), 'boxed{ ') END,
 repeat('{a', CAST(p_size % 8 AS INT)), p_size, repeat('}', CAST(p_size % 8 AS INT)), CASE p_partkey % 5 WHEN 2 THEN '$ more' WHEN 3 THEN ' open' WHEN 4 THEN ' } end' ELSE '} end' END) AS s FROM part)"""
INNER = "concat(repeat('{a', CAST(d AS INT)), p_size, repeat('}', CAST(d AS INT)))"


@query(f"WITH {BOXES} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(chr(92), 'boxed{{', {INNER}, '}}') WHEN 1 THEN concat(chr(92), 'fbox{{', {INNER}, '}}') WHEN 2 THEN concat(chr(92), 'boxed ', {INNER}) WHEN 4 THEN concat(chr(92), 'boxed{{ ', {INNER}, ' }}') END AS box, CASE p_partkey % 5 WHEN 4 THEN concat(' ', {INNER}, ' ') WHEN 0 THEN {INNER} WHEN 2 THEN {INNER} END AS content, CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN {INNER} WHEN p_partkey % 5 = 2 AND d > 0 THEN substr({INNER}, 2, length({INNER}) - 2) END AS braced FROM bx")
def braced_box(spark, sf):
    body = BOXES[len("bx AS (SELECT p_partkey, p_size, p_size % 8 AS d, ") : -len(" AS s FROM part)")]
    b = table(spark, sf, "part").select("p_partkey", F.expr(body).alias("s"))
    return b.select("p_partkey", text.last_box(F.col("s")).alias("box"), text.box_content(text.last_box(F.col("s"))).alias("content"), text.last_braced(F.col("s")).alias("braced"))


@query(f"WITH {RESP} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN concat('print(', truth, ')', chr(10)) END AS call FROM resp")
def tool_call(spark, sf):
    t = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("so\n```python\nprint("), "truth", F.lit(")\n```"))).otherwise(F.concat(F.lit("```python\nprint("), "truth"))
    return responses(spark, sf).select("row_id", text.tool_call(t).alias("call"))


@query(f"WITH {RESP}, w AS (SELECT *, string_split(predict, ' ') AS t, row_id % 13 = 0 AS optim FROM resp) SELECT row_id, CASE WHEN CASE WHEN optim THEN contains(right(predict, 200), '```') ELSE passes = 1 AND len(t) > 15 AND coalesce(length(regexp_extract(array_to_string(t[-3:], ''), '\\\\boxed\\{{(.*)\\}}', 1, 's')) > 0, false) END THEN 1 ELSE 0 END AS flag FROM w")
def row_flags(spark, sf):
    tokens_ = F.split("predict", " ")
    flag = groups.row_flag(F.col("passes"), F.size(tokens_), text.boxed_near_end(tokens_, 3), F.col("predict"), F.when(F.col("row_id") % 13 == 0, 1).otherwise(0), 15)
    return responses(spark, sf).select("row_id", flag.alias("flag"))


@query(f"WITH {RESP} SELECT uid FROM resp GROUP BY uid HAVING max(CASE WHEN score = 1 THEN 1 ELSE 0 END) = 0")
def skipped_batches(spark, sf):
    return groups.skipped(responses(spark, sf), "score", "uid")


@query("WITH m AS (SELECT conv_id, list(concat('<|', role, '|>', text) ORDER BY turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, left(array_to_string(list_append(m, '<|assistant|>done'), chr(10)), 500) AS chat, bool_or(role = 'user' AND regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')) AS chinese FROM m JOIN conversations USING (conv_id) GROUP BY conv_id, m")
def chat_append(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", text.rendered_chat(F.col("m"), F.lit("done"), 500).alias("chat"), text.has_chinese_message(F.col("m"), "user").alias("chinese"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN -2 WHEN p_partkey % 4 = 1 THEN -1 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS result FROM part")
def output_codes(spark, sf):
    k = F.col("p_partkey") % 4
    error = F.when(k == 0, "compile").when(k == 1, "run")
    out = F.concat("p_name", F.lit("\n\n"), F.col("p_size"), F.lit(" "))
    want = F.concat("p_name", F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("none")))
    return table(spark, sf, "part").select("p_partkey", scores.output_result(out, want, error).alias("result"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [0.25::DOUBLE] ELSE [0.0::DOUBLE, CASE WHEN p_partkey % 3 = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 0.0::DOUBLE] END AS rewards FROM part")
def given_rewards(spark, sf):
    k = F.col("p_partkey") % 3
    r = scores.sparse_reward(F.lit(0.5), F.lit(2), F.lit(3), F.when(k == 0, F.array(F.lit(0.25))), F.lit(1), F.when(k == 1, 1).otherwise(0))
    return table(spark, sf, "part").select("p_partkey", r.alias("rewards"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), c AS (SELECT doc_id, t, list_filter(list_transform(range(0, len(t)), lambda i: CASE WHEN contains(t[i + 1], chr(10)) THEN i END), lambda i: i IS NOT NULL) AS p FROM w), s AS (SELECT doc_id, t, p, unnest(range(0, len(t), 150)) AS s FROM c), e AS (SELECT doc_id, s, coalesce((SELECT min(struct_pack(d := abs(c - least(s + 200, len(t))), c := c)) FROM (SELECT unnest(p) AS c)).c, least(s + 200, len(t))) - s AS n FROM s) SELECT doc_id, coalesce(list(CAST(n AS INT) ORDER BY s) FILTER (n >= 64), []) AS sizes FROM e GROUP BY doc_id")
def snapped_windows(spark, sf):
    d = docs(spark, sf).select("doc_id", F.split("text", " ").alias("t"))
    w = sequence.snapped_windows(F.col("t"), text.cut_points(F.col("t")), 200, 150, 64)
    return d.select("doc_id", F.transform(w, F.size).alias("sizes"))


@query("SELECT p_partkey, concat(p_size, CASE WHEN p_size % 2 = 0 THEN ' x' ELSE '' END) AS form FROM part")
def unwrapped_forms(spark, sf):
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    inside = F.concat(n, F.when(F.col("p_size") % 2 == 0, " x").otherwise(""))
    raw = F.when(kind == 0, F.concat(F.lit("\\textbf{"), inside, F.lit("}"))).when(kind == 1, F.concat(F.lit("\\overline{"), inside, F.lit("}"))).otherwise(F.concat(F.lit(" \\text{"), inside, F.lit("} ")))
    normal = F.when(kind == 2, normalize.unwrapped_text(raw)).otherwise(F.regexp_replace(normalize.final_answer(raw), "x$", " x"))
    return table(spark, sf, "part").select("p_partkey", normal.alias("form"))


@query(f"""WITH {ANSWERS} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, '') ELSE 'x/y' END AS plain FROM ans JOIN part USING (p_partkey)""")
def plain_answers(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\\text{ "), F.col("p_size"), F.lit(" }"))).otherwise("x/y")
    return table(spark, sf, "part").select("p_partkey", normalize.plain_answer(raw).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, p_partkey % 900 + 100, p_partkey % 800 + 100) ELSE concat(p_size, ',', p_partkey % 90 + 10) END AS n, p_partkey % 2 = 0 AS whole FROM part")
def thousands_commas(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat_ws(",", "p_size", k % 900 + 100, k % 800 + 100)).otherwise(F.concat_ws(",", "p_size", k % 90 + 10))
    return table(spark, sf, "part").select("p_partkey", normalize.without_thousands_commas(raw).alias("n"), normalize.is_whole(raw).alias("whole"))


@query("SELECT p_partkey, p_size % 3 = 0 AS traditional FROM part")
def traditional_text(spark, sf):
    t = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "漢字").otherwise("汉字中文"))
    return table(spark, sf, "part").select("p_partkey", text.has_any_of(t, text.traditional_characters(spark)).alias("traditional"))


@query("SELECT page_id, regexp_matches(lower(url), '\\.(jpg|jpeg|png|webp|gif|bmp)$') AS image FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)")
def image_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.is_image(F.col("url")).alias("image"))


@query("WITH f AS (SELECT conv_id, CAST(turn % 3 AS VARCHAR) AS f, min(turn) AS t FROM conversations WHERE role <> 'system' GROUP BY 1, 2) SELECT conv_id, coalesce(list(f ORDER BY t) FILTER (f IS NOT NULL), []) AS files FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id")
def message_files(spark, sf):
    file = F.when(F.col("role") != "system", (F.col("turn") % 3).cast("string"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", file.alias("file")))).alias("m"))
    return c.select("conv_id", text.message_files(F.col("m")).alias("files"))


@query("SELECT p_partkey, [struct_pack(unit := repeat('ab', CAST(m // 2 AS INT)), times := CAST(CASE WHEN m = 3 THEN 3 ELSE 2 END AS INT))] AS runs, false AS many FROM (SELECT p_partkey, p_size % 5 + 2 AS m FROM part)")
def longest_runs(spark, sf):
    t = F.concat(F.lit("x\n"), F.repeat(F.lit("ab"), F.col("p_size") % 5 + 2), F.lit("<ret>-z"))
    r = dealt(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", repetition.consecutive_runs(t).alias("runs"))
    return r.select("p_partkey", "runs", repetition.too_many(F.col("runs")).alias("many"))
