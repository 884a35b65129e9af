"""Predicates, extractors and formatters on text columns; null texts give null."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scan import bound as let

# Patterns of boxes, think blocks, code fences, tags and links.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"
THINK = r"(?s)<think>(.*?)</think>"
CODE = r"(?s)```python(.*?)```"
HTML_TAG = r"<(p|span|div|li|html|script)[^>]*?"
URL = r"https?://\S+"
MARKDOWN_URL = r"!?\[[^\]]*\]\(([^)]+)\)"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last(items: Column) -> Column:
    """The last item, or null."""
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


# ---- predicates -----------------------------------------------------------------------------------------------------


def no_boxed(text: Column) -> Column:
    return ~F.contains(text, F.lit("boxed"))


def unescaped_dollars(text: Column) -> Column:
    return count_of(text, "$") - count_of(text, "\\$")


def unpaired_dollars(text: Column) -> Column:
    """An odd number of unescaped dollars; a single one is allowed."""
    n = unescaped_dollars(text)
    return (n % 2 == 1) & (n != 1)


def has_any_of(text: Column, characters: str) -> Column:
    """Whether any of the characters occurs (such as traditional forms, given as data)."""
    return F.length(F.translate(text, characters, "")) < F.length(text)


def traditional_characters(spark: SparkSession) -> str:
    """All traditional Chinese characters of the unified block: those that the session's transliterator writes otherwise."""
    block = [chr(c) for c in range(0x4E00, 0xA000)]
    simple = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(block)).split("\n")
    return "".join(a for a, b in zip(block, simple, strict=True) if a != b)


def low_quality(block: Column, lines: int = 5) -> Column:
    """A code block of few lines that are neither empty nor comments."""
    return F.size(F.filter(F.split(block, "\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))) <= lines


def good_code(blocks: Column, share: float = 0.4) -> Column:
    """No more low-quality blocks than ceil(share * number of blocks)."""
    return F.size(F.filter(blocks, lambda b: low_quality(b))) <= F.ceil(F.size(blocks) * F.lit(share))


def think_block(text: Column, quality: bool = True) -> Column:
    """struct(ok, code_num) of the only think block: not empty, with code (of quality); null where there are several or it is empty."""

    def of(blocks: Column) -> Column:
        code = found(F.get(blocks, F.lit(0)), CODE)
        n = F.coalesce(F.size(code), F.lit(0))
        ok = (n > 0) & (good_code(code) if quality else F.lit(True))
        bad = (F.size(blocks) > 1) | ((F.size(blocks) == 1) & (F.length(F.get(blocks, F.lit(0))) == 0))
        return F.when(~bad, F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.greatest(F.lit(0), n).alias("code_num")))

    return let(found(text, THINK), of)


def answer_tail(text: Column, end: str = "<|im_end|>") -> Column:
    """What follows the first </think> (up to a second one) is not empty and ends with the end mark."""
    return F.coalesce(F.endswith(F.get(F.split(text, "</think>"), F.lit(1)), F.lit(end)), F.lit(False))


def ngrams(text: Column, n: int, piece: int = 256) -> Column:
    """64-bit hashes of the character n-grams at every start but the last, in order of the hash. They are cut from pieces of the
    text, since a place in a string is found by walking to it."""

    def of(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.xxhash64(F.substr(p, i, F.lit(n))))

    size = F.length(text) - n
    pieces = F.transform(F.sequence(F.lit(0), size - 1, F.lit(piece)), lambda i: F.substr(text, i + 1, F.least(F.lit(piece), size - i) + n - 1))
    return F.when(size > 0, F.sort_array(F.flatten(F.transform(pieces, of)))).otherwise(F.array().cast("array<bigint>"))


def max_ngram_count(text: Column, n: int) -> Column:
    """The count of the commonest character n-gram, the last start position left out; 0 if there is none, or for null."""
    start = F.struct(F.lit(0).cast("long").alias("gram"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, g: Column) -> Column:
        run = F.when((a["gram"] == g) & (a["run"] > 0), a["run"] + 1).otherwise(1)
        return let(run, lambda r: F.struct(g.alias("gram"), r.alias("run"), F.greatest(a["best"], r).alias("best")))

    return F.coalesce(F.aggregate(ngrams(text, n), start, step, lambda a: a["best"]), F.lit(0))


def has_ngram_over(text: Column, n: int, most: int) -> Column:
    """Whether a character n-gram occurs more than `most` times; false for null."""
    many = let(ngrams(text, n), lambda g: F.when(F.size(g) > most, F.exists(F.sequence(F.lit(0), F.size(g) - 1 - most), lambda i: F.get(g, i) == F.get(g, i + most))))
    return F.coalesce(many, F.lit(False))


def count_matching(text: Column, kept: str) -> Column:
    """Number of characters of a class (a class without its brackets)."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def mixed_languages(text: Column, least: int = 20) -> Column:
    return (count_matching(text, r"\u4e00-\u9fff") >= least) & (count_matching(text, "a-zA-Z") >= least)


#: Characters that are in order in a response (fixed value).
ORDERLY = r"""[a-zA-Z0-9\s\.,!?"'\(\)\{\}\[\]_\-+=<>/@#$%^&*\\|:;~`\u2200-\u22FF]"""


def garbled(text: Column, most: float = 0.3) -> Column:
    return F.when(F.length(text) == 0, False).otherwise(F.length(F.regexp_replace(text, ORDERLY, "")) / F.length(text) > most)


def unfinished(text: Column) -> Column:
    return ~F.contains(text, F.lit("<|endoftext|>"))


def boxed_near_end(tokens: Column, last_tokens: int = 100) -> Column:
    """A box with content among the last tokens (an array of strings)."""
    tail = F.array_join(F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - last_tokens + 1), F.lit(last_tokens)), "")
    return F.length(F.coalesce(last(found(tail, r"(?s)\\boxed\{(.*)\}")), F.lit(""))) > 0


def unsafe_code(code: Column) -> Column:
    """Code that asks for input or runs a shell: an error without being run (nothing is ever run)."""
    return F.rlike(code, F.lit(r"input\s*\(|os\.system\s*\("))


# ---- extractors -----------------------------------------------------------------------------------------------------


def last_boxed(text: Column) -> Column:
    """Content of the last box, braces nested three deep; null without one."""
    return last(found(text, BOXED))


def balanced(text: Column) -> Column:
    """struct(first, end): places (from 1) of the first opening brace and of the closing one at which as many have closed as
    opened; 0 without. One pass over the braces."""
    braces = found(text, "[{}]", 0)
    steps = let(braces, lambda b: F.zip_with(F.slice(F.split(text, "[{}]"), F.lit(1), F.size(b)), b, lambda gap, x: F.struct(F.length(gap).alias("gap"), (x == "{").alias("opens"))))
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("first"), zero.alias("end"))

    def step(s: Column, x: Column) -> Column:
        at, depth = s["at"] + x["gap"] + 1, s["depth"] + F.when(x["opens"], 1).otherwise(-1)
        first = F.when((s["first"] == 0) & x["opens"], at).otherwise(s["first"])
        end = F.when((s["end"] == 0) & ~x["opens"] & (depth == 0), at).otherwise(s["end"])
        return F.struct(at.alias("at"), depth.alias("depth"), first.alias("first"), end.alias("end"))

    return F.aggregate(steps, start, step)


def from_last(text: Column, mark: str) -> Column:
    """The text from the last mark on; null without one."""
    at = F.locate(mark[::-1], F.reverse(text))
    return F.when(at > 0, F.substr(text, F.length(text) - at - len(mark) + 2))


def from_last_box(text: Column) -> Column:
    return F.coalesce(from_last(text, "\\boxed"), from_last(text, "\\fbox"))


def last_box(text: Column) -> Column:
    """The last box (else framed box) with its command and balanced braces of any depth; null without one or if it is open. Where
    a box command is followed by a blank anywhere, what follows the last such up to a dollar, after that command."""
    spaced = F.concat(F.lit("\\boxed "), F.get(F.split(F.element_at(F.split(text, r"\\boxed "), -1), r"\$"), F.lit(0)))
    cut = let(from_last_box(text), lambda t: let(balanced(t), lambda b: F.when(b["end"] > 0, F.left(t, b["end"]))))
    return F.when(F.contains(text, F.lit("\\boxed ")), spaced).otherwise(cut)


def box_content(box: Column) -> Column:
    """What a box as of last_box holds; null for a framed box."""
    inner = F.when(F.startswith(box, F.lit("\\boxed{")) & F.endswith(box, F.lit("}")), F.substr(box, F.lit(8), F.length(box) - 8))
    return F.when(F.startswith(box, F.lit("\\boxed ")), F.substr(box, F.lit(8))).otherwise(inner)


def last_braced(text: Column) -> Column:
    """The trimmed content of the braces after the last box command (else framed box), balanced at any depth; null without."""
    return let(from_last_box(text), lambda t: let(balanced(t), lambda b: F.when((b["first"] > 0) & (b["end"] > 0), stripped(F.substr(t, b["first"] + 1, b["end"] - b["first"] - 1)))))


def unboxed(text: Column) -> Column:
    """The content of a string that is one box, else null."""
    inner = F.regexp_extract(text, r"(?s)^\\boxed\{(.*)\}$", 1)
    return F.when(F.startswith(text, F.lit("\\boxed{")) & F.endswith(text, F.lit("}")), inner)


def hash_answer(text: Column) -> Column:
    """The number after the first ####, without commas; null without one."""
    x = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
    return F.when(x != "", F.replace(x, F.lit(","), F.lit("")))


def last_number(text: Column) -> Column:
    """The last run of digits, points and commas that is not a point alone; if all are, the first; null without any."""
    all_ = found(text, r"(-?[0-9.,]+)")
    return let(all_, lambda a: F.coalesce(last(F.filter(a, lambda x: ~x.isin("", "."))), F.get(a, F.lit(0))))


def last_program(text: Column, last_only: bool = True) -> Column:
    """Lines between a line that begins or ends with python (fenced or not) and one that begins a fence; '' if it is not closed."""
    start = F.struct(F.lit("").alias("program"), F.lit(False).alias("open"))

    def step(a: Column, line: Column) -> Column:
        opens = F.startswith(line, F.lit("```python")) | F.startswith(line, F.lit("python")) | F.endswith(line, F.lit("python"))
        fresh = F.lit("") if last_only else F.concat(a["program"], F.lit("\n# ========\n"))
        return (
            F.when(opens, F.struct(fresh.alias("program"), F.lit(True).alias("open")))
            .when(F.startswith(line, F.lit("```")), F.struct(a["program"].alias("program"), F.lit(False).alias("open")))
            .when(a["open"], F.struct(F.concat(a["program"], line, F.lit("\n")).alias("program"), F.lit(True).alias("open")))
            .otherwise(a)
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.when(a["open"], "").otherwise(a["program"]))


def has_tool_call(text: Column) -> Column:
    return last_program(text) != ""


def tool_call(text: Column) -> Column:
    """The program of a text's tool call, if it is there and stands unchanged in JSON; else null."""
    program = last_program(text)
    return let(program, lambda p: F.when((p != "") & (F.from_json(F.to_json(F.struct(p.alias("code"))), "code string")["code"] == p), p))


def first_code(text: Column) -> Column:
    return F.regexp_extract(text, CODE, 1)


def all_code(text: Column) -> Column:
    return found(text, CODE)


def through_first_code(text: Column) -> Column:
    """The text up to the end of the first closed block, or all of it."""
    head = F.regexp_extract(text, r"(?s)^(.*?```python.*?```)", 1)
    return F.when(head != "", head).otherwise(text)


def code_of(text: Column) -> Column:
    """Code from triple backticks, else from a JSON field code, else from single backticks, else the text."""
    fenced, field, single = F.regexp_extract(text, r"(?s)```[^\n]*\n(.+?)```", 1), F.get_json_object(text, "$.code"), F.regexp_extract(text, r"(?s)`([^`]+)`", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), field, F.nullif(single, F.lit("")), text)


def before_last(text: Column, mark: str) -> Column:
    """The text before the last mark; null without one."""
    at = F.locate(mark[::-1], F.reverse(text))
    return F.when(at > 0, F.substr(text, F.lit(1), F.length(text) - at - len(mark) + 1))


def without_last_call(text: Column) -> Column:
    """Cut at the last output fence, then at the last python fence before it."""
    head = before_last(text, "```output")
    return F.when(head.isNull(), text).otherwise(F.coalesce(before_last(head, "```python"), before_last(head, "``` python"), head))


def without_tail(tokens: Column, n: int) -> Column:
    """Tokens (of a text cut before its last call) without the last n."""
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - n))


def choice_letter(text: Column) -> Column:
    """The last of A-E as a word, else the trimmed text."""
    t = F.ltrim(F.trim(F.rtrim(F.rtrim(F.trim(text, F.lit("\n")), F.lit(".")), F.lit("/")), F.lit(" ")), F.lit(":"))
    letter = last(found(F.upper(t), r"\b([ABCDE])\b"))
    return F.rtrim(F.rtrim(F.coalesce(letter, F.trim(F.trim(t), F.lit("."))), F.lit(".")), F.lit("/"))


def code_solution(text: Column) -> Column:
    """After the last python fence up to the next fence."""
    return F.get(F.split(F.element_at(F.split(text, "```python"), -1), "```"), F.lit(0))


def urls(text: Column) -> Column:
    return found(text, URL, 0)


def markdown_urls(text: Column) -> Column:
    return found(text, MARKDOWN_URL, 1)


def basename(url: Column) -> Column:
    """The last part of the path, decoded; of a url without one the last part at all."""
    clean = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = F.element_at(F.split(path, "/"), -1)
    fallback = F.element_at(F.split(F.rtrim(clean, F.lit("/")), "/"), -1)
    return F.url_decode(F.coalesce(F.nullif(name, F.lit("")), fallback))


def has_html(text: Column) -> Column:
    return F.rlike(text, F.lit(HTML_TAG))


def file_type(name: Column) -> Column:
    """The extension of the last path part in lower case, or unk."""
    ext = F.lower(F.regexp_extract(basename(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.nullif(ext, F.lit("")), F.lit("unk"))


def is_image(name: Column) -> Column:
    return file_type(name).isin("jpg", "jpeg", "png", "webp", "gif", "bmp")


def is_http(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def has_chinese(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\u4e00-\u9fff]"))


def has_chinese_message(messages: Column, *roles: str) -> Column:
    """Whether a message (role, text) of one of the roles, or of any if none is named, holds Chinese."""
    return F.exists(messages, lambda m: (m["role"].isin(*roles) if roles else F.lit(True)) & F.coalesce(has_chinese(m["text"]), F.lit(False)))


def cut_points(tokens: Column) -> Column:
    """Positions (from 0) of tokens that hold a newline."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(F.contains(t, F.lit("\n")), i)), lambda i: i.isNotNull())


def nearest(points: Column, to: Column) -> Column:
    """The point nearest to a position; of two the earlier."""
    return F.array_min(F.transform(points, lambda p: F.struct(F.abs(p - to).alias("d"), p.alias("p"))))["p"]


#: Markers of an answer (fixed values).
BEFORE_ANSWER = ["answer:", "answer is", "answers are"]
AFTER_ANSWER = ["is answer", "is the answer", "are answers", "are the answers"]
VERBS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def after_last(text: Column, mark: str) -> Column:
    """The trimmed text after the last mark (in any case); null without one."""
    at = F.locate(mark[::-1], F.reverse(F.lower(text)))
    return F.when(at > 0, F.regexp_replace(F.substr(text, F.length(text) - at + 2), r"^\s+|\s+$", ""))


def head_of_last(text: Column, mark: str) -> Column:
    """The trimmed text before the last mark (in any case); null without one."""
    at = F.locate(mark[::-1], F.reverse(F.lower(text)))
    return F.when(at > 0, F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - at - len(mark) + 1), r"^\s+|\s+$", ""))


def cuts() -> list:
    """Steps that each cut what the one before left: markers, the last box, the last sentence's end, verbs; and whether a step
    counts as a match."""
    return (
        [(lambda t, m=m: after_last(t, m), True) for m in BEFORE_ANSWER]
        + [(lambda t, m=m: head_of_last(t, m), True) for m in AFTER_ANSWER]
        + [(lambda t: F.nullif(last_braced(t), F.lit("")), True), (lambda t: head_of_last(t, ". "), False)]
        + [(lambda t, m=m: after_last(t, m), True) for m in VERBS]
    )


def reply(text: Column) -> Column:
    """What all cuts leave."""
    heads = _cut_at(text, [(m, True) for m in BEFORE_ANSWER] + [(m, False) for m in AFTER_ANSWER])
    return _cut_at(_cut(heads, lambda t: F.nullif(last_braced(t), F.lit(""))), [(". ", False)] + [(m, True) for m in VERBS])


def _cut_at(text: Column, marks: list[tuple[str, bool]]) -> Column:
    """Of each mark in turn the text after its last place (or before that), where it has one: one fold, however many marks."""

    def cut(t: Column, mark: Column) -> Column:
        at = F.position(mark["back"], F.reverse(F.lower(t)))
        after, head = F.substr(t, F.length(t) - at + 2), F.substr(t, F.lit(1), F.length(t) - at - F.length(mark["back"]) + 1)
        return F.when(at > 0, F.regexp_replace(F.when(mark["after"], after).otherwise(head), r"^\s+|\s+$", "")).otherwise(t)

    return F.aggregate(F.array(*[F.struct(F.lit(m[::-1]).alias("back"), F.lit(after).alias("after")) for m, after in marks]), text, cut)


def _cut(text: Column, cut) -> Column:
    return let(text, lambda t: F.coalesce(cut(t), t))


def matched_answer(text: Column) -> Column:
    """struct(matched, answer): the reply, and whether a step found its mark and a digit is left."""

    def step(state: Column, cut, counts: bool) -> Column:
        return let(state, lambda s: let(cut(s["t"]), lambda n: F.struct((s["m"] | (n.isNotNull() & counts)).alias("m"), F.coalesce(n, s["t"]).alias("t"))))

    s = F.struct(F.lit(False).alias("m"), text.alias("t"))
    for cut, counts in cuts():
        s = step(s, cut, counts)
    return let(s, lambda x: F.struct((x["m"] & F.rlike(x["t"], F.lit("[0-9]"))).alias("matched"), x["t"].alias("answer")))


#: The line after an answer mark in any case (fixed value).
ANSWER_LINE = r"(?i)Answer\s*:\s*([^\n]+)"
#: A number before words (fixed value).
NUMBER_AND_UNIT = r"^(\d+(\.\d+)?)\s+[a-zA-Z]+(?:\s+[a-zA-Z]+)*$"


def _without_stars(x: Column) -> Column:
    return F.trim(stripped(F.trim(x, F.lit("*"))), F.lit("*"))


def marked_answers(text: Column) -> Column:
    """The last answer line and the last box; empty strings without them."""
    return F.array(*[_without_stars(F.coalesce(c, F.lit(""))) for c in (last(found(text, ANSWER_LINE)), last_boxed(text))])


def candidates(text: Column, once: bool = False) -> Column:
    """Answers that a text may mean: tails of separators, the last answer line, the last box; then of each what follows =, a choice,
    a number before units, what follows set signs. once: each answer once (a text without separators is its own tail three times)."""
    tails = [stripped(F.element_at(F.split(text, "####"), -1)), *[_without_stars(F.element_at(F.split(text, mark), -1)) for mark in ("####\n", "Answer:")]]

    def signs(a: Column) -> Column:
        up = F.upper(a)
        choice = F.lit(None).cast("string")
        for c in "FEDCBA":
            choice = F.when(F.contains(up, F.lit(f"({c})")) | F.contains(up, F.lit(f"{c}:")) | F.contains(up, F.lit(f"{c}. ")), c).otherwise(choice)
        return F.array(F.when(F.contains(a, F.lit("=")), F.element_at(F.split(a, "="), -1)), choice)

    unit = lambda a: F.when(F.rlike(a, F.lit(NUMBER_AND_UNIT)), F.get(F.split(a, " "), F.lit(0)))
    after = lambda a, mark, pattern: F.when(F.contains(a, F.lit(mark)), stripped(F.element_at(F.split(a, pattern), -1)))
    sets = lambda a: F.array(after(a, "\\in", r"\\in"), after(a, "∈", "∈"))
    more = lambda xs: F.concat(F.flatten(F.transform(xs, signs)), F.transform(xs, unit), F.flatten(F.transform(xs, sets)))
    distinct = F.array_distinct if once else (lambda xs: xs)
    return distinct(let(distinct(F.concat(F.array(*tails), marked_answers(text))), lambda xs: F.concat(xs, F.filter(more(xs), lambda x: x.isNotNull()))))


# ---- formats --------------------------------------------------------------------------------------------------------

#: Prompt templates by type, filled in by literal replacement; the last is for any other type.
TEMPLATES = {
    "plain": "[PROMPT]",
    "boxed": "[PROMPT]\nReason step by step and put the final answer into \\boxed{}.",
    "tool": "[PROMPT]\nReason step by step; you may write python blocks, whose output follows them. Put the final answer into \\boxed{}.",
    "direct": "[PROMPT]\nGive the final answer alone.",
    "review": "Question: [question]\nReasoning so far: [long_cot]\nSay where code would help.",
}


def filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"[{k}]"), v)
    return out


def filled_by_type(kind: Column, templates: dict[str, str] = TEMPLATES, **values: Column) -> Column:
    """The template of a row's type; an unknown type raises. For whole chats see rendered_chat."""
    out = F.raise_error(F.concat(F.lit("unknown template "), kind)).cast("string")
    for k, t in templates.items():
        out = F.when(kind == k, filled(t, **values)).otherwise(out)
    return out


def expanded_images(text: Column, counts: Column, pad: str = "<|image_pad|>") -> Column:
    """The i-th <image> replaced by counts[i] pads."""
    parts = F.split(text, "<image>")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p, i: F.concat(F.repeat(F.lit(pad), F.coalesce(F.get(counts, i), F.lit(0))), p))
    return F.concat(parts[0], F.array_join(rest, ""))


def resized(width: Column, height: Column, least: int = 56 * 56, most: int = 2048 * 2048) -> Column:
    """struct(width, height) scaled, aspect kept, into [least, most] pixels."""
    area = width * height
    f = F.when(area > most, F.sqrt(most / area)).when(area < least, F.sqrt(least / area)).otherwise(F.lit(1.0))
    return F.struct((width * f).cast("int").alias("width"), (height * f).cast("int").alias("height"))


def stripped_of(text: Column, pad: str) -> Column:
    return F.replace(text, F.lit(pad), F.lit(""))


def lenient_json(text: Column, schema: str) -> Column:
    """JSON within fences or not, with comments, single quotes and bare names allowed; null if it is none."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.from_json(body, schema, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowComments": "true", "allowNonNumericNumbers": "true"})


def message_text(messages: Column) -> Column:
    """Texts of messages, trimmed and joined."""
    return F.array_join(F.transform(messages, lambda m: F.trim(m["text"])), "\n")


def message_files(messages: Column) -> Column:
    """Files of messages in first-seen order."""
    return F.array_distinct(F.filter(F.transform(messages, lambda m: m["file"]), lambda f: f.isNotNull()))


def rendered_chat(messages: Column, reply: Column | None = None, most: int | None = None) -> Column:
    """Messages (role, text) in order as one text of marked turns, with a reply appended as the assistant's; of at most `most`
    characters, cut on the right."""
    if reply is not None:
        messages = F.concat(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))), F.array(F.struct(F.lit("assistant").alias("role"), reply.alias("text"))))
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["text"])), "\n")
    return text if most is None else F.left(text, F.lit(most))


def last_user_turn(messages: Column) -> Column:
    """Index of the last message of the user; raises without one."""
    at = F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()))
    return F.coalesce(at, F.raise_error(F.lit("no user message")).cast("int"))


def head_and_tail(text: Column, most: int = 400, keep: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit("..."), F.right(text, F.lit(keep)))).otherwise(text)


def middle_cut(text: Column, most: int = 300) -> Column:
    """Texts over `most` characters as their two halves of that length around a note."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit("...(truncated) ..."), F.right(text, F.lit(half)))).otherwise(text)


def regex_runs(text: Column) -> Column:
    """Array of struct(unit, times) of consecutive repeats as a greedy back-reference finds them, left to right (short texts:
    its cost grows with a power of the length)."""
    pattern = r"(.+)\1+"
    return F.zip_with(found(text, pattern, 1), found(text, pattern, 0), lambda u, w: F.struct(u.alias("unit"), F.floor(F.length(w) / F.length(u)).cast("int").alias("times")))
