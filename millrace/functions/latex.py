"""LaTeX of answers as plain text, by a stack machine over tokens: one fold, linear in the braces' depth and of no bounded depth."""

from __future__ import annotations

from pyspark.sql import Column

from millrace.functions.scan import applied, bound_sql, quoted, scanned_sql

# What commands read as, and commands whose argument is read as it is.
AS_TEXT = [("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/")]
FRACTIONS, PLAIN_ARGUMENT = ("\\frac", "\\tfrac", "\\dfrac"), ("\\text", "\\mathrm", "\\mathbf", "\\textbf", "\\mbox", "\\operatorname", "\\boxed")
SILENT = ("\\left", "\\right", "\\,", "\\;", "\\!", "\\:", "\\ ", "\\quad")
# Brackets of the machine's own around arguments, until it is known whether these need any.
OPEN, CLOSE = "", ""


def _any(words: tuple[str, ...]) -> str:
    return ", ".join(map(quoted, words))


def plain_text(x: Column) -> Column:
    """LaTeX as plain text: fractions as " a/b", roots as sqrt(a) and root(n,a), some signs, text as it is. Arguments, exponents and
    indices that are no single name or number are put in brackets; the braces of any other group go. Commands that are not known stay. Nesting may be of any depth; null for null.

    The stack is a string, a character a level: what closes there. f, d: both sides of a fraction; q: a root; i, r: a root's
    index and what follows it; t: text; p: an exponent or index; g: any other group. In capitals: an argument without braces
    that is a command itself and ends with that command's arguments. want: what the next token (t) is the argument of.
    """
    state = lambda stack, want, out: f"named_struct('stack', {stack}, 'want', {want}, 'out', {out})"
    opened = lambda kind: f"CASE WHEN {kind} IN ('f', 'd', 'p') THEN '{OPEN}' WHEN {kind} = 'q' THEN 'sqrt(' ELSE '' END"

    def done(stack: str, out: str) -> str:
        """After a whole argument: arguments without braces that end with it."""
        ends = f"replace(translate(reverse(tail), 'QRDPT', ')){CLOSE}{CLOSE}'), 'F', '{CLOSE}/')"
        after = state(f"left({stack}, length({stack}) - length(tail))", "CASE WHEN tail LIKE 'F%' THEN 'd' ELSE '' END", f"concat({out}, {ends})")
        return bound_sql(f"regexp_extract({stack}, 'F?[QRDTP]*$', 0)", "tail", after)

    top, popped, before = "right(s.stack, 1)", "left(s.stack, length(s.stack) - 1)", f"CASE WHEN s.want = '' THEN '' ELSE {opened('s.want')} END"
    nested = "CASE WHEN s.want = '' THEN s.stack ELSE concat(s.stack, upper(s.want)) END"
    autos, kind = "regexp_extract(s.stack, '[A-Z]*$', 0)", "CASE WHEN s.want = '' THEN 'g' ELSE s.want END"
    read = f"CASE {' '.join(f'WHEN t = {quoted(a)} THEN {quoted(b)}' for a, b in AS_TEXT)} WHEN t RLIKE '^\\\\\\\\[{{}}%$&#_]$' THEN right(t, 1) ELSE t END"
    ends = f"CASE WHEN {top} IN ('q', 'r') THEN ')' WHEN {top} IN ('d', 'p') THEN '{CLOSE}' ELSE '' END"
    bare = f"CASE s.want WHEN 'p' THEN {read} WHEN 't' THEN {read} WHEN 'r' THEN concat({read}, ')') WHEN 'q' THEN concat('sqrt(', {read}, ')') ELSE concat('{OPEN}', {read}, '{CLOSE}') END"
    unclosed = state(f"left(s.stack, length(s.stack) - length({autos}) - 1)", "''", f"concat(translate(reverse({autos}), 'QRDPFT', ')){CLOSE}{CLOSE}{CLOSE}'), '{CLOSE}')")
    step = f"""CASE WHEN t = '}}' AND {autos} <> '' THEN {unclosed}
        WHEN t = '{{' THEN {state(f"concat(s.stack, {kind})", "''", opened(f"({kind})"))}
        WHEN t = '}}' AND {top} = 'f' THEN {state(popped, "'d'", f"'{CLOSE}/'")}
        WHEN t = '}}' AND {top} IN ('', 'i') THEN {state("s.stack", "''", "''")}
        WHEN t = '}}' THEN {done(f"({popped})", f"({ends})")}
        WHEN t = '[' AND s.want = 'q' THEN {state("concat(s.stack, 'i')", "''", "'root('")}
        WHEN t = ']' AND {top} = 'i' THEN {state(popped, "'r'", "','")}
        WHEN t IN ({_any(FRACTIONS)}) THEN {state(nested, "'f'", f"concat({before}, ' ')")}
        WHEN t = {quoted(chr(92) + "sqrt")} THEN {state(nested, "'q'", before)}
        WHEN t IN ({_any(PLAIN_ARGUMENT)}) THEN {state(nested, "'t'", before)}
        WHEN t IN ({_any(SILENT)}) OR (s.want <> '' AND trim(t) = '') THEN {state("s.stack", "s.want", "''")}
        WHEN t IN ('^', '_') AND s.want IN ('', 'p') THEN {state("s.stack", "'p'", "t")}
        WHEN t = '(' AND s.want = 'q' THEN {state("s.stack", "''", "'sqrt('")}
        WHEN s.want = '' AND length(t) > 1 THEN {done("s.stack", f"({read})")}
        WHEN s.want = '' THEN {state("s.stack", "''", "t")}
        WHEN s.want = 'f' THEN {state("s.stack", "'d'", f"concat({bare}, '/')")}
        ELSE {done("s.stack", f"({bare})")} END"""
    tokens = "regexp_extract_all(x_, '(?s)\\\\\\\\[A-Za-z]+|\\\\\\\\.|.', 0)"
    out = f"array_join({scanned_sql(tokens, state("''", "''", "''"), step, 's.out', 'string')}, '')"
    out = f"translate(regexp_replace({out}, '{OPEN}(-?[^{OPEN}{CLOSE}+*/^ -]*){CLOSE}', '$1'), '{OPEN}{CLOSE}', '()')"
    out = f"regexp_replace({out}, '(root[(][^,()]*,) +', '$1')"
    return applied(x, "x_", f"regexp_replace(replace({out}, '( ', '('), '^\\\\s+|\\\\s+$', '')")
