"""Whether two formulas are the same: read by precedence, then tested at random points modulo primes, in Arrow batches.

A formula (LaTeX or plain) has, at each of some random points modulo two primes, a residue; besides, an exact fraction where it is
a rational constant and a double where it is any constant. Equal rational functions agree at every point; others agree by chance at
one point with a probability of degree / 2^62. Nothing is run as code, and what cannot be read is undecided.

Roots: both primes are -1 modulo 8 and modulo 3, 5, ..., 47. So -1 has no square root, 2, 3, ..., 47 have one, and of both roots of a
residue exactly one has a root itself. Taking that one makes roots multiplicative, sqrt(4) equal 2, and sqrt(x^2) differ from x where
x stands for a negative number; roots of odd degree are unique. Points at which a root does not exist are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Four times the product of the primes to 47; the primes are multiples of it, less 1.
STEP = 4 * math.prod([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47])
PRIMES = (STEP - 1, 2 * STEP - 1)
#: Random points modulo each prime, and how many must be left for a decision.
POINTS, ENOUGH = 12, 2
#: Constants may differ by this share.
TOLERANCE = 1e-4
#: Bits of an exact fraction, beyond which residues and doubles alone are kept.
EXACT_BITS = 4096

# Names of functions, letters of other alphabets that are variables, commands that read as signs, and those that say nothing.
FUNCTIONS = ("sqrt", "root", "sin", "cos", "tan", "ln", "log", "exp")
GREEK = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega".split()
SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\pi": "pi", "**": "^", "−": "-", "×": "*", "·": "*", "÷": "/", "\\dfrac": "\\frac", "\\tfrac": "\\frac"}
SILENT = {"\\left", "\\right", "\\,", "\\;", "\\!", "\\:", "\\"}
TOKEN = re.compile(rf"\s*(?:([0-9]+(?:\.[0-9]*)?|\.[0-9]+)|({'|'.join(FUNCTIONS)}|pi)(?![A-Za-z])|(\\[A-Za-z]+|\\[,;!: ])|([A-Za-z](?:_(?:[A-Za-z0-9]|\{{[A-Za-z0-9]+\}}))?)|(\*\*|[-+*/^(){{}}\[\],−×·÷]))")
MIXED = re.compile(r"(?<![0-9.^/])([0-9]+)\s*(?: |\\[dt]?frac(?=\s*\{?[0-9]))\s*(?:([0-9]+)\s*/\s*([0-9]+)|\{([0-9]+)\}\s*\{([0-9]+)\})")
RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3, "^": 4}
POINT_PRIMES = [p for p in PRIMES for _ in range(POINTS)]


class Unreadable(Exception):
    pass


@dataclass
class Value:
    """Residues at the points (None: there is no value), whole residues of it as an exponent (None: not known to be whole), the exact
    fraction and the double of a constant, and whether roots or functions leave a difference open."""

    at: list[int | None]
    whole: list[int] | None = None
    exact: Fraction | None = None
    real: float | None = None
    open: bool = False


def constant(x: Fraction) -> Value:
    at = [x.numerator * pow(x.denominator, -1, p) % p if x.denominator % p else None for p in POINT_PRIMES]
    return Value(at, [x.numerator % (p - 1) for p in POINT_PRIMES] if x.denominator == 1 else None, x, as_real(x))


def as_real(x: Fraction) -> float | None:
    try:
        return float(x)
    except OverflowError:
        return None


def variable(name: str) -> Value:
    """A random point; pi and e are variables with a known double, and i leaves differences open."""
    raw = [int.from_bytes(hashlib.blake2b(f"{name}:{i}".encode(), digest_size=16).digest(), "big") for i in range(len(POINT_PRIMES))]
    known = {"pi": math.pi, "e": math.e}.get(name)
    return Value([r % p for r, p in zip(raw, POINT_PRIMES, strict=True)], None if known else [r % (p - 1) for r, p in zip(raw, POINT_PRIMES, strict=True)], None, known, name == "i")


def made(f, a: Value, b: Value, whole: bool = True) -> Value:
    """f of both, part by part."""
    at = [None if x is None or y is None else f(x, y) % p for x, y, p in zip(a.at, b.at, POINT_PRIMES, strict=True)]
    both = whole and a.whole is not None and b.whole is not None
    exact = f(a.exact, b.exact) if a.exact is not None and b.exact is not None else None
    if exact is not None and exact.numerator.bit_length() + exact.denominator.bit_length() > EXACT_BITS:
        exact = None
    real = f(a.real, b.real) if a.real is not None and b.real is not None else None
    return Value(at, [f(x, y) % (p - 1) for x, y, p in zip(a.whole, b.whole, POINT_PRIMES, strict=True)] if both else None, exact, finite(real), a.open or b.open)


def finite(x: float | complex | None) -> float | None:
    return x if isinstance(x, float) and math.isfinite(x) else None


def inverse(a: Value) -> Value:
    exact = 1 / a.exact if a.exact else None
    return Value([pow(x, -1, p) if x else None for x, p in zip(a.at, POINT_PRIMES, strict=True)], None, exact, 1 / a.real if a.real else None, a.open)


def root(a: Value, degree: int) -> Value:
    """Of the even part of the degree by (p + 1) / 4 again and again, of the odd part by its inverse."""
    twos = (degree & -degree).bit_length() - 1
    odd = degree >> twos

    def at(x: int | None, p: int) -> int | None:
        if x is None or math.gcd(odd, p - 1) > 1 or (twos and x and pow(x, p // 2, p) != 1):
            return None
        return pow(x, pow((p + 1) // 4, twos, p - 1) * pow(odd, -1, p - 1), p)

    real = None
    if a.real is not None and (a.real >= 0 or not twos):
        real = math.copysign(abs(a.real) ** (1 / degree), a.real)
    return Value([at(x, p) for x, p in zip(a.at, POINT_PRIMES, strict=True)], None, None, real, True)


def raised(a: Value, b: Value) -> Value:
    """a ^ b: by an exact fraction (a root, then a whole power), or by whole residues of the exponent (2^n, n a whole number)."""
    real = None
    if a.real is not None and b.real is not None and (a.real or b.real > 0):
        try:
            real = finite(a.real**b.real)
        except OverflowError:
            real = None
    if b.exact is not None:
        n, x = b.exact.numerator, a
        if b.exact.denominator > 1:
            x = root(a, b.exact.denominator)
            real = finite(x.real**n) if real is None and x.real else real
        at = [None if v is None or (not v and n <= 0) else pow(v, n, p) for v, p in zip(x.at, POINT_PRIMES, strict=True)]
        small = x.exact is not None and abs(n) * (x.exact.numerator.bit_length() + x.exact.denominator.bit_length()) <= EXACT_BITS and (x.exact or n > 0)
        whole = [pow(v, n, p - 1) for v, p in zip(x.whole, POINT_PRIMES, strict=True)] if x.whole is not None and n >= 0 else None
        return Value(at, whole, x.exact**n if small else None, real, x.open)
    if b.whole is not None:
        return Value([pow(v, w, p) if v else None for v, w, p in zip(a.at, b.whole, POINT_PRIMES, strict=True)], None, None, real, a.open or b.open)
    return opaque("^", [a, b], real)


def opaque(name: str, args: list[Value], real: float | None) -> Value:
    """A function about which only this is known: equal arguments give equal values."""
    rows = zip(*[a.at for a in args], POINT_PRIMES, strict=True)
    at = [None if None in xs else int.from_bytes(hashlib.blake2b(f"{name}:{xs}".encode(), digest_size=16).digest(), "big") % p for *xs, p in rows]
    return Value(at, None, None, real, True)


def function(name: str, args: list[Value]) -> Value:
    if name == "root":
        degree, a = args
        if degree.exact is None or degree.exact.denominator > 1 or degree.exact < 1:
            raise Unreadable
        return root(a, int(degree.exact))
    (a,) = args
    if name == "sqrt":
        return root(a, 2)
    real = None
    if a.real is not None and name != "log" and (name != "ln" or a.real > 0) and (name != "exp" or a.real < 700):
        real = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "exp": math.exp}[name](a.real)
    return opaque(name, args, real)


def tokens(x: str) -> list[str]:
    """Tokens in plain notation: fractions and roots of LaTeX as brackets with / and names, whatever their depth."""
    if re.fullmatch(r"\s*[A-Za-z]{2,}\s*", x):
        raise Unreadable  # a word
    x = MIXED.sub(lambda m: f"({m[1]}+{m[2] or m[4]}/{m[3] or m[5]})", x.strip())
    out: list[str] = []
    stack: list[tuple[int, str]] = []  # of each open brace: arguments wanted outside it, and its end
    want: list[list[str]] = []  # what follows each argument that is wanted; the last first
    at, letters = 0, 0

    def done() -> None:
        """An argument is whole."""
        out.extend(want.pop())
        if out[-1] == "/":  # a fraction's other side
            begin(["("], [")", ")"])

    def begin(x: list[str], follows: list[str]) -> None:
        out.extend(x)
        want.append(follows)

    while at < len(x):
        m = TOKEN.match(x, at)
        if not m:
            raise Unreadable
        at, t = m.end(), m[0].strip() or m[0]
        t = SIGNS.get(t, t)
        letters = letters + 1 if m[4] and len(t) == 1 and m[0] == t else int(bool(m[4]))
        if letters > 2 or (m[1] and out and re.match(r"[0-9.]", out[-1])):
            raise Unreadable
        if t in SILENT:
            continue
        waits = len(want) > (stack[-1][0] if stack else 0)
        if waits and (t in RANK or t in "(),"):
            raise Unreadable
        if t == "\\frac":
            begin(["(", "("], [")", "/"])
        elif t in ("\\sqrt", "sqrt") and x[at : at + 1] != "(":
            begin(["sqrt", "("], [")"])
        elif t == "[" and want and out[-2:] == ["sqrt", "("] and waits:
            out[-2] = "root"
            stack.append((len(want), "]"))
            out.append("(")
        elif t == "]" and stack and stack[-1][1] == "]":
            stack.pop()
            out.extend([")", ","])
        elif t == "{":
            stack.append((len(want), "}"))
            out.append("(")
        elif t == "}":
            if not stack or stack[-1][1] != "}" or len(want) != stack[-1][0]:
                raise Unreadable
            stack.pop()
            out.append(")")
            close(want, stack, done)
        elif t in ("[", "]"):
            raise Unreadable
        elif t.startswith("\\"):
            if t[1:] not in GREEK and t[1:] not in FUNCTIONS:
                raise Unreadable
            out.append(t[1:] if t[1:] in FUNCTIONS else t)
            if t[1:] in GREEK and waits:
                close(want, stack, done)
        elif m[1] and waits:  # of digits side by side one is the argument
            out.append(t[0])
            at -= len(t) - 1
            close(want, stack, done)
        else:
            out.append(re.sub(r"[{}]", "", t))
            if waits:
                close(want, stack, done)
    if want or stack:
        raise Unreadable
    return out


def close(want: list, stack: list, done) -> None:
    """After a whole argument: every command without braces that ends with it."""
    least = stack[-1][0] if stack else 0
    while len(want) > least:
        n = len(want)
        done()
        if len(want) == n:  # a fraction's other side is wanted now
            return


def value(x: str) -> Value:
    """The value of a formula. ^ goes from the right and before a sign; * may be left out."""
    values: list[Value] = []
    ops: list[str] = []
    commas: list[int] = []
    after = False  # whether an operand ends here

    def apply() -> None:
        op = ops.pop()
        need = 1 if op == "~" else 2
        if len(values) < need:
            raise Unreadable
        b = values.pop()
        if op == "~":
            values.append(made(lambda x, _: -x, b, b))
            return
        a = values.pop()
        values.append(raised(a, b) if op == "^" else made(lambda x, y: x * y, a, inverse(b), False) if op == "/" else made({"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op], a, b))

    def push(op: str) -> None:
        while ops and ops[-1] in RANK and RANK[ops[-1]] >= RANK[op] and op not in ("^", "~"):
            apply()
        ops.append(op)

    for t in tokens(x):
        operand = t not in RANK and t not in "),"
        if operand and after:
            push("*")
        if t in ("+", "-") and not after:
            if t == "-":
                push("~")
            continue
        if t in FUNCTIONS:
            ops.append(t)
            after = False
        elif t == "(":
            ops.append(t)
            commas.append(0)
            after = False
        elif t in "),":
            while ops and ops[-1] in RANK:
                apply()
            if not ops or ops[-1] != "(" or not after:
                raise Unreadable
            if t == ",":
                commas[-1] += 1
                after = False
                continue
            ops.pop()
            n = commas.pop() + 1
            name = ops.pop() if ops and ops[-1] in FUNCTIONS else None
            if n != (2 if name == "root" else 1):
                raise Unreadable
            if name:
                args = values[-n:]
                del values[-n:]
                values.append(function(name, args))
        elif t in RANK:
            if not after:
                raise Unreadable
            push(t)
            after = False
        else:
            if ops and ops[-1] in FUNCTIONS:
                raise Unreadable  # a function's argument is in brackets
            values.append(constant(Fraction(t)) if t[0] in "0123456789." else variable(t))
            after = True
    while ops and ops[-1] in RANK:
        apply()
    if ops or len(values) != 1 or not after:
        raise Unreadable
    return values[0]


def agree(a: Value, b: Value, sign: int = 1) -> bool | None:
    both = [(x - sign * y) % p == 0 for x, y, p in zip(a.at, b.at, POINT_PRIMES, strict=True) if x is not None and y is not None]
    return all(both) if len(both) >= ENOUGH else None


def same_value(a: str, b: str) -> bool | None:
    """same_formula of two strings."""
    sides = a.split("="), b.split("=")
    equations = len(sides[0]) == 2
    if len(sides[0]) != len(sides[1]) or len(sides[0]) > 2:
        return None
    try:
        x, y = (value(f"({s[0]})-({s[1]})" if equations else s[0]) for s in sides)
    except (Unreadable, ZeroDivisionError):
        return None
    same = agree(x, y)
    if same or (equations and agree(x, y, -1)):
        return True
    if x.exact is not None and y.exact is not None and x.exact == y.exact:
        return True
    if not equations and x.real is not None and y.real is not None:
        return abs(x.real - y.real) <= TOLERANCE * max(abs(x.real), abs(y.real))
    return None if x.open or y.open else same


@F.pandas_udf(T.BooleanType())
def _same_formula(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], bool | None] = {}
    for pair in set(zip(a, b, strict=True)):
        known[pair] = None if pair[0] is None or pair[1] is None else same_value(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="object")


def same_formula(a: Column, b: Column) -> Column:
    """True if two formulas, or the differences of the sides of two equations (up to their sign), are the same; false if not; null
    for nulls, and where a formula cannot be read, too few points are left, or roots and functions of variables leave it open.
    Constants are the same if they differ by TOLERANCE at most, as the numbers that answers give are rounded. Each distinct pair of
    a batch is decided once."""
    return _same_formula(a, b)
