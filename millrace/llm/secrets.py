"""Secret scans with DataFrame and SQL functions only.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, every long token is put to a battery of
tests of the hypothesis that it is drawn evenly from the alphabet of its inferred encoding: chi-squared uniformity, runs
above and below the alphabet's middle, serial correlation. Its combined p-values are nearly even for random tokens (of 20 to
64 symbols of any alphabet 2 to 3 % lie under 0.01, 7 to 8 % under 0.05, 43 to 48 % under 1/2) and near 0 for most words, so
that in each class of encoding and length the share of false discoveries above a threshold can be told, and the threshold is
set where that share is small enough. Each distinct token is one observation. A class of few is pooled with those of
neighbouring lengths; if all lengths of an encoding are few, its threshold is fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scan import bound as bound_column
from millrace.functions.scan import scanned
from millrace.llm._base import Workspace, rows_of, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets by encoding; a token has the first whose symbols it keeps to.
ALPHABETS = [
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: Letters of one case: mostly long words.
WORDLIKE = ("lower", "upper")
#: Thresholds that are tried, and the share of false discoveries allowed.
EDGES = [1e-4, 3e-4, 1e-3, 3e-3, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
HALF = EDGES.index(0.5)
FALSE_SHARE = 0.05
#: Fewer distinct tokens of an encoding tell nothing of the share; their threshold is this p, or that one for letters of one case.
FEW, FEW_EDGE, FEW_WORDLIKE = 20, 0.01, 0.2
#: Standard errors by which the number of a class's random tokens is taken to exceed its estimate, if most of them are random; to
#: fall short of it for letters of one case, if not; else the estimate itself is taken.
ERRORS = 2
#: Characters of the pieces in which a text is redacted.
PIECE = 1024
SPANS = "array<struct<kind:int,start:int,end:int>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def places(text: Column, pattern: str, found: str) -> Column:
    """(start, end) in code points of each match in the array column `found`: the lengths of what lies between matches and of matches, added up."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(between, F.col(found), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n")))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["end"] + x["gap"]).alias("start"), (s["end"] + x["gap"] + x["n"]).alias("end"))
    return F.when(F.size(found) > 0, scanned(steps, zero, step, lambda s: s, "struct<start:int,end:int>")).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def bound(value: str, name: str, body: str) -> str:
    """SQL of body with a value under a name, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def tail(z: str) -> str:
    """Upper tail of the normal distribution (logistic approximation, error under 2e-4)."""
    return f"(1 / (1 + exp(least(700D, 1.5976D * ({z}) + 0.070565992D * pow({z}, 3)))))"


def battery(codes: str, k: str) -> str:
    """SQL of the combined p-value (Fisher's method) of an array of symbol numbers 0 ... k-1, n of them, n > 2."""
    n = f"cast(size({codes}) AS double)"
    squares = f"aggregate(array_distinct({codes}), 0D, (s, x) -> s + pow(size(filter({codes}, y -> y = x)), 2D))"
    chi = f"(({k} / {n}) * {squares} - {n}) / ({k} - 1)"
    uniform = f"((pow(greatest(0D, {chi}), 1D / 3) - (1 - 2D / (9 * ({k} - 1)))) / sqrt(2D / (9 * ({k} - 1))))"
    follow = f"sequence(1, size({codes}) - 1)"
    changes = f"aggregate({follow}, 0D, (s, i) -> s + CASE WHEN (2 * {codes}[i] < {k}) = (2 * {codes}[i - 1] < {k}) THEN 0D ELSE 1D END)"
    runs = f"abs({changes} - ({n} - 1) / 2) / (sqrt({n} - 1) / 2)"
    product = f"aggregate({follow}, 0D, (s, i) -> s + ({codes}[i] - ({k} - 1) / 2) * ({codes}[i - 1] - ({k} - 1) / 2))"
    serial = f"abs({product} / (({k} * {k} - 1) / 12)) / sqrt({n} - 1)"
    ps = [bound(uniform, "z", tail("z")), bound(runs, "z", f"2 * {tail('z')}"), bound(serial, "z", f"2 * {tail('z')}")]
    half = "-(" + " + ".join(f"ln(greatest(1e-290D, least(1D, {p})))" for p in ps) + ")"
    return bound(half, "v", "exp(-v) * (1 + v + v * v / 2)")


def tested(tokens: str, at: str) -> Column:
    """Of each token (with its place in the array column `at`) start, end, hash, encoding number, length class and p."""
    kinds = "CASE " + " ".join(f"WHEN translate(t, '{a}', '') = '' THEN {i}" for i, (_, a) in enumerate(ALPHABETS)) + f" ELSE {len(ALPHABETS) - 1} END"
    names = "array(" + ", ".join(f"'{a}'" for _, a in ALPHABETS) + ")"
    p = bound(f"{names}[e]", "alpha", bound("transform(split(t, ''), c -> instr(alpha, c) - 1)", "codes", battery("codes", "cast(length(alpha) AS double)")))
    row = f"struct(x.p.start AS start, x.p.end AS end, xxhash64(t) AS token, e AS encoding, cast(floor(2 * log2(length(t))) AS int) AS length_class, {p} AS p)"
    each = bound("rtrim('=', x.t)", "t", bound(kinds, "e", row))
    return F.expr(f"transform(zip_with({tokens}, {at}, (t, p) -> struct(t, p)), x -> {each})")


def spans_of(kind: int, at: Column) -> Column:
    return F.transform(at, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def found_in(docs: DataFrame, text: str) -> DataFrame:
    """row (the columns of docs as a struct, whatever their names), base (spans of the base kinds) and candidates (tested tokens)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    some = t.contains("=") | t.contains(":")
    none = F.array().cast("array<string>")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text")).select(
        "row",
        t.alias("text"),
        F.when(some, matches(t, ASSIGN)).otherwise(none).alias("assign"),
        F.when(some, matches(t, ASSIGN, 2)).otherwise(none).alias("value"),
        F.when(t.contains("AKIA"), matches(t, ACCESS)).otherwise(none).alias("access"),
        matches(t, HEX).alias("hex"),
        matches(t, TOKEN).alias("token"),
    )
    d = d.select("*", *[places(F.col("text"), p, c).alias(f"{c}_at") for c, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))])
    long = F.expr("transform(filter(zip_with(assign_at, value, (p, v) -> struct(p, v)), x -> length(x.v) >= 6), x -> x.p)")
    base = F.concat(spans_of(0, long), spans_of(1, F.col("access_at")), spans_of(2, F.col("hex_at")))
    return d.select("row", base.cast(SPANS).alias("base"), tested("token", "token_at").alias("candidates"))


def threshold(counts: list[int], wordlike: bool, share: float) -> float | None:
    """The smallest edge with a false share of at most `share`, by the numbers of tokens over each edge and, last, of all.

    Of the random tokens, which lie evenly, half are over 1/2; of the tokens over an edge, what exceeds the random ones is false.
    """
    half, n = counts[HALF], counts[-1]
    errors = ERRORS if 4 * half >= n else -ERRORS if wordlike else 0
    random = ((errors + (errors**2 + 8 * half) ** 0.5) / 2) ** 2
    return next((e for e, m in zip(EDGES, counts, strict=False) if m and 1 - random * (1 - e) / m <= share), None)


def thresholds(found: DataFrame, share: float = FALSE_SHARE) -> dict[tuple[int, int], float]:
    """The threshold of p in each class of encoding and length (a few hundred at most) in which any holds. Distinct tokens are
    counted, however often each occurs; a class of fewer than FEW together with those of the next lengths."""
    tokens = found.select(F.explode("candidates").alias("x")).select("x.*").groupBy("encoding", "length_class", "token").agg(F.first("p").alias("p"))
    over = [F.count_if(F.col("p") >= e).alias(f"n{i}") for i, e in enumerate(EDGES)]
    own = {(r.encoding, r.length_class): [*r[2:]] for r in tokens.groupBy("encoding", "length_class").agg(*over, F.count("*").alias("n")).collect()}
    out = {}
    for e, n in own:
        lengths = sorted(m for x, m in own if x == e)
        reach = next((d for d in range(lengths[-1] - lengths[0] + 1) if sum(own[e, m][-1] for m in lengths if abs(m - n) <= d) >= FEW), None)
        wordlike = ALPHABETS[e][0] in WORDLIKE
        if reach is None:
            p = FEW_WORDLIKE if wordlike else FEW_EDGE
        else:
            p = threshold([sum(c) for c in zip(*[own[e, m] for m in lengths if abs(m - n) <= reach], strict=True)], wordlike, share)
        if p is not None:
            out[e, n] = p
    return out


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", share: float = FALSE_SHARE) -> DataFrame:
    """docs with a column of spans (an array): kind, start, end (code points, end exclusive) of each secret in the whole text, by start and kind.

    Kinds are assign, access, hex and random; a random span is a token of 20 characters or more that passes the battery and
    overlaps no base span. Null and empty texts have none; every row gives one row, and an input column named as `spans` is
    replaced; other columns may have any name. Thresholds are of all of docs' tokens. The matches, and the columns of docs,
    are written to the shared folder.
    """
    ws = Workspace(docs.sparkSession, "secrets", docs)
    found = ws.save(found_in(docs.drop(spans), text), "found")
    return found.select("row.*", spans_in(found, share).alias(spans))


def spans_in(found: DataFrame, share: float) -> Column:
    """The spans of a row of found, with thresholds of all of found."""
    limit = thresholds(found, share)
    cases = " ".join(f"WHEN x.encoding = {e} AND x.length_class = {n} THEN x.p >= {p!r}D" for (e, n), p in sorted(limit.items()))
    ok = f"CASE {cases} ELSE false END" if cases else "false"
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    added = f"transform(filter(candidates, x -> {ok}), x -> struct(x.start AS start, {len(KINDS) - 1} AS kind, x.end AS end))"
    ordered = f"array_sort(concat(transform(base, x -> struct(x.start AS start, x.kind AS kind, x.end AS end)), {added}))"
    return F.transform(_apart(F.expr(ordered)), lambda x: F.struct(F.get(F.expr(kinds), x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _apart(spans: Column) -> Column:
    """Spans in order, without the random ones that overlap one of the base kinds. Two passes, since a base span may reach over its
    start from the left or the right: each carries the reach of the base spans so far."""
    item, random = "struct<start:int,kind:int,end:int>", len(KINDS) - 1

    def kept(xs: Column, step: Callable[[Column, Column], Column], start: int) -> Column:
        state = F.struct(F.lit(start).alias("reach"), F.lit(None).cast(item).alias("x"))
        return F.filter(scanned(xs, state, step, lambda s: s["x"], item), lambda x: x.isNotNull())

    def forth(s: Column, x: Column) -> Column:
        base = x["kind"] != random
        return F.struct(F.when(base, F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"), F.when(base | (x["start"] >= s["reach"]), x).alias("x"))

    def back(s: Column, x: Column) -> Column:
        base = x["kind"] != random
        return F.struct(F.when(base, F.least(s["reach"], x["start"])).otherwise(s["reach"]).alias("reach"), F.when(base | (x["end"] <= s["reach"]), x).alias("x"))

    return F.reverse(kept(F.reverse(kept(spans, forth, 0)), back, 2**31 - 1))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each span (overlapping ones together) replaced by a mark. The text is cut into pieces of PIECE characters once,
    and places are sought in their pieces: time grows with the text and the spans, not with their product."""
    joined = "struct<start:int,end:int>"

    def step(s: Column, x: Column) -> Column:
        """Reaches of overlapping spans: what is given out is the part of the text before a span, or null inside one."""
        new = x["start"] >= s["end"]
        return F.struct(F.greatest(s["end"], x["end"]).alias("end"), F.when(new, F.struct(s["end"].alias("start"), x["start"].alias("end"))).cast(joined).alias("gap"))

    def gaps(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(None).cast(joined).alias("gap"))
        last = F.struct(F.array_max(F.transform(xs, lambda x: x["end"])).alias("start"), F.length(text).alias("end"))
        return F.concat(F.filter(scanned(xs, start, step, lambda s: s["gap"], joined), lambda g: g.isNotNull()), F.array(last))

    def part(pieces: Column, g: Column) -> Column:
        piece = lambda at: F.floor(at / PIECE).cast("int")
        of = lambda at: F.coalesce(F.get(pieces, piece(at)), F.lit(""))
        first, n = F.substr(of(g["start"]), g["start"] % PIECE + 1), g["end"] - g["start"]
        between = F.array_join(F.slice(pieces, piece(g["start"]) + 2, F.greatest(piece(g["end"]) - piece(g["start"]) - 1, F.lit(0))), "")
        return F.when(piece(g["start"]) == piece(g["end"]), F.left(first, n)).otherwise(F.concat(first, between, F.left(of(g["end"]), g["end"] % PIECE)))

    whole = F.struct(matches(F.col(text), f"(?s).{{1,{PIECE}}}").alias("pieces"), gaps(F.col(spans)).alias("gaps"))
    parts = bound_column(whole, lambda w: F.transform(w["gaps"], lambda g: part(w["pieces"], g)))
    return F.when(F.size(spans) > 0, F.array_join(parts, mark)).otherwise(F.col(text))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, numbers of the base kinds, base_sha256 and spans of each row of docs."""
    ws = Workspace(docs.sparkSession, "secrets", docs)
    found = ws.save(found_in(rows_of(docs, doc_id=key, text=text), "text").select(F.struct("row.doc_id").alias("row"), "base", "candidates"), "found")
    d = found.select("row.doc_id", spans_in(found, FALSE_SHARE).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    return d.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return report(table(spark, sf_dir, "documents"))
