"""Fill-in-the-middle transformation of whole texts by ropes.

A text is a balanced tree of short leaves; each node caches how many units (runs of ASCII letters, or single other code points)
start in it and how many code points it has. Cutting a text at a unit's rank walks down one path; the prefix, middle and suffix are
put together again, with sentinels between them, by joining trees. The inverse cuts the tree of an output at its sentinels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import by_bytes, mapped, raw_texts, rows_of, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 documents so many are transformed, and of 100 of those so many have their suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1
#: Code points of a leaf.
LEAF = 1 << 12


def unit_starts(text: str, after_letter: bool = False) -> np.ndarray:
    """Whether a unit starts at each code point; after_letter: what precedes the text ends in a letter."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((code | 0x20) - np.uint32(ord("a"))) < 26
    before = np.concatenate([[after_letter], letter[:-1]])[: len(letter)]
    return ~(letter & before)


class Rope:
    """A leaf (text, and where its units start) or an inner node; units and chars are those of all its leaves."""

    __slots__ = ("chars", "left", "right", "starts", "text", "units")

    def __init__(self, text: str | None = None, starts: np.ndarray | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        self.units = int(np.count_nonzero(starts)) if left is None else left.units + right.units
        self.chars = len(text) if left is None else left.chars + right.chars

    @staticmethod
    def of(text: str, leaf: int = LEAF) -> Rope:
        """The balanced tree of a text."""
        row, letter = [], False
        for i in range(0, max(1, len(text)), leaf):
            part = text[i : i + leaf]
            row.append(Rope(part, unit_starts(part, letter)))
            letter = part[-1:].isascii() and part[-1:].isalpha()
        while len(row) > 1:
            row = [Rope(left=a, right=b) for a, b in zip(row[::2], row[1::2], strict=False)] + row[len(row) & ~1 :]
        return row[0]

    def __add__(self, other: Rope) -> Rope:
        return other if not self.chars else self if not other.chars else Rope(left=self, right=other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def _split(self, size: Callable[[Rope], int], place: Callable[[Rope, int], int], rank: int) -> tuple[Rope, Rope]:
        """Both sides of a place inside the tree: down one path, and joined again on the way up."""
        path, node = [], self
        while node.left is not None:
            own = size(node.left)
            path.append((node, rank < own))
            node, rank = (node.left, rank) if rank < own else (node.right, rank - own)
        at = place(node, rank)
        left, right = Rope(node.text[:at], node.starts[:at]), Rope(node.text[at:], node.starts[at:])
        for node, went_left in reversed(path):
            left, right = (left, right + node.right) if went_left else (node.left + left, right)
        return left, right

    def split_units(self, rank: int) -> tuple[Rope, Rope]:
        """Before the unit of a rank (from 0), and from it on; all and nothing where there are no more units."""
        if rank >= self.units:
            return self, Rope("", np.zeros(0, bool))
        return self._split(lambda r: r.units, lambda leaf, k: int(np.flatnonzero(leaf.starts)[k]), rank)

    def split_chars(self, rank: int) -> tuple[Rope, Rope]:
        """The first `rank` code points, and the rest."""
        if rank >= self.chars:
            return self, Rope("", np.zeros(0, bool))
        return self._split(lambda r: r.chars, lambda _, k: k, rank)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2 ** 32 of a document's id (null: of an empty name)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, numbers: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output of a text."""
    whole = Rope.of(text)
    n, (h1, h2, h3, h4) = whole.units, numbers
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    rest, suffix = whole.split_units(high)
    prefix, middle = rest.split_units(low)
    form = SPM if h4 % 100 < SUFFIX_FIRST else PSM
    order = [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)] if form == SPM else [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
    out = Rope.of("")
    for sentinel, part in order:
        out = out + Rope.of(sentinel) + part
    return n, form, prefix.chars, middle.chars, str(out)


def original(output: str, form: str) -> str:
    """The text of an output: its tree cut at the first sentinel of each kind, and joined in the text's order."""
    if form == PLAIN:
        return output
    rest, parts = Rope.of(output), {}
    for sentinel in reversed((SUFFIX, PREFIX, MIDDLE) if form == SPM else (PREFIX, SUFFIX, MIDDLE)):
        rest, tail = rest.split_chars(output.index(sentinel))
        parts[sentinel] = tail.split_chars(len(sentinel))[1]
    return str(parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX])


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, restored: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in `keep`) with the transformed text of each row: n (units), form, prefix_chars, middle_chars and output;
    with `restored`, a column of that name has the text that is rebuilt from output and form alone.

    Empty texts and those that hold a sentinel stay as they are; null texts count as empty ones, stray bytes as U+FFFD. Cuts and form
    depend on the key and the seed alone: repeated keys draw alike, a null key draws for an empty name. Texts of any length are
    whole; every row gives one row. Input columns named as the new ones are replaced. An empty table gives none. No shuffle.
    """
    new = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string" + (f", `{restored}` string" if restored else ""))
    names = {f.name.lower() for f in new.fields}
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text):
            made = [arranged(raw.decode(), draws(k, seed)) for raw, k in zip(raw_texts(b.column(text)), b.column(key).to_pylist(), strict=True)]
            columns = {f: [m[i] for m in made] for i, f in enumerate(new.names[:5])}
            if restored:
                columns[restored] = [original(m[4], m[1]) for m in made]
            arrays = {f.name: pa.array(columns[f.name], pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in new.fields}
            yield pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else b.column(f.name) for f in schema.fields], names=schema.names)

    return mapped(df, run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """df with the text of each output in a column `text` (a null output or form: null). No shuffle."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, output):
            pairs = zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)
            back = pa.array([None if o is None or f is None else original(o, f) for o, f in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([back if f.name == text else b.column(f.name) for f in schema.fields], names=schema.names)

    return mapped(df, run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, transformed and rebuilt."""
    docs = rows_of(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return transform(docs, restored="restored", keep=["doc_id"]).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id)) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
 h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
