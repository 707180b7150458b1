"""Fill-in-middle: a document is cut at two places into prefix, middle and suffix, and these are put in another order.

Cuts fall on unit ends. A unit is a regular expression, matched left to right: one code point unless told
otherwise, or a word, a line, a grapheme. `regex` collects the ends of all units of a text in a compact
array; the two cuts are two lookups in it. Text that no unit matches lies in the part of the next unit,
or in the suffix behind the last one, so no character is lost. Cuts and forms follow from a SHA-256 of seed and doc_id alone,
so a run over other partitions, or again after a lost executor, gives the same.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), with a mark
before each part. A text that is empty or holds a mark stays plain, so the text can always be rebuilt.

Null texts count as empty. A null doc_id counts as an empty string. Rows are cut one by one: repeated rows
give equal rows, and columns other than doc_id and text are left out, whatever their names. Texts of any
length are cut whole; a task holds one batch of texts and the unit ends of one text (4 bytes each).
"""

from __future__ import annotations

import functools
import hashlib
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units that one match collects at most: fewer matches are faster, longer lists are not.
RUN = 256
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Spec:
    """unit: a regular expression that matches no empty string. marks: those of prefix, suffix and middle."""

    unit: str = "."
    seed: int = 1
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain_from: int = 90
    spm_below: int = 20

    def __post_init__(self) -> None:
        if regex.match(self.unit, "", regex.DOTALL):
            raise ValueError("a unit must not match the empty string")
        for mark in self.marks:
            # With these, the first place where a mark is found behind the one before is the place where it was put.
            if not mark or any(mark in other for other in self.marks if other is not mark) or any(mark[:k] == mark[-k:] for k in range(1, len(mark))):
                raise ValueError("marks must be distinct, none in another, and none may end as it begins")


@functools.cache
def _runs(unit: str) -> regex.Pattern:
    return regex.compile(f"(?P<_unit>{unit}){{1,{RUN}}}", regex.DOTALL)


def unit_ends(text: str, unit: str = ".") -> array:
    """Ends of the units of a text, in code points."""
    ends = array("I")
    for run in _runs(unit).finditer(text):
        ends.extend(run.ends("_unit"))
    return ends


def cut(doc_id: str, text: str, spec: Spec) -> tuple[int, str, int | None, int | None, str]:
    """CUT of one document."""
    ends = unit_ends(text, spec.unit)
    n = len(ends)
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{spec.seed}:{doc_id}".encode()).digest()[:16])
    if not text or h3 % 100 >= spec.plain_from or any(mark in text for mark in spec.marks):
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = spec.marks
    parts = (s, text[b:], p, text[:a]) if h4 % 100 < spec.spm_below else (p, text[:a], s, text[b:])
    return n, "spm" if parts[0] == s else "psm", a, b - a, "".join((*parts, m, text[a:b]))


def rebuilt(output: str, form: str, spec: Spec) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = spec.marks
    first, second = (s, p) if form == "spm" else (p, s)
    at = output.index(second, len(first))
    end = output.index(m, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(m) :]
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output: one row for each row of docs."""

    @F.pandas_udf(CUT)
    def apart(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [cut(doc_id, text, spec) for doc_id, text in zip(ids, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)

    made = apart(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", made.alias("_cut")).select("doc_id", "_cut.*")


def with_digests(made: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """What fill_in_middle() made, with DIGESTS of the output and of the text rebuilt from output and form instead of the output."""

    @F.pandas_udf(DIGESTS)
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            rows = [[hashlib.sha256(x.encode()).hexdigest() for x in (output, rebuilt(output, form, spec))] for output, form in zip(outputs, forms, strict=True)]
            yield pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"], dtype=object)

    kept = [c for c in made.columns if c != "output"]
    return made.select(*kept, digests("output", "form").alias("_digests")).select(*kept, "_digests.*")


def restore(made: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, text of what fill_in_middle() made."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([rebuilt(output, form, spec) for output, form in zip(outputs, forms, strict=True)], dtype=object)

    return made.select("doc_id", back("output", "form").alias("text"))
