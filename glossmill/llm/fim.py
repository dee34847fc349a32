"""Fill-in-middle transformation of documents.

A text is cut into three pieces at two of its token borders and written in one
of two orders with marks between, so that a left-to-right model learns to fill
the middle.  A token is a run of characters that are no white space with the
white space before it; white space at the end is a token of its own.

Each text becomes a numpy array of code points.  Borders are where a character
outside white space is followed by white space: the classes of neighbours are
compared and ``flatnonzero`` gives all borders at once.  The two ranks drawn for
the row index them, and the pieces are slices of the array.

The draw is a hash of a seed and the row's id, so a row that is computed anew,
on any executor, comes out the same.  There is no shuffle, and a batch of rows
is bounded by bytes.

Defined cases: a null text counts as empty; an empty text, and one that holds a
mark, stays as it is (form ``plain``); a null id draws as the seed with nothing
behind it; equal and repeated rows come out equal; an id of any type draws by
its text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import small_batches, table, text_or_empty

SEED = 42
#: Percent of the texts that are transformed, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80


@dataclass(frozen=True)
class Marks:
    """The marks of the three pieces; none may begin within another, or a text could not be rebuilt."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = astuple(self)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                meets = any(a.endswith(b[:k]) for k in range(1, len(b)))
                if not a or meets or (i != j and a in b):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def borders(codes: np.ndarray) -> np.ndarray:
    """Token borders from 0 to the length: one more than there are tokens."""
    if not len(codes):
        return np.zeros(1, np.int64)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    inner = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], inner, [len(codes)]))


class Cutter:
    """Cuts texts by drawn numbers and writes the pieces with marks."""

    def __init__(self, marks: Marks, rate: int, suffix_first: int):
        self.texts = astuple(marks)
        self.p, self.s, self.m = map(points, self.texts)
        self.rate, self.suffix_first = rate, suffix_first

    def __call__(self, text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
        """(tokens, form, prefix length, middle length, output) of a text."""
        codes = points(text)
        ends = borders(codes)
        n = len(ends) - 1
        if not text or h[2] % 100 >= self.rate or any(mark in text for mark in self.texts):
            return n, "plain", None, None, text
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = np.split(codes, ends[[a, b]])
        if h[3] % 100 < self.suffix_first:
            form, order = "spm", (self.s, suffix, self.p, prefix, self.m, middle)
        else:
            form, order = "psm", (self.p, prefix, self.s, suffix, self.m, middle)
        return n, form, len(prefix), len(middle), np.concatenate(order).tobytes().decode("utf-32-le")


def draws(seed: int) -> list[Column]:
    """Four 32-bit numbers of a row: the first digits of a hash of the seed and the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Marks = Marks()
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; ids keep their type."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(marks, rate, suffix_first)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            drawn = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            rows = [cut(text, h) for text, h in zip(batch.column(1).to_pylist(), drawn)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", text_or_empty().alias("text"), *draws(seed)).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", marks: Marks = Marks()) -> Column:
    """The text that a row was made of, from its output and form alone."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(F.col(output), F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, marks.middle, 1)
        return one, two, F.substr(rest, F.length(two) + len(marks.middle) + 1)

    prefix, suffix, middle = pieces(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(marks.suffix, marks.prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), tokens AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM texts
), drawn AS (
  SELECT *, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens
), parts AS (
  SELECT *, coalesce(array_to_string(t[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(t[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(t[greatest(a, b) + 1:], ''), '') AS s FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
