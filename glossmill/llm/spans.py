"""Pattern matches with their places, by SQL expressions only.

``matches`` marks every match in one pass of the pattern, cuts at the marks and
adds up the lengths of the parts, so the leftmost non-overlapping matches come
with code point places.  Sums run in blocks of blocks: no array is copied once
per match and no text is walked once per match, so a text costs time in
proportion to its length and its matches.  Patterns must be linear: possessive
loops and no nested open repeats, so that very long texts neither backtrack nor
exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before and after a match that come with it.
CONTEXT = 24
SPAN = "array<struct<start:int,stop:int,kind:int,word:string,before:string,after:string>>"
_BLOCK = 64
_PIECE = 1000


def nothing() -> Column:
    """The empty array of spans."""
    return F.expr(f"cast(array() as {SPAN})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _upto(n: Column) -> Column:
    """0, 1, .. n - 1; n is at least 1."""
    return F.sequence(F.lit(0), n - 1)


def _blocks(values: Column) -> Column:
    n = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    return F.transform(_upto(F.greatest(n, F.lit(1))), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))


def _plain_scan(values: Column, start: Column, op: Callable) -> Column:
    zero = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(
        values,
        zero,
        lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )


def scan(values: Column, zero: int, op: Callable, depth: int = 2) -> Column:
    """For each of an array of ints, ``op`` over all before it; ``zero`` for the first."""
    first = F.lit(zero)
    if not depth:
        return _plain_scan(values, first, op)

    def by_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, first, op))
        return let(
            scan(whole, zero, op, depth - 1),
            lambda before: F.flatten(F.zip_with(blocks, before, lambda b, at: _plain_scan(b, at, op))),
        )

    return let(
        values, lambda v: F.when(F.size(v) <= _BLOCK, _plain_scan(v, first, op)).otherwise(let(_blocks(v), by_blocks))
    )


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of ``pattern``: (start, stop, kind, word, before, after), places from 0, stop exclusive.

    ``before`` ends where the match starts and begins at most ``CONTEXT``
    characters earlier, after the match before; ``after`` likewise.  A pattern
    must match neither of the characters U+0000 and U+0001.
    """
    mark = "\0"
    marked = F.regexp_replace(F.translate(text, mark, "\1"), pattern, f"{mark}$0{mark}")

    def spans(parts: Column) -> Column:
        def items() -> Column:
            return F.transform(
                _upto(F.greatest((F.size(parts) / 2).cast("int"), F.lit(1))),
                lambda i: F.struct(
                    F.length(parts[i * 2]).alias("gap"),
                    F.length(parts[i * 2 + 1]).alias("size"),
                    parts[i * 2 + 1].alias("word"),
                    F.right(parts[i * 2], F.lit(CONTEXT)).alias("before"),
                    F.left(parts[i * 2 + 2], F.lit(CONTEXT)).alias("after"),
                ),
            )

        def placed(found: Column) -> Column:
            steps = F.transform(found, lambda x: x["gap"] + x["size"])
            return F.zip_with(
                found,
                scan(steps, 0, lambda a, b: a + b),
                lambda x, at: F.struct(
                    (at + x["gap"]).alias("start"),
                    (at + x["gap"] + x["size"]).alias("stop"),
                    F.lit(kind).alias("kind"),
                    x["word"].alias("word"),
                    x["before"].alias("before"),
                    x["after"].alias("after"),
                ),
            )

        return F.when(F.size(parts) > 1, let(items(), placed)).otherwise(nothing())

    return let(F.split(marked, mark, -1), spans)


def apart(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, in order."""
    far = 1 << 30

    def tagged(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span")))

    def alone(both: Column) -> Column:
        stops = F.transform(both, lambda x: F.when(x["own"], x["span"]["stop"]).otherwise(F.lit(0)))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["own"], -x["start"]).otherwise(F.lit(-far)))
        return let(
            F.struct(scan(stops, 0, _larger).alias("behind"), scan(starts, -far, _larger).alias("ahead")),
            lambda near: F.filter(
                both,
                lambda x, i: ~x["own"]
                & (near["behind"][i] <= x["start"])
                & (-near["ahead"][F.size(both) - 1 - i] >= x["span"]["stop"]),
            ),
        )

    found = let(F.array_sort(F.concat(tagged(base, True), tagged(more, False))), alone)
    return F.when(F.size(more) > 0, F.transform(found, lambda x: x["span"])).otherwise(nothing())


def replaced(text: Column, spans: Column, labels: Column) -> Column:
    """``text`` with ``spans``, at least one and in order, replaced by the label of their kind; overlapping ones by the first's."""

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first, last = (a / _PIECE).cast("int"), (b / _PIECE).cast("int")
        head = F.substr(parts[first], a % _PIECE + 1, F.when(first == last, b - a).otherwise(F.lit(_PIECE)))
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.when(last < F.size(parts), F.substr(parts[last], F.lit(1), b % _PIECE)).otherwise(F.lit(""))
        return F.when(a >= b, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, tail))

    def build(x: Column) -> Column:
        pieces = F.zip_with(
            x["spans"],
            x["done"],
            lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
                F.concat(piece(x["parts"], at, s["start"]), F.element_at(labels, s["kind"] + 1))
            ),
        )
        end = F.array_max(F.transform(x["spans"], lambda s: s["stop"]))
        return F.concat(F.array_join(pieces, ""), piece(x["parts"], end, F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    done = scan(F.transform(spans, lambda s: s["stop"]), 0, _larger)
    return let(F.struct(spans.alias("spans"), done.alias("done"), parts.alias("parts")), build)


def joined(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of every span by start, then kind, joined by commas."""
    labels = F.array(*[F.lit(n) for n in names])
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(labels, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def count_of(spans: Column, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.try_cast("int").alias("d"), (i % 2).alias("odd"))
    )
    total = F.aggregate(
        figures,
        F.lit(0),
        lambda acc, x: acc
        + F.when(x["odd"] == 1, F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]),
    )
    return total % 10 == 0
