"""Spans of pattern matches as columns, with SQL functions only.

Everything here takes time in proportion to the text and its matches: running
values come from two levels of folds, so no array grows by one element at a
time over a whole text, and parts of a text are taken from its blocks instead
of from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:string>"
STEP = 256  # elements that one inner fold takes
BLOCK = 1024  # characters in a block of a text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, kind: str, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each element ``op`` over those before it (``zero`` for the first), and at the end over all; ``op`` is associative."""
    start = F.lit(zero).cast(kind)

    def fold(part: Column) -> Column:
        first = F.struct(start.alias("all"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(op(acc["all"], x).cast(kind).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out")))

    def whole(v: Column) -> Column:
        n = F.size(v)
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / STEP).cast("int") - 1, F.lit(0))), lambda b: fold(F.slice(v, b * STEP + 1, F.lit(STEP))))

        def joined_up(parts: Column) -> Column:
            def shifted(before: Column) -> Column:
                own = F.zip_with(parts, F.slice(before["out"], 1, F.size(parts)), lambda p, at: F.transform(p["out"], lambda x: op(at, x).cast(kind)))
                return F.concat(F.flatten(own), F.array(before["all"]))

            return let(fold(F.transform(parts, lambda p: p["all"])), shifted)

        return let(blocks, joined_up)

    return let(values, whole)


def located(text: Column, pattern: str, found: Column, window: int = 0, least: int = 5) -> Column:
    """Start, end (code points, end exclusive) and value of each match, and the ``window`` characters before it.

    ``found`` is the array of all matches, of ``least`` characters or more each;
    the gaps between them, which a split by the same pattern gives, carry the
    running position.
    """

    def placed(pieces: Column) -> Column:
        def at_ends(ends: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                end = ends[i + 1]
                back = F.lit("").cast("string")
                if window:
                    near = -(-window // least)
                    first = F.greatest(i - near, F.lit(0))
                    older = F.array_join(F.transform(F.slice(pieces, first + 1, i - first), lambda q: q["tail"]), "")
                    back = F.right(F.concat(older, F.right(p["gap"], F.lit(window))), F.lit(window))
                return F.struct((end - F.length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value"), back.alias("before"))

            return F.transform(pieces, one)

        return let(running(F.transform(pieces, lambda p: F.length(p["gap"]) + F.length(p["value"])), "int", lambda a, b: a + b), at_ends)

    def piece(gap: Column, value: Column) -> Column:
        tail = F.right(F.concat(F.right(gap, F.lit(window)), value), F.lit(window)) if window else F.lit("")
        return F.struct(gap.alias("gap"), value.alias("value"), tail.alias("tail"))

    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, piece)
    return F.when(F.size(found) > 0, let(pieces, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, label; ordered by start) replaced by its label.

    Where spans overlap, the first one's label stands for the covered stretch.
    """

    def cut(blocks: Column) -> Column:
        def part(lo: Column, hi: Column) -> Column:
            a, b = F.floor(lo / BLOCK).cast("int"), F.floor((hi - 1) / BLOCK).cast("int")
            one = F.substr(blocks[a], lo - a * BLOCK + 1, hi - lo)
            more = F.concat(F.substr(blocks[a], lo - a * BLOCK + 1), F.array_join(F.slice(blocks, a + 2, b - a - 1), ""), F.substr(blocks[b], F.lit(1), hi - b * BLOCK))
            return F.when(lo >= hi, "").when(a == b, one).otherwise(more)

        def out(s: Column) -> Column:
            def ends(done: Column) -> Column:
                kept = F.transform(s, lambda x, i: F.when(x["start"] >= done[i], F.concat(part(done[i], x["start"]), x["label"])).otherwise(""))
                return F.concat(F.array_join(kept, ""), part(done[F.size(s)], F.length(text)))

            return let(running(F.transform(s, lambda x: x["end"]), "int", lambda a, b: F.greatest(a, b)), ends)

        return let(spans, out)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """All leftmost non-overlapping matches, looked for only where ``gate`` holds."""
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
