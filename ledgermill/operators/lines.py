"""Texts as arrays of lines within their row: places of labels, blocks that own the lines below their heading, and values below a label.

All functions are column expressions over one row's array, so no text is shuffled and a long one is no hot key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions import columns as C

#: What ends a line.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
Test = Callable[[Column], Column]
let = C.let


def lines(text: Column, blank: bool = True) -> Column:
    """Array of structs (clean, norm) of a text's lines; none for null. ``blank``: with blank lines."""
    found = F.transform(F.split(text, BREAKS), lambda x: F.struct(C.clean(x).alias("clean"), C.normal_text(x).alias("norm")))
    return found if blank else F.filter(found, lambda x: x["clean"] != "")


def bare_lines(text: Column) -> Column:
    """Array of structs (clean) of a text's lines, for what asks for no more."""
    return F.transform(F.split(text, BREAKS), lambda x: F.struct(C.clean(x).alias("clean")))


def place(of: Column, test: Test) -> Column:
    """The first line (from 1) that fits; 0 if there is none."""
    return F.coalesce(F.array_position(F.transform(of, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)), F.lit(0)).cast("int")


def below(of: Column, at: Column, most: int | None = None) -> Column:
    """The lines below a place, ``most`` at most; null without a place."""
    return F.when(at > 0, F.slice(of, at + 1, F.size(of) if most is None else F.lit(most)))


def until(of: Column, stop: Test) -> Column:
    """The lines before the first one that fits."""
    cut = lambda x: let(place(x, stop), lambda at: F.when(at > 0, F.slice(x, F.lit(1), at - 1)).otherwise(x))
    return let(of, cut)


def blocks(of: Column, start: Test) -> Column:
    """Array of arrays: every line that fits, with the lines below it up to the next."""
    cut = lambda o, starts: F.transform(starts, lambda at, i: F.slice(o, at, F.coalesce(F.get(starts, i + 1), F.size(o) + 1) - at))
    return let(of, lambda o: let(places(o, start), lambda starts: cut(o, starts)))


def places(of: Column, test: Test) -> Column:
    """All lines (from 1) that fit."""
    return F.filter(F.transform(of, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())


def section(of: Column, start: Test, stop: Test) -> Column:
    """The lines below the first one that fits, up to a stop."""
    return let(of, lambda o: until(below(o, place(o, start)), stop))


def in_section(of: Column, start: Test, stop: Test) -> Column:
    """Array of booleans: whether the last start or stop at or above the line is a start."""
    marks = F.transform(of, lambda x: F.when(start(x), 1).when(stop(x), 2).otherwise(0))
    return F.transform(last_above(marks, lambda m: m > 0), lambda m: F.coalesce(m == 1, F.lit(False)))


def last_above(of: Column, test: Test) -> Column:
    """For every element the last one at or above it that fits, or null."""

    def filled(o: Column, at: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i - 1), F.array(F.size(o)))
        run = lambda e: lambda r: F.array_repeat(F.when(r > 0, F.get(o, F.get(e, r))), F.get(e, r + 1) - F.get(e, r))
        return let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), run(e))))

    return let(of, lambda o: let(places(o, test), lambda at: filled(o, at)))


def paragraphs(of: Column) -> Column:
    """Array of (block, value): the lines between blank ones as one text, with the number of blank lines above."""
    edges = F.concat(F.array(F.lit(0)), places(of, lambda x: x["clean"] == ""), F.array(F.size(of) + 1))
    part = lambda e, r: F.slice(of, F.get(e, r) + 1, F.get(e, r + 1) - F.get(e, r) - 1)
    found = let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda r: F.struct(r.alias("block"), joined(part(e, r)).alias("value"))))
    return F.filter(found, lambda x: x["value"].isNotNull())


def first_value(of: Column) -> Column:
    """The first line that isn't blank."""
    return F.get(F.filter(of, lambda x: x["clean"] != ""), F.lit(0))["clean"]


def joined(of: Column, most: int | None = None) -> Column:
    """The lines as one text; null if it is empty."""
    text = F.nullif(F.array_join(F.transform(of, lambda x: x["clean"]), " "), F.lit(""))
    return text if most is None else F.substring(text, 1, most)


def last(of: Column, test: Test) -> Column:
    """The last line that fits."""
    return F.try_element_at(F.filter(of, test), F.lit(-1))


def labelled(of: Column, pattern: str, next_lines: int = 2, marks: str = " :-") -> Column:
    """The value after the first label that has one: on the line itself, else the first that isn't blank of the next lines."""


    def value(o: Column, x: Column, i: Column) -> Column:
        own = C.clean_value(F.btrim(F.regexp_extract(x["clean"], f"(?iU){pattern}(.*)$", 1), F.lit(marks)))
        return F.when(x["clean"].rlike(f"(?iU){pattern}"), F.coalesce(own, C.clean_value(first_value(F.slice(o, i + 2, F.lit(next_lines))))))

    return let(of, lambda o: F.get(F.filter(F.transform(o, lambda x, i: value(o, x, i)), lambda v: v.isNotNull()), F.lit(0)))
