"""Small Column helpers with the semantics that extraction needs: Unicode regular expressions, null on a miss."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and only \n ends a line.
FLAGS = "(?Ud)"


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with its Column arguments evaluated once for a row and then referred to by name, however often f uses them. Without
    that, an argument's whole tree is copied into the plan at every use, which doubles with each level of nesting."""

    @wraps(f)
    def made(*args, **kwargs) -> Column:
        names = {f"a{i}": a for i, a in enumerate(args) if isinstance(a, Column)}
        row = F.struct(*[c.alias(n) for n, c in names.items()])
        return F.get(F.transform(F.array(row), lambda s: f(*[s[f"a{i}"] if isinstance(a, Column) else a for i, a in enumerate(args)], **kwargs)), F.lit(0))

    return made


def batched(f: Callable, kind) -> Callable[..., Column]:
    """f, of Arrow arrays, as a function of columns. It is declared as not deterministic, though it is, so that the optimizer neither evaluates it twice nor moves a
    condition on it into the filter of a scan, where it can't run."""
    return F.arrow_udf(f, kind).asNondeterministic()


def pattern(p: str, ignore_case: bool = False) -> str:
    return ("(?Udi)" if ignore_case else FLAGS) + p


def matches(t: Column, p: str, ignore_case: bool = False) -> Column:
    return t.rlike(pattern(p, ignore_case))


def found(t: Column, p: str, group: int = 0, ignore_case: bool = False) -> Column:
    """A group of the first match, or null if it is empty or there is none."""
    return empty_to_null(F.regexp_extract(t, pattern(p, ignore_case), group))


def all_found(t: Column, p: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern(p, ignore_case)), F.lit(group))


def substituted(t: Column, p: str, by: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(t, pattern(p, ignore_case), by)


def stripped(t: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return substituted(t, r"^\s+|\s+$")


def literal(rows: list, schema: str) -> Column:
    """Rows of a vocabulary as one literal: it is parsed once, when the plan is optimised, and costs one call to build."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


@bound
def replaced(t: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after another; none is tried on a text that holds nothing that is replaced by something else, as none changes it."""
    pairs = [(a, b) for a, b in pairs if a != b]
    table = literal([{"a": a, "b": b} for a, b in pairs], "array<struct<a:string,b:string>>")
    held = f"(?={one_of(a[0] for a, _ in pairs)})(?:" + "|".join(rf"\Q{a}\E" for a, _ in pairs) + ")"
    return F.when(t.rlike(held), F.aggregate(table, t, lambda s, p: F.replace(s, p["a"], p["b"]))).otherwise(t)


def rules(t: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after another."""
    return reduce(lambda c, p: substituted(c, p[0], p[1]), pairs, t)


def without(t: Column, characters: str) -> Column:
    return F.translate(t, characters, "")


def any_in(t: Column, words: Iterable[str]) -> Column:
    """Whether t contains any of the words."""
    return t.rlike("|".join(rf"\Q{w}\E" for w in words))


def one_of(letters: Iterable[str]) -> str:
    """A pattern of any of some letters."""
    return "[" + "".join(map(re.escape, sorted(set(letters)))) + "]"


def strings(values: Iterable[str]) -> Column:
    return literal(list(values), "array<string>")


def cut_before(t: Column, words: Iterable[str]) -> Column:
    """What stands before the first occurrence of each word in turn."""
    return reduce(lambda c, w: F.substring_index(c, w, 1), words, t)


def empty_to_null(t: Column) -> Column:
    return F.get(F.filter(F.array(t), lambda v: v != ""), F.lit(0))


def first_where(array: Column, keep: Callable[[Column], Column]) -> Column:
    """The first element that holds the condition, or null."""
    return F.get(F.filter(array, keep), F.lit(0))


@bound
def median(array: Column) -> Column:
    """The middle of a numeric array, or the mean of the middle pair; null if it is empty."""
    s, n = F.sort_array(array), F.size(array)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def as_count(t: Column) -> Column:
    """An unsigned number; null if it isn't one or has more digits than a long."""
    return t.try_cast("bigint")
