"""Arrow UDFs for the few string steps Spark has no native function for.

Callers pass null for every row the native path already answers, so only rows
with unusual characters cross into Python.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers receive the functions of this module by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN_TYPE = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v), na_action="ignore")


def _numeric_entity(match: re.Match) -> str:
    digits, base = (match[1][1:], 16) if match[1][0] in "xX" else (match[1], 10)
    point = int(digits, base)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else match[0]


@F.pandas_udf(T.StringType())
def numeric_entities(values: pd.Series) -> pd.Series:
    pattern = re.compile(r"&#([xX][0-9a-fA-F]+|[0-9]+);")
    return values.map(lambda v: pattern.sub(_numeric_entity, v), na_action="ignore")


def fold_offsets(source: str) -> tuple[str, list[int]]:
    """Folded text and, per folded character, the index of its raw character."""
    pieces = [unicodedata.normalize("NFKC", ch).lower() for ch in source]
    owner = [raw for raw, piece in enumerate(pieces) for _ in piece]
    return "".join(pieces), owner


def occurrence_span(source: str, needle: str, occurrence: int) -> tuple[int, int] | None:
    """Raw span of the n-th hit of normalised ``needle``; hits may overlap."""
    if not needle:
        return None
    folded, owner = fold_offsets(source)
    hit = re.compile("[^a-z0-9]+".join(re.escape(word) for word in needle.split(" ")))
    at = 0
    for _ in range(occurrence + 1):
        found = hit.search(folded, at)
        if found is None:
            return None
        at = found.start() + 1
    return owner[found.start()], owner[found.end() - 1] + 1


@F.pandas_udf(SPAN_TYPE)
def locate_span(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Span of an already normalised needle; null source rows are skipped."""
    for sources, needles, occurrences in batches:
        spans = [
            (occurrence_span(s, n, int(k)) if s is not None and n is not None else None)
            or (None, None)
            for s, n, k in zip(sources, needles, occurrences)
        ]
        yield pd.DataFrame(spans, columns=["start", "end"]).astype("Int64")


@F.udtf(returnType="occurrence: bigint, start: bigint, end: bigint")
class LocateAll:
    """Every occurrence of a normalised needle in one source text."""

    def eval(self, source: str, needle: str):
        if source is None or not needle:
            return
        folded, owner = fold_offsets(source)
        hit = re.compile("[^a-z0-9]+".join(re.escape(w) for w in needle.split(" ")))
        at, rank = 0, 0
        while (found := hit.search(folded, at)) is not None:
            yield rank, owner[found.start()], owner[found.end() - 1] + 1
            at, rank = found.start() + 1, rank + 1
