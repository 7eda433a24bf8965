"""Oversized items cut into pieces under every limit, at natural boundaries, with an overlap.

Balanced targets: the least number of pieces follows from the item's cost, targets of equal cost are
placed, each is snapped to the strongest boundary near it, and one more piece is taken whenever a piece
breaks a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import small_enough, stored

#: Boundaries from strong to weak; a cut falls behind the match. Nothing else is a natural boundary.
BOUNDARIES = tuple(
    regex.compile(p)
    for p in (
        r"\r?\n[ \t]*(?:\r?\n[ \t]*)+",  # paragraph
        r"\r\n|\n|\r(?!\n)",  # line
        r"[.!?\u2026]+[\"'\u201d\u2019)\]]*(?=\s)\s|[\u3002\uff01\uff1f]+",  # sentence
        r"[,;:](?=\s)\s|[\uff0c\u3001\uff1b\uff1a]",  # clause
        r"\s(?!\s)",  # word
    )
)
#: Marks and joiners that belong to the character before them.
_BOUND = regex.compile(r"[\p{M}\u200c\u200d\ufe0e\ufe0f\U0001F3FB-\U0001F3FF]")


@dataclass(frozen=True)
class Limits:
    """chars and tokens a piece may have, the overlap wished for, and how far from its target (as a share of
    a piece) a cut may be snapped."""

    chars: int = 2048
    tokens: int = 512
    overlap: int = 200
    reach: float = 0.2


def _whole(text: str, at: int) -> int:
    """The nearest place at or before `at` that parts no character from its marks, and no CR from its LF."""
    lowest = max(1, at - 32)
    while at > lowest and at < len(text) and (_BOUND.match(text[at]) or text[at - 1] == "\u200d" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at


def _snapped(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], of equal ones the nearest to target; else target itself."""
    for pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text, max(0, low - 2), min(len(text), high + 2)) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    return max(low, _whole(text, target))


def _weights(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    if text.isascii():
        return np.ones(len(text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1.0 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def cut(text: str, tokens: int | None, limits: Limits = Limits()) -> list[tuple[int, int, float]]:
    """(start, end, tokens) of the pieces of a text with so many tokens in all (None: not known, no token limit).

    Tokens are taken to be spread over the text as its bytes are. A piece's cost is the larger of its share of
    the two limits, character by character, so that a cost of 1 keeps both. A single character that alone
    exceeds the token limit is a piece by itself. Where the overlap alone would take more than half of a limit, it
    shrinks to that, piece by piece. The count of pieces is the least, from what the whole costs, that fits.
    """
    n = len(text)
    if not n:
        return []
    per = _weights(text)
    per_token = per * ((tokens or 0) / per.sum())
    cost = np.concatenate([[0.0], np.cumsum(np.maximum(1 / limits.chars, np.minimum(1.0, per_token / limits.tokens)))])
    spent = np.concatenate([[0.0], np.cumsum(per_token)])
    slack = 1e-9
    if n <= limits.chars and spent[-1] <= limits.tokens + slack:
        return [(0, n, float(spent[-1]))]
    pieces = max(2, int(np.ceil(cost[-1] - slack)))
    while pieces < n:
        found, start, begun = [], 0, 0
        for i in range(1, pieces + 1):
            if i == pieces:
                end = n
            else:
                target = int(np.searchsorted(cost, cost[-1] * i / pieces))
                furthest = int(np.searchsorted(cost, cost[start] + 1 + slack, "right")) - 1
                around = int(limits.reach * n / pieces)
                low, high = max(begun + 1, target - around), min(furthest, target + around, n - 1)
                end = _snapped(text, min(max(target, low), high), low, high) if low <= high else -1
            if end <= begun or end - start > limits.chars or spent[end] - spent[start] > limits.tokens + slack:
                break
            found.append((start, end, float(spent[end] - spent[start])))
            begun = end
            reach = max(end - limits.overlap, int(np.searchsorted(cost, cost[end] - 0.5)))  # half a piece at most
            start = min(end, max(found[-1][0] + 1, _whole(text, reach))) if limits.overlap else end
        else:
            return found
        pieces += 1
    return [(i, i + 1, float(per_token[i])) for i in range(n)]


def oversized(strings: DataFrame, predictions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(string_id, raw_string, tokens): items whose largest positive token_count is above the limit, or that have
    none and more characters than the limit.

    Only narrow columns of the predictions move. The counts above the limit are few or many: they are broadcast
    if their counted size allows, else joined by a shuffle. Of the strings without such a count only those over
    the character limit move. Null and empty strings and null ids are no items; null, zero and negative counts
    are no counts.
    """
    counts = predictions.filter((F.col("token_count") > 0) & F.col("string_id").isNotNull()).groupBy("string_id").agg(F.max("token_count").alias("tokens"))
    counts = stored(counts, "token-counts")
    heavy = counts.filter(F.col("tokens") > limits.tokens)
    if small_enough(heavy.count(), 16):
        heavy = F.broadcast(heavy)
    items = strings.select("string_id", "raw_string").filter(F.length("raw_string") > 0)
    some = items.join(heavy, "string_id", "left").filter(F.col("tokens").isNotNull() | (F.length("raw_string") > limits.chars))
    rest = counts.select("string_id", F.col("tokens").alias("_any"))
    return some.join(rest, "string_id", "left").filter(F.col("tokens").isNotNull() | F.col("_any").isNull()).select("string_id", "raw_string", "tokens")


def pieces(strings: DataFrame, predictions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(string_id, piece_no, start_pos, end_pos, tokens, piece) of every oversized item, in code points from 0.

    See oversized() for what is one and cut() for where it is cut. Equal texts under different ids are cut alike;
    repeated rows give repeated pieces; an empty table gives an empty one.
    """
    schema = f"string_id {strings.schema['string_id'].dataType.simpleString()}, piece_no int, start_pos int, end_pos int, tokens double, piece string"
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(strings.schema["string_id"].dataType.simpleString(), pa.string())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for key, text, tokens in zip(*(part.column(c).to_pylist() for c in ("string_id", "raw_string", "tokens"))):
                    rows += [(key, k, a, b, t if tokens else None, text[a:b]) for k, (a, b, t) in enumerate(cut(text, tokens, limits))]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()))], names=["string_id", "piece_no", "start_pos", "end_pos", "tokens", "piece"])

    return oversized(strings, predictions, limits).mapInArrow(stage, schema)
