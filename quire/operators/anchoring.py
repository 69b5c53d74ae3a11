"""Anchors of annotations: where a quote stands after its text was edited."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a quote's characters so many may be edited, and a match counts from this score on.
ERROR_RATE, LEAST_SCORE = 0.25, 0.6
ANCHOR = "struct<outcome:string,start:int,end:int,score:double>"


@lru_cache(4096)
def _masks(quote: str) -> dict[str, int]:
    """The places of each character, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distances(quote: str, text: str, anywhere: bool = True) -> list[int]:
    """For each prefix of ``text``, from the empty one on, the edit distance between ``quote`` and it, or with
    ``anywhere`` the least one of what ends there. A column of the dynamic program is two bit vectors, one of the
    steps down it that add 1 and one of those that take 1."""
    if not quote:
        return [0] * (len(text) + 1) if anywhere else list(range(len(text) + 1))
    masks, first = _masks(quote), 0 if anywhere else 1
    every, last = (1 << len(quote)) - 1, 1 << len(quote) - 1
    up, down, distance = every, 0, len(quote)
    out = [distance]
    for c in text:
        equal = masks.get(c, 0)
        same = equal | down
        carry = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(carry | up) & every, up & carry
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise, fall = rise << 1 | first, fall << 1  # the first row grows unless a match may start anywhere
        up, down = (fall | ~(same | rise)) & every, rise & same & every
        out.append(distance)
    return out


def edit_distance(x: str, y: str) -> int:
    return distances(x, y, anywhere=False)[-1]


def stretches(quote: str, text: str, errors: int) -> list[tuple[int, int]]:
    """Stretches of text that hold every match with so many errors: cut into one piece more than errors, a quote has
    a piece that stands unchanged in the match. Ordered, apart from each other."""
    cuts = [len(quote) * i // (errors + 1) for i in range(errors + 2)]
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = text.find(quote[a:b])
        while at >= 0:
            found.append((max(0, at - a - errors), min(len(text), at - a + len(quote) + errors)))
            at = text.find(quote[a:b], at + 1)
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def matches(quote: str, text: str, errors: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the places where the quote stands with at most so many errors: ends whose distance is
    not above that of the ends beside them, each with the shortest span of that distance."""
    out = []
    for low, high in stretches(quote, text, errors):
        part = text[low:high]
        least = distances(quote, part)
        for end in range(1, len(least)):
            d = least[end]
            if d <= errors and d <= least[end - 1] and (end + 1 == len(least) or d <= least[end + 1]):
                backwards = distances(quote[::-1], part[max(0, end - len(quote) - d) : end][::-1], anywhere=False)
                out.append((low + end - backwards.index(d), low + end, d))
    return out


def best_match(quote: str, text: str, prefix: str, suffix: str, errors: int, least: float) -> tuple[int | None, int | None, float | None]:
    """(start, end, score) of the one match of highest score: the share of the characters of prefix, quote and suffix
    that need no edit. No place where another match scores the same or none reaches ``least``."""
    whole = prefix + quote + suffix
    at = text.find(whole)
    if at >= 0:  # unedited with its context: no other place can score 1 unless it is there again
        start = at + len(prefix)
        return (start, start + len(quote), 1.0) if text.find(whole, at + 1) < 0 else (None, None, 1.0)
    scored = []
    for start, end, d in matches(quote, text, errors):
        before = text[max(0, start - len(prefix)) : start]
        after = text[end : end + len(suffix)]
        wrong = d + min(edit_distance(prefix, before), len(prefix)) + min(edit_distance(suffix, after), len(suffix))
        scored.append((1 - wrong / len(whole), start, end))
    if not scored:
        return None, None, None
    scored.sort(key=lambda x: -x[0])
    score, start, end = scored[0]
    if score < least or (len(scored) > 1 and scored[1][0] == score):
        return None, None, score
    return start, end, score


def match_anchor(text: Column, quote: Column, start: Column, prefix: Column, suffix: Column, rate: float = ERROR_RATE, least: float = LEAST_SCORE) -> Column:
    """What became of an anchor in the current text: (outcome, start, end, score), offsets half-open in code points.

    ``stable`` where the quote still stands at its offset, by built-in expressions alone; their texts are not sent to
    Python. Else ``reanchored`` at the one place where quote and context fit best: of places where the quote stands
    with at most ``rate`` of its characters edited, that with the highest score, if it reaches ``least``. The score is
    the share of the characters of prefix, quote and suffix that need no edit, so the context decides between places
    of equal quotes, and an edited quote in its old context wins over an equal one elsewhere. ``needs_review`` where
    no place or more than one has that score (then with the score, without a place), or without quote or text.
    """

    @F.pandas_udf(ANCHOR)
    def find(t: pd.Series, q: pd.Series, p: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for text, quote, before, after in zip(t, q, p, s, strict=True):
            if not text or not quote:
                out.append((None, None, None, None))
                continue
            place = best_match(quote, text, before or "", after or "", math.floor(rate * len(quote)), least)
            out.append(("reanchored" if place[0] is not None else "needs_review", *place))
        frame = pd.DataFrame(out, columns=["outcome", "start", "end", "score"])
        return frame.astype({"start": "Int32", "end": "Int32", "score": "Float64"})

    here = F.coalesce((F.char_length(quote) > 0) & (F.substring(text, start + 1, F.char_length(quote)) == quote), F.lit(False))
    found = find(F.when(~here, text), quote, prefix, suffix)
    stable = F.struct(F.lit("stable").alias("outcome"), start.cast("int").alias("start"), (start + F.char_length(quote)).cast("int").alias("end"), F.lit(1.0).alias("score"))
    moved = F.struct(F.coalesce(found["outcome"], F.lit("needs_review")).alias("outcome"), found["start"].alias("start"), found["end"].alias("end"), found["score"].alias("score"))
    return F.when(here, stable).otherwise(moved)


def reanchored(anchors: DataFrame, entries: DataFrame, fk: str, key: str, text: str, rate: float = ERROR_RATE, least: float = LEAST_SCORE) -> DataFrame:
    """``anchors`` (fk, quote, prefix_context, suffix_context, start_offset) with ``anchor``, the struct of
    ``match_anchor`` in the current text of their entries. An anchor without an entry needs review."""
    current = entries.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = anchors.join(current, F.col(fk) == F.col("__key"), "left")
    column = match_anchor(F.col("__text"), F.col("quote"), F.col("start_offset"), F.col("prefix_context"), F.col("suffix_context"), rate, least)
    return rows.withColumn("anchor", column).drop("__key", "__text")
