"""Text classification, segmentation and normalisation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern occurs, ignoring case."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


#: Words that tell a query's kind.
QUERY_RULES = [
    ("TEMPORAL", r"\b(when|yesterday|today|last|ago|before|after|since|recent)\b"),
    ("FACTUAL", r"\b(what|who|which|where|how many)\b"),
]
#: Ordered families of a record's layer.
LAYER_RULES = [
    ("TASK", r"\b(todo|task|need to|deadline|remind)\b"),
    ("IDENTITY", r"\b(i am|my name|i prefer|always|never)\b"),
    ("PROJECT", r"\b(project|repo|release|deploy|sprint)\b"),
]
#: Patterns of sensitive content.
SAFETY_PATTERNS = {
    "secret": r"\b(token|password|api[_ ]?key|secret)\b",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "card": r"\b\d{16}\b",
    "address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def parse_currency(x: Column) -> Column:
    """``$1,347.42`` as a double; what is no number is null."""
    return F.regexp_replace(x, r"[$,\s]", "").try_cast("double")


def parse_percent(x: Column) -> Column:
    """``35.06%`` as 0.3506; a bare zero and what is no number are null."""
    return F.when(F.trim(x) == "0", None).otherwise(F.regexp_replace(x, r"[%,\s]", "").try_cast("double") / 100)


def parse_number(x: Column) -> Column:
    return F.regexp_replace(x, r"[,\s]", "").try_cast("double")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _sentences(text: str, least: int, most: int) -> list[tuple[int, str]]:
    """Sentences with their starts: short ones go with the next, the last with the one
    before; long ones are cut at ``; ``, `` - `` or ``, ``."""
    cuts, parts = [0], []
    for m in _SENTENCE.finditer(text):
        cuts.append(m.end())
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        parts.append((a, text[a:b].strip()))
    merged: list[tuple[int, str]] = []
    for at, part in (p for p in parts if p[1]):
        if merged and len(merged[-1][1]) < least:
            merged[-1] = (merged[-1][0], f"{merged[-1][1]} {part}")
        else:
            merged.append((at, part))
    if len(merged) > 1 and len(merged[-1][1]) < least:
        _, last = merged.pop()
        merged[-1] = (merged[-1][0], f"{merged[-1][1]} {last}")
    out = []
    for at, part in merged:
        sep = next((s for s in ("; ", " - ", ", ") if s in part), None) if len(part) > most else None
        for piece in part.split(sep) if sep else [part]:
            out.append((at, piece))
            at += len(piece) + len(sep or "")
    return out


def segments(df: DataFrame, id_col: str, text_col: str, least: int = 20, most: int = 512) -> DataFrame:
    """``(id, position, start, segment)``; null and blank texts have none."""

    def cut(frames):
        for frame in frames:
            rows = [
                (i, k, at, s) for i, t in zip(frame[id_col], frame[text_col].fillna(""), strict=True) for k, (at, s) in enumerate(_sentences(t, least, most))
            ]
            yield pd.DataFrame(rows, columns=["id", "position", "start", "segment"])

    return df.select(id_col, text_col).mapInPandas(cut, "id long, position int, start int, segment string")


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """``(id, position, chunk)``: sentences packed up to ``size`` characters; a chunk
    begins with the last ``overlap`` characters of the one before."""

    def pack(text: str) -> list[str]:
        out, now = [], ""
        for _, sentence in _sentences(text, 0, size):
            if now and len(now) + 1 + len(sentence) > size:
                out.append(now)
                now = now[-overlap:]
            now = f"{now} {sentence}".strip()
        return [*out, now] if now else out

    def cut(frames):
        for frame in frames:
            rows = [(i, k, c) for i, t in zip(frame[id_col], frame[text_col].fillna(""), strict=True) for k, c in enumerate(pack(t))]
            yield pd.DataFrame(rows, columns=["id", "position", "chunk"])

    return df.select(id_col, text_col).mapInPandas(cut, "id long, position int, chunk string")


def fitting_rows(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each key in order, each kept if it still fits the budget: rows that
    don't are passed over.  Keys are one session's or user's rows at a time."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        left, kept = budget, []
        for n in frame[size]:
            kept.append(n <= left)
            left -= n if n <= left else 0
        return frame[kept]

    return df.groupBy(key).applyInPandas(keep, df.schema)
