"""Parsers of model output.

Models wrap JSON in fences and talk, break it off, or write several arrays.
``from_json`` gives null for all of these, so the parsers work on text: a
scanner takes every value that stands whole at the top level, and the plain
reading is tried first.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CANDIDATE
from ..sources.workspace import ship_package

_DECODER = json.JSONDecoder()


class Unparseable(ValueError):
    pass


def unfence(text: str) -> str:
    """The inside of the first code fence up to the last one, trimmed; all of it without fences."""
    head, fence, rest = text.partition("```")
    if fence:
        line, newline, body = rest.partition("\n")
        text = body if newline else rest
    body, fence, _ = text.rpartition("```")
    return (body if fence else text).strip()


def after_think(text: str) -> str:
    _, end, rest = text.partition("</think>")
    return rest.strip() if end else text


def _number(x, default):
    if x is None:
        return default
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise Unparseable("not a number")
    return float(x)


def _candidate(x) -> dict:
    if not isinstance(x, dict) or not all(isinstance(x.get(k), str) for k in ("content", "scope", "category")):
        raise Unparseable("not a candidate")
    entity = x.get("entity")
    if entity is not None and not isinstance(entity, str):
        raise Unparseable("entity")
    return {"content": x["content"], "scope": x["scope"], "category": x["category"], "entity": entity, "confidence": _number(x.get("confidence"), 0.5), "scope_confidence": _number(x.get("scope_confidence"), 0.5)}


def _candidates(text: str) -> list[dict] | None:
    try:
        value = json.loads(text)
        return [_candidate(x) for x in value] if isinstance(value, list) else None
    except ValueError:
        return None


def objects(text: str) -> list[str]:
    """The top-level ``{...}`` pieces of a text, minding strings; a last piece may be incomplete."""
    out, depth, start, quoted, skip = [], 0, None, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip = ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
            start = i if start is None else start
        elif ch == "{":
            start = i if start is None else start
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth <= 0 and start is not None:
                out.append(text[start : i + 1])
                depth, start = 0, None
    if start is not None:
        out.append(text[start:])
    return out


def parse_candidates(response: str | None) -> list[dict]:
    """Candidates of an extraction response; raises ``Unparseable`` when nothing can be read.

    Tried in turn: empty; the whole text; its inside without fences; from the first
    bracket to the last; a bare object; arrays and objects one after another;
    single objects, also without their opening brace or cut off at the end.
    """
    text = (response or "").strip()
    if text in ("", "[]"):
        return []
    inner = unfence(text)
    for attempt in (text, inner, inner[inner.find("[") : inner.rfind("]") + 1] if "[" in inner else "", f"[{inner}]" if inner.startswith("{") else ""):
        found = _candidates(attempt)
        if found is not None:
            return found
    found, at = [], 0
    while 0 <= (at := min((k for k in (inner.find("[", at), inner.find("{", at)) if k >= 0), default=-1)):
        try:
            value, end = _DECODER.raw_decode(inner, at)
            found += [_candidate(x) for x in (value if isinstance(value, list) else [value])]
            at = end
        except ValueError:
            at += 1
    if not found:
        for piece in objects(inner.strip().lstrip("[").rstrip("]")):
            try:
                found.append(_candidate(json.loads(piece if piece.startswith("{") else "{" + piece)))
            except ValueError:
                continue
    if not found:
        raise Unparseable("no candidate in the response")
    return found


def _decisions(text: str) -> list[dict] | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, list):
        return None
    out = []
    for x in value:
        if not isinstance(x, dict):
            return None
        index, action, reason = x.get("index"), x.get("action"), x.get("reason")
        if isinstance(index, bool) or not isinstance(index, int) or index < 0 or not isinstance(action, str):
            return None
        target = None
        if action.startswith("merge:"):
            number = action[6:]
            if not number.removeprefix("+").isascii() or not number.removeprefix("+").isdigit():
                return None
            action, target = "merge", int(number)
        elif action not in ("keep", "keep_as_project", "drop"):
            action = "keep"
        out.append({"index": index, "action": action, "target": target, "reason": reason if isinstance(reason, str) else None})
    return out


def parse_decisions(response: str | None, n: int) -> list[dict]:
    """One decision for each of ``n`` candidates, in order.

    The first of several for one index holds; indices out of range are ignored;
    candidates without one are kept, and all are if nothing can be read.
    """
    text = after_think((response or "").strip())
    slice_ = text[text.find("[") : text.rfind("]") + 1] if "[" in text else ""
    found = next((d for d in map(_decisions, (text, unfence(text), slice_)) if d is not None), None)
    default = "unparseable response" if found is None else "no decision"
    by: dict[int, dict] = {}
    for d in found or []:
        if d["index"] < n:
            by.setdefault(d["index"], d)
    return [by.get(k, {"index": k, "action": "keep", "target": None, "reason": default}) for k in range(n)]


def parse_synthesis(response: str | None) -> dict:
    """content, category (default pattern) and confidence (default 0.8) of a synthesis response."""
    text = after_think((response or "").strip())
    inner = unfence(text)
    for attempt in (inner, text, inner[inner.find("{") : inner.rfind("}") + 1] if "{" in inner else ""):
        try:
            x = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(x, dict) and isinstance(x.get("content"), str):
            category = x.get("category", "pattern")
            if isinstance(category, str):
                return {"content": x["content"], "category": category, "confidence": _number(x.get("confidence"), 0.8)}
    raise Unparseable("no synthesis in the response")


_FIELDS = [f.split() for f in CANDIDATE.split(", ")]


def candidates_column(spark, response) -> Column:
    """struct(items array of candidates, error string) of a response column; error is set for dead letters."""
    ship_package(spark)

    @F.pandas_udf(f"items array<struct<{', '.join(f'{a}:{b}' for a, b in _FIELDS)}>>, error string")
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((parse_candidates(x), None))
            except ValueError as e:
                rows.append(([], str(e)))
        return pd.DataFrame(rows, columns=["items", "error"])

    return parse(response)


def decisions_column(spark, response, n) -> Column:
    """array of struct(index, action, target, reason): see ``parse_decisions``."""
    ship_package(spark)

    @F.pandas_udf("array<struct<index:int, action:string, target:int, reason:string>>")
    def parse(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([parse_decisions(x, int(k)) for x, k in zip(s, n)])

    return parse(response, n)


def synthesis_column(spark, response) -> Column:
    """struct(content, category, confidence, error)."""
    ship_package(spark)

    @F.pandas_udf("content string, category string, confidence double, error string")
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((*parse_synthesis(x).values(), None))
            except ValueError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["content", "category", "confidence", "error"])

    return parse(response)
