"""Scalar text functions, as column expressions wherever Spark has the parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.workspace import ship_package

_DROPPED_BLOCKS = ("local-command-caveat", "system-reminder")
_DROPPED_TAGS = ("local-command-caveat", "local-command-stdout", "local-command-stderr", "bash-input", "bash-stdout", "bash-stderr")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_estimate(text) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return (F.octet_length(_c(text)) / 4).cast("bigint")


def strip_noise(text) -> Column:
    """Without the harness's blocks (tag, content and end tag) and stray tags; an end before a start changes nothing."""
    out = _c(text)
    for tag in _DROPPED_BLOCKS:
        out = F.regexp_replace(out, f"(?s)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(out, f"</?(?:{'|'.join(_DROPPED_TAGS)})>", "")


def encode_project(path) -> Column:
    return F.translate(_c(path), "/", "-")


def session_of(path) -> Column:
    """The file's name without its ending."""
    return F.regexp_extract(_c(path), r"([^/]+)\.jsonl$", 1)


def escape_like(needle: str) -> str:
    """A literal for LIKE: %, _ and the backslash are escaped."""
    return "".join("\\" + ch if ch in "%_\\" else ch for ch in needle)


def short_id(id_) -> Column:
    return F.substring(_c(id_), 1, 8)


def after_thinking(text) -> Column:
    """What follows the first end of a thinking block, trimmed; unchanged without one."""
    t = _c(text)
    at = F.instr(t, "</think>")
    return F.when(at > 0, F.regexp_replace(F.expr("substring({0}, instr({0}, '</think>') + 8)".format(f"`{text}`")) if isinstance(text, str) else t.substr(at + 8, F.length(t)), r"^\s+|\s+$", "")).otherwise(t)


def text_lines(text) -> Column:
    """Lines without their ends; no empty last line after a final line feed."""
    return F.split(F.regexp_replace(_c(text), r"\r?\n$", ""), r"\r?\n")


def cut_bytes(value: str, most: int) -> str:
    """The longest prefix of at most ``most`` UTF-8 bytes that doesn't split a character."""
    return value.encode()[:most].decode("utf-8", "ignore")


def tail_bytes(value: str, most: int) -> str:
    """The longest such suffix."""
    raw = value.encode()
    return value if len(raw) <= most else raw[len(raw) - most :].decode("utf-8", "ignore")


def truncate_bytes(spark, text, most: int) -> Column:
    ship_package(spark)

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else cut_bytes(x, most))

    return F.when(F.octet_length(_c(text)) <= most, _c(text)).otherwise(cut(_c(text)))


def preview(spark, text, most: int) -> Column:
    """``truncate_bytes`` with an ellipsis where something was cut."""
    return F.when(F.octet_length(_c(text)) <= most, _c(text)).otherwise(F.concat(truncate_bytes(spark, text, most), F.lit("...")))


def stable_id(*columns) -> Column:
    """An id that a retried task makes again: the hash of what identifies the row, in the shape of a UUID."""
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
