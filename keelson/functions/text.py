"""Previews of raw bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = dict.fromkeys(map(ord, "\n\r\t"))
PREVIEW_BYTES, CLEAN_BYTES, HEX_BYTES, PRINT_BYTES = 64, 256, 256 << 10, 4 << 10


def printable(data: bytes) -> str:
    """Printable characters of valid UTF-8 as they are, every other byte as \\xNN."""
    try:
        if (whole := data.decode()).isprintable():
            return whole
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                ch = data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if len(ch) == 1 and ch.isprintable():
                out.append(ch)
                at += n
                break
        else:
            out.append(f"\\x{data[at]:02x}")
            at += 1
    return "".join(out)


def preview(data: bytes, limit: int = CLEAN_BYTES) -> str:
    """Clean text cut at limit bytes (at a character) with an ellipsis; other bytes printable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return printable(data[:limit])
    if not text.translate(_BLANKS).isprintable():
        return printable(data[:limit])
    return text if len(data) <= limit else data[:limit].decode("utf-8", "ignore") + "…"


def _text(function):
    @F.pandas_udf("string")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return apply


def printable_column(data: Column) -> Column:
    return _text(printable)(data)


def preview_column(data: Column, limit: int = CLEAN_BYTES) -> Column:
    return _text(lambda x: preview(x, limit))(data)


def entry_preview(value: Column) -> list[Column]:
    """size (bytes) and preview (the first characters) of a text column, without Python."""
    return [F.octet_length(value).cast("long").alias("size"), F.substring(value, 1, PREVIEW_BYTES).alias("preview")]


def hex_dump(data: Column, limit: int = HEX_BYTES) -> Column:
    return F.lower(F.hex(F.substring(data, 1, limit)))


def truncated(data: Column, limit: int = HEX_BYTES) -> Column:
    return F.octet_length(data) > limit


def base64url(data: Column) -> Column:
    """URL-safe base 64 without padding or line breaks."""
    return F.translate(F.rtrim(F.translate(F.base64(data), "\r\n", ""), F.lit("=")), "+/", "-_")
