"""Charsets, hashes and formats of response bodies."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels whose codec has another name in Python.
_LABELS = {"gb2312": "gbk", "x-gbk": "gbk", "iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "shift-jis": "cp932", "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "big5": "big5hkscs", "iso-8859-9": "cp1254", "tis-620": "cp874"}


def sniff_meta_charset(body: Column) -> Column:
    """Label in a meta tag of the first 2048 bytes, null if there is none."""
    head = F.lower(F.make_valid_utf8(F.substring(body, 1, 2048).cast("string")))
    tags = F.filter(F.regexp_extract_all(head, F.lit("<meta([^>]*)"), F.lit(1)), lambda t: t.contains("charset"))
    labels = F.transform(tags, lambda t: F.regexp_extract(F.get(F.split(t, "charset", 2), F.lit(1)), r"^\s*=[\s\"']*([^\s\"'/;,]+)", 1))
    return F.get(F.filter(labels, lambda x: x != ""), F.lit(0))


def header_charset(content_type: Column) -> Column:
    """Label in a Content-Type header; the name of the parameter is matched as written."""
    part = F.filter(F.split(content_type, ";"), lambda p: F.trim(p).startswith("charset="))
    return F.nullif(F.trim(F.substr(F.trim(F.get(part, F.lit(0))), F.lit(9))), F.lit(""))


def _codec(label):
    try:
        return codecs.lookup(_LABELS.get(label.strip().lower(), label.strip().lower())).name if label else None
    except LookupError:
        return None


@F.pandas_udf(T.StringType())
def _other_charset(body: pd.Series, header: pd.Series, meta: pd.Series) -> pd.Series:
    def one(b, h, m):
        if b is None:
            return None
        name = _codec(h) or _codec(m) or "utf-8"
        return bytes(b).decode(name, "replace")

    return pd.Series([one(*x) for x in zip(body, header, meta)])


def decode_body(body: Column, content_type: Column) -> Column:
    """Text of a body: valid UTF-8 as it is, else by header or meta label, else with replacement characters.

    Only bodies that are not UTF-8 have their bytes sent to Python.
    """
    text = body.cast("string")
    fine = F.is_valid_utf8(text)
    odd = F.when(~fine, body)
    return F.when(fine, text).otherwise(_other_charset(odd, F.when(~fine, header_charset(content_type)), F.when(~fine, sniff_meta_charset(body))))


def hash_bytes(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def format_bytes(n: Column) -> Column:
    """Whole bytes, else KB, MB or GB with one decimal, halves to even."""
    unit = lambda k, name: F.concat(F.bround(n / float(1024**k), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {name}"))
    return F.when(n >= 1024**3, unit(3, "GB")).when(n >= 1024**2, unit(2, "MB")).when(n >= 1024, unit(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def now_seconds() -> Column:
    return F.unix_timestamp().cast("string")


def header(headers: Column, name: str) -> Column:
    """A response header, empty ones as null."""
    return F.nullif(F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0)), F.lit(""))


def retry_decision(status: Column, attempt: Column, retries: int = 2) -> Column:
    """struct(action, delay_ms) after an answer; status null is a network error, attempts count from 1."""
    again = (status.isNull() | (status >= 500) | (status == 429)) & (attempt <= retries)
    action = F.when(status == 200, "use").when(status == 304, "not_modified").when(again, "retry").otherwise("fail")
    return F.struct(action.alias("action"), F.when(action == "retry", 500 * F.pow(F.lit(2), attempt - 1)).cast("long").alias("delay_ms"))
