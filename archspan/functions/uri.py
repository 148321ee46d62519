"""Paths as file URIs and back, with percent-encoding by UTF-8 bytes."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(path: str) -> str:
    return "file://" + quote(path, safe="/")


def decode(uri: str) -> str:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else uri


@F.pandas_udf(T.StringType())
def path_to_uri(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else encode(p))


@F.pandas_udf(T.StringType())
def uri_to_path(uri: pd.Series) -> pd.Series:
    return uri.map(lambda u: None if u is None else decode(u))
