"""The tokenizer: runs of ASCII letters and digits, then lower-cased."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[0-9A-Za-z]+"


def tokens(text: Column | str) -> Column:
    """Tokens in order, repeats kept; null for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def token_list(text: str) -> list[str]:
    """The same for a query on the driver."""
    return [t.lower() for t in re.findall(TOKEN, text)]


def terms(query: str) -> list[str]:
    """The distinct tokens of a query."""
    return sorted(set(token_list(query)))
