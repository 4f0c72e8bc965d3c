"""All matches of Python regular expressions, with code-point offsets and named groups.

Built-in functions give no offsets, and papers' patterns look behind and back; so this is an Arrow function over whole
texts, one pass for all patterns. Everything that follows it is built in.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "array<struct<rank:int,start:int,end:int,match:string,groups:map<string,string>>>"


def spans(text: Column, *patterns: str, flags: int = 0) -> Column:
    """Matches of each pattern from left to right without overlap, pattern by pattern (rank, from 0); an empty list for
    null. Groups that took no part are left out."""
    compiled = [re.compile(p, flags) for p in patterns]

    @F.pandas_udf(_SPAN)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [
                    {"rank": k, "start": m.start(), "end": m.end(), "match": m[0], "groups": {g: v for g, v in m.groupdict().items() if v is not None}}
                    for k, p in enumerate(compiled)
                    for m in p.finditer(x or "")
                ]
                for x in texts
            ]
        )

    return found(text)


def of_rank(found: Column, rank: int) -> Column:
    """The matches of one of the patterns."""
    return F.filter(found, lambda m: m["rank"] == rank)
