"""Font-name patterns as a relation of any length, met through what every match must contain.

Each alternative of a pattern has a longest run of characters that a match cannot do without.  Of that run's grams
the one that fewest names have is the pattern's entry in an inverted index, so thousands of patterns meet only names
that have its gram; a pattern without such a run meets every name, as it must.  What is met is then matched.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters of a gram; shorter runs are grams themselves.
GRAM = 3
_SPECIAL = set("\\[](){}.*+?^$|")


def required(pattern: str) -> list[str]:
    """For each alternative at the top, the longest run that all its matches contain, in lower case; '' for none.

    Knows literals, escapes, classes, groups and quantifiers.  Of groups only what follows them is kept from running
    together, and what is not known ('(?' and back references among them) makes the whole pattern one without a run.
    """
    runs: list[list[str]] = [[""]]
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        atom: str | None = None  # a literal, or something else
        if c == "\\":
            if i + 1 == n or pattern[i + 1] in "123456789kQEpPxuc0":
                return [""]
            atom = pattern[i + 1] if not pattern[i + 1].isalnum() else None
            i += 2
        elif c == "[":
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            while i < n and pattern[i] != "]":
                if pattern[i] == "[" or pattern[i : i + 2] == "&&":
                    return [""]
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 1 : i + 3] != "?:":
                return [""]
            depth, i = 1, i + 1
            while i < n and depth:
                if pattern[i] == "[":
                    return [""]
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 2 if pattern[i] == "\\" else 1
        elif c == "|":
            runs.append([""])
            i += 1
            continue
        else:
            if c in "{}*+?)]":
                return [""]
            atom = c if c not in _SPECIAL else None
            i += 1
        least = 1
        if i < n and pattern[i] in "*+?{":
            if pattern[i] == "{":
                end = pattern.find("}", i)
                low = pattern[i + 1 : end].partition(",")[0] if end > 0 else ""
                if not low.isdigit():
                    return [""]
                least, i = int(low), end + 1
            else:
                least, i = int(pattern[i] == "+"), i + 1
            if i < n and pattern[i] in "?+":
                i += 1
            # What is repeated is there, but what follows it need not follow one of it.
            runs[-1] += [atom, ""] if atom is not None and least else [""]
        elif atom is None:
            runs[-1].append("")
        else:
            runs[-1][-1] += atom
    return [max((r.lower() for r in of), key=len) for of in runs]


@F.pandas_udf(ArrayType(StringType()))
def _required(pattern: pd.Series) -> pd.Series:
    return pattern.map(required)


def grams(text: Column, size: int) -> Column:
    """All substrings of a size; none of shorter texts."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(size)))


def match_patterns(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """name, encoding of distinct names (name) that a pattern finds, whatever the case of letters.

    patterns: encoding, priority, ord, regex; the greatest priority wins, then the smallest ord, then the encoding.
    Null and empty names and patterns match nothing.
    """
    distinct = names.select("name").where("name <> ''").distinct()
    small = F.lower("name")
    of_name = F.array_distinct(F.concat(*[grams(small, k) for k in range(1, GRAM + 1)], F.array(F.lit(""))))
    entered = distinct.select("name", F.explode(of_name).alias("gram"))
    having = entered.groupBy("gram").agg(F.count(F.lit(1)).alias("n_names"))
    rows = patterns.where("regex <> ''").select("encoding", "priority", "ord", "regex")
    runs = rows.withColumn("run", F.explode(F.array_distinct(_required("regex"))))
    run = F.col("run")
    parts = runs.withColumn("gram", F.explode(F.when(F.length(run) <= GRAM, F.array(run)).otherwise(F.array_distinct(grams(run, GRAM)))))
    rarest = parts.join(having, "gram", "left").groupBy("encoding", "priority", "ord", "regex", "run").agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n_names"), "gram")).alias("rarest"))
    index = rarest.where("rarest.n_names > 0").select("encoding", "priority", "ord", "regex", "run", F.col("rarest.gram").alias("gram"))
    met = entered.join(index, "gram").where(F.contains(small, F.col("run")) & F.regexp_like("name", F.concat(F.lit("(?i)"), F.col("regex"))))
    best = met.groupBy("name").agg(F.min(F.struct((-F.col("priority")).alias("p"), "ord", "encoding")).alias("best"))
    return best.select("name", F.col("best.encoding").alias("encoding"))
