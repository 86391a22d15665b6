import random
import re

import pytest

from glyphflow.data.fonts import BY_PRIORITY
from glyphflow.operators import catalog
from glyphflow.operators.patterns import match_patterns, required

SCHEMA = "encoding string, priority int, ord int, regex string"


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"shree[-_\s]*dev", ["shree"]), (r"krutidev", ["krutidev"]), (r"surekh[-_\s]*(normal|bold)", ["surekh"]), (r"wm|Chanakya", ["wm", "chanakya"]),
        (r"ab?cd", ["cd"]), (r"ab*", ["a"]), (r"abc+d", ["ab"]), (r"x{0,2}yz", ["yz"]), (r"x{2}y", ["x"]), (r"a\.b", ["a.b"]), (r"a\db", ["a"]), (r".*", [""]), (r"[a-z]+", [""]), (r"[]a]bc", ["bc"]), (r"[^]a]bc", ["bc"]),
        (r"(?i)abc", [""]), (r"(a)\1", [""]), (r"(?:ab)cd", ["cd"]), (r"^font$", ["font"]), (r"a(b\)c)d", ["a"]), ("", [""]), (r"\x41bc", [""]), (r"a|", ["a", ""]), (r"ab+?c", ["a"]),
    ],
)
def test_required(pattern, want):
    got = required(pattern)
    assert [len(g) for g in got] == [len(w) for w in want] and (got == want or len(want[0]) == 1)


def test_every_match_contains_a_required_run():
    """Patterns put together at random, and strings they match."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abcd-1 ") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    atoms = ["a", "b", "cd", "ab", "[-a]", r"\d", r"\-", ".", "(a|b)", "(?:cd)", "1"]
    hits = 0
    for _ in range(500):
        p = "".join(rng.choice(["", "", "", "|"]) + rng.choice(atoms) + rng.choice(["", "", "", "*", "+", "?", "{2}", "{0,1}"]) for _ in range(rng.randrange(1, 5))).lstrip("|")
        runs = required(p)
        for name in names:
            if re.search(p, name):
                hits += 1
                assert any(r in name for r in runs), (p, runs, name)
    assert hits > 5000


def brute(names, patterns):
    out = {}
    for name in {n for n in names if n}:
        found = [(-p, o, e) for e, p, o, r in patterns if r and re.search(r, name, re.I)]
        if found:
            out[name] = min(found)[2]
    return out


def test_against_every_pattern_tried(spark):
    rng = random.Random(5)
    words = ["shree", "dev", "kruti", "lipi", "bold", "x", "yz"]
    names = ["-".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + str(rng.randrange(30)) for _ in range(300)] + ["SHREE-Dev", "", None, "q"]
    patterns = [(f"e{i}", rng.randrange(3), i, rng.choice(words) + rng.choice(["[-_]*", "", r"\d*", "?"]) + rng.choice(words) + rng.choice(["", str(rng.randrange(9)), r"\d$"])) for i in range(120)]
    patterns += [("any", -1, 0, ".*q.*"), ("digits", -2, 0, r"\d"), ("all", -3, 0, "[a-z]"), ("none", 9, 0, ""), ("null", 9, 0, None)]
    got = match_patterns(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(patterns, SCHEMA))
    assert {r.name: r.encoding for r in got.collect()} == brute(names, patterns)
    assert match_patterns(spark.createDataFrame([], "name string"), spark.createDataFrame(patterns, SCHEMA)).count() == 0
    assert match_patterns(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_built_in_patterns(spark):
    names = ["Shree-Dev-0714", "KRUTIDEV010", "Surekh Bold", "WM-Chanakya", "Arial", "DVBWTTSurekhNormal", "Shusha02"]
    patterns = [(e, p, i, r) for e, p, regexes, _ in BY_PRIORITY for i, r in enumerate(regexes)]
    got = match_patterns(spark.createDataFrame([(n,) for n in names], "name string"), catalog.font_patterns(spark))
    assert {r.name: r.encoding for r in got.collect()} == brute(names, patterns)
