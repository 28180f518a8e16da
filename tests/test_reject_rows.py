import random
import re

import pytest

from glyphgrove.operators import reject_rows

NUMBER = r" *[0-9]{1,18} *"
SCORE = r" *[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)? *"


def fields(line):
    """Fields of a line by a reading head, or null where quotes are used otherwise."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + line[i], i + 1
            if i < n and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            value, i = line[i:j], j
            if '"' in value:
                return None
        out.append(value)
        if i >= n:
            return out
        i += 1


def tree_ok(x):
    d = 0
    for i, ch in enumerate(x):
        d += {"[": 1, "]": -1}.get(ch, 0)
        if d <= 0 and i < len(x) - 1:
            return False
    return x.endswith("]") and d == 0


def score_ok(x):
    one = lambda s: bool(re.fullmatch(SCORE, s)) and float(s) <= 1
    t = x.strip(" ")
    return one(x) or t.startswith("[") and t.endswith("]") and len(t) > 1 and len(t[1:-1].split(",")) == 3 and all(map(one, t[1:-1].split(",")))


def reason(line):
    if line is None:
        return None
    line = line.removesuffix("\r")
    m = re.match(r'("?)([ER])\1(?:\t|$)', line)
    if not m:
        return None
    f = fields(line)
    if f is None:
        return "quoting"
    if len(f) != {"E": 3, "R": 5}[m[2]]:
        return "columns"
    if m[2] == "E":
        t = f[2].strip(" ")
        ok = tree_ok(f[1]) and t.startswith("[") and t.endswith("]") and all(re.fullmatch(NUMBER, x) for x in t[1:-1].split(","))
    else:
        ok = re.fullmatch(NUMBER, f[1]) and re.fullmatch(NUMBER, f[2]) and tree_ok(f[3]) and score_ok(f[4])
    return None if ok else "value"


def check(spark, lines):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id bigint, line string, _tag string")
    got = {r["line_id"]: r["reason"] for r in reject_rows.rejected(df).collect()}
    want = {i: reason(x) for i, x in enumerate(lines) if reason(x)}
    assert got == want, [(lines[i], got.get(i), want.get(i)) for i in got.keys() ^ want.keys() | {k for k in got.keys() & want.keys() if got[k] != want[k]}][:5]
    loaded = {r["line_id"] for r in reject_rows.strict_load(df).collect()}
    assert loaded == {i for i, x in enumerate(lines) if x is not None and reason(x) is None and re.match(r'("?)[ER]\1(\t|\r?$)', x)}
    return df


GOOD = ["E\t[V!x]\t[1, 2]", "R\t1\t2\t[V!x[V!y]]\t0.5", 'R\t1\t2\t"[V!x]"\t[0.1, 1, 1e-3]', '"E"\t"[T!a""b\tc]"\t[ 7 ]\r', "R\t 12 \t0\t[a]\t [1,0,0.0] "]
EDGE = [
    None, "", "E", "R", "E\t", "Q\tx", "E\t[a]\t[]", "E\t[a]\t[1,]", "E\t[a][b]\t[1]", "E\t[a]]\t[1]", "E\t[a\t[1]", "E\t]a[\t[1]", "E\ta]\t[1]", 'E\t"[a]\t[1]', 'E\t[a"]\t[1]', 'E\t"[a]"x\t[1]', 'E\t""\t[1]',
    "R\t1\t2\t[a]\t1.01", "R\t1\t2\t[a]\t.5", "R\t1\t2\t[a]\t1.", "R\t1\t2\t[a]\tNaN", "R\t1\t2\t[a]\t-0.1", "R\t1\t2\t[a]\t1e5", "R\t1\t2\t[a]\t[0,0]", "R\t1\t2\t[a]\t[0,0,0,0]", "R\t1234567890123456789\t2\t[a]\t0", "R\t\t2\t[a]\t0",
    "R\t1\t2\t[a]\t0\t", "E\t[a]\t[1]\r\r", "\tE\t[a]\t[1]", "E \t[a]\t[1]", "E\t[a\\\"]\t[1]", 'E\t"a\t\t\t', '"E\t[a]\t[1]', 'E\t[a]\t"[1]"', "E\t[a\x01b]\t[1]",
]


def test_cases(spark):
    check(spark, GOOD + EDGE)


def test_random_lines(spark):
    rnd = random.Random(7)
    lines = []
    for _ in range(3000):
        x = list(rnd.choice(GOOD))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(x) + 1)
            x[i : i + rnd.randint(0, 1)] = rnd.choice('"\t[],.e1 \r\\"')
        lines.append("".join(x))
    check(spark, lines)


def test_loaded_values(spark):
    df = spark.createDataFrame(list(enumerate(GOOD)), "line_id bigint, line string")
    r = {x["line_id"]: x for x in reject_rows.strict_load(df).collect()}
    assert r[0]["positions"] == [1, 2] and r[0]["doc"] is None
    assert r[2]["scores"] == [0.1, 1.0, 1e-3] and r[2]["expression"] == "[V!x]"
    assert r[3]["expression"] == '[T!a"b\tc]'
    assert (r[4]["doc"], r[4]["pos"]) == (12, 0)


def test_long_lines(spark):
    long = ["R\t1\t2\t[" + "[a]" * 50_000 + "]\t0.5", "E\t[a]\t[" + ", ".join("1" * 50_000) + "]", 'E\t"[' + '""' * 50_000 + ']"\t[1]', "R" + "\t1" * 100_000, '"' * 99_999]
    df = spark.createDataFrame(list(enumerate(long)), "line_id bigint, line string")
    assert {r["line_id"]: r["reason"] for r in reject_rows.rejected(df).collect()} == {3: "columns"}


def test_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/result_lines.parquet").select("line_id", "line").collect()
    from glyphgrove.plans.hygiene import p3_found

    assert {r["line_id"]: r["reason"] for r in p3_found(spark, data).collect()} == {i: reason(x) for i, x in rows if reason(x)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, line string")
    assert reject_rows.rejected(df).count() == 0 and reject_rows.strict_load(df).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 12, 13, 14, 40])
def test_deep_expressions(spark, depth):
    good = "[" * depth + "x" + "]" * depth
    bad = [good[:-1], good + "]", good + good, "[" + good + "]]" + good, "[]" * depth + "[", good.replace("x", "]" * depth + "[" * depth)]
    rows = [(0, f"E\t{good}\t[1]")] + [(i + 1, f"E\t{b}\t[1]") for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "line_id bigint, line string")
    assert {r["line_id"] for r in reject_rows.strict_load(df).collect()} == {0}
    assert {tuple(r) for r in reject_rows.rejected(df).collect()} == {(i + 1, "value") for i in range(len(bad))}
