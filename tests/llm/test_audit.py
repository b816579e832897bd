"""The audit of filters against a plain walk through every order."""

import re
from itertools import permutations

import pytest

from tests.compare import difference
from vintagelake.llm import audit
from vintagelake.llm import queries as q


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append((lang or "", {k for k, v in f.items() if v}))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    flags = fails(rows)
    out = []
    for part in sorted({p for p, _ in flags}):
        own = [(f, r[0] in good, r[0] in toxic) for (p, f), r in zip(flags, rows, strict=True) if p == part]
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                earlier = set(order[: k - 1])
                steps.append([part, order, k, len(left), len(gone), sum(f in x[0] and bool(x[0] & earlier) for x in own), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        shapley = {f: sum(s[4] for s in steps if s[1][s[2] - 1] == f) for f in "ABCDE"}
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(220))
    texts = [long, long.upper(), long + " #", "a " * 300, "A " * 300, "", None, "short *", long + "\x0bé\x1c", "ÄÖ " * 40, "B " * 250 + "|"]
    rows = [(i, texts[i % 7 if i < 60 else i % 11], ["en", "fr", None, "", "de"][i * 7 % 5]) for i in range(150)]
    rows += [(None, long, "en"), (None, None, None), (3, texts[3], "en"), (3, texts[3], "en"), (3, long, "fr"), (0, long, "en")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 150, 2)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, A string")
    out = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == brute(rows, labels)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(q.op13_filter_audit(spark, folder), audit.SQL, folder) == ""
