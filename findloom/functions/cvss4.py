"""CVSS version 4.0: vectors and scores by the published algorithm, once for each distinct vector.

The scores of the 270 macro-vectors are FIRST's published table. They're a parameter here: a dict from six digits to a score, or a JSON file of one that the
session's SETTING names.
"""

from __future__ import annotations

import json
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The values of the base metrics; of threat, environmental and supplemental ones (X: not defined).
BASE = {
    "AV": ("N", "A", "L", "P"), "AC": ("L", "H"), "AT": ("N", "P"), "PR": ("N", "L", "H"), "UI": ("N", "P", "A"),
    "VC": ("H", "L", "N"), "VI": ("H", "L", "N"), "VA": ("H", "L", "N"), "SC": ("H", "L", "N"), "SI": ("H", "L", "N"), "SA": ("H", "L", "N"),
}
OTHER = {"E": ("X", "A", "P", "U"), "CR": ("X", "H", "M", "L"), "IR": ("X", "H", "M", "L"), "AR": ("X", "H", "M", "L")}
MODIFIED = {
    "MAV": ("X", "N", "A", "L", "P"), "MAC": ("X", "L", "H"), "MAT": ("X", "N", "P"), "MPR": ("X", "N", "L", "H"), "MUI": ("X", "N", "P", "A"),
    "MVC": ("X", "H", "L", "N"), "MVI": ("X", "H", "L", "N"), "MVA": ("X", "H", "L", "N"), "MSC": ("X", "H", "L", "N"), "MSI": ("X", "S", "H", "L", "N"), "MSA": ("X", "S", "H", "L", "N"),
}
SUPPLEMENTAL = {"S": ("X", "N", "P"), "AU": ("X", "N", "Y"), "R": ("X", "A", "U", "I"), "V": ("X", "D", "C"), "RE": ("X", "L", "M", "H"), "U": ("X", "CLEAR", "GREEN", "AMBER", "RED")}
#: How many steps of 0.1 a value is below the worst one.
STEPS = {
    "AV": {"N": 0, "A": 1, "L": 2, "P": 3}, "PR": {"N": 0, "L": 1, "H": 2}, "UI": {"N": 0, "P": 1, "A": 2}, "AC": {"L": 0, "H": 1}, "AT": {"N": 0, "P": 1},
    "VC": {"H": 0, "L": 1, "N": 2}, "VI": {"H": 0, "L": 1, "N": 2}, "VA": {"H": 0, "L": 1, "N": 2},
    "SC": {"H": 1, "L": 2, "N": 3}, "SI": {"S": 0, "H": 1, "L": 2, "N": 3}, "SA": {"S": 0, "H": 1, "L": 2, "N": 3},
    "CR": {"H": 0, "M": 1, "L": 2}, "IR": {"H": 0, "M": 1, "L": 2}, "AR": {"H": 0, "M": 1, "L": 2},
}
#: The highest vectors of each level of EQ1, EQ2, EQ3 with EQ6, and EQ4.
HIGHEST = (
    {(0,): ("AV:N/PR:N/UI:N",), (1,): ("AV:A/PR:N/UI:N", "AV:N/PR:L/UI:N", "AV:N/PR:N/UI:P"), (2,): ("AV:P/PR:N/UI:N", "AV:A/PR:L/UI:P")},
    {(0,): ("AC:L/AT:N",), (1,): ("AC:H/AT:N", "AC:L/AT:P")},
    {
        (0, 0): ("VC:H/VI:H/VA:H/CR:H/IR:H/AR:H",),
        (0, 1): ("VC:H/VI:H/VA:L/CR:M/IR:M/AR:H", "VC:H/VI:H/VA:H/CR:M/IR:M/AR:M"),
        (1, 0): ("VC:L/VI:H/VA:H/CR:H/IR:H/AR:H", "VC:H/VI:L/VA:H/CR:H/IR:H/AR:H"),
        (1, 1): ("VC:L/VI:H/VA:L/CR:H/IR:M/AR:H", "VC:L/VI:H/VA:H/CR:H/IR:M/AR:M", "VC:H/VI:L/VA:H/CR:M/IR:H/AR:M", "VC:H/VI:L/VA:L/CR:M/IR:H/AR:H", "VC:L/VI:L/VA:H/CR:H/IR:H/AR:M"),
        (2, 1): ("VC:L/VI:L/VA:L/CR:H/IR:H/AR:H",),
    },
    {(0,): ("SC:H/SI:S/SA:S",), (1,): ("SC:H/SI:H/SA:H",), (2,): ("SC:L/SI:L/SA:L",)},
)
#: The depths of those levels, in steps.
DEPTHS = ({(0,): 1, (1,): 4, (2,): 5}, {(0,): 1, (1,): 2}, {(0, 0): 7, (0, 1): 6, (1, 0): 8, (1, 1): 8, (2, 1): 10}, {(0,): 6, (1,): 5, (2,): 4})
#: The session's setting that names a JSON file of macro-vector scores.
SETTING = "spark.findloom.cvss4.scores"
RESULT = T.StructType([T.StructField("version", T.StringType()), T.StructField("vector", T.StringType()), T.StructField("base_score", T.DoubleType())])


def load_macro_scores(path: str) -> dict[str, float]:
    with open(path) as f:
        return {k: float(v) for k, v in json.load(f).items()}


def configured(spark: SparkSession) -> dict[str, float] | None:
    """The scores that the session's SETTING names, or None."""
    path = spark.conf.get(SETTING, None)
    return load_macro_scores(path) if path else None


def parse(vector: str) -> dict[str, str] | None:
    """The metrics of a vector; None if it's invalid."""
    head, _, body = vector.strip().partition("/")
    if head.upper() != "CVSS:4.0":
        return None
    allowed, out = BASE | OTHER | MODIFIED | SUPPLEMENTAL, {}
    for pair in body.split("/"):
        key, colon, value = (x.upper() for x in pair.partition(":"))
        if not colon or value not in allowed.get(key, ()) or key in out:
            return None
        out[key] = value
    return out if BASE.keys() <= out.keys() else None


def canonical(m: dict[str, str]) -> str:
    """In the published order, without supplemental and unset metrics."""
    return "/".join(["CVSS:4.0", *[f"{k}:{m[k]}" for k in BASE | OTHER | MODIFIED if m.get(k, "X") != "X"]])


def effective(m: dict[str, str]) -> dict[str, str]:
    """What counts of each metric: a modified one over the base one, the worst case where threat and requirements are unset."""
    out = {k: m.get(f"M{k}", "X") for k in BASE}
    out = {k: m[k] if v == "X" else v for k, v in out.items()}
    for k, worst in (("E", "A"), ("CR", "H"), ("IR", "H"), ("AR", "H")):
        out[k] = worst if m.get(k, "X") == "X" else m[k]
    return out


def levels(e: dict[str, str]) -> tuple[int, ...]:
    """EQ1 to EQ6."""
    worst = [e["AV"] == "N", e["PR"] == "N", e["UI"] == "N"]
    eq1 = 0 if all(worst) else 2 if e["AV"] == "P" or not any(worst) else 1
    high = [e["VC"] == "H", e["VI"] == "H", e["VA"] == "H"]
    eq3 = 0 if high[0] and high[1] else 1 if any(high) else 2
    eq4 = 0 if "S" in (e["SI"], e["SA"]) else 1 if "H" in (e["SC"], e["SI"], e["SA"]) else 2
    eq6 = 0 if any(h and e[r] == "H" for h, r in zip(high, ("CR", "IR", "AR"), strict=True)) else 1
    return eq1, int((e["AC"], e["AT"]) != ("L", "N")), eq3, eq4, "APU".index(e["E"]), eq6


def base_score(m: dict[str, str], scores: dict[str, float]) -> float:
    e = effective(m)
    if all(e[k] == "N" for k in ("VC", "VI", "VA", "SC", "SI", "SA")):
        return 0.0
    eq = levels(e)
    of = lambda q: scores.get("".join(map(str, q)))
    value = of(eq)

    def next_lower(*which: int) -> float | None:
        return of(tuple(x + (i in which) for i, x in enumerate(eq)))

    if (eq[2], eq[5]) == (0, 0):
        both = [x for x in (next_lower(2), next_lower(5)) if x is not None]
        lower3 = max(both, default=None)
    else:
        lower3 = next_lower(5) if (eq[2], eq[5]) == (1, 0) else next_lower(2) if eq[5] == 1 and eq[2] < 2 else next_lower(2, 5)
    lower = (next_lower(0), next_lower(1), lower3, next_lower(3), next_lower(4))
    keys = ((eq[0],), (eq[1],), (eq[2], eq[5]), (eq[3],))

    for tops in product(*[HIGHEST[g][k] for g, k in enumerate(keys)]):
        steps = [[STEPS[n][e[n]] - STEPS[n][t] for n, t in (pair.split(":") for pair in top.split("/"))] for top in tops]
        if all(x >= 0 for group in steps for x in group):
            break
    drops = [(value - low) * (sum(steps[g]) / DEPTHS[g][keys[g]] if g < 4 else 0) for g, low in enumerate(lower) if low is not None]
    value -= sum(drops) / len(drops) if drops else 0
    return int(min(max(value, 0.0), 10.0) * 10 + 0.5) / 10


def score_v4(vectors: DataFrame, macro_scores: dict[str, float], vector: str = "vector") -> DataFrame:
    """Distinct vectors with s4: (version, vector, base_score), null if invalid."""
    def score(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            m = parse(v or "")
            out.append(m and {"version": "4.0", "vector": canonical(m), "base_score": base_score(m, macro_scores)})
        return pa.array(out, pa.struct([("version", pa.string()), ("vector", pa.string()), ("base_score", pa.float64())]))

    return vectors.withColumn("s4", F.arrow_udf(score, RESULT)(vector))
