"""CVSS base scores and vectors, version 2 and 3, as expressions; the weights are those of the published specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findloom.functions.text import let, lookup, trimmed

#: Metric weights.
V2 = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
    "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
    "AU": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.660},
    "I": {"N": 0.0, "P": 0.275, "C": 0.660},
    "A": {"N": 0.0, "P": 0.275, "C": 0.660},
}
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 0.0},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CHANGED_PR = {"N": 0.85, "L": 0.68, "H": 0.5}
#: Temporal and environmental metrics, which are passed over.
IGNORED_V2 = ("E", "RL", "RC", "CDP", "TD", "CR", "IR", "AR")
IGNORED_V3 = ("E", "RL", "RC", "CR", "IR", "AR", "MAV", "MAC", "MPR", "MUI", "MS", "MC", "MI", "MA")
RESULT = "struct<version:string,vector:string,base_score:double>"


def _metrics(body: Column) -> Column:
    """Pairs of a vector's body, in upper case; a part without a colon has a null value."""
    part = lambda p: F.struct(F.upper(F.substring_index(p, ":", 1)).alias("k"), F.when(p.contains(":"), F.upper(F.regexp_extract(p, "(?s)^[^:]*:(.*)$", 1))).alias("v"))
    return F.transform(F.split(F.regexp_replace(body, r"^[()]+|[()]+$", ""), "/"), part)


def _known(pairs: Column, weights: dict, ignored: tuple[str, ...]) -> Column:
    allowed = [f"{k}:{v}" for k, vs in weights.items() for v in vs]

    def fine(own: Column) -> Column:
        keys = F.transform(own, lambda p: p["k"])
        known = F.forall(own, lambda p: p["v"].isNotNull() & F.concat(p["k"], F.lit(":"), p["v"]).isin(*allowed))
        return (F.size(own) == len(weights)) & known & (F.size(F.array_distinct(keys)) == len(weights))

    return let(F.filter(pairs, lambda p: ~p["k"].isin(*ignored) | p["v"].isNull()), fine)


def _letters(pairs: Column, weights: dict) -> Column:
    """A struct of the metrics' letters."""
    letter = lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"]
    return F.struct(*[letter(k).alias(k) for k in weights])


def _joined(letters: Column, weights: dict, names: dict) -> Column:
    return F.concat_ws("/", *[F.concat(F.lit(f"{names.get(k, k)}:"), letters[k]) for k in weights])


def base_v2(metric) -> Column:
    """The score from metric(name) -> weight."""
    ease = 20 * metric("AV") * metric("AC") * metric("AU")

    def of(impact: Column) -> Column:
        raw = (0.6 * impact + 0.4 * ease - 1.5) * F.when(impact == 0, F.lit(0.0)).otherwise(F.lit(1.176))
        return F.round(raw * 10 + 1e-9) / 10 + 0.0

    return let(10.41 * (1 - (1 - metric("C")) * (1 - metric("I")) * (1 - metric("A"))), of)


def base_v3(metric, changed: Column, v30: Column) -> Column:
    """The score from metric(name) -> weight (PR by scope), whether the scope changes and whether 3.0's plain rounding up holds."""
    ease = 8.22 * metric("AV") * metric("AC") * metric("PR") * metric("UI")
    up = lambda scaled: F.when(scaled % 10_000 == 0, scaled / 100_000.0).otherwise((F.floor(scaled / 10_000) + 1) / 10.0)
    rounded = lambda total: F.when(v30, F.ceil(total * 10) / 10.0).otherwise(let(F.round(total * 100_000).cast("long"), up))
    sum_of = lambda impact: F.least((impact + ease) * F.when(changed, F.lit(1.08)).otherwise(F.lit(1.0)), F.lit(10.0))
    of = lambda impact: F.when(impact <= 0, F.lit(0.0)).otherwise(let(sum_of(impact), rounded))
    impact = lambda iss: F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    return let(1 - (1 - metric("C")) * (1 - metric("I")) * (1 - metric("A")), lambda iss: let(impact(iss), of))


def score_vector(vector: Column) -> Column:
    """(version, canonical vector, base_score) of a version 2 or 3 vector, null if it isn't a valid one."""
    def scored(v: Column) -> Column:
        head = F.upper(F.substring(v, 1, 9))
        v30, v31 = head == "CVSS:3.0/", head == "CVSS:3.1/"

        def two_of(m: Column) -> Column:
            score = base_v2(lambda k: lookup(m[k], V2[k]))
            return F.struct(F.lit("2.0").alias("version"), _joined(m, V2, {"AU": "Au"}).alias("vector"), score.alias("base_score"))

        def three_of(m: Column) -> Column:
            changed = m["S"] == "C"
            weight = lambda k: F.when(changed, lookup(m[k], CHANGED_PR)).otherwise(lookup(m[k], V3[k])) if k == "PR" else lookup(m[k], V3[k])
            version = F.when(v30, F.lit("3.0")).otherwise(F.lit("3.1"))
            vector = F.concat(F.lit("CVSS:"), version, F.lit("/"), _joined(m, V3, {}))
            return F.struct(version.alias("version"), vector.alias("vector"), base_v3(weight, changed, v30).alias("base_score"))

        three = let(_metrics(F.substring(v, F.lit(10), F.length(v))), lambda p: F.when(_known(p, V3, IGNORED_V3), let(_letters(p, V3), three_of)))
        two = let(_metrics(v), lambda p: F.when(_known(p, V2, IGNORED_V2), let(_letters(p, V2), two_of)))
        return F.when(v30 | v31, three).when(~head.startswith("CVSS:"), two)

    return let(trimmed(F.coalesce(vector, F.lit(""))), scored).cast(RESULT)


def band(version: Column, score: Column) -> Column:
    """The severity of a score; version 2 has no critical."""
    return (
        F.when((score >= 9) & ~version.startswith("2"), "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score >= 0.1, "low").otherwise("info")
    )
