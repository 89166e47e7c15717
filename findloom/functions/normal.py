"""Normalising expressions: severities, vulnerability ids, package URLs, CWEs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findloom.config import GENERAL_SCALE, PATH_PREFIXES, SEVERITY_RANK, VULN_FORMATS, SeverityPolicy, path_rules
from findloom.functions.scores import band
from findloom.functions.text import let, lookup, or_empty, trimmed


def label_severity(label: Column, scales=(GENERAL_SCALE,)) -> Column:
    """The first scale's severity of a label, in any case; null if none has it."""
    return let(F.lower(trimmed(or_empty(label))), lambda own: F.coalesce(*[lookup(own, s) for s in scales]))


def score_severity(score: Column) -> Column:
    """A scanner's score in version 3 bands; null outside 0..10, info for NaN."""
    return F.when(F.isnan(score), "info").when((score >= 0) & (score <= 10), band(F.lit("3.1"), score))


def score_is_bad(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & ((score < 0) | (score > 10))


def picked_cvss(cvss: Column, order=()) -> Column:
    """The CVSS score that decides: 3.x before 4.0 before 2.0, then by source order, source and vector."""
    def ranked(x: Column) -> Column:
        rank = F.when(x["version"].startswith("3"), 0).when(x["version"] == "4.0", 1).when(x["version"] == "2.0", 2).otherwise(4)
        place = F.coalesce(lookup(x["source"], {s: i for i, s in enumerate(order)}), F.lit(len(order)))
        return F.struct(rank.alias("rank"), place.alias("place"), x["source"].alias("source"), x["vector"].alias("vector"), x["base_score"].alias("score"), x["version"].alias("version"))

    return F.array_min(F.transform(cvss, ranked))


def policy_severity(policy: SeverityPolicy, label: Column, score: Column, cvss: Column) -> Column:
    """The first source that resolves; null if none does."""
    by_cvss = let(picked_cvss(cvss, policy.cvss_order), lambda one: F.when(one.isNotNull(), band(one["version"], one["score"])))
    by = {"label": label_severity(label, policy.scales), "score": score_severity(score), "cvss": by_cvss}
    return F.coalesce(*[by[s] for s in policy.sources])


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK)


def vuln_id(raw: Column, formats=VULN_FORMATS) -> Column:
    """(source, value) of an id; source unknown and the trimmed text where no format fits; null for a blank."""
    def of(v: Column) -> Column:
        out = F.when(v == "", F.lit(None).cast("struct<source:string,value:string>"))
        for f in formats:
            body = F.substring(v, F.lit(len(f.prefix) + 1), F.length(v))
            body = {"upper": F.upper(body), "lower": F.lower(body), "keep": body}[f.case]
            out = out.when(v.rlike(rf"^(?i:{f.prefix}(?:{f.body}))\z"), F.struct(F.lit(f.source).alias("source"), F.concat(F.lit(f.prefix), body).alias("value")))
        return out.otherwise(F.struct(F.lit("unknown").alias("source"), v.alias("value")))

    return let(trimmed(or_empty(raw)), of)


def _decoded(c: Column) -> Column:
    """Percent-decoded, or null if malformed; a plus stays one."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _escaped(c: Column) -> Column:
    """Every byte outside A-Z a-z 0-9 - . _ ~ : as %XX."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def purl(raw: Column) -> Column:
    """(purl, type, namespace, name, version) of a package URL in canonical form; null if it's blank or invalid."""
    empty = F.lit("")

    def of(v: Column) -> Column:
        rest = F.substring_index(F.substring(v, F.lit(5), F.length(v)), "#", 1)
        query = F.when(rest.contains("?"), F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)).otherwise(empty)
        whole = F.regexp_replace(F.substring_index(rest, "?", 1), "^/+", "")
        version = _decoded(F.when(whole.contains("@"), F.regexp_extract(whole, "(?s)^[^@]*@(.*)$", 1)).otherwise(empty))
        segments = F.split(F.substring_index(whole, "@", 1), "/")
        pairs = F.when(query == "", F.array().cast("array<string>")).otherwise(F.split(query, "&"))
        value = lambda q: _decoded(F.regexp_extract(q, "(?s)^[^=]*=(.*)$", 1))
        good = F.forall(pairs, lambda q: q.rlike("(?s)^[^=]+=") & value(q).isNotNull())
        kept = F.transform(F.filter(pairs, lambda q: value(q) != ""), lambda q: F.concat(F.lower(F.substring_index(q, "=", 1)), F.lit("="), _escaped(value(q))))
        fine = F.lower(v).startswith("pkg:") & (F.size(segments) >= 2) & F.forall(segments, lambda s: (s != "") & _decoded(s).isNotNull()) & version.isNotNull() & good

        def built(d: Column) -> Column:
            kind = F.lower(F.get(d, F.lit(0)))
            name = F.element_at(d, -1)
            name = F.when(kind.isin("npm", "golang", "deb"), F.lower(name)).when(kind == "pypi", F.replace(F.lower(name), F.lit("_"), F.lit("-"))).otherwise(name)
            space = F.array_join(F.slice(d, F.lit(2), F.size(d) - 2), "/")
            space = F.when(kind.isin("npm", "golang", "deb", "rpm"), F.lower(space)).otherwise(space)
            path = F.array_join(F.transform(F.filter(F.concat(F.split(space, "/"), F.array(name)), lambda s: s != ""), _escaped), "/")
            text = F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.when(version != "", F.concat(F.lit("@"), _escaped(version))).otherwise(empty), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(empty))
            return F.struct(text.alias("purl"), kind.alias("type"), space.alias("namespace"), name.alias("name"), version.alias("version"))

        return F.when(fine, let(F.transform(segments, _decoded), built))

    return let(trimmed(or_empty(raw)), of)


def purl_is_bad(raw: Column) -> Column:
    return (trimmed(or_empty(raw)) != "") & purl(raw).isNull()


CWE = r"(?i)cwe[-_/ :]*0*(\d+)"


def cwe_names(raw: Column) -> Column:
    """CWE-n for every number in the entries, in numeric order, each once."""
    numbers = F.flatten(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.regexp_extract_all(or_empty(x), F.lit(CWE), 1)))
    numbers = F.filter(F.transform(numbers, lambda x: x.try_cast("bigint")), lambda n: n > 0)
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


def cwe_is_bad(raw: Column) -> Column:
    """Whether an entry holds no CWE number."""
    return F.coalesce(F.exists(raw, lambda x: ~or_empty(x).rlike(CWE)), F.lit(False))


def _lexical(path: Column) -> Column:
    """Without empty and . segments, .. taken with the segment before it; nothing left: . or /."""
    rooted = path.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return (
            F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when((s == "..") & rooted, acc).otherwise(F.concat(acc, F.array(s)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def clean_path(raw: Column, prefixes=PATH_PREFIXES) -> Column:
    """Slashes forward, build folders cut from absolute paths, segments resolved; empty stays empty."""
    def stripped(v: Column) -> Column:
        def cut(segments: Column) -> Column:
            out = F.when(F.lit(False), v)
            for rule in path_rules(prefixes):
                fits = F.size(segments) > len(rule)
                for i, want in enumerate(rule):
                    fits = fits if want == "*" else fits & (F.get(segments, F.lit(i)) == want)
                out = out.when(fits, F.array_join(F.slice(segments, F.lit(len(rule) + 1), F.size(segments)), "/"))
            return out.otherwise(v)

        return F.when(v.startswith("/"), let(F.split(F.substring(_lexical(v), F.lit(2), F.length(v)), "/"), cut)).otherwise(v)

    v = F.replace(raw, F.lit("\\"), F.lit("/"))
    return F.when(or_empty(raw) == "", raw).otherwise(let(let(v, stripped), _lexical))
