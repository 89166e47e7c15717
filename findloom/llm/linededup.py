"""Line dedup: hashes of lines in ranges, sorted by document and position, and a run-length bitmap of kept lines for each document; in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findloom.llm.common import ascii_lower, fresh, saved, table, without

#: White space at both ends of a line that its key lacks.
ENDS = " \t\n\x0b\x0c\r"
#: A key's documents are spread over so many slices, each of which is a range of its own.
SLICES = 64
#: Keys in more than one of so many lines are at most as many as this, so they are broadcast; other keys are broadcast up to BROADCAST_ROWS of two numbers each.
HUBS, BROADCAST_ROWS = 10_000, 1_000_000
OUTPUTS = ("n_lines", "n_dropped", "keep_edges")


def line_key(line: Column) -> Column:
    """What makes two lines equal: the line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ENDS)))


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, own, text): a document is its id and a digest of its text, so that rows which share an id stay apart."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(_text(text)).alias("own"), _text(text).alias("text"))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """(h, g, doc, own, at) for each line whose key has min_chars code points: two hashes of the key, 128 bits together, its document and its place."""
    lines = _named(docs, doc_id, text).select("doc", "own", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "doc", "own", "at")


def repeated_keys(lines: DataFrame, min_docs: int, first: bool = False) -> DataFrame:
    """(h, g, n, docs, and with first: least) of the keys in min_docs documents or more: lines, documents and the first occurrence.

    Lines are dealt out by ranges of hash and slice and sorted by document and position, so each slice streams by: a line that isn't of the document before
    it is the document's first one with that key. A key of very many documents is in many slices; each gives one row to the sums.
    """
    order = ["doc", "own", "at"]
    w = W.partitionBy("h", "g", "slice").orderBy(*order)
    rows = lines.withColumn("slice", F.pmod(F.xxhash64("doc", "own"), F.lit(SLICES))).repartitionByRange("h", "g", "slice").sortWithinPartitions("h", "g", "slice", *order)
    again = F.lag(F.struct("doc", "own")).over(w).eqNullSafe(F.struct("doc", "own"))
    rows = rows.withColumn("again", again)
    sums = [F.count("*").alias("n"), F.count_if(~F.col("again")).alias("docs")]
    return rows.groupBy("h", "g").agg(*sums, *[F.min(F.struct(*order)).alias("least")] * first).where(F.col("docs") >= min_docs)


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """(doc, own, keep_edges) of the documents that lose a line; no text comes out.

    A key in at least min_docs documents keeps its first occurrence by doc_id and position (keep="first") or none (keep="none"). keep_edges is the document's
    bitmap of kept lines as its run edges, in ascending order: lines from edge 0 up to edge 1 go, those up to edge 2 stay, and so on; lines before edge 0 stay.
    Lines meet the keys in a broadcast where those are few, else in a shuffle that no frequent key takes part in. Only dropped lines are shuffled
    to their documents.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    lines, first = saved(occurrences(docs, doc_id, text, min_chars), "lines"), keep == "first"  # read three times, once to sample the ranges
    keys = saved(repeated_keys(lines, min_docs, first), "keys")
    n, total = keys.agg(F.count("*"), F.sum("n")).first()
    if n <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(keys), ["h", "g"])
    else:
        hub = F.col("n") > total // HUBS
        hubs, rest = F.broadcast(keys.where(hub)), keys.where(~hub)
        hit = lines.join(hubs, ["h", "g"]).unionByName(lines.join(hubs, ["h", "g"], "left_anti").join(rest, ["h", "g"]))
    if first:
        hit = hit.where(~F.col("least").eqNullSafe(F.struct("doc", "own", "at")))
    places = hit.groupBy("doc", "own").agg(F.collect_set("at").alias("at")).select("doc", "own", F.explode(F.array(F.sort_array("at"))).alias("at"))
    return places.select("doc", "own", run_edges(F.col("at")).alias("keep_edges"))


def run_edges(at: Column) -> Column:
    """The edges of the runs of an ascending list of places: where each begins, and the place after its end."""
    begins = F.filter(at, lambda x, j: ~F.coalesce(F.get(at, j - 1) == x - 1, F.lit(False)))
    ends = F.filter(at, lambda x, j: ~F.coalesce(F.get(at, j + 1) == x + 1, F.lit(False)))
    return F.flatten(F.zip_with(begins, ends, lambda a, b: F.array(a, b + 1)))


def kept_text(text: Column, edges: Column) -> Column:
    """The lines that run edges keep, joined again; null edges keep all."""
    def runs(lines: Column) -> Column:
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(edges, 2 * k - 1))
        end = lambda k: F.coalesce(F.get(edges, 2 * k), F.size(lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(edges) / 2).cast("int")), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k))))

    out = F.element_at(F.transform(F.array(F.split(text, "\n")), runs), 1)  # split once
    return F.when(edges.isNull(), text).otherwise(F.array_join(out, "\n"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """docs with n_lines, n_dropped, keep_edges (null: nothing dropped) and the text that is left in `text`.

    A null or empty text is one empty line; lines without min_chars code points in their keys always stay. Rows of one doc_id with different texts are
    different documents, repeated rows count as one and lose the same lines; a null doc_id is one like any other and comes first. Input columns named like
    an output are replaced; an empty table gives an empty result. A very long text is one row, and its places are sorted in its own group.
    """
    docs = docs.withColumnRenamed(doc_id, "doc_id_") if doc_id in OUTPUTS and "doc_id_" not in docs.columns else docs
    doc_id = doc_id if doc_id in docs.columns else "doc_id_"
    maps = line_bitmaps(docs, doc_id, text, min_docs, min_chars, keep)
    doc, own = fresh(docs, "doc"), fresh(docs, "own")
    maps = maps.select(F.col("doc").alias(doc), F.col("own").alias(own), F.col("keep_edges").alias(edges := fresh(docs, "edges")))
    d = docs.join(maps, docs[f"`{doc_id}`"].eqNullSafe(maps[doc]) & (F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))) == maps[own]), "left").drop(doc, own)
    t, e = _text(text), F.col(edges)
    dropped = F.aggregate(F.coalesce(e, F.array().cast("array<int>")), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"])
    counts = {"n_lines": F.size(F.split(t, "\n")).cast("long"), "n_dropped": dropped, "keep_edges": e}
    text = text if text not in OUTPUTS else "text"
    rest = without(d.withColumn(left := fresh(d, "left"), kept_text(t, e)).withColumns({f"{left}{k}": v for k, v in counts.items()}), *OUTPUTS, text, edges)
    names = {f"{left}{k}": k for k in counts}
    return rest.select(*[F.col(f"`{c}`").alias(text if c == left else names.get(c, c)) for c in rest.columns])


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, min_docs=10, keep="none").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents),
l as (select doc_id, unnest(x) x, generate_subscripts(x, 1) i from s),
k as (select doc_id, x, i, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
hot as (select k from k where k <> '' group by k having count(distinct doc_id) >= 10),
m as (select doc_id, x, i, k in (select k from hot) gone from k)
select doc_id, count(*)::bigint n_lines, count(case when gone then 1 end)::bigint n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) kept_sha256 from m group by 1
"""
