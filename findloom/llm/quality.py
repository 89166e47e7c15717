"""Quality rules: line-first cleaning, then document rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm.common import SPACE, fresh, table, without

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line ends well with one of these, closing quotes and brackets after them allowed.
TERMINAL = r"[.!?:;\x{2026}][\x{22}'\x{201D}\x{2019}\x{BB})\]]*[\x20\x09-\x0D]*$"
#: Separators between the entries of a menu.
MENU = r"(^|[\x20\x09-\x0D])[|\x{BB}\x{203A}\x{2022}\x{B7}>]+([\x20\x09-\x0D]|$)"
#: A word with repeated exclamation marks, question marks or symbols after it.
NOISY = r"[^\x20\x09-\x0D]([!?]{2,}|[#*$%&|<>]{2,})([\x20\x09-\x0D]|$)"
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|terms and conditions"
    "|enable javascript|lorem ipsum|click here|sign up for our newsletter|subscribe to our newsletter|skip to content|powered by wordpress"
)
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_removed_lines", "removed_chars", "clean_text", "kept")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once though body uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(line: Column, pattern: str) -> Column:
    """Matches of a pattern, found without overlap."""
    return F.regexp_count(line, F.lit(pattern))


def line_fails(line: Column, boilerplate: str = BOILERPLATE, short_words: int = 5) -> Column:
    """The line rules: a short line without closing punctuation, a menu, marks after half of all words, or a short line of boilerplate. Lines without a word never fail."""
    def rules(n: Column) -> Column:
        return (n > 0) & (
            ((n < short_words) & ~line.rlike(TERMINAL))
            | ((_hits(line, MENU) >= 2) & (_hits(line, MENU) * 5 >= n))
            | (_hits(line, NOISY) * 2 >= n)
            | ((n <= 20) & F.lower(line).rlike(boilerplate))
        )

    return _let(F.size(F.filter(F.split(line, SPACE), lambda w: w != "")), rules)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows are compared by 64-bit hashes, sorted with their places."""
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        covered = F.flatten(F.transform(_let(pairs, again), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))

    return _let(_let(words, windows), marked)


def quality(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: int = 50) -> DataFrame:
    """docs with counts, the base verdict, the cleaned text and `kept`.

    Every line is judged first and failing ones are removed; a document is kept when it passes the base rules and the
    removed lines hold at most max_lost per cent of its word characters. A null text counts as empty: no words, base_failed, not kept,
    clean_text empty. Repeated rows are judged one by one; an empty table gives an empty result; input columns named like an output are replaced.
    Nothing is shuffled, so a very long text costs its own task only O(n log n).
    """
    docs = docs.withColumnRenamed(text, keep) if text in OUTPUTS and (keep := fresh(docs, "text")) else docs
    text = keep if text in OUTPUTS else text
    t, words, lines, fails = (fresh(docs, x) for x in ("t", "words", "lines", "fails"))
    d = without(docs, *OUTPUTS).withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    d = d.withColumns({words: F.filter(F.split(t, SPACE), lambda w: w != ""), lines: F.split(t, "\n")})
    d = d.withColumn(fails, F.transform(lines, lambda x: line_fails(x)))
    word_chars = lambda c: F.length(F.translate(c, " \t\n\x0b\x0c\r", ""))
    wordy = F.filter(lines, lambda x: word_chars(x) > 0)
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        word_chars(F.col(t)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(wordy, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(words)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(fails, lambda x: x)).cast("long").alias("n_removed_lines"),
        F.array_join(_let(F.col(fails), lambda f: F.filter(lines, lambda _, i: ~F.get(f, i))), "\n").alias("clean_text"),
    )
    # a generator: a filter on what it gives isn't pushed below it, where all words would be split again
    d = d.select(*[d[f"`{c}`"] for c in d.columns if c not in (words, lines, fails)], F.inline(F.array(counts)))
    d = d.withColumn("removed_chars", F.col("word_chars") - word_chars(F.col("clean_text")))
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_chars") <= max_lost * F.col("word_chars"))).drop(t)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *OUTPUTS[:9], "kept")


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, unnest(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) w, generate_subscripts(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) i from d),
g as (select doc_id, i, w, lead(w) over p w2, lead(w, 2) over p w3 from w window p as (partition by doc_id order by i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w, w2, w3) c from g where w3 is not null) where c > 1),
rep as (select doc_id, count(distinct i + o) n from r, (values (0), (1), (2)) v(o) group by 1),
n as (select doc_id, count(*) n, sum(length(w)) c from w group by 1),
l as (select doc_id, unnest(string_split(t, chr(10))) x from d),
m as (select doc_id, x, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) k, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) c,
  len(regexp_extract_all(x, '{MENU}')) menu, len(regexp_extract_all(x, '{NOISY}')) noisy from l),
f as (select *, k > 0 and ((k < 5 and not regexp_matches(x, '{TERMINAL.replace("'", "''")}')) or (menu >= 2 and menu * 5 >= k) or noisy * 2 >= k or (k <= 20 and regexp_matches(lower(x), '{BOILERPLATE}'))) bad from m),
s as (select doc_id, count(*) n_lines, sum(bad::int) n_removed_lines, sum(case when bad then c else 0 end) removed_chars,
  count(case when c > 0 then 1 end) - count(distinct case when c > 0 then x end) n_dup_lines from f group by 1),
a as (select d.doc_id, coalesce(n.n, 0) n_words, coalesce(n.c, 0) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, n_dup_lines, coalesce(rep.n, 0) n_repeat_words, n_lines, n_removed_lines, removed_chars
  from d left join n using (doc_id) left join rep using (doc_id) join s using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from a)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
  n_lines::bigint n_lines, n_removed_lines::bigint n_removed_lines, removed_chars::bigint removed_chars, not base_failed and 100 * removed_chars <= 50 * word_chars kept from b
"""
