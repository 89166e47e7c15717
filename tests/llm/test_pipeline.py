"""The pipeline's stages against what each should do with its input."""

from findloom.llm import pii, tokens


def test_stages(spark):
    import corpus_pipeline as cp
    import public_tokenizers

    clean = [" ".join(f"{c}{k}{i}" for i in range(80)) + "." for k, c in enumerate("abcdefgh")]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate([*clean, clean[0], "short", None, clean[3] + " mail a.b@c.org now."])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in cp.STAGES:
        before, d = d, stage(spark, d, "")
        out[name] = d.collect()
        if name != cp.STAGES[-1][0]:
            assert tuple(d.columns) == cp.COLUMNS
        d = spark.createDataFrame(out[name], d.schema)
    assert sorted(r["doc_id"] for r in out["quality rules"]) == [*range(9), 11]
    assert sorted(r["doc_id"] for r in out["MinHash near-dedup"]) == list(range(8))
    assert all(r["text"] == pii.masked(r["text"], pii.spans_of(r["text"])) for r in out["PII"])
    t = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in out["mixing sources"]}
    assert all(list(r["ids"]) == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in out["BPE encoding"])
    assert len(out["BPE encoding"]) == len(out["mixing sources"])


def test_neardup_stage_by_text(spark):
    """Null and shared doc_ids name no document: distinct texts stay, copies go, and each is compared on its own text."""
    import corpus_pipeline as cp

    a, b, c, e, f = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcef")
    near = lambda t: t + " end"
    rows = [(None, a), (None, b), (None, near(b)), (3, c), (7, near(c)), (7, e), (7, f), (7, f), (9, None), (9, " "), (8, near(e))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.neardup_stage(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (3, c), (7, e), (7, f), (9, None), (9, " ")], key=str)


def test_run_by_brute_force(spark, tmp_path):
    """run() over a table with junk, short, null, repeated and near documents, against plain Python for each stage."""
    import hashlib
    import math

    import corpus_pipeline as cp
    import public_tokenizers

    sentence = lambda tag, n: " ".join(f"{tag}word{i}" for i in range(n)) + "."
    good = [sentence(c, 40 + k) for k, c in enumerate("abcdefghij")]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(good)]
    rows += [(20, good[3] + " more.", "en", "s1", 1), (21, good[4], "en", "s0", 1), (None, good[5], "en", "s0", 1), (22, "Short but clean.", "en", None, 1), (22, sentence("other", 60), "en", "s2", 1)]
    rows += [(30, None, "en", "s0", 1), (31, "", "en", "s0", 1), (32, "menu | home | about | contact | more\n" * 9, "en", "s1", 1), (33, sentence("mail", 50) + " write to a.b@c.org now.", "en", "s1", 1)]
    rows += [(34, "home\n" + sentence("line", 60) + "\nabout", "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumnRenamed("n_chars", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["source"], list(r["ids"])) for r in cp.run(spark, str(tmp_path)).collect()]

    kept = [r for r in rows if r[0] not in (30, 31, 32)]
    kept = [(i, t if i != 34 else sentence("line", 60), s) for i, t, _, s, _ in kept]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    first = []
    for i, t, s in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        a = shingles(t)
        if not any(len(a & b) >= 0.8 * len(a | b) for b in map(shingles, (x[1] for x in first))):
            first.append((i, t, s))
    masked = [(i, pii.masked(t, pii.spans_of(t)), s) for i, t, s in first]
    size: dict = {}
    for _, t, s in masked:
        size[s] = size.get(s, 0) + len(t)
    weight = {s: n**0.5 for s, n in size.items()}
    t = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, s in masked:
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u, n, below = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        p = below
        while below <= u:
            n += 1
            p *= rate / n
            below += p
        want += [(i, s, t.encode(text, add_special_tokens=False).ids)] * n
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 5


def test_empty_run(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
