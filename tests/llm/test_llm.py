"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import cProfile
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findloom.llm import bpe, graph, licenses, mixing, neardup, pii, quality, substrings, tokenfiles, tokens, urls, vectors

tok = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, kept string, copy string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in texts], DOCS)


TEXTS = [(0, None), (1, ""), (2, " \n\t"), (3, "word"), (4, "one two three four five six seven eight. " * 9), (5, "one two three four five six seven eight. " * 9), (5, "one two three four five six seven eight. " * 9), (6, "é日本 mail a.b@c.org, +1 (988) 555-2485, 4111 1111 1111 1111, 1.2.3.4"), (7, "x" * 5000)]


def test_quality(spark):
    rows = {r["doc_id"]: r for r in quality.quality(docs(spark, TEXTS + [(8, "menu | home | about | contact | more\n" * 30), (9, "All good words stand here in one line. " * 20)])).collect()}
    assert not rows[0]["kept"] and rows[0]["n_words"] == 0 and rows[3]["base_failed"]
    assert rows[4]["n_repeat_words"] == 72 and rows[4]["base_failed"]
    assert rows[8]["n_removed_lines"] == 30 and not rows[8]["kept"] and rows[9]["n_lines"] == 1
    assert quality.quality(docs(spark, [])).count() == 0
    assert quality.quality(docs(spark, [(1, " ".join(f"word{i}" for i in range(300)) + ".")])).where("kept").select("clean_text").count() == 1


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTPS://WWW.Example.com/en/x?q"), (2, "http://a.example.com/en/"), (3, "http://x.net/es/1"), (3, "http://x.net/es/1"), (4, None), (5, "nothing"), (6, "http://y.com"), (7, "http://z.net/de/"), (8, "a://b://c.net/es/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow")}
    assert urls.filter_urls(pages, urls.rule_table(spark, [("x", "y")]).limit(0)).count() == 9
    old, urls.BROADCAST_RULES = urls.BROADCAST_RULES, 0
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.rule_table(spark, urls.RULES)).collect()} == got
    urls.BROADCAST_RULES = old


def test_mixing(spark):
    d = spark.createDataFrame([(i, "abcd", "big" if i % 10 else "small") for i in range(3000)] + [(9999, None, None)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    rates = mixing.source_rates(d, w)
    out = mixing.mix(d, rates)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 1500) < 200 and set(n) == {"big", "small"}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(d.repartition(7), rates).collect()))
    old, mixing.BROADCAST_BYTES = mixing.BROADCAST_BYTES, 0
    assert out.count() == mixing.mix(d, rates).count()
    mixing.BROADCAST_BYTES = old
    assert mixing.mix(d.limit(0), mixing.source_rates(d.limit(0))).count() == 0


def test_poisson_cdf(spark):
    """Small and very large rates against sums of exact weights."""
    rates = {"a": 0.01, "b": 1.0, "c": 7.5, "d": 250.0, "e": 40_000.0}
    got = {r["source"]: r for r in mixing.poisson_cdf(spark.createDataFrame(list(rates.items()), "source string, rate double")).collect()}
    for source, rate in rates.items():
        first, cdf = got[source]["first"], got[source]["cdf"]
        k = range(max(0, first - 50), first + len(cdf))
        want = np.cumsum([math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in k])[first - k[0] :]
        assert len(cdf) < 24 * rate**0.5 + 70 and np.abs(np.array(cdf) - want).max() < 1e-7 and cdf[-1] == 1.0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    r = random.Random(1)
    texts = [t for _, t in TEXTS] + ["<|endoftext|> Σας İ ½² \x1c\x85\xa0 don't 'S"] + ["".join(r.choice("a'stdrvelm AZ09_.,!\n\t é×ßĳ—日Я") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    t = tokens.tokenizer(tok.path(name))
    assert tokens.Encoder(tok.path(name)).encode(pa.array(texts)).to_pylist() == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bpe_tree_and_decode(spark):
    """Encode, decode and digests against the library: long texts with and without spaces, null and shared doc_ids, a clashing ids column, an empty table."""
    path = tok.path("word_bpe_49k.json")
    t = tokens.tokenizer(path)
    r = random.Random(5)
    texts = TEXTS + [(10, "abetter" * 400 + " don't 's é"), (11, "a b" * 999), (11, "a b" * 999), (None, "".join(r.choice("abcde") for _ in range(3000))), (None, "9" * 2000)]
    d = spark.createDataFrame([(i, x, "clash", "clash") for i, x in texts], "doc_id long, text string, ids string, decoded string")
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in texts]
    got = bpe.decode(bpe.encode(d, path, piece=300), path).collect()
    told = lambda ids: t.decode(ids, skip_special_tokens=False)
    assert sorted(((x["doc_id"], list(x["ids"]), x["decoded"]) for x in got), key=str) == sorted(((i, ids, told(ids)) for i, ids in want), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [tuple(x) for x in bpe.digests(d, path, piece=300).collect()]
    assert sorted(rows, key=str) == sorted(((i, len(ids), sha(" ".join(map(str, ids))), sha(told(ids))) for i, ids in want), key=str)
    assert bpe.digests(d.limit(0), path).count() == bpe.encode(d.limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_joins_inside_a_run(name):
    """Halves of long runs of letters or digits, joined by windows that start and end inside them."""
    path, r, inside = tok.path(name), random.Random(8), 0
    t = tokens.tokenizer(path)
    ids = lambda x: np.array(t.encode(x, add_special_tokens=False).ids)
    for k in range(300):
        x = "".join(r.choice("0123456789" if k % 4 == 0 else "abcdefghijklmnopqrstuvwxyz"[: r.choice([2, 5, 26])]) for _ in range(r.randint(150, 500)))
        at = r.randint(1, len(x) - 1)
        assert bpe.join(path, x[:at], ids(x[:at]), x[at:], ids(x[at:]), 8).tolist() == ids(x).tolist()
        inside += bpe.join_inside(path, x[:at], ids(x[:at]), x[at:], ids(x[at:]), 32) is not None
    assert inside > 150


def test_token_files(spark, tmp_path):
    path = tok.path("byte_bpe_50k.json")
    t = tokens.tokenizer(path)
    texts = TEXTS + [(None, "no id"), (None, "none either, but longer"), (None, None), (4, "the same id")]
    m = tokenfiles.write_tokens(docs(spark, texts), path, f"file://{tmp_path}/t", length=64)
    got = [tuple(r) for r in tokenfiles.read_tokens(m).orderBy("start").collect()]
    starts, keys, want = [r[1] for r in got], [-1 if r[0] is None else r[0] for r in got], []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert keys == sorted(keys) and starts == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    s = tokenfiles.Sequences(m.orderBy("file").first()["path"] + ".arrows")
    ids, mask = s[0]
    assert ids.shape == (64,) and mask.shape == (8,) and not ids.flags.owndata and not mask.flags.owndata and not ids.flags.writeable and len(s) > 0
    assert sum(tokenfiles.unmasked(s[i][1]).sum() for i in range(len(s))) == m.orderBy("file").first()["n_ids"]
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(docs(spark, []), path, f"file://{tmp_path}/e")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    for g in range(6):
        base = [r.choice(words) for _ in range(r.randint(6, 150))]
        for _ in range(8):
            texts.append((100 + len(texts), " ".join(base)))
            base = list(base)
            base[r.randrange(len(base))] = "new" + str(len(texts))
    texts += [(None, None), (None, "a null id"), (7, "another text under a shared id"), (None, texts[-1][1] + " more")]
    old = neardup.REACH, neardup.GROUP, neardup.BLOCK
    for neardup.REACH, neardup.GROUP, neardup.BLOCK in (old, (2, 4, 3)):  # whole groups, and groups in blocks
        got = [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(docs(spark, texts), words=4).collect()]
        assert sorted(got, key=str) == sorted(brute_groups(texts), key=str)
    neardup.REACH, neardup.GROUP, neardup.BLOCK = old
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def brute_groups(texts):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least[find(i)], 1 << 60 if d is None or not sets[i] else d)
    name = lambda i, d: d if not sets[i] or least[find(i)] == 1 << 60 else least[find(i)]
    return [(d, len(sets[i]), name(i, d), d == name(i, d)) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("small", [200_000, 0])
def test_components_with_hubs(spark, small, monkeypatch):
    """A star whose centre isn't its smallest node, a chain, loops and nulls, with minima broadcast and with hubs apart."""
    monkeypatch.setattr(graph, "SMALL", small)
    monkeypatch.setattr(graph, "HUB", 5)
    edges = [(100, 200 + i) for i in range(50)] + [(1, 207)] + [(500 + i, 501 + i) for i in range(30)] + [(9, 9), (None, 4)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: 1 for x in (1, 100, *range(200, 250))} | {x: 500 for x in range(500, 531)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_collision_correction():
    a, b = neardup.shingles(b" ".join(b"%d" % i for i in range(3000)), 1), neardup.shingles(b" ".join(b"%d" % i for i in range(600, 3600)), 1)
    e = neardup.estimate(neardup.registers(a), neardup.registers(b)[None])[0]
    assert abs(e - 2400 / 3600) < 0.12 and neardup.estimate(neardup.registers(a), neardup.registers(a)[None])[0] == 1


def test_vectors(spark):
    r = np.random.default_rng(3)
    rows, base = [], r.normal(size=(40, 16))
    for i in range(400):
        rows.append((i, (base[i % 40] + r.normal(size=16) * 0.1 * (i % 5)).tolist(), i % 3 if i % 50 else None))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[1][1], 1), (404, rows[1][1], 1), (405, [1.0], 1), (406, [None] * 16, 1)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    fine = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[k][1] for k in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([rows[k][2] for k in fine])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(hit, False)
    found = sum(got[rows[k][0]][0] for k in fine)
    assert 0.9 * hit.sum() <= found <= hit.sum() and all(got[rows[k][0]][0] <= n for k, n in zip(fine, hit.sum(1)))
    assert [got[i] for i in (400, 401, 402, 405, 406)] == [(0, i) for i in (400, 401, 402, 405, 406)] and got[403][1] == got[404][1] == got[1][1] <= 1
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_at_the_threshold(spark):
    """Two dense groups at about the least cosine and a bridge out of range: every pair is judged by its cosine alone; text labels."""
    r, e = np.random.default_rng(1), np.eye(16)
    one, two = e[0], 0.93 * e[0] + (1 - 0.93**2) ** 0.5 * e[1]
    bridge = 0.8 * (one + two) / np.linalg.norm(one + two) + 0.6 * e[2]
    x = np.concatenate([c + r.normal(size=(k, 16)) * 0.002 for c, k in ((one, 100), (two, 100), (bridge, 10))])
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), "a label") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.93
    assert {g["vec_id"]: g["n_links"] for g in got} == dict(enumerate((hit.sum(1) - 1).tolist()))


@pytest.mark.parametrize("cell", [8192, 400])
def test_vectors_of_sparse_pairs(spark, cell, monkeypatch):
    """A hot group and few pairs in random directions, in many shards, and in cells that overlap: neither group's recall stands for the other's."""
    monkeypatch.setattr(vectors, "SHARD", 128)
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "FAN", 8)
    r = np.random.default_rng(5)
    x = r.normal(size=(2200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1000] = x[0] + r.normal(size=(1000, 64)) * 0.005
    x[2000:] = 0.94 * x[1000:1200] + 0.34 * x[1200:1400]
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth, links = (x @ x.T >= 0.93).sum(1) - 1, {g["vec_id"]: g["n_links"] for g in got}
    assert truth[1000:].sum() > 300 and all(links[i] <= truth[i] for i in range(2200))
    for part in (range(1000), range(1000, 2200)):
        assert sum(links[i] for i in part) >= 0.98 * truth[part].sum()


def test_flat_graph():
    """One graph over overlapping shards finds neighbours beyond a query's own shards, and searches go on through a group larger than the beam."""
    r = np.random.default_rng(7)
    x = r.normal(size=(150, 32))[r.integers(0, 150, 3000)] + r.normal(size=(3000, 32)) * 0.2
    x[:400] = x[0] + r.normal(size=(400, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.flat_graph(x, 3, np.random.default_rng(0))
    begin, near, medoids = graph
    assert len(medoids) > 4 and (np.diff(begin) > 0).all() and np.diff(begin).mean() < 200
    hits, truth = vectors.range_search(x, graph, 0.93, vectors.BEAM), x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    assert not (hits & ~truth).any() and (hits & truth).sum() >= 0.97 * truth.sum() and (hits == hits.T).all()


def brute_repeats(texts):
    none, first, want = 1 << 62, {}, []
    for d, t in texts:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], none), none if d is None else d)
    for d, t in texts:
        b = (t or "").encode()
        gone = {j + k for j in range(len(b) - 49) if first[b[j : j + 50]] < (none if d is None else d) for k in range(50)}
        want.append((d, len(b), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(bytes(c for j, c in enumerate(b) if j not in gone)).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_substrings(spark, hot, monkeypatch):
    """Shared and null doc_ids, copies, long runs of one letter; grams that are hot and such that aren't."""
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(4)
    passages = ["".join(r.choice("abcde fghij") for _ in range(130)) for _ in range(3)]
    texts = TEXTS + [(7, "yy" + "x" * 60), (2, passages[0] + "Y" * 3), (2, "unrelated text that no other document has at all, more than fifty bytes")]
    for k in range(40):
        p, a = r.choice(passages), r.randint(0, 60)
        texts.append((r.choice([None, None, 5, 9, 20 + k]), f"{r.random()} {p[a : a + r.randint(40, 70)]} {r.random()} {r.choice(passages)[: r.randint(0, 130)]}"))
    texts += [texts[-1], (1000, texts[-3][1]), (None, texts[-4][1])]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in substrings.remove_repeats(docs(spark, texts)).collect()]
    assert sorted(got, key=str) == brute_repeats(texts)


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0
    text = ("one two three " + "x" * 80).encode()
    found = substrings.first_holders([text, text[5:]], np.array([7, 3]), 50)
    assert found[0].tolist() == [7] * 5 + [3] * (len(text) - 54) and set(found[1].tolist()) == {3}


def test_substrings_of_one_letter(spark):
    """Runs of one byte or of two, whose gram may be any hash, also one with its highest bit set."""
    units = [chr(c) for c in range(1, 128)] + ["ab", "=-", "é", " \n"]
    texts = [(i + k * 1000, f"{k}{u * 60}{i}"[: 60 + 20 * k]) for i, u in enumerate(units) for k in (0, 1)]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in substrings.remove_repeats(docs(spark, texts)).collect()]
    assert sorted(got, key=str) == brute_repeats(texts)


@pytest.mark.parametrize("seed", range(2))
def test_substrings_in_pieces(spark, seed, monkeypatch):
    """Texts of short periods and shared passages with pieces, segments, blocks and long stretches of a few bytes."""
    r = random.Random(seed)
    for name, few in (("SEGMENT", 64), ("PIECE", 300), ("BLOCK", 100), ("LONG", 7), ("HOT", 3 if seed else 10_000)):
        monkeypatch.setattr(substrings, name, few)
    unit = lambda: "".join(r.choice("aé b") for _ in range(r.choice([1, 2, 5, 17, 40])))
    passages = ["".join(r.choice("aé b") for _ in range(200)) for _ in range(3)] + [unit() * 90 for _ in range(3)]
    texts = [(1, None), (2, "")]
    for k in range(100):
        a = r.randint(0, 100)
        texts.append((r.choice([k, k, 5, None, -k]), "".join(r.choice([r.choice(passages)[a : a + r.randint(10, 150)], unit() * r.randint(1, 60), str(r.random())]) for _ in range(r.randint(0, 6)))))
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in substrings.remove_repeats(docs(spark, texts)).collect()]
    assert sorted(got, key=str) == brute_repeats(texts)


def test_substrings_are_judged_in_blocks():
    """Work on a shard's stretches is by columns: few Python calls for each row, whether stretches are equal, alone or neither."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(84)) for _ in range(500)]
    rows = sorted((s, 10_000 + i, i, 7, words[s][(a := r.choice([0, 0, 9, r.randint(0, 20)])) : a + 64].encode()) for i in range(20_000) for s in [r.randrange(500)])
    schema = pa.schema([("shard", pa.int64()), ("who", pa.int64()), ("rank", pa.int64()), ("first", pa.int64()), ("context", pa.binary())])
    batches = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema).to_batches(max_chunksize=3000)
    calls = cProfile.Profile()
    out = calls.runcall(lambda: list(substrings._judge(50)(iter(batches))))
    assert sum(x.callcount for x in calls.getstats()) < len(rows)
    least, want, got = {}, set(), set()
    for _, _, rank, _, c in rows:
        for j in range(15):
            least[c[j : j + 50]] = min(rank, least.get(c[j : j + 50], rank))
    for _, who, rank, first, c in rows:
        want |= {(who, first + j, least[c[j : j + 50]]) for j in range(15) if least[c[j : j + 50]] < rank}
    for b in out:
        got |= {(x["who"], x["first"] + j, x["holder"]) for x in b.to_pylist() for j in range(x["n"])}
    assert got == want


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def test_pii(spark):
    def brute(t):
        out = []
        for kind, p in BASE:
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                    out.append((kind, *m.span()))
        return out

    r = random.Random(6)
    for _ in range(20000):
        t = "".join(r.choice(["4111111111111111", "4111 1111", "1.2.3.4", ".", " ", "-", "a.b@c.d", "@", "+1 (9", "8) 555-2485", "x", "0"]) for _ in range(r.randint(0, 10)))
        assert [s for s in pii.spans_of(t) if s[0] in pii.KINDS[:4]] == brute(t)
    kinds = [s[0] for s in pii.spans_of('password=b7db7aa4a5fc IBAN: DE89 3704 0044 0532 0130 00 http://bob:pw@h.org/x')]
    assert kinds == ["email", "login", "account", "secret"]
    rows = {x["doc_id"]: x for x in pii.find_pii(docs(spark, TEXTS)).collect()}
    assert rows[0]["spans"] == [] and [s["kind"] for s in rows[6]["spans"]] == ["email", "ip", "card", "phone"]
    assert pii.mask_pii(docs(spark, TEXTS)).where("doc_id = 6").first()["text"].startswith("é日本 mail [EMAIL], [PHONE]")


def test_clashing_names_and_empty_tables(spark):
    """Input columns named as an operator's outputs are replaced; empty tables give empty ones with the same columns."""
    d = docs(spark, TEXTS).withColumn("spans", F.lit("clash"))
    rows = {x["doc_id"]: x["spans"] for x in pii.find_pii(d).collect()}
    assert len(rows[6]) == 4 and rows[0] == [] and pii.find_pii(d.limit(0)).count() == pii.mask_pii(d.limit(0)).count() == 0
    assert {x["doc_id"]: x["text"] for x in pii.mask_pii(d).collect()}[0] is None
    p = spark.createDataFrame([("http://x.net/es/1", "clash", "clash", "clash", "clash"), (None, "h", "p", "r", "v")], "url string, host string, path string, rule string, verdict string")
    got = urls.filter_urls(p, urls.rule_table(spark, urls.RULES))
    assert sorted(got.columns) == ["host", "path", "rule", "url", "verdict"] and {(r["host"], r["rule"], r["verdict"]) for r in got.collect()} == {("x.net", "net/es/", "block"), ("", None, "allow")}
    assert urls.filter_urls(p.limit(0), urls.rule_table(spark, urls.RULES)).count() == urls.filter_urls(p.limit(0), urls.rule_table(spark, [])).count() == 0
    any_host = urls.rule_table(spark, [("", "block")])
    assert {r["verdict"] for r in urls.filter_urls(p, any_host).collect()} == {"block"}
    q = docs(spark, TEXTS).withColumn("n_words", F.lit("clash")).withColumn("clean_text", F.lit("clash"))
    assert {r["doc_id"]: r["n_words"] for r in quality.quality(q).collect()}[3] == 1


def test_pii_account_forms():
    """Qualifiers in any case, words in capitals after an IBAN, and dotted chains of very many zeros."""
    for cue in ("Account Number: ", "Account No. ", "ACCOUNT NUMBER: ", "account number: "):
        assert pii.spans_of(cue + "12345678") == [("account", len(cue), len(cue) + 8)]
    for cue in ("pAsSwOrD = ", "Access_Key: ", "İ Kontonummer ", "SOCIAL SECURITY number: "):
        assert [(k, b - a) for k, a, b in pii.spans_of(cue + "12345678")] == [("secret" if cue[0] in "pA" else "account", 8)]
    value = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC: X", " BIC COBADEFFXXX", " or so", "."):
        assert pii.spans_of(f"IBAN: {value}{after}") == [("account", 6, 6 + len(value))]
    for wrong in ("IBAN: DE88 3704 0044 0532 0130 00 BIC: X", f"IBAN: {value}X"):
        assert pii.spans_of(wrong) == []
    assert pii.spans_of("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)] and pii.spans_of("1.2.3.000256") == []


def test_licenses(spark):
    texts = TEXTS + [(30, "a\nReleased under the MIT License.\nb"), (31, "Released under the MIX License."), (32, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,\nprovided that the copyright notice and this permission notice appear in all copies."), (None, "All rights reserved.")]
    d = docs(spark, texts).withColumn("licenses", F.lit("clash"))
    rows = {x["doc_id"]: [(s["license"], s["differences"]) for s in x["licenses"]] for x in licenses.scan_licenses(d).collect()}
    assert rows[30] == [("MIT", 0)] and rows[31] == [] and rows[32] == [("ISC", 1)] and rows[0] == [] and rows[None] == [("Proprietary", 0)]
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_licenses_by_brute_force():
    """Notices with changed words, wrapped as comments, in noise: every template on every stretch, without cues, blocks or compression."""
    r = random.Random(9)
    templates = [(name, [w.lower() for w in licenses.WORD.findall(t)], t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    assert all(licenses.CUES.search(t) for _, _, t in templates)

    def least(a, block):
        row = [0] * (len(block) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(block, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    for k in range(60):
        name, words, text = templates[k % len(templates)]
        parts = text.split()
        changes = r.randint(0, int(0.12 * len(words))) if len(words) > 10 else r.randint(0, 1)
        for _ in range(changes):
            parts[r.randrange(len(parts))] = f"new{r.randint(0, 99)}"
        noise = [" ".join(f"n{r.randint(0, 300)}" for _ in range(r.randint(0, 60))) for _ in range(2)]
        lines, width = [], r.choice([30, 60, 79, 1000])
        for w in [*noise[0].split(), *parts, *noise[1].split()]:
            if lines and len(lines[-1]) + len(w) < width:
                lines[-1] += " " + w
            else:
                lines.append(r.choice(["# ", " * ", "// "]) + w)
        whole = "\n".join(lines)
        block = [w.lower() for w in licenses.WORD.findall(whole)]
        fits = {}
        for other, own, _ in templates:
            n = least(own, block)
            if n <= (0 if len(own) <= 10 else int(0.1 * len(own))):
                fits.setdefault(len(own), set()).add((other, n))
        got = licenses.license_spans(whole)
        assert bool(got) == bool(fits and licenses.CUES.search(whole))
        if got:
            fewest = min(n for _, n in fits[max(fits)])
            assert any((s[0], s[4]) in fits[max(fits)] and s[4] == fewest for s in got)
