"""Line dedup, Merkle manifests and hard negatives against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from findloom.llm import linededup, merkle, negatives

ENDS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def lines_by_hand(rows, least, keep):
    key = lambda x: x.strip(ENDS).translate(UP)
    known = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    at = collections.defaultdict(list)
    for d in known:
        for k, x in enumerate(d[2].split("\n")):
            at[key(x)].append((d, k))
    hot = {k: v for k, v in at.items() if k and len({d for d, _ in v}) >= least}
    out = []
    for i, t in rows:
        d = (i is not None, i or 0, t or "")
        x = d[2].split("\n")
        gone = [key(y) in hot and not (keep == "first" and (d[:2], k) == (hot[key(y)][0][0][:2], hot[key(y)][0][1])) for k, y in enumerate(x)]
        out.append((i, len(x), sum(gone), "\n".join(y for y, g in zip(x, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("few", [True, False])
def test_line_dedup(spark, keep, few):
    rng = random.Random(5)
    pool = ["Same line", " same LINE\t", "", "  ", "other", "É line", "é line", "x" * 3000, *[f"line {i}" for i in range(30)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "same line\nalone"), (103, "same line\n" * 500 + "end"), (104, "other"), (104, "other"), (105, "word\n" * 2000)]
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "doc_id long, text string, n_lines int, keep_edges string, doc int").repartition(5)
    old = linededup.BROADCAST_ROWS, linededup.HUBS
    if not few:
        linededup.BROADCAST_ROWS, linededup.HUBS = 0, 20
    out = linededup.drop_lines(df, min_docs=4, keep=keep)
    assert sorted(out.columns) == ["doc", "doc_id", "keep_edges", "n_dropped", "n_lines", "text"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()]
    linededup.BROADCAST_ROWS, linededup.HUBS = old
    assert sorted(got, key=str) == lines_by_hand(rows, 4, keep)
    assert linededup.drop_lines(df.limit(0), min_docs=4, keep=keep).count() == 0


def test_run_edges(spark):
    rng = random.Random(2)
    for _ in range(5):
        at = sorted(rng.sample(range(12), rng.randint(0, 12)))
        text = "\n".join(map(str, range(12)))
        df = spark.createDataFrame([(at, text)], "at array<int>, t string")
        left = df.select(linededup.kept_text(F.col("t"), linededup.run_edges(F.col("at")))).first()[0]
        assert left == "\n".join(str(i) for i in range(12) if i not in at)
    assert spark.range(1).select(linededup.kept_text(F.lit("a\nb"), F.lit(None).cast("array<int>"))).first()[0] == "a\nb"


def tree(digests):
    """(root, path of each as (place, siblings))."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, merged = [], []
        for at in range(0, len(digests), 16):
            run = digests[at : at + 16]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(H("".join(run)))
            merged.append([i for g in groups[at : at + 16] for i in g])
        digests, groups = up, merged
    return digests[0], paths


def manifest_by_hand(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(f(v) for v in r))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own, tops = {}, []
    for s in names:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in ordered])
        own[s] = (top, ordered, paths)
        tops.append(top)
    root, upper = tree(tops)
    out = []
    for s, up in zip(names, upper, strict=True):
        top, ordered, paths = own[s]
        for r, p in zip(ordered, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], r[4].translate(UP) if r[4] is not None else None)) if bad else leaf(r)
            for k, others in p + up:
                node = H("".join([*others[:k], node, *others[k:]]))
            out.append((r[0], leaf(r), top, root, H("".join(x for _, others in p + up for x in others)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_merkle(spark, levels, tmp_path):
    rng = random.Random(3)
    source = lambda i: rng.choice([None, "", "a", "é", "Z", "only"]) if i % 3 else "hot"
    rows = [(i, "alone" if i == 7 else source(i), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "Text A", "lower", "日本 X"])) for i in range(900)]
    rows += [(None, "hot", None, None, "x"), (5, "hot", "en", 1, "same"), (5, "hot", "en", 1, "same"), *[(1000 + i, f"s{i}", "en", 1, "T") for i in range(40)]]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    old = merkle.LEVELS, merkle.BLOCK
    merkle.LEVELS, merkle.BLOCK = levels, 16**levels
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert merkle.manifest(none).count() == 0
    merkle.LEVELS, merkle.BLOCK = old
    assert sorted(got, key=str) == manifest_by_hand(rows)


def test_merkle_one_row(spark):
    df = spark.createDataFrame([(1, None, None, None, None, 9)], "doc_id long, source string, lang string, n_chars long, text string, leaf int")
    (r,) = merkle.manifest(df).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == H("1:1----") and r["path"] == []


def negatives_by_hand(rows, positives=5, k=10):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    v = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in x]) for i, x, label in rows if label is not None and i is not None and ok(x)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for n, (a, label, x) in enumerate(v):
        if a % 100:
            continue
        scored = [(-dot(x, y), i, other) for m, (i, other, y) in enumerate(v) if m != n and len(y) == len(x)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            hits = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:k]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 8192])
def test_hard_negatives(spark, block):
    rng = random.Random(11)
    near = lambda c: [x + rng.gauss(0, 0.2) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, near(rng.choice(centres)) if i % 4 else [round(rng.gauss(0, 1)) / 4 for _ in range(6)], rng.choice([0, 1, 2])) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, -1.0, 2.0], i % 2) for i in range(60)] + [(1100, [0.0] * 6, 0), (1101, [0.0] * 6, 1), (1200, [], 1), (1201, [], 1), (1202, [], 2)]
    rows += [(1300, None, 1), (1301, [1.0] * 6, None), (1302, [1.0] * 5 + [None], 1), (1303, [float("nan")] + [1.0] * 5, 1), (1400, [1.0, 2.0, 3.0], 1), (1401, [1.0, 2.0, 3.5], 1), (1402, [1.0, 1.0, 1.0], 2), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame([(i, x, c, "clash") for i, x, c in rows], "vec_id long, embedding array<double>, label int, score string").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    old, negatives.BLOCK = negatives.BLOCK, block
    mine = lambda d: negatives.hard_negatives(d, F.col("vec_id") % 100 == 0, relabel=label)
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in mine(df).collect()]
    negatives.BLOCK = old
    assert sorted(got) == negatives_by_hand(rows) and len(got) > 200
    assert mine(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        mine(spark.createDataFrame([(1, [1e30], 1, "x")], df.schema))


def test_bounds_hold(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-300, 300, (80, 8)), np.repeat(rng.integers(-9, 9, (1, 8)), 20, 0) * np.arange(20)[:, None]])
    norms, refs = np.sqrt((x * x).sum(1).astype(float)), x[:5] / np.sqrt((x[:5] ** 2).sum(1, keepdims=True))
    angles = negatives._angles(x.astype(float), norms, refs)
    least, most = negatives.bounds(angles, norms, angles, norms)
    true = negatives.scores(x, x)
    assert (least <= true).all() and (true <= most).all() and (true == (x @ x.T)).all()
    assert ((most - least)[:5] <= 5 + 2e-2 * norms[:5, None] * norms[None, :]).all()  # a reference's own scores are known


def test_pii_in_linear_time():
    import time

    from findloom.llm import pii

    began = time.time()
    for text in ("account" + " " * 200_000, "token=" * 30_000, "token:" + " " * 200_000 + "x", "+1" + " " * 200_000, "a@" * 50_000, "a://" * 50_000, "1." * 100_000, "iban: " * 30_000, "password password=" * 20_000):
        assert not [s for s in pii.spans_of(text) if s[0] in ("account", "secret", "phone", "email", "login")]
    assert time.time() - began < 10
    text = "password=my_secret_token: abcd1234efgh, account no. 12345678; account  :  87654321"
    assert [text[a:b] for k, a, b in pii.spans_of(text) if k in ("account", "secret")] == ["12345678", "87654321", "abcd1234efgh"]


def test_sparse_links_of_50_000_vectors(spark, monkeypatch, tmp_path):
    """Few links in random directions, in cells that overlap: the graph's searches find them, the exact blocks are never used."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from findloom.llm import vectors

    def refused(*_):
        raise AssertionError("the graph wasn't enough")

    monkeypatch.setattr(vectors, "_exact_search", refused)
    r = np.random.default_rng(5)
    x = r.normal(size=(50_000, 32)).astype(np.float32)
    x[49_000:] = x[:1000] + r.normal(size=(1000, 32)).astype(np.float32) * 0.25
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 32).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": lists, "label": np.zeros(50_000, np.int32)}), f"{tmp_path}/v.parquet")
    got = vectors.near_vectors(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas().sort_values("vec_id")
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    truth = np.concatenate([(x[at : at + 1000] @ x.T >= 0.93).sum(1) - 1 for at in range(0, 50_000, 1000)])
    links = got["n_links"].to_numpy()
    assert truth.sum() > 1500 and (links <= truth).all() and links.sum() >= 0.9 * truth.sum() and got["audited_recall"].min() >= 0.98


def test_scaled_copies_and_labels_with_commas(spark, monkeypatch):
    """Vectors of one direction don't split a cell, whatever their lengths; a comma in a label or a number beside it joins nothing."""
    import numpy as np

    from findloom.llm import vectors

    monkeypatch.setattr(vectors, "CELL", 300)
    monkeypatch.setattr(vectors, "EXACT", 256)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(1, 8)) * r.uniform(0.1, 9, size=(1500, 1)), r.normal(size=(200, 8))])
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(5000, [2.0], "a,1.0"), (5001, [1.0, 2.0], "a"), (5002, [1.0, 2.0], "a,1.0"), (5003, [4.0], "a,1.0")]
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= 0.93).sum(1) - 1
    assert [got[i][0] for i in range(1500)] == truth[:1500].tolist() and {got[i][1] for i in range(1500)} == {0}
    assert got[5000] == (1, 5000) and got[5003] == (1, 5000) and got[5001] == (0, 5001) and got[5002] == (0, 5002)


def test_licenses_are_ranked():
    """Two notices in one text, each whole; one-line references; of notices that overlap the one that saves most."""
    from findloom.llm import licenses

    mit, zlib_, apache = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["Zlib"][-1], licenses.TEMPLATES["Apache-2.0"]
    two = f"Copyright a\n{mit}\n\nParts are by others:\n{zlib_}\nend"
    got = licenses.license_spans(two)
    assert [(g[0], g[4]) for g in got] == [("MIT", 0), ("Zlib", 0)] and two[got[0][1] : got[0][2]] == mit.rstrip(".") and got[1][2] <= len(two)
    whole = licenses.license_spans(f"x {apache[-1]} y\n{apache[0]}")
    assert [g[0] for g in whole] == ["Apache-2.0"] * 2 and whole[0][2] - whole[0][1] > len(apache[1])
    for text, want in (
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("# SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]), ("licensed under the GNU General Public License v3.0 or later", ["GPL-3.0"]), ("Released under the MIT licence.", ["MIT"]),
        ("MIT License\nCopyright (c) 2020 A\n" + mit, ["MIT"]), ("a licence to kill", []), ("", []), (None, []),
    ):
        assert [g[0] for g in licenses.license_spans(text)] == want, text
    assert len(licenses.license_spans("SPDX-License-Identifier: MIT\n" * 300)) == 300
