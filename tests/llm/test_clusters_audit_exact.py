"""Annulus search, the filter audit and Grace hash deduplication against brute force and SQL."""

import hashlib
import math
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from typeloom.llm import centroids, exact, interactions, queries
from typeloom.llm.exact import ContentTable

from ..test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_annulus_search", "op12_incidence_audit", "op13_grace_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(sql.fetchall(), sql.columns)


# -- centroids


def slow_nearest(vectors, points):
    far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in points] for v in vectors]
    return [min(range(len(points)), key=lambda i: (f[i], i)) for f in far], [min(f) for f in far]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 2), min_size=1, max_size=9), st.lists(st.tuples(*[st.integers(-6, 6)] * 2), min_size=1, max_size=20), st.sampled_from([np.int64, object]))
def test_annulus_finds_the_nearest_and_the_first_of_ties(points, vectors, kind):
    found, far = centroids.Annuli(np.array(points, dtype=kind)).nearest(np.array(vectors, dtype=kind))
    assert (found.tolist(), far.tolist()) == slow_nearest(vectors, points)


def test_annulus_leaves_centroids_of_other_norms_out():
    rng = np.random.default_rng(3)
    direction = rng.standard_normal((4000, 3))
    direction /= np.linalg.norm(direction, axis=1)[:, None]
    vectors = (direction * rng.integers(1, 40, 4000)[:, None] * 5000).astype(np.int64)
    annuli = centroids.Annuli(vectors[:200])
    found, far = annuli.nearest(vectors)
    assert annuli.compared < 0.3 * 200 * 4000
    brute = ((vectors[:, None, :] - vectors[None, :200, :]) ** 2).sum(2)
    assert (found == brute.argmin(1)).all() and (far == brute.min(1)).all()


def slow_clusters(rows, dims, k, rounds, seed):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    points = [v for _, v in by_hash[:k]]
    for _ in range(rounds):
        found, _ = slow_nearest([v for _, v in kept], points)
        for c in range(len(points)):
            own = [v for (_, v), f in zip(kept, found) if f == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own)]
    found, far = slow_nearest([v for _, v in kept], points)
    fits = lambda x: x if x < 1 << 63 else None
    inertia = {c: sum(d for d, f in zip(far, found) if f == c) if all(d < 1 << 63 for d, f in zip(far, found) if f == c) else None for c in set(found)}
    total = None if None in inertia.values() else fits(sum(inertia.values()))
    named = {c: hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest() for c in inertia}
    return sorted(((i, f, fits(d), None if inertia[f] is None else fits(inertia[f]), total, named[f]) for (i, _), f, d in zip(kept, found, far)), key=repr)


ODD_VECTORS = [
    (0, [0.5, 1.0, -0.25]), (1, None), (2, []), (3, [1.0, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, None, 0.0]),
    (7, [0.0, 0.0, 0.0]), (8, [0.5, 1.0, -0.25]), (8, [0.5, 1.0, -0.25]), (8, [4.0, 4.0, 4.0]), (None, [1.5, 0.001, -7.0]), (9, [-0.001, 0.003, 9.0]), (10, [2.0, 2.0, 2.0]),
]


@pytest.mark.parametrize("more", [[], [(11, [3e5, -1e6, 2.0]), (12, [3e5, -1e6, 2.5])], [(11, [1e30, 0.0, 0.0]), (12, [-3e300, 1e-300, 0.0]), (13, [0.1, 0.2, 0.3])]])
@pytest.mark.parametrize("k", [3, 40])
def test_clusters_of_odd_vectors(spark, more, k):
    given = ODD_VECTORS + more
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in given], "vec_id long, embedding array<double>, cluster int, vector string").repartition(3)
    found = centroids.cluster(df, dims=3, clusters=k, rounds=3)
    assert sorted(map(tuple, found.collect()), key=repr) == slow_clusters(given, 3, k, 3, 2)
    assert found.columns == centroids.cluster(df.limit(0), dims=3).columns and centroids.cluster(df.limit(0), dims=3).count() == 0


# -- filter audit


def slow_audit(docs, labels):
    import re

    marked = []
    for i, text, lang in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        firsts = [j for j, other, _ in docs if (other or "") == body and j is not None]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in body) > 10 * len(body),
            "D": any(c in "#$%&*|" for c in body),
            "E": bool(firsts) and (i is None or min(firsts) < i),
        }
        good, toxic = (any(j == i is not None and both[at] == 1 for j, *both in labels) for at in (0, 1))
        marked.append((lang or "", {f for f, v in fails.items() if v}, good, toxic))
    out, removed = {}, Counter()
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in own if f in m[1] and not m[1] & before]
                removed[part, f] += len(gone)
                out[part, order, step] = (sum(not m[1] & (before | {f}) for m in own), len(gone), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_of_odd_documents(spark, odd_docs, no_docs):
    varied = " ".join(f"w{i}" for i in range(120))
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    docs += [(100 + i, t, "de") for i, t in enumerate([varied, varied + " x", varied.upper(), varied + " 5%", varied, "a|b", "word " * 200, varied * 3])]
    docs += [(None, varied, "de"), (None, "only here", ""), (100, varied, "fr")]
    labels = [(100, 1, 0), (100, 0, 1), (104, 1, 1), (None, 1, 1), (107, None, None), (0, 0, 1), (900, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, lang string, part int, mask string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = interactions.audit_documents(df, said)
    assert sorted(map(tuple, found.collect())) == slow_audit(docs, labels)
    assert interactions.audit_documents(no_docs, said).count() == 0
    assert {r["good_lost"] for r in interactions.audit_documents(df, said.limit(0)).collect()} == {0}


def test_matrices_split_every_mask():
    columns, by = interactions.matrices("ABCDE")
    assert all(m.shape == (32, 600) for m in by.values()) and len(set(columns)) == 600
    fails = by["removed"] + by["redundant"]
    assert (by["kept"][0] == 1).all() and set(np.unique(fails + by["kept"])) <= {0, 1}


# -- exact deduplication


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=3), st.one_of(st.none(), st.integers(0, 9))), max_size=60))
def test_table_counts_texts(records):
    table = ContentTable(1 << 30)
    for text, i in records:
        assert table.add(hashlib.sha256(text.encode()).digest(), text, i, 1)
    ids = {t: [i for x, i in records if x == t] for t, _ in records}
    assert dict(zip(table.contents, zip(table.last, table.n))) == {t: (max((i for i in v if i is not None), default=None), len(v)) for t, v in ids.items()}


def test_table_grows_probes_and_fills():
    table = ContentTable(1 << 30)
    for i in range(5000):  # all hashes collide in their last bytes
        assert table.add(i.to_bytes(4, "little") + bytes(28), str(i), i, 1) if i < 300 else table.add(hashlib.sha256(str(i).encode()).digest(), str(i), i, 1)
    assert len(table.contents) == 5000 and 2 * 5000 <= len(table.slots)
    small = ContentTable(10)
    assert small.add(b"a" * 32, "long beyond the limit", 1, 1) and not small.add(b"b" * 32, "b", 1, 1) and small.add(b"a" * 32, "long beyond the limit", 2, 1)
    with pytest.raises(ValueError):
        small.add(b"a" * 32, "another", 3, 1)


def slow_groups(docs):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, t in docs:
        ids = [j for j, other in docs if fold(other) == fold(t)]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table_bytes", [exact.TABLE_BYTES, 100_000, 20_000])
def test_groups_of_odd_documents(spark, odd_docs, no_docs, table_bytes):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    docs += [(None, "only here"), (None, "Only Here"), (None, "É"), (50, "É"), (51, "é")] + [(60 + i, f"text {i % 17}" * (1 + i % 5)) for i in range(150)]
    df = spark.createDataFrame([(*d, "c", 5) for d in docs], "doc_id long, text string, content string, n int").repartition(5)
    want = slow_groups(docs)
    assert sorted(map(tuple, exact.exact_groups(df, table_bytes=table_bytes).collect()), key=repr) == want
    kept = exact.keep_one(df, table_bytes=table_bytes)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)
    assert exact.exact_groups(no_docs, table_bytes=table_bytes).count() == 0


def test_groups_with_string_ids(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "x"), ("c", "y")], "doc_id string, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(df).collect()} == {"a": "b", "b": "b", "c": "c"}
