"""Registered queries against brute force on their whole tables."""

import re

import numpy as np
import pandas as pd
import xxhash

from cellwise.llm import queries


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = sum((xxhash.xxh64_intdigest(s, 42) >> np.arange(64, dtype=object)) & 1 for s in shingles) if shingles else np.zeros(64, int)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_op4_equals_all_pairs(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    bits = [fingerprint(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op4_simhash_bk_tree"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {name: (f"{bits[i]:016x}", ids[top(i)]) for i, name in enumerate(ids)}
    assert any(component != name for name, (_, component) in found.items())


def test_op8_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = pd.read_parquet(f"{folder}/embeddings.parquet").sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    rows = queries.QUERIES["op8_pruned_graph_search"](spark, folder).toPandas()
    hits = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        got = rows[rows["query_id"] == ids[q]].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 21)) and (np.diff(got["score"]) <= 0).all()
        np.testing.assert_allclose(got["score"], scores[np.searchsorted(ids, got["vec_id"])], rtol=1e-9)
        hits += len(set(best) & set(got["vec_id"]))
    assert hits >= 0.95 * 20 * len(asked) and len(rows) == 20 * len(asked)
