import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wirelark.llm import merkle, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=None):
    values = (row.doc_id, row.source, row.lang, row.n_chars, row.text if text is None else text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        yield level[i // 8 * 8:i // 8 * 8 + 8], i % 8
        i //= 8


def brute(rows, tampered):
    """Rows of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in order]
    top = levels([t[-1][0] for t in trees]) if trees else []
    for n, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = [*steps(trees[n], i), *steps(top, n)]
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if tampered(r) and r.text is not None else None)
            for run, at in path:
                now = digest("".join(run[:at] + [now] + run[at + 1:]))
            proof = digest("".join("".join(run[:at] + run[at + 1:]) for run, at in path))
            out.append((r.doc_id, leaf(r), trees[n][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(queries.tampered(), merkle.leaf_of(text=small)).otherwise(merkle.leaf_of())
    proofs = merkle.manifest(docs.select("doc_id", "lang", merkle.leaf_of().alias("leaf"), shown.alias("shown")), carried=("shown",))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("upwards"))).alias("p"),
                         merkle.folded(F.col("shown"), F.col("upwards")).alias("f")).collect()
    return sorted(((*r, r.f == r.root) for r in rows), key=str)


def tampered(row):
    return row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = sorted((tuple(r) for r in queries.op11_merkle(spark, folder).collect()), key=str)
    want = brute(spark.read.parquet(f"{folder}/documents.parquet").collect(), tampered)
    assert got == want and len({r[-1] for r in got}) == 2


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (1, 1), (64, 1, 65), (513, 7), tuple([1, 2, 9] * 4)])
def test_shapes(spark, sizes):
    """Lone leaves, full and broken runs, trees of several heights, and more than eight groups."""
    rows = [(100 * g + i, f"Text {i}", None if g == 1 else f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    assert found(docs) == brute(docs.collect(), tampered)


def test_odd_rows(odd, empty):
    """Nulls are values of their own, whole copies are leaves of their own, clashing columns do not matter."""
    for name in ("rank", "size", "digest", "tree", "way", "path", "leaf", "root"):
        odd = odd.withColumn(name, F.lit("mine"))
    assert found(odd) == brute(odd.collect(), tampered)
    assert found(empty) == []


def test_values_cannot_run_together(spark):
    rows = spark.createDataFrame([(1, "2:ab", None, "", 3), (1, "2:ab", "", None, 3)], "doc_id long, source string, lang string, text string, n_chars int")
    assert rows.select(merkle.leaf_of().alias("l")).distinct().count() == 2
