"""The Merkle manifest against a plain bottom-up version and DuckDB."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from strata.llm import merkle, oracle


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text) -> str:
    shown = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root and, for each node, its siblings by level."""
    paths, above = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[a : a + 8] for a in range(0, len(nodes), 8)]
        for k, at in enumerate(above):
            run, place = runs[at // 8], at % 8
            paths[k].append((run[:place], run[place + 1 :]))
        nodes, above = [digest(*run) for run in runs], [at // 8 for at in above]
    return nodes[0], paths


def plain(rows) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row.lang, []).append((row.doc_id is not None, row.doc_id or 0, leaf(row, row.text), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: (found := sorted(groups[name], key=lambda x: x[:3]), *climb([x[2] for x in found])) for name in names}
    root, tops = climb([trees[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        found, subroot, paths = trees[name]
        for (_, _, own, row), path in zip(found, paths):
            odd = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0
            low = None if row.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text)
            folded = leaf(row, low) if odd else own
            for left, right in path + top:
                folded = digest(*left, folded, *right)
            proof = digest(*(x for left, right in path + top for x in left + right))
            out.append((row.doc_id, own, subroot, root, proof, folded, folded == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(docs, height):
    found = [tuple(r) for r in merkle.manifest(docs, height=height).collect()]
    assert sorted(map(str, found)) == sorted(map(str, plain(docs.collect())))


def test_many_groups_and_lone_leaves(spark):
    """More groups than one block of roots holds, one of them with a third of all rows."""
    rows = [(k, f"Text {k}", None if k % 90 == 7 else "hot" if k % 3 == 0 else f"g{k % 80}", "s", k, k) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, leaf int").repartition(5)
    found = [tuple(r) for r in merkle.manifest(docs, height=1).collect()]
    assert sorted(map(str, found)) == sorted(map(str, plain(docs.collect()))) and {r[-1] for r in found} == {True, False}


def test_empty_and_one(empty, make):
    assert merkle.manifest(empty).collect() == []
    one = make([(5, "A")])
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest()
    assert tuple(row) == plain(one.collect())[0]


def test_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null").toPandas().astype(object))
    con.execute("create table d as select doc_id::bigint doc_id, text, lang, source, n_chars::int n_chars from documents")
    con.execute("drop view documents; alter table d rename to documents")
    found = merkle.manifest(docs.filter("doc_id is not null")).toPandas()
    assert sorted(map(str, found[sorted(found.columns)].values.tolist())) == sorted(map(str, (x := con.execute(oracle.MERKLE).df())[sorted(x.columns)].values.tolist()))


def test_path_bytes():
    path = [([b"a" * 32], [b"b" * 32, b"c" * 32]), ([], [])]
    assert merkle.unpack_path(merkle.pack_path(path)) == path
    assert [merkle.levels(n) for n in (0, 1, 2, 8, 9, 64, 65, 512, 513)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
