"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: each byte is followed by eight shifts, marked -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN e >= 0 THEN xor(r, e) ELSE xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce({steps}, lambda r, e: {turn}, 4294967295::BIGINT), 4294967295::BIGINT)"


def base32(digest: str) -> str:
    """Base 32 of a digest of 160 bits in hexadecimal: eight characters for every ten digits."""
    part = f"('0x' || substr({digest}, 10 * (i // 8)::INT + 1, 10))::BIGINT"
    return f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part} >> (5 * (7 - i % 8))::INT) & 31)::INT + 1, 1)), '')"


def merkle(levels: int = 8, top_levels: int = 4) -> str:
    """Trees of 8 to the power of ``levels`` leaves at most, a table of 8 to the power of ``top_levels`` groups at most."""
    value = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(value(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    out = [f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS used FROM documents)",
           "l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d)",
           "a0 AS (SELECT tree, rank, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM l)"]

    def climb(a: str, r: str, count: int) -> None:
        for k in range(count):
            out.append(f"{r}{k} AS (SELECT tree, rank // 8 AS run, any_value(n) AS n, list(node ORDER BY rank) AS nodes FROM {a}{k} GROUP BY ALL)")
            out.append(f"{a}{k + 1} AS (SELECT tree, run AS rank, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node, (n + 7) // 8 AS n FROM {r}{k})")

    climb("a", "r", levels)
    out.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, node, count(*) OVER () AS n, tree AS name FROM a{levels})")
    climb("b", "s", top_levels)
    out.append(f"f0 AS (SELECT l.doc_id, l.tree, l.leaf, l.used AS folded, '' AS proof, l.rank, b0.rank AS top, a{levels}.node AS subroot, b{top_levels}.node AS root "
               f"FROM l JOIN b0 ON b0.name = l.tree JOIN a{levels} ON a{levels}.tree = l.tree, b{top_levels})")
    steps = [(f"r{k}", "rank", k) for k in range(levels)] + [(f"s{k}", "top", k) for k in range(top_levels)]
    for at, (runs, place, k) in enumerate(steps):
        own = f"(f.{place} // {8**k} % 8)::INT"
        left, right = f"array_to_string(x.nodes[:{own}], '')", f"array_to_string(x.nodes[{own} + 2:], '')"
        on = f"x.run = f.{place} // {8 ** (k + 1)}" + (" AND x.tree = f.tree" if place == "rank" else "")
        out.append(f"f{at + 1} AS (SELECT f.* EXCLUDE (folded, proof), CASE WHEN x.n = 1 THEN f.folded ELSE sha256({left} || f.folded || {right}) END AS folded, "
                   f"f.proof || CASE WHEN x.n = 1 THEN '' ELSE {left} || {right} END AS proof FROM f{at} f JOIN {runs} x ON {on})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}"


MERKLE = merkle()

WARC = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, row_number() OVER (PARTITION BY html ORDER BY page_id DESC) AS place, sha1(html) AS digest FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {base32('digest')} AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN place > 1 THEN last END AS refers_to, coalesce(url, '') AS url FROM q"""
