"""DuckDB SQL of the queries that need more than a line: checksums, hash trees, near words and repeated windows."""

from __future__ import annotations

# crc(x): unsigned crc32 of a string's UTF-8 bytes, by the table of the reflected polynomial (a fixed value), built by its rule.
CRC = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc(x: str) -> str:
    """The expression for ``x``; needs CRC among the WITH clauses and crc_table among the FROM tables."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda k: ('0x' || hex(encode({x}))[2 * k + 1:2 * k + 2])::BIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def hash_tree(levels: int = 6) -> str:
    """Hash trees of 16 nodes a run, unrolled for ``levels`` levels: enough for 16 ** levels rows a source and as many sources."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    given = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [CRC, f"""d AS (SELECT doc_id, source, sha256({given} || {value('text')}) AS leaf, sha256({given} || {value(lower)}) AS low, {crc("coalesce(doc_id::VARCHAR, '')")} AS c FROM documents, crc_table),
m AS MATERIALIZED (SELECT doc_id, source, leaf, CASE WHEN doc_id IS NOT NULL AND c % 5 = 0 THEN low ELSE leaf END AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS MATERIALIZED (SELECT coalesce('=' || source, '') AS tree, i, leaf AS h FROM m)"""]

    def climb(name: str, first: int) -> None:
        """Levels of the trees in {name}0 and, for each level, what stands left and right of every node in its run."""
        for k in range(levels):
            parts.append(f"""{name}s{k} AS MATERIALIZED (SELECT tree, i, h, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) WINDOW w AS (PARTITION BY tree, i // 16 ORDER BY i)),
{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}s{k} GROUP BY 1, 2)""")

    climb("a", 0)
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, h, tree AS source FROM a{levels})")
    climb("b", 0)
    parts.append("c0 AS (SELECT m.doc_id, m.leaf, m.h AS f, '' AS proof, coalesce('=' || m.source, '') AS tree, m.i, b0.i AS j FROM m JOIN b0 ON b0.source = coalesce('=' || m.source, ''))")
    at = 0
    for name, tree, i, rest in (("a", "c.tree", "i", "c.j"), ("b", "''", "j", "c.i")):
        for k in range(levels):
            moved = f"c.i // 16 AS i, {rest}" if name == "a" else f"{rest}, c.j // 16 AS j"
            parts.append(f"""c{at + 1} AS (SELECT c.doc_id, c.leaf, CASE WHEN s.n > 1 THEN sha256(s.l || c.f || s.r) ELSE c.f END AS f, CASE WHEN s.n > 1 THEN c.proof || s.l || s.r ELSE c.proof END AS proof, c.tree, {moved}
FROM c{at} c JOIN {name}s{k} s ON s.tree = {tree} AND s.i = c.{i})""")
            at += 1
    return f"""WITH {', '.join(parts)}
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.f AS folded_root, c.f = r.h AS verified
FROM c{at} c JOIN a{levels} s ON s.tree = c.tree CROSS JOIN b{levels} r"""


# Near words share what is left when one letter goes: both lose one at the same place (replaced), or one loses it (inserted).
VARIANTS = f"""WITH RECURSIVE {CRC},
x AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM x WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT doc_id, run, c, {crc("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM g, crc_table),
a AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM a WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
l AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT y.word AS a, z.word AS b FROM l y JOIN l z ON y.d = z.d AND y.i = z.i AND y.word <> z.word UNION SELECT l.word, v.word FROM l JOIN v ON l.d = v.word UNION SELECT v.word, l.word FROM l JOIN v ON l.d = v.word),
b AS (SELECT a AS word, count(*) AS n_near, first(p.b ORDER BY v.n DESC, p.b) AS near, max(v.n) AS most FROM p JOIN v ON v.word = p.b GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, CASE WHEN most >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN most END AS form_n FROM v LEFT JOIN b USING (word)),
r(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL"""


# Windows of 20 words of equal words are ranked by place; words of any but the first go.
REPEATS = r"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
k AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
g AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, i) AS n FROM k) WHERE n > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM g),
t AS (SELECT w.r, u.j, ws[u.j] AS v FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS j) u),
o AS (SELECT t.r, count(x.j) AS n_removed, sha256(coalesce(string_agg(t.v, ' ' ORDER BY t.j) FILTER (WHERE x.j IS NULL), '')) AS kept_sha256 FROM t LEFT JOIN x ON x.r = t.r AND x.j = t.j GROUP BY 1)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(o.n_removed, 0) AS n_removed, coalesce(o.kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN o USING (r)"""
