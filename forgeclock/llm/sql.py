"""DuckDB text of operators whose SQL is longer than a query: made from rules, so it stays short here."""

from __future__ import annotations

#: ``t`` holds the 256 entries of a CRC-32's table, made from its polynomial.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc(codes: str) -> str:
    """Unsigned CRC-32 of a list of bytes."""
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


def ascii_bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"


def lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _trees(name: str, levels: int) -> list[str]:
    """Levels above ``{name}0`` (tree, place, n, digest); ``{name}s`` levels have the digests around each node among its siblings."""
    around = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN {}), '')"
    before, after = around.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), around.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    out = []
    for k in range(levels):
        out.append(f"{name}s{k} AS (SELECT tree, place, n, {before} AS before, {after} AS after FROM {name}{k})")
        out.append(
            f"""{name}{k + 1} AS (
  SELECT tree, place // 16 AS place, (n + 15) // 16 AS n,
    CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
  FROM {name}{k} GROUP BY tree, place // 16, n)"""
        )
    return out


def merkle_sql(fields: list[str], levels: int, above: int) -> str:
    """Both trees level by level, for groups of at most 16^levels rows and at most 16^above groups."""
    part = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = [part.format(f) for f in fields]
    claim = [part.format(lowered(f) if f == "text" else f) for f in fields]
    chosen = crc(ascii_bytes("CAST(doc_id AS VARCHAR)")) + " % 5 = 0"
    steps = [f"""
  SELECT r.doc_id, r.digest AS leaf, r.claim AS folded, '' AS proof, r.tree, r.place, o.digest AS subroot, t.digest AS root
  FROM r JOIN l{levels} o ON o.tree = r.tree JOIN u{above} t ON true"""]
    for name, many, own, place in (("l", levels, "p.tree", "p.place"), ("u", above, "0", "p.tree")):
        for k in range(many):
            steps.append(f"""
  SELECT p.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.before || p.folded || s.after) ELSE p.folded END AS folded,
    p.proof || CASE WHEN s.n > 1 THEN s.before || s.after ELSE '' END AS proof)
  FROM p{len(steps) - 1} p JOIN {name}s{k} s ON s.tree = {own} AND s.place = {place} // {16**k}""")
    tables = [
        CRC_TABLE,
        f"""a AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({" || ".join(leaf)}) AS digest,
    sha256(CASE WHEN {chosen} THEN {" || ".join(claim)} ELSE {" || ".join(leaf)} END) AS claim
  FROM documents, crc)""",
        """r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n
  FROM a)""",
        "l0 AS (SELECT tree, place, n, digest FROM r)",
        *_trees("l", levels),
        f"u0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, digest FROM l{levels})",
        *_trees("u", above),
        *[f"p{i} AS ({step})" for i, step in enumerate(steps)],
    ]
    return "WITH " + ",\n".join(tables) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p{len(steps) - 1}"""


def letter_bytes(text: str) -> str:
    """UTF-8 bytes of a text with code points below U+0100 only, of which those above U+007F are U+00C0 to U+00FF."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda x: "
        "CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END))"
    )


def variants_sql(min_chars: int, min_count: int, every: int, factor: int) -> str:
    """Near pairs by words with one letter taken out; forms followed one by one."""
    h = crc(letter_bytes("CAST(doc_id AS VARCHAR) || ':' || run"))
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, {lowered("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {min_chars} GROUP BY ALL),
hashed AS (SELECT run, n, {h} AS h FROM counted, crc),
spoiled AS (
  SELECT n, CASE WHEN h % {every} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(n) >= {min_count}),
gaps AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.rest
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.rest),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {factor} * w.n THEN best END AS form,
    CASE WHEN best_n >= {factor} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS root, 0 AS steps FROM words
  UNION ALL SELECT u.word, f.form, steps + 1 FROM up u JOIN formed f ON f.word = u.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)"""
