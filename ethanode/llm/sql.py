"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, k: int) -> str:
    words = _WORDS.format(text=_LOWER)
    return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS s
 FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0"""


ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": f"""WITH RECURSIVE ds AS ({_shingles("documents", "doc_id", 3)}), n AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY doc_id),
 common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM ds x JOIN ds y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id),
 c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35), k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS t FROM s),
 d AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY t) > 1), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM d),
 p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
 kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p WHERE gone.p IS NULL GROUP BY p.doc_id)
 SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": f"""WITH ds AS ({_shingles("documents", "doc_id", 5)}), bs AS ({_shingles("benchmark", "item_id", 5)}), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
 SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)""",
    "op8_quality_rules": rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {_WORDS.format(text="text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3)),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
 s AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
 u AS (UNPIVOT (SELECT source, CAST(n_words < 50 AS INTEGER) AS short, CAST(100 * n_repeat_words > 50 * n_words AS INTEGER) AS repeats, CAST(10 * n_symbols > n_words AS INTEGER) AS signs,
  CAST(10 * n_dup_lines > 3 * n_lines AS INTEGER) AS lines, CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INTEGER) AS words FROM f WHERE source IS NOT NULL) ON short, repeats, signs, lines, words INTO NAME rule VALUE bad),
 h AS (SELECT source, rule, count(*) AS n, sum(bad) AS k FROM u GROUP BY ALL), m AS (SELECT rule, avg(k / n) AS m, var_samp(k / n) AS v FROM h GROUP BY rule),
 z AS (SELECT rule, greatest(m * z, 1e-6) AS a, greatest((1 - m) * z, 1e-6) AS b FROM (SELECT *, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 2.0 END AS z FROM m)),
 q AS (SELECT source, max((k + a) / (n + a + b)) AS rate FROM h JOIN z USING (rule) GROUP BY source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept FROM f LEFT JOIN q USING (source)""",
}

#: The table of the reflected CRC-32 (polynomial EDB88320), by its rule; _CRC folds a list of bytes with it.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
#: UTF-8 bytes of a text without code points over 00FF.
_BYTES = "flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END))"


def _crc(text: str) -> str:
    return _CRC.format(bytes=_BYTES.format(text=text))


ORACLE_SQL["op12_spelling_variants"] = f"""WITH RECURSIVE {_CRC_TABLE},
 r AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
 h AS (SELECT r, n, {_crc("doc_id || ':' || r")} AS h FROM r, crc), g AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM h),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
 e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.d = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.d = w.word),
 m AS (SELECT e.word, count(*) AS n_near, max(b.n) AS top, min_by(near, (-b.n, near)) AS best FROM e JOIN w b ON b.word = near GROUP BY e.word),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN m ON m.word = w.word),
 go(word, place) AS (SELECT word, word FROM f UNION ALL SELECT go.word, f.form FROM go JOIN f ON f.word = go.place WHERE f.form IS NOT NULL),
 z AS (SELECT go.word, go.place AS root FROM go JOIN f ON f.word = go.place WHERE f.form IS NULL)
 SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs {name}0 .. of (p, idx, n, h), up to the root, and {name}s0 .. with the siblings' digests l and r."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"{name}s{k} AS (SELECT a.p, a.idx, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r FROM {name}{k} a LEFT JOIN {name}{k} b ON a.p = b.p AND a.idx // 8 = b.idx // 8 AND a.idx <> b.idx GROUP BY a.p, a.idx)")
        out.append(f"{name}{k + 1} AS (SELECT p, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY p, idx // 8)")
    return ", ".join(out)


def _walk(name: str, tree: str, start: str, part: str, at: str, levels: int) -> str:
    """CTEs that fold f and join the siblings into `proof` along the levels of a tree, for rows of `start` whose leaf is (part, at)."""
    out, before = [], start
    for k in range(levels):
        out.append(f"{name}{k} AS (SELECT q.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || q.f || s.r) ELSE q.f END AS f, q.proof || s.l || s.r AS proof) FROM {before} q JOIN {tree}s{k} s ON s.p = q.{part} AND s.idx = q.{at} // {8**k})")
        before = f"{name}{k}"
    return ", ".join(out)


_ENCODED = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_ENCODED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_TEXT_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Levels written out: enough for 8**6 rows of a language and 8**3 languages.
_LOW, _TOP = 6, 3

ORACLE_SQL["op13_manifest"] = f"""WITH {_CRC_TABLE}, d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, {_LEAF.format(text="text")} AS leaf,
 CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(text=_TEXT_LOWER)} ELSE {_LEAF.format(text="text")} END AS f, '' AS proof, 0 AS one FROM documents, crc),
 {_tree("t", "SELECT p, idx, n, leaf AS h FROM d", _LOW)}, {_tree("u", f"SELECT 0 AS p, p AS idx, count(*) OVER () AS n, h FROM t{_LOW}", _TOP)},
 {_walk("v", "t", "d", "p", "idx", _LOW)}, {_walk("w", "u", f"v{_LOW - 1}", "one", "p", _TOP)}
 SELECT doc_id, leaf, t{_LOW}.h AS subroot, u{_TOP}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u{_TOP}.h AS verified FROM w{_TOP - 1} w JOIN t{_LOW} ON t{_LOW}.p = w.p, u{_TOP}"""
