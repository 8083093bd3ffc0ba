"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations


def _kind(kind: str, rank: int, pattern: str, least: int) -> str:
    """Spans of one kind: matches are marked, the text is split at the marks, and lengths are summed up."""
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos AS s, pos + len(split_part(piece, chr(2), 1)) + n AS e
    FROM (
        SELECT doc_id, piece, k,
            sum(CASE WHEN k = 1 THEN len(piece) ELSE len(piece) - 2 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos,
            len(split_part(split_part(piece, chr(3), 1), chr(2), 2)) AS n
        FROM (
            SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
            FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS pieces FROM clean)
        )
    )
    WHERE k > 1 AND n >= {least}"""


SECRETS = f"""
WITH clean AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents),
spans AS ({
    " UNION ALL ".join(
        _kind(*x)
        for x in (
            ("assign", 0, r'''((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)''', 6),
            ("access", 1, "()(AKIA[A-Z0-9]+)", 20),
            ("hex", 2, "()([0-9a-f]{24,})", 24),
        )
    )
}),
joined AS (
    SELECT doc_id, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j USING (doc_id)
"""


WARC = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM (
    SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS revisit
    FROM (
        SELECT page_id, payload_bytes, payload_digest, min(page_id) OVER (PARTITION BY payload_digest) AS first
        FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages)
    )
)
"""


def _escaped_length(text: str) -> str:
    """Code points of a text with backslashes and control strings escaped."""
    return f"len(regexp_replace(replace({text}, chr(92), chr(92) || chr(92)), '(<)(/?s>)|(\\[)(/?INST\\])', '\\1\\3' || chr(1) || '\\2\\4', 'g'))"


CHAT = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
joined AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(20 + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit: each byte is met at the first of its eight steps."""
    steps = f"flatten(list_transform(range(1, len({text}) + 1), lambda k: [ascii({text}[k]), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _field(name: str, value: str | None = None) -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_field, ('doc_id', 'source', 'lang', 'n_chars')), _field('text', text)])})"


def _climb(leaves: str, name: str, levels: int) -> str:
    """Levels of a tree for each grp over leaves(grp, i, node); from the level with one node on there are no more."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        below = f"{name}{k}"
        out.append(f"{name}{k + 1} AS (SELECT grp, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {below} WHERE grp IN (SELECT grp FROM {below} GROUP BY grp HAVING count(*) > 1) GROUP BY grp, i // 8)")
    return ", ".join(out)


def _siblings(name: str, levels: int, of: str, grp: str, i: str) -> str:
    """Joins that put beside each row of ``of`` the siblings before and after its path, level by level."""
    out = ""
    for k in range(levels):
        step, width = f"{name}s{k}", 8**k
        out += f"""
        LEFT JOIN (
            SELECT a.grp, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
            FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.i // 8 = b.i // 8 WHERE a.grp IN (SELECT grp FROM {name}{k} GROUP BY grp HAVING count(*) > 1) GROUP BY a.grp, a.i
        ) {step} ON {step}.grp = {grp} AND {step}.i = {i} // {width}"""
    return out


_STEPS = [f"l_s{k}" for k in range(7)] + [f"g_s{k}" for k in range(2)]


def _folded(node: str) -> str:
    """Selections, one on another, that fold the proof's nine steps; a step without nodes leaves what was there."""
    inner = f"SELECT *, {node} AS f0 FROM proved"
    for k, step in enumerate(_STEPS):
        inner = f"SELECT *, CASE WHEN {step}_b IS NULL THEN f{k} ELSE sha256({step}_b || f{k} || {step}_a) END AS f{k + 1} FROM ({inner})"
    return inner


#: Up to 8 ** 7 documents a language and 64 languages.
MERKLE = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS claimed
    FROM documents
),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{_climb("SELECT grp, i, leaf AS node FROM placed", "l_", 7)},
subroots AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS i FROM (
    {" UNION ALL ".join(f"SELECT grp, any_value(node) AS node FROM l_{k} GROUP BY grp HAVING count(*) = 1" for k in range(8))})),
{_climb("SELECT '' AS grp, i, node FROM subroots", "g_", 2)},
top AS ({" UNION ALL ".join(f"SELECT any_value(node) AS root FROM g_{k} HAVING count(*) = 1" for k in range(3))}),
proved AS (
    SELECT doc_id, leaf, claimed, r.node AS subroot, root, {", ".join(f"{s}.before AS {s}_b, {s}.after AS {s}_a" for s in _STEPS)}
    FROM placed p JOIN subroots r ON r.grp = p.grp CROSS JOIN top
    {_siblings("l_", 7, "p", "p.grp", "p.i")}
    {_siblings("g_", 2, "r", "''", "r.i")}
)
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"coalesce({s}_b || {s}_a, '')" for s in _STEPS)}) AS proof_sha256, f9 AS folded_root, f9 = root AS verified
FROM ({_folded("claimed")})
"""

_UNITS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"

FILL_MIDDLE = f"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, {_UNITS} AS u, len({_UNITS}) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM units),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


def _models(order: int, names: list[str]) -> str:
    """Blended likelihoods w0 to w<order> of windows(gram, counts), from the shortest context up."""
    out = []
    for k in range(order + 1):
        sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in names)
        out.append(f"g{k} AS (SELECT substr(gram, {order - k + 1}, {k + 1}) AS own, {sums} FROM windows GROUP BY 1)")
        out.append(f"c{k} AS (SELECT substr(own, 1, {k}) AS context, {', '.join(f'sum({c})::BIGINT AS n_{c}, count(*) FILTER ({c} > 0) AS t_{c}' for c in names)} FROM g{k} GROUP BY 1)")
        lower = (lambda c: f"s.p_{c}") if k else (lambda c: "(1 / (kinds + 1.0::DOUBLE))")
        blend = ", ".join(f"CASE WHEN n_{c} > 0 THEN (g.{c} + t_{c} * {lower(c)}) / (n_{c} + t_{c})::DOUBLE ELSE {lower(c)} END AS p_{c}" for c in names)
        below = f"JOIN w{k - 1} s ON s.own = substr(g.own, 2, {k})" if k else "CROSS JOIN (SELECT count(DISTINCT substr(gram, " + str(order + 1) + ", 1)) AS kinds FROM windows)"
        out.append(f"w{k} AS (SELECT g.own, {blend} FROM g{k} g JOIN c{k} c ON c.context = substr(g.own, 1, {k}) {below})")
    return ", ".join(out)


_RULES = "(VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS rules(says, rule_host, rule_path)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URLS = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
named AS (SELECT page_id, translate(regexp_extract(coalesce(after, ''), '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(coalesce(after, ''), '^[^/?#]*([^?#]*)', 1) AS path, coalesce(after, '') AS after FROM cut),
bodied AS (SELECT page_id, host, path, host || substr(after, len(host) + 1) AS body FROM named),
ruled AS (SELECT body, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(says, len(rule_host || rule_path)) AS says
    FROM (SELECT DISTINCT body, host, path FROM bodied) JOIN {_RULES} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY body),
bodies AS (SELECT body, any_value(says) AS says, count(*) AS times, {_crc32("body")} % 4 = 0 AS held FROM bodied LEFT JOIN ruled USING (body) WHERE body <> '' GROUP BY body),
cuts AS (SELECT *, unnest(list_transform(range(1, len(body) + 1), lambda k: substr(repeat(chr(2), 4) || body, k, 5))) AS gram FROM bodies),
windows AS (SELECT gram, {", ".join(f"coalesce(sum(times) FILTER (says = '{v}'{also}), 0)::BIGINT AS {c}" for c, v, also in (("a", "allow", ""), ("r", "block", ""), ("a_rest", "allow", " AND NOT held"), ("r_rest", "block", " AND NOT held")))} FROM cuts GROUP BY gram),
{_models(4, ["a", "r", "a_rest", "r_rest"])},
totals AS (SELECT {", ".join(f"sum({c}) > 0 AS has_{c}" for c in ("a", "r", "a_rest", "r_rest"))} FROM windows),
scores AS (
    SELECT own AS gram, CASE WHEN has_a AND has_r THEN round((ln(p_a) - ln(p_r)) * 1000000)::BIGINT ELSE 0 END AS score,
        CASE WHEN has_a_rest AND has_r_rest THEN round((ln(p_a_rest) - ln(p_r_rest)) * 1000000)::BIGINT ELSE 0 END AS score_rest
    FROM w4 CROSS JOIN totals
),
scored AS (SELECT body, floor(sum(score) / len(body))::BIGINT AS score, floor(sum(score_rest) / len(body))::BIGINT AS score_rest FROM cuts JOIN scores USING (gram) GROUP BY body),
classes AS (SELECT floor(score_rest / 1000)::BIGINT AS spot, coalesce(sum(times) FILTER (says = 'allow'), 0) AS a, coalesce(sum(times) FILTER (says = 'block'), 0) AS r FROM bodies JOIN scored USING (body) WHERE held AND says IS NOT NULL GROUP BY 1),
worth AS (SELECT spot, coalesce(lag(spot) OVER (ORDER BY spot), spot) AS prior, (sum(r) OVER (ORDER BY spot) - r) * (SELECT sum(a) FROM classes) - (sum(a) OVER (ORDER BY spot) - a) * (SELECT sum(r) FROM classes) AS worth FROM classes),
least AS (SELECT coalesce((SELECT floor((prior + spot + 1) / 2)::BIGINT * 1000 FROM worth WHERE (SELECT sum(a) > 0 AND sum(r) > 0 FROM classes) ORDER BY worth DESC, spot LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN coalesce(score, 0) >= least THEN 'allow' ELSE 'block' END) AS verdict, coalesce(score, 0) / 1000000::DOUBLE AS score
FROM bodied LEFT JOIN ruled USING (body) LEFT JOIN scored USING (body) CROSS JOIN least
"""
