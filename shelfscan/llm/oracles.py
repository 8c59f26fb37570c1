"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .credentials import ACCESS, ASSIGN, HEX, OPAQUE
from .settings import MIX, SHARDS, SITE
from .sharding import MULTIPLIERS, ROUNDS, round_keys

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_sql(table: str, site: str = SITE, min_sites: int = 10) -> str:
    """All columns of ``table`` with text less widespread lines, n_lines and n_removed."""
    return f"""
    WITH rows_ AS (SELECT *, row_number() OVER () AS row_, {site} AS site_ FROM {table}),
    split_ AS (
        SELECT row_, site_, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
        FROM rows_ WHERE text IS NOT NULL
    ),
    bad AS (
        SELECT trim(line) AS line FROM split_ WHERE trim(line) <> ''
        GROUP BY 1 HAVING count(DISTINCT site_) >= {min_sites}
    ),
    marked AS (
        SELECT s.row_, s.line, s.pos, b.line IS NOT NULL AS gone
        FROM split_ s LEFT JOIN bad b ON trim(s.line) = b.line
    ),
    joined AS (
        SELECT row_, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
               count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
        FROM marked GROUP BY row_
    )
    SELECT r.* EXCLUDE (row_, site_, text), j.text, coalesce(j.n_lines, 0) AS n_lines,
           coalesce(j.n_removed, 0) AS n_removed
    FROM rows_ r LEFT JOIN joined j USING (row_)
    """


ORACLES["op10_line_dedup"] = (
    f"SELECT doc_id, text, n_lines, n_removed FROM ({lines_sql('documents')})"
)


def _weight(level: str, name: str) -> str:
    whens = " ".join(f"WHEN {_quoted(g)} THEN {w}" for g, w in MIX["weights"].get(name, []))
    return f"CASE {level} {whens} ELSE 1.0 END" if whens else "1.0"


def mix_sql(table: str) -> str:
    """All columns of ``table`` with mix_0.., mix_tokens, mix_copies, by plain windows."""
    names = list(MIX["levels"])
    path = [f"mix_{i}" for i in range(len(names))]
    domain = "'d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)"
    source = [domain, "lang", "source"]
    text = (
        "WITH rows_ AS (SELECT * EXCLUDE (t_), "
        + ", ".join(f"coalesce({e}, 'unknown') AS {p}" for e, p in zip(source, path))
        + ", CAST(1 + length(t_) - length(replace(replace(t_, ' ', ''), chr(10), '')) AS BIGINT)"
        + f" AS mix_tokens FROM (SELECT *, coalesce(text, '') AS t_ FROM {table})),\n"
        f"t0 AS (SELECT {', '.join(path)}, sum(mix_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),\n"
        f"s0 AS (SELECT *, tokens::DOUBLE * {MIX['max_epochs']} AS supply, "
        f"least(floor(sum(tokens) OVER () * {MIX['budget_share']}::DOUBLE)::DOUBLE, "
        f"sum(tokens::DOUBLE * {MIX['max_epochs']}) OVER ()) AS share FROM t0),\n"
    )
    for n, name in enumerate(names):
        node, child = path[:n], path[: n + 1]
        part = f"PARTITION BY {', '.join(node)}" if node else ""
        order = f"ORDER BY ratio, {child[-1]}"
        text += f"""
        g{n} AS (SELECT {', '.join(child)}, {_weight(child[-1], name)}::DOUBLE AS w,
                 sum(supply) AS s, max(share) AS give FROM s{n} GROUP BY {', '.join(child)}),
        r{n} AS (SELECT *, s / w AS ratio FROM g{n}),
        l{n} AS (SELECT *, (give - coalesce(sum(s) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{n}),
        w{n} AS (SELECT *, min(level) FILTER (WHERE level <= ratio) OVER ({part}) AS low,
                 first_value(CASE WHEN level <= ratio THEN level END IGNORE NULLS)
                 OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM l{n}),
        s{n + 1} AS (SELECT s.* EXCLUDE (share), least(w.s, coalesce(w.water * w.w, w.s)) AS share
                     FROM s{n} s JOIN w{n} w USING ({', '.join(child)})),"""
    keys = ", ".join(path)
    text += f"""
    plan AS (SELECT *, floor(share + 1e-6)::BIGINT AS target FROM s{len(names)}),
    whole_ AS (SELECT {keys}, target // tokens AS whole, target - (target // tokens) * tokens AS rest FROM plan),
    placed AS (SELECT r.*, whole, rest, substr(md5('{MIX['seed']}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12) AS place
               FROM rows_ r JOIN whole_ USING ({keys})),
    run AS (SELECT *, whole + (sum(mix_tokens) OVER (PARTITION BY {keys} ORDER BY place, doc_id NULLS FIRST, mix_tokens
            ROWS UNBOUNDED PRECEDING) <= rest)::INT AS mix_copies FROM placed)
    SELECT * EXCLUDE (whole, rest, place) FROM run WHERE mix_copies > 0"""
    return text


ORACLES["op2_mixing"] = (
    "SELECT doc_id, mix_0 AS domain, mix_1 AS language, mix_2 AS leaf, mix_tokens, "
    f"mix_copies::BIGINT AS mix_copies FROM ({mix_sql('documents')})"
)


def _found(kind: int, pattern: str, value: str, keep: str) -> str:
    """(row_, start, end, kind, value) of one kind's matches."""
    quoted = _quoted(pattern)
    return f"""
    SELECT row_, doc_id, source, lang, {kind} AS kind, s AS start, s + length(v) AS "end", {value} AS value
    FROM (
        SELECT row_, doc_id, source, lang, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i:
            list_sum(list_transform(p[1:i], lambda x: length(x))) +
            coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
        FROM (SELECT row_, doc_id, source, lang, regexp_extract_all(text, {quoted}, 0) AS m,
                     regexp_split_to_array(text, {quoted}) AS p FROM rows_)
        WHERE len(m) > 0)
    WHERE {keep}"""


def secrets_sql(example_owners: int = 3) -> str:
    group2 = f"regexp_extract(v, {_quoted(ASSIGN)}, 2)"
    mixed = " AND ".join(f"regexp_matches(v, '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]"))
    name = "['assign', 'access', 'hex', 'opaque'][kind + 1]"
    label = f"{name} || ':' || start || ':' || \"end\""
    return f"""
    WITH rows_ AS (SELECT row_number() OVER () AS row_, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
    base AS ({_found(0, ASSIGN, group2, f"length({group2}) >= 6")}
        UNION ALL {_found(1, ACCESS, 'v', 'true')} UNION ALL {_found(2, HEX, 'v', 'true')}),
    more AS (SELECT * FROM ({_found(3, OPAQUE, 'v', mixed)}) o WHERE NOT EXISTS
        (SELECT 1 FROM base b WHERE b.row_ = o.row_ AND b.start < o."end" AND o.start < b."end")),
    every AS (FROM base UNION ALL FROM more),
    held AS (SELECT value, count(DISTINCT source) AS n_owners FROM every GROUP BY value),
    judged AS (SELECT e.*, n_owners >= {example_owners} AS example FROM every e JOIN held USING (value)
               WHERE kind < 3 OR n_owners < {example_owners}),
    said AS (
        SELECT row_, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
               count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE NOT example) AS n_live,
               string_agg({label}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
               string_agg({label}, ',' ORDER BY start, kind) AS spans
        FROM judged GROUP BY row_)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
    FROM rows_ LEFT JOIN said USING (row_)"""


ORACLES["op8_secrets"] = secrets_sql()


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, over the polynomial's byte table."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda a, x: xor(a >> 8, {table}[(xor(a, x) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}))"


def _network(value: str) -> str:
    """Select list: one pass of the sharding network over ``value``, as column ``out``."""

    def mixed(number: str) -> str:
        found = f"[({number}) & 4294967295]"
        for factor in MULTIPLIERS:
            found = f"list_transform({found}, lambda x: (xor(x, x >> 16) * {factor}) & 4294967295)"
        return f"list_transform({found}, lambda x: xor(x, x >> 15))[1]"

    parts, high, low = [f"{value} >> lower AS h", f"{value} & ((1::BIGINT << lower) - 1) AS l"], "h", "l"
    for at, key in enumerate(round_keys(SHARDS["seed"])[:ROUNDS]):
        if at % 2:
            parts.append(f"xor({low}, {mixed(f'{high} + {key}')} & ((1::BIGINT << lower) - 1)) AS l{at}")
            low = f"l{at}"
        else:
            parts.append(f"xor({high}, {mixed(f'{low} + {key}')} & ((1::BIGINT << upper) - 1)) AS h{at}")
            high = f"h{at}"
    return ", ".join([*parts, f"(({high} << lower) | {low}) AS out"])


ORACLES["op13_sharding"] = f"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
               {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
    rows_ AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS shard_row FROM sized),
    wide AS (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS bits FROM sized),
    halves AS (SELECT n, (bits // 2)::BIGINT AS upper, (bits - bits // 2)::BIGINT AS lower FROM wide),
    walk AS (
        SELECT shard_row, out FROM (SELECT shard_row, {_network("shard_row")} FROM rows_, halves)
        UNION ALL
        SELECT shard_row, out2 FROM (SELECT shard_row, n, {_network("w.out").replace(" AS out", " AS out2")} FROM walk w, halves WHERE w.out >= n))
    SELECT doc_id, size, text_crc32, 'rows' AS law, (out % {SHARDS["shards"]})::INT AS shard,
           out // {SHARDS["shards"]} AS slot, NULL::INT AS grown_shard, shard_row
    FROM rows_ JOIN walk USING (shard_row), halves WHERE out < n"""


def spelling_sql(table: str = "documents", every: int = 199) -> str:
    """Words with their forms by all texts with one character left out, in plain joins."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    left_out = "substr(word, 1, i - 1) || substr(word, i + 1)"
    return f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
            translate(text, '{upper}', '{lower}'), '[a-z\u00C0-\u00FF]+')) AS word FROM {table}),
    told AS (SELECT doc, word, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT word, n, {_crc32("doc || ':' || word")} AS h FROM told),
    words AS (
        SELECT CASE WHEN h % {every} = 0
               THEN substr(word, 1, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2)
               ELSE word END AS word, sum(n)::BIGINT AS n
        FROM hashed GROUP BY 1),
    kept AS (SELECT * FROM words WHERE length(word) >= 6 AND n >= 5),
    less AS (SELECT word, n, i, {left_out} AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM kept)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN kept b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN kept b ON a.rest = b.word),
    ranked AS (
        SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
               row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near COLLATE "C") AS place FROM pairs),
    formed AS (
        SELECT k.word, k.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
               CASE WHEN r.near_n >= 5 * k.n THEN r.near END AS form,
               CASE WHEN r.near_n >= 5 * k.n THEN r.near_n END AS form_n
        FROM kept k LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
    way AS (
        SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM formed
        UNION ALL
        SELECT w.word, coalesce(f.form, f.word), f.form IS NULL FROM way w JOIN formed f ON w.root = f.word WHERE NOT w.ended)
    SELECT word, n, n_near, form, form_n, root FROM formed JOIN way USING (word) WHERE ended"""


ORACLES["op11_spelling"] = spelling_sql()
