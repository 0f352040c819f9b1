"""DuckDB SQL for the queries of this subpackage that SQL can express, from its own parameters."""

from __future__ import annotations

from quire.llm.url_reputation import IP, IPV4, IPV6, LEVELS, RULES, SECOND_LABELS, SITE_SUFFIXES, STRENGTH

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, min(struct_pack(less := -length(text), unnamed := doc_id IS NULL, doc_id := doc_id)) AS best
  FROM t GROUP BY norm
)
SELECT t.doc_id, g.best.doc_id AS keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.best.doc_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def lines(min_docs: int = 3, min_chars: int = 20) -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents
), l AS (
  SELECT rid, doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS pos FROM d
), k AS (
  SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l
), h AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) + bool_or(doc_id IS NULL)::INT >= {min_docs}
), m AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.last AS gone FROM k LEFT JOIN h USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def substrings(window: int = 20) -> str:
    words = ", ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, window))])
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS cut FROM documents
), w AS (
  SELECT rid, doc_id, unnest(cut) AS word, generate_subscripts(cut, 1) AS pos FROM d
), v AS (
  SELECT *, CASE WHEN lead(word, {window - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {words}) END AS seen FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), a AS (
  SELECT *, seen IS NOT NULL AND row_number() OVER (PARTITION BY seen ORDER BY doc_id, pos) > 1 AS again FROM v
), c AS (
  SELECT *, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM a
), s AS (
  SELECT rid, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY rid
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (rid)
"""


def urls(limit: float = 0.5, bound: float = 1.645) -> str:
    def tail(k: int) -> str:
        return f"array_to_string(list_slice(parts, greatest(len(parts) - {k - 1}, 1), len(parts)), '.')"

    long = f"({tail(2)} IN ({', '.join(map(repr, SITE_SUFFIXES))}) OR regexp_matches({tail(2)}, '^({'|'.join(SECOND_LABELS)})\\.[a-z][a-z]$'))"
    address = f"(regexp_matches(host, '{IPV4}') OR regexp_matches(host, '{IPV6}'))"
    cases = {"rule": [], "verdict": []}
    for text, says in sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True):
        site, start = text[: text.find("/")], text[text.find("/") :]
        fits = f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{start}') THEN"
        cases["rule"].append(f"{fits} '{text}'")
        cases["verdict"].append(f"{fits} '{says}'")
    steps, above = [], None
    for at, level in enumerate(LEVELS):
        path = ", ".join(LEVELS[: at + 1])
        source = f"FROM hosts JOIN {above} USING ({', '.join(LEVELS[:at])})" if above else "FROM hosts, total"
        prior = "any_value(mean)" if above else "any_value((total.bad + 1) / (total.n + 2))"
        steps.append(f"""g{at} AS (
  SELECT {path}, CAST(sum(hosts.n) AS DOUBLE) AS n, CAST(sum(hosts.bad) AS DOUBLE) AS bad, {prior} AS m {source} GROUP BY {path}
), r{at} AS (
  SELECT CASE WHEN sum(n * m * (1 - m) * (n - 1)) FILTER (n > 0) <> 0
              THEN sum(pow(bad - n * m, 2) - n * m * (1 - m)) / sum(n * m * (1 - m) * (n - 1)) FILTER (n > 0) ELSE 0 END AS rho FROM g{at}
), s{at} AS (
  SELECT least(greatest(1 / greatest(rho, 1e-9) - 1, {STRENGTH[0]}), least({STRENGTH[1]}, total.n + 2)) AS strength FROM r{at}, total
), p{at} AS (
  SELECT {path}, n, strength, (bad + m * strength) / (n + strength) AS mean FROM g{at}, s{at}
)""")
        above = f"p{at}"
    return f"""
WITH u AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), known AS (
  SELECT doc_id AS page_id, greatest(max(1 - quality), max(toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bad IN (0, 1)
), named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS site FROM u
), counts AS (
  SELECT site AS host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(site, '.') AS parts FROM named LEFT JOIN known USING (page_id) WHERE named.host <> '' GROUP BY site
), hosts AS (
  SELECT host, n, bad, CASE WHEN {address} THEN '{IP}' WHEN {long} THEN {tail(2)} ELSE {tail(1)} END AS suffix,
         CASE WHEN {address} THEN host WHEN {long} THEN {tail(3)} ELSE {tail(2)} END AS domain FROM counts
), total AS (
  SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM hosts
), {", ".join(steps)}, f AS (
  SELECT named.page_id, named.host, path, mean - {bound} * sqrt(mean * (1 - mean) / (n + strength + 1)) AS score FROM named LEFT JOIN {above} ON {above}.host = site
)
SELECT page_id, host, path, CASE {" ".join(cases["rule"])} END AS rule,
       CASE {" ".join(cases["verdict"])} WHEN score > {limit} THEN 'block' ELSE 'allow' END AS verdict, round(score, 6) AS reputation
FROM f
"""


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """For vectors of one length that parts divides."""
    apart = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(error := {apart}, e := e)) AS best FROM p JOIN b{n} b USING (part) GROUP BY ALL
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT part, best.e AS e, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT r, part, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM p) JOIN a{n} USING (r, part) GROUP BY ALL
), b{n + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(n.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT part, e, list(x ORDER BY d) AS v FROM m{n} GROUP BY ALL) n USING (part, e)
)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT r, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS d, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM k
), p AS MATERIALIZED (
  SELECT r, d * {parts} // n AS part, list(x ORDER BY d) AS v FROM x GROUP BY ALL
), b0 AS MATERIALIZED (
  SELECT part, r AS e, v FROM p WHERE r < {entries}
), {", ".join(steps)}, s AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.error) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN s USING (r), h
"""


def repairs(rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5) -> str:
    """The cheapest state of each conversation after each turn, turn by turn."""
    line = "chr(10) || {} || ':' || {}"

    def after(state: str, cost: str, letter: str, said: str = "''") -> str:
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', r := {state}.r || {said})"

    def least(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def stay(state: str, role: str) -> str:
        kept = f"CASE WHEN kind = 'd' THEN 1000000 WHEN initial = '{role[0]}' THEN more ELSE 1000000 END"
        return after(state, kept, "K", line.format("role", "text"))

    def turned(state: str, role: str) -> str:
        return after(state, f"CASE WHEN kind = 'd' THEN 1000000 ELSE more + {rerole} END", "R", line.format(f"'{role}'", "text"))

    def added(state: str, role: str) -> str:
        return after(state, str(insert), "I", line.format(f"'{role}'", "''"))

    gone = [after(f"s{i}", str(delete), "D") for i in range(4)]
    users = [f(f"s{i}", "user") for i in (0, 1, 3) for f in (stay, turned)]
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) g(i))
), q AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), z AS (
  SELECT cid, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM q, tab
), dm AS (
  SELECT cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE fault <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS n, trim(text, {_BLANKS}) AS bare, left(role, 1) AS initial FROM dm
), f AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY n) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY cid ORDER BY n) || initial AS pair FROM o
), k AS MATERIALIZED (
  SELECT *, CASE WHEN fault IN (1, 2) THEN 'd' ELSE initial END AS kind, CASE WHEN fault = 3 THEN {truncated} ELSE 0 END AS more FROM f
), st(cid, n, s0, s1, s2, s3) AS (
  SELECT DISTINCT cid, 0::BIGINT, struct_pack(c := 0, a := '', r := ''), struct_pack(c := 1000000, a := '', r := ''),
         struct_pack(c := {insert}, a := 'I', r := chr(10) || 'user:'), struct_pack(c := {2 * insert}, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:') FROM k
  UNION ALL
  SELECT cid, n, s0, s1, s2, {least("s3", added("s2", "assistant"))} FROM (
    SELECT cid, n, s0, s1, s3, {least("s2", added("s0", "user"), added("s1", "user"), added("s3", "user"))} AS s2 FROM (
      SELECT cid, k.n, {gone[0]} AS s0, {least(gone[1], stay("s0", "system"))} AS s1, {least(gone[2], *users)} AS s2, {least(gone[3], stay("s2", "assistant"), turned("s2", "assistant"))} AS s3
      FROM st JOIN k USING (cid) WHERE k.n = st.n + 1))
), en AS (
  SELECT cid, {least("s0", "s3")} AS s FROM st JOIN (SELECT cid, max(n) AS n FROM k GROUP BY cid) USING (cid, n)
), c AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM q) LEFT JOIN c USING (cid) LEFT JOIN en USING (cid)
"""
