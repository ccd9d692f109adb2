"""SQL for the queries of this subpackage that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from meterlens.llm import fixity, urls

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+')"


def _shingles(source: str, key: str, size: str) -> str:
    return f"""
SELECT DISTINCT {key}, n, array_to_string(w[i : i + n - 1], ' ') AS shingle FROM (
  SELECT {key}, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (
    SELECT {key}, {size} AS n, w FROM (SELECT {key}, {_WORDS} AS w FROM {source})) WHERE n > 0 AND len(w) >= n)"""


def decontamination() -> str:
    """For tables whose items have five words or more, as the benchmark's have."""
    return f"""
WITH i AS ({_shingles("benchmark", "item_id", "least(5, len(w))")}),
d AS ({_shingles("documents", "doc_id", "5")}),
size AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM i JOIN d USING (n, shingle) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
FROM both_ JOIN size USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles"""


def preferences() -> str:
    head, body = "'<|' || role || '|>' || chr(10)", "text || '<|end|>' || chr(10)"
    mask = f"'0:' || length({head}) || ',' || CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END || length({body})"
    return f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last,
         min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS first FROM t),
r AS (
  SELECT conv_id, last, first, text AS good FROM p WHERE turn = last),
o AS (
  SELECT r.*, CASE WHEN r.first < r.last THEN p.text ELSE '' END AS bad FROM r JOIN p USING (conv_id) WHERE p.turn = r.first),
reply AS (SELECT *, good = bad AS same FROM o),
lead AS (
  SELECT p.conv_id, count(*) AS n, string_agg({head} || {body}, '' ORDER BY turn) AS prompt FROM p
  JOIN reply q ON q.conv_id = p.conv_id AND (p.turn < q.last OR p.turn = q.last AND q.same) GROUP BY ALL),
done AS (
  SELECT *, 'assistant' AS role FROM reply)
SELECT conv_id AS pair_id, coalesce(n, 0) AS common_turns, coalesce(prompt, '') AS prompt,
       CASE WHEN same THEN '' ELSE {head} || {body.replace("text", "good")} END AS chosen,
       CASE WHEN same THEN '' ELSE {head} || {body.replace("text", "bad")} END AS rejected,
       CASE WHEN same THEN '' ELSE {mask.replace("text", "good")} END AS chosen_mask,
       CASE WHEN same THEN '' ELSE {mask.replace("text", "bad")} END AS rejected_mask
FROM done LEFT JOIN lead USING (conv_id)"""


def fixity_audit() -> str:
    """For distinct page ids, and files of at most RANGE * FANOUT ** 3 bytes."""

    def digest(name: str, source: str) -> str:
        record = (
            "'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || url || crlf || 'Content-Length: ' "
            "|| strlen(payload) || crlf || crlf || payload || crlf || crlf"
        )
        return f"""
{name} AS (SELECT file_id, record_id, strlen(record) AS length, sha256(record) AS hash
  FROM (SELECT *, {record} AS record FROM (SELECT *, chr(13) || chr(10) AS crlf FROM {source})))"""

    def level(side: str, k: int) -> str:
        width = fixity.RANGE if k == 1 else fixity.FANOUT
        return f"""
{side}{k} AS (SELECT file_id, node // {width} AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash
  FROM {side}{k - 1} GROUP BY 1, 2)"""

    wide = [fixity.RANGE * fixity.FANOUT**k for k in range(4)]
    root = lambda side: (
        f"SELECT file_id, CASE WHEN (SELECT last FROM deep) < {wide[0]} THEN (SELECT min(hash) FROM {side}1 x WHERE x.file_id = f.file_id) "
        f"WHEN (SELECT last FROM deep) < {wide[1]} THEN (SELECT min(hash) FROM {side}2 x WHERE x.file_id = f.file_id) "
        f"WHEN (SELECT last FROM deep) < {wide[2]} THEN (SELECT min(hash) FROM {side}3 x WHERE x.file_id = f.file_id) "
        f"ELSE (SELECT min(hash) FROM {side}4 x WHERE x.file_id = f.file_id) END AS root FROM (SELECT DISTINCT file_id FROM {side}0) f"
    )
    levels = ",".join(level(side, k) for side in "ab" for k in range(1, 5))
    return f"""
WITH rec AS (
  SELECT page_id // 1024 AS file_id, page_id AS record_id, coalesce(url, '') AS url, coalesce(html, '') AS payload
  FROM pages WHERE page_id IS NOT NULL),
worn AS (
  SELECT file_id, record_id, url, CASE WHEN record_id % 997 = 5 THEN replace(payload, '<', '(')
    WHEN record_id % 2003 = 11 THEN payload[1 : length(payload) // 2] ELSE payload END AS payload
  FROM rec WHERE record_id % 1499 <> 7),
{digest("mine", "rec")},{digest("copies", "worn")},
placed AS (SELECT *, sum(length) OVER (PARTITION BY file_id ORDER BY record_id) - length AS node FROM mine),
a0 AS (SELECT file_id, CAST(node AS BIGINT) AS node, hash FROM placed),
b0 AS (SELECT file_id, CAST(node AS BIGINT) AS node, c.hash FROM placed p JOIN copies c USING (file_id, record_id)),
{levels},
deep AS (SELECT max(node) AS last FROM a0),
ra AS ({root("a")}), rb AS ({root("b")}),
bad AS (
  SELECT file_id, count(*) AS n, string_agg(node || ':' || kind, ',' ORDER BY node) AS found FROM (
    SELECT file_id, node, CASE WHEN b0.hash IS NULL THEN 'missing' WHEN a0.hash IS NULL THEN 'extra' ELSE 'changed' END AS kind
    FROM a0 FULL JOIN b0 USING (file_id, node) WHERE a0.hash IS DISTINCT FROM b0.hash) GROUP BY ALL),
sizes AS (SELECT file_id, count(*) AS n_records, sum(length) AS n_bytes FROM mine GROUP BY ALL)
SELECT file_id, n_records, CAST(n_bytes AS BIGINT) AS n_bytes, ra.root, rb.root AS replica_root, coalesce(n, 0) AS n_damaged,
       coalesce(found, '') AS damaged
FROM sizes LEFT JOIN ra USING (file_id) LEFT JOIN rb USING (file_id) LEFT JOIN bad USING (file_id)"""


def url_verdicts(depth: int = 4) -> str:
    """For tables in which no path has frequent segments beyond `depth`."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in rules) + " END"
    spelled = "s"
    for sign in "%*{|}":
        spelled = f"replace({spelled}, '{sign}', '%{ord(sign):02X}')"
    wide = lambda n, m: f"sqrt(p * (1 - p) * (1 / greatest({n}, 1) + 1 / greatest({m}, 1)))"
    steps = []
    for k in range(1, depth + 1):
        steps.append(f"""
c{k} AS (SELECT host, prefix, seg[{k}] AS s, count(*) AS n, count(good) AS lab, coalesce(sum(good), 0) AS ok
  FROM r{k - 1} WHERE len(seg) >= {k} GROUP BY ALL),
e{k} AS (SELECT *, sum(n) OVER v AS total, sum(lab) OVER v - lab AS lab1, sum(ok) OVER v - ok AS ok1,
    sum(ok) OVER v / greatest(sum(lab) OVER v, 1) AS p FROM c{k} WINDOW v AS (PARTITION BY host, prefix)),
go{k} AS (SELECT coalesce(max(total), 0) >= 8 AND (SELECT go FROM go{k - 1}) AS go FROM e{k}),
f{k} AS (SELECT * EXCLUDE (p), ok / greatest(lab, 1) AS purity FROM e{k} WHERE (SELECT go FROM go{k}) AND n >= 8 AND (n >= 0.05 * total
  OR lab > 0 AND lab1 > 0 AND abs(ok / greatest(lab, 1) - ok1 / greatest(lab1, 1)) > 2.0 * {wide("lab", "lab1")})),
g{k} AS (SELECT *, (ok + ok0) / greatest(lab + lab0, 1) AS p FROM (
  SELECT *, lag(ok) OVER w AS ok0, lag(lab) OVER w AS lab0, lag(purity) OVER w AS purity0
  FROM f{k} WINDOW w AS (PARTITION BY host, prefix ORDER BY purity, s))),
h{k} AS (SELECT *, sum(CASE WHEN lab > 0 AND lab0 > 0 AND purity - purity0 > 2.0 * {wide("lab", "lab0")} THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, prefix ORDER BY purity, s) AS branch FROM g{k}),
m{k} AS (SELECT host, prefix, s, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) <= {urls.MOST_NAMED}
    THEN '{{' || array_to_string(l, '|') || '}}' ELSE '{{' || l[1] || '|' || len(l) || '|' || md5(array_to_string(l, '|')) || '}}' END AS part
  FROM (SELECT host, prefix, list_sort(list({spelled})) AS l, unnest(list(s)) AS s FROM h{k} GROUP BY host, prefix, branch)),
r{k} AS (SELECT r.* EXCLUDE (prefix, level), level + CASE WHEN (SELECT go FROM go{k}) THEN 1 ELSE 0 END AS level,
    r.prefix || CASE WHEN len(seg) < {k} OR NOT (SELECT go FROM go{k}) THEN '' ELSE '/' || coalesce(part, '*') END AS prefix
  FROM r{k - 1} r LEFT JOIN m{k} m ON m.host = r.host AND m.prefix = r.prefix AND m.s = seg[{k}])""")
    return f"""
WITH l AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r0 AS (SELECT u.*, good, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, '' AS prefix, 0 AS level
  FROM u LEFT JOIN l USING (page_id)),
go0 AS (SELECT true AS go),
{",".join(steps)},
t AS (SELECT *, host || prefix || CASE WHEN len(seg) > level THEN '/**' ELSE '' END AS template FROM r{depth}),
a AS (SELECT host, template, count(good) AS n, coalesce(sum(good), 0) AS good FROM t GROUP BY ALL),
b AS (SELECT host, sum(n) AS n, sum(good) AS good FROM a GROUP BY ALL),
o AS (SELECT sum(n) AS n, sum(good) / sum(n) AS p, sum(good * good / n) AS squares, count(*) AS hosts, sum(n * n) AS sizes
  FROM b WHERE n > 0),
q AS (SELECT coalesce(p, 1.0) AS p, CASE WHEN n - sizes / n > 0 THEN (squares - p * p * n - (hosts - 1) * p * (1 - p)) / (n - sizes / n)
  ELSE 0 END AS spread FROM o),
w AS (SELECT p, CASE WHEN spread > 1e-9 THEN round(least(10.0, greatest(1.0, p * (1 - p) / spread - 1)), 6) ELSE 10.0 END AS m FROM q),
j AS (SELECT host, template, (a.good + m * ((b.good + m * p) / (b.n + m))) / (a.n + m) AS purity FROM a JOIN b USING (host), w)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule,
       coalesce({case(lambda r: r[0])}, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template,
       round(purity, 9) AS purity
FROM t JOIN j USING (host, template)"""
