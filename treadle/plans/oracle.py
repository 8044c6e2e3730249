"""The same queries as SQL for DuckDB, made with the same constants."""

from __future__ import annotations

from treadle.constants import ALPHA, DECAY_INTERVAL_SECS, EDGE_MIN_WEIGHT, MAX_GAP_SECS, MIN_GAP_SECS, REPEAT_SECS, REPEAT_SLOTS, ROUNDS, TOP_K
from treadle.plans import queries as Q
from treadle.sources import tables as T


def text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"'{value}'::DOUBLE"
    return str(value)


def values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns}))"


WORD = "coalesce(nullif(regexp_replace(split_part(replace(trim(text), chr(10), ' '), ' ', 1), '[./]', '', 'g'), ''), 'x')"
FILES = f"""
files AS (
  SELECT '/data' AS root, '/data/parts/' || p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.csv' AS path, 'part' AS source FROM part
  UNION ALL SELECT '/data', '/data/customers/' || c_mktsegment || '/' || c_name || '.vcf', 'customer' FROM customer
  UNION ALL SELECT '/data', '/data/suppliers/' || n_name || '/' || s_name || '.json', 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT '/data', '/data/docs/' || lang || '/' || source || '/' || {WORD} || '-' || doc_id || '.txt', 'documents' FROM documents
  UNION ALL SELECT '/data', '/data/web/' || rtrim(regexp_replace(url, '^[a-z]+://', ''), '/'), 'pages' FROM pages
)"""
ENTRIES = f"""{FILES}, parted AS (SELECT root, string_split(path, '/') AS s FROM files WHERE path IS NOT NULL), entries AS (
  SELECT root, path, false AS is_dir, 0.0::DOUBLE AS score FROM files WHERE path IS NOT NULL
  UNION ALL SELECT DISTINCT root, array_to_string(list_slice(s, 1, k), '/'), true, 0.0::DOUBLE FROM (SELECT root, s, unnest(range(2, len(s))) AS k FROM parted)
)"""
BASE = "regexp_extract(path, '[^/]*$')"
OLD = """old AS (
  SELECT f.root, f.path, false AS is_dir, coalesce(d.dead, false) AS dead FROM files f
  LEFT JOIN (SELECT '/data/customers/' || c_mktsegment || '/' || c_name || '.vcf' AS path, true AS dead FROM customer WHERE c_acctbal < 0) d USING (path)
  WHERE f.source IN ('part', 'customer', 'documents') AND f.path IS NOT NULL
), listing AS (SELECT DISTINCT root, path, false AS is_dir FROM files WHERE source <> 'part' AND path IS NOT NULL)"""


def tier(base: str, query: str) -> str:
    inner = " OR ".join(f"contains({base}, {text(b)} || {query})" for b in ".-_ ")
    return f"CASE WHEN {base} = {query} THEN 0 WHEN starts_with({base}, {query}) THEN 1 WHEN {inner} THEN 2 ELSE 3 END"


def where(query: str, root: str = "/data") -> tuple[str, str]:
    """(condition, tier) of a search."""
    if not query:
        return f"starts_with(path, '{root}/') AND NOT contains(substr(path, {len(root) + 2}), '/') AND length(path) > {len(root) + 1}", "0"
    if len(query.encode()) == 1 or "/" in query:
        return f"starts_with(path, {text(query if query.startswith('/') else f'{root}/{query}')})", "0"
    return f"contains({BASE}, {text(query)})", tier(BASE, text(query))


def hits(query: str, limit: int = TOP_K) -> str:
    condition, place = where(query)
    return f"""WITH {ENTRIES}, m AS (SELECT path, is_dir, {place} AS tier, score FROM entries WHERE {condition})
SELECT path, is_dir, tier::INTEGER AS tier, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY tier, score DESC, path) AS rank FROM m) WHERE rank <= {limit}"""


ALL_MATCHES = " UNION ALL ".join(f"SELECT {k} AS qid, path, is_dir, {where(t)[1]} AS tier, score FROM entries WHERE {where(t)[0]}" for k, t in enumerate(T.TEXTS))
REPLIES = f"""{ENTRIES}, m AS ({ALL_MATCHES}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, path) AS rank FROM m
), t AS (
  SELECT q.qid::INTEGER AS qid, count(r.path) AS total, count(CASE WHEN rank <= {TOP_K} THEN 1 END) AS hits,
    coalesce(string_agg('{{"path":"' || replace(replace(path, '\\', '\\\\'), '"', '\\"') || '","score":' || printf('%.4f', score) || ',"is_dir":' || is_dir::VARCHAR || '}}', ',' ORDER BY rank) FILTER (rank <= {TOP_K}), '') AS list
  FROM range({len(T.TEXTS)}) AS q(qid) LEFT JOIN r ON r.qid = q.qid GROUP BY q.qid
), replies AS (
  SELECT qid, total, hits, '{{"total":' || total || ',"root":"{T.ROOT}","indexed":' || (SELECT count(*) FROM entries) || ',"scan_done":true,"unwatched":0,"root_lost":false,"index_gen":0,"score_gen":0,"hits":[' || list || ']}}' AS reply FROM t
)"""
TOKENS = f"""{ENTRIES}, names AS (SELECT root, path, {BASE} AS name FROM entries), segs AS (
  SELECT root, path, unnest(list_filter(string_split_regex(name, '[.\\-_ ]'), lambda x: x <> '')) AS segment FROM names
), postings AS (
  SELECT DISTINCT token, root, path FROM (
    SELECT substr(segment, k) AS token, root, path FROM (SELECT root, path, segment, unnest(range(1, length(segment) + 1)) AS k FROM segs)
    UNION ALL SELECT name, root, path FROM names) WHERE strlen(token) >= 2
)"""

EVENTS = """ev AS (
  SELECT event_id, ts, '/events/r' || (user_id % 4) AS root,
    '/events/r' || (user_id % 4) || '/item_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) || '.log' AS path,
    CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' END AS kind
  FROM events
)"""
TREE = f"""{EVENTS}, items AS (SELECT *, regexp_extract(path, '_([0-9]+)', 1)::BIGINT AS item FROM ev
), marked AS (SELECT *, (kind = 'delete' AND item % 5 = 0) OR (kind = 'open' AND item = 19) AS is_dir FROM items
), tree AS (
  SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS n, root, root || '/d' || (item % 4) || CASE WHEN is_dir THEN '' ELSE '/item_' || item || '.log' END AS path,
    CASE WHEN kind = 'create' AND item % 2 = 0 THEN 'move_in' ELSE kind END AS kind, is_dir FROM marked
)"""


def tree_life(events: str) -> str:
    """The files of ``events`` after all of them."""
    return f"""own AS (SELECT root, path, max(n) AS at, arg_max(kind, n) AS kind FROM {events} WHERE kind IN ('create', 'move_in', 'delete') GROUP BY root, path
), gone AS (
  SELECT e.root, e.path, max(d.n) AS n FROM (SELECT DISTINCT root, path FROM {events} WHERE NOT is_dir) e
  JOIN {events} d ON e.root = d.root AND ((d.kind = 'delete' AND d.is_dir AND starts_with(e.path, d.path || '/')) OR d.kind = 'root_gone') GROUP BY e.root, e.path
), tlife AS (
  SELECT e.root, e.path, false AS is_dir, CASE WHEN g.n > coalesce(o.at, 0) THEN true ELSE coalesce(o.kind = 'delete', false) END AS dead
  FROM (SELECT DISTINCT root, path FROM {events} WHERE NOT is_dir) e LEFT JOIN own o USING (root, path) LEFT JOIN gone g USING (root, path)
)"""


ELIGIBLE = f"""{EVENTS}, elig AS (
  SELECT event_id, ts, root, path, kind FROM (
    SELECT *, coalesce(last_value(CASE kind WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
      OVER (PARTITION BY root, path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS live FROM ev)
  WHERE live AND kind IN ('open', 'edit')
)"""
GAPS = f"""{ELIGIBLE}, gaps AS (
  SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY root ORDER BY ts, event_id))) / 1e6, {MAX_GAP_SECS + 1}) AS gap FROM elig
)"""
CANDIDATES = f"""{GAPS}, gated AS (SELECT * FROM gaps WHERE gap >= {MIN_GAP_SECS}
), opn AS (SELECT *, lag(path) OVER (PARTITION BY root ORDER BY ts, event_id) AS src FROM gated WHERE kind = 'open'
), trans AS (SELECT root, ts, event_id, src, path AS dst FROM opn WHERE gap <= {MAX_GAP_SECS} AND src <> path
), cand AS (
  SELECT root, kind, ts, event_id, path AS src, NULL::VARCHAR AS dst FROM gated UNION ALL SELECT root, 'edge', ts, event_id, src, dst FROM trans
)"""
COUNTED = f"""{CANDIDATES}, c AS (
  SELECT *, src || chr(1) || coalesce(dst, '') AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY root, kind ORDER BY ts, event_id) AS rn FROM cand
), f AS (
  SELECT root, kind, rn, [{{'k': key, 'at': t}}] AS ring, true AS counted FROM c WHERE rn = 1
  UNION ALL
  SELECT root, kind, rn, CASE WHEN hit THEN ring ELSE list_append(ring, {{'k': key, 'at': t}})[-{REPEAT_SLOTS}:] END, NOT hit FROM (
    SELECT c.root, c.kind, c.rn, c.key, c.t, f.ring, len(list_filter(f.ring, lambda x: x.k = c.key AND c.t - x.at < {REPEAT_SECS})) > 0 AS hit
    FROM f JOIN c ON c.root = f.root AND c.kind = f.kind AND c.rn = f.rn + 1)
), counted AS (SELECT c.root, c.kind, c.event_id, c.src, c.dst FROM c JOIN f ON c.root = f.root AND c.kind = f.kind AND c.rn = f.rn WHERE f.counted)"""


def graph(name: str = "", condition: str = "true") -> str:
    """Opens, edges, nodes and shares of the counted rows that meet a condition."""
    return f"""vis{name} AS (SELECT root, src AS path, sum(1.0::DOUBLE) AS opens FROM counted WHERE kind <> 'edge' AND {condition} GROUP BY root, src
), edg{name} AS (SELECT root, src, dst, sum(1.0::DOUBLE) AS weight FROM counted WHERE kind = 'edge' AND {condition} GROUP BY root, src, dst
), nod{name} AS (SELECT n.root, n.path, coalesce(v.opens, 0.0::DOUBLE) AS opens FROM (
    SELECT root, path FROM vis{name} UNION SELECT root, src FROM edg{name} UNION SELECT root, dst FROM edg{name}) n LEFT JOIN vis{name} v USING (root, path)
), shr{name} AS (SELECT root, src, dst, weight / sum(weight) OVER (PARTITION BY root, src) AS share FROM edg{name})"""


def series(first: str, shares: str, name: str, rounds: int = ROUNDS) -> str:
    """CTEs name_0 .. name_n of residuals from ``first``, and name, the sum of what each settles."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT root, path, r FROM {first})"]
    for k in range(1, rounds):
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT x.root, s.dst AS path, sum({ALPHA} * x.r * s.share) AS r FROM {name}_{k - 1} x JOIN {shares} s ON x.root = s.root AND x.path = s.src GROUP BY x.root, s.dst)")
    settled = " UNION ALL ".join(f"SELECT root, path, {1 - ALPHA} * r AS p FROM {name}_{k}" for k in range(rounds))
    out.append(f"{name} AS (SELECT root, path, sum(p) AS p FROM ({settled}) GROUP BY root, path)")
    return ", ".join(out)


FULL = f"{COUNTED}, {graph()}, start AS (SELECT root, path, opens AS r FROM nod), {series('start', 'shr', 'pr')}"
LIFE = """life AS (
  SELECT e.root, e.path, false AS is_dir, coalesce(l.kind = 'delete', false) AS dead FROM (SELECT DISTINCT root, path FROM ev) e
  LEFT JOIN (SELECT root, path, arg_max(kind, (ts, event_id)) AS kind FROM ev WHERE kind IN ('create', 'delete') GROUP BY root, path) l USING (root, path)
)"""
SCORED = f"{FULL}, {LIFE}, scored AS (SELECT l.*, coalesce(p / {1 - ALPHA}, 0.0) AS score FROM life l LEFT JOIN pr USING (root, path))"
SAVED = f"""{SCORED}, {ENTRIES}, live AS (
  SELECT root, path, is_dir, score FROM entries UNION ALL SELECT root, path, is_dir, score FROM scored WHERE NOT dead
), snodes AS (
  SELECT root, (row_number() OVER (PARTITION BY root ORDER BY path) - 1)::INTEGER AS id, path, CASE WHEN path = root THEN '' ELSE substr(path, length(root) + 2) END AS rel,
    score * {1 - ALPHA} AS pgrk, coalesce(opens, 0.0::DOUBLE) AS opens, is_dir FROM live LEFT JOIN vis USING (root, path)
), sedges AS (
  SELECT e.root, a.id AS src, b.id AS dst, w AS weight FROM (SELECT *, weight * pow(0.5, {Q.SAVED_AFTER / (14 * 86400.0)!r}) AS w FROM edg) e
  JOIN snodes a ON a.root = e.root AND a.path = e.src JOIN snodes b ON b.root = e.root AND b.path = e.dst WHERE w >= {EDGE_MIN_WEIGHT}
)"""
HALF = "event_id <= (SELECT max(event_id) // 2 FROM events)"


def abbreviated(width: int) -> str:
    name, parts = "regexp_extract(rel, '[^/]*$')", "string_split(rel, '/')"
    options = [
        ("true", "rel"),
        (f"len({parts}) > 2", f"{parts}[1] || '/…/' || {parts}[-2] || '/' || {name}"),
        (f"len({parts}) > 1", f"'…/' || {parts}[-2] || '/' || {name}"),
        (f"len({parts}) > 1", f"'…/' || {name}"),
    ]
    cases = " ".join(f"WHEN {c} AND length({x}) <= {width} THEN {x}" for c, x in options)
    return f"CASE {cases} ELSE substr({name}, 1, {width - 1}) || '…' END AS w{width}"


def oracle_sql() -> dict[str, str]:
    own = {
        "cat_entries": f"WITH {ENTRIES} SELECT root, path, is_dir FROM entries",
        "cat_visible": f"""WITH {FILES}, p AS (SELECT root, unnest([path, replace(path, '/data/', '/data/.hidden/'), path || '/.x']) AS path FROM files WHERE path IS NOT NULL)
          SELECT root, path FROM p WHERE NOT contains(substr(path, length(root) + 1), '/.')""",
        "cat_ordered": f"WITH {ENTRIES} SELECT root, path, is_dir, (row_number() OVER (PARTITION BY root ORDER BY path) - 1)::INTEGER AS place FROM entries",
        "cat_seek": f"WITH {ENTRIES} SELECT * FROM (" + " UNION ALL ".join(f"(SELECT {text(k)} AS key, path FROM entries WHERE path >= {text(k)} ORDER BY path LIMIT 1)" for k in Q.SEEK_KEYS) + ")",
        "cat_upsert": f"""WITH {FILES}, {OLD} SELECT root, path, coalesce(l.is_dir, o.is_dir) AS is_dir, CASE WHEN l.path IS NOT NULL THEN false ELSE o.dead END AS dead
          FROM old o FULL JOIN listing l USING (root, path)""",
        "cat_lifecycle": f"WITH {EVENTS}, {LIFE} SELECT root, path, is_dir, dead FROM life",
        "cat_dir_delete": f"WITH {TREE}, {tree_life('tree')} SELECT root, path, is_dir, dead FROM tlife",
        "cat_root_lost": f"""WITH {TREE}, last AS (SELECT max(n) AS n FROM tree WHERE root = '{T.LOST_ROOT}'),
          lost AS (SELECT event_id, ts, t.n, root, path, CASE WHEN t.n = last.n THEN 'root_gone' ELSE kind END AS kind, is_dir FROM tree t, last), {tree_life('lost')}
          SELECT root, CASE WHEN root_lost THEN 0 ELSE indexed END::INTEGER AS indexed, true AS scan_done, 0 AS unwatched, root_lost, index_gen, score_gen
          FROM (SELECT root, count_if(NOT dead) AS indexed FROM tlife GROUP BY root)
          JOIN (SELECT root, bool_or(kind = 'root_gone') AS root_lost, count_if(kind IN ('create', 'move_in', 'delete'))::BIGINT AS index_gen, count_if(kind IN ('open', 'edit'))::BIGINT AS score_gen FROM lost GROUP BY root) USING (root)""",
        "acc_move_in": f"""WITH {TREE}, o AS (
            SELECT *, last_value(CASE WHEN kind IN ('create', 'move_in', 'delete') THEN n END IGNORE NULLS) OVER w AS changed_at,
              coalesce(last_value(CASE WHEN kind IN ('create', 'move_in') THEN true WHEN kind = 'delete' THEN false END IGNORE NULLS) OVER w, true) AS live
            FROM tree WINDOW w AS (PARTITION BY root, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          ), g AS (
            SELECT e.n, max(d.n) AS gone FROM tree e JOIN tree d ON e.root = d.root AND d.n < e.n AND d.kind = 'delete' AND d.is_dir AND starts_with(e.path, d.path || '/') GROUP BY e.n
          )
          SELECT event_id, root, path, CASE WHEN kind = 'move_in' THEN 'edit' ELSE kind END AS kind FROM o LEFT JOIN g USING (n)
          WHERE NOT is_dir AND (kind = 'move_in' OR (kind IN ('open', 'edit') AND live AND coalesce(gone, 0) <= coalesce(changed_at, 0)))""",
        "cat_delete_subtree": f"WITH {ENTRIES} SELECT root, path, is_dir, gone AS dead, gone AS newly_dead FROM (SELECT *, path = '{Q.DELETED}' OR starts_with(path, '{Q.DELETED}/') AS gone FROM entries)",
        "cat_diff": f"""WITH {FILES}, {OLD} SELECT root, path, coalesce(l.is_dir, o.is_dir) AS is_dir, l.path IS NULL AS dead FROM old o FULL JOIN listing l USING (root, path)""",
        "cat_diff_unreadable": f"""WITH {FILES}, {OLD} SELECT root, path, coalesce(l.is_dir, o.is_dir) AS is_dir,
          CASE WHEN l.path IS NOT NULL THEN false WHEN {' OR '.join(f"starts_with(o.path, '{d}/') OR o.path = '{d}'" for d in Q.UNREADABLE)} THEN o.dead ELSE true END AS dead
          FROM old o FULL JOIN listing l USING (root, path)""",
        "fn_basename": f"WITH {ENTRIES} SELECT path, {BASE} AS name FROM entries",
        "fn_relpath": f"""WITH {ENTRIES} SELECT path, CASE WHEN path = root THEN '' ELSE substr(path, length(root) + 2) END AS rel,
          CASE WHEN path = '/data/docs' THEN '' WHEN starts_with(path, '/data/docs/') THEN substr(path, 12) END AS in_docs, substr(path, 2) AS in_all FROM entries""",
        "fn_relpath_ok": f"""WITH {ENTRIES}, r AS (SELECT DISTINCT unnest([path, substr(path, 2), path || '/..', replace(substr(path, 2), 'data/', 'data//'), './' || substr(path, 2), substr(path, 2) || '/..x']) AS rel FROM entries)
          SELECT rel, rel = '' OR len(list_filter(string_split(rel, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS ok FROM r""",
        "fn_path_join": f"WITH {ENTRIES} SELECT path, root || '/' || {BASE} AS in_root, '/' || {BASE} AS in_top FROM entries",
        "fn_normalize": f"""WITH {ENTRIES}, r AS (SELECT DISTINCT unnest([path, path || '/', path || '///', '/', '///']) AS raw FROM entries)
          SELECT raw, CASE WHEN rtrim(raw, '/') = '' THEN '/' ELSE rtrim(raw, '/') END AS path FROM r""",
        "fn_abbreviate": f"WITH {ENTRIES} SELECT path, {', '.join(map(abbreviated, Q.WIDTHS))} FROM (SELECT path, CASE WHEN path = root THEN '' ELSE substr(path, length(root) + 2) END AS rel FROM entries)",
        "tok_segments": f"""WITH {ENTRIES}, s AS (SELECT path, list_filter(string_split_regex({BASE}, '[.\\-_ ]'), lambda x: x <> '') AS l FROM entries)
          SELECT path, unnest(range(len(l)))::INTEGER AS place, unnest(l) AS segment FROM s""",
        "tok_suffixes": f"WITH {TOKENS}, d AS (SELECT DISTINCT segment FROM segs), x AS (SELECT segment, substr(segment, k) AS suffix FROM (SELECT segment, unnest(range(1, length(segment) + 1)) AS k FROM d)) SELECT * FROM x WHERE strlen(suffix) >= 2",
        "tok_postings": f"WITH {TOKENS} SELECT token, root, path FROM postings",
        "tok_count": f"WITH {TOKENS} SELECT count(*) AS pairs FROM postings",
        "tok_prefix_postings": f"WITH {TOKENS} SELECT prefix, (SELECT count(*) FROM postings WHERE starts_with(token, prefix)) AS postings FROM {values([(p,) for p in Q.PREFIX_PROBES], 'prefix')}",
        "search_classify": f"""SELECT qid::INTEGER AS qid, kind, CASE WHEN kind = 'prefix' THEN CASE WHEN starts_with(text, '/') THEN text ELSE root || '/' || text END END AS prefix FROM (
          SELECT *, CASE WHEN text = '' THEN 'root' WHEN strlen(text) = 1 OR contains(text, '/') THEN 'prefix' ELSE 'token' END AS kind FROM {values([(k, T.ROOT, t) for k, t in enumerate(T.TEXTS)], 'qid, root, text')})""",
        "search_token_indexed": hits("ring_1"),
        "search_limit": hits("ring", 5),
        "search_tiers": f"""WITH {FILES}, p AS (SELECT DISTINCT path, text FROM (SELECT path FROM files WHERE path IS NOT NULL UNION ALL SELECT * FROM {values(T.TIER_ROWS, 'path')}), {values([(t,) for t in [*T.TIER_TEXTS, 'ring']], 'text')})
          SELECT path, text, {tier(BASE, 'text')}::INTEGER AS tier FROM p WHERE contains({BASE}, text)""",
        "search_totals": f"WITH {ENTRIES}, m AS ({ALL_MATCHES}) SELECT q.qid::INTEGER AS qid, count(m.path) AS total FROM range({len(T.TEXTS)}) AS q(qid) LEFT JOIN m ON m.qid = q.qid GROUP BY q.qid",
        "search_batch": f"""WITH {ENTRIES}, m AS ({ALL_MATCHES}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, path) AS rank FROM m)
          SELECT qid::INTEGER AS qid, path, is_dir, tier::INTEGER AS tier, score, rank::INTEGER AS rank FROM r WHERE rank <= {TOP_K}""",
        "acc_eligible": f"WITH {ELIGIBLE} SELECT event_id, root, path, kind FROM elig",
        "acc_gaps": f"WITH {GAPS} SELECT event_id, root, round(gap, 6) AS gap FROM gaps",
        "acc_gated": f"""WITH g AS (SELECT event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6, {MAX_GAP_SECS + 1}) AS gap FROM events)
          SELECT event_id, round(gap, 6) AS gap FROM g WHERE gap >= {MIN_GAP_SECS}""",
        "acc_sessions": f"""WITH {GAPS}, s AS (SELECT *, sum(CASE WHEN gap > {MAX_GAP_SECS} THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts, event_id) AS session FROM gaps)
          SELECT root, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY root, session""",
        "acc_transitions": f"WITH {CANDIDATES} SELECT root, event_id, src, dst FROM trans",
        "acc_counted": f"WITH RECURSIVE {COUNTED} SELECT root, kind, event_id, src, dst FROM counted",
        "acc_opens": f"WITH RECURSIVE {COUNTED}, {graph()} SELECT root, path, opens FROM vis",
        "acc_edges": f"WITH RECURSIVE {COUNTED}, {graph()} SELECT root, src, dst, weight FROM edg",
        "graph_outweight": f"WITH RECURSIVE {COUNTED}, {graph()} SELECT root, src, sum(weight) AS total, count(*) AS out_degree FROM edg GROUP BY root, src",
        "graph_apply": f"WITH RECURSIVE {COUNTED}, {graph()} SELECT root, src, dst, weight FROM edg",
        "graph_stats": f"""WITH RECURSIVE {COUNTED}, {graph()} SELECT root, nodes, opens, edges, weight FROM (SELECT root, count(*) AS nodes, sum(opens) AS opens FROM nod GROUP BY root)
          JOIN (SELECT root, count(*) AS edges, sum(weight) AS weight FROM edg GROUP BY root) USING (root)""",
        "pr_step": f"""WITH RECURSIVE {COUNTED}, {graph()}, got AS (SELECT n.root, s.dst AS path, sum({ALPHA} * n.opens * s.share) AS r FROM nod n JOIN shr s ON n.root = s.root AND n.path = s.src GROUP BY n.root, s.dst)
          SELECT root, path, round({1 - ALPHA} * opens, 6) AS p, round(coalesce(r, 0.0), 6) AS r FROM nod LEFT JOIN got USING (root, path)""",
        "pr_full": f"WITH RECURSIVE {FULL} SELECT root, path, round(p, 4) AS p FROM pr",
        "pr_incremental": f"""WITH RECURSIVE {COUNTED}, {graph('1', HALF)}, {graph()}, start AS (SELECT root, path, opens AS r FROM nod1), {series('start', 'shr1', 'one')},
          got AS (SELECT o.root, s.dst AS path, sum(o.p * s.share) AS g FROM one o JOIN shr s ON o.root = s.root AND o.path = s.src GROUP BY o.root, s.dst),
          again AS (SELECT root, path, n.opens - coalesce(o.p, 0) / {1 - ALPHA} + {ALPHA / (1 - ALPHA)} * coalesce(g, 0) AS r FROM nod n LEFT JOIN one o USING (root, path) LEFT JOIN got USING (root, path)),
          {series('again', 'shr', 'two')}
          SELECT root, path, round(coalesce(one.p, 0) + two.p, 4) AS p FROM two LEFT JOIN one USING (root, path)""",
        "rank_sync": f"WITH RECURSIVE {SCORED} SELECT root, path, round(score, 4) AS score FROM scored",
        "rank_decay": f"""WITH RECURSIVE {COUNTED}, {graph()} SELECT elapsed, half_life, root, src, dst,
          round(weight * CASE WHEN elapsed >= {DECAY_INTERVAL_SECS} AND half_life > 0 THEN pow(0.5, elapsed / half_life) ELSE 1 END, 9) AS weight FROM edg, {values(Q.DECAYS, 'elapsed, half_life')}""",
        "rank_forget": f"WITH RECURSIVE {COUNTED}, {graph()} SELECT root, path, 0.0::DOUBLE AS p, 0.0::DOUBLE AS r FROM nod",
        "search_ranked": f"""WITH RECURSIVE {SCORED}, m AS (SELECT path, is_dir, {tier(BASE, text(Q.SCORED_TEXT))} AS tier, round(score, 4) AS score FROM scored WHERE NOT dead AND contains({BASE}, {text(Q.SCORED_TEXT)}))
          SELECT path, is_dir, tier::INTEGER AS tier, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY tier, score DESC, path) AS rank FROM m) WHERE rank <= {TOP_K}""",
        "snap_nodes": f"WITH RECURSIVE {SAVED} SELECT root, id, rel, round(pgrk, 4) AS pgrk, opens, is_dir FROM snodes",
        "snap_edges": f"WITH RECURSIVE {SAVED} SELECT root, src, dst, round(weight, 9) AS weight FROM sedges",
        "snap_size": f"""WITH RECURSIVE {SAVED} SELECT root, (48 + strlen(root) + n + coalesce(m, 0))::BIGINT AS bytes FROM (SELECT root, sum(21 + strlen(rel)) AS n FROM snodes GROUP BY root)
          LEFT JOIN (SELECT root, count(*) * 16 AS m FROM sedges GROUP BY root) USING (root)""",
        "snap_validate": f"""SELECT 'node' AS part, rel AS what, (rel = '' OR len(list_filter(string_split(rel, '/'), lambda x: x IN ('', '.', '..'))) = 0) AND isfinite(pgrk) AND pgrk >= 0 AND isfinite(opens) AND opens >= 0 AS ok
          FROM {values(T.SNAPSHOT_ROWS, 'rel, pgrk, opens, is_dir')}
          UNION ALL SELECT 'edge', src || ' ' || dst, src BETWEEN 0 AND {len(T.SNAPSHOT_ROWS) - 1} AND dst BETWEEN 0 AND {len(T.SNAPSHOT_ROWS) - 1} AND isfinite(weight) AND weight >= 0 FROM {values(T.SNAPSHOT_EDGES, 'src, dst, weight')}""",
        "snap_adopt": f"""WITH r AS {values(T.ROOTS, 'root, dev, ino, btime')}, s AS {values(T.SAVED, 'root, dev, ino, btime')}, l AS {values(T.REACHABLE, 'root, dev, ino, btime')}
          SELECT r.root, min(s.root) AS old_root FROM r JOIN s USING (dev, ino, btime) WHERE r.btime <> 0 AND r.root NOT IN (SELECT root FROM s)
          AND NOT EXISTS (SELECT 1 FROM l WHERE l.root = s.root AND l.dev = s.dev AND l.ino = s.ino AND l.btime = s.btime) GROUP BY r.root""",
        "status_row": f"""WITH {EVENTS}, {LIFE} SELECT root, indexed, true AS scan_done, 0 AS unwatched, false AS root_lost, index_gen, score_gen FROM (SELECT root, count_if(NOT dead)::INTEGER AS indexed FROM life GROUP BY root)
          JOIN (SELECT root, count_if(kind IN ('create', 'delete'))::BIGINT AS index_gen, count_if(kind IN ('open', 'edit'))::BIGINT AS score_gen FROM ev GROUP BY root) USING (root)""",
    }
    own |= {name: hits(t) for name, t in Q.SEARCHES.items()}
    own["reply_json"] = f"WITH {REPLIES} SELECT qid, reply FROM replies"
    own["reply_parse"] = f"WITH {REPLIES} SELECT true AS ok, total::INTEGER AS total, hits::INTEGER AS hits, '{T.ROOT}' AS root FROM replies"
    digit = lambda at: f"position(substr(hex(encode(root)), {at}, 1) IN '0123456789ABCDEF') - 1"
    own["snap_name"] = f"""SELECT root, lpad(printf('%x', list_reduce(list_prepend({0xCBF29CE484222325}::UHUGEINT, list_transform(range(0, octet_length(encode(root))::INTEGER), lambda i: (16 * ({digit('2 * i + 1')}) + {digit('2 * i + 2')})::UHUGEINT)),
      lambda h, b: (xor(h, b) * {0x100000001B3}::UHUGEINT) % {1 << 64}::UHUGEINT)::UBIGINT), 16, '0') AS name FROM {values([(r,) for r in Q.ROOTS], 'root')}"""
    own["tok_probe"] = f"WITH {TOKENS} SELECT * FROM (" + " UNION ALL ".join(probe(t) for t in Q.PROBE_TEXTS) + ")"
    own |= {"stream_events": f"WITH {EVENTS} SELECT *, false AS is_dir FROM ev", "stream_apply": own["cat_lifecycle"], "stream_counted": own["acc_counted"], "stream_rank": own["pr_full"]}
    return own


def probe(query: str) -> str:
    from treadle.functions.tokens import probe_segments

    found = [(k, s) for k, s in enumerate(probe_segments(query))]
    if not found:
        return f"SELECT {text(query)} AS text, NULL::VARCHAR AS segment, NULL::BIGINT AS postings"
    counted = " UNION ALL ".join(f"SELECT {k} AS place, {text(s)} AS segment, count(*) AS postings FROM postings WHERE starts_with(token, {text(s)})" for k, s in found)
    return f"(SELECT {text(query)} AS text, segment, postings FROM ({counted}) ORDER BY postings, strlen(segment) DESC, place LIMIT 1)"
