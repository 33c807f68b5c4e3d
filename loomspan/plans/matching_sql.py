"""SQL of the matching queries, generated from the same rules; RE2 has no look-around, so words
are marked with two control characters and lengths are taken without them."""

from __future__ import annotations

import re

from loomspan.operators.rules import DEMO_PACK, DEMO_RULES, Policy, Rule, usable

_W = r"[\p{L}\p{N}_]"
_S = r"[\x09-\x0D\x20\x{A0}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeezed(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '{_S}+', ' ', 'g'), '^ | $', '', 'g')"


def _marked(x: str) -> str:
    return f"regexp_replace({x}, '({_W}+)', chr(1) || '\\1' || chr(2), 'g')"


def _plain_len(x: str) -> str:
    return f"length(replace(replace({x}, chr(1), ''), chr(2), ''))"


def _spans(text: str, rx: str) -> str:
    """List of structs (s, e) of an expression's matches in a text."""
    parts, ms = f"string_split_regex({text}, {rx})", f"regexp_extract_all({text}, {rx})"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: {_plain_len('x')})), 0)"
    at = f"{total(f'({parts})[1:i]')} + {total(f'({ms})[1:i-1]')}"
    return f"list_transform(range(1, len({ms}) + 1), lambda i: struct_pack(s := ({at})::INT, e := ({at} + {_plain_len(f'({ms})[i]')})::INT))"


def _rx(pattern: str) -> tuple[str, bool]:
    """(SQL of the expression, whether it is for marked text)."""
    if pattern.startswith("re:"):
        return _quoted("(?i)" + pattern[3:]), False
    body = rf"\x02{_S}*\x01".join(re.escape(w) for w in pattern.lower().split())
    return _quoted(rf"\x01{body}\x02"), True


SENTENCES = rf"""
d AS (SELECT doc_id, text, translate(lower(text), chr(9) || chr(11) || chr(12) || chr(13) || chr(160), '     ') AS t FROM documents),
p1 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '({_W})\.({_W})', '\1' || chr(4) || '\2', 'g'), '({_W})\.({_W})', '\1' || chr(4) || '\2', 'g') AS p FROM d),
p2 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(p, '([.!?。！？])', '\1' || chr(3), 'g'), '(\n *\n[\n ]*)', chr(3) || '\1' || chr(5) || chr(3), 'g'), chr(3)) AS ps FROM p1),
p3 AS (SELECT doc_id, unnest(ps) AS raw, unnest(range(len(ps))) AS k FROM p2),
p4 AS (SELECT doc_id, k, replace(replace(raw, chr(5), ''), chr(4), '.') AS s, contains(raw, chr(5))::INT AS gap FROM p3),
p5 AS (SELECT *, sum(length(s)) OVER o AS e, sum(gap) OVER o AS par FROM p4 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
sent AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sid, s, (e - length(s))::INT AS st, e::INT AS en, par::INT AS par FROM p5 WHERE {squeezed("s")} <> '')"""

WINDOWS = """
around AS (SELECT *, CASE WHEN lag(par) OVER o = par THEN lag(st) OVER o END AS before, CASE WHEN lead(par) OVER o = par THEN lead(en) OVER o END AS after FROM sent WINDOW o AS (PARTITION BY doc_id ORDER BY sid)),
win0 AS (SELECT doc_id, sid, FALSE AS pair, st, en, en - st AS cut, before, after FROM around
         UNION ALL SELECT doc_id, sid, TRUE, st, after, en - st, NULL, NULL FROM around WHERE after IS NOT NULL),
win AS (SELECT w.*, (row_number() OVER (PARTITION BY w.doc_id ORDER BY sid, pair) - 1)::INT AS idx, substring(d.t, w.st + 1, w.en - w.st) AS wt FROM win0 w JOIN d ON d.doc_id = w.doc_id)"""


def _known() -> list[Rule]:
    return usable(DEMO_RULES)


def hits_sql() -> str:
    parts = []
    for rule in _known():
        for role in ("trigger", "context", "support", "exclusion"):
            for pattern, _ in rule.regexes(role, DEMO_PACK):
                rx, marked = _rx(pattern)
                text = "mt" if marked else "wt"
                single = "" if rule.scope == "paragraph" else " AND NOT pair"
                parts.append(f"SELECT doc_id, idx, '{rule.id}' AS rule_id, '{role}' AS role, {_quoted(pattern)} AS pattern, unnest({_spans(text, rx)}) AS h FROM mw WHERE regexp_matches({text}, {rx}){single}")
    return "mw AS (SELECT doc_id, idx, pair, wt, " + _marked("wt") + " AS mt FROM win),\nhit0 AS (" + "\nUNION ALL ".join(parts) + "),\nhit AS (SELECT doc_id, idx, rule_id, role, pattern, h.s AS hs, h.e AS he FROM hit0)"


def candidates_sql() -> str:
    by_rule = lambda f: "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {f(r)}" for r in _known()) + " END"
    limit = by_rule(lambda r: max(0, min(2000, int(r.max_distance + 0.5))))
    needs = by_rule(lambda r: "TRUE" if r.any_of else "FALSE")
    contrast = _quoted(r"\x01(?:but|by)\x02")
    return f"""
tc AS (SELECT t.doc_id, t.idx, t.rule_id, t.pattern AS trig, c.pattern AS ctx, t.hs AS ts, t.he AS te, c.hs AS cs, c.he AS ce,
              greatest(c.hs - t.he, t.hs - c.he, 0) AS g FROM hit t JOIN hit c USING (doc_id, idx, rule_id)
       WHERE t.role = 'trigger' AND c.role = 'context' AND (t.he <= c.hs OR c.he <= t.hs)),
tcs AS (SELECT tc.*, s.hs AS ss, s.he AS se, CASE WHEN s.hs IS NULL THEN g ELSE greatest(g, s.hs - te, ts - s.he, s.hs - ce, cs - s.he) END AS gap
        FROM tc LEFT JOIN (SELECT * FROM hit WHERE role = 'support') s ON s.doc_id = tc.doc_id AND s.idx = tc.idx AND s.rule_id = tc.rule_id AND (s.he <= ts OR te <= s.hs) AND (s.he <= cs OR ce <= s.hs)),
ca AS (SELECT x.*, w.st, w.en, w.cut, w.pair, w.before, w.after, w.wt, least(ts, cs, coalesce(ss, ts)) AS low, greatest(te, ce, coalesce(se, te)) AS high
       FROM (SELECT *, {limit} AS lim, {needs} AS needs FROM tcs) x JOIN win w ON w.doc_id = x.doc_id AND w.idx = x.idx
       WHERE gap <= lim AND (ss IS NOT NULL OR NOT needs)),
cb AS (SELECT *, {_spans("mk", contrast)} AS marks FROM (SELECT *, {_marked("wt")} AS mk FROM ca WHERE NOT pair OR (low < cut AND high > cut))),
cc AS (SELECT *, coalesce(list_max(list_transform(list_filter(marks, lambda m: m.e <= low), lambda m: m.e)), 0) AS c0, coalesce(list_min(list_transform(list_filter(marks, lambda m: m.s >= high), lambda m: m.s)), length(wt)) AS c1 FROM cb),
cd AS (SELECT row_number() OVER () AS cid, * EXCLUDE (marks, mk) FROM cc WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.doc_id = cc.doc_id AND x.idx = cc.idx AND x.rule_id = cc.rule_id AND x.role = 'exclusion' AND x.hs >= c0 AND x.he <= c1)),
sc AS (SELECT cid, doc_id, st + low AS a, st + high AS b, st AS lo, en AS hi FROM cd UNION ALL SELECT cid, doc_id, st + low, st + high, before, en FROM cd WHERE before IS NOT NULL
       UNION ALL SELECT cid, doc_id, st + low, st + high, st, after FROM cd WHERE after IS NOT NULL),
sd AS (SELECT cid, {squeezed("substring(t, lo + 1, hi - lo)")} AS pl, length({squeezed("substring(t, lo + 1, a - lo)")}) AS a, length({squeezed("substring(t, lo + 1, b - lo)")}) AS b FROM sc JOIN d ON d.doc_id = sc.doc_id),
se AS (SELECT cid, pl, a, b, {_spans("mk", contrast)} AS marks FROM (SELECT *, {_marked("pl")} AS mk FROM sd)),
sf AS (SELECT cid, pl, coalesce(list_max(list_transform(list_filter(marks, lambda m: m.e <= a), lambda m: m.e)), 0) AS c0, coalesce(list_min(list_transform(list_filter(marks, lambda m: m.s >= b), lambda m: m.s)), length(pl)) AS c1 FROM se),
sg AS (SELECT cid, substring(pl, c0 + 1, c1 - c0) AS said FROM sf),
guard AS (SELECT DISTINCT cid FROM sg WHERE regexp_matches(said, {_quoted(DEMO_PACK.denial)}) OR (regexp_matches(said, {_quoted(DEMO_PACK.quote_mark)}) AND regexp_matches(said, {_quoted(DEMO_PACK.discussion)})) OR regexp_matches(said, {_quoted(DEMO_PACK.frame)})),
cand AS (SELECT doc_id, rule_id, gap::INT AS gap, (high - low)::INT AS envelope, (st + low)::INT AS start, trig AS trigger, ctx AS context, idx AS window_no, (st + high)::INT AS end_at,
                st + ts AS t_start, st + te AS t_end, st + cs AS c_start, st + ce AS c_end, st + ss AS s_start, st + se AS s_end FROM cd WHERE cid NOT IN (SELECT cid FROM guard))"""


def matches_sql() -> str:
    fixed = ", ".join(
        f"('{r.id}', '{r.category}', '{r.pattern_type}', {max(0, min(100, int(r.severity_floor + 0.5)))}, {float(r.severity_floor)}::DOUBLE, {r.dominant}, {float(r.confidence)}::DOUBLE, '{r.domain}')" for r in _known()
    )
    bare = [f"(rule_id = '{r.id}' AND regexp_matches(p, {_quoted(DEMO_PACK.bare_amount)}) AND NOT regexp_matches(p, {_quoted(DEMO_PACK.sparing)}))" for r in _known() if r.domain == DEMO_PACK.suppressed_domain]
    return f"""
best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY gap, envelope, start, trigger, context, window_no, end_at, t_start, t_end, c_start, c_end, s_start, s_end) AS rn FROM cand) WHERE rn = 1),
book(rule_id, category, pattern_type, score, floor, dominant, confidence, domain) AS (VALUES {fixed}),
raw AS (SELECT b.*, k.* EXCLUDE (rule_id), p FROM best b JOIN book k USING (rule_id) JOIN (SELECT doc_id, {squeezed("text")} AS p FROM documents) q USING (doc_id) WHERE NOT ({" OR ".join(bare) or "FALSE"})),
told AS (SELECT *, bool_or(domain = '{DEMO_PACK.suppressing_domain}') OVER (PARTITION BY doc_id) OR regexp_matches(p, {_quoted(DEMO_PACK.suppressing)}) AS told FROM raw),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, dominant DESC, confidence DESC, rule_id) AS rank FROM told
      WHERE NOT (told AND NOT regexp_matches(p, {_quoted(DEMO_PACK.sparing)}) AND domain = '{DEMO_PACK.suppressed_domain}'))"""


def scores_sql(policy: Policy | None = None) -> str:
    q = policy or Policy()
    grades = " ".join(f"WHEN final_score BETWEEN {a} AND {b} THEN '{g}'" for g, a, b in sorted(q.grades, key=lambda g: -g[1]))
    low, high = min(q.grades, key=lambda g: g[1])[0], max(q.grades, key=lambda g: g[1])[0]
    acts = " ".join(f"WHEN regexp_matches(p, {_quoted(rx)})" + (f" AND regexp_matches(text, {_quoted(DEMO_PACK.quote_mark)})" if quoted else "") + f" THEN '{act}'" for act, rx, quoted in DEMO_PACK.speech_acts)
    return f"""
cat AS (SELECT doc_id, category, least(100.0, max(score) + least({q.max_corroboration}, (count(DISTINCT pattern_type) - 1) * {q.corroboration_per_pattern}))::DOUBLE AS score, string_agg(rule_id, '|' ORDER BY rule_id) AS rule_ids FROM m GROUP BY doc_id, category),
top AS (SELECT doc_id, max(CASE WHEN k = 1 THEN score ELSE 0 END) AS s1, max(CASE WHEN k = 2 THEN score ELSE 0 END) AS s2, max(CASE WHEN k = 3 THEN score ELSE 0 END) AS s3
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS k FROM cat) GROUP BY doc_id),
dom AS (SELECT doc_id, max(CASE WHEN dominant THEN floor ELSE 0 END) AS dominant_floor, count(*) AS n, max(CASE WHEN rank = 1 THEN rule_id END) AS primary_rule FROM m GROUP BY doc_id),
fin AS (SELECT doc_id, text, {squeezed("text")} AS p, coalesce(n, 0) AS n_matches, coalesce(dominant_floor, 0)::DOUBLE AS dominant_floor, primary_rule,
               (CASE WHEN n IS NULL THEN floor({q.no_match_score} + 0.5) ELSE least(100.0, greatest(s1, dominant_floor) + least({q.max_support}, floor(s2 * {q.second_weight} + s3 * {q.third_weight} + 0.5))) END)::DOUBLE AS final_score
        FROM documents LEFT JOIN dom USING (doc_id) LEFT JOIN top USING (doc_id)),
scored AS (SELECT doc_id, n_matches::BIGINT AS n_matches, primary_rule, dominant_floor, final_score, CASE {grades} WHEN final_score <= 0 THEN '{low}' ELSE '{high}' END AS grade,
                  CASE WHEN final_score >= 80 THEN 'high' WHEN final_score >= 70 THEN 'attention' WHEN final_score > 0 THEN 'review' ELSE 'no_match' END AS status,
                  CASE {acts} ELSE '{DEMO_PACK.default_act}' END AS speech_act FROM fin)"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)
