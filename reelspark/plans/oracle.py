"""DuckDB SQL of the registered queries: one chain of named steps, and a SELECT for each query.

Written independently of the operators' code; the folds are recursive queries.
"""

from __future__ import annotations

import re

from ..operators.transcripts import JUNK
from ..params import FILLERS, HIGHLIGHT_GROUPS, HIGHLIGHT_STOPWORDS, STOPWORDS, TRANSITIONS


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-záéíóúñü]+'))"


def _normal(text: str) -> str:
    tidy = f"regexp_replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), ' {{2,}}', ' ', 'g')"
    return f"CASE WHEN regexp_matches({tidy}, '^\\p{{Ll}}') THEN replace(upper(({tidy})[1]), 'ẞ', 'SS') || ({tidy})[2:] ELSE {tidy} END"


def _r3(x: str) -> str:
    return f"round(({x})::DECIMAL(24, 10), 3)::DOUBLE"


_WORDS = lambda t: f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
_BARE = lambda w: f"regexp_replace(lower({w}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
_FAMILY = lambda w: "CASE " + " ".join(f"WHEN list_contains({_list(g)}, {w}) THEN {n}" for n, g in enumerate(HIGHLIGHT_GROUPS)) + " END"


STEPS = {
    "seg_raw": r"""SELECT conv_id AS vod_id, turn, unnest(p) AS raw0, generate_subscripts(p, 1) AS pos FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\. |\n') AS p FROM conversations)""",
    "seg_txt": r"""SELECT vod_id, turn, pos, regexp_replace(raw0, '^\s+|\s+$', '', 'g') AS raw FROM seg_raw WHERE regexp_replace(raw0, '^\s+|\s+$', '', 'g') <> ''""",
    "seg_num": """SELECT vod_id, row_number() OVER w - 1 AS seq, raw, greatest(length(raw), 3) AS n,
        coalesce(sum(2 * greatest(length(raw), 3) + 15 + 75 * (length(raw) % 7)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a
        FROM seg_txt WINDOW w AS (PARTITION BY vod_id ORDER BY turn, pos)""",
    "transcript": """SELECT vod_id, seq::BIGINT AS seq, round(a / 30.0::DOUBLE, 3) AS start, round((a + 2 * n) / 30.0::DOUBLE, 3) AS "end",
        CASE WHEN seq % 11 = 0 THEN 'por cierto ' ELSE '' END || raw || CASE WHEN seq % 5 = 0 THEN '!' ELSE '' END || CASE WHEN seq % 7 = 0 THEN '?' ELSE '' END AS text FROM seg_num""",
    "cend": 'SELECT vod_id, arg_max("end", seq) AS content_end FROM transcript GROUP BY vod_id',
    "peaks": """SELECT e.vod_id, timestamp, intensity FROM (SELECT user_id AS vod_id, round((epoch_us(ts) - 1704067200000000) / 3600e6::DOUBLE, 3) AS timestamp,
        round(sqrt(value / max(value) OVER (PARTITION BY user_id)), 4) AS intensity FROM events) e""",
    "frames": """SELECT l_suppkey AS vod_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS frame_idx,
        l_quantity / 50.0::DOUBLE AS rms FROM lineitem""",
    "durations": "SELECT vod_id, count(*)::DOUBLE AS total_s FROM frames GROUP BY vod_id",
    "windows0": """SELECT *, sum(CASE WHEN timestamp - prev < 9.0 THEN 0 ELSE 1 END) OVER (PARTITION BY vod_id ORDER BY timestamp, intensity ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, lag(timestamp) OVER (PARTITION BY vod_id ORDER BY timestamp, intensity) AS prev FROM peaks)""",
    "windows": """SELECT vod_id, run::BIGINT - 1 AS idx, round(greatest(0, min(timestamp) - 10), 3) AS start, round(least(max(timestamp) + 15, round(greatest(0, min(timestamp) - 10), 3) + 120), 3) AS "end",
        list({'t': timestamp, 'i': intensity} ORDER BY timestamp, intensity) AS gp FROM windows0 GROUP BY vod_id, run""",
    "clips0": """SELECT vod_id, round(greatest(0, timestamp - CASE WHEN intensity > 0.8 THEN 15 WHEN intensity > 0.6 THEN 12 ELSE 10 END), 3) AS start,
        round(timestamp + CASE WHEN intensity > 0.8 THEN 20 WHEN intensity > 0.6 THEN 18 ELSE 15 END, 3) AS "end", timestamp AS peak_timestamp, intensity
        FROM (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY intensity DESC, timestamp) AS n FROM peaks) WHERE n <= 25""",
    "clips": """SELECT *, (row_number() OVER (PARTITION BY vod_id ORDER BY start, "end", peak_timestamp))::INTEGER AS clip_idx FROM clips0""",
    "rich": f"""SELECT *, CASE WHEN len(w) = 0 OR len(c) = 0 THEN 0 ELSE list_sum(list_transform(c, lambda x: length(x)))
        * greatest(len(list_distinct(c)) / len(c), 0.3::DOUBLE) * greatest(0.3::DOUBLE, 1.0::DOUBLE - len(list_filter(w, lambda x: list_contains({_list(STOPWORDS)}, x))) / len(w)) END AS richness,
        list_filter(w, lambda x: NOT list_contains({_list(STOPWORDS)}, x) AND length(x) > 2) AS tokens
        FROM (SELECT *, list_filter(w, lambda x: NOT list_contains({_list(FILLERS)}, x) AND length(x) > 2) AS c FROM (SELECT *, {words('text')} AS w FROM transcript))""",
    "win_seg": 'SELECT w.vod_id, w.idx, w.start, w."end", s.seq, s.start AS s_start, s."end" AS s_end, s.text, s.richness, s.tokens FROM windows w JOIN rich s ON w.vod_id = s.vod_id AND s.start < w."end" AND s."end" > w.start',
    "win_text": "SELECT vod_id, idx, string_agg(text, ' ' ORDER BY seq) AS body, sum(length(text)) AS chars, sum(richness) AS richness FROM win_seg GROUP BY vod_id, idx",
    "clip_seg": 'SELECT c.vod_id, c.clip_idx, c.start, c."end", s.seq, s.start AS s_start, s."end" AS s_end, s.text FROM clips c JOIN transcript s ON c.vod_id = s.vod_id AND s.start < c."end" AND s."end" > c.start',
    # energy
    "energy0": "SELECT *, coalesce(abs(rms - lag(rms) OVER (PARTITION BY vod_id ORDER BY frame_idx)), 0) AS diff FROM frames",
    "energy": "SELECT vod_id, frame_idx, rms, rms / (max(rms) OVER (PARTITION BY vod_id) + 1e-9) + 0.5 * (diff / (max(diff) OVER (PARTITION BY vod_id) + 1e-9)) AS score FROM energy0",
    "thresh": "SELECT *, round(threshold, 9) AS th FROM (SELECT *, avg(score) OVER (PARTITION BY vod_id) + stddev_pop(score) OVER (PARTITION BY vod_id) AS threshold FROM energy)",
    "runs0": "SELECT *, sum(CASE WHEN score = prev THEN 0 ELSE 1 END) OVER (PARTITION BY vod_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(score) OVER (PARTITION BY vod_id ORDER BY frame_idx) AS prev FROM thresh)",
    "runs": "SELECT vod_id, run, min(frame_idx) AS lo, max(frame_idx) AS hi, any_value(score) AS score, any_value(threshold) AS threshold FROM runs0 GROUP BY vod_id, run",
    "maxima": """SELECT vod_id, floor((lo + hi) / 2.0)::BIGINT AS frame_idx, score FROM (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS n FROM runs WINDOW w AS (PARTITION BY vod_id ORDER BY run))
        WHERE p < score AND n < score AND score >= threshold""",
    "ranked_max": "SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY score DESC, frame_idx DESC) AS k FROM maxima",
    "greedy": """SELECT vod_id, k, [frame_idx] AS kept FROM ranked_max WHERE k = 1
        UNION ALL SELECT m.vod_id, m.k, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - m.frame_idx) < 5)) > 0 THEN g.kept ELSE list_append(g.kept, m.frame_idx) END
        FROM greedy g JOIN ranked_max m ON m.vod_id = g.vod_id AND m.k = g.k + 1""",
    "kept_max": "SELECT m.vod_id, m.frame_idx, m.score FROM maxima m JOIN (SELECT vod_id, arg_max(kept, k) AS kept FROM greedy GROUP BY vod_id) g ON m.vod_id = g.vod_id AND list_contains(g.kept, m.frame_idx)",
    "top50": """SELECT vod_id, timestamp, intensity FROM (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY intensity DESC, timestamp) AS n FROM (
        SELECT vod_id, round(frame_idx::DOUBLE, 3) AS timestamp, round(score / max(score) OVER (PARTITION BY vod_id), 4) AS intensity FROM kept_max)) WHERE n <= 50""",
    # simple windows
    "rpeaks": "SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY timestamp, intensity) AS peak_idx FROM peaks",
    "pw0": """SELECT p.vod_id, peak_idx, intensity, timestamp AS ts, coalesce(content_end, 'inf'::DOUBLE) AS ce, greatest(0, timestamp - CASE WHEN intensity > 0.8 THEN 15 WHEN intensity > 0.6 THEN 12 ELSE 10 END) AS start,
        least(coalesce(content_end, 'inf'::DOUBLE), timestamp + CASE WHEN intensity > 0.8 THEN 20 WHEN intensity > 0.6 THEN 18 ELSE 15 END) AS e FROM rpeaks p LEFT JOIN cend c ON p.vod_id = c.vod_id""",
    "pw1": """SELECT w.*, coalesce(round(least(x.m + 0.3, ce), 3), e) AS "end" FROM pw0 w LEFT JOIN (
        SELECT w.vod_id, w.peak_idx, max(s."end") AS m FROM pw0 w JOIN transcript s ON w.vod_id = s.vod_id AND s.start <= w.e AND s."end" > w.ts GROUP BY 1, 2) x ON w.vod_id = x.vod_id AND w.peak_idx = x.peak_idx""",
    "near_seg": """SELECT p.vod_id, p.peak_idx, arg_min(s.text, (abs((s.start + s."end") / 2 - p.timestamp), s.seq)) AS nearest_text FROM rpeaks p JOIN transcript s ON p.vod_id = s.vod_id GROUP BY 1, 2""",
    "pw": """SELECT w.vod_id, w.peak_idx, round(start, 3) AS start, CASE WHEN "end" - start > 60 THEN round(start + 60, 3) ELSE "end" END AS "end", round(ts, 3) AS peak_timestamp, round(intensity, 4) AS intensity, nearest_text
        FROM pw1 w LEFT JOIN near_seg n ON w.vod_id = n.vod_id AND w.peak_idx = n.peak_idx WHERE "end" - start >= 8""",
    "pwr": 'SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY start, "end", peak_timestamp, intensity) AS k FROM pw',
    "mergef": """SELECT vod_id, k, start, "end", peak_timestamp, intensity, nearest_text, 1 AS g FROM pwr WHERE k = 1 UNION ALL
        SELECT c.vod_id, c.k, CASE WHEN j THEN l.start ELSE c.start END, CASE WHEN j THEN greatest(l."end", c."end") ELSE c."end" END, CASE WHEN j THEN l.peak_timestamp ELSE c.peak_timestamp END,
          CASE WHEN j THEN l.intensity ELSE c.intensity END, CASE WHEN j THEN l.nearest_text ELSE c.nearest_text END, CASE WHEN j THEN l.g ELSE l.g + 1 END
        FROM (SELECT l.*, c.k AS ck, least(l."end", c."end") - greatest(l.start, c.start) > 0 AND (least(l."end", c."end") - greatest(l.start, c.start)) / least(l."end" - l.start, c."end" - c.start) > 0.5 AS j
          FROM mergef l JOIN pwr c ON c.vod_id = l.vod_id AND c.k = l.k + 1) l JOIN pwr c ON c.vod_id = l.vod_id AND c.k = l.ck""",
    "merged": 'SELECT vod_id, g, arg_max({\'s\': start, \'e\': "end", \'p\': peak_timestamp, \'i\': intensity, \'t\': nearest_text}, k) AS r FROM mergef GROUP BY vod_id, g',
    "legacy": """SELECT vod_id, start, "end", peak_timestamp, intensity, nearest_text FROM (SELECT vod_id, r.s AS start, r.e AS "end", r.p AS peak_timestamp, r.i AS intensity, r.t AS nearest_text, g AS n FROM merged)
        WHERE n <= 25 AND "end" - start BETWEEN 8 AND 60""",
    # momentum sessions
    "aw0": """SELECT p.vod_id, row_number() OVER (PARTITION BY p.vod_id ORDER BY timestamp, intensity) AS k, timestamp AS ts, intensity AS i, round(greatest(0, timestamp - CASE WHEN intensity > 0.8 THEN 15 WHEN intensity > 0.6 THEN 12 ELSE 10 END), 3) AS s,
        round(least(coalesce(content_end, 'inf'::DOUBLE), timestamp + CASE WHEN intensity > 0.8 THEN 20 WHEN intensity > 0.6 THEN 18 ELSE 15 END), 3) AS e, coalesce(content_end, 'inf'::DOUBLE) AS ce FROM peaks p LEFT JOIN cend c ON c.vod_id = p.vod_id""",
    "awf": """SELECT vod_id, k, ce, s, e, i AS m, i AS total, 1 AS n, 0 AS sess, ts AS best_t, i AS best_i, [{'t': ts, 'i': i}] AS gp FROM aw0 WHERE k = 1 UNION ALL
        SELECT vod_id, ck, ce, CASE WHEN j THEN s ELSE cs END, CASE WHEN j THEN greatest(e, c_e) ELSE c_e END, CASE WHEN j THEN least(1, held + ci) ELSE ci END, CASE WHEN j THEN total + ci ELSE ci END, CASE WHEN j THEN n + 1 ELSE 1 END,
          CASE WHEN j THEN sess ELSE sess + 1 END, CASE WHEN j AND best_i >= ci THEN best_t ELSE cts END, CASE WHEN j THEN greatest(best_i, ci) ELSE ci END,
          CASE WHEN j THEN list_append(gp, {'t': cts, 'i': ci}) ELSE [{'t': cts, 'i': ci}] END
        FROM (SELECT *, held > 0.12 AND c_e - s <= 120 AS j FROM (SELECT *, CASE WHEN cts > e AND rich >= 8 THEN least(1, decayed + 0.15) ELSE decayed END AS held FROM (
          SELECT l.*, c.k AS ck, c.s AS cs, c.e AS c_e, c.i AS ci, c.ts AS cts, l.m * exp(-0.20 / (1 + 1.5 * (l.total / l.n)) * greatest(0, c.ts - l.e)) AS decayed,
            coalesce((SELECT sum(r.richness::DECIMAL(24, 10)) FROM rich r WHERE r.vod_id = c.vod_id AND r.start < c.ts AND r."end" > l.e), 0)::DOUBLE AS rich
          FROM awf l JOIN aw0 c ON c.vod_id = l.vod_id AND c.k = l.k + 1)))""",
    "aw1": "SELECT vod_id, sess, any_value(ce) AS ce, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(total, k) AS total, arg_max(n, k) AS n, arg_max(best_t, k) AS best_t, arg_max(gp, k) AS gp FROM awf GROUP BY vod_id, sess",
    "active": """SELECT vod_id, row_number() OVER (PARTITION BY vod_id ORDER BY sess) - 1 AS idx, s AS start, least(coalesce(round(least(last + 0.3, ce), 3), e), s + 120) AS "end", n::INTEGER AS n_peaks, round((total / n)::DECIMAL(24, 10), 4)::DOUBLE AS mean_intensity, gp
        FROM (SELECT a.*, (SELECT max(t."end") FROM transcript t WHERE t.vod_id = a.vod_id AND t.start <= a.e AND t."end" > a.best_t) AS last FROM aw1 a)""",
    # tokens and continuity
    "tok": "SELECT vod_id, idx, token, count(*) AS n FROM (SELECT vod_id, idx, unnest(tokens) AS token FROM win_seg) GROUP BY ALL",
    "ctx": "SELECT vod_id, idx + d AS idx, token, sum(n) AS n FROM tok CROSS JOIN (SELECT unnest([1, 2]) AS d) GROUP BY ALL",
    "cosine": """SELECT w.vod_id, w.idx, coalesce(d / (sqrt(qa) * sqrt(qb)), 0) AS sim FROM windows w
        LEFT JOIN (SELECT a.vod_id, a.idx, sum(a.n * b.n) AS d FROM ctx a JOIN tok b ON a.vod_id = b.vod_id AND a.idx = b.idx AND a.token = b.token GROUP BY 1, 2) x ON x.vod_id = w.vod_id AND x.idx = w.idx
        LEFT JOIN (SELECT vod_id, idx, sum(n * n) AS qa FROM ctx GROUP BY 1, 2) a ON a.vod_id = w.vod_id AND a.idx = w.idx LEFT JOIN (SELECT vod_id, idx, sum(n * n) AS qb FROM tok GROUP BY 1, 2) b ON b.vod_id = w.vod_id AND b.idx = w.idx""",
    "trans": "SELECT w.vod_id, w.idx, coalesce(" + " OR ".join(f"contains(lower(body), '{p}')" for p in TRANSITIONS) + ", false) AS has_transition FROM windows w LEFT JOIN win_text t ON t.vod_id = w.vod_id AND t.idx = w.idx",
    "cont0": """SELECT w.vod_id, w.idx, w.start, w."end", CASE WHEN w.idx = 0 THEN 1.0 ELSE sim END AS sim, has_transition, w.idx > 0 AND sim < 0.25 AS low, count(*) OVER (PARTITION BY w.vod_id) > 1 AND w.vod_id IN (SELECT vod_id FROM transcript) AS known,
        w.start - lag(w."end") OVER (PARTITION BY w.vod_id ORDER BY w.idx) AS gap FROM windows w JOIN cosine c ON c.vod_id = w.vod_id AND c.idx = w.idx JOIN trans t ON t.vod_id = w.vod_id AND t.idx = w.idx""",
    "contf": """SELECT *, 0 AS run, 1.0::DOUBLE AS prev, 1.0::DOUBLE AS average, false AS tested FROM cont0 WHERE idx = 0 UNION ALL
        SELECT c.*, CASE WHEN NOT c.low THEN 0 WHEN p.run = 1 THEN 0 ELSE p.run + 1 END, p.sim, (p.sim + c.sim) / 2, c.low AND p.run = 1 FROM contf p JOIN cont0 c ON c.vod_id = p.vod_id AND c.idx = p.idx + 1""",
    "contb": """SELECT *, tested AND known AND round(0.35 * f(sim) + 0.30 * f(average) + 0.20 * least(1, gap / 30.0) + 0.15 * CASE WHEN has_transition THEN f(sim) ELSE 0 END, 3) >= 0.45 AS hit FROM contf""".replace(
        "f(sim)", "least(1, greatest(0, (0.25 - sim) / 0.25))").replace("f(average)", "least(1, greatest(0, (0.25 - average) / 0.25))"),
    "continuity": """SELECT vod_id, idx, start, "end", CASE WHEN known THEN round(sim, 4) ELSE 0.5 END AS semantic_score, known AND idx > 0 AND has_transition AS has_transition,
        coalesce(lead(hit) OVER (PARTITION BY vod_id ORDER BY idx), false) AS is_break FROM contb""",
    # metrics of the windows
    "best_peak": "SELECT vod_id, idx, list_sort(list_transform(gp, lambda x: {'a': -x.i, 'b': x.t}))[1] AS b, list_avg(list_transform(gp, lambda x: x.i)) AS mi, len(gp) AS n FROM windows",
    "near_win": """SELECT w.vod_id, w.idx, arg_min(s.text, (abs((s.start + s."end") / 2 - round(b.b, 3)), s.seq)) AS nearest_text FROM best_peak w JOIN transcript s ON w.vod_id = s.vod_id GROUP BY 1, 2""",
    "metrics": """SELECT *, round((0.30 * least(intensity, 1) + 0.25 * CASE WHEN d < 8 THEN 0.2 WHEN d <= 45 THEN least(1, 0.6 + 0.4 * (d - 8) / 37) WHEN d <= 90 THEN 1 ELSE greatest(0.3, 1 - (d - 90) / 60) END
        + 0.20 * least(density / 5, 1) + 0.15 * 0.5 + 0.10 * least(n / 5.0, 1))::DECIMAL(24, 10), 4)::DOUBLE AS confidence_score FROM (
        SELECT w.vod_id, w.idx, w.start, w."end", w."end" - w.start AS d, round(-b.b.a, 4) AS intensity, round(mi::DECIMAL(24, 10), 4)::DOUBLE AS energy_score, round(b.b.b, 3) AS peak_timestamp, b.n, nearest_text,
          coalesce(t.chars, 0) / greatest(w."end" - w.start, 1e-3) AS density
        FROM windows w JOIN best_peak b ON b.vod_id = w.vod_id AND b.idx = w.idx LEFT JOIN near_win x ON x.vod_id = w.vod_id AND x.idx = w.idx LEFT JOIN win_text t ON t.vod_id = w.vod_id AND t.idx = w.idx)""",
    "tiers": "SELECT *, CASE WHEN v >= 0.7 THEN 'brutal' WHEN v >= 0.5 THEN 'excellent' WHEN v >= 0.3 THEN 'good' ELSE 'weak' END AS moment_tier FROM (SELECT *, 0.6 * confidence_score + 0.4 * energy_score AS v FROM metrics)",
    "mergew0": 'SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY idx) AS k FROM windows',
    "mergewf": """SELECT vod_id, k, idx, start, "end", len(gp) AS n FROM mergew0 WHERE k = 1 UNION ALL
        SELECT c.vod_id, c.k, CASE WHEN j THEN l.idx ELSE c.idx END, CASE WHEN j THEN l.start ELSE c.start END, CASE WHEN j THEN greatest(l."end", c."end") ELSE c."end" END, CASE WHEN j THEN l.n + len(c.gp) ELSE len(c.gp) END
        FROM (SELECT l.*, c.k AS ck, NOT b.is_break AND c.start - l."end" <= 4 * CASE WHEN l."end" - l.start >= 60 THEN 0.5 WHEN l."end" - l.start <= 15 THEN 1.5 ELSE 1 END AND c."end" - l.start <= 120 AS j
          FROM mergewf l JOIN mergew0 c ON c.vod_id = l.vod_id AND c.k = l.k + 1 JOIN continuity b ON b.vod_id = c.vod_id AND b.idx = c.idx) l JOIN mergew0 c ON c.vod_id = l.vod_id AND c.k = l.ck""",
    # scoring of the clips
    "hook3": "SELECT c.vod_id, c.clip_idx, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY seq) AS h FROM clips c JOIN transcript s ON c.vod_id = s.vod_id AND s.start < c.start + 3 AND s.\"end\" > c.start GROUP BY 1, 2",
    "hook5": "SELECT c.vod_id, c.clip_idx, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY seq) AS h FROM clips c JOIN transcript s ON c.vod_id = s.vod_id AND s.start < c.start + 5 AND s.\"end\" > c.start GROUP BY 1, 2",
    "body": "SELECT vod_id, clip_idx, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY seq) AS b FROM clip_seg GROUP BY 1, 2",
    "phrase": 'SELECT DISTINCT c.vod_id, c.clip_idx FROM clips c JOIN transcript s ON c.vod_id = s.vod_id AND abs(s."end" - c."end") < 0.5',
    "early": "SELECT c.vod_id, c.clip_idx, avg(p.intensity) AS e FROM clips c JOIN peaks p ON p.vod_id = c.vod_id AND p.timestamp >= c.start AND p.timestamp < c.start + 5 GROUP BY 1, 2",
    "raw_score": """SELECT *, "end" - start AS d, coalesce(length(h3), 0) > 0 AS s3, coalesce(length(h5), 0) > 0 AS s5 FROM (SELECT c.*, a.h AS h3, b.h AS h5, coalesce(x.b, '') AS body, p.vod_id IS NOT NULL AS phrase_complete, coalesce(e.e, 0) AS e
        FROM clips c LEFT JOIN hook3 a ON a.vod_id = c.vod_id AND a.clip_idx = c.clip_idx LEFT JOIN hook5 b ON b.vod_id = c.vod_id AND b.clip_idx = c.clip_idx LEFT JOIN body x ON x.vod_id = c.vod_id AND x.clip_idx = c.clip_idx
        LEFT JOIN phrase p ON p.vod_id = c.vod_id AND p.clip_idx = c.clip_idx LEFT JOIN early e ON e.vod_id = c.vod_id AND e.clip_idx = c.clip_idx)""",
    "hooked": """SELECT *, CASE WHEN d > 0 THEN least(length(body) / d, 15) / 15 ELSE 0 END AS td, CASE WHEN s3 THEN length(h3) / 3.0::DOUBLE WHEN s5 THEN length(h5) / 5.0::DOUBLE ELSE 0 END AS hd,
        CASE WHEN s3 THEN length(h3) - length(translate(h3, '!?', '')) WHEN s5 THEN length(h5) - length(translate(h5, '!?', '')) ELSE 0 END AS hm,
        CASE WHEN d < 8 THEN 0 WHEN d < 20 THEN (d - 8) / 12 WHEN d <= 45 THEN 1 WHEN d <= 60 THEN (60 - d) / 15 ELSE 0 END AS ds FROM raw_score""",
    "strength": """SELECT *, CASE WHEN s3 OR s5 THEN 0.7 * (hd / CASE WHEN max(hd) OVER w = 0 THEN 1 ELSE max(hd) OVER w END) + 0.3 * (hm / CASE WHEN max(hm) OVER w = 0 THEN 1.0::DOUBLE ELSE (max(hm) OVER w)::DOUBLE END) ELSE 0.5 * e END AS hs
        FROM hooked WINDOW w AS (PARTITION BY vod_id)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY score DESC, clip_idx) AS rank FROM (SELECT vod_id, clip_idx, start, "end", peak_timestamp, round(intensity, 4) AS intensity, round(td::DECIMAL(24, 10), 4)::DOUBLE AS text_density, round(hs::DECIMAL(24, 10), 4)::DOUBLE AS hook_strength,
        round(ds::DECIMAL(24, 10), 4)::DOUBLE AS duration_score, phrase_complete, round((CASE WHEN phrase_complete THEN least(v + 0.07, 1) ELSE v END)::DECIMAL(24, 10), 4)::DOUBLE AS score FROM (SELECT *, intensity * 0.30 + td * 0.25 + hs * 0.25 + ds * 0.20 AS v FROM strength))""",
    "elig": """SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY rank) AS k FROM (SELECT *, count(*) FILTER (score >= 0.65) OVER w < least(15, count(*) OVER w) AS few FROM ranked WINDOW w AS (PARTITION BY vod_id))
        WHERE CASE WHEN few THEN rank <= 15 ELSE score >= 0.65 END""",
    "pick": """SELECT vod_id, k, [start] AS kept, [rank] AS ranks FROM elig WHERE k = 1 UNION ALL
        SELECT c.vod_id, c.k, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - c.start) < 30)) > 0 OR len(p.kept) >= 15 THEN p.kept ELSE list_append(p.kept, c.start) END,
          CASE WHEN len(list_filter(p.kept, lambda x: abs(x - c.start) < 30)) > 0 OR len(p.kept) >= 15 THEN p.ranks ELSE list_append(p.ranks, c.rank) END FROM pick p JOIN elig c ON c.vod_id = p.vod_id AND c.k = p.k + 1""",
    "selected": "SELECT r.* FROM ranked r JOIN (SELECT vod_id, arg_max(ranks, k) AS ranks FROM pick GROUP BY vod_id) p ON p.vod_id = r.vod_id AND list_contains(p.ranks, r.rank)",
    "cover": """SELECT c.vod_id, c.rank, count(*) AS n, arg_min(s.start, s.seq) FILTER (s.start < c.start - 0.3) AS sentence FROM selected c JOIN transcript s ON s.vod_id = c.vod_id AND s.start < c.start + 1.5 AND s."end" > c.start GROUP BY 1, 2""",
    "upcome": "SELECT c.vod_id, c.rank, min(s.start) AS nxt FROM selected c JOIN transcript s ON s.vod_id = c.vod_id AND s.start > c.start AND s.start < c.peak_timestamp GROUP BY 1, 2",
    "refined": """SELECT *, round(start - new, 3) AS delta, round(new, 3) AS new_start FROM (SELECT *, CASE WHEN reason = 'silence_skip' THEN greatest(0, nxt - 0.15) WHEN reason = 'phrase_align' THEN greatest(0, sentence - 0.15) ELSE start END AS new FROM (
        SELECT c.*, n, sentence, nxt, CASE WHEN n IS NULL AND intensity < 0.8 AND nxt IS NOT NULL AND NOT (intensity >= 0.6 AND nxt - start > 1.5) AND peak_timestamp - greatest(0, nxt - 0.15) >= 8 THEN 'silence_skip'
          WHEN n IS NOT NULL AND sentence IS NOT NULL AND start - greatest(0, sentence - 0.15) > 0 AND start - greatest(0, sentence - 0.15) <= 8 THEN 'phrase_align' ELSE 'no_change' END AS reason
        FROM selected c LEFT JOIN cover v ON v.vod_id = c.vod_id AND v.rank = c.rank LEFT JOIN upcome u ON u.vod_id = c.vod_id AND u.rank = c.rank))""",
    # subtitles
    "ctr0": """SELECT vod_id, clip_idx, seq, greatest(0, s_start - start + o) AS a, least("end" - start, s_end - start + o) AS b, text FROM (SELECT *, CASE WHEN s_end - s_start < 0.8 THEN 0 WHEN s_end - s_start < 1.2 THEN -0.1 ELSE -0.2 END AS o FROM clip_seg)""",
    "ctr": 'SELECT vod_id, clip_idx, seq, round(a, 3) AS start, round(b, 3) AS "end", text, row_number() OVER (PARTITION BY vod_id, clip_idx ORDER BY seq) AS chunk_idx FROM ctr0 WHERE b > a',
    "ctw": "SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM ctr",
    "srtf": """SELECT vod_id, clip_idx, chunk_idx, text, w, 0 AS i, 0 AS used, []::VARCHAR[] AS one, []::VARCHAR[] AS two FROM ctw UNION ALL
        SELECT vod_id, clip_idx, chunk_idx, text, w, i + 1, CASE WHEN used + length(w[i + 1]) <= 38 THEN used + length(w[i + 1]) + 1 ELSE used END,
          CASE WHEN used + length(w[i + 1]) <= 38 THEN list_append(one, w[i + 1]) ELSE one END, CASE WHEN used + length(w[i + 1]) <= 38 THEN two ELSE list_append(two, w[i + 1]) END FROM srtf WHERE i < len(w)""",
    "srtw": """SELECT vod_id, clip_idx, chunk_idx, CASE WHEN length(text) <= 38 THEN text WHEN len(two) = 0 THEN array_to_string(one, ' ') ELSE array_to_string(one, ' ') || chr(10)
          || CASE WHEN length(array_to_string(two, ' ')) > 76 THEN array_to_string(two, ' ')[:75] || '…' ELSE array_to_string(two, ' ') END END AS text FROM srtf WHERE i = len(w)""",
    # chunks: parts packed to lines, time shared by characters
    "ckn": f"SELECT vod_id, clip_idx, seq, start, \"end\", {_normal('text')} AS text FROM ctr",
    "ckp": r"SELECT *, string_split(regexp_replace(text, '([,\.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) AS cut FROM ckn",
    "ckf": """SELECT vod_id, clip_idx, seq, cut, 1 AS i, [cut[1]] AS parts FROM ckp UNION ALL
        SELECT vod_id, clip_idx, seq, cut, i + 1, CASE WHEN length(parts[-1]) + 1 + length(cut[i + 1]) <= 38 THEN list_append(parts[:-2], parts[-1] || ' ' || cut[i + 1]) ELSE list_append(parts, cut[i + 1]) END FROM ckf WHERE i < len(cut)""",
    "cks": f"""SELECT c.*, parts, {_WORDS('c.text')} AS w, greatest(list_sum(list_transform(parts, lambda x: length(x))), 1) AS total, c."end" - start <= 2.5 AND length(c.text) <= 76 AS whole
        FROM ckn c JOIN ckf f ON f.vod_id = c.vod_id AND f.clip_idx = c.clip_idx AND f.seq = c.seq AND f.i = len(f.cut)""",
    "ckt": f"""SELECT vod_id, clip_idx, seq, start, "end", parts, total, 0 AS i, start AS a, start AS b FROM cks WHERE NOT whole AND len(parts) > 1 UNION ALL
        SELECT vod_id, clip_idx, seq, start, "end", parts, total, i + 1, b, {_r3('b + ("end" - start) * length(parts[i + 1]) / total')} FROM ckt WHERE i < len(parts)""",
    "ck0": f"""SELECT vod_id, clip_idx, seq, 0 AS pos, start, "end", text FROM cks WHERE whole
        UNION ALL SELECT vod_id, clip_idx, seq, 0, start, {_r3('(start + "end") / 2')}, array_to_string(w[:len(w) // 2], ' ') FROM cks WHERE NOT whole AND len(parts) = 1
        UNION ALL SELECT vod_id, clip_idx, seq, 1, {_r3('(start + "end") / 2')}, "end", array_to_string(w[len(w) // 2 + 1:], ' ') FROM cks WHERE NOT whole AND len(parts) = 1
        UNION ALL SELECT vod_id, clip_idx, seq, i - 1, {_r3('a')}, CASE WHEN i = len(parts) THEN "end" ELSE b END, {_normal('parts[i]')} FROM ckt WHERE i > 0""",
    "chs": 'SELECT vod_id, clip_idx, (row_number() OVER (PARTITION BY vod_id, clip_idx ORDER BY seq, pos))::INTEGER AS chunk_idx, start, "end", text FROM ck0',
    # highlights: what may be shown by chunk, then the choice with its state over a clip's chunks
    "hl0": f"""SELECT *, least(CASE WHEN regexp_matches(text, '[!?]') THEN 3 WHEN factor >= 0.6 THEN greatest(1, round_even((factor - 0.6::DOUBLE) / (1.0::DOUBLE - 0.6::DOUBLE) * 3, 0)) ELSE 0 END, greatest(1, len(w) // 2))::BIGINT AS quota,
        list_filter(list_transform(w, lambda x, i: {{'pos': i - 1, 'word': {_BARE('x')}}}), lambda c: length(c.word) > 1 AND NOT list_contains({_list(sorted(HIGHLIGHT_STOPWORDS))}, c.word)) AS known
        FROM (SELECT c.*, {_WORDS('c.text')} AS w, (k.intensity + 0.6::DOUBLE) / 2 AS factor FROM chs c JOIN clips k ON k.vod_id = c.vod_id AND k.clip_idx = c.clip_idx)""",
    "hl1": f"""SELECT *, list_transform(known, lambda c: {{'cost': length(c.word) + sqrt(c.pos / greatest(len(w), 1)) + greatest(0, length(c.word) - 4) * 0.3::DOUBLE, 'pos': c.pos, 'word': c.word, 'family': {_FAMILY('c.word')}}}) AS may FROM hl0""",
    "hlf": """SELECT DISTINCT vod_id, clip_idx, 0 AS k, 7::BIGINT AS budget, 0::BIGINT AS ready, []::VARCHAR[] AS words, []::INTEGER[] AS families, []::BIGINT[] AS chosen FROM chs UNION ALL
        SELECT vod_id, clip_idx, k, CASE mode WHEN 'pick' THEN budget - len(best) ELSE budget END, CASE mode WHEN 'pick' THEN k + 1 ELSE ready END,
          CASE mode WHEN 'pick' THEN list_transform(best, lambda x: x.word) WHEN 'clear' THEN []::VARCHAR[] ELSE words END,
          CASE mode WHEN 'pick' THEN list_filter(list_transform(best, lambda x: x.family), lambda x: x IS NOT NULL) WHEN 'clear' THEN []::INTEGER[] ELSE families END,
          CASE mode WHEN 'pick' THEN list_transform(best, lambda x: x.pos) ELSE []::BIGINT[] END
        FROM (SELECT *, (list_sort(list_transform(may, lambda c: {'price': c.cost * CASE WHEN list_contains(words, c.word) THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN c.family IS NOT NULL AND list_contains(families, c.family) THEN 1.3::DOUBLE ELSE 1 END,
            'pos': c.pos, 'word': c.word, 'family': c.family})))[:least(quota, budget)] AS best,
          CASE WHEN budget = 0 OR (k - 1 >= ready AND quota = 0) THEN 'clear' WHEN k - 1 >= ready AND len(may) > 0 THEN 'pick' ELSE 'same' END AS mode
        FROM (SELECT l.vod_id, l.clip_idx, l.k + 1 AS k, budget, ready, words, families, quota, may FROM hlf l JOIN hl1 c ON c.vod_id = l.vod_id AND c.clip_idx = l.clip_idx AND c.chunk_idx = l.k + 1))""",
    "hls": """SELECT c.vod_id, c.clip_idx, c.chunk_idx, c.start, c."end", CASE WHEN len(chosen) > 0 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN list_contains(chosen, i - 1) THEN upper(replace(x, 'ß', 'ss')) ELSE x END), ' ') ELSE text END AS text
        FROM hl1 c JOIN hlf l ON l.vod_id = c.vod_id AND l.clip_idx = c.clip_idx AND l.k = c.chunk_idx""",
    # voice
    "vframes": "SELECT vod_id, c.clip_idx, frame_idx, round(frame_idx * 0.1 + 0.05, 3) AS t, rms / 10 AS rms FROM frames CROSS JOIN (SELECT unnest(range(1, 26)) AS clip_idx) c",
    "vseg": 'SELECT s.vod_id, s.clip_idx, s.chunk_idx, s.start, s."end", s.text, c."end" - c.start AS clip_dur FROM ctr s JOIN clips c ON c.vod_id = s.vod_id AND c.clip_idx = s.clip_idx',
    "vhit": 'SELECT s.*, f.t, f.rms FROM vseg s JOIN vframes f ON f.vod_id = s.vod_id AND f.clip_idx = s.clip_idx AND f.t >= greatest(0, s.start - 0.5) AND f.t <= least(clip_dur, s."end" + 0.5)',
    "vloud": "SELECT * FROM (SELECT *, greatest(0.005, avg(rms) OVER w + 0.5 * stddev_pop(rms) OVER w) AS lv FROM vhit WINDOW w AS (PARTITION BY vod_id, clip_idx, chunk_idx)) WHERE rms >= lv",
    "vbounds": """SELECT vod_id, clip_idx, chunk_idx, greatest(0, round(greatest(min(t), any_value(start) - 1), 3)) AS det_start, least(any_value(clip_dur), round(least(max(t) + 0.025, any_value("end") + 1), 3)) AS det_end
        FROM vloud GROUP BY 1, 2, 3""",
    # bounds (one frame a second)
    "sides": """SELECT vod_id, 'head' AS side, 0.0::DOUBLE AS off, least(600, total_s * 0.5) AS scan FROM durations UNION ALL SELECT vod_id, 'tail', greatest(0, total_s - least(600, total_s * 0.5)), least(600, total_s * 0.5) FROM durations""",
    "scan0": "SELECT s.vod_id, s.side, s.off, f.frame_idx - ceil(s.off)::BIGINT AS pos, f.rms FROM frames f JOIN sides s ON s.vod_id = f.vod_id AND f.frame_idx >= s.off AND f.frame_idx < s.off + s.scan",
    "scan1": "SELECT *, coalesce(abs(rms - lag(rms) OVER (PARTITION BY vod_id, side ORDER BY pos)), 0) AS diff FROM scan0",
    "scan2": "SELECT *, rms / (max(rms) OVER w + 1e-9) + 0.5 * (diff / (max(diff) OVER w + 1e-9)) AS score FROM scan1 WINDOW w AS (PARTITION BY vod_id, side)",
    "scan": "SELECT *, pos + off AS t, score >= th AS active FROM (SELECT *, avg(score) OVER w + stddev_pop(score) OVER w AS th FROM scan2 WINDOW w AS (PARTITION BY vod_id, side))",
}


#: Cuts of long, dense windows, over the step `windows`; `parts` are the windows after them.
SPLITS = {
    "mids": """SELECT *, list_filter(gp, lambda x: x.t <= mid_at) AS pre, list_filter(gp, lambda x: x.t > mid_at) AS post, least(25, ("end" - start) * 0.3) AS reach FROM (
        SELECT vod_id, idx, start, "end", gp, pos, (gp[pos + 1].t + gp[pos + 2].t) / 2 AS mid_at FROM (SELECT *, unnest(range(len(gp) - 1)) AS pos FROM windows)) WHERE mid_at - start >= 8 AND "end" - mid_at >= 8""",
    "sptok": """SELECT vod_id, idx, pos, side, token, count(*) AS n FROM (SELECT c.vod_id, c.idx, c.pos, 0 AS side, unnest(s.tokens) AS token FROM mids c JOIN rich s ON s.vod_id = c.vod_id AND s.start < c.mid_at AND s."end" > c.mid_at - reach
        UNION ALL SELECT c.vod_id, c.idx, c.pos, 1, unnest(s.tokens) FROM mids c JOIN rich s ON s.vod_id = c.vod_id AND s.start < c.mid_at + reach AND s."end" > c.mid_at) GROUP BY ALL""",
    "spdot": "SELECT a.vod_id, a.idx, a.pos, sum(a.n * b.n) AS d FROM sptok a JOIN sptok b ON a.vod_id = b.vod_id AND a.idx = b.idx AND a.pos = b.pos AND a.token = b.token AND a.side = 0 AND b.side = 1 GROUP BY 1, 2, 3",
    "spnrm": "SELECT vod_id, idx, pos, side, sqrt(sum(n * n)) AS q FROM sptok GROUP BY ALL",
    "pts": """SELECT *, round((0.40 * f_gap + 0.35 * f_sem + 0.25 * (1 - least(e1, e2) / greatest(e1, e2, 1e-6)))::DECIMAL(24, 10), 4)::DOUBLE AS split_score FROM (
        SELECT c.*, CASE WHEN c.vod_id IN (SELECT vod_id FROM transcript) AND c.vod_id IN (SELECT vod_id FROM windows GROUP BY vod_id HAVING count(*) > 1) THEN 1 - coalesce(d / (a.q * b.q), 0) ELSE 0.5 END AS f_sem,
          least(1, (list_min(list_transform(post, lambda x: x.t)) - list_max(list_transform(pre, lambda x: x.t))) / 30.0) AS f_gap, list_avg(list_transform(pre, lambda x: x.i)) AS e1, list_avg(list_transform(post, lambda x: x.i)) AS e2
        FROM mids c LEFT JOIN spdot d ON d.vod_id = c.vod_id AND d.idx = c.idx AND d.pos = c.pos LEFT JOIN spnrm a ON a.vod_id = c.vod_id AND a.idx = c.idx AND a.pos = c.pos AND a.side = 0
        LEFT JOIN spnrm b ON b.vod_id = c.vod_id AND b.idx = c.idx AND b.pos = c.pos AND b.side = 1 WHERE len(pre) > 0 AND len(post) > 0)""",
    "cutat": """SELECT vod_id, idx, arg_min(mid_at, (-split_score, mid_at)) AS mid_at FROM pts WHERE "end" - start >= 60 AND len(gp) >= 3 AND len(gp) / ("end" - start) * 60 >= 3 GROUP BY 1, 2 HAVING max(split_score) >= 0.3""",
    "parts": """SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY old_idx, half) - 1 AS idx FROM (
        SELECT w.vod_id, w.idx AS old_idx, h.half, CASE WHEN h.half = 1 THEN cut_at ELSE w.start END AS start, CASE WHEN h.half = 0 AND cut_at IS NOT NULL THEN cut_at ELSE w."end" END AS "end",
          CASE WHEN cut_at IS NULL THEN gp WHEN h.half = 0 THEN list_filter(gp, lambda x: x.t <= cut_at) ELSE list_filter(gp, lambda x: x.t > cut_at) END AS gp
        FROM (SELECT w.*, round(mid_at::DECIMAL(24, 10), 3)::DOUBLE AS cut_at FROM windows w LEFT JOIN cutat c ON c.vod_id = w.vod_id AND c.idx = w.idx) w JOIN (SELECT unnest([0, 1])::INTEGER AS half) h ON h.half = 0 OR cut_at IS NOT NULL)""",
}


def renamed(steps: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """The steps under other names, reading other steps."""
    swap = lambda text: re.sub(r"\b(" + "|".join(names) + r")\b(?!\()", lambda m: names[m[1]], text)
    return {names.get(k, k): swap(body) for k, body in steps.items()}


def _hybrid() -> dict[str, str]:
    """Candidates from momentum sessions to the final filter, then scored, selected and refined: the steps above, chained."""
    of = lambda *names: {n: STEPS[n] for n in names}
    topics = ["win_seg", "win_text", "tok", "ctx", "cosine", "trans", "cont0", "contf", "contb", "continuity"]
    out = renamed({**of(*topics), **SPLITS}, {n: f"h_{n}" for n in (*topics, *SPLITS)} | {"windows": "active"})
    flagged = """SELECT p.vod_id, p.idx, p.start, p."end", p.gp, c.semantic_score, c.has_transition, NOT c.is_break AS topic_continuity, row_number() OVER (PARTITION BY p.vod_id ORDER BY p.idx) AS k
        FROM h_parts p JOIN h_continuity c ON c.vod_id = p.vod_id AND c.idx = p.old_idx"""
    folded = """SELECT vod_id, k, idx, start, "end", gp, semantic_score, has_transition, topic_continuity FROM h_flagged WHERE k = 1 UNION ALL
        SELECT c.vod_id, c.k, CASE WHEN j THEN l.idx ELSE c.idx END, CASE WHEN j THEN l.start ELSE c.start END, CASE WHEN j THEN greatest(l."end", c."end") ELSE c."end" END, CASE WHEN j THEN list_concat(l.gp, c.gp) ELSE c.gp END,
          CASE WHEN j THEN l.semantic_score ELSE c.semantic_score END, CASE WHEN j THEN l.has_transition ELSE c.has_transition END, CASE WHEN j THEN l.topic_continuity ELSE c.topic_continuity END
        FROM (SELECT l.*, c.k AS ck, c.idx NOT IN (SELECT b.idx FROM h_continuity b WHERE b.vod_id = c.vod_id AND b.is_break) AND c.start - l."end" <= 4 * CASE WHEN l."end" - l.start >= 60 THEN 0.5 WHEN l."end" - l.start <= 15 THEN 1.5 ELSE 1 END
            AND c."end" - l.start <= 120 AS j FROM h_folded l JOIN h_flagged c ON c.vod_id = l.vod_id AND c.k = l.k + 1) l JOIN h_flagged c ON c.vod_id = l.vod_id AND c.k = l.ck"""
    merged = """SELECT vod_id, idx, arg_max(start, k) AS start, arg_max("end", k) AS "end", arg_max(gp, k) AS gp, any_value(semantic_score) AS semantic_score, any_value(has_transition) AS has_transition,
        any_value(topic_continuity) AS topic_continuity FROM h_folded GROUP BY vod_id, idx"""
    out |= {"h_flagged": flagged, "h_folded": folded, "h_merged": merged}
    measured = of("win_seg", "win_text", "best_peak", "near_win", "metrics", "tiers")
    measured["metrics"] = measured["metrics"].replace("0.15 * 0.5", "0.15 * semantic_score").replace('w."end" - w.start AS d,', 'w."end" - w.start AS d, w.semantic_score, w.has_transition, w.topic_continuity,')
    out |= renamed(measured, {n: f"m_{n}" for n in measured} | {"windows": "h_merged"})
    out["h_found"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY start, idx) AS place FROM (
        SELECT *, bool_or(k) OVER (PARTITION BY vod_id, start, "end") AS keep FROM (SELECT *, confidence_score >= 0.15 OR row_number() OVER (PARTITION BY vod_id ORDER BY energy_score DESC, idx) <= 5 AS k FROM m_tiers))
        WHERE keep AND "end" - start BETWEEN 8 AND 120) WHERE place <= 25"""
    out["h_clips"] = 'SELECT vod_id, start, "end", peak_timestamp, intensity, row_number() OVER (PARTITION BY vod_id ORDER BY start, "end", peak_timestamp) AS clip_idx FROM h_found'
    scored = of("clip_seg", "hook3", "hook5", "body", "phrase", "early", "raw_score", "hooked", "strength", "ranked", "elig", "pick", "selected", "cover", "upcome", "refined")
    return out | renamed(scored, {n: f"b_{n}" for n in scored} | {"clips": "h_clips"})


def _subtitles() -> dict[str, str]:
    """The subtitles of a clip, from highlighted chunks to calm ones."""
    up = lambda x: f"(length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) > 1 AND regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g') = upper(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))"
    low = "CASE WHEN x[1] = chr(10) THEN chr(10) || upper(lower(x)[2]) || lower(x)[3:] WHEN i = 1 THEN upper(lower(x)[1]) || lower(x)[2:] ELSE lower(x) END"
    return {
        "st_words": f"SELECT *, {_WORDS('text')} AS w FROM hls",
        "st_laid": wrapped_sql("st_words"),
        "st_w": f"SELECT *, {_WORDS('text')} AS w FROM st_laid",
        "st_cap": f"""SELECT vod_id, clip_idx, chunk_idx AS old, 0 AS half, start, CASE WHEN "end" - start <= 4 THEN "end" ELSE {_r3('(start + "end") / 2')} END AS "end", CASE WHEN "end" - start <= 4 THEN text ELSE array_to_string(w[:greatest(1, len(w) // 2)], ' ') END AS text FROM st_w
            UNION ALL SELECT vod_id, clip_idx, chunk_idx, 1, {_r3('(start + "end") / 2')}, "end", array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM st_w WHERE "end" - start > 4""",
        "st_num": "SELECT *, (row_number() OVER (PARTITION BY vod_id, clip_idx ORDER BY old, half))::INTEGER AS chunk_idx FROM st_cap",
        "st_fix": """SELECT vod_id, clip_idx, chunk_idx, start, CASE WHEN nxt < "end" THEN greatest(round(start + 0.1, 3), round(nxt - 0.05, 3)) ELSE "end" END AS "end", text FROM (SELECT *, lead(start) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx) AS nxt FROM st_num)""",
        "st_calm": f"""SELECT vod_id, clip_idx, chunk_idx, start, "end", CASE WHEN 2 * len(list_filter(w, lambda x: {up('x')})) > len(w) THEN replace(array_to_string(list_transform(tok, lambda x, i: CASE WHEN {up('x')}
            AND len(list_filter(tok[:i - 1], lambda y: {up('y')})) >= 2 THEN {low} ELSE x END), ' '), ' ' || chr(10), chr(10)) ELSE text END AS text
            FROM (SELECT *, string_split(replace(text, chr(10), ' ' || chr(10)), ' ') AS tok, {_WORDS('text')} AS w FROM st_fix)""",
    }


_FIT = lambda w: f"greatest(1, len(list_filter(range(1, len({w}) + 1), lambda k: length(array_to_string({w}[:k], ' ')) <= 38)))"


def wrapped_sql(words_step: str) -> str:
    """Chunks laid out in at most two lines, from a step with their words as w."""
    return f"""SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, start, "end", CASE WHEN length(text) <= 38 THEN text WHEN two = 0 THEN array_to_string(p, ' ') ELSE array_to_string(p[:cut], ' ') || chr(10) || array_to_string(p[cut + 1:], ' ') END AS text
  FROM (SELECT *, CASE WHEN abs(a - b) / greatest(a, b) > 0.4 THEN greatest(1, least(1 + len(list_filter(range(1, len(p) + 1), lambda k: length(array_to_string(p[:k], ' ')) < length(array_to_string(p, ' ')) // 2)), len(p) - 1)) ELSE one END AS cut
  FROM (SELECT *, length(array_to_string(p[:one], ' ')) AS a, length(array_to_string(p[one + 1:], ' ')) AS b
  FROM (SELECT *, CASE WHEN length(array_to_string(w[one + two + 1:], ' ')) + 1 > 3.8 AND len(w) > one + two AND NOT (length(e) > 1 AND e = upper(e)) THEN list_append(w[:one + two - 1], w[one + two] || '…') ELSE w[:one + two] END AS p
  FROM (SELECT *, regexp_replace(w[one + two], '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS e FROM (SELECT *, CASE WHEN len(w) > one THEN {_FIT('w[one + 1:]')} ELSE 0 END AS two FROM (SELECT *, {_FIT('w')} AS one FROM {words_step}))))))"""


#: Steps from frames to peaks.
AUDIO = ["frames", "energy0", "energy", "thresh", "runs0", "runs", "maxima", "ranked_max", "greedy", "kept_max", "top50"]


def sql(select: str, more: dict[str, str] | None = None, first: list[str] = ()) -> str:
    """A query over the steps and some more; those named first stand before the others."""
    steps = ",\n".join(f"{name} AS ({body})" for name, body in {**{n: STEPS[n] for n in first}, **STEPS, **(more or {})}.items())
    return f"WITH RECURSIVE {steps}\n{select}"


HYBRID, SUBTITLES = _hybrid(), _subtitles()


JUNK_LIST = _list(JUNK)
