"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

from .queries import ALPHA, CONFIG, UNITS, WIDTH

FORCED = ", ".join(map(str, CONFIG.forced_periods))

#: Common table expressions in order; each may use those before it.
STEPS = {
    "ev": """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderdate AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 48 THEN 'DEATH' ELSE p_type || '/' || p_brand END AS event
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "ue": """SELECT CAST(user_id AS VARCHAR) AS patient_id, ts AS date, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS year,
        CASE WHEN event_type = 'error' AND value > 150 THEN 'DEATH' ELSE event_type END AS event FROM events""",
    "years": f"""SELECT year, CASE WHEN (SELECT count(DISTINCT year) FROM ev WHERE year IN ({FORCED})) = {len(CONFIG.forced_periods)} THEN year IN ({FORCED})
        ELSE row_number() OVER (ORDER BY year) <= count(*) OVER () // 2 END AS is_train FROM (SELECT DISTINCT year FROM ev)""",
    "split": f"""SELECT patient_id, rn, rn <= ceil(n * {CONFIG.test_percent} / 100) AS is_test FROM (SELECT patient_id,
        row_number() OVER (ORDER BY md5('{CONFIG.seed}:' || patient_id), patient_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM ev))""",
    "train": """SELECT * FROM ev WHERE year IN (SELECT year FROM years WHERE is_train) AND patient_id IN (SELECT patient_id FROM split WHERE NOT is_test)""",
    "dead": """SELECT patient_id, min(year) AS terminal_year FROM train WHERE regexp_matches(event, '(?i)DEATH') GROUP BY patient_id""",
    "avail": """SELECT t.patient_id, count(DISTINCT t.year) AS n_rows, string_agg(DISTINCT CAST(t.year AS VARCHAR), ',' ORDER BY CAST(t.year AS VARCHAR)) AS years,
        any_value(d.terminal_year) IS NOT NULL AS is_pos FROM train t LEFT JOIN dead d ON t.patient_id = d.patient_id
        WHERE d.terminal_year IS NULL OR t.year <= d.terminal_year GROUP BY t.patient_id""",
    "running": f"""SELECT patient_id, is_pos, n_rows, row_number() OVER w AS rn, CAST(sum(n_rows) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM avail
        WINDOW w AS (PARTITION BY is_pos ORDER BY md5(CASE WHEN is_pos THEN '{CONFIG.seed}:' ELSE '{CONFIG.seed + 1}:' END || patient_id), patient_id)""",
    "chosen": f"""SELECT * FROM running WHERE rn <= (SELECT least(count(*) FILTER (WHERE is_pos AND cum <= {CONFIG.cap_positive}), count(*) FILTER (WHERE NOT is_pos AND cum <= {CONFIG.cap_negative})) FROM running)""",
    "own": "SELECT * FROM train WHERE patient_id IN (SELECT patient_id FROM chosen)",
    "freq": "SELECT event, count(*) AS n FROM (SELECT DISTINCT patient_id, year, event FROM own WHERE upper(event) <> 'DEATH') GROUP BY event",
    "top": f"SELECT event FROM freq ORDER BY n DESC, event LIMIT {CONFIG.top_k}",
    "vocab": "SELECT event FROM top UNION SELECT 'DEATH'",
    "counts": "SELECT patient_id, year, event, count(date) AS n FROM own WHERE event IN (SELECT event FROM vocab) GROUP BY ALL",
    "trimmed": """SELECT * FROM (SELECT *, min(CASE WHEN event = 'DEATH' AND n > 0 THEN year END) OVER (PARTITION BY patient_id) AS first FROM counts) WHERE first IS NULL OR year <= first""",
    "emb": "SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS act FROM embeddings",
    "unit": f"SELECT CAST(range AS INTEGER) AS unit FROM range({UNITS})",
    "code": """SELECT row_id, unit AS idx, greatest(sum(act * (((unit * 31 + e.idx * 17) % 13) - 6) / 10) + (unit % 3 - 1) / 10, 0) AS h FROM emb e, unit GROUP BY row_id, unit""",
    "back": f"""SELECT row_id, pos, sum(h * (((c.idx * 31 + pos * 17) % 13) - 6) / 10) + (pos % 5 - 2) / 10 AS xhat FROM code c, (SELECT CAST(range AS INTEGER) AS pos FROM range({WIDTH})) GROUP BY row_id, pos""",
    "wide": """SELECT l_orderkey AS row_id, l_linenumber AS line, CASE WHEN l_quantity > 5 THEN l_quantity END AS quantity,
        CASE WHEN l_returnflag <> 'N' THEN CAST(l_returnflag = 'R' AS INTEGER) END AS returned, CASE WHEN l_tax > 0 THEN l_extendedprice END AS price, 1.0::DOUBLE AS constant, l_shipdate AS shipped FROM lineitem""",
}

#: What each step reads.
USES = {
    "years": "ev", "split": "ev", "train": "ev years split", "dead": "train", "avail": "train dead", "running": "avail", "chosen": "running", "own": "train chosen", "freq": "own", "top": "freq", "vocab": "top",
    "counts": "own vocab", "trimmed": "counts", "code": "emb unit", "back": "code",
}


def sql(select: str, *steps: str) -> str:
    """``select`` after the given steps and all that they use."""
    need: set[str] = set()

    def add(step: str) -> None:
        if step not in need:
            need.add(step)
            for s in USES.get(step, "").split():
                add(s)

    for step in steps:
        add(step)
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in STEPS.items() if k in need) + f"\n{select}"


def thresholds(support: int) -> str:
    return f"SELECT CAST(idx AS INTEGER) AS idx, count(*) AS n_positive, median(act) AS threshold FROM emb WHERE act > 0 GROUP BY idx HAVING count(*) >= {support}"


MARKS = "SELECT row_id, CAST(e.idx AS INTEGER) AS idx, CAST(act > threshold AS INTEGER) AS y FROM emb e JOIN ({}) t ON e.idx = t.idx"
#: Row by row, a column for each kind of event.
KINDS = ("click", "error", "purchase", "signup", "view", "DEATH")
CELLS = ", ".join(f"count(date) FILTER (WHERE event = '{k}') AS n_{k.lower()}" for k in KINDS)
IN_KINDS = ", ".join(f"'{k}'" for k in KINDS)

ORACLE_SQL = {
    "scan_canonical_events": sql("SELECT patient_id, date, year, event FROM ev", "ev"),
    "scan_user_events": sql("SELECT patient_id, date, year, event FROM ue", "ue"),
    "terminal_regex_filter": sql("SELECT DISTINCT patient_id, year FROM ev WHERE regexp_matches(event, '(?i)DEATH')", "ev"),
    "first_terminal_period": sql("SELECT patient_id, min(year) AS terminal_year FROM ev WHERE regexp_matches(event, '(?i)DEATH') GROUP BY patient_id", "ev"),
    "presence_years_array": sql("SELECT patient_id, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years, count(DISTINCT year) AS n_years FROM ev GROUP BY patient_id", "ev"),
    "period_split_forced_or_half": sql("SELECT * FROM years", "years"),
    "period_split_days": sql("SELECT year, row_number() OVER (ORDER BY year) <= count(*) OVER () // 2 AS is_train FROM (SELECT DISTINCT year FROM ue)", "ue"),
    "anti_join_periods": sql("SELECT DISTINCT year FROM ev WHERE year NOT IN (SELECT year FROM years WHERE is_train)", "years"),
    "entity_hash_split": sql("SELECT * FROM split", "split"),
    "membership_semi_join": sql(
        f"SELECT * FROM train WHERE event IN (SELECT event FROM (SELECT event, count(*) AS n FROM (SELECT DISTINCT patient_id, year, event FROM train WHERE upper(event) <> 'DEATH') GROUP BY event) ORDER BY n DESC, event LIMIT {CONFIG.top_k})", "train"
    ),
    "availability_table": sql("SELECT * FROM avail", "avail"),
    "running_rows": sql("SELECT * FROM running", "running"),
    "balanced_cap_selection": sql("SELECT * FROM chosen", "chosen"),
    "uncapped_fallback_selection": sql("SELECT * FROM running WHERE rn <= (SELECT least(count(*) FILTER (WHERE is_pos), count(*) FILTER (WHERE NOT is_pos)) FROM running)", "running"),
    "event_frequency_topm": sql(f"SELECT event, n FROM freq ORDER BY n DESC, event LIMIT {CONFIG.candidates}", "freq"),
    "vocab_union_terminal": sql("SELECT event FROM vocab", "vocab"),
    "long_event_counts": sql("SELECT patient_id, year, event, count(date) AS n FROM ev GROUP BY ALL", "ev"),
    "pivot_event_counts": sql(f"SELECT patient_id, year, {CELLS} FROM ue WHERE event IN ({IN_KINDS}) GROUP BY patient_id, year", "ue"),
    "pivot_align_missing": sql("SELECT patient_id, year, count(date) AS n_click, CAST(0 AS BIGINT) AS n_never_seen, CAST(0 AS BIGINT) AS n_death FROM ue WHERE event = 'click' GROUP BY patient_id, year", "ue"),
    "presence_preserved_rows": sql("SELECT patient_id, year, count(date) FILTER (WHERE event = 'error') AS n_error FROM ue GROUP BY patient_id, year", "ue"),
    "trim_post_terminal": sql(
        "SELECT patient_id, year, event, n FROM (SELECT *, min(CASE WHEN event = 'DEATH' THEN year END) OVER (PARTITION BY patient_id) AS first FROM (SELECT patient_id, year, event, count(date) AS n FROM ue GROUP BY ALL)) WHERE first IS NULL OR year <= first", "ue"
    ),
    "train_matrix_rows": sql(
        f"SELECT k.patient_id, k.year, v.event, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT patient_id, year FROM trimmed ORDER BY md5('{CONFIG.seed}:' || patient_id || ':' || year), patient_id, year LIMIT {CONFIG.max_rows}) k CROSS JOIN vocab v LEFT JOIN trimmed t ON k.patient_id = t.patient_id AND k.year = t.year AND v.event = t.event", "trimmed"
    ),
    "test_matrix_rows": sql(
        "SELECT k.patient_id, k.year, v.event, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT patient_id, year FROM cells) k CROSS JOIN vocab v LEFT JOIN cells t ON k.patient_id = t.patient_id AND k.year = t.year AND v.event = t.event", "vocab"
    ).replace("\nSELECT", ",\ncells AS (SELECT patient_id, year, event, count(date) AS n FROM ev WHERE year IN (SELECT year FROM years WHERE NOT is_train) AND patient_id IN (SELECT patient_id FROM split WHERE is_test) AND event IN (SELECT event FROM vocab) GROUP BY ALL)\nSELECT", 1),
    "row_label": sql("SELECT patient_id, year, CAST(count(date) FILTER (WHERE event = 'DEATH') > 0 AS INTEGER) AS label FROM ev GROUP BY patient_id, year", "ev"),
    "class_ratio": sql("SELECT n_pos, n_neg, round(n_neg / nullif(n_pos, 0), 6) AS ratio FROM (SELECT count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg FROM (SELECT count(date) FILTER (WHERE event = 'DEATH') > 0 AS label FROM ev GROUP BY patient_id, year))", "ev"),
    "row_cap_sample": sql(f"SELECT patient_id, year FROM (SELECT DISTINCT patient_id, year FROM ev) ORDER BY md5('{CONFIG.seed}:' || patient_id || ':' || year), patient_id, year LIMIT {CONFIG.max_rows}", "ev"),
    "array_features": sql(f"SELECT patient_id, year, concat_ws(',', n_click, n_error, n_purchase, n_signup, n_view) AS features, CAST(n_death > 0 AS INTEGER) AS label FROM (SELECT patient_id, year, {CELLS} FROM ue WHERE event IN ({IN_KINDS}) GROUP BY patient_id, year)", "ue"),
    "wide_outcome_prepare": sql("SELECT row_id, line, quantity, price, constant, returned AS outcome FROM wide WHERE returned IS NOT NULL", "wide"),
    "impute_median": sql("SELECT row_id, line, round(coalesce(quantity, (SELECT median(quantity) FROM wide)), 6) AS quantity, round(coalesce(price, (SELECT median(price) FROM wide)), 6) AS price FROM wide", "wide"),
    "standardise_pop": sql("SELECT row_id, line, round((quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER (), 6) AS quantity, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price, 0.0::DOUBLE AS constant FROM wide", "wide"),
    "unit_positive_median": sql(f"SELECT idx, n_positive, round(threshold, 6) AS threshold FROM ({thresholds(240)})", "emb"),
    "binarise_units": sql(MARKS.format(thresholds(240)), "emb"),
    "useful_units": sql(f"SELECT idx FROM ({MARKS.format(thresholds(50))}) GROUP BY idx HAVING sum(y) FILTER (WHERE row_id % 2 = 0) > 0 AND sum(y) FILTER (WHERE row_id % 2 = 1) > 0", "emb"),
    "binary_metrics": sql(
        f"""SELECT idx, n, round(hit / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
        SELECT m.idx, count(*) AS n, count(*) FILTER (WHERE (m.y = 1) = (label >= 5)) AS hit, count(*) FILTER (WHERE m.y = 1 AND label >= 5) AS tp, count(*) FILTER (WHERE m.y = 1 AND label < 5) AS fp, count(*) FILTER (WHERE m.y = 0 AND label >= 5) AS fn
        FROM ({MARKS.format(thresholds(50))}) m JOIN embeddings ON vec_id = m.row_id GROUP BY m.idx) WHERE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) >= 0.35""", "emb"
    ),
    "affine_relu_encode": sql("SELECT row_id, idx, round(h, 6) AS h FROM code", "code"),
    "affine_in_plan": sql("SELECT row_id, idx, round(h, 6) AS h FROM code", "code"),
    "affine_decode": sql("SELECT row_id, pos, round(xhat, 6) AS xhat FROM back", "back"),
    "row_cosine_and_sparsity": sql(
        "SELECT round(avg(c), 6) AS mean_cosine, round((1 - avg(c)) * 100, 6) AS loss_percent, (SELECT round(avg(z), 6) FROM (SELECT count(*) FILTER (WHERE h = 0) AS z FROM code GROUP BY row_id)) AS mean_zeros FROM (SELECT sum(act * xhat) / nullif(sqrt(sum(act * act)) * sqrt(sum(xhat * xhat)), 0) AS c FROM emb e JOIN back b ON e.row_id = b.row_id AND e.idx = b.pos GROUP BY e.row_id)", "back", "emb"
    ),
    "sae_loss_terms": sql(
        f"SELECT round(r, 6) AS reconstruction, round(s, 6) AS sparsity, round(r + s, 6) AS loss FROM (SELECT (SELECT sum((xhat - act) * (xhat - act)) / {WIDTH} FROM emb e JOIN back b ON e.row_id = b.row_id AND e.idx = b.pos) AS r, (SELECT {ALPHA} * sum(h) FROM code) AS s)", "back", "emb"
    ),
    "concept_dot_scores": sql("SELECT CAST(label AS INTEGER) AS idx, round(sum(m * g), 6) AS score FROM (SELECT label, idx, avg(act) AS m FROM emb GROUP BY label, idx) JOIN (SELECT idx, avg(act) AS g FROM emb GROUP BY idx) USING (idx) GROUP BY label", "emb"),
    "stream_bucket_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS event, count(*) AS n FROM events GROUP BY ALL",
    "stream_first_terminal": """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'error' AND value > 150)
        SELECT patient_id, make_timestamp(min(ms) * 1000) AS terminal_date FROM t GROUP BY patient_id HAVING min(ms) < (SELECT max(ms) - 86400000 FROM t)""",
    "feather_roundtrip": "SELECT * FROM orders",
    "feather_columns": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
    "outcome_apart": sql("SELECT returned AS outcome, count(*) AS n, (SELECT count(*) FROM wide WHERE returned IS NOT NULL) AS n_rows, (SELECT count(price) FROM wide WHERE returned IS NOT NULL) AS n_prices, 'row_id,line,quantity,price,constant' AS columns FROM wide WHERE returned IS NOT NULL GROUP BY returned", "wide"),
    "normalised_features": sql(
        "SELECT row_id, line, round((q - avg(q) OVER ()) / stddev_pop(q) OVER (), 6) AS quantity, round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 6) AS price FROM (SELECT row_id, line, CAST(coalesce(quantity, (SELECT median(quantity) FROM wide)) AS DOUBLE) AS q, CAST(coalesce(price, (SELECT median(price) FROM wide)) AS DOUBLE) AS p FROM wide)", "wide"
    ),
    "cached_counts": sql("SELECT patient_id, year, event, count(date) AS n FROM ue GROUP BY ALL", "ue"),
    "weights_roundtrip": f"""SELECT 'means' AS name, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS row, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT label, pos, avg(v) AS v FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos)
        UNION ALL SELECT 'b_e', 0, CAST(range AS INTEGER), (range % 3 - 1) / 10 FROM range({UNITS}) UNION ALL SELECT 'b_d', 0, CAST(range AS INTEGER), (range % 5 - 2) / 10 FROM range({WIDTH})""",
}
ORACLE_SQL["appended_metrics"] = f"{ORACLE_SQL['binary_metrics'].replace('SELECT idx, n, round(hit', ', found AS (SELECT idx, n, round(hit', 1)}) SELECT * FROM found UNION ALL SELECT * FROM found"
ORACLE_SQL["concept_vector_slopes"] = sql(f"SELECT DISTINCT CAST(c.idx AS INTEGER) AS idx, CAST(p.range AS INTEGER) AS pos, true AS vanishes FROM (SELECT idx FROM code WHERE h > 0 GROUP BY idx HAVING count(*) >= 50) c, range({WIDTH + 1}) p", "code")

#: Trees of two levels: bins at 64 quantiles (or all values if there are no more), gini, ties to the first feature's least limit.
SPLITS = {
    "y": "SELECT c.row_id, c.idx, CAST(h > threshold AS INTEGER) AS y FROM code c JOIN (SELECT idx, median(h) AS threshold FROM code WHERE h > 0 GROUP BY idx HAVING count(*) >= 50) t USING (idx)",
    "valued": "SELECT *, row_number() OVER (PARTITION BY idx ORDER BY act) - 1 AS rank, count(*) OVER (PARTITION BY idx) AS total FROM emb",
    "limits": """SELECT DISTINCT idx AS feature, act AS lim FROM valued JOIN (SELECT idx, count(DISTINCT act) AS kinds FROM emb GROUP BY idx) USING (idx) WHERE kinds <= 64 OR rank IN (SELECT (total - 1) * range // 64 FROM range(1, 64))
        UNION ALL SELECT idx, 'inf'::DOUBLE FROM emb GROUP BY idx HAVING count(DISTINCT act) > 64""",
    "binned": "SELECT row_id, e.idx AS feature, act, min(lim) AS lim FROM emb e JOIN limits l ON l.feature = e.idx AND lim >= act GROUP BY row_id, e.idx, act",
}


def _best(rows: str) -> str:
    """The best split by (idx, place) of rows (idx, place, feature, lim, y)."""
    gini = lambda p, n: f"coalesce(2 * ({p} / ({n})) * (1 - {p} / ({n})) * ({n}), 0)"
    return f"""SELECT * FROM (SELECT *, round({gini("pa", "na")} - {gini("p", "n")} - {gini("(pa - p)", "na - n")}, 9) AS gain FROM (
        SELECT idx, place, feature, lim, CAST(sum(sum(1)) OVER w AS DOUBLE) AS n, CAST(sum(sum(y)) OVER w AS DOUBLE) AS p, CAST(sum(sum(1)) OVER (PARTITION BY idx, place, feature) AS DOUBLE) AS na, CAST(sum(sum(y)) OVER (PARTITION BY idx, place, feature) AS DOUBLE) AS pa
        FROM ({rows}) GROUP BY idx, place, feature, lim WINDOW w AS (PARTITION BY idx, place, feature ORDER BY lim)) WHERE n >= 50 AND na - n >= 50) WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY idx, place ORDER BY gain DESC, feature, lim) = 1"""


SPLITS["first"] = _best("SELECT y.idx, '' AS place, feature, lim, y FROM binned JOIN y USING (row_id)")
SPLITS["second"] = _best("SELECT y.idx, CASE WHEN e.act <= f.lim THEN 'L' ELSE 'R' END AS place, b.feature, b.lim, y FROM y JOIN first f USING (idx) JOIN emb e ON e.row_id = y.row_id AND e.idx = f.feature JOIN binned b ON b.row_id = y.row_id")
#: Newton's steps for two coefficients a, b and an intercept c, by Cramer's rule; twelve are more than enough.
NEWTON = {
    "y": SPLITS["y"],
    "pairs": "SELECT y.idx, y, max(act) FILTER (e.idx = 0) AS u, max(act) FILTER (e.idx = 1) AS v FROM y JOIN emb e USING (row_id) GROUP BY y.row_id, y.idx, y",
    "t0": "SELECT DISTINCT idx, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM pairs",
}
for _i in range(12):
    NEWTON[f"s{_i}"] = f"""SELECT idx, a, b, c, sum((p - y) * u) + a AS gu, sum((p - y) * v) + b AS gv, sum(p - y) AS g, sum(w * u * u) + 1 AS uu, sum(w * v * v) + 1 AS vv, sum(w * u * v) AS uv, sum(w * u) AS u1, sum(w * v) AS v1, sum(w) AS w1
        FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(a * u + b * v + c))) AS p FROM pairs JOIN t{_i} USING (idx))) GROUP BY idx, a, b, c"""
    NEWTON[f"t{_i + 1}"] = f"""SELECT idx, a - (gu * (vv * w1 - v1 * v1) - uv * (gv * w1 - v1 * g) + u1 * (gv * v1 - vv * g)) / d AS a, b - (uu * (gv * w1 - v1 * g) - gu * (uv * w1 - v1 * u1) + u1 * (uv * g - gv * u1)) / d AS b,
        c - (uu * (vv * g - gv * v1) - uv * (uv * g - gv * u1) + gu * (uv * v1 - vv * u1)) / d AS c FROM (SELECT *, uu * (vv * w1 - v1 * v1) - uv * (uv * w1 - v1 * u1) + u1 * (uv * v1 - vv * u1) AS d FROM s{_i})"""
ORACLE_SQL["separator_coefficients"] = sql("SELECT CAST(idx AS INTEGER) AS idx, CAST(pos AS INTEGER) AS pos, round(coefficient, 6) AS coefficient FROM (SELECT idx, 0 AS pos, a AS coefficient FROM t12 UNION ALL SELECT idx, 1, b FROM t12 UNION ALL SELECT idx, 2, c FROM t12)", "code").replace(
    "\nSELECT CAST(idx", ",\n" + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in NEWTON.items()) + "\nSELECT CAST(idx", 1
)
ORACLE_SQL["unit_tree_splits"] = sql(
    "SELECT CAST(idx AS INTEGER) AS idx, place, CAST(feature AS INTEGER) AS feature, round(lim, 6) AS limit, CAST(na AS BIGINT) AS n, CAST(pa AS BIGINT) AS positive, round(gain, 6) AS gain FROM (SELECT * FROM first UNION ALL SELECT * FROM second)", "code"
).replace("\nSELECT CAST(idx", ",\n" + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in SPLITS.items()) + "\nSELECT CAST(idx", 1)

#: The first boosted tree: every cut of every candidate at the root, then in both children, of which the better one is cut.
BOOSTED = {
    "candidates": f"SELECT event, row_number() OVER (ORDER BY n DESC, event) AS code FROM freq ORDER BY code LIMIT {CONFIG.candidates}",
    "found": "SELECT patient_id, year, event, count(date) AS n FROM own WHERE event = 'DEATH' OR event IN (SELECT event FROM candidates) GROUP BY ALL",
    "rows_": "SELECT *, CASE WHEN y = 1 THEN (total - pos) / pos ELSE 1 END AS w, pos / total AS p FROM (SELECT *, CAST(sum(y) OVER () AS DOUBLE) AS pos, count(*) OVER () AS total FROM (SELECT patient_id, year, CAST(count(*) FILTER (WHERE event = 'DEATH') > 0 AS INTEGER) AS y FROM found GROUP BY patient_id, year))",
    "dense": "SELECT patient_id, year, code, event, coalesce(n, 0) AS lim, w * (p - y) AS g, w * p * (1 - p) AS h FROM rows_ CROSS JOIN candidates LEFT JOIN found USING (patient_id, year, event)",
}


def _boosted(rows: str) -> str:
    """The best cut by place of rows (place, code, event, lim, g, h)."""
    return f"""SELECT * FROM (SELECT *, round(gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha, 9) AS gain FROM (SELECT place, code, event, lim, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl, sum(count(*)) OVER w AS nl, sum(sum(g)) OVER a AS ga, sum(sum(h)) OVER a AS ha, sum(count(*)) OVER a AS na
        FROM ({rows}) GROUP BY place, code, event, lim WINDOW a AS (PARTITION BY place, code), w AS (PARTITION BY place, code ORDER BY lim)) WHERE nl >= 20 AND na - nl >= 20 AND hl >= 0.001 AND ha - hl >= 0.001) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY place ORDER BY gain DESC, code, lim) = 1"""


BOOSTED["root"] = _boosted("SELECT '' AS place, code, event, lim, g, h FROM dense")
BOOSTED["children"] = _boosted("SELECT CASE WHEN c.lim <= r.lim THEN 'L' ELSE 'R' END AS place, d.code, d.event, d.lim, d.g, d.h FROM dense d JOIN dense c USING (patient_id, year) JOIN root r ON c.code = r.code")
ORACLE_SQL["boosted_splits"] = sql(
    "SELECT CAST(0 AS INTEGER) AS round, place, event, CAST(lim AS DOUBLE) AS limit, round(gain, 6) AS gain, CAST(na AS BIGINT) AS n FROM (SELECT * FROM root UNION ALL SELECT * FROM (SELECT * FROM children ORDER BY gain DESC, place LIMIT 1))", "freq"
).replace("\nSELECT CAST(0", ",\n" + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in BOOSTED.items()) + "\nSELECT CAST(0", 1)
