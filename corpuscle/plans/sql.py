"""The SQL that the queries' results are held against, in DuckDB's dialect, written on its own."""

from __future__ import annotations

from corpuscle.functions.text import ARTIFACTS, BLANKS, DIGIT, MONEY, PHONE, PROMO, URL, WORD

#: Where a template takes the name of its rows.
ROWS = "{rows}"
MSG = "msg AS (SELECT id, min(split) AS split, min(text) AS text, min(lower(trim(label))) AS label, min(uci_row_number) AS uci_row_number FROM canonical_sms WHERE id IS NOT NULL GROUP BY id)"
SPLIT = f"{MSG}, sp AS (SELECT * FROM msg WHERE split IN ('train', 'heldout'))"
PRED = "pred AS (SELECT id, min(split) AS split, min(uci_row_number) AS uci_row_number, min(lower(trim(label))) AS label, min(text) AS text, min(word_p_spam) AS word_p_spam, min(word_pred) AS word_pred, min(char_p_spam) AS char_p_spam, min(char_pred) AS char_pred FROM heldout_predictions WHERE id IS NOT NULL GROUP BY id)"
FLAT = lambda t: f"trim(regexp_replace(coalesce({t}, ''), '{BLANKS}+', ' ', 'g'))"
NORM = lambda t: FLAT(f"replace(lower({t}), 'ς', 'σ')")
COUNT = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
AMONG = lambda t, words: f"len(list_filter(regexp_extract_all(lower({t}), '{WORD}'), lambda x: x IN ({_IN(words)})))"

FEAT = f"""t AS (SELECT *, coalesce(text, '') AS x, greatest(coalesce(max(uci_row_number) OVER (), 1), 1) AS last_row FROM {{rows}}),
feat AS (SELECT id, split, label,
  length(x) AS char_count, {COUNT('x', WORD)} AS token_count,
  CASE WHEN {COUNT('x', WORD)} > 0 THEN list_sum(list_transform(regexp_extract_all(x, '{WORD}'), lambda w: length(w))) / {COUNT('x', WORD)}::DOUBLE ELSE 0 END AS avg_token_length,
  {COUNT('x', DIGIT)} AS digit_count,
  CASE WHEN length(x) > 0 THEN {COUNT('x', DIGIT)} / length(x)::DOUBLE ELSE 0 END AS digit_ratio,
  CASE WHEN {COUNT('x', '[[:alpha:]]|' + r'\p{L}')} > 0 THEN {COUNT('x', r'\p{Lu}')} / {COUNT('x', r'\p{L}')}::DOUBLE ELSE 0 END AS uppercase_ratio,
  {COUNT('x', '!')} AS exclamation_count, {COUNT('x', '[$£€]')} + {AMONG('x', MONEY)} AS currency_count,
  CAST(regexp_matches(x, '{URL}') AS BIGINT) AS has_url, CAST(regexp_matches(x, '{PHONE}') AS BIGINT) AS has_phone,
  {AMONG('x', PROMO)} AS promo_token_count, uci_row_number / last_row::DOUBLE AS row_position FROM t),
f AS (SELECT *, CAST(currency_count > 0 AS BIGINT) AS has_currency, CAST(promo_token_count > 0 AS BIGINT) AS has_promo, CAST(char_count > 160 AS BIGINT) AS over_160_chars FROM feat)"""
KNOWN = f"WITH {SPLIT}, k AS (SELECT * FROM sp WHERE label IN ('ham', 'spam')), {FEAT.replace(ROWS, 'k')}"
KEY = "concat(least(id_a, id_b), '|', greatest(id_a, id_b))"
PAIRS = "np AS (SELECT * REPLACE (lower(trim(label_a)) AS label_a, lower(trim(label_b)) AS label_b) FROM near_pairs)"
DECIDED = f"""{PAIRS}, d0 AS (SELECT array_to_string(list_sort(list_transform(string_split(upper(trim(pair_key)), '|'), lambda x: trim(x))), '|') AS key, review_decision, review_category, confidence FROM near_decisions WHERE pair_key IS NOT NULL),
d1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY review_decision NULLS FIRST, review_category NULLS FIRST, confidence NULLS FIRST) AS r FROM d0),
adj AS (SELECT np.*, {KEY} AS key, coalesce(d1.review_decision, 'needs_review') AS review_decision, d1.review_category, d1.confidence FROM np LEFT JOIN d1 ON d1.key = {KEY} AND r = 1)"""
CLUSTERS = f"""keyed AS (SELECT *, {NORM('text')} AS norm FROM {{rows}} WHERE text IS NOT NULL),
cl AS (SELECT norm, min(id) AS representative_id, count(*) AS cluster_size, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'heldout') AS heldout_count,
  count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'heldout') > 0 AS cross_split, coalesce(min(label) <> max(label), false) AS label_conflict FROM keyed GROUP BY norm HAVING count(*) > 1)"""
EXACT = f"WITH {MSG}, {CLUSTERS.replace(ROWS, 'msg')}"
LEAKED = "lk AS (SELECT upper(trim(heldout_id)) AS id, max(coalesce(contains(leakage_type, 'exact'), false)) AS exact, max(coalesce(contains(leakage_type, 'near'), false)) AS near FROM leakage_heldout_rows WHERE heldout_id IS NOT NULL GROUP BY 1)"
MODELS = "{cols}, unnest([{{'model': 'word', 'pred': lower(trim(word_pred)), 'p': word_p_spam}}, {{'model': 'char', 'pred': lower(trim(char_pred)), 'p': char_p_spam}}]) AS m FROM {rows}"


def _scores(rows: str, *keys: str) -> str:
    """Scores of the CTE ``rows`` (keys, label, pred)."""
    k = ", ".join(keys)
    return f"""c AS (SELECT {k}, count(*) FILTER (label = 'spam' AND pred = 'spam') AS tp, count(*) FILTER (label = 'ham' AND pred = 'spam') AS fp, count(*) FILTER (label = 'spam' AND pred = 'ham') AS fn, count(*) FILTER (label = 'ham' AND pred = 'ham') AS tn
FROM {rows} WHERE label IN ('ham', 'spam') AND pred IN ('ham', 'spam') GROUP BY ALL)
SELECT {k}, tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS spam_precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS spam_recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS spam_f1,
round(((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END) + (CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn)::DOUBLE ELSE 0 END)) / 2, 6) AS macro_f1, tp, fp, fn, tn FROM c"""


_METRICS = ("has_url", "has_phone", "has_currency", "has_promo", "over_160_chars")
_FEATURES = ("char_count", "token_count", "avg_token_length", "digit_count", "digit_ratio", "uppercase_ratio", "exclamation_count", "currency_count", "has_url", "has_phone", "promo_token_count", "row_position")
_SHARES = "list_value(0.88, 0.90, 0.92, 0.94, 0.96)"
_WORDS = lambda t: f"list_distinct(list_filter(string_split(lower({FLAT(t)}), ' '), lambda w: w <> ''))"

LEAKS = f"""WITH {MSG}, {DECIDED}, cases AS (SELECT pair_id, CASE WHEN split_a = 'heldout' THEN id_a ELSE id_b END AS heldout_id, CASE WHEN split_a = 'heldout' THEN id_b ELSE id_a END AS train_id,
CASE WHEN split_a = 'heldout' THEN label_a ELSE label_b END AS heldout_label, CASE WHEN split_a = 'heldout' THEN label_b ELSE label_a END AS train_label, coalesce(label_a <> label_b, false) AS label_conflict,
round(max_cosine, 6) AS max_cosine, review_category, confidence FROM adj WHERE review_decision = 'accepted' AND ((split_a = 'heldout' AND split_b = 'train') OR (split_a = 'train' AND split_b = 'heldout')))"""
NEIGHBOURS = f"""{PRED}, kp AS (SELECT * FROM pred WHERE label IN ('ham', 'spam') AND word_p_spam IS NOT NULL AND char_p_spam IS NOT NULL), {PAIRS},
ln AS (SELECT id_a AS id, id_b AS partner, label_b AS partner_label, max_cosine AS s, text_a, text_b FROM np UNION ALL SELECT id_b, id_a, label_a, max_cosine, text_a, text_b FROM np),
l1 AS (SELECT id, partner, max(s) AS s, min(partner_label) AS partner_label FROM ln WHERE s IS NOT NULL AND id <> partner AND {NORM('text_a')} <> {NORM('text_b')} GROUP BY ALL),
l5 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, partner) <= 5),
nb AS (SELECT l5.id, count(*) AS neighbour_count, coalesce(sum(CASE WHEN partner_label <> label THEN greatest(s, 0.0) ELSE 0 END) / nullif(sum(greatest(s, 0.0)), 0), 0) AS opposite_fraction, coalesce(max(CASE WHEN partner_label <> label THEN s END), 0) AS closest_similarity FROM l5 JOIN kp ON kp.id = l5.id GROUP BY l5.id),
e0 AS (SELECT kp.*, coalesce(neighbour_count, 0) AS neighbour_count, coalesce(opposite_fraction, 0) AS opposite_fraction, coalesce(closest_similarity, 0) AS closest_similarity, (word_p_spam + char_p_spam) / 2 AS mean_p FROM kp LEFT JOIN nb ON nb.id = kp.id),
ev AS (SELECT *, CASE WHEN label = 'ham' THEN mean_p ELSE 1 - mean_p END AS strength, CASE WHEN label = 'ham' THEN 'spam' ELSE 'ham' END AS proposed_label,
  CAST(coalesce(word_pred <> label, false) AS BIGINT) + CAST(coalesce(char_pred <> label, false) AS BIGINT) + CAST(opposite_fraction >= 0.6 AND closest_similarity >= 0.3 AS BIGINT) AS signal_count FROM e0)"""
WORDS = r"""list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ς', 'σ'), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2)"""
TFIDF = f"""g AS (SELECT id, w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS two FROM (SELECT id, {WORDS} AS w FROM {{rows}})),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w, two)) AS term FROM g) GROUP BY ALL), n AS (SELECT count(*) AS n FROM {{rows}}),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w0 AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN dfs USING (term), n WHERE df >= 2 AND df <= 0.995 * n),
wt AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0)"""

SQL: dict[str, str] = {
    "normalize_text": f"WITH {MSG} SELECT id, {NORM('text')} AS normalized_text FROM msg",
    "text_sha256": f"WITH {MSG} SELECT id, sha256(coalesce(text, '')) AS sha256 FROM msg",
    "shallow_features": f"WITH {MSG}, {FEAT.replace(ROWS, 'msg')} SELECT id, {', '.join(f'round({c}, 6) AS {c}' if c in ('avg_token_length', 'digit_ratio', 'uppercase_ratio', 'row_position') else c for c in _FEATURES)}, has_currency, has_promo, over_160_chars FROM f",
    "mask_promo": f"WITH {MSG} SELECT id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}|[^{WORD[1:-2]}]+'), lambda x: CASE WHEN lower(x) IN ({_IN(PROMO)}) THEN ' PROMO_TOKEN ' ELSE x END), '') AS masked FROM msg",
    "dataset_validation": """SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'heldout') AS heldout_rows, count(*) FILTER (split IS NULL) AS null_splits,
count(*) FILTER (uci_row_number IS NULL) AS null_row_numbers, count(DISTINCT uci_row_number) AS n_row_numbers, count(*) FILTER (lower(trim(label)) IN ('ham', 'spam')) AS known_labels, count(*) FILTER (label IS NULL) AS null_labels,
count(*) FILTER (text IS NULL) AS null_texts, count(*) FILTER (trim(text) = '') AS empty_texts, count(*) FILTER (NOT coalesce(regexp_matches(id, '^[THU][0-9]+$'), false)) AS odd_ids FROM canonical_sms""",
    "artifact_summary": f"WITH {MSG}, h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS artifact_type, id, regexp_matches(coalesce(text, ''), '{p}') AS hit FROM msg" for k, p in ARTIFACTS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY artifact_type, hit ORDER BY id) AS place FROM h) SELECT artifact_type, count(*) FILTER (hit) AS n, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate, coalesce(string_agg(CASE WHEN hit AND place <= 5 THEN id END, '|' ORDER BY id), '') AS example_ids FROM r GROUP BY artifact_type",
    "profile_summary": f"{KNOWN}, e AS (SELECT unnest(['all', split]) AS split, * EXCLUDE (split) FROM f), e2 AS (SELECT unnest(['all', label]) AS label, * EXCLUDE (label) FROM e), s AS (SELECT split, label, count(*) AS n, quantile_cont(char_count, 0.5) AS char_median, quantile_cont(char_count, 0.25) AS char_q1, quantile_cont(char_count, 0.75) AS char_q3, quantile_cont(token_count, 0.5) AS token_median, quantile_cont(digit_count, 0.5) AS digit_median, {', '.join(f'round(avg({c}), 6) AS {c}_rate' for c in _METRICS)}, round(avg(promo_token_count), 6) AS promo_token_mean FROM e2 GROUP BY ALL) SELECT *, round(n / max(n) OVER (PARTITION BY split)::DOUBLE, 6) AS class_fraction FROM s",
    "split_comparison": f"{KNOWN}, e AS (SELECT unnest(['all', label]) AS label, label AS own, * EXCLUDE (label) FROM f), s AS (SELECT label, split, avg(CASE WHEN own = 'spam' THEN 1.0 ELSE 0.0 END)::DOUBLE AS spam_share, quantile_cont(char_count, 0.5)::DOUBLE AS char_median, quantile_cont(token_count, 0.5)::DOUBLE AS token_median, {', '.join(f'avg({c})::DOUBLE AS {c}_rate' for c in _METRICS)} FROM e GROUP BY ALL), u AS (UNPIVOT s ON COLUMNS(* EXCLUDE (label, split)) INTO NAME metric VALUE v) SELECT label, metric, round(max(v) FILTER (split = 'train'), 6) AS train, round(max(v) FILTER (split = 'heldout'), 6) AS heldout, round(max(v) FILTER (split = 'heldout') - max(v) FILTER (split = 'train'), 6) AS difference FROM u GROUP BY ALL",
    "row_position_bins": f"WITH {SPLIT}, e AS (SELECT *, min(uci_row_number) OVER () AS lo, max(uci_row_number) OVER () AS hi FROM sp WHERE uci_row_number IS NOT NULL) SELECT CAST(greatest(least(ceil((uci_row_number - lo) * 10 / greatest(hi - lo, 1)::DOUBLE), 10), 1) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN label = 'spam' THEN 1.0 ELSE 0.0 END), 6) AS spam_rate FROM e GROUP BY 1",
    "length_histogram": f"WITH {SPLIT} SELECT label, CAST(floor(least(length(coalesce(text, '')), 250) / 10) * 10 AS BIGINT) AS bin, count(*) AS n FROM sp GROUP BY ALL",
    "label_crosstab": f"WITH {SPLIT} SELECT split, count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'spam') AS spam, count(*) FILTER (label IS NULL OR label NOT IN ('ham', 'spam')) AS other FROM sp GROUP BY split",
    "mean_features": f"{KNOWN} SELECT label, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _METRICS[:4])} FROM f GROUP BY label",
    "exact_duplicate_clusters": f"{EXACT} SELECT * EXCLUDE (norm) FROM cl",
    "exact_duplicate_members": f"{EXACT} SELECT representative_id, id, split, label FROM keyed JOIN cl USING (norm)",
    "cluster_size_counts": f"{EXACT} SELECT cluster_size, count(*) AS n_clusters FROM cl GROUP BY 1",
    "exact_leakage_cases": f"WITH {SPLIT}, {CLUSTERS.replace(ROWS, 'sp')} SELECT h.id AS heldout_id, cl.representative_id, count(*) AS n_train_partners, min(t.id) AS first_train_id FROM keyed h JOIN keyed t ON h.norm = t.norm AND h.split = 'heldout' AND t.split = 'train' JOIN cl ON cl.norm = h.norm GROUP BY ALL",
    "duplicate_overview": f"{EXACT}, u(metric, value) AS (SELECT 'total_rows', (SELECT count(*) FROM msg) UNION ALL SELECT 'normalized_unique_texts', (SELECT count(DISTINCT norm) FROM keyed) UNION ALL SELECT 'exact_duplicate_clusters', (SELECT count(*) FROM cl) UNION ALL SELECT 'rows_in_exact_duplicate_clusters', (SELECT coalesce(sum(cluster_size), 0) FROM cl) UNION ALL SELECT 'repeated_rows_beyond_first', (SELECT coalesce(sum(cluster_size - 1), 0) FROM cl) UNION ALL SELECT 'cross_split_exact_clusters', (SELECT count(*) FILTER (cross_split) FROM cl) UNION ALL SELECT 'label_conflict_exact_clusters', (SELECT count(*) FILTER (label_conflict) FROM cl) UNION ALL SELECT 'largest_exact_cluster_size', (SELECT coalesce(max(cluster_size), 0) FROM cl)) SELECT metric, CAST(value AS BIGINT) AS value FROM u",
    "near_pair_reason_codes": f"WITH {PAIRS}, o AS (SELECT *, {_WORDS('text_a')} AS wa, {_WORDS('text_b')} AS wb FROM np), j AS (SELECT *, len(list_intersect(wa, wb)) / greatest(len(list_distinct(list_concat(wa, wb))), 1)::DOUBLE AS ov, greatest(length(coalesce(text_a, '')), length(coalesce(text_b, ''))) AS longest FROM o) SELECT pair_id, {KEY} AS key, round(ov, 6) AS overlap, CASE WHEN longest <= 40 THEN 'generic_short_text_review_needed' WHEN word_cosine >= 0.98 AND char_cosine < 0.94 THEN 'same_words_possible_entity_or_number_change' WHEN char_cosine >= 0.98 AND word_cosine < 0.94 THEN 'same_character_template_minor_format_change' WHEN word_cosine >= 0.96 AND char_cosine >= 0.96 THEN 'very_high_similarity_template_review_needed' WHEN ov >= 0.75 THEN 'high_token_overlap_review_needed' ELSE 'threshold_candidate_review_needed' END AS reason FROM j",
    "near_pairs_sensitivity": f"WITH {PAIRS}, th AS (SELECT unnest({_SHARES})::DOUBLE AS threshold), j AS (SELECT threshold, np.* FROM np JOIN th ON max_cosine >= threshold), i AS (SELECT threshold, count(DISTINCT h) AS unique_heldout_ids FROM (SELECT threshold, id_a AS h FROM j WHERE cross_split AND split_a = 'heldout' UNION ALL SELECT threshold, id_b FROM j WHERE cross_split AND split_b = 'heldout') GROUP BY 1), s AS (SELECT threshold, count(*) AS candidate_pairs, count(*) FILTER (cross_split) AS cross_split_pairs, count(*) FILTER (label_conflict) AS label_conflict_pairs FROM j GROUP BY 1) SELECT s.*, coalesce(unique_heldout_ids, 0) AS unique_heldout_ids, round(candidate_pairs / max(candidate_pairs) OVER ()::DOUBLE, 6) AS retention FROM s LEFT JOIN i USING (threshold)",
    "review_queue": f"SELECT pair_id, {KEY} AS key, round(max_cosine, 6) AS max_cosine, cross_split FROM near_pairs WHERE max_cosine >= 0.92 AND NOT coalesce(split_a = 'heldout' AND split_b = 'heldout', false)",
    "adjudicated_queue": f"WITH {DECIDED} SELECT pair_id, key, review_decision, review_category, confidence FROM adj",
    "review_summary": f"WITH {DECIDED}, i AS (SELECT review_decision, count(DISTINCT h) AS u FROM (SELECT review_decision, id_a AS h FROM adj WHERE split_a = 'heldout' UNION ALL SELECT review_decision, id_b FROM adj WHERE split_b = 'heldout') GROUP BY 1), s AS (SELECT review_decision, count(*) AS pairs, count(*) FILTER (cross_split) AS cross_split_pairs, count(*) FILTER (split_a = 'train' AND split_b = 'train') AS train_train_pairs, count(*) FILTER (label_a = 'spam' AND label_b = 'spam') AS spam_pairs, count(*) FILTER (label_a = 'ham' AND label_b = 'ham') AS ham_pairs FROM adj GROUP BY 1) SELECT s.*, coalesce(u, 0) AS unique_heldout_ids FROM s LEFT JOIN i USING (review_decision)",
    "review_counters": f"WITH {DECIDED} SELECT 'decision' AS counter, review_decision AS value, count(*) AS n FROM adj GROUP BY ALL UNION ALL SELECT 'category', coalesce(review_category, ''), count(*) FROM adj GROUP BY ALL UNION ALL SELECT 'splits', coalesce(split_a, 'none') || '-' || coalesce(split_b, 'none'), count(*) FROM adj GROUP BY ALL",
    "sample_duplicate_rollup": f"WITH {MSG}, {CLUSTERS.replace(ROWS, 'msg')}, {DECIDED}, ex AS (SELECT keyed.id, representative_id, cluster_size FROM keyed JOIN cl USING (norm)), w AS (SELECT id_a AS id, id_b AS partner, * FROM adj WHERE review_decision = 'accepted' UNION ALL SELECT id_b, id_a, * FROM adj WHERE review_decision = 'accepted'), nr AS (SELECT id, count(DISTINCT pair_id) AS np, count(DISTINCT partner) AS npt, count(DISTINCT CASE WHEN cross_split THEN pair_id END) AS nc, round(max(max_cosine), 6) AS ms FROM w GROUP BY id), al AS (SELECT coalesce(ex.id, nr.id) AS id, ex.* EXCLUDE (id), nr.* EXCLUDE (id) FROM ex FULL JOIN nr ON ex.id = nr.id) SELECT al.id, split, label, CASE WHEN representative_id IS NOT NULL AND np IS NOT NULL THEN 'exact_and_near_reviewed_accepted' WHEN representative_id IS NOT NULL THEN 'exact' ELSE 'near_reviewed_accepted' END AS duplicate_type, representative_id AS exact_class, coalesce(cluster_size, 0) AS class_members, coalesce(np, 0) AS n_near_pairs, coalesce(npt, 0) AS n_near_partners, coalesce(nc, 0) AS n_cross_near_pairs, ms AS max_near_similarity FROM al LEFT JOIN msg ON msg.id = al.id",
    "near_leakage_cases": f"{LEAKS} SELECT 'L_NEAR_' || pair_id AS case_id, * EXCLUDE (pair_id) FROM cases",
    "heldout_leakage_rollup": f"{LEAKS}, sp AS (SELECT * FROM msg WHERE split IN ('train', 'heldout')), {CLUSTERS.replace(ROWS, 'sp')}, {PRED}, ex AS (SELECT h.id, count(*) AS ne FROM keyed h JOIN keyed t ON h.norm = t.norm AND h.split = 'heldout' AND t.split = 'train' GROUP BY 1), nr AS (SELECT heldout_id AS id, count(DISTINCT train_id) AS nn, string_agg(DISTINCT pair_id, '|' ORDER BY pair_id) AS ps, string_agg(DISTINCT review_category, '|' ORDER BY review_category) AS cs, max(CASE WHEN lower(confidence) = 'high' THEN 1 ELSE 0 END) AS sure, max(max_cosine) AS mx FROM cases GROUP BY 1), al AS (SELECT coalesce(ex.id, nr.id) AS id, ne, nn, ps, cs, sure, mx FROM ex FULL JOIN nr ON ex.id = nr.id) SELECT al.id AS heldout_id, CASE WHEN ne IS NOT NULL AND nn IS NOT NULL THEN 'exact_and_near_reviewed_accepted' WHEN ne IS NOT NULL THEN 'exact' ELSE 'near_reviewed_accepted' END AS leakage_type, CASE WHEN ne IS NOT NULL THEN 'high' WHEN sure = 1 THEN 'medium_high' ELSE 'medium' END AS severity, coalesce(ne, 0) AS n_exact_train_partners, coalesce(nn, 0) AS n_near_train_partners, coalesce(ps, '') AS near_pair_ids, coalesce(cs, '') AS review_categories, CASE WHEN ne IS NOT NULL THEN 1.0 ELSE mx END AS max_similarity, word_pred, char_pred FROM al LEFT JOIN pred ON pred.id = al.id",
    "leakage_top_examples": f"{LEAKS} SELECT review_category, 'L_NEAR_' || pair_id AS case_id, heldout_id, train_id, max_cosine FROM cases WHERE review_category IS NOT NULL AND max_cosine IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_category ORDER BY max_cosine DESC, heldout_id, train_id, pair_id) = 1",
    "leakage_summary": """SELECT "by", value, count(DISTINCT id) AS n_ids FROM (SELECT upper(trim(heldout_id)) AS id, 'leakage_type' AS "by", leakage_type AS value FROM leakage_heldout_rows UNION ALL SELECT upper(trim(heldout_id)), 'severity', severity FROM leakage_heldout_rows UNION ALL SELECT upper(trim(heldout_id)), 'label', lower(trim(label)) FROM leakage_heldout_rows) GROUP BY ALL""",
    "leakage_partner_counts": r"WITH x AS (SELECT upper(trim(heldout_id)) AS heldout_id, n_total_train_partners AS n, unnest(CASE WHEN len(list_filter(regexp_extract_all(upper(coalesce(train_partner_ids, '')), '[\p{L}\p{N}]+'), lambda y: true)) > 0 THEN regexp_extract_all(upper(train_partner_ids), '[\p{L}\p{N}]+') ELSE [NULL] END) AS t, near_pair_ids FROM leakage_heldout_rows), a AS (SELECT heldout_id, count(DISTINCT t) AS nt, max(n) AS st FROM x GROUP BY 1), y AS (SELECT upper(trim(heldout_id)) AS heldout_id, unnest(regexp_extract_all(upper(coalesce(near_pair_ids, '')), '[\p{L}\p{N}]+')) AS p FROM leakage_heldout_rows), b AS (SELECT heldout_id, count(DISTINCT p) AS pn FROM y GROUP BY 1) SELECT a.heldout_id, nt AS n_listed_partners, coalesce(pn, 0) AS n_listed_pairs, st AS n_stated, coalesce(nt = st, false) AS agrees FROM a LEFT JOIN b ON a.heldout_id IS NOT DISTINCT FROM b.heldout_id",
    "classification_metrics": f"WITH {PRED}, r AS (SELECT label, m.model AS model, m.pred AS pred FROM (SELECT {MODELS.format(cols='label', rows='pred')})), {_scores('r', 'model')}",
    "threshold_agreement": f"WITH {PRED}, r AS (SELECT m.model AS model, m.pred AS pred, m.p AS p FROM (SELECT {MODELS.format(cols='label', rows='pred')})) SELECT model, count(*) AS n, count(*) FILTER ((p >= 0.5) = (pred = 'spam')) AS n_agree FROM r WHERE p IS NOT NULL AND pred IS NOT NULL GROUP BY model",
    "leakage_metric_sensitivity": f"WITH {PRED}, {LEAKED}, j AS (SELECT pred.*, coalesce(exact, false) AS exact, coalesce(near, false) AS near FROM pred LEFT JOIN lk ON lk.id = pred.id), k AS (SELECT 'original_heldout' AS condition, * FROM j UNION ALL SELECT 'exclude_exact_leakage', * FROM j WHERE NOT exact UNION ALL SELECT 'exclude_exact_and_reviewed_near_leakage', * FROM j WHERE NOT (exact OR near)), r AS (SELECT condition, label, m.model AS model, m.pred AS pred FROM (SELECT {MODELS.format(cols='condition, label', rows='k')})), {_scores('r', 'condition', 'model')}",
    "leakage_aware_eval": f"WITH {PRED}, {LEAKED}, j AS (SELECT pred.*, CASE WHEN lk.id IS NULL THEN 'clean' ELSE 'leaked' END AS side FROM pred LEFT JOIN lk ON lk.id = pred.id), r AS (SELECT side, label, m.model AS model, m.pred AS pred FROM (SELECT {MODELS.format(cols='side, label', rows='j')})) SELECT model, side, count(*) AS n, count(*) FILTER (label = pred) AS n_correct, round(count(*) FILTER (label = pred) / count(*)::DOUBLE, 6) AS accuracy FROM r WHERE label IS NOT NULL AND pred IS NOT NULL GROUP BY ALL",
    "majority_baseline": f"WITH {SPLIT}, k AS (SELECT * FROM sp WHERE label IN ('ham', 'spam')), mode AS (SELECT label AS pred FROM k WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), r AS (SELECT pred, label FROM k, mode WHERE split = 'heldout'), {_scores('r', 'pred')}",
    "prediction_integrity": f"WITH {SPLIT}, {PRED} SELECT count(*) AS n, count(sp.id) AS matched, count(*) FILTER (pred.text IS NOT DISTINCT FROM sp.text) AS same_text, count(*) FILTER (pred.split IS NOT DISTINCT FROM sp.split) AS same_split, count(*) FILTER (pred.label IS NOT DISTINCT FROM sp.label) AS same_label FROM pred LEFT JOIN sp ON sp.id = pred.id",
    "knn_label_evidence": f"WITH {NEIGHBOURS} SELECT id, label, neighbour_count, round(opposite_fraction, 6) AS opposite_fraction, round(closest_similarity, 6) AS closest_similarity, signal_count, round(strength, 6) AS strength FROM ev",
    "label_error_candidates": f"WITH {NEIGHBOURS} SELECT id, label, proposed_label, signal_count, round(strength + 0.2 * signal_count + 0.2 * opposite_fraction, 6) AS candidate_score FROM ev WHERE signal_count >= 2",
    "label_error_watchlist": f"WITH {NEIGHBOURS} SELECT id, label, round(strength, 6) AS strength FROM ev WHERE signal_count = 1 AND strength >= 0.6",
    "ambiguity_candidates": f"WITH {NEIGHBOURS}, a AS (SELECT *, coalesce(word_pred <> char_pred, false) AS disagreement, abs(mean_p - 0.5) AS bd, 1 - least(abs(opposite_fraction - 0.5) * 2, 1.0) AS mx FROM ev) SELECT id, label, disagreement, round(bd, 6) AS boundary_distance, round(mx, 6) AS mixedness, round(greatest(1 - 2 * bd, 0.0) + 0.4 * CAST(disagreement AS INT) + 0.4 * mx, 6) AS score FROM a WHERE disagreement OR bd <= 0.18 OR mx >= 0.7",
    "shortcut_review_queue": f"WITH {PRED}, k AS (SELECT * FROM pred WHERE word_p_spam IS NOT NULL AND char_p_spam IS NOT NULL), q AS (SELECT id, CASE WHEN label = 'ham' AND char_pred = 'spam' AND word_pred = 'ham' THEN 'shallow_false_positive' WHEN label = 'spam' AND char_pred = 'ham' AND word_pred = 'spam' THEN 'shallow_false_negative' WHEN label = 'spam' AND char_pred = 'spam' AND word_pred = 'ham' THEN 'shallow_rescues_full_text_miss' WHEN label = 'spam' AND char_pred = 'ham' AND word_pred = 'ham' THEN 'both_models_miss_spam' END AS reason, char_p_spam - word_p_spam AS gap, 1 - greatest(char_p_spam, word_p_spam) AS miss FROM k), p AS (SELECT id, reason, round(CASE reason WHEN 'shallow_false_negative' THEN -gap WHEN 'both_models_miss_spam' THEN miss ELSE gap END, 6) AS priority FROM q WHERE reason IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY reason ORDER BY priority DESC, id) AS place FROM p QUALIFY place <= 15",
    "training_partner_removal": r"WITH " + SPLIT + r", nm AS (SELECT DISTINCT unnest(regexp_extract_all(upper(coalesce(train_partner_ids, '')), '[\p{L}\p{N}]+')) AS id FROM leakage_heldout_rows) SELECT id, uci_row_number FROM sp WHERE split = 'train' AND id LIKE 'T%' AND id IN (SELECT id FROM nm) ORDER BY uci_row_number NULLS LAST, id LIMIT 30",
    "exclude_leaked_heldout": f"WITH {SPLIT}, {LEAKED} SELECT label, count(*) AS n, count(*) FILTER (lk.id IS NULL) AS n_kept FROM sp LEFT JOIN lk ON lk.id = sp.id WHERE split = 'heldout' GROUP BY label",
    "dedup_keep_first": f"WITH {SPLIT}, tr AS (SELECT *, {NORM('text')} AS norm FROM sp WHERE split = 'train' AND text IS NOT NULL), k AS (SELECT id, first_value(id) OVER (PARTITION BY norm ORDER BY uci_row_number NULLS LAST, id) AS keep_id FROM tr) SELECT * FROM k WHERE id <> keep_id",
    "overlay_effect": f"WITH {SPLIT}, {NEIGHBOURS}, c AS (SELECT id, proposed_label FROM ev WHERE signal_count >= 2) SELECT sp.label AS label, coalesce(proposed_label, sp.label) AS new_label, count(*) AS n FROM sp LEFT JOIN c ON c.id = sp.id WHERE split = 'heldout' GROUP BY ALL",
    "word_tfidf_weights": f"WITH {MSG}, d AS (SELECT * FROM msg WHERE text IS NOT NULL), {TFIDF.replace(ROWS, 'd')} SELECT id, term, round(weight, 6) AS weight FROM wt",
    "near_pairs_word": f"WITH {MSG}, d AS (SELECT min(id) AS id, arg_min(text, id) AS text FROM msg WHERE text IS NOT NULL GROUP BY {NORM('text')}), {TFIDF.replace(ROWS, 'd')}, c AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.weight * b.weight) AS cosine FROM wt a JOIN wt b ON a.term = b.term AND a.id < b.id GROUP BY ALL) SELECT id_a, id_b, round(cosine, 4) AS cosine FROM c WHERE cosine >= 0.88",
}
_UNION = ", ".join(f"{{'feature': '{c}', 'value': {c}::DOUBLE}}" for c in _FEATURES)
SQL["feature_prevalence"] = f"{KNOWN}, l AS (SELECT split, label, unnest([{_UNION}]) AS x FROM f), v AS (SELECT split, label, x.feature AS feature, x.value AS value FROM l) SELECT split, label, feature, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_rate FROM v GROUP BY ALL"
SQL["feature_prevalence_pivot"] = f"WITH p AS ({SQL['feature_prevalence']}) SELECT feature, max(nonzero_rate) FILTER (label = 'ham') AS ham, max(nonzero_rate) FILTER (label = 'spam') AS spam FROM p WHERE split = 'heldout' GROUP BY feature"
