"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpuscle.llm import copies, cut, encoding, groups, mix, near, overlap, pii, splits, tokens

QUERIES = {
    "p1_found": near.p1_found,
    "p1_groups": near.p1_groups,
    "p2_found": splits.p2_found,
    "p2_assigned": splits.p2_assigned,
    "p2_shares": splits.p2_shares,
    "p3_found": copies.p3_found,
    "p3_collapsed": copies.p3_collapsed,
    "p4_found": encoding.p4_found,
    "p4_restored": encoding.p4_restored,
    "p5_found": pii.p5_found,
    "p5_masked": pii.p5_masked,
    "p5_surrogates": pii.p5_surrogates,
    "p6_found": overlap.p6_found,
    "p6_report": overlap.p6_report,
    "p7_found": groups.p7_found,
    "p7_group_sizes": groups.p7_group_sizes,
    "p8_ids": tokens.p8_ids,
    "p9_mix": mix.p9_mix,
    "p9_shares": mix.p9_shares,
    "p10_pieces": cut.p10_pieces,
}

_TIDY = r"upper(regexp_replace({c}, '^[\s\x{{a0}}\x{{200b}}]+|[\s\x{{a0}}\x{{200b}}]+$', '', 'g'))"
_LIST = r"unnest(regexp_extract_all(upper(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+'))"
_LINKS = f"""WITH RECURSIVE t AS (SELECT {_TIDY.format(c='heldout_id')} AS a, {_LIST.format(c='train_partner_ids')} AS b FROM leakage_heldout_rows), nm AS (SELECT DISTINCT {_LIST.format(c='near_pair_ids')} AS p FROM leakage_heldout_rows),
l AS (SELECT a, b FROM t WHERE a <> '' UNION SELECT {_TIDY.format(c='id_a')}, {_TIDY.format(c='id_b')} FROM near_pairs WHERE {_TIDY.format(c='pair_id')} IN (SELECT p FROM nm)),
e AS (SELECT a, b FROM l WHERE a <> '' AND b <> '' UNION SELECT b, a FROM l WHERE a <> '' AND b <> '' UNION SELECT a, a FROM l WHERE a <> '' AND b <> '' UNION SELECT b, b FROM l WHERE a <> '' AND b <> ''),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS id, min(b) AS group_id FROM r GROUP BY a)"""

SQL: dict[str, str] = {
    "p7_found": f"{_LINKS} SELECT id, group_id FROM g",
    "p7_group_sizes": f"{_LINKS}, s AS (SELECT count(*) AS members FROM g GROUP BY group_id) SELECT members, count(*) AS n_groups FROM s GROUP BY members",
}
