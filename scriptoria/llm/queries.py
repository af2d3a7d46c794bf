"""Queries on training data and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

import importlib

#: Module of each problem's queries; every function p<N>_... in it is one.
MODULES = ("set_pairs", "distinctive", "term_counts", "cooccurrence", "print_forms", "vector_clusters", "vector_neighbours", "token_ids", "leaks", "text_quality")


def queries() -> dict:
    found = {}
    for m in MODULES:
        module = importlib.import_module(f"scriptoria.llm.{m}")
        found |= {k: f for k, f in vars(module).items() if k[0] == "p" and k[1:].split("_")[0].isdigit() and callable(f)}
    return dict(sorted(found.items()))


_LEMMAS = """
    occ AS (SELECT row_id, trim(regexp_replace(strip_accents(lower(u)), '[\\p{Z}\\t\\n\\r]+', ' ', 'g')) AS item
            FROM (SELECT row_id, unnest(lemmas) AS u FROM concept_layer) WHERE u IS NOT NULL),
    lem AS (SELECT row_id, item FROM occ WHERE item <> ''),
    tot AS (SELECT count(*) AS n FROM concept_layer)"""
_PERSONS = r"""
    per AS (SELECT row_id, item FROM (
              SELECT row_id, regexp_replace(regexp_replace(u, '^[\p{Z}\t\n\r]*#*[\p{Z}\t\n\r]*', ''), '[\p{Z}\t\n\r]+$', '') AS item
              FROM (SELECT row_id, unnest(persons) AS u FROM (SELECT DISTINCT row_id, persons FROM paragraphs)) WHERE u IS NOT NULL)
            WHERE item <> '')"""
_BOTH = f"""{_LEMMAS}, {_PERSONS},
    both_ AS (SELECT 'lemmas' AS field, row_id, item FROM lem UNION ALL SELECT 'persons', row_id, item FROM per),
    counts AS (SELECT field, item, count(*) AS uses, count(DISTINCT row_id) AS records FROM both_ GROUP BY ALL)"""

_VECTORS = """
    vec AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM (SELECT vec_id, embeddings::DOUBLE[] AS e FROM para_vectors WHERE len(embeddings) = 64)
            WHERE NOT list_contains(list_transform(e, lambda v: isnan(v)), true) AND list_dot_product(e, e) > 0)"""
_STATS = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\p{Z}\t\n\r]+'), lambda x: x <> '') AS w,
      list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\p{Z}\t\n\r]+$', '')), lambda x: x <> '') AS l FROM documents),
    known AS (SELECT doc_id, count(*) AS known FROM (SELECT doc_id, lower(regexp_replace(unnest(w), '^\P{L}+|\P{L}+$', '', 'g')) AS b FROM w) SEMI JOIN (SELECT word AS b FROM function_words) USING (b) GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, length(regexp_replace(text, '[\p{Z}\t\n\r\p{L}\p{M}\p{N}]', '', 'g')) AS odd,
      len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][»”"'')\]]*$'))) AS ends, coalesce(known, 0) AS known FROM w LEFT JOIN known USING (doc_id))"""

SQL = {
    "p10_statistics": _STATS + " SELECT doc_id, n AS word_count, round(chars / nullif(n, 0), 6) AS mean_word_length, round(odd / nullif(chars, 0), 6) AS symbol_ratio, round(ends / nullif(lines, 0), 6) AS line_punctuation, round(known / nullif(n, 0), 6) AS common_words FROM m",
    "p2_found": f"""WITH {_LEMMAS},
    u AS (SELECT row_id, item, count(*) AS uses FROM lem GROUP BY ALL),
    df AS (SELECT item, count(*) AS records FROM u GROUP BY ALL),
    wide AS (SELECT row_id FROM u GROUP BY ALL HAVING count(*) >= 8),
    s AS (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY uses * ln(n::DOUBLE / records) DESC, item) AS rk
          FROM u JOIN df USING (item) SEMI JOIN wide USING (row_id), tot WHERE records >= 2)
    SELECT row_id, item AS lemma FROM s WHERE rk <= 3""",
    "p3_counts": f"WITH {_BOTH} SELECT field, item, uses, records FROM counts",
    "p3_phrases": f"""WITH l AS (SELECT row_id, list_filter(list_transform(coalesce(lemmas, []), lambda u: trim(regexp_replace(strip_accents(lower(u)), '[\\p{{Z}}\\t\\n\\r]+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '') AS a FROM concept_layer)
    SELECT array_to_string(g, ' | ') AS terms, count(*) AS uses, count(DISTINCT row_id) AS records FROM (SELECT row_id, a[k:k + m - 1] AS g FROM (SELECT row_id, a, m, unnest(range(1, len(a) - m + 2)) AS k FROM l, (SELECT unnest([1, 2, 3]) AS m))) GROUP BY g""",
    "p3_found": f"""WITH {_BOTH}
    SELECT field, item, mark FROM (
      SELECT field, item, CASE WHEN records < CASE field WHEN 'lemmas' THEN 10 ELSE 5 END THEN 'rare'
        WHEN records * CASE field WHEN 'lemmas' THEN 10 ELSE 20 END > n THEN 'common' END AS mark FROM counts, tot) WHERE mark IS NOT NULL""",
    "p5_found": f"""WITH {_BOTH},
    d AS (SELECT DISTINCT field, row_id, item FROM both_ JOIN counts USING (field, item) WHERE records >= CASE field WHEN 'lemmas' THEN 10 ELSE 5 END),
    pairs AS (SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM d x JOIN d y ON x.field = y.field AND x.row_id = y.row_id AND x.item < y.item GROUP BY ALL)
    SELECT p.field, item_a, item_b FROM pairs p JOIN counts a ON a.field = p.field AND a.item = item_a JOIN counts b ON b.field = p.field AND b.item = item_b, tot
    WHERE n_ab >= CASE p.field WHEN 'lemmas' THEN 8 ELSE 5 END AND n_ab * n >= 15 * a.records * b.records""",
    "p5_lift": f"""WITH {_BOTH},
    d AS (SELECT DISTINCT field, row_id, item FROM both_ JOIN counts USING (field, item) WHERE records >= CASE field WHEN 'lemmas' THEN 10 ELSE 5 END),
    pairs AS (SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM d x JOIN d y ON x.field = y.field AND x.row_id = y.row_id AND x.item < y.item GROUP BY ALL)
    SELECT p.field, item_a, item_b, a.records AS n_a, b.records AS n_b, n_ab, n_ab * n::DOUBLE / (a.records * b.records) AS lift FROM pairs p JOIN counts a ON a.field = p.field AND a.item = item_a JOIN counts b ON b.field = p.field AND b.item = item_b, tot
    WHERE n_ab >= CASE p.field WHEN 'lemmas' THEN 8 ELSE 5 END AND n_ab * n >= 15 * a.records * b.records""",
    "p1_classes": f"""WITH {_BOTH},
    s AS (SELECT field, row_id, list_sort(list_distinct(list(item))) AS items FROM both_ GROUP BY ALL HAVING count(DISTINCT item) >= CASE field WHEN 'lemmas' THEN 8 ELSE 4 END),
    c AS (SELECT field, items, min(row_id) AS id FROM s GROUP BY ALL),
    e AS (SELECT a.field, a.id AS p, b.id AS q FROM c a JOIN c b ON a.field = b.field AND a.id < b.id AND len(a.items) * 0.7 <= len(b.items) AND len(b.items) * 0.7 <= len(a.items)
      WHERE len(list_intersect(a.items, b.items)) >= CASE a.field WHEN 'lemmas' THEN 0.70 ELSE 0.75 END * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) - 1e-9),
    n AS (SELECT field, id, count(*) AS links FROM (SELECT field, p AS id FROM e UNION ALL SELECT field, q FROM e) GROUP BY ALL)
    SELECT s.field, s.row_id, c.id AS class_id, coalesce(links, 0) AS links FROM s JOIN c USING (field, items) LEFT JOIN n ON n.field = c.field AND n.id = c.id""",
    "p1_found": f"""WITH {_BOTH},
    s AS (SELECT field, row_id, list_sort(list_distinct(list(item))) AS items FROM both_ GROUP BY ALL HAVING count(DISTINCT item) >= CASE field WHEN 'lemmas' THEN 8 ELSE 4 END)
    SELECT a.field, a.row_id AS row_a, b.row_id AS row_b FROM s a JOIN s b ON a.field = b.field AND a.row_id < b.row_id
      AND len(a.items) * 0.7 <= len(b.items) AND len(b.items) * 0.7 <= len(a.items)
    WHERE len(list_intersect(a.items, b.items)) >= CASE a.field WHEN 'lemmas' THEN 0.70 ELSE 0.75 END * (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) - 1e-9""",
    "p4_found": f"""WITH RECURSIVE {_VECTORS},
    links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.85),
    reach(x, low) AS (SELECT vec_id, vec_id FROM vec UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.x WHERE r.low < l.y),
    lab AS (SELECT x AS vec_id, min(low) AS cluster_key FROM reach GROUP BY x)
    SELECT vec_id, cluster_key FROM (SELECT *, count(*) OVER (PARTITION BY cluster_key) AS n FROM lab) WHERE n >= 8""",
    "p6_found": f"""WITH {_VECTORS},
    near AS (SELECT * FROM (SELECT a.vec_id AS x, b.vec_id AS y, c, row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) AS rk
             FROM (SELECT a, b, list_dot_product(a.u, b.u) AS c FROM vec a JOIN vec b ON a.vec_id <> b.vec_id) WHERE c >= 0.98) WHERE rk <= 5)
    SELECT p.x AS vec_a, p.y AS vec_b FROM near p JOIN near q ON p.x = q.y AND p.y = q.x WHERE p.x < p.y""",
    "p6_nearest": f"""WITH {_VECTORS}
    SELECT vec_id, other, rank, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM (
      SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.u, b.u), 12) AS c FROM vec a JOIN vec b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5""",
    "p9_found": r"""WITH doc AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '\p{M}+', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    item AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '\p{M}+', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM doc)),
    ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM item))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": _STATS + """ SELECT doc_id, stat FROM (
      SELECT doc_id, unnest([CASE WHEN n < 40 OR n > 2000 THEN 'word_count' END, CASE WHEN n > 0 AND (chars / n < 3.5 OR chars / n > 8) THEN 'mean_word_length' END,
        CASE WHEN n > 0 AND odd / chars > 0.1 THEN 'symbol_ratio' END, CASE WHEN n > 0 AND ends / lines < 0.5 THEN 'line_punctuation' END, CASE WHEN n > 0 AND known / n < 0.2 THEN 'common_words' END]) AS stat FROM m) WHERE stat IS NOT NULL""",
}
SQL["p9_items"] = f"SELECT item_id, count(*) AS documents FROM ({SQL['p9_found']}) GROUP BY item_id"
