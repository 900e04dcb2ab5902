"""DuckDB SQL of the queries that SQL can express."""

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
FOLDED = rf"regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH rated AS (SELECT doc_id, avg(1.0 + 3.0 * quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, coalesce(len(regexp_extract_all(text, {WORD})), 0) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
      / coalesce(q, 2.0) AS key
  FROM documents d LEFT JOIN rated USING (doc_id)),
sources AS (SELECT skey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM sized GROUP BY skey),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY source_size / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM sources),
capped AS (SELECT *, (total - below)::DOUBLE * weight >= rest::DOUBLE * source_size::DOUBLE * 3 AS full_ FROM ordered),
levels AS (SELECT *, sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER () AS given, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS open_ FROM capped),
plan AS (SELECT skey, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * (total - given)::DOUBLE / open_::DOUBLE END AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS e FROM plan),
placed AS (
  SELECT doc_id, size, source_size, target, e, floor(target)::BIGINT - e * source_size AS budget,
    sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized JOIN epochs USING (skey))
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, budget - upto + size)))::BIGINT AS taken FROM placed
"""

OP3 = f"""
WITH items AS (SELECT DISTINCT item_id, {FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS gram
  FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({FOLDED}, []) AS w FROM documents),
starts AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
found AS (SELECT r, starts.n, i, item_id FROM starts JOIN grams USING (n, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r),
places AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
terms AS (SELECT gram, n, unnest(string_split(gram, ' ')) AS word, unnest(range(n)) AS k FROM (SELECT DISTINCT gram, n FROM grams)),
first AS (SELECT r, p AS s, gram, n FROM places JOIN terms USING (word) WHERE k = 0),
near AS (
  SELECT DISTINCT r, gram FROM (
    SELECT first.r, first.gram, s FROM first JOIN terms ON terms.gram = first.gram JOIN places ON places.r = first.r AND places.word = terms.word AND p BETWEEN s + k - 2 AND s + k + 2 AND (k > 0 OR p = s)
    GROUP BY first.r, first.gram, s, first.n HAVING count(DISTINCT k) = first.n)),
close AS (SELECT r, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_ids
  FROM (SELECT DISTINCT r, item_id FROM near JOIN grams USING (gram) EXCEPT SELECT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near_items, sha256(coalesce(near_ids, '')) AS near_sha256
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN close USING (r)
"""

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, {WORD}), []) AS w FROM documents),
starts AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - 12)) AS i FROM docs WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
lowest AS (SELECT gram, min(doc_id) AS first FROM starts GROUP BY gram HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM starts JOIN lowest USING (gram) WHERE doc_id > first),
places AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {UPPER}, {LOWER}), {WORD}), []) AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS gram FROM (SELECT *, unnest(range(greatest(1, len(w) - 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS low FROM reach GROUP BY node) USING (doc_id)
"""

OP12 = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13 = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
cut AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
parts AS (SELECT *, coalesce(array_to_string(u[1 : low], ''), '') AS p, coalesce(array_to_string(u[low + 1 : high], ''), '') AS m, coalesce(array_to_string(u[high + 1 :], ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

SQL = {"op2_mix_sources": OP2, "op3_decontaminate": OP3, "op4_substring_dedup": OP4, "op10_ngram_jaccard": OP10, "op12_hard_negatives": OP12, "op13_fill_in_middle": OP13}
