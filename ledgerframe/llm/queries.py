"""The numbered operators as queries over the whole tables, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), with_text=False)


ORACLE["op7_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 12] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), earliest AS (
  SELECT x, min(doc_id) AS first_id FROM windows GROUP BY x
), lost AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN earliest USING (x) WHERE first_id < doc_id
), gone AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM lost GROUP BY doc_id
), placed AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words WHERE len(w) > 0
), kept AS (
  SELECT p.doc_id, string_agg(w[p.k], ' ' ORDER BY p.k) AS t
  FROM placed p LEFT JOIN lost l ON p.doc_id = l.doc_id AND p.k = l.k WHERE l.k IS NULL GROUP BY p.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE["op6_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS x, a AS y FROM both_ways
  UNION
  SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a
), least AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c, words.doc_id) AS BIGINT) AS component_id, coalesce(c, words.doc_id) = words.doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = words.doc_id
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)


ORACLE["op3_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS x, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM phrases
), windows AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, w.n, item_id FROM windows w JOIN phrases p ON w.x = p.x AND w.n = p.n
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"), with_text=False)


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"), with_text=False).drop("found")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import linked_components

    return linked_components(table(spark, sf_dir, "embeddings"))


ORACLE["op4_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
), n AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a AS x, a AS y FROM links
  UNION
  SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
), least AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(c, vec_id) AS BIGINT) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON x = vec_id LEFT JOIN counts ON a = vec_id
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: a file lies in /source/lang, one of over 400 characters in a folder below it."""
    from .license_scan import scan_licenses

    folder = F.when(F.length("text") > 400, "articles")
    return scan_licenses(table(spark, sf_dir, "documents"), F.concat_ws("/", F.lit(""), "source", "lang", folder, F.col("doc_id").cast("string")))


def _personal_sql() -> str:
    """Spans by splitting texts, and the scores that the words near them give."""
    from .pii import _LOWER, _UPPER, CONTEXT, KINDS, PRIOR, WORDS

    near = " ".join(f"WHEN {o} THEN '(^|[^a-z])(?:{WORDS[kind]})($|[^a-z])'" for o, kind in enumerate(KINDS, 1))
    prior = " ".join(f"WHEN {o} THEN {PRIOR[kind]}" for o, kind in enumerate(KINDS, 1))
    return r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), kinds AS (
  SELECT * FROM (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
    (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (5, 'iban', '(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?:$|[^A-Za-z0-9])'), (6, 'ssn', '[0-9-]+')) k(o, kind, p)
), cut AS (
  SELECT r, o, kind, regexp_extract_all(x, p) AS ms, string_split_regex(x, p) AS ps FROM texts, kinds
), placed AS (
  SELECT r, o, kind, ms[k] AS v, CAST(list_sum(list_transform(ps[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda s: length(s))), 0) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM cut)
), spans AS (
  SELECT r, o, kind, CASE WHEN o = 5 THEN trim(regexp_replace(v, '^[^A-Za-z0-9]|[^A-Za-z0-9]$', '', 'g')) ELSE v END AS v,
    CASE WHEN o = 5 AND regexp_matches(v, '^[^A-Za-z0-9]') THEN b + 1 ELSE b END AS b FROM placed
), digits AS (
  SELECT *, b + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d, replace(v, ' ', '') AS c FROM spans
), turned AS (
  SELECT *, substr(c, 5) || substr(c, 1, 4) AS t FROM digits
), valid AS (
  SELECT r, o, kind, b, e FROM turned WHERE CASE o
    WHEN 2 THEN list_aggregate(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(substr(ltrim(p, '0'), 1, 3) AS INTEGER), 0) <= 255), 'bool_and')
    WHEN 3 THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS INTEGER)
      WHEN CAST(substr(reverse(d), i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse(d), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse(d), i, 1) AS INTEGER) END)) % 10 = 0
    WHEN 4 THEN length(d) BETWEEN 9 AND 15
    WHEN 5 THEN list_reduce(list_prepend(0, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN substr(t, i, 1) BETWEEN '0' AND '9' THEN CAST(substr(t, i, 1) AS INTEGER) ELSE ascii(substr(t, i, 1)) - 55 END)),
      lambda a, n: CASE WHEN n > 9 THEN (a * 100 + n) % 97 ELSE (a * 10 + n) % 97 END) = 1
    WHEN 6 THEN regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$')
    ELSE true END
), scored AS (
  SELECT v.*, CASE WHEN regexp_matches(substr(t, greatest(b - @CONTEXT, 0) + 1, least(b, @CONTEXT)), word) OR regexp_matches(substr(t, e + 1, @CONTEXT), word) THEN (100 + prior) // 2 ELSE prior END AS score
  FROM (SELECT *, CASE o @NEAR END AS word, CASE o @PRIOR END AS prior FROM valid) v JOIN (SELECT r, translate(x, '@UPPER', '@LOWER') AS t FROM texts) USING (r)
), kept AS (
  SELECT * FROM scored v WHERE o < 5 OR (score >= 50 AND NOT EXISTS (SELECT 1 FROM valid w WHERE w.r = v.r AND w.o IN (1, 2, 4) AND w.b < v.e AND v.b < w.e))
), per_doc AS (
  SELECT r, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3, count(*) FILTER (o = 4) AS n4,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b) FILTER (o < 5) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b) AS every,
    string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, b) AS scores
  FROM kept GROUP BY r
)
SELECT doc_id, CAST(coalesce(n1, 0) AS BIGINT) AS n_email, CAST(coalesce(n2, 0) AS BIGINT) AS n_ip, CAST(coalesce(n3, 0) AS BIGINT) AS n_card, CAST(coalesce(n4, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(scores, '') AS scores
FROM texts LEFT JOIN per_doc USING (r)
""".replace("@CONTEXT", str(CONTEXT)).replace("@NEAR", near).replace("@PRIOR", prior).replace("@UPPER", _UPPER).replace("@LOWER", _LOWER)


ORACLE["op10_pii"] = _personal_sql()


def _license_sql() -> str:
    from .license_scan import TEMPLATES

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    terms = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return rf"""
WITH templates AS (
  SELECT * FROM (VALUES {values}) t(i, name, text)
), template_terms AS (
  SELECT i, term, count(*) AS tf FROM (SELECT i, unnest({terms.format('text')}) AS term FROM templates) GROUP BY ALL
), docs AS (
  SELECT *, dir || '/' || doc_id AS path FROM (SELECT row_number() OVER () AS r, doc_id, text, '/' || source || '/' || lang || CASE WHEN length(text) > 400 THEN '/articles' ELSE '' END AS dir FROM documents)
), n AS (
  SELECT count(*) AS n FROM docs
), df AS (
  SELECT term, count(DISTINCT r) AS df FROM (SELECT r, unnest({terms.format('text')}) AS term FROM docs) WHERE term IN (SELECT term FROM template_terms) GROUP BY term
), idf AS (
  SELECT t.term, ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT term FROM template_terms) t LEFT JOIN df USING (term), n
), vectors AS (
  SELECT i, term, tf * idf AS w FROM template_terms JOIN idf USING (term)
), lengths AS (
  SELECT i, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY i
), pieces AS (
  SELECT r, row_number() OVER () AS p, whole, piece FROM (
    SELECT r, true AS whole, text AS piece FROM docs UNION ALL
    SELECT r, false, unnest(regexp_split_to_array(text, '\r?\n')) FROM docs UNION ALL
    SELECT r, false, unnest(list_filter(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n'), lambda x: contains(x, chr(10)))) FROM docs)
), piece_terms AS (
  SELECT r, p, whole, term, count(*) AS tf FROM (SELECT r, p, whole, unnest({terms.format('piece')}) AS term FROM pieces) GROUP BY ALL
), weighed AS (
  SELECT t.*, t.tf * coalesce(idf, ln(n + 1) + 1) AS w FROM piece_terms t LEFT JOIN idf USING (term), n
), norms AS (
  SELECT p, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM weighed GROUP BY p
), scores AS (
  SELECT r, whole, v.i, round(sum(t.w * v.w) / any_value(q.norm) / any_value(l.norm), 6) AS score, any_value(q.words) AS words
  FROM weighed t JOIN vectors v USING (term) JOIN norms q USING (p) JOIN lengths l ON l.i = v.i GROUP BY r, p, whole, v.i
), sizes AS (
  SELECT r, sum(tf) AS every FROM piece_terms WHERE whole GROUP BY r
), best AS (
  SELECT r, bool_or(score >= 0.9 AND (whole OR words >= 0.4 * every)) AS is_license_file, arg_max(i, (score, -i)) AS i, max(score) AS score FROM scores JOIN sizes USING (r) WHERE score >= 0.7 GROUP BY r
), owned AS (
  SELECT d.*, name AS own_license, score AS own_score, coalesce(is_license_file, false) AS is_license_file FROM docs d LEFT JOIN best USING (r) LEFT JOIN templates USING (i)
), given AS (
  SELECT dir AS ancestor, arg_min(own_license, (-own_score, own_license)) AS given FROM owned WHERE is_license_file GROUP BY dir
), nearest AS (
  SELECT o.r, arg_max(ancestor, length(ancestor)) AS ancestor, arg_max(given, length(ancestor)) AS given FROM owned o JOIN given g ON o.dir = ancestor OR starts_with(o.dir, ancestor || '/') GROUP BY o.r
)
SELECT doc_id, path, own_license, own_score, is_license_file, coalesce(own_license, given) AS license, CASE WHEN own_license IS NOT NULL THEN 'own' ELSE ancestor END AS license_from
FROM owned LEFT JOIN nearest USING (r)"""


ORACLE["op5_license_scan"] = _license_sql()


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


# DuckDB has no crc32: its table of 256 remainders is made from the polynomial, and each run folded byte by byte.
ORACLE["op11_spelling_variants"] = r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, CAST(v AS BIGINT)) ORDER BY v) AS t FROM range(0, 256) r(v)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_transform(range(0, octet_length(encode(doc_id || ':' || run))), lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM counted, remainders
), words AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM hashed
  ) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2
), keys AS (
  SELECT word, n, word AS key FROM words
  UNION
  SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near_word, b.n AS near_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE abs(length(a.word) - length(b.word)) = 1 AND (a.word = a.key OR b.word = b.key)
    OR length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
), best AS (
  SELECT word, n, count(*) AS n_near, list(near_word ORDER BY near_n DESC, near_word)[1] AS form, max(near_n) AS form_n FROM near GROUP BY ALL
), forms AS (
  SELECT word, form, form_n FROM best WHERE form_n >= 10 * n
), chains AS (
  SELECT word, form AS root FROM forms
  UNION
  SELECT c.word, f.form FROM chains c JOIN forms f ON c.root = f.word
), last AS (
  SELECT word, root FROM chains WHERE root NOT IN (SELECT word FROM forms)
)
SELECT word, f.form, coalesce(root, word) AS root, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN forms f USING (word) LEFT JOIN last USING (word)
"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import first_lines

    return first_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE["op12_line_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), lines AS (
  SELECT doc_id, i, x[i] AS line, translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM texts)
), firsts AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT doc_id, i, line, coalesce(first_id < doc_id, false) AS dropped FROM lines LEFT JOIN firsts USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, w[i:i + m - 1] AS x, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, range(1, 5) r(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT lang, x, f AS a FROM grams WHERE len(x) > 1
), cuts AS (
  SELECT c.lang, c.x, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT lang, x, a, unnest(range(1, len(x))) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.x = c.x[1:k] JOIN grams r ON r.lang = c.lang AND r.x = c.x[k + 1:len(c.x)]
), lowest AS (
  SELECT lang, x, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1
), inside AS (
  SELECT lang, x[i:i + m - 1] AS x, max(a) AS held
  FROM (SELECT lang, x, a, m, unnest(range(1, len(x) - m + 2)) AS i FROM candidates, range(2, 4) r(m) WHERE len(x) > m) GROUP BY ALL
), ranked AS (
  SELECT lang, array_to_string(x, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN inside USING (lang, x) WHERE held IS NULL OR CAST(100 AS HUGEINT) * held < CAST(80 AS HUGEINT) * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
