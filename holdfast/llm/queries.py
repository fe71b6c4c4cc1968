"""One registered query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    decontamination,
    html_text,
    language,
    licenses,
    line_dedup,
    merkle,
    neardup,
    packing,
    phrases,
    quality,
    secrets,
    token_files,
    urls,
)
from holdfast.llm.tables import lower_ascii, read_table
from holdfast.session import shared_dir


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# words of letters and digits, A-Z lower-cased, and their five-word shingles; shorter texts whole
SHINGLED_SQL = """
    SELECT id, unnest(CASE WHEN len(w) >= 5
                      THEN list_distinct(list_transform(range(1, len(w) - 3),
                                         lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN ['/' || array_to_string(w, ' ')] ELSE [] END) AS shingle
    FROM (SELECT {id} AS id, regexp_extract_all(translate(text,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '{word}') AS w FROM {table})
"""
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(read_table(spark, sf_dir, "documents"),
                                      read_table(spark, sf_dir, "benchmark"))


OP1_SQL = f"""
WITH d AS ({SHINGLED_SQL.format(id="doc_id", word=ALNUM, table="documents")}),
     b AS ({SHINGLED_SQL.format(id="item_id", word=ALNUM, table="benchmark")}),
     sizes AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
     hits AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found
              FROM d JOIN b USING (shingle) GROUP BY d.id, b.id)
SELECT doc_id, item_id, n_found, n_item, n_found / n_item AS containment
FROM hits JOIN sizes ON sizes.id = item_id WHERE 100 * n_found >= 75 * n_item
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  vocabulary_path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"),
                                  vocabulary_path("byte_bpe_50k.json"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score")


def _op5_sql() -> str:
    templates = ", ".join(
        f"({n}, '{label}', {words!r}, {licenses.needed(len(words), licenses.THRESHOLD)}, "
        f"{licenses.span(text)}, {list(marks)!r})"
        for n, ((label, text), marks) in enumerate(zip(licenses.TEMPLATES, licenses.MARKS))
        for words in [licenses.template_words(text)])
    return rf"""
WITH templates(t, label, words, least, reach, marks) AS (VALUES {templates}),
     d AS MATERIALIZED (
         SELECT doc_id, low, regexp_extract_all(low, '{ALNUM}') AS w
         FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
     words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     places AS (
         SELECT doc_id, i - 1 AS start,
                CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by'
                     WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'
                     THEN 'gpl'
                     WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved'
                     THEN 'reserved' END AS label FROM words),
     base AS (SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word
              FROM places WHERE label IS NOT NULL GROUP BY doc_id),
     blocks AS (SELECT doc_id, regexp_extract_all(part, '{ALNUM}') AS b
                FROM (SELECT doc_id, unnest(regexp_split_to_array(
                          low, '\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n')) AS part FROM d)),
     runs AS (SELECT doc_id, t, label, words, least, marks, b[i:i + reach - 1] AS run
              FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM blocks, templates
                    WHERE len(list_intersect(list_distinct(b), words)) >= least)
              WHERE list_contains(words, b[i])),
     found AS (SELECT doc_id, label,
                      len(list_intersect(list_distinct(run), words)) / len(words) AS share
               FROM runs WHERE len(list_intersect(list_distinct(run), words)) >= least
               AND len(list_filter(marks, lambda m: NOT regexp_matches(
                       array_to_string(run, ' '), '(^| )(' || m || ')( |$)'))) = 0),
     labels AS (SELECT doc_id, label FROM found
                UNION SELECT doc_id, label FROM places WHERE label IS NOT NULL),
     listed AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
                FROM labels GROUP BY doc_id),
     base_listed AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
                     FROM places WHERE label IS NOT NULL GROUP BY doc_id),
     nearest AS (SELECT doc_id, max(share) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN listed USING (doc_id)
LEFT JOIN base_listed USING (doc_id) LEFT JOIN nearest USING (doc_id)
"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH parsed AS (
    SELECT page_id, lower(coalesce(url, '')) AS low,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
sites(rule, verdict, host, path) AS (VALUES
    ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
    ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
    ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
judged AS (
    SELECT p.*, (SELECT max_by(s.rule, length(s.rule)) FROM sites s
                 WHERE (p.host = s.host OR ends_with(p.host, '.' || s.host))
                   AND starts_with(p.path, s.path)) AS rule
    FROM parsed p)
SELECT page_id, j.host, j.path, j.rule,
       coalesce(s.verdict, CASE WHEN j.host <> '' AND regexp_matches(low,
           '(^|[^a-z0-9])(spam[^a-z0-9]+farm|adult|porn|casino|viagra|xxx|wp[^a-z0-9]+login|'
           || 'click[^a-z0-9]+bait)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN sites s ON s.rule = j.rule
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs, learn=~held_out)
    return language.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP8_SQL = r"""
WITH w AS MATERIALIZED (
         SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
         FROM documents),
     grams AS (SELECT doc_id, i, w[i:i + 2] AS g
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
     twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
                                      FROM grams) WHERE n > 1),
     covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
                 FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
     lines AS MATERIALIZED (
         SELECT doc_id, host, text, line,
                trim(regexp_replace(regexp_replace(lower(line), '\p{N}', '0', 'g'),
                                    '[^\p{L}0]+', ' ', 'g')) AS norm
         FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM w)),
     dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     common AS (SELECT host, norm FROM lines WHERE norm <> ''
                GROUP BY host, norm HAVING count(DISTINCT text) > 30),
     sizes AS (SELECT l.doc_id, sum(len(string_split(l.norm, ' '))) AS total,
                      sum(CASE WHEN c.norm IS NOT NULL THEN len(string_split(l.norm, ' ')) ELSE 0
                          END) AS removed
               FROM lines l LEFT JOIN common c ON c.host = l.host AND c.norm = l.norm
               WHERE l.norm <> '' GROUP BY l.doc_id),
     counted AS (
         SELECT w.doc_id, len(w)::BIGINT AS n_words,
                length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
                coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
                coalesce(total, 0) AS total, coalesce(removed, 0) AS removed
         FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)
         LEFT JOIN sizes USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND 100 * (total - removed) >= 30 * total AS kept
FROM counted
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_components(read_table(spark, sf_dir, "documents"))


SPACED = r"[^\x20\x09-\x0D]+"
OP9_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED (
         {SHINGLED_SQL.format(id="doc_id", word=SPACED, table="documents")}),
     sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
     links AS MATERIALIZED (
         SELECT x.a, x.b FROM (SELECT l.id AS a, r.id AS b, count(*) AS met
                               FROM s l JOIN s r ON l.shingle = r.shingle AND l.id <> r.id
                               GROUP BY l.id, r.id) x
         JOIN sizes m ON m.id = x.a JOIN sizes n ON n.id = x.b
         WHERE 100 * met >= 75 * (m.n + n.n - met)),
     reach AS (SELECT a AS id, a AS other FROM links
               UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
     lowest AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id,
       coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.id = d.doc_id LEFT JOIN lowest ON lowest.id = d.doc_id
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    index = line_dedup.build(docs, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}")
    return index.deduplicate(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS MATERIALIZED (
         SELECT row, doc_id, i, line, CASE WHEN length(key) >= 20 THEN key END AS key
         FROM (SELECT row, doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line,
                      regexp_replace(translate(unnest(lines), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'),
                                     '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
               FROM (SELECT row_number() OVER () AS row, doc_id,
                            string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
     repeated AS (SELECT key, max(doc_id) AS top FROM lines WHERE key IS NOT NULL
                  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     judged AS (SELECT l.*, coalesce(r.key IS NOT NULL AND doc_id <> top, false) AS dropped
                FROM lines l LEFT JOIN repeated r ON r.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), ''))
           AS kept_sha256
FROM judged GROUP BY row, doc_id
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered(docs: DataFrame) -> Column:
        fields = [docs[c] for c in merkle.FIELDS[:-1]]
        hit = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
        return F.when(hit, merkle.leaf_hash([*fields, lower_ascii(docs["text"])]))

    return merkle.verify(merkle.manifest(read_table(spark, sf_dir, "documents"), tampered))


def _op12_sql(levels: int = 5) -> str:
    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(
            f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')"
            for f in fields) + ")"

    def tree(name: str, nodes: str) -> str:
        """CTEs `name`0.. of nodes and `name`r0.. of runs, from rows (tree, pos, n, h)."""
        parts = [f"{name}0 AS MATERIALIZED ({nodes})"]
        for k in range(levels):
            parts.append(f"""{name}r{k} AS MATERIALIZED (
         SELECT tree, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs
         FROM {name}{k} GROUP BY tree, pos // 16)""")
            parts.append(f"""{name}{k + 1} AS MATERIALIZED (
         SELECT tree, run AS pos, (n + 15) // 16 AS n,
                CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h
         FROM {name}r{k})""")
        return ",\n     ".join(parts)

    def walk(name: str, runs: str, start: str) -> str:
        """CTEs `name`0..: folded node f and siblings so far s of each row, place pos."""
        parts = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(levels):
            left = "array_to_string(hs[1:pos % 16], '')"
            right = "array_to_string(hs[pos % 16 + 2:], '')"
            parts.append(f"""{name}{k + 1} AS MATERIALIZED (
         SELECT w.row, w.tree, pos // 16 AS pos,
                CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f,
                CASE WHEN n = 1 THEN s ELSE s || {left} || {right} END AS s
         FROM {name}{k} w JOIN {runs}r{k} r ON r.tree = w.tree AND r.run = w.pos // 16)""")
        return ",\n     ".join(parts)

    return f"""
WITH hashed AS MATERIALIZED (
         SELECT row_number() OVER () AS row, doc_id, source, {leaf("text")} AS leaf,
                CASE WHEN xor(4294967295::UBIGINT, list_reduce(
                    [4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''),
                                                            lambda c: ascii(c)::UBIGINT),
                    lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT for x in range(8)],
                        lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1))))) % 5 = 0
                THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
                           " 'abcdefghijklmnopqrstuvwxyz')")} END AS claim
         FROM documents),
     placed AS MATERIALIZED (
         SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1
                AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
     {tree("t", "SELECT tree, pos, n, leaf AS h FROM placed")},
     {tree("c", f"SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM t{levels}")},
     {walk("w", "t", "SELECT row, tree, pos, coalesce(claim, leaf) AS f, '' AS s FROM placed")},
     {walk("v", "c", f"SELECT row, 0 AS tree, tree AS pos, f, s FROM w{levels}")}
SELECT doc_id, leaf, t.h AS subroot, c.h AS root, sha256(v.s) AS proof_sha256,
       v.f AS folded_root, v.f = c.h AS verified
FROM placed p JOIN t{levels} t ON t.tree = p.tree JOIN v{levels} v ON v.row = p.row
CROSS JOIN c{levels} c
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
         SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \t]+') AS w
         FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
               FROM documents)),
     grams AS MATERIALIZED (
         SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase,
                any_value(w[i:i + k - 1]) AS w, count(*)::HUGEINT AS f
         FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
               FROM pieces, (VALUES (1), (2), (3)) AS s(k))
         GROUP BY ALL),
     totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
     cand AS MATERIALIZED (SELECT * FROM grams WHERE k > 1 AND f >= 10),
     cuts AS (SELECT c.lang, c.k, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r,
                     (1000000 * c.f * c.f) // (l.f * r.f) AS score
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
              JOIN grams l ON l.lang = c.lang
                   AND l.k = cut AND l.phrase = array_to_string(c.w[1:cut], ' ')
              JOIN grams r ON r.lang = c.lang AND r.k = c.k - cut
                   AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
     lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (
                    PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
     longer AS (SELECT lang, phrase, max(f) AS f FROM (
                    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM cand WHERE k = 3
                    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM cand WHERE k = 3)
                GROUP BY lang, phrase),
     kept AS (SELECT x.* FROM lowest x LEFT JOIN longer y ON x.k = 2 AND y.lang = x.lang
                   AND y.phrase = x.phrase WHERE y.f IS NULL OR 100 * y.f < 50 * x.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept k JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_best_fit_packing, op3_token_files, op4_secret_scans,
        op5_license_scans, op6_url_filters, op7_language_id,
        op8_quality_rules, op9_near_dedup, op10_html_extraction,
        op11_line_dedup, op12_merkle_manifest, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_license_scans": _op5_sql(),
            "op6_url_filters": OP6_SQL,
            "op8_quality_rules": OP8_SQL, "op9_near_dedup": OP9_SQL,
            "op11_line_dedup": OP11_SQL, "op12_merkle_manifest": _op12_sql(),
            "op13_phrase_collocations": OP13_SQL}
