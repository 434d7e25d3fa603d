"""Registered queries of the text operators, and SQL for those SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm import cover_tree, decontaminate, hilbert, hnsw, katz, language, lsh_forest, mixing, private, quality, repair, secrets, url_rules
from meterlens.llm.common import remainder, table

N_SHARDS = 40
#: What the mixed corpus should consist of, in tokens.
TARGETS = {"high": 0.9, "low": 0.1}
#: Fixed rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       "lang", "source", "n_chars")
    sharded = hilbert.hilbert_shards(rows, ["lang", "source", "n_chars"], N_SHARDS, [F.col("doc_id"), F.col("text_crc32")])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = docs.select("doc_id", decontaminate.contamination(F.col("text"), bench).alias("f"))
    return found.select("doc_id", "f.n_words", "f.n_hit", F.size("f.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated"))


def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs.select("doc_id", "text"), mixing.domains_of(labels), TARGETS)
    return mixed.select("doc_id", "n_tokens", *[F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))],
                        "rate", "copies")


def lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.secrets(spark, F.col("text")).alias("f")).select("doc_id", "f.*")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.languages(docs).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
                                           "lang_pred", "score", "rejected")


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), lambda vec_id: vec_id % 100 == 0)


def personal_data_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", private.personal_data("text").alias("spans"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    base = F.filter("spans", lambda s: s["kind"].isin(*private.BASE_KINDS))
    return docs.select("doc_id", *[of(kind) for kind in private.BASE_KINDS],
                       F.sha2(private.listed(base), 256).alias("base_sha256"), private.listed(F.col("spans")).alias("spans"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_hilbert_sharding": hilbert_sharding,
    "op2_decontamination": decontamination,
    "op3_soft_mixing": soft_mixing,
    "op4_lsh_forest": lsh_forest_dedup,
    "op5_url_filter": url_filter,
    "op6_hnsw_search": hnsw_search,
    "op7_katz_backoff": katz_backoff,
    "op8_fourier_quality": quality_classifier,
    "op9_token_secrets": secret_scan,
    "op10_kneser_ney_language": language_id,
    "op11_cover_tree_negatives": hard_negatives,
    "op12_anchor_pii": personal_data_scan,
    "op13_conversation_repair": conversation_repair,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EMPTY = hashlib.sha256(b"").hexdigest()

DECONTAMINATION_SQL = rf"""
WITH lowered AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM lowered WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[pos:pos + k - 1], ' ') AS s FROM item_at),
texts AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
doc_at AS (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM texts, sizes WHERE len(w) >= k),
found AS (SELECT d.n, d.pos, d.k, i.item_id FROM doc_at d JOIN windows i ON i.k = d.k AND i.s = array_to_string(d.w[d.pos:d.pos + d.k - 1], ' ')),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(pos, pos + k)) AS p FROM found) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h
          FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, '{_EMPTY}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (n) LEFT JOIN items USING (n)
"""

URL_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
                                      ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""

NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
word_at AS (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + k - 1], ' ') AS s FROM word_at),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

HARD_NEGATIVES_SQL = r"""
WITH rows AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM scored WHERE label = own AND other_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""



def _repair_sql() -> str:
    """Op 13 by two recursions: over rows, with a key of cost and audit per state, and over the letters of each audit."""
    far = "'900000000'"

    def add(key: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({key}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}'"

    def inserts(k: list[str]) -> list[str]:
        user = f"least({k[2]}, {', '.join(add(k[i], '2', 'I') for i in (0, 1, 3))})"
        return [k[0], k[1], user, f"least({k[3]}, {add(user, '2', 'I')})"]
    gone = [add(f"k{i}", "3", "D") for i in range(4)]
    more = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
    free = "fault NOT IN ('blank', 'duplicate')"
    keep = lambda i, initial: f"CASE WHEN {free} AND initial = '{initial}' THEN {add(f'k{i}', more, 'K')} ELSE {far} END"  # noqa: E731
    change = lambda i: f"CASE WHEN {free} THEN {add(f'k{i}', '2 + ' + more, 'R')} ELSE {far} END"  # noqa: E731
    rows = [gone[0], f"least({gone[1]}, {keep(0, 's')})",
            f"least({gone[2]}, {', '.join(f'{keep(i, chr(117))}, {change(i)}' for i in (0, 1, 3))})",
            f"least({gone[3]}, {keep(2, 'a')}, {change(2)})"]
    named = lambda keys: ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))  # noqa: E731
    start = inserts(["'000000000'", far, far, far])
    after = inserts([f"n{i}" for i in range(4)])
    return rf"""
WITH RECURSIVE keyed AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t FROM conversations),
sums AS (
    SELECT key, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS hit
    FROM (SELECT DISTINCT key FROM keyed) k),
damaged AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE r END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
           unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed JOIN sums USING (key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
judged AS (
    SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
           CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM placed),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
best AS (
    SELECT conv_id, 0 AS i, {named(start)} FROM counted
    UNION ALL
    SELECT conv_id, i, {named(after)} FROM (
        SELECT b.conv_id, b.i + 1 AS i, {', '.join(f'{x} AS n{i}' for i, x in enumerate(rows))}
        FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.pos = b.i + 1) step),
audited AS (SELECT c.*, least(k0, k3) AS best FROM counted c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n),
mended AS (
    SELECT conv_id, substr(best, 10) AS audit, 0 AS j, 0 AS row, '' AS state, CAST([] AS VARCHAR[]) AS lines FROM audited
    UNION ALL
    SELECT conv_id, audit, j, row, CASE WHEN line IS NULL THEN state ELSE left(line, 1) END, CASE WHEN line IS NULL THEN lines ELSE list_append(lines, line) END
    FROM (SELECT m.conv_id, audit, j + 1 AS j, m.row + CASE WHEN letter = 'I' THEN 0 ELSE 1 END AS row, state, lines,
                 CASE letter WHEN 'I' THEN wanted || ':' WHEN 'R' THEN wanted || ':' || text WHEN 'K' THEN role || ':' || text END AS line
          FROM (SELECT *, substr(audit, j + 1, 1) AS letter, CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS wanted FROM mended WHERE j < length(audit)) m
          LEFT JOIN judged g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.pos = m.row + 1) step)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost,
       coalesce(m.audit, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN audited a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.j = length(m.audit)
"""


REPAIR_SQL = _repair_sql()

ORACLES = {"op13_conversation_repair": REPAIR_SQL, "op11_cover_tree_negatives": HARD_NEGATIVES_SQL, "op4_lsh_forest": NEAR_DUPLICATES_SQL, "op2_decontamination": DECONTAMINATION_SQL, "op5_url_filter": URL_SQL}
