"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.llm import (
    bpe, collocations, decontaminate, digest, idcoder, licenses, lines, minhash, mixing, periodic, quality, superkmer, warc,
)
from dockline.llm.common import shared_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(
        _table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, keep_ids=False
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.without_repeats(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.converted(_table(spark, folder, "pages"), shared_path(spark, "warc"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scanned(docs.select("doc_id", path.alias("path"), "text"))


def _license_sql() -> str:
    weights, rare = licenses.term_weights()
    known = ", ".join(f"('{t}', {w!r}e0)" for t, w in weights.items())
    shares = ", ".join(
        f"({k}, '{name}', '{t}', {v!r}e0)" for k, name, vector in licenses.template_vectors() for t, v in vector.items())
    return f"""
WITH known(term, idf) AS (VALUES {known}), shares(template, name, term, share) AS (VALUES {shares}),
f AS (
  SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, '/' || source || '/' || lang AS dir,
         translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS text FROM documents),
u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS unit FROM f
  UNION ALL SELECT doc_id, text, -1 FROM f),
t AS (
  SELECT doc_id, unit, term, count(*) AS n
  FROM (SELECT doc_id, unit, unnest(regexp_extract_all(x, '{licenses.TERM}')) AS term FROM u) GROUP BY ALL),
w AS (SELECT doc_id, unit, t.term, n * coalesce(idf, {rare!r}e0) AS w FROM t LEFT JOIN known USING (term)),
size AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL),
dots AS (SELECT doc_id, unit, template, name, sum(w * share) AS dot FROM w JOIN shares USING (term) GROUP BY ALL),
best AS (
  SELECT doc_id, unit, arg_max(template, (round(dot / size, 6), -template)) AS template,
         arg_max(name, (round(dot / size, 6), -template)) AS name, max(round(dot / size, 6)) AS score
  FROM dots JOIN size USING (doc_id, unit) GROUP BY ALL HAVING max(round(dot / size, 6)) >= {licenses.THRESHOLD}),
own AS (
  SELECT doc_id, coalesce(any_value(name) FILTER (unit < 0), arg_max(name, (score, -unit)) FILTER (unit >= 0)) AS name,
         coalesce(any_value(score) FILTER (unit < 0), max(score) FILTER (unit >= 0)) AS score, bool_or(unit < 0) AS is_file
  FROM best GROUP BY doc_id),
holder AS (
  SELECT dir, arg_min(name, (-score, path)) AS hname, min(path) AS any_path, arg_min(path, (-score, path)) AS hpath,
         max(score) AS hscore
  FROM own JOIN f USING (doc_id) WHERE is_file GROUP BY dir)
SELECT doc_id, path, coalesce(name, hname) AS license, coalesce(score, hscore) AS license_score,
       CASE WHEN name IS NOT NULL AND is_file THEN 'file' WHEN name IS NOT NULL THEN 'header'
            WHEN hname IS NOT NULL THEN 'inherited' END AS license_by,
       CASE WHEN name IS NULL THEN hpath END AS license_from
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN holder USING (dir)"""


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents"))


def op6_id_coder(spark: SparkSession, folder: str) -> DataFrame:
    return idcoder.round_trip(
        _table(spark, folder, "documents"), shared_path(spark, "ids"), WORD_TOKENIZER, 1, keep_ids=False
    )


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), size=2, percent=80)


def op8_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    found = superkmer.without_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digest.fingerprints(_table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents the words from place a on repeat with period p.

    h is the crc32 of the decimal doc_id and g = floor(h / 10); texts with h % 10 = 0 and
    n > 0 words change, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id
    leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("ws", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("ws"))
    g = F.floor(F.col("h") / 10)
    placed = split.withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    periodic = F.transform("ws", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(_table(spark, folder, "documents")))
    top = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# target weights of the production mixture; a name that is not listed weighs 1
MIX_WEIGHTS = {
    "domain": {"web": 0.5, "books": 1.5},
    "lang": {"en": 2.0},
    "source": {"src0": 0.5},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 17


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mixed(docs, weights=MIX_WEIGHTS, domain=mixing.domain_of(), budget_share=MIX_SHARE,
                        max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_table(spark, folder, "documents")).drop("_th")


def _mixing_sql() -> str:
    """The same allocation level by level, then one running sum over each whole leaf."""
    parts, given = [], "SELECT 1 AS top, CAST(floor(sum(tokens) * {s}) AS BIGINT) AS pb FROM leaves".format(s=MIX_SHARE)
    for depth, level in enumerate(mixing.LEVELS):
        own, above = ", ".join(mixing.LEVELS[: depth + 1]), ", ".join(mixing.LEVELS[:depth]) or "top"
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
        over = f"OVER (PARTITION BY {above} ORDER BY ratio, {level} ROWS BETWEEN "
        top = "" if depth else "1 AS top, "
        parts.append(f"""
g{depth} AS ({given}),
n{depth} AS (
  SELECT {top}{own}, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS capacity, CAST(sum(tokens) AS BIGINT) AS tokens,
         CAST(CASE {cases} ELSE 1 END AS DOUBLE) AS w
  FROM leaves GROUP BY {own}),
r{depth} AS (
  SELECT *, greatest(pb - coalesce(sum(capacity) {over}UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest,
         sum(w) {over}CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM (SELECT *, capacity / w AS ratio FROM n{depth} JOIN g{depth} USING ({above}))),
l{depth} AS (
  SELECT {above}, arg_min(rest, (ratio, {level})) AS rest0, arg_min(opened, (ratio, {level})) AS open0
  FROM r{depth} WHERE capacity > rest * w / opened GROUP BY {above}),
b{depth} AS (
  SELECT {own}, tokens, CAST(floor(least(capacity::DOUBLE, coalesce(rest0 * w / open0, capacity::DOUBLE)) + 1e-6) AS BIGINT) AS budget
  FROM r{depth} LEFT JOIN l{depth} USING ({above}))""")
        given = f"SELECT {own}, budget AS pb FROM b{depth}"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_matches(source, '[0-2]$') THEN 'web' WHEN regexp_matches(source, '[3-5]$') THEN 'books'
              WHEN regexp_matches(source, '[67]$') THEN 'news' ELSE 'other' END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),{",".join(parts)},
placed AS (
  SELECT d.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM d JOIN b2 USING (domain, lang, source)),
run AS (
  SELECT *, coalesce(sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM run"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_quality_rules": op5_quality_rules,
    "op6_id_coder": op6_id_coder,
    "op7_minhash": op7_minhash,
    "op8_super_kmers": op8_super_kmers,
    "op9_digest": op9_digest,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontaminate": op13_decontaminate,
}

ORACLES = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents),
worded AS (
  SELECT doc_id, x, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT a.doc_id, a.k, row_number() OVER (PARTITION BY a.x, b.x ORDER BY a.doc_id, a.k) AS r
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
long AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, k) AS r
  FROM worded WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (
  SELECT w.doc_id, w.p FROM pairs q JOIN worded w ON w.doc_id = q.doc_id AND w.k IN (q.k, q.k + 1) WHERE q.r > 1
  UNION SELECT doc_id, p FROM long WHERE r > 1),
kept AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS m FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op3_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h
  FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g""",
    "op4_licenses": _license_sql(),
    "op10_mixing": _mixing_sql(),
    "op5_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
five AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM five) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines
  FROM base b LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_dup_lines <= 30 * n_lines AND 3 * n_words <= word_chars AND word_chars <= 12 * n_words AS kept
FROM f""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
                      ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN low USING (doc_id)""",
    "op8_super_kmers": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, (SELECT unnest(range(0, 20)) AS k)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
  FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT lang, phrase, size, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size),
s AS (
  SELECT cut.lang, cut.phrase, size, a, k, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN (SELECT lang, phrase AS x, f FROM f) l USING (lang, x) JOIN (SELECT lang, phrase AS y, f FROM f) r USING (lang, y)),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
cover AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
best AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM low LEFT JOIN cover USING (lang, phrase) WHERE size = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_periodic_runs": r"""
WITH RECURSIVE bits(i, step, x) AS (
  SELECT unnest(range(256)), 0, unnest(range(256))
  UNION ALL
  SELECT i, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(x ORDER BY i) AS held FROM bits WHERE step = 8),
w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: xor(c >> 8, held[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, crc),
placed AS (SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS m FROM w),
t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // m) + 1] END)
    ELSE ws END AS ws
  FROM placed),
five AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, n, ws, unnest(range(0, n - 4)) AS i FROM t WHERE n >= 6)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
island AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pair) GROUP BY doc_id, q, part
  HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM island GROUP BY doc_id, s, len),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
top AS (
  SELECT doc_id, s, len, q FROM run x
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(0, n)) AS i FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", len AS length, q AS period, 1000 * len // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(list_slice(ws, i, i + 9), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
dwin AS (
  SELECT doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM dw, (SELECT DISTINCT size FROM wins) WHERE len(ws) >= size)),
hit AS (SELECT doc_id, item_id, size, i FROM dwin JOIN wins USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
