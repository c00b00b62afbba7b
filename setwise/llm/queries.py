"""The registered queries of this subpackage, each beside the SQL that checks it where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from setwise.llm import alignment, bpe, decontaminate, group_join, language, licenses, merkle, minhash, pii, quality, sharding, substrings, toxicity
from setwise.llm.store import prepare
from setwise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

UPPER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
PLAIN_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(prepare(spark)), lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_personal_data")
def op2(spark, read):
    """Personal data by anchor expansion."""
    return pii.find_personal(read("documents"))


CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


@query("op3_interleave", rf"""
WITH {CRC_TABLE},
octets AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::INT) AS x FROM documents),
rows AS (
  SELECT doc_id, source, size, md5('{sharding.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS draw,
    CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum,
    xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, y: xor(a >> 8, tab[xor(a & 255, y) + 1])), 4294967295) AS text_crc32
  FROM octets, crc),
placed AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, size, text_crc32) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS part FROM rows),
sequence AS (
  SELECT *, row_number() OVER (ORDER BY part, stratum, draw, doc_id, size, text_crc32) - 1 AS pos,
    count(*) OVER () // 16 AS least, count(*) OVER () % 16 AS larger FROM placed),
dealt AS (
  SELECT *, CASE WHEN pos < larger * (least + 1) THEN pos // (least + 1)
    ELSE larger + (pos - larger * (least + 1)) // least END AS shard FROM sequence)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
  (pos - CASE WHEN shard <= larger THEN shard * (least + 1) ELSE larger + shard * least END)::BIGINT AS slot,
  NULL::INT AS grown_shard FROM dealt
""")
def op3(spark, read):
    """Sixteen shards of one mixture by proportional stratified interleaving."""
    return sharding.shards_of(read("documents"))


def _license_sql() -> str:
    sets = ", ".join(
        f"('{n}', {sorted(set(x.split()))}, {len(set(x.split()))}, {math.ceil(licenses.THRESHOLD * len(set(x.split())) - 1e-9)}, {licenses.STRETCH * len(x.split())})"
        for n, x in licenses.TEMPLATES.items())
    starts = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        starts.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, {PLAIN_WORDS.format(UPPER)} AS w FROM docs),
hits AS (SELECT r, doc_id, len(w) AS n_words, flatten([{', '.join(starts)}]) AS h FROM words),
templates AS (SELECT template, size, needed, width, unnest(t) AS word FROM (VALUES {sets}) AS t(template, t, size, needed, width)),
positions AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM words),
spots AS (SELECT r, i, t.* FROM positions JOIN templates t USING (word)),
enough AS (SELECT r, template FROM spots GROUP BY r, template, needed HAVING count(DISTINCT word) >= needed),
near AS (SELECT * FROM spots SEMI JOIN enough USING (r, template)),
matches AS (
  SELECT a.r, a.template, count(DISTINCT b.word) / a.size AS share FROM near a JOIN near b ON a.r = b.r AND a.template = b.template AND b.i BETWEEN a.i AND a.i + a.width - 1
  GROUP BY a.r, a.template, a.i, a.size, a.needed HAVING count(DISTINCT b.word) >= a.needed),
found AS (SELECT r, list(DISTINCT template) AS names, max(share) AS best FROM matches GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(h)::BIGINT AS n_base,
  list_min(list_transform(h, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(h, lambda x: x.at))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(h, lambda x: x.label), coalesce(names, [])))), ',') AS labels,
  coalesce(best, 0.0)::DOUBLE AS score
FROM hits LEFT JOIN found USING (r)
"""


@query("op7_licenses", _license_sql())
def op7(spark, read):
    """License notices by an exact set-similarity join."""
    return licenses.scan_licenses(read("documents"))


@query("op8_quality", rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, {SPACE_WORDS.format('text')} AS w FROM docs),
positions AS (SELECT r, w, unnest(range(len(w))) AS i FROM words),
windows AS (SELECT r, i, i + 8 <= len(w) AS whole, array_to_string(w[i + 1 : i + 8], ' ') AS s, w[i + 1] AS word FROM positions),
again AS (SELECT r, i, whole AND count(*) OVER (PARTITION BY r, whole, s) > 1 AS twice, word FROM windows),
inside AS (SELECT r, word, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM again),
repeats AS (SELECT r, sum(hit)::BIGINT AS n_repeat_words, coalesce(sum(CASE WHEN hit = 1 THEN length(word) END), 0)::BIGINT AS covered_chars
  FROM inside GROUP BY r),
long AS (SELECT DISTINCT r FROM (
  SELECT r, array_to_string(w[i + 1 : i + 201], ' ') AS s FROM positions WHERE i + 201 <= len(w)) GROUP BY r, s HAVING count(*) > 1),
lines AS (SELECT r, l, len({SPACE_WORDS.format('l')}) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)),
dups AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM lines WHERE n > 0 GROUP BY r),
counts AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_chars, 0) AS covered_chars, long.r IS NOT NULL AS too_long
  FROM words LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN long USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR too_long OR 100 * covered_chars > 35 * word_chars) AS kept FROM counts
""")
def op8(spark, read):
    """Quality rules on suffix-array repetition."""
    return quality.quality(read("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_contamination", rf"""
WITH items AS (SELECT item_id, {PLAIN_WORDS.format(UPPER)} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS.format(UPPER)} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
spots AS (
  SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT r, w, unnest(range(len(w))) AS i FROM docs), (SELECT DISTINCT n FROM grams) WHERE i + n <= len(w)),
found AS (SELECT r, i, spots.n, item_id FROM spots JOIN grams USING (g) WHERE spots.n = grams.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
who AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN who USING (r)
""")
def op9(spark, read):
    """Benchmark windows in documents by Wu-Manber search."""
    return decontaminate.find_contamination(read("documents"), read("benchmark")).drop("items")


@query("op10_byte_bpe")
def op10(spark, read):
    """Token ids of every text, and the bytes they decode to."""
    coded = bpe.encode(read("documents"), RANKS, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_language")
def op4(spark, read):
    """Language of every document, learned from the documents outside one fold of four."""
    docs = read("documents")
    held_out = language.fold("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5(spark, read):
    """Toxicity of every document, learned from the labels outside one fold of three."""
    docs = read("documents")
    held_out = language.fold("doc_id", 3) == 1
    lexicon = toxicity.fit(docs, read("labels").where(~held_out))
    return toxicity.rate(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def _linked_sql(k: int, more: str = "") -> str:
    """Components of all pairs of documents with 85 per cent of their k-word shingles in common."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {SPACE_WORDS.format(UPPER)} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {k}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {k} + 1, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS far FROM sides UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON sides.a = reach.far),
least AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id{more}
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query("op1_near_duplicates", _linked_sql(3, ", doc_id = coalesce(component_id, doc_id) AS kept"))
def op1(spark, read):
    """Near-duplicates on three-word shingles at 85 per cent."""
    return minhash.near_duplicates(read("documents"), k=3, percent=85).withColumnRenamed("component", "component_id")


@query("op6_repeated_passages", rf"""
WITH words AS (SELECT doc_id, {SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM words)),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM judged WHERE again),
positions AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op6(spark, read):
    """Documents without passages that an earlier document has."""
    return substrings.digest(substrings.remove_repeats(read("documents")))


def _said(*columns: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)


def _levels_sql(name: str, source: str) -> str:
    """All levels of the trees over (tree, pos, h, n): runs of two become their digest."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, h, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""


@query("op13_merkle_manifest", rf"""
WITH RECURSIVE {CRC_TABLE},
octets AS (SELECT *, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::INT) AS x FROM documents),
marked AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, y: xor(a >> 8, tab[xor(a & 255, y) + 1])), 4294967295) % 7 = 0, false) AS hit
  FROM octets, crc),
said AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, sha256({_said("doc_id", "source", "lang", "n_chars", "text")}) AS h,
    sha256({_said("doc_id", "source", "lang", "(n_chars::HUGEINT + hit::INT)", "text")}) AS start FROM marked),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM said),
{_levels_sql("low", "leaves")},
tops AS (
  SELECT 0 AS tree, low.tree AS name, h, row_number() OVER (ORDER BY encode(low.tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_levels_sql("high", "tops")},
path AS (
  SELECT l.doc_id, l.tree, l.pos, 0 AS part, v.level, (l.pos >> v.level) & 1 AS side, s.h AS beside
  FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) v USING (tree)
  LEFT JOIN low s ON s.tree = l.tree AND s.level = v.level AND s.pos = xor(l.pos >> v.level, 1)
  UNION ALL
  SELECT l.doc_id, l.tree, l.pos, 1, v.level, (t.pos >> v.level) & 1, s.h
  FROM leaves l JOIN tops t ON t.name = l.tree, (SELECT DISTINCT level FROM high WHERE n > 1) v
  LEFT JOIN high s ON s.level = v.level AND s.pos = xor(t.pos >> v.level, 1)),
paths AS (SELECT tree, pos, list({{'side': side, 'beside': beside}} ORDER BY part, level) AS steps, string_agg(beside, '' ORDER BY part, level) AS proof
  FROM path GROUP BY tree, pos),
begun AS (SELECT l.*, t.h AS subroot, coalesce(steps, []) AS steps, coalesce(proof, '') AS proof
  FROM leaves l JOIN tops t ON t.name = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos),
fold AS (
  SELECT tree, pos, 0 AS k, start AS now FROM begun
  UNION ALL
  SELECT f.tree, f.pos, k + 1, sha256(CASE WHEN steps[k + 1].beside IS NULL THEN now WHEN steps[k + 1].side = 1 THEN steps[k + 1].beside || now ELSE now || steps[k + 1].beside END)
  FROM fold f JOIN begun b ON b.tree = f.tree AND b.pos = f.pos WHERE k < len(steps)),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, b.h AS leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM begun b JOIN fold f ON f.tree = b.tree AND f.pos = b.pos AND f.k = len(steps), root
""")
def op13(spark, read):
    """A manifest of all documents, and whether each still folds to its root after some counts were raised."""
    return merkle.prove(read("documents"), merkle.with_count_raised())


@query("op12_token_alignment")
def op12(spark, read):
    """Two tokenizers aligned on every text, and how often their ids are linked."""
    return alignment.align(read("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_group_join", _linked_sql(4))
def op11(spark, read):
    """Documents that share 85 per cent of their four-word shingles, over a token-group matrix."""
    return group_join.similar_groups(read("documents")).withColumnRenamed("component", "component_id")
