"""Registered queries of this subpackage, each over its whole table, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import read
from crosstide.llm.conversations import repair_conversations
from crosstide.llm.decontaminate import contaminated
from crosstide.llm.jaccard_join import similar_documents
from crosstide.llm.language import identify_languages
from crosstide.llm.mixing import mix_sources
from crosstide.llm.neighbours import search
from crosstide.llm.phrases import mine_phrases
from crosstide.llm.pii import personal_data_digest
from crosstide.llm.quality import score_quality
from crosstide.llm.suffix_dedup import remove_repeats
from crosstide.llm.token_files import token_documents
from crosstide.llm.toxicity import score_toxicity
from crosstide.llm.url_filter import judge_urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(read(spark, sf_dir, "documents"), vocabulary(), end_id=0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("copies", "source", "p")


def mixing_sql(documents: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size,
  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS digest FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, floor(sum(size) / count(*)) AS mean_size FROM d GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((turn - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
r AS (SELECT *, cap / weight AS full_at FROM w),
f AS (
  SELECT *, (sum(source_size) OVER () * 150.0::DOUBLE / 100
      - coalesce(sum(cap) OVER (ORDER BY full_at, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY full_at, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r),
g AS (
  SELECT source, source_size, mean_size, CASE WHEN rate >= full_at THEN cap
    ELSE (SELECT x.rate FROM f x WHERE NOT x.rate >= x.full_at ORDER BY x.full_at, x.turn LIMIT 1) * weight
    END AS target FROM f),
c AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
    CASE WHEN size > 0 THEN floor(10000.0::DOUBLE * size / (size + mean_size)) ELSE 0 END AS place,
    (CAST('0x' || substr(digest, 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (
  SELECT *, floor(share) AS certain, share - floor(share) AS q, target - floor(share) * source_size AS rest,
    (place - sum(size * place) OVER (PARTITION BY source) / sum(size) OVER (PARTITION BY source)) / 20000.0::DOUBLE AS lean FROM c),
i AS (SELECT *, CASE WHEN q > 0 THEN q * (1 + (1 - q) * lean) ELSE 0 END AS p FROM q),
o AS (SELECT *, CASE WHEN q > 0 THEN u / (1 - u) / (p / (1 - p)) END AS odds FROM i),
k AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, u, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS upto FROM o),
m AS (SELECT *, CAST(certain AS BIGINT) + CASE WHEN q > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM k)"""


OP8_SQL = mixing_sql() + " SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM m"


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.c) + any_value(nb.c) - count(*))),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY 1) m ON m.x = d.doc_id
"""

def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))


def _edited(state: str, after: dict[str, str]) -> str:
    """Least (cost, edits, lines) before row m that does not begin with an insert."""
    keeps = "".join(
        f", CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = '{i}' THEN {{'c': {to}.c + (fault = 3)::BIGINT, 'a': 'K' || {to}.a, 't': list_prepend(role || ':' || text, {to}.t)}} END"
        for i, to in after.items()
    )
    role, to = ("assistant", after["a"]) if "a" in after else ("user", after["u"])
    return (
        f"list_min(list_filter([{{'c': {state}.c + 3, 'a': 'D' || {state}.a, 't': {state}.t}}{keeps}, "
        f"CASE WHEN fault NOT IN (1, 2) THEN {{'c': {to}.c + 2 + (fault = 3)::BIGINT, 'a': 'R' || {to}.a, 't': list_prepend('{role}:' || text, {to}.t)}} END], lambda x: x IS NOT NULL))"
    )


def _inserted(own: str, to: str, role: str) -> str:
    return f"list_min([{own}, {{'c': {to}.c + 2, 'a': 'I' || {to}.a, 't': list_prepend('{role}:', {to}.t)}}])"


CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)), " \
    "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"
OP11_SQL = rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, {CRC32} % 20 AS kind FROM x),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, count(*) OVER (PARTITION BY conv_id) AS n,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault FROM o),
w AS (
  SELECT conv_id, n + 1 AS m, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS p,
    {{'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']}} AS u, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS a
  FROM (SELECT DISTINCT conv_id, n FROM f)
  UNION ALL
  SELECT conv_id, m, {_inserted("s", "u2", "user")}, {_inserted("p", "u2", "user")}, u2, a2 FROM (
    SELECT *, {_inserted("u", "a", "assistant")} AS u2, {_inserted("a", "u", "user")} AS a2 FROM (
      SELECT w.conv_id, m - 1 AS m, {_edited("s", {"s": "p", "u": "u"})} AS s, {_edited("p", {"u": "u"})} AS p,
        {_edited("u", {"a": "a"})} AS u, {_edited("a", {"u": "u"})} AS a
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.m - 1))),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.s.c, 0)::BIGINT AS cost, coalesce(w.s.a, '') AS audit,
  sha256(coalesce(array_to_string(w.s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.m = 1
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' '))) FROM w WHERE len(ws) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) FROM w WHERE len(ws) > 2),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, part, max(f) AS over FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
    FROM f WHERE size = 3) GROUP BY 1, 2),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE o.over IS NULL OR 100 * o.over < 50 * a)
SELECT r.lang, rank, phrase, a, l, r.r AS r, t.n::BIGINT AS n, score::BIGINT AS score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_source_mixing": op8_source_mixing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {
    "op8_source_mixing": OP8_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_phrase_mining": OP12_SQL,
}
