"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evirank.llm import bpe, chat, jaccard, media, merkle, nearest, packing, pages, pii, prefixes, quality, substrings, toxicity
from evirank.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.nodes(table(spark, sf_dir, "conversations")).drop("position", "end")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_media_columns": op4_media_columns,
    "op5_pii": op5_pii,
    "op6_main_text": op6_main_text,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_quality": op8_quality,
    "op9_repeated_substrings": op9_repeated_substrings,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}


def _crc32(value: str) -> str:
    """crc32 of a value's text, for ASCII texts."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce([4294967295] || list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT)), lambda c, b: {bits}), 4294967295)"


_CONTROL = r"([<\[])(\\*)(\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|im_sep\|>|\/INST\]|INST\]|\/s>|s>)"
#: Shingle sets, links and the smallest id reachable by links; trees level by level; beginnings as whole strings; the other operators are held against plain versions in tests.
ORACLES: dict[str, str] = {
    "op7_jaccard_components": """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n AS k ON k.doc_id = x JOIN n AS l ON l.doc_id = y WHERE 100 * c >= 75 * (k.n + l.n - c)), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.y FROM r JOIN u ON u.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2""",
    "op11_merkle_manifest": f"""WITH RECURSIVE f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents),
l AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf, sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || z) AS tampered, {_crc32("doc_id")} % 7 = 0 AS hit FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS lev, pos, leaf AS h, n FROM p UNION ALL SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lev, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, pos, subroot AS h, n FROM s UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, pos // 2, n),
w AS (SELECT p.doc_id, p.lang, p.leaf, p.pos, CASE WHEN p.hit THEN p.tampered ELSE p.leaf END AS b, s.subroot, s.pos AS top FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang),
g AS (SELECT doc_id, leaf, 0 AS k, t.lev, x.h AS h, (w.pos >> t.lev) % 2 = 1 AS before FROM w JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.pos = w.pos >> t.lev AND t.n > 1 LEFT JOIN t AS x ON x.lang IS NOT DISTINCT FROM w.lang AND x.lev = t.lev AND x.pos = xor(t.pos, 1)
  UNION ALL SELECT doc_id, leaf, 1, u.lev, x.h, (w.top >> u.lev) % 2 = 1 FROM w JOIN u ON u.pos = w.top >> u.lev AND u.n > 1 LEFT JOIN u AS x ON x.lev = u.lev AND x.pos = xor(u.pos, 1)),
q AS (SELECT doc_id, leaf, string_agg(coalesce(h, ''), '' ORDER BY k, lev) AS proof, list(CASE WHEN before THEN h ELSE '' END ORDER BY k, lev) AS l, list(CASE WHEN before THEN '' ELSE coalesce(h, '') END ORDER BY k, lev) AS r FROM g GROUP BY 1, 2),
o AS (SELECT w.doc_id, w.leaf, w.subroot, sha256(coalesce(q.proof, '')) AS proof_sha256, list_reduce([b] || list_transform(coalesce(range(1, len(q.l) + 1), []), lambda i: CAST(i AS VARCHAR)), lambda a, i: sha256(q.l[CAST(i AS BIGINT)] || a || q.r[CAST(i AS BIGINT)])) AS folded_root FROM w LEFT JOIN q USING (doc_id, leaf))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o, (SELECT h AS root FROM u WHERE n = 1)""",
    "op12_prefix_trie": f"""WITH a AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id")} % 9 AS h, count(*) AS own FROM a GROUP BY conv_id), d AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (SELECT d.conv_id, a.pos AS depth, role, text FROM d JOIN a ON a.conv_id = d.base AND a.pos <= d.taken UNION ALL SELECT d.conv_id, a.pos - d.h + d.taken, role, text FROM d JOIN a ON a.conv_id = d.conv_id AND a.pos > d.h),
e AS (SELECT conv_id, depth, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(depth) AS last FROM e GROUP BY 1),
n AS (SELECT e.path, e.depth, min(e.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id) FILTER (WHERE last = e.depth), '')) AS ends_sha256 FROM e JOIN len USING (conv_id) GROUP BY 1, 2),
m AS (SELECT n.*, n2.conv_id AS parent_conv_id FROM n LEFT JOIN n AS n2 ON n.depth > 0 AND n2.depth = n.depth - 1 AND n2.path = left(n.path, 64 * (n.depth - 1))),
k AS (SELECT left(path, 64 * (depth - 1)) AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2), z AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k USING (path, depth)),
sub AS (SELECT e.path, e.depth, count(*) FILTER (WHERE z.n_children = 0) AS n_leaves, sum((z.n_convs - 1) * z.bytes) AS saved FROM z JOIN e ON e.conv_id = z.conv_id AND e.depth <= z.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM z JOIN sub USING (path, depth)""",
    "op13_chat_format": rf"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(32 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars, CAST(1 AS BIGINT) AS branch_rank FROM b GROUP BY conv_id""",
}
