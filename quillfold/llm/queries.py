"""Registered queries of the operators in this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, binary, decontaminate, hosts, licenses, neardup, packing, passages, quality, secrets, topk, toxicity, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.tokenise(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.forked(trie.sequences(table(spark, sf_dir, "conversations")))).drop("turn")


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_top_products": op2_top_products,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repeated_passages": op13_repeated_passages,
}


def _secrets_sql() -> str:
    """Matches of each pattern with their places, weak ones that have a complementary part within the scope, and lists."""
    kinds = [*secrets.BASE, *secrets.WEAK]
    names = [k[0] for k in kinds]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, generate_subscripts(w, 1) AS number, unnest(w) AS w, unnest(p) AS p, unnest(g[1:len(w)]) AS gap FROM "
        f"(SELECT doc_id, regexp_extract_all(t, {quoted(rx)}, 0) AS w, regexp_extract_all(t, {quoted(rx)}, {group}) AS p, string_split_regex(t, {quoted(rx)}) AS g FROM d)"
        for n, (_, rx, group, _) in enumerate(kinds)
    )
    least = " ".join(f"WHEN {n} THEN {k[3]}" for n, k in enumerate(kinds))
    suits = " OR ".join(
        f"(l.kind = {names.index(k)} AND r.kind IN ({', '.join(str(names.index(x)) for x in others)}))" for k, others in secrets.COMPLEMENTS.items()
    )
    listed = f"{names!r}[kind + 1] || ':' || start || ':' || till"
    near, base = secrets.SCOPE, len(secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({matches}),
s AS (SELECT doc_id, kind, length(w) AS size, length(p) AS counted, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY number)::BIGINT AS till FROM m),
p AS (SELECT doc_id, kind, till - size AS start, till FROM s WHERE counted >= CASE kind {least} END),
k AS (SELECT DISTINCT l.doc_id, l.kind, l.start, l.till FROM p l JOIN p r ON r.doc_id = l.doc_id WHERE ({suits}) AND r.start - l.till <= {near} AND l.start - r.till <= {near}),
a AS (SELECT * FROM p WHERE kind < {base} UNION ALL SELECT * FROM k)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {n}) AS n_{k[0]}" for n, k in enumerate(secrets.BASE))},
 sha256(coalesce(string_agg({listed}, ',' ORDER BY start, kind, till) FILTER (kind < {base}), '')) AS base_sha256,
 coalesce(string_agg({listed}, ',' ORDER BY start, kind, till) FILTER (kind IS NOT NULL), '') AS spans, count(*) FILTER (kind >= {base}) AS n_linked
FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id"""


def _trie_sql() -> str:
    """Rebuilt conversations, their prefixes as hashes, and sums over each node's ancestors. crc32 is spelled out."""
    step = "list_reduce(list_prepend(xor(a, x), range(8)::UBIGINT[]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, x: {step}), 4294967295::UBIGINT)"
    return f"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, count(*) AS turns FROM o GROUP BY 1), h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, ({crc} % 9)::BIGINT AS h FROM z),
b AS (SELECT h.*, least(h.h, coalesce(z.turns, 0)) AS begun FROM h LEFT JOIN z ON z.conv_id = h.base),
r AS (SELECT b.conv_id, o.k AS d, role, text FROM b JOIN o ON o.conv_id = b.base AND o.k <= b.h UNION ALL SELECT b.conv_id, b.begun + o.k - b.h, role, text FROM b JOIN o ON o.conv_id = b.conv_id AND o.k > b.h),
p AS (SELECT conv_id, d, octet_length(encode(text)) AS bytes, md5(string_agg(md5(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM h),
n AS (SELECT node, min(d) AS depth, min(conv_id) AS conv, count(*) AS convs, min(bytes) AS bytes FROM p GROUP BY 1),
u AS (SELECT n.*, q.node AS up, m.conv AS up_conv FROM n LEFT JOIN p q ON q.conv_id = n.conv AND q.d = n.depth - 1 LEFT JOIN n m ON m.node = q.node),
c AS (SELECT up, count(*) AS children FROM u WHERE up IS NOT NULL GROUP BY 1), v AS (SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN c ON c.up = u.node),
s AS (SELECT q.node, count(*) FILTER (v.children = 0) AS leaves, sum((v.convs - 1) * v.bytes)::BIGINT AS saved FROM v JOIN p q ON q.conv_id = v.conv AND q.d <= v.depth GROUP BY 1),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY 1), e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY 1)
SELECT v.conv AS conv_id, v.depth, v.up_conv AS parent_conv_id, v.convs AS n_convs, v.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN e USING (node)"""


#: The others train, iterate, hash, tokenise or walk an automaton; they are tested against brute-force versions.
ORACLES: dict[str, str] = {
    "op1_secrets": _secrets_sql(),
    "op12_prefix_trie": _trie_sql(),
    "op2_top_products": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
