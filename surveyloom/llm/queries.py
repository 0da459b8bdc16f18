"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from surveyloom.llm import bpe

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op3_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT p.page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(p.d, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to,
  1 AS n_requests
FROM p JOIN f ON p.d = f.d""",
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import warc

    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(spark, pages).select(
        F.col("metadata.fields")["page-id"].cast(kind).alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        F.col("metadata.fields")["refers-to-page-id"].cast(kind).alias("refers_to"),
        F.col("request").isNotNull().cast("int").alias("n_requests"),
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_e8_lattice")
def op10_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surveyloom.llm import lattice

    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_lattice_lm")
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from surveyloom.llm import lattice_lm

    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op4_decontamination",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM i)),
o AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS s FROM w, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
m AS (SELECT doc_id, o.n, s, item_id FROM o JOIN k ON o.n = k.n AND o.t = k.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id""",
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op9_weighted_minhash")
def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surveyloom.llm import weighted_minhash

    return weighted_minhash.classes(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import suffix_dedup

    found = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op1_chat_hmm")
def op1_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import chat

    lines = chat.conversation_lines(table(spark, sf_dir, "conversations"))
    model = chat.fit(lines.where(~chat.held_out(F.col("conv_id"))))
    return chat.recover(lines.drop("role"), model).withColumn("held_out", chat.held_out(F.col("conv_id")))


_VECTORS = """r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))"""


@query(
    "op11_bond_negatives",
    f"""WITH {_VECTORS},
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 10""",
)
def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from surveyloom.llm import hard_negatives

    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label)


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surveyloom.llm import simhash
    from surveyloom.session import settle

    found = settle(simhash.beside_next(table(spark, sf_dir, "documents")), "simhash")
    return found.join(simhash.classes(found.select("doc_id", "fingerprint")), "fingerprint").select(*found.columns, "n_links", "class_id")


_BYTE = "CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, CAST(i // 8 + 1 AS INT), 1))) ELSE v END"
#: crc32 of the ASCII text ``s``, bit by bit.
_CRC32 = f"""xor(list_reduce(list_concat([4294967295], range(0, 8 * len(s))),
    lambda v, i: xor(({_BYTE}) >> 1, CASE WHEN ({_BYTE}) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


@query(
    "op13_prefix_trie",
    """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
y AS (SELECT c, n, c - c % 20 AS b, CRC32 % 4 AS h FROM z),
g AS (SELECT y.c, y.b, y.h, least(y.h, coalesce(o.n, 0)) AS m FROM y LEFT JOIN y o ON y.b = o.c),
u AS (SELECT t.c, m + p - h AS d, r, x FROM t JOIN g ON t.c = g.c AND p > h UNION ALL SELECT g.c, p, r, x FROM t JOIN g ON t.c = g.b AND p <= h),
k AS (SELECT c, d, string_agg(md5(len(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM u
  UNION ALL SELECT c, 0, '', 0 FROM g),
e AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY k),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(w) AS w, left(k, 32 * CAST(d - 1 AS INT)) AS p FROM k GROUP BY k, d),
f AS (SELECT p, count(*) AS n FROM n WHERE d > 0 GROUP BY p),
v AS (SELECT n.*, coalesce(f.n, 0) AS children FROM n LEFT JOIN f ON n.k = f.p),
q AS (SELECT k.k, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * v.w) AS saved FROM v JOIN k ON k.c = v.c AND k.d <= v.d GROUP BY k.k)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, o.c AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.children AS BIGINT) AS n_children,
  CAST(q.leaves AS BIGINT) AS n_leaves, CAST(q.saved AS BIGINT) AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM v JOIN q ON v.k = q.k LEFT JOIN n o ON v.d > 0 AND o.k = v.p AND o.d = v.d - 1 LEFT JOIN e ON v.k = e.k""".replace("CRC32", _CRC32),
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surveyloom.llm import prefix_trie

    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
