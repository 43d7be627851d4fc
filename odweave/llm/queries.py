"""Queries of the numbered operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from odweave.llm import byte_bpe as _bytes
from odweave.llm import embedding_dedup as _vectors
from odweave.llm import hard_negatives as _negatives
from odweave.llm import jaccard as _jaccard
from odweave.llm import line_dedup as _lines
from odweave.llm import merkle as _merkle
from odweave.llm import mpeg_audio as _mpeg
from odweave.llm import packing as _packing
from odweave.llm import substring_dedup as _substrings
from odweave.llm import token_counts as _counts
from odweave.llm import token_orc as _orc
from odweave.llm import toxicity as _toxicity
from odweave.llm import warc as _warc
from odweave.llm.bpe import vocabulary
from odweave.llm.common import arrow_ready, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _lines.line_dedup(docs)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as MPEG audio and read back."""
    arrow_ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _mpeg.digests(_mpeg.scan_column(_mpeg.media_column(docs)))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 400-byte strings that start anywhere else; after those, what goes as passages of over 50 words."""
    arrow_ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _substrings.remove_repeats(docs, passage=_substrings.PASSAGE)
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        "n_passages", "passage_bytes", F.col("without_passages").alias("text"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Texts encoded by a byte-level vocabulary and decoded again."""
    arrow_ready(spark)
    raw = vocabulary(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = _bytes.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), raw, public_tokenizers.PATTERN)
    return _bytes.decode(ids, raw, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their links of cosine 0.9 or more, and the components that these make."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return _vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Texts as tokens, cut and packed into windows of 4096."""
    arrow_ready(spark)
    raw = vocabulary(path or public_tokenizers.path("word_bpe_49k.json"))
    return _packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), raw)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored by a classifier that has learnt from four folds of the labels."""
    arrow_ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _toxicity.score(docs, model).select(
        "doc_id",
        _toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of each text, counted in flat token files."""
    arrow_ready(spark)
    raw = vocabulary(path or public_tokenizers.path("word_bpe_49k.json"))
    return _counts.documents_counted(table(spark, sf_dir, "documents").select("doc_id", "text"), raw)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the components that links of Jaccard similarity 0.75 or more make."""
    arrow_ready(spark)
    return _jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back by boundary chains."""
    arrow_ready(spark)
    records = _warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their place in a Merkle tree, and what their proofs say after some were tampered with."""
    return _merkle.verified_rows(table(spark, sf_dir, "documents").select(*_merkle.FIELDS))


def op12_token_orc(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Texts as tokens in ORC files, and what is read back from those."""
    arrow_ready(spark)
    raw = vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _orc.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), raw)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wrongly labelled vectors that score nearly as high as each anchor's positives."""
    arrow_ready(spark)
    return _negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP1_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
each AS (
  SELECT page, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages
),
counts AS (SELECT source, line, count(*) AS n FROM each WHERE trim(line, ' ') <> '' GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
bad AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n > {_lines.MAX_RATIO} * total AND n >= {_lines.MIN_PAGES}
),
split AS (SELECT page, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
                 unnest(string_split(text, chr(10))) AS line FROM pages),
marked AS (
  SELECT s.page, s.pos, s.line, b.line IS NOT NULL AS gone
  FROM split s LEFT JOIN bad b ON s.line = b.line AND s.source IS NOT DISTINCT FROM b.source
),
joined AS (
  SELECT page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY page
)
SELECT p.doc_id, p.source, j.text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped
FROM pages p LEFT JOIN joined j USING (page)
"""


#: Components by reaching along links, for a table of nodes (id) and one of links (a, b), both ways.
REACH = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP5_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {_vectors.LEAST}
),
nodes AS (SELECT id FROM good),
{REACH}
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN parts ON parts.id = e.vec_id
"""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP9_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
),
each AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.id AS a, y.id AS b FROM each x JOIN each y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
nodes AS (SELECT id FROM sets),
{REACH}
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN parts USING (id)
"""

OP10_SQL = """
WITH bodies AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
),
roles AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS main FROM bodies)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = main THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> main THEN main END AS refers_to
FROM roles
"""


OP13_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.uid <> b.uid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS place FROM scores WHERE same
  QUALIFY place <= 5
),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.uid, p.place ORDER BY n.score DESC, n.vec_id, n.other) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON p.uid = n.uid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""


def merkle_sql(levels: int = 6) -> str:
    """op11 in SQL, for groups and a number of groups of at most 16 ** levels each."""
    field = lambda x: f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in _merkle.FIELDS) + ")"
    low = f"translate(text, '{_merkle.UPPER}', '{_merkle.LOWER}')"
    step = "list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"
    out = [f"""docs AS (
  SELECT row_number() OVER () AS doc, doc_id, source, {leaf("text")} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS tampered FROM documents
),
n0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM docs
),
p0 AS (SELECT doc, doc_id, source, leaf, i, n, '' AS proof, tampered AS folded FROM n0)"""]

    def tree(nodes: str, paths: str) -> None:
        for k in range(levels):
            out.append(f"{nodes}r{k} AS (SELECT source, i // 16 AS i, n, list(h ORDER BY i) AS hs FROM {nodes}{k} GROUP BY source, i // 16, n)")
            up = "CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END"
            out.append(f"{nodes}{k + 1} AS (SELECT source, i, {up} AS h, (n + 15) // 16 AS n FROM {nodes}r{k})")
            before, behind = "array_to_string(hs[1:p.i % 16], '')", "array_to_string(hs[p.i % 16 + 2:], '')"
            out.append(f"""{paths}{k + 1} AS (
  SELECT doc, doc_id, p.source, leaf, p.i // 16 AS i, (p.n + 15) // 16 AS n, CASE WHEN p.n > 1 THEN proof || {before} || {behind} ELSE proof END AS proof,
         CASE WHEN p.n > 1 THEN sha256({before} || folded || {behind}) ELSE folded END AS folded{", subroot" * (paths == "q")}
  FROM {paths}{k} p JOIN {nodes}r{k} r ON p.source IS NOT DISTINCT FROM r.source AND p.i // 16 = r.i
)""")

    tree("n", "p")
    out.append(f"""m0 AS (
  SELECT '' AS source, source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM n{levels}
),
q0 AS (
  SELECT doc, doc_id, '' AS source, leaf, m0.i, m0.n, proof, folded, h AS subroot FROM p{levels} p JOIN m0 ON p.source IS NOT DISTINCT FROM m0.name
)""")
    tree("m", "q")
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM q{levels}, m{levels}
"""


OP11_SQL = merkle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage."""
    return {"op1_line_dedup": op1_line_dedup, "op2_mpeg_audio": op2_mpeg_audio, "op3_suffix_array_dedup": op3_suffix_array_dedup, "op4_byte_bpe": op4_byte_bpe, "op5_embedding_dedup": op5_embedding_dedup, "op6_packing": op6_packing, "op7_toxicity": op7_toxicity, "op8_token_counts": op8_token_counts, "op9_jaccard_join": op9_jaccard_join, "op10_warc": op10_warc, "op11_merkle": op11_merkle, "op12_token_orc": op12_token_orc, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return {"op1_line_dedup": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op9_jaccard_join": OP9_SQL, "op10_warc": OP10_SQL, "op11_merkle": OP11_SQL, "op13_hard_negatives": OP13_SQL}
