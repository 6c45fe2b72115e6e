"""The governed corpus: documents with review metadata, chunks, queries.

``documents_view`` and its siblings derive what the plain test tables lack, by
fixed rules, so that the same view can be written in SQL (``SQL_*`` below).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-12-31"

#: Fixed lookups of the derived columns, by remainder.
STATUS_OF_20 = ["deprecated", "archived", "superseded", "draft", "draft", "approved", "approved", "approved"]
OWNERS = ["platform-team", "security-team", "data-team", "ops-team", None]
AUTHORITIES = ["platform", "security", "standards"]
SENSITIVITIES = ["public", "internal", "restricted"]
QUERY_TERMS = [1, 2, 2, 5]
DOC_TYPES = ["guide", "runbook", "adr", "reference"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUS_OF_20]), (i % 20).cast("int")), F.lit("active"))
    url = F.when(i % 13 == 0, F.lit("javascript:alert(1)")).when(i % 13 == 1, F.lit(" ftp://files.example.com/x ")).otherwise(F.concat(F.lit("https://docs.example.com/doc-"), i.cast("string")))
    return table(spark, sf_dir, "documents").select(
        i.alias("document_id"),
        F.col("source").alias("repo"),
        F.concat(F.lit("doc-"), i.cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Document "), i.cast("string")).alias("title"),
        status.alias("status"),
        F.when(i % 11 != 0, F.date_add(F.lit("2023-01-01").cast("date"), ((i * 37) % 730).cast("int"))).alias("last_reviewed"),
        _pick(OWNERS, i).alias("owner"),
        _pick(AUTHORITIES, i).alias("authority"),
        _pick(SENSITIVITIES, i).alias("sensitivity"),
        _pick(DOC_TYPES, i).alias("doc_type"),
        url.alias("source_url"),
        F.array(F.concat(F.lit("AC-"), (i % 4).cast("string")), F.concat(F.lit("SC-"), (i % 6).cast("string"))).alias("controls"),
        F.array("lang", F.concat(F.lit("t"), (i % 7).cast("string"))).alias("tags"),
        F.when(i % 50 == 0, i + 1).alias("superseded_by"),
        F.col("text"),
    )


def chunks_view(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One chunk per line that is not blank, numbered from 0 within its document; of the documents ``only(document_id)``, if given."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return line_chunks(docs if only is None else docs.join(only, "document_id", "left_semi"))


def line_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of ``docs(document_id, text)``, with the document's ``fits`` if it has it."""
    kept = [c for c in ("fits",) if c in docs.columns]
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    # The outer form: the plain one filters on the array first, which splits each text twice.
    out = docs.select("document_id", *kept, F.posexplode_outer(lines).alias("chunk_index", "content")).where("content is not null")
    return out.select("document_id", "chunk_index", F.concat_ws("-", "document_id", "chunk_index").alias("chunk_id"), "content", *kept)


def chunk_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """A vector for every chunk, of ``chunks`` if they are written already (with their ``fits``): one of the table's, and half of another, picked by the chunk's numbers."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    c, d = F.col("chunk_index"), F.col("document_id")
    chunks = chunks_view(spark, sf_dir) if chunks is None else chunks
    kept = ["chunk_id", *[x for x in ("fits",) if x in chunks.columns]]
    own = chunks.select(*kept, ((d * 31 + c) % n).alias("a"), ((d * 7 + c * 13 + 1) % n).alias("b"))
    own = own.join(vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return own.select(*kept, F.zip_with("x", "y", lambda x, y: x.cast("double") + y.cast("double") * 0.5).alias("embedding"))


def queries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per benchmark item: its first one, two or five words as text, and the vector of the same number."""
    items = table(spark, sf_dir, "benchmark")
    terms = _pick(QUERY_TERMS, F.col("item_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), F.lit(1), terms)
    return items.join(vectors, "item_id").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"), "query_vector")


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


SQL_DOCUMENTS = f"""docs AS (
  SELECT doc_id AS document_id, source AS repo, 'doc-' || doc_id || '.md' AS path, 'Document ' || doc_id AS title,
    coalesce({sql_list(STATUS_OF_20)}[(doc_id % 20 + 1)::INT], 'active') AS status,
    CASE WHEN doc_id % 11 <> 0 THEN DATE '2023-01-01' + ((doc_id * 37) % 730)::INT END AS last_reviewed,
    {sql_list(OWNERS)}[(doc_id % 5 + 1)::INT] AS owner, {sql_list(AUTHORITIES)}[(doc_id % 3 + 1)::INT] AS authority,
    {sql_list(SENSITIVITIES)}[(doc_id % 3 + 1)::INT] AS sensitivity, {sql_list(DOC_TYPES)}[(doc_id % 4 + 1)::INT] AS doc_type,
    CASE WHEN doc_id % 13 = 0 THEN 'javascript:alert(1)' WHEN doc_id % 13 = 1 THEN ' ftp://files.example.com/x ' ELSE 'https://docs.example.com/doc-' || doc_id END AS source_url,
    ['AC-' || (doc_id % 4), 'SC-' || (doc_id % 6)] AS controls, [lang, 't' || (doc_id % 7)] AS tags,
    CASE WHEN doc_id % 50 = 0 THEN doc_id + 1 END AS superseded_by, text
  FROM documents)"""

SQL_CHUNKS = """raw_lines AS (
  SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
chunks AS (
  SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY n) - 1)::INT AS chunk_index,
    document_id || '-' || (row_number() OVER (PARTITION BY document_id ORDER BY n) - 1) AS chunk_id, content
  FROM raw_lines WHERE trim(content, ' ') <> '')"""

SQL_VECTORS = """n_vectors AS (SELECT count(*) AS n FROM embeddings),
vec AS (
  SELECT chunk_id, document_id, list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE + z[2]::DOUBLE * 0.5) AS v
  FROM (SELECT chunk_id, document_id, (document_id * 31 + chunk_index) % n AS a, (document_id * 7 + chunk_index * 13 + 1) % n AS b FROM chunks CROSS JOIN n_vectors)
  JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b)"""

SQL_QUERIES = f"""queries AS (
  SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:{QUERY_TERMS}[(item_id % {len(QUERY_TERMS)} + 1)::INT]], ' ') AS query, embedding AS query_vector
  FROM benchmark JOIN embeddings ON vec_id = item_id)"""
