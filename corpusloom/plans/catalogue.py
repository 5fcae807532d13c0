"""Catalogue of the engine's queries over the driver's tables, each with its SQL.

A query takes (spark, folder of tables) and returns a DataFrame; the SQL beside
it is what an independent engine runs on the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids, jsonx, text
from corpusloom.functions import vectors as V
from corpusloom.operators import languages as languages_
from corpusloom.operators import answer, chunking, entities, graph, kg, patterns, search, similarity, tables, text_index, vector_index
from corpusloom.plans import runner
from corpusloom.schemas import ChunkOptions
from corpusloom.sources import files, keyed
from corpusloom.streaming import flows, health

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _char_embed(text: Column, dims: int = 8) -> Column:
    """Embedder that SQL can repeat: code points of the first characters modulo 13."""
    padded = F.rpad(F.coalesce(text, F.lit("")), dims, " ")
    return F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.ascii(F.substring(padded, i, F.lit(1))) % 13) / 13.0)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("series"), F.col("doc_id").cast("string").alias("filename"), "text", "doc_id")


# --- chunking ---------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _stripped(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {_STRIP.format('p')}), lambda p: p <> '')"


def _packed(parts: str, size: str, overlap: str, extra: str = "") -> str:
    """CTEs that pack ``parts`` of documents into chunks."""
    return f"""
parts AS (SELECT source AS series, CAST(doc_id AS VARCHAR) AS filename, {size} AS size, {overlap} AS ov, {parts} AS p FROM documents{extra}),
packed AS (SELECT series, filename, ov, CASE WHEN len(p) = 0 THEN NULL ELSE list_reduce(list_transform(p, lambda x: {{'buf': x, 'out': []::VARCHAR[]}}),
  lambda a, x: CASE WHEN length(a.buf) + length(x.buf) + 1 <= size THEN {{'buf': a.buf || ' ' || x.buf, 'out': a.out}} ELSE {{'buf': x.buf, 'out': list_append(a.out, a.buf)}} END) END AS r FROM parts),
joined AS (SELECT series, filename, ov, CASE WHEN r IS NULL THEN [] ELSE list_append(r.out, r.buf) END AS c FROM packed),
chunks AS (SELECT series, filename, CASE WHEN len(c) = 0 THEN [] ELSE list_reduce(list_transform(c, lambda x: [x]),
  lambda o, x: list_append(o, {_STRIP.format("(CASE WHEN length(o[-1]) > ov THEN right(o[-1], ov) ELSE o[-1] END || ' ' || x[1])")})) END AS c FROM joined),
each AS (SELECT series, filename, i - 1 AS idx, c[i] AS text FROM chunks, unnest(generate_series(1, len(c))) AS u(i))
"""


_EACH = "SELECT series, filename, CAST(idx AS INT) AS idx, series || ':' || filename || ':' || idx AS cid, length(text) AS n_chars, md5(text) AS digest FROM each"
_SENTENCES = _stripped(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")
_PARAGRAPHS = _stripped(r"regexp_split_to_array(text, '\n{2,}')")
_LINES = _stripped(r"regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]')")


def _chunks(spark: SparkSession, sf_dir: str, o: ChunkOptions) -> DataFrame:
    c = chunking.document_chunks(_documents(spark, sf_dir), o)
    return c.select("series", "filename", "idx", "cid", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_packed(_SENTENCES, '800', '150')} {_EACH}")
def chunk_sentence(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("sentence"))


@query(f"WITH {_packed(_PARAGRAPHS, '800', '150')} {_EACH}")
def chunk_paragraph(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("paragraph"))


@query(f"WITH {_packed(_LINES, '800', '150')} {_EACH}")
def chunk_line(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("line"))


@query(
    f"""WITH w AS (SELECT source AS series, CAST(doc_id AS VARCHAR) AS filename, {_stripped("list_transform(generate_series(0, length(text) - 1, 650), lambda i: substring(text, i + 1, 800))")} AS c FROM documents),
each AS (SELECT series, filename, i - 1 AS idx, c[i] AS text FROM w, unnest(generate_series(1, len(c))) AS u(i)) {_EACH}"""
)
def chunk_char(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("char"))


_WORD_SQL = rf"""WITH w AS (SELECT source AS series, CAST(doc_id AS VARCHAR) AS filename, regexp_extract_all(text, '\S+') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) <= {{size}} THEN least(len(w), 1) ELSE CAST(ceil((len(w) - {{size}}) / {{step}}.0) AS BIGINT) + 1 END AS k FROM w),
each AS (SELECT series, filename, i AS idx, array_to_string(w[i * {{step}} + 1 : i * {{step}} + {{size}}], ' ') AS text FROM n, unnest(generate_series(0, k - 1)) AS u(i)) {_EACH}"""


@query(_WORD_SQL.format(size=120, step=100))
def chunk_word(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("word", 120, 20))


@query(_WORD_SQL.format(size=600, step=520))
def chunk_tokens(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("tokens", 600, 80))


def _recursive_sql(source: str, size: int) -> str:
    """One step per separator: split unless the pieces are short enough already."""
    out, last = "", source
    for k, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "'.'", "'•'", "'،'")):
        split = f"list_filter(flatten(list_transform(p, lambda x: string_split(x, {sep}))), lambda x: x <> '')"
        out += f"r{k} AS (SELECT * EXCLUDE (p, done), CASE WHEN done THEN p ELSE {split} END AS p, done FROM {last}), s{k} AS (SELECT * EXCLUDE (done), done OR coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) / greatest(len(p), 1) <= {size} * 1.2 AS done FROM r{k}), "
        last = f"s{k}"
    return out + f"documents2 AS (SELECT source, doc_id, p FROM {last}), "


_RECURSIVE = "WITH r AS (SELECT source, doc_id, CASE WHEN text = '' THEN [] ELSE [text] END AS p, false AS done FROM documents), " + _recursive_sql("r", 800)


@query(_RECURSIVE + _packed(_stripped("p"), "800", "150").replace("FROM documents)", "FROM documents2)") + _EACH)
def chunk_recursive(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("recursive"))


_SUGGEST = """CASE WHEN contains(text, '|') OR (contains(text, ',') AND contains(text, chr(10)) AND length(text) / (nl + 1) > 40) OR bullets > 10 OR nl > 20 THEN 'paragraph' WHEN length(text) < 2000 THEN 'sentence' ELSE 'recursive' END"""


@query(
    f"""WITH c AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS nl, length(text) - length(replace(text, '•', '')) + (length(text) - length(replace(text, '- ', ''))) / 2 AS bullets FROM documents),
s AS (SELECT *, {_SUGGEST} AS strategy FROM c)
SELECT doc_id, strategy, CAST(CASE strategy WHEN 'paragraph' THEN least(1000, greatest(400, length(text) // 50)) WHEN 'sentence' THEN 600 ELSE 800 END AS INT) AS size, CAST(CASE strategy WHEN 'paragraph' THEN 100 WHEN 'sentence' THEN 120 ELSE 150 END AS INT) AS overlap FROM s"""
)
def chunk_suggestion(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.suggest("text").alias("s")).select("doc_id", "s.*")


@query(
    f"""WITH c AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS nl, length(text) - length(replace(text, '•', '')) + (length(text) - length(replace(text, '- ', ''))) / 2 AS bullets FROM documents),
s AS (SELECT *, {_SUGGEST} AS strategy FROM c),
r AS (SELECT source, doc_id, CASE WHEN text = '' THEN [] ELSE [text] END AS p, false AS done FROM s WHERE strategy = 'recursive'), {_recursive_sql("r", 800)}
p3 AS (SELECT source, doc_id, 800 AS size, 150 AS ov, {_stripped("p")} AS p FROM documents2
  UNION ALL SELECT source, doc_id, 600, 120, {_SENTENCES} FROM s WHERE strategy = 'sentence'
  UNION ALL SELECT source, doc_id, least(1000, greatest(400, length(text) // 50)), 100, {_PARAGRAPHS} FROM s WHERE strategy = 'paragraph'),
{_packed("p", "size", "ov").replace("FROM documents)", "FROM p3)")} {_EACH}"""
)
def chunk_llm(spark, sf_dir):
    return _chunks(spark, sf_dir, ChunkOptions("llm"))


@query(
    f"""WITH {_packed(_SENTENCES, '800', '150')}
SELECT series, filename, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(max(length(text)) AS INT) AS longest FROM each GROUP BY series, filename"""
)
def chunk_report(spark, sf_dir):
    return chunking.report(chunking.document_chunks(_documents(spark, sf_dir)))


_TOKENS = r"CASE WHEN text = '' THEN 0 ELSE CAST(floor(len(regexp_extract_all(text, '\S+')) * {0}) AS INT) + 1 END"


@query(f"SELECT doc_id, CAST({_TOKENS.format(1.33)} AS INT) AS approx, CAST({_TOKENS.format('2.0')} AS INT) AS gemini, CAST({_TOKENS.format(1.5)} AS INT) AS other FROM documents")
def token_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.count_tokens("text", "openai").alias("approx"), text.count_tokens("text", "gemini").alias("gemini"), text.count_tokens("text").alias("other"))


@query(
    r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
w AS (SELECT doc_id, text, i, s[i] AS x, len(regexp_extract_all(s[i], '\S+')) AS n FROM s, unnest(generate_series(1, len(s))) AS u(i)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM c WHERE floor(total * 1.33) + 1 <= 64 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN floor(len(regexp_extract_all(text, '\S+')) * 1.33) + 1 <= 64 THEN text WHEN coalesce(kept, '') = '' THEN substring(text, 1, 230) ELSE kept END) AS digest FROM documents LEFT JOIN k USING (doc_id)"""
)
def token_fit(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.fit("text", 64).cast("binary")).alias("digest"))


# --- identifiers and text functions -----------------------------------------


@query("SELECT p_partkey, substr(sha1(array_to_string(list_filter([lower(trim(p_brand)), lower(trim(p_name)), lower(trim(p_type))], lambda x: x <> ''), '::')), 1, 16) AS id FROM part")
def stable_ids(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", ids.node_id(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("id"))


_SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\- _]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g')"


@query(f"""WITH s AS (SELECT c_custkey, c_mktsegment AS t, coalesce(nullif(substr({_SLUG.format("c_name")}, 1, 128), ''), 'x') AS s FROM customer) SELECT c_custkey, 'tpch:' || t || ':' || s || ':' || substr(sha1('tpch|' || t || '|' || s), 1, 16) AS id FROM s""")
def slug_ids(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", ids.entity_id(F.lit("tpch"), F.col("c_mktsegment"), F.col("c_name")).alias("id"))


_FP = r"substr(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: length(x) > 2), ' '), 1, 64)"


@query(f"SELECT fp, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, {_FP} AS fp FROM part) WHERE fp <> '' GROUP BY fp")
def fingerprint_blocks(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", ids.fingerprint(F.col("p_name")).alias("fp"))
    return p.where("fp <> ''").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT sha1(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL")
def distinct_texts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.lang = d.lang AND o.source = d.source AND sha1(o.text) = sha1(d.text))")
def incremental_skip(spark, sf_dir):
    """Documents whose (series, file, text) the rows with ids divisible by three did not bring before; a language is a series."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("series"), F.col("source").alias("filename"), "text")
    done = d.where("doc_id % 3 = 0").select("series", "filename", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return chunking.fresh(d, done).select("doc_id")


@query(r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages")
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(files.html_text(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def event_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    p = jsonx.parse(F.col("props"), "page STRING, ref STRING")
    return e.select("event_id", p["page"].alias("page"), p["ref"].alias("ref"))


@query(
    r"""WITH f AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS filename, length(html) AS size FROM pages),
e AS (SELECT *, lower(regexp_extract(filename, '(\.[^./\\]+)$', 1)) AS ext FROM f)
SELECT page_id, filename, CASE WHEN ext NOT IN ('.txt', '.html', '') THEN 'extension not allowed' WHEN size = 0 THEN 'empty file' WHEN size > 3000 THEN 'file too large' END AS reason FROM e"""
)
def import_validation(spark, sf_dir):
    f = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([^/]*)$", 1).alias("filename"), F.length("html").alias("size"))
    return files.classify(f, (".txt", ".html", ""), 3000).select("page_id", "filename", "reason")


@query("""WITH r AS (SELECT p_partkey // 200 AS "order", p_partkey, 'p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_brand: ' || p_brand AS line FROM part) SELECT 'part' AS series, CAST("order" AS INT) AS "order", md5(string_agg(line, chr(10) ORDER BY p_partkey)) AS digest FROM r GROUP BY "order" """)
def table_blocks(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return files.table_blocks(p, "p_partkey", 200, "part").select("series", "order", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH s AS (SELECT source AS series, CAST(doc_id % 50 AS VARCHAR) || '.txt' AS filename, doc_id AS seq FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY series, filename ORDER BY seq) - 1 AS k FROM s) SELECT series, seq, CASE WHEN k = 0 THEN filename ELSE replace(filename, '.txt', '__' || k || '.txt') END AS stored_name FROM n")
def collision_names(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("series"), F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("filename"), F.col("doc_id").alias("seq"))
    return tables.collision_names(d).select("series", "seq", "stored_name")


# --- vectors and lexical retrieval -------------------------------------------

_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"SELECT e.vec_id AS id, round({_COS.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 10")
def cosine_top_k(spark, sf_dir):
    """Top-k of one query vector: the report is the ten best."""
    e = _vectors(spark, sf_dir)
    q = e.where("id = 0").select("embedding").head()["embedding"]
    return search.vector_top_k(e, q, 10).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def cosine_join(spark, sf_dir):
    """Every twentieth vector searched against all of them."""
    e = _vectors(spark, sf_dir)
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.vector_join(e, q, 5).withColumn("score", F.round("score", 6))


@query(
    """WITH p AS (SELECT vec_id AS id, embedding AS a, embedding[1:32] AS b, label FROM embeddings)
SELECT id, round(list_cosine_similarity(CAST(a[1:32] AS DOUBLE[]), CAST(b AS DOUBLE[])), 6) AS truncated, CAST(0 AS DOUBLE) AS zero, round((1 + list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(list_reverse(a) AS DOUBLE[]))) / 2, 6) AS rescaled FROM p"""
)
def cosine_variants(spark, sf_dir):
    """Unequal lengths, zero norm and the rescaled score."""
    e = _vectors(spark, sf_dir)
    a = F.col("embedding")
    zero = F.transform(a, lambda x: F.lit(0.0))
    return e.select("id", F.round(V.cosine(a, F.slice(a, 1, 32), truncate=True), 6).alias("truncated"), V.cosine(a, zero).alias("zero"), F.round(V.rescaled(V.cosine(a, F.reverse(a))), 6).alias("rescaled"))


_HASH_VEC = "list_transform(generate_series(0, 383), lambda i: (CAST('0x' || substr(sha256({0}), (i % 32) * 2 + 1, 2) AS INT) - 128) / 128.0)"


@query(
    f"""WITH v AS (SELECT doc_id AS id, {_HASH_VEC.format('text')} AS v FROM documents), q AS (SELECT {_HASH_VEC.format("'which text is this'")} AS q),
s AS (SELECT id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM v, q)
SELECT id, round(s, 6) AS score FROM s ORDER BY s DESC, id LIMIT 10"""
)
def hash_embed_search(spark, sf_dir):
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), V.hash_embed()(F.col("text")).alias("embedding"))
    return search.vector_top_k(d, V.hash_vector("which text is this").tolist(), 10).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH w AS (SELECT p_partkey AS id, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 2)) AS t FROM part), q AS (SELECT list_distinct(list_filter(string_split(lower('the red widget and ring'), ' '), lambda x: length(x) > 2)) AS q)
SELECT id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM w, q"""
)
def keyword_overlap(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(V.keyword_overlap(F.col("p_name"), F.lit("the red widget and ring")), 6).alias("score"))


@query(
    """WITH n AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_type AS d, round(p_size / 50.0, 4) AS conf FROM part)
SELECT id, conf, round(CAST(contains(lower(name), 'red') OR contains(lower(d), 'red') AS INT) + CAST(contains(lower(name), 'widget') OR contains(lower(d), 'widget') AS INT) + conf, 6) AS score FROM n WHERE contains(lower(name), 'red') OR contains(lower(name), 'widget') ORDER BY 3 DESC, id LIMIT 30"""
)
def keyword_nodes(spark, sf_dir):
    n = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("desc"), F.lit(None).cast("array<string>").alias("aliases"), F.round(F.col("p_size") / 50.0, 4).alias("conf"))
    return search.keyword_top_n(n, "Red widget", 30).select("id", "conf", F.round("score", 6).alias("score"))


@query(
    """WITH t AS (SELECT p_partkey AS id, unnest(list_filter(regexp_split_to_array(lower(replace(p_type || ' ' || p_brand, '-', ' ')), '\\s+'), lambda x: x <> '')) AS token FROM part), c AS (SELECT id, token, count(*) AS n FROM t GROUP BY ALL),
z AS (SELECT id, sum(n) AS size FROM c GROUP BY id), b AS (SELECT a.id AS mention_id, x.id, sum(least(a.n, x.n)) AS both FROM c a JOIN c x USING (token) WHERE a.id % 20 = 0 GROUP BY ALL),
s AS (SELECT mention_id, b.id, both / (za.size + zx.size - both) AS score FROM b JOIN z za ON za.id = mention_id JOIN z zx ON zx.id = b.id)
SELECT mention_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 20""".replace("both", "shared")
)
def multiset_jaccard(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return search.multiset_jaccard(p, p.where("id % 20 = 0").withColumnRenamed("id", "mention_id")).withColumn("score", F.round("score", 6))


@query(f"SELECT mention_id, id AS winner, score FROM ({ORACLE_SQL['multiset_jaccard']}) WHERE rank = 1 AND score >= 0.55")
def similar_names(spark, sf_dir):
    """Every twentieth part's best catalogue row by a threshold join: the winners that ``best_or_none`` gives at 0.55."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    found = similarity.join(p, p.where("id % 20 = 0").withColumnRenamed("id", "mention_id"))
    return search.best_or_none(found).select("mention_id", "winner", F.round("score", 6).alias("score"))


_BM25_TERMS = ["the", "que", "der"]


@query(
    r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), q AS (SELECT unnest(['the', 'que', 'der']) AS w),
f AS (SELECT id, len(t) AS n, w, len(list_filter(t, lambda x: x = w)) AS tf FROM t, q), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), d AS (SELECT w, count(*) AS df FROM f WHERE tf > 0 GROUP BY w),
r AS (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM f JOIN d USING (w), s WHERE tf > 0 GROUP BY id)
SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 10"""
)
def bm25_top_k(spark, sf_dir):
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return search.bm25(d, _BM25_TERMS, 10).withColumn("score", F.round("score", 6))


_TEXT_QUERIES = {"articles": ["the", "que", "der"], "notices": ["license", "copyright", "rights"], "rare": ["und", "les", "nosuchtoken"]}


@query(
    rf"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents WHERE doc_id % 11 <> 5), q AS (SELECT unnest({[n for n, ws in _TEXT_QUERIES.items() for _ in ws]}) AS query, unnest({[w for ws in _TEXT_QUERIES.values() for w in ws]}) AS w),
x AS (SELECT id, len(t) AS n, unnest(t) AS w FROM t), f AS (SELECT id, n, w, count(*) AS tf FROM x SEMI JOIN q USING (w) GROUP BY ALL), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), d AS (SELECT w, count(*) AS df FROM f GROUP BY w),
r AS (SELECT query, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM f JOIN d USING (w) JOIN q USING (w), s GROUP BY query, id)
SELECT query, id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10"""
)
def text_index_search(spark, sf_dir):
    """Three queries against a stored text index: built with some texts that are replaced later, extended, thinned, merged and reopened; the report is the ten best of each."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    path = _folder(spark, "texts")
    early = d.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 10 == 1, "the license of the que und").otherwise(F.col("text")))
    index = text_index.TextIndex.build(early, path).upsert(d.where("id % 3 = 0 OR id % 10 = 1"))
    index.delete(d.where("id % 11 = 5").select("id")).merge()
    index, out = text_index.TextIndex(spark, path), None
    for name, words in _TEXT_QUERIES.items():
        hits = index.search(words, 10).select(F.lit(name).alias("query"), "id", F.round("score", 6).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _vectors(spark, sf_dir)
    one = e.select("id", (F.col("label") / 10).alias("score")).where("score >= 0.3")
    two = e.select("id", (F.col("id") % 7 / 7).alias("score")).where("score >= 0.2")
    return one, two


#: Hits of two searches over all vectors: those that reach the threshold of each.
_HITS = "WITH one AS (SELECT vec_id AS id, label / 10 AS score FROM embeddings WHERE label / 10 >= 0.3), two AS (SELECT vec_id AS id, vec_id % 7 / 7 AS score FROM embeddings WHERE vec_id % 7 / 7 >= 0.2)"


@query(f"{_HITS}, s AS (SELECT id, round(coalesce(0.6 * one.score, 0) + coalesce(0.4 * two.score, 0), 9) AS score FROM one FULL JOIN two USING (id)) SELECT id, round(score, 6) AS score FROM s")
def hybrid_fusion(spark, sf_dir):
    one, two = _hits(spark, sf_dir)
    return search.hybrid(one, two, 1 << 30).select("id", F.round("score", 6).alias("score"))


@query(f"{_HITS} SELECT id, round(coalesce(one.score, 0), 6) AS prior, round(coalesce(two.score, 0), 6) AS dense, round(0.5 * coalesce(one.score, 0) + 0.5 * coalesce(two.score, 0), 6) AS score FROM one FULL JOIN two USING (id)")
def candidate_merge(spark, sf_dir):
    one, two = _hits(spark, sf_dir)
    m = search.merge_candidates(one, two, 1 << 30)
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("prior", "dense", "score")])


@query("""WITH c AS (SELECT label AS mention_id, vec_id AS id, vec_id % 97 / 97 AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS k FROM c)
SELECT mention_id, max(CASE WHEN k = 1 AND score >= 0.55 THEN id END) AS winner, round(max(CASE WHEN k = 1 THEN score END), 6) AS score, string_agg(id, ',' ORDER BY k) AS kept FROM r WHERE k <= 5 GROUP BY mention_id""")
def best_or_none(spark, sf_dir):
    c = _vectors(spark, sf_dir).select(F.col("label").alias("mention_id"), "id", (F.col("id") % 97 / 97).alias("score"))
    b = search.best_or_none(c)
    return b.select("mention_id", "winner", F.round("score", 6).alias("score"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


# --- graph -------------------------------------------------------------------


def tpch_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and customers as nodes; where they lie as edges."""
    r, n, s, c = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))

    def node(df: DataFrame, prefix: str, key: str, name: str, kind: str, conf: Column) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit("tpch").alias("series"), F.col(name).alias("name"), F.lit(kind).alias("type"), conf.alias("conf"))

    nodes = node(r, "r", "r_regionkey", "r_name", "region", F.lit(1.0)).unionByName(node(n, "n", "n_nationkey", "n_name", "nation", F.lit(0.9))).unionByName(node(s, "s", "s_suppkey", "s_name", "supplier", F.col("s_suppkey") % 10 / 10.0)).unionByName(node(c, "c", "c_custkey", "c_name", "customer", F.col("c_custkey") % 8 / 8.0))

    def edge(df: DataFrame, a: str, key: str, b: str, to: str, pred: str, conf: Column) -> DataFrame:
        src, dst = F.concat(F.lit(a), F.col(key)), F.concat(F.lit(b), F.col(to))
        return df.select(F.concat(src, F.lit(">"), dst).alias("id"), F.lit("tpch").alias("series"), src.alias("src_id"), dst.alias("dst_id"), F.lit(pred).alias("pred"), conf.alias("conf"))

    edges = edge(n, "n", "n_nationkey", "r", "n_regionkey", "part_of", F.lit(0.8)).unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey", "located_in", F.col("s_suppkey") % 7 / 7.0)).unionByName(edge(c, "c", "c_custkey", "n", "c_nationkey", "lives_in", F.col("c_custkey") % 5 / 5.0))
    return nodes, edges


_GRAPH = """nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS type, 1.0::DOUBLE AS conf FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', 0.9 FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', s_suppkey % 10 / 10.0 FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, 'customer', c_custkey % 8 / 8.0 FROM customer),
edges AS (SELECT 'n' || n_nationkey AS src_id, 'r' || n_regionkey AS dst_id, 'part_of' AS pred, 0.8::DOUBLE AS conf FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', s_suppkey % 7 / 7.0 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in', c_custkey % 5 / 5.0 FROM customer)"""


@query(
    f"""WITH {_GRAPH}, s AS (SELECT a.src_id AS s, a.dst_id AS n, b.src_id AS c FROM edges a JOIN edges b ON b.dst_id = a.dst_id AND b.pred = 'lives_in' WHERE a.pred = 'located_in' AND a.conf >= 0.5),
w AS (SELECT src_id AS x, dst_id AS r, 1 AS hops FROM edges WHERE pred IN ('part_of', 'located_in') UNION ALL SELECT a.src_id, b.dst_id, 2 FROM edges a JOIN edges b ON a.dst_id = b.src_id WHERE a.pred IN ('part_of', 'located_in') AND b.pred IN ('part_of', 'located_in')),
u AS (SELECT x.src_id AS a, x.dst_id AS n, y.src_id AS b FROM edges x JOIN edges y ON x.dst_id = y.dst_id AND x.src_id <> y.src_id WHERE x.pred = 'part_of' AND y.pred = 'part_of')
SELECT 'near' AS pattern, s AS a, n AS b, c, 2 AS hops FROM s JOIN nodes ON id = c AND nodes.conf >= 0.75 AND type = 'customer'
UNION ALL SELECT 'within', x, r, NULL, hops FROM w JOIN nodes ON id = r AND name = 'ASIA'
UNION ALL SELECT 'siblings', a, n, b, 2 FROM u"""
)
def graph_patterns(spark, sf_dir):
    """Customers of a supplier's nation, everything within a region up to two edges away, and nations of one region by edges in either direction."""
    nodes, edges = tpch_graph(spark, sf_dir)
    n, e = patterns.Node, patterns.Edge
    near = patterns.match(nodes, edges, n("a"), e(("located_in",), where=F.col("conf") >= 0.5), n("b"), e(("lives_in",), "in"), n("c", (F.col("type") == "customer") & (F.col("conf") >= 0.75)))
    within = patterns.match(nodes, edges, n("a"), e(("part_of", "located_in"), hops=(1, 2), name="walk"), n("b", F.col("name") == "ASIA"))
    siblings = patterns.match(nodes, edges, n("a"), e(("part_of",), "any"), n("b", F.col("type") == "region"), e(("part_of",), "any"), n("c"))
    rows = lambda df, name, hops: df.select(F.lit(name).alias("pattern"), "a", "b", F.col("c") if "c" in df.columns else F.lit(None).cast("string").alias("c"), hops.alias("hops"))
    return rows(near, "near", F.lit(2)).unionByName(rows(within, "within", F.size("walk"))).unionByName(rows(siblings, "siblings", F.lit(2)))


@query(f"WITH {_GRAPH} SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id")
def degrees(spark, sf_dir):
    return graph.degree(tpch_graph(spark, sf_dir)[1])


@query("SELECT 'p' || l_partkey AS id, 'sells' AS pred, round(1 - l_discount, 6) AS weight FROM lineitem WHERE l_suppkey = 7")
def neighbours(spark, sf_dir):
    """What supplier 7 sells, one row for each sale."""
    sales = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst_id"), F.lit("sells").alias("pred"), (1 - F.col("l_discount")).alias("conf"))
    return graph.neighbours(sales, "s7").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_GRAPH}, half AS (SELECT * FROM edges WHERE conf >= 0.3) SELECT id, type FROM nodes WHERE id NOT IN (SELECT src_id FROM half UNION SELECT dst_id FROM half)")
def isolated_nodes(spark, sf_dir):
    nodes, edges = tpch_graph(spark, sf_dir)
    return graph.isolated(nodes, edges.where("conf >= 0.3")).select("id", "type")


@query(f"""WITH {_GRAPH}, e AS (SELECT * FROM edges WHERE conf >= 0.3), n AS (SELECT *, CASE WHEN type = 'supplier' AND conf = 0.4 THEN 'other' ELSE 'tpch' END AS series FROM nodes WHERE conf >= 0.2 UNION ALL SELECT *, 'tpch' FROM nodes WHERE type = 'supplier' AND conf = 0.5)
SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM e) AS relations, (SELECT count(*) FROM n WHERE id NOT IN (SELECT src_id FROM e UNION SELECT dst_id FROM e)) AS isolated,
(SELECT count(*) FROM e JOIN n a ON a.id = src_id JOIN n b ON b.id = dst_id WHERE a.series <> 'tpch' OR b.series <> 'tpch') AS off_series,
(SELECT count(*) FROM (SELECT id FROM n GROUP BY id HAVING count(*) > 1)) AS duplicate_ids, (SELECT count(*) FROM e WHERE src_id NOT IN (SELECT id FROM n)) AS orphans""")
def graph_quality(spark, sf_dir):
    """Counts over a graph that breaks each rule: some suppliers are of another series, some are there twice."""
    nodes, edges = tpch_graph(spark, sf_dir)
    some = lambda conf: (F.col("type") == "supplier") & (F.col("conf") == conf)
    broken = nodes.where("conf >= 0.2").withColumn("series", F.when(some(0.4), "other").otherwise(F.col("series"))).unionByName(nodes.where(some(0.5)))
    return kg.quality(broken, edges.where("conf >= 0.3"))


@query(
    f"""WITH RECURSIVE {_GRAPH}, n AS (SELECT id, conf FROM nodes WHERE conf >= 0.05), e0 AS (SELECT src_id || '>' || dst_id AS eid, * FROM edges WHERE conf >= 0.05),
e AS (SELECT eid, src_id AS u, dst_id AS v, conf FROM e0 UNION ALL SELECT eid, dst_id, src_id, conf FROM e0),
seeds AS (SELECT 's' || s_suppkey AS id, s_suppkey AS rank FROM supplier),
w AS (SELECT n.id AS src, s.rank AS sr, n.id AS at, [n.id] AS path, []::VARCHAR[] AS used, n.conf AS total, 0 AS hops FROM seeds s JOIN n ON n.id = s.id
 UNION ALL SELECT w.src, w.sr, e.v, list_append(w.path, e.v), list_append(w.used, e.eid), w.total + e.conf + n.conf, w.hops + 1 FROM w JOIN e ON e.u = w.at JOIN n ON n.id = e.v WHERE w.hops < 3 AND NOT list_contains(w.used, e.eid)),
f AS (SELECT w.src, s.id AS dst, hops, used, pow(0.8, hops - 1) * total / (2 * hops + 1) AS score FROM w JOIN seeds s ON s.id = w.at WHERE hops > 0 AND w.sr < s.rank)
SELECT src, dst, CAST(hops AS INT) AS length, array_to_string(used, '|') AS edges, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY round(score, 12) DESC, hops, array_to_string(used, '|')) <= 6"""
)
def bounded_trails(spark, sf_dir):
    """Best six trails of at most three edges between each two seeds."""
    nodes, edges = tpch_graph(spark, sf_dir)
    seeds = nodes.where("type = 'supplier'").select("id", F.substring("id", 2, 20).cast("int").alias("rank"))
    t = graph.trails(nodes, edges, seeds, k=None, checkpoint=_rounds(spark))
    return t.select("src", "dst", "length", F.array_join("edges", "|").alias("edges"), F.round("score", 6).alias("score"))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities of customers at level 0, regions at level 1."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    one = lambda level, cid: j.select(F.lit("tpch").alias("series"), F.lit(level).alias("level"), cid.alias("cid"), F.concat(F.lit("c"), F.col("c_custkey")).alias("entity_id"))
    return one(0, F.col("n_name")).unionByName(one(1, F.concat(F.lit("R"), F.col("n_regionkey"))))


_MEMBERS = "m AS (SELECT 0 AS level, n_name AS cid, 'c' || c_custkey AS entity_id FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 1, 'R' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"WITH {_MEMBERS} SELECT 'tpch' AS series, CAST(a.level AS INT) AS lo_level, a.cid AS lo_cid, CAST(b.level AS INT) AS hi_level, b.cid AS hi_cid, count(*) AS overlap FROM m a JOIN m b USING (entity_id) WHERE b.level = a.level + 1 GROUP BY ALL")
def community_overlap(spark, sf_dir):
    return graph.hierarchy(_membership(spark, sf_dir))


@query(f"WITH {_MEMBERS} SELECT 'tpch' AS series, CAST(level AS INT) AS level, count(DISTINCT cid) AS communities, count(*) AS memberships FROM m GROUP BY level")
def community_stats(spark, sf_dir):
    return _membership(spark, sf_dir).groupBy("series", "level").agg(F.countDistinct("cid").alias("communities"), F.count(F.lit(1)).alias("memberships"))


_ORDER_EDGES = "o AS (SELECT 'c' || o_custkey AS u, 'c' || (1 + (o_custkey * 7 + o_orderkey) % (SELECT max(c_custkey) FROM customer)) AS v, o_totalprice / 1000000 AS w FROM orders)"


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _table(spark, sf_dir, "customer").agg(F.max("c_custkey")).head()[0]
    o = _table(spark, sf_dir, "orders")
    src = F.concat(F.lit("c"), F.col("o_custkey"))
    dst = F.concat(F.lit("c"), 1 + (F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.lit(top))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("tpch").alias("series"), src.alias("src_id"), dst.alias("dst_id"), F.lit("buys_like").alias("pred"), (F.col("o_totalprice") / 1000000).alias("conf"))


@query(
    f"""WITH {_MEMBERS}, {_ORDER_EDGES}, i AS (SELECT a.level, sum(CASE WHEN a.cid = b.cid THEN w ELSE 0 END) AS inside, sum(w) AS t FROM o JOIN m a ON a.entity_id = u JOIN m b ON b.entity_id = v AND b.level = a.level GROUP BY a.level),
k AS (SELECT id, sum(w) AS k FROM (SELECT u AS id, w FROM o UNION ALL SELECT v, w FROM o) GROUP BY id), s AS (SELECT level, cid, sum(k) AS k FROM m JOIN k ON k.id = entity_id GROUP BY ALL), q AS (SELECT level, sum(k * k) AS k2, count(*) AS communities FROM s GROUP BY level)
SELECT 'tpch' AS series, CAST(level AS INT) AS level, communities, round(inside / t - k2 / (4 * t * t), 6) AS modularity FROM i JOIN q USING (level)"""
)
def modularity(spark, sf_dir):
    return graph.modularity(_order_edges(spark, sf_dir), _membership(spark, sf_dir)).withColumn("modularity", F.round("modularity", 6))


@query(
    f"""WITH {_MEMBERS}, {_ORDER_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM o UNION ALL SELECT v FROM o) GROUP BY id)
SELECT CAST(level AS INT) AS level, cid, entity_id, coalesce(degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY level, cid ORDER BY coalesce(degree, 0) DESC, entity_id) AS INT) AS rank FROM m LEFT JOIN d ON d.id = entity_id QUALIFY rank <= 5"""
)
def community_top_members(spark, sf_dir):
    nodes, _ = tpch_graph(spark, sf_dir)
    return graph.top_members(_membership(spark, sf_dir), nodes, _order_edges(spark, sf_dir), 5).select("level", "cid", "entity_id", "degree", "rank")


@query("""WITH g AS (SELECT p_partkey // 4 AS g, 'p' || p_partkey AS id FROM part), n AS (SELECT *, min(id) OVER (PARTITION BY g) AS cid FROM g)
SELECT 'tpch' AS series, CAST(level AS INT) AS level, cid, id AS entity_id FROM n, (VALUES (0), (1)) AS l(level)""")
def communities(spark, sf_dir):
    """Four parts each are all linked, and five such groups hang together by weak edges: the communities are the groups."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 4).alias("g"))
    inside = p.join(p.withColumnRenamed("k", "to"), "g").where("k < to").select("k", "to", F.lit(1.0).alias("conf"))
    between = p.where("k % 4 = 3 AND k % 20 <> 19").join(p.select(F.col("k").alias("to")), F.col("k") + 1 == F.col("to")).select("k", "to", F.lit(0.01).alias("conf"))
    e = inside.unionByName(between)
    edges = e.select(F.concat_ws(">", "k", "to").alias("id"), F.lit("tpch").alias("series"), F.concat(F.lit("p"), "k").alias("src_id"), F.concat(F.lit("p"), "to").alias("dst_id"), F.lit("like").alias("pred"), "conf")
    return graph.communities(edges, _rounds(spark), levels=2)


def _shared(spark: SparkSession) -> str | None:
    """The folder that the cluster names for checkpoints; none is needed in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for stored structures."""
    return f"{_shared(spark) or '/tmp/checkpoints/corpusloom-stores'}/{name}-{uuid.uuid4().hex}"


def _rounds(spark: SparkSession):
    """Writes a round to the folder that the cluster names for checkpoints."""
    folder = _shared(spark)
    if not folder:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/corpusloom-rounds")
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df: df.checkpoint()


# --- tables: upserts, canonical forms, linking --------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _table(spark, sf_dir, "supplier")
    one = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("tpch").alias("series"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.array(F.concat(F.lit("a"), F.col("s_suppkey") % 3)).alias("aliases"), F.lit("short").alias("desc"), F.array(F.concat(F.lit("d"), F.col("s_suppkey"))).alias("cids"), (F.col("s_suppkey") % 10 / 10).alias("conf"))
    two = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("tpch").alias("series"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.array(F.lit("a0"), F.lit("b")).alias("aliases"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("a longer text")).otherwise(F.lit("tiny")).alias("desc"), F.array(F.lit("d0")).alias("cids"), F.lit(0.45).alias("conf"))
    return one, two


@query(
    """WITH a AS (SELECT 's' || s_suppkey AS id, ['a' || s_suppkey % 3] AS al, 'short' AS d, ['d' || s_suppkey] AS c, s_suppkey % 10 / 10 AS conf FROM supplier UNION ALL SELECT 's' || s_suppkey, ['a0', 'b'], CASE WHEN s_suppkey % 4 = 0 THEN 'a longer text' ELSE 'tiny' END, ['d0'], 0.45 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT id, array_to_string(list_sort(list_distinct(flatten(list(al)))), ',') AS aliases, first(d ORDER BY length(d) DESC, d) AS "desc", array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS cids, round(max(conf), 6) AS conf FROM a GROUP BY id"""
)
def upsert_entities(spark, sf_dir):
    out = tables.upsert_entities(*_versions(spark, sf_dir))
    return out.select("id", F.array_join("aliases", ",").alias("aliases"), "desc", F.array_join("cids", ",").alias("cids"), F.round("conf", 6).alias("conf"))


@query(
    """WITH a AS (SELECT 0 AS turn, 's' || s_suppkey AS id, ['a' || s_suppkey % 3] AS al, 'short' AS d, ['d' || s_suppkey] AS c, s_suppkey % 10 / 10 AS conf FROM supplier UNION ALL SELECT 1 + s_suppkey % 4 // 2, 's' || s_suppkey, ['a0', 'b'], CASE WHEN s_suppkey % 4 = 0 THEN 'a longer text' ELSE 'tiny' END, ['d0'], 0.45 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT CAST(version AS INT) AS version, id, array_to_string(list_sort(list_distinct(flatten(list(al)))), ',') AS aliases, first(d ORDER BY length(d) DESC, d) AS "desc", array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS cids, round(max(conf), 6) AS conf FROM a, (VALUES (0), (1), (2)) AS v(version) WHERE turn <= version GROUP BY version, id"""
)
def keyed_versions(spark, sf_dir):
    """Entities upserted into a keyed table in three batches, the last one repeated; every version read back."""
    one, two = _versions(spark, sf_dir)
    four = F.substring("id", 2, 20).cast("bigint") % 4
    path, merge, out, versions = _folder(spark, "keyed"), tables.upsert_entities, None, []
    for n, batch in enumerate([one, two.where(four == 0), two.where(four == 2), two.where(four == 2)]):
        versions.append(keyed.KeyedTable.open(spark, path, "id", 16).upsert(batch, merge, min(n, 2)).meta["version"])
    for n, version in enumerate(versions[:3]):
        rows = keyed.KeyedTable(spark, path, version).rows(merge).select(F.lit(n).alias("version"), "id", F.array_join("aliases", ",").alias("aliases"), "desc", F.array_join("cids", ",").alias("cids"), F.round("conf", 6).alias("conf"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH {_GRAPH}, n AS (SELECT id FROM nodes WHERE conf >= 0.2), e AS (SELECT * FROM edges UNION ALL SELECT src_id, dst_id, pred, conf / 2 FROM edges WHERE pred = 'lives_in')
SELECT src_id || '>' || dst_id AS id, pred, round(max(conf), 6) AS conf, CAST(1 AS DOUBLE) AS weight FROM e WHERE src_id IN (FROM n) AND dst_id IN (FROM n) GROUP BY ALL"""
)
def upsert_relations(spark, sf_dir):
    nodes, edges = tpch_graph(spark, sf_dir)
    edges = edges.withColumn("cids", F.array().cast("array<string>"))
    again = edges.where("pred = 'lives_in'").withColumn("conf", F.col("conf") / 2)
    out = tables.upsert_relations(edges, again, nodes.where("conf >= 0.2"))
    return out.select("id", "pred", F.round("conf", 6).alias("conf"), "weight")


@query(
    """WITH a AS (SELECT vec_id AS cid, 1 AS ts, label AS page, embedding FROM embeddings UNION ALL SELECT vec_id, 2, label + 1, CASE WHEN vec_id % 4 = 0 THEN embedding[1:2] END FROM embeddings WHERE vec_id % 2 = 0)
SELECT cid, CAST(max(ts) AS DOUBLE) AS ts, arg_max(page, ts) AS page, len(arg_max(embedding, ts) FILTER (embedding IS NOT NULL)) AS dims FROM a GROUP BY cid"""
)
def upsert_chunks(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    old = e.select(F.col("id").alias("cid"), F.lit(1.0).alias("ts"), F.col("label").alias("page"), "embedding")
    new = e.where("id % 2 = 0").select(F.col("id").alias("cid"), F.lit(2.0).alias("ts"), (F.col("label") + 1).alias("page"), F.when(F.col("id") % 4 == 0, F.slice("embedding", 1, 2)).alias("embedding"))
    return tables.upsert_chunks(old, new).select("cid", "ts", "page", F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT DISTINCT 's' || s_suppkey AS entity_id, CAST(doc_id AS VARCHAR) AS cid FROM supplier JOIN documents ON doc_id IN (s_suppkey, s_suppkey * 2)")
def mentions(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.array(F.col("s_suppkey").cast("string"), (F.col("s_suppkey") * 2).cast("string"), F.col("s_suppkey").cast("string")).alias("cids"))
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("cid"))
    return tables.link_mentions(s, d).select("entity_id", "cid")


@query("SELECT source AS id, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return tables.duplicates(_table(spark, sf_dir, "documents").withColumnRenamed("source", "id"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction rows built from parts: the brand and the type are entities, and the brand makes the type."""
    p = _table(spark, sf_dir, "part")
    entity = lambda name, kind, conf: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("desc"), conf.alias("conf"))
    conf = F.col("p_size") / 50.0
    return p.select(
        F.lit("tpch").alias("series"),
        F.lit("part").alias("filename"),
        F.col("p_partkey").cast("int").alias("idx"),
        F.concat(F.lit("p"), F.col("p_partkey")).alias("cid"),
        F.array(entity(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), "brand", conf), entity(F.col("p_type"), "type", F.lit(0.9))).alias("entities"),
        F.array(F.struct(F.col("p_brand").alias("src"), F.lit("makes").alias("pred"), F.col("p_type").alias("dst"), conf.alias("conf"))).alias("relations"),
    )


_NODE = "substr(sha1('tpch::' || lower(trim({0})) || '::{1}'), 1, 16)"


@query(
    f"""WITH e AS (SELECT p_partkey AS k, 0 AS o, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS name, 'brand' AS type, {_NODE.format('p_brand', 'brand')} AS id, p_size / 50.0 AS conf FROM part UNION ALL SELECT p_partkey, 1, p_type, 'type', {_NODE.format('p_type', 'type')}, 0.9 FROM part)
SELECT id, arg_min(name, k * 2 + o) AS name, type, count(DISTINCT k) AS n_cids, round(max(conf), 6) AS conf FROM e WHERE conf >= 0.35 GROUP BY id, type"""
)
def canonical_nodes(spark, sf_dir):
    x = _extracted(spark, sf_dir)
    n = kg.canonical_nodes(x).join(_evidence_counts(kg.evidence(x)), "id")
    return n.select("id", "name", "type", "n_cids", F.round("conf", 6).alias("conf"))


def _evidence_counts(rows: DataFrame, of: str = "entity_id") -> DataFrame:
    return rows.groupBy(F.col(of).alias("id")).agg(F.count(F.lit(1)).alias("n_cids"))


@query(
    f"""WITH b AS (SELECT DISTINCT lower(trim(p_brand)) AS b FROM part WHERE p_size / 50.0 >= 0.35),
r AS (SELECT p_partkey, {_NODE.format('p_brand', 'brand')} AS s, {_NODE.format('p_type', 'type')} AS d, p_size / 50.0 AS conf FROM part WHERE p_size / 50.0 >= 0.35)
SELECT substr(sha1('tpch::' || s || '::makes::' || d), 1, 16) AS id, s AS src_id, d AS dst_id, count(DISTINCT p_partkey) AS n_cids, round(max(conf), 6) AS conf FROM r GROUP BY s, d"""
)
def canonical_edges(spark, sf_dir):
    x = _extracted(spark, sf_dir)
    nodes = kg.canonical_nodes(x)
    e = kg.canonical_edges(x, nodes).join(_evidence_counts(kg.edge_evidence(x, nodes), "edge_id"), "id")
    return e.select("id", "src_id", "dst_id", "n_cids", F.round("conf", 6).alias("conf"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.lit("tpch").alias("series"), F.col("p_type").alias("name"), F.lit("part").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("desc"), F.array(F.concat(F.lit("d"), F.col("p_partkey"))).alias("cids"), (F.col("p_size") / 50.0).alias("conf"))


_LINK = rf"""g AS (SELECT 'p' || p_partkey AS id, p_type AS name, p_size / 50.0 AS conf, {_FP.replace("p_name", "p_type")} AS fp FROM part), w AS (SELECT coalesce(nullif(fp, ''), '#' || id) AS fp, first(id ORDER BY conf DESC, id) AS win FROM g GROUP BY 1), map AS (SELECT id AS old_id, win AS new_id FROM g JOIN w ON w.fp = coalesce(nullif(g.fp, ''), '#' || g.id))"""


@query(f"WITH {_LINK} SELECT new_id AS id, count(*) AS n_cids, round(max(conf), 6) AS conf FROM map JOIN g ON g.id = old_id GROUP BY new_id")
def linked_nodes(spark, sf_dir):
    n = _named(spark, sf_dir)
    mapping = kg.id_map(n)
    rows = kg.map_evidence(n.select(F.col("id").alias("entity_id"), F.explode("cids").alias("cid")), mapping)
    return kg.link_nodes(n, mapping).join(_evidence_counts(rows), "id").select("id", "n_cids", F.round("conf", 6).alias("conf"))


@query(
    f"""WITH {_LINK}, e AS (SELECT 's' || l_suppkey AS src_id, 'p' || l_partkey AS dst_id, round(1 - l_discount, 2) AS conf FROM lineitem)
SELECT src_id, coalesce(new_id, dst_id) AS dst_id, substr(sha1('tpch::' || src_id || '::sells::' || coalesce(new_id, dst_id)), 1, 16) AS id, round(max(conf), 6) AS conf FROM e LEFT JOIN map ON old_id = dst_id GROUP BY ALL"""
)
def remapped_edges(spark, sf_dir):
    e = _table(spark, sf_dir, "lineitem").select(F.lit("").alias("id"), F.lit("tpch").alias("series"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst_id"), F.lit("sells").alias("pred"), F.array().cast("array<string>").alias("cids"), F.round(1 - F.col("l_discount"), 2).alias("conf"))
    return kg.remap_edges(e, kg.id_map(_named(spark, sf_dir))).select("src_id", "dst_id", "id", F.round("conf", 6).alias("conf"))


# --- answers -------------------------------------------------------------------


def _route_sql(q: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"
    fact = "(" + " OR ".join(f"starts_with({q}, '{w}')" for w in answer.FACT_STARTS) + ")"
    graph_ = f"{has(answer.COMPARE_WORDS)} OR (len(regexp_extract_all({q}, '\\S+')) >= {answer.LONG_QUESTION} AND NOT {fact})"
    path = f"{has(answer.RELATION_WORDS)} OR ({fact} AND (regexp_matches({q}, '\\d') OR contains({q}, 'entre')))"
    return f"CASE WHEN {graph_} THEN 'graph' WHEN {path} THEN 'path' ELSE 'vector' END"


_Q = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, {_route_sql(_Q)} AS mode FROM conversations")
def route_questions(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.route(F.col("text"))["mode"].alias("mode"))


@query(
    rf"""WITH d AS (SELECT doc_id AS id, {_HASH_VEC.format('text')} AS v, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS t FROM documents),
q AS (SELECT ['the', 'que', 'der', 'words'] AS q, {_HASH_VEC.format("'the que der words'")} AS qv)
SELECT id, round(CASE WHEN id % 2 = 0 THEN list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])) ELSE len(list_intersect(q, t)) / 4 END, 6) AS score FROM d, q ORDER BY CASE WHEN id % 2 = 0 THEN list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])) ELSE len(list_intersect(q, t)) / 4 END DESC, id LIMIT 12"""
)
def summary_search(spark, sf_dir):
    """Summaries with a vector by cosine, the others by keyword overlap; the report is the twelve best."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit(0).alias("level"), "text", F.when(F.col("doc_id") % 2 == 0, V.hash_embed()(F.col("text"))).alias("vec"))
    return answer.search_summaries(d, "the que der words", vector=V.hash_vector("the que der words").tolist()).select("id", F.round("score", 6).alias("score"))


@query(r"WITH p AS (SELECT item_id AS id, text AS p FROM benchmark) SELECT id, round(0.5 + (id % 5) / 10, 6) AS confidence, md5(p) AS partial, substring(string_split(p, '. ')[1], 1, 280) AS snippet FROM p")
def map_replies(spark, sf_dir):
    """Replies of a map step, some in fences or with trailing commas, read back into partial answers and snippets."""
    b = _table(spark, sf_dir, "benchmark")
    body = F.to_json(F.struct(F.col("text").alias("partial_answer"), F.round(0.5 + (F.col("item_id") % 5) / 10, 6).alias("confidence"), F.array(F.col("item_id").cast("string")).alias("evidence")))
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("Here it is: "), F.regexp_replace(body, r"\]\}$", "],}"))).otherwise(body)
    df = b.select(F.col("item_id").alias("id"), jsonx.map_reply(raw).alias("r"))
    return df.select("id", F.round("r.confidence", 6).alias("confidence"), F.md5(F.col("r.partial").cast("binary")).alias("partial"), F.substring(F.element_at(F.split("r.partial", r"\. ", -1), 1), 1, 280).alias("snippet"))


_TEXT_OF = "coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE trim(p_type) END, ''), p_name)".replace("'  '", "''")


@query(f"""WITH n AS (SELECT 'p' || p_partkey AS id, {_TEXT_OF} AS t FROM part), v AS (SELECT id, t, list_transform(generate_series(1, 8), lambda i: ord(substring(rpad(t, 8, ' '), i, 1)) % 13 / 13.0) AS v FROM n),
q AS (SELECT list_transform(generate_series(1, 8), lambda i: ord(substring('STANDARD', i, 1)) % 13 / 13.0) AS q)
SELECT id, t AS text, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM v, q""")
def entity_vectors(spark, sf_dir):
    """Entities by the vector of their description, or of their name where that is blank; cosine to a query."""
    p = _table(spark, sf_dir, "part")
    nodes = p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")).alias("desc"))
    rows = entities.embed_entities(nodes, _char_embed(F.col("text")), dims=8).join(entities.entity_texts(nodes), "id")
    q = spark.range(1).select(_char_embed(F.lit("STANDARD")).alias("v")).head()["v"]
    return rows.select("id", "text", F.round(V.cosine(F.col("evec"), F.array(*[F.lit(x) for x in q])), 6).alias("score"))


@query(f"""WITH n AS (SELECT 'p' || p_partkey AS id, {_TEXT_OF} AS t FROM part), v AS (SELECT id, list_transform(generate_series(1, 8), lambda i: ord(substring(rpad(t, 8, ' '), i, 1)) % 13 / 13.0) AS v FROM n),
q AS (SELECT list_transform(generate_series(1, 8), lambda i: ord(substring('STANDARD', i, 1)) % 13 / 13.0) AS q), s AS (SELECT id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM v, q ORDER BY score DESC, id LIMIT 10)
SELECT kind, id, round(score, 6) AS score FROM s, (VALUES ('scan'), ('inverted')) AS k(kind)""")
def entity_indexes(spark, sf_dir):
    """Entities synchronised with the catalogue, as a scan and as an inverted file, and searched after reopening; the report is the ten best of each."""
    p = _table(spark, sf_dir, "part")
    nodes = p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")).alias("desc"))
    q = spark.range(1).select(_char_embed(F.lit("STANDARD")).alias("v")).head()["v"]
    catalog, out = entities.Catalog(spark, _folder(spark, "catalog")), None
    for kind in ("scan", "inverted"):
        entities.sync_at(catalog, f"parts {kind}", nodes, _folder(spark, kind), vector=_char_embed(F.col("text")), dims=8, kind=kind)
        found = catalog.open(f"parts {kind}").search(q, 10).select(F.lit(kind).alias("kind"), "id", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


@query(ORACLE_SQL["cosine_join"])
def vector_index_join(spark, sf_dir):
    """Every twentieth vector against an inverted file of all of them, built from a part, extended and reopened; all lists are probed."""
    e = _vectors(spark, sf_dir)
    path = _folder(spark, "vectors")
    vector_index.InvertedFile.build(e.where("id % 3 <> 0"), path).upsert(e.where("id % 3 = 0 OR id % 10 = 1"))
    index = vector_index.InvertedFile(spark, path)
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return index.search_many(q, 5, index.lists).withColumn("score", F.round("score", 6))


def _language_sql() -> str:
    words = r"regexp_split_to_array(lower(substring(text, 1, 2000)), '[^\p{L}]+')"
    votes = ", ".join(f"{{'n': -len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))), 'lang': '{lang}'}}" for lang, ws in sorted(text.STOP_WORDS.items()))
    return f"WITH d AS (SELECT doc_id, {words} AS w FROM documents), v AS (SELECT doc_id, list_sort([{votes}])[1] AS b FROM d) SELECT doc_id, CASE WHEN b.n < 0 THEN b.lang END AS lang FROM v"


@query(_language_sql())
def languages(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.detect_language("text").alias("lang"))


@query()
def language_profiles(spark, sf_dir):
    """Language of every whole text by profiles learnt from four fifths of the documents (a bounded sample of them)."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = languages_.fit(d.where(~held_out), order=F.col("doc_id"))
    return languages_.detect(d.withColumn("held_out", held_out), profiles).select("doc_id", "held_out", "language")


def _model_reply() -> Column:
    return F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Sure: {\"strategy\": \"Paragraph\", \"size\": "), (F.col("doc_id") % 300).cast("string"), F.lit(", \"overlap\": -5}"))).when(F.col("doc_id") % 4 == 1, F.lit("```json\n{\"strategy\": \"pages\", \"size\": 900}\n```")).when(F.col("doc_id") % 4 == 2, F.lit("no idea")).otherwise(F.lit("{\"overlap\": 40}"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, (length(text) - length(replace(text, chr(10), ''))) AS lines, (length(text) - length(replace(text, '•', ''))) + (length(text) - length(replace(text, '- ', ''))) / 2 AS bullets FROM documents),
s AS (SELECT *, contains(text, '|') OR (contains(text, ',') AND contains(text, chr(10)) AND n / (lines + 1) > 40) OR bullets > 10 OR lines > 20 AS p FROM d)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'paragraph' WHEN 2 THEN CASE WHEN p THEN 'paragraph' WHEN n < 2000 THEN 'sentence' ELSE 'recursive' END ELSE 'sentence' END AS strategy,
CAST(CASE doc_id % 4 WHEN 0 THEN greatest(100, doc_id % 300) WHEN 1 THEN 900 WHEN 3 THEN 800 ELSE CASE WHEN p THEN least(1000, greatest(400, floor(n / 50))) WHEN n < 2000 THEN 600 ELSE 800 END END AS INT) AS size,
CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 150 WHEN 3 THEN 40 ELSE CASE WHEN p THEN 100 WHEN n < 2000 THEN 120 ELSE 150 END END AS INT) AS overlap FROM s""")
def model_options(spark, sf_dir):
    """Chunk options out of model replies: in prose, in a fence, of an unknown strategy, or none at all."""
    d = _table(spark, sf_dir, "documents").withColumn("reply", _model_reply())
    return d.select("doc_id", text.model_options("reply", "text").alias("o")).select("doc_id", "o.*")


@query(r"""WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
j AS (SELECT conv_id, text, b, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '')) AS y FROM t),
s AS (SELECT conv_id, count(*) AS pages, coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END END), 0) AS s FROM j GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS filename, pages, round(s, 6) AS similarity, CASE WHEN pages > 2 AND round(s, 12) >= 0.35 THEN 'linked' ELSE 'per_page' END AS mode FROM s""")
def page_linkage(spark, sf_dir):
    """Turns of a conversation as pages of a file: how alike neighbours are."""
    c = _table(spark, sf_dir, "conversations").select(F.lit("c").alias("series"), F.col("conv_id").cast("string").alias("filename"), F.col("turn").alias("page"), F.lit(0).alias("order"), "text")
    return files.page_linkage(c).select("filename", "pages", F.round("similarity", 6).alias("similarity"), "mode")


@query("""WITH c AS (SELECT p_size AS mention_id, 'p' || p_partkey AS id, p_name AS name, p_brand AS type, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS d FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY id) AS k FROM c)
SELECT mention_id, string_agg(CASE WHEN d = '' THEN name ELSE name || ': ' || d END, chr(10) ORDER BY k) FILTER (k <= 20) AS context, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT type AS t FROM c WHERE c.mention_id = r.mention_id)) AS types FROM r GROUP BY mention_id""")
def linking_context(spark, sf_dir):
    """Types and lines of the candidates of each mention."""
    c = _table(spark, sf_dir, "part").select(F.col("p_size").alias("mention_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("desc"))
    return kg.linking_context(c).withColumn("types", F.array_join("types", ","))


@query("""WITH c AS (SELECT source AS series, CAST(doc_id AS VARCHAR) AS filename, text FROM documents WHERE trim(text) <> ''), done AS (SELECT series, filename, sha1(text) AS h FROM c WHERE series IN ('src0', 'src1'))
SELECT series, filename, sha1(text) AS hash FROM c WHERE (series, filename, sha1(text)) NOT IN (SELECT series, filename, h FROM done) ORDER BY series, filename LIMIT 100""")
def chunks_due(spark, sf_dir):
    """The first hundred chunks that an incremental run would extract: with text, and not extracted before."""
    c = _documents(spark, sf_dir).withColumn("idx", F.lit(0))
    done = c.where("series IN ('src0', 'src1')").select("series", "filename", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return runner.due(c, done, 100).select("series", "filename", "hash")


# --- events ----------------------------------------------------------------------


@query(
    """WITH p AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN struct_pack(t := ts, e := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM events)
SELECT user_id, event_id, round((epoch_us(m.t) - epoch_us(ts)) / 1000, 3) AS ms FROM p WHERE event_type = 'view' AND m IS NOT NULL"""
)
def step_durations(spark, sf_dir):
    return flows.step_durations(_table(spark, sf_dir, "events")).withColumn("ms", F.round("ms", 3))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS n FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return flows.latest(_table(spark, sf_dir, "events"))


@query("""WITH p AS (SELECT *, CASE WHEN event_type = 'error' THEN 'DEGRADED' ELSE 'RUNNING' END AS phase FROM events) SELECT user_id, event_id, phase FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM p) WHERE before IS NULL OR before <> phase""")
def status_changes(spark, sf_dir):
    """Phase changes of each user, as the batch form of the stateful stream."""
    e = _table(spark, sf_dir, "events").withColumn("phase", F.when(F.col("event_type") == "error", "DEGRADED").otherwise("RUNNING"))
    before = F.lag("phase").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", before).where("before IS NULL OR before <> phase").select("user_id", "event_id", "phase")


@query("""WITH r AS (SELECT user_id AS key, event_id, ts, CASE WHEN event_type = 'error' THEN 'DEGRADED' ELSE 'RUNNING' END AS phase, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
u AS (SELECT key, event_id, ts, phase FROM r UNION ALL SELECT key, NULL, ts + INTERVAL 6 HOUR, 'DEGRADED' FROM r WHERE nx IS NULL OR nx > ts + INTERVAL 6 HOUR),
b AS (SELECT *, lag(phase) OVER (PARTITION BY key ORDER BY ts, event_id NULLS LAST) AS before FROM u) SELECT key, event_id, phase, epoch_us(ts) AS us FROM b WHERE before IS NULL OR before <> phase""")
def health_phases(spark, sf_dir):
    """Phase changes of each user, silences of six hours included: the batch form of the stream with timers."""
    found = health.phases_of(_table(spark, sf_dir, "events"), quiet=6 * 3600)
    return found.select("key", "event_id", "phase", F.unix_micros("ts").alias("us"))


@query("""WITH a AS (SELECT user_id AS step, ts FROM events WHERE event_type = 'view'), b AS (SELECT user_id AS step, ts FROM events WHERE event_type = 'purchase')
SELECT a.step, epoch_us(a.ts) AS start_us, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1000, 3) AS ms, CASE WHEN b.ts IS NULL THEN 'expired' ELSE 'done' END AS state FROM a LEFT JOIN b ON a.step = b.step AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""")
def step_ends(spark, sf_dir):
    """Views with the purchases of the same user within two hours, or expired: the static form of the stream-stream join."""
    e = _table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("step"), "ts")
    found = health.steps(of("view"), of("purchase"), limit=2 * 3600)
    return found.select("step", F.unix_micros("start_ts").alias("start_us"), F.round("ms", 3).alias("ms"), "state")


# --- the whole slice -------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to sentence chunks to vectors to the ten chunks nearest to a question."""
    chunks = chunking.document_chunks(_documents(spark, sf_dir))
    nodes = chunks.select(F.col("cid").alias("id"), "series", "filename", V.hash_embed()(F.col("text")).alias("embedding"))
    return search.vector_top_k(nodes, V.hash_vector("which text is this").tolist(), 10).select("id", "series", "filename", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_packed(_SENTENCES, '800', '150')}, v AS (SELECT series || ':' || filename || ':' || idx AS id, series, filename, {_HASH_VEC.format('text')} AS v FROM each), q AS (SELECT {_HASH_VEC.format("'which text is this'")} AS q)
SELECT id, series, filename, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM v, q ORDER BY list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, id LIMIT 10"""
)
def chunk_embed_search(spark, sf_dir):
    return flagship(spark, sf_dir)
