"""Queries of grouped results, chips, and chunks by budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as tx
from tarn.functions.nfkc import nfkc
from tarn.operators import budget, grouping, identifiers
from tarn.plans.queries import DOC_WORDS, WORDS, docs
from tarn.plans.registry import query, table
from tarn.session import work_folder, written

#: Lines of documents that have a first word of a benchmark item, as hits of that word; a document with three such lines is a hit as well, and the parent of its lines.
LINE_HITS = f"""
q AS (SELECT w AS word, min(item_id) AS query_id FROM (SELECT item_id, {DOC_WORDS}[1] AS w FROM benchmark) WHERE w IS NOT NULL GROUP BY w),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no, len(string_split(text, chr(10))) AS n_lines FROM documents),
word AS (SELECT DISTINCT doc_id, no, n_lines, unnest({WORDS.format('line')}) AS word FROM line),
own AS (SELECT query_id, doc_id, no, n_lines FROM word JOIN q USING (word)),
hit AS (SELECT query_id, doc_id * 100000 + no AS chunk_id, doc_id * 100000 AS parent_chunk_id, doc_id AS file_id, no AS line_start, no AS line_end FROM own UNION ALL
        SELECT query_id, doc_id * 100000, NULL, doc_id, 1, n_lines FROM own GROUP BY query_id, doc_id, n_lines HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 97, chunk_id) AS rank FROM hit)"""


#: Numbers of chunks, those of 4,096 documents, whose hits of one query and remainder are sorted together.
CHUNKS = 4_096 * 100_000


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.get(tx.tokens(F.col("text")), F.lit(0)).alias("word")).where("word is not null").groupBy("word").agg(F.min("item_id").alias("query_id"))
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"), F.size(F.split("text", "\n")).alias("n_lines"))
    # all hits of a document come from one pass over its lines
    found = lines.select("doc_id", (F.col("at") + 1).alias("no"), "n_lines", F.explode(F.array_distinct(tx.tokens(F.col("line")))).alias("word")).join(words, "word")
    base = F.col("doc_id") * 100_000
    hit = lambda chunk, parent, start, end: F.struct(chunk.alias("chunk_id"), parent.alias("parent_chunk_id"), F.col("doc_id").alias("file_id"), start.alias("line_start"), end.alias("line_end"))
    own = F.transform("nos", lambda no: hit(base + no, base, no, no))
    whole = F.array(hit(base, F.lit(None).cast("bigint"), F.lit(1), F.col("n_lines")))
    of_doc = found.groupBy("query_id", "doc_id", "n_lines").agg(F.collect_list("no").alias("nos"))
    return of_doc.select("query_id", F.inline(F.when(F.size("nos") >= 3, F.concat(own, whole)).otherwise(own)))


@query(f"""WITH {LINE_HITS},
best AS (SELECT h.query_id, h.parent_chunk_id AS top, p.rank AS top_rank, h.chunk_id FROM ranked h JOIN ranked p ON p.query_id = h.query_id AND p.chunk_id = h.parent_chunk_id
         QUALIFY row_number() OVER (PARTITION BY h.query_id, h.parent_chunk_id ORDER BY h.rank, h.chunk_id) = 1),
left_over AS (SELECT r.query_id, r.chunk_id, r.file_id, r.line_start, r.line_end, least(r.rank, coalesce(b.top_rank, r.rank)) AS rank, CASE WHEN b.top IS NULL THEN 0 ELSE 1 END AS folded
  FROM ranked r LEFT JOIN best b ON b.query_id = r.query_id AND b.chunk_id = r.chunk_id WHERE NOT EXISTS (SELECT 1 FROM best g WHERE g.query_id = r.query_id AND g.top = r.chunk_id)),
gap AS (SELECT *, CASE WHEN line_start > max(line_end) OVER (PARTITION BY query_id, file_id ORDER BY line_start, line_end, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4 THEN 1 ELSE 0 END AS fresh FROM left_over),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, file_id ORDER BY line_start, line_end, chunk_id) AS island FROM gap),
grouped AS (SELECT query_id, file_id, min(line_start) AS line_start, max(line_end) AS line_end, arg_min(chunk_id, rank * 1000000000 + chunk_id) AS chunk_id, min(rank) AS rank, count(*) + sum(folded) - 1 AS additional_hits FROM island GROUP BY query_id, file_id, island)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS INTEGER) AS group_rank, file_id, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(additional_hits AS BIGINT) AS additional_hits FROM grouped""")
def h4_nearby_groups(spark, sf_dir):
    # a list that is read several times, as a search leaves it; its order is by remainder, and chunks part the hits of one
    hits = written(line_hits(spark, sf_dir), "hits")
    order = F.col("chunk_id") % 97
    return grouping.nearby(grouping.numbered(hits, F.struct(order, F.floor(F.col("chunk_id") / CHUNKS)), [order, "chunk_id"], "rank"))


FACETS = ["lang", "source", "size"]


@query(f"""WITH {LINE_HITS},
result AS (SELECT query_id, r.doc_id, d.lang, d.source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size FROM (SELECT DISTINCT query_id, doc_id FROM own) r JOIN documents d USING (doc_id)),
total AS (SELECT query_id, count(*) AS total FROM result GROUP BY query_id HAVING count(*) >= 4),
pair AS (SELECT query_id, doc_id, unnest([{{'facet': 'lang', 'value': lang}}, {{'facet': 'size', 'value': size}}, {{'facet': 'source', 'value': source}}], recursive := true) FROM result),
chip AS (SELECT query_id, facet, value, count(*) AS n FROM pair JOIN total USING (query_id) WHERE value IS NOT NULL GROUP BY query_id, facet, value, total HAVING count(*) <= 0.8 * total),
has AS (SELECT * FROM pair JOIN chip USING (query_id, facet, value)),
c1 AS (SELECT query_id, facet, value, n, n AS fresh FROM chip QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, facet, value) = 1),
h2 AS (SELECT h.* FROM has h WHERE NOT EXISTS (SELECT 1 FROM has s JOIN c1 USING (query_id, facet, value) WHERE s.query_id = h.query_id AND s.doc_id = h.doc_id)),
c2 AS (SELECT query_id, facet, value, n, count(*) AS fresh FROM h2 GROUP BY query_id, facet, value, n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, facet, value) = 1),
h3 AS (SELECT h.* FROM h2 h WHERE NOT EXISTS (SELECT 1 FROM h2 s JOIN c2 USING (query_id, facet, value) WHERE s.query_id = h.query_id AND s.doc_id = h.doc_id)),
c3 AS (SELECT query_id, facet, value, n, count(*) AS fresh FROM h3 GROUP BY query_id, facet, value, n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, facet, value) = 1)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS INTEGER) AS place, facet, value, n, fresh FROM (SELECT 1 AS place, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)""")
def f7_chips(spark, sf_dir):
    """Chips over all documents that have a query's word, some thousand for a common one."""
    hits = line_hits(spark, sf_dir).select("query_id", F.col("file_id").alias("doc_id")).distinct()
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    rows = hits.join(docs(spark, sf_dir).select("doc_id", "lang", "source", size.alias("size")), "doc_id")
    ranked = grouping.numbered(written(rows, "results"), F.floor(F.col("doc_id") / grouping.RANKS), ["doc_id"], "rank")
    return grouping.chips(ranked, FACETS)


def token_sql(mode: str) -> str:
    own = budget.MODES[mode]
    half, target = own.target // 2, own.target
    pick = lambda marks: f"list_max(list_filter({marks}, lambda b: b > g.stop - {own.overlap} + {half} AND b <= g.stop - {own.overlap} + {target}))"
    first = lambda marks: f"list_max(list_filter({marks}, lambda b: b > {half} AND b <= {target}))"
    return rf"""WITH RECURSIVE line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text <> ''),
counted AS (SELECT doc_id, no, line, sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+'))) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS next, lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS later, row_number() OVER (PARTITION BY doc_id ORDER BY no DESC) AS back FROM line),
doc AS (SELECT doc_id, CAST(max(upto) AS BIGINT) AS n, coalesce(list(CAST(upto AS BIGINT)) FILTER (later IS NOT NULL), []) AS lines,
  coalesce(list(CAST(upto AS BIGINT)) FILTER (back > 2 AND regexp_full_match(next, '[ \t]*')), []) AS paragraphs FROM counted GROUP BY doc_id),
g AS (SELECT doc_id, n, lines, paragraphs, 0 AS ordinal, CAST(0 AS BIGINT) AS start, CASE WHEN n <= {own.most} THEN n ELSE coalesce({first('paragraphs')}, {first('lines')}, {target}) END AS stop FROM doc
 UNION ALL SELECT doc_id, n, lines, paragraphs, ordinal + 1, stop - {own.overlap}, CASE WHEN n - stop + {own.overlap} <= {own.most} THEN n ELSE coalesce({pick('paragraphs')}, {pick('lines')}, stop - {own.overlap} + {target}) END FROM g WHERE stop < n)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(start AS INTEGER) AS token_start, CAST(stop AS INTEGER) AS token_end FROM g"""


@query(token_sql("space_saving"))
def c7_tokens_space_saving(spark, sf_dir):
    return budget.token_chunks(docs(spark, sf_dir), "doc_id", "text", "space_saving").drop("content")


@query(token_sql("balanced"))
def c7_tokens_balanced(spark, sf_dir):
    return budget.token_chunks(docs(spark, sf_dir), "doc_id", "text", "balanced").drop("content")


@query(token_sql("high_accuracy"))
def c7_tokens_high_accuracy(spark, sf_dir):
    return budget.token_chunks(docs(spark, sf_dir), "doc_id", "text", "high_accuracy").drop("content")


#: Conversations as CSV texts: every field of text is quoted, with a newline in it.
CSV_ROW = "CAST(turn AS {s}) || ',' || role || ',\"' || replace(text, '\"', '\"\"') || '\n\"\"end\"\"\"'"
CSV_HEAD = "turn,role,text"


@query(f"""WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {CSV_ROW.format(s='VARCHAR')} AS line FROM conversations),
c AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY conv_id ORDER BY n) AS upto, count(*) OVER (PARTITION BY conv_id) AS total FROM r),
stop AS (SELECT a.conv_id, a.n, greatest(a.n, coalesce(max(b.n) FILTER (b.upto - a.upto + octet_length(encode(a.line)) + 1 <= 1200 - {len(CSV_HEAD) + 1}), 0)) AS stop FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.n >= a.n GROUP BY a.conv_id, a.n),
g AS (SELECT conv_id, 0 AS ordinal, n, stop FROM stop WHERE n = 1 UNION ALL SELECT s.conv_id, g.ordinal + 1, s.n, s.stop FROM g JOIN stop s ON s.conv_id = g.conv_id AND s.n = g.stop + 1),
t AS (SELECT g.conv_id, g.ordinal, g.n, g.stop, string_agg(c.line, chr(10) ORDER BY c.n) AS body FROM g JOIN c ON c.conv_id = g.conv_id AND c.n BETWEEN g.n AND g.stop GROUP BY g.conv_id, g.ordinal, g.n, g.stop)
SELECT conv_id, CAST(ordinal AS INTEGER) AS ordinal, 'table' AS chunk_kind, CAST(n AS INTEGER) AS row_start, CAST(stop AS INTEGER) AS row_end, sha256('{CSV_HEAD}' || chr(10) || body) AS content_hash FROM t""")
def c3_csv_row_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(CSV_ROW.format(s="STRING").replace("\n", "\\n").replace('\\"', '"')).alias("line"))
    files = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    body = F.concat(F.lit(f"{CSV_HEAD}\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    out = budget.csv_groups(files.select("conv_id", body.alias("body")), "conv_id", "body")
    return out.select("conv_id", "ordinal", "chunk_kind", "row_start", "row_end", F.sha2("content", 256).alias("content_hash"))


@query()
def x1_nfkc(spark, sf_dir):
    """No oracle: DuckDB has no compatibility forms. The tests hold the function against the standard library's on all code points."""
    n = nfkc(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(n, 256).alias("nfkc_sha256"), F.length(n).cast("bigint").alias("n_chars"))


#: Identifiers of documents in order, with their parts.
NAMES = r"""
n AS (SELECT doc_id, unnest(x) AS name, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(replace(text, chr(160), ' '))), '[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*') AS x FROM documents)),
p AS (SELECT doc_id, name, i, regexp_extract_all(name, '[\p{L}\p{N}]+') AS parts FROM n)"""


def identifier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query): the identifiers of several parts that documents have."""
    return identifiers.wholes(docs(spark, sf_dir), F.col("text")).withColumnRenamed("token", "query")


@query(f"WITH {NAMES} SELECT name AS identifier, count(DISTINCT doc_id) AS n_docs, count(*) AS hits FROM p WHERE len(parts) > 1 GROUP BY name")
def k9_identifiers(spark, sf_dir):
    # written, as a list that is read several times
    path = f"{work_folder(spark)}/identifiers-{uuid.uuid4().hex}"
    identifier_queries(spark, sf_dir).select("query", F.col("query").alias("query_id")).write.parquet(path)
    q = spark.read.schema("query string, query_id string").parquet(path)
    found = identifiers.phrase_hits(docs(spark, sf_dir), q, "doc_id", F.col("text"))
    return found.groupBy(F.col("query_id").alias("identifier")).agg(F.count("*").alias("n_docs"), F.sum("hits").alias("hits"))


@query(rf"""WITH {NAMES}, f AS (SELECT doc_id, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM p),
s AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos FROM f),
t AS (SELECT item_id AS query_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS off, len(ps) AS k FROM (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')[1:3] AS ps FROM benchmark)),
m AS (SELECT query_id, doc_id, pos - off AS start FROM t JOIN s USING (part) GROUP BY query_id, doc_id, pos - off, k HAVING count(*) = k)
SELECT query_id, doc_id, count(*) AS hits FROM m GROUP BY query_id, doc_id""")
def k9_part_phrases(spark, sf_dir):
    """The first three words of every benchmark item as a phrase of parts, over all documents."""
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(tx.TOKEN), 0), 1, 3)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
    return identifiers.phrase_hits(docs(spark, sf_dir), q, "doc_id", F.col("text"), exact=False)
