"""The registered queries of the library engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import catalog, chunker, context, fusion, intake, keyword, layout, semantic
from foliant.plans import search as s
from foliant.sources import html_blocks
from foliant.sources import tables as t

QUERY = "pathetic worthless scum of the thing"
ALL_QUERY = "retion thing"
PHRASE_QUERY = "of-the"
TOP = 10

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def library(spark: SparkSession, sf_dir: str) -> s.Library:
    return s.Library(t.books(spark, sf_dir), t.chunks(spark, sf_dir), t.vectors(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0, as the embedding of the query."""
    row = t.vectors(spark, sf_dir).where("chunk_id = 0").select("embedding").first()
    return list(row[0]) if row else [1.0]


# SQL building blocks


def sql_bm25(name: str, terms: list[list[str]], match_all: bool = False) -> str:
    """CTEs {name}_c (counts), {name}_s (statistics) and {name} (chunk_id, bm25)."""

    def count(term: list[str]) -> str:
        if len(term) == 1:
            return f"len(list_filter(t, lambda x: x = '{term[0]}'))"
        same = " AND ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(term))
        return f"len(list_filter(range(1, len(t) - {len(term) - 2}), lambda i: {same}))"

    n = range(len(terms))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    rule = (" AND " if match_all else " OR ").join(f"tf{i} > 0" for i in n)
    return f"""
{name}_c AS (SELECT chunk_id, len(t) AS dl, {", ".join(f"{count(x)} AS tf{i}" for i, x in enumerate(terms))}
  FROM (SELECT chunk_id, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM chunks)),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"CAST(sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS df{i}" for i in n)} FROM {name}_c),
{name} AS (SELECT chunk_id, round({score}, 9) AS bm25 FROM {name}_c, {name}_s WHERE {rule})"""


OR_TERMS = [[w] for w in ("pathetic", "worthless", "scum", "thing")]
ALL_TERMS = [["retion"], ["thing"]]
SQL_COSINE = """
qv AS (SELECT embedding AS q FROM vectors WHERE chunk_id = 0),
dist AS (SELECT chunk_id, round(1 - list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE)))
  / (greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12)
   * greatest(sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12)), 9) AS distance FROM vectors, qv)"""
SQL_BOILERPLATE = (
    "len(list_filter(section_path, lambda x: lower(x) IN (" + ", ".join(f"'{x}'" for x in tx.BACK_MATTER + tx.FRONT_MATTER) + ") OR starts_with(lower(x), 'appendix'))) > 0"
)


def ranks(src: str, name: str, order: str, rank: str, limit: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS {rank} FROM {src}) WHERE {rank} <= {limit})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


KW = [t.SQL_CHUNKS, sql_bm25("kw0", OR_TERMS), ranks("kw0", "kw", "bm25 DESC, chunk_id", "kw_rank", TOP * 2)]
HYBRID = [
    *KW, t.SQL_BOOKS, t.SQL_VECTORS, SQL_COSINE, ranks("dist", "sem0", "distance, chunk_id", "sem_rank", TOP * 2),
    "sem AS (SELECT chunk_id, sem_rank, greatest(0.0, 1 - distance) AS sim FROM sem0 WHERE distance <= 1)",
    sql_bm25("ev0", OR_TERMS, True), ranks("ev0", "ev", "bm25 DESC, chunk_id", "ev_rank", TOP * 2),
    f"every AS (SELECT chunk_id FROM ev JOIN chunks USING (chunk_id) WHERE NOT ({SQL_BOILERPLATE}))",
    """fused AS (SELECT coalesce(kw.chunk_id, sem.chunk_id) AS chunk_id, kw_rank, sem_rank, sim, every.chunk_id IS NOT NULL AS ev,
      coalesce(1.0 / (60 + kw_rank), 0.0::DOUBLE) + coalesce(1.0 / (60 + sem_rank), 0.0::DOUBLE) AS rrf
      FROM kw FULL JOIN sem ON kw.chunk_id = sem.chunk_id LEFT JOIN every ON every.chunk_id = coalesce(kw.chunk_id, sem.chunk_id))""",
    "gate AS (SELECT max(sim) AS best FROM fused HAVING max(sim) >= 0.25 OR bool_or(ev))",
    f"cut AS (SELECT fused.*, best, CASE WHEN ev THEN greatest(coalesce(sim, 0), best) ELSE coalesce(sim, 0) END AS s FROM fused, gate WHERE sem_rank IS NOT NULL OR kw_rank <= {TOP})",
    """scored AS (SELECT *, round(CASE WHEN s >= 0.45 THEN 0.5 * n + 0.5 * s WHEN s > 0 THEN 0.3 * n + 0.2 * s ELSE 0.3 * n END, 9) AS score0
      FROM (SELECT *, rrf / max(rrf) OVER () AS n FROM cut))""",
    f"top AS (SELECT *, row_number() OVER (ORDER BY score0 DESC, kw_rank ASC NULLS LAST, sem_rank ASC NULLS LAST) AS prior FROM scored QUALIFY prior <= {TOP})",
    f"""result AS (SELECT chunk_id, book_id, coalesce(title, 'Unknown book') AS book_title, sequence, content_type, section_path,
      CASE WHEN kw_rank IS NULL THEN 'semantic' WHEN sem_rank IS NULL THEN 'keyword' ELSE 'both' END AS source, prior,
      round(score0 * CASE WHEN {SQL_BOILERPLATE} THEN 0.3 ELSE 1.0 END * CASE WHEN length(trim(content)) < 100 THEN 0.5 ELSE 1.0 END, 9) AS score
      FROM top JOIN chunks USING (chunk_id) LEFT JOIN books USING (book_id))""",
]
RESULT = "CAST(chunk_id AS BIGINT) AS chunk_id, book_title, source, CAST(row_number() OVER (ORDER BY score DESC, prior) AS BIGINT) AS rank, round(score, 6) AS score"


def shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("chunk_id").cast("long").alias("chunk_id"), "book_title", "source", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# Search


@query(with_(*KW) + f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(kw_rank AS BIGINT) AS kw_rank, round(bm25, 6) AS bm25, round(61.0 / (60 + kw_rank), 6) AS score FROM kw WHERE kw_rank <= {TOP}")
def keyword_search(spark, sf_dir):
    hits = s.keyword_hits(library(spark, sf_dir), QUERY, TOP)
    return hits.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("kw_rank").cast("long").alias("kw_rank"), F.round("bm25", 6).alias("bm25"), F.round(keyword.rank_score(F.col("kw_rank")), 6).alias("score"))


@query(with_(t.SQL_CHUNKS, sql_bm25("kw", ALL_TERMS, True)) + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, round(bm25, 6) AS bm25 FROM kw")
def keyword_all_terms(spark, sf_dir):
    return keyword.bm25(t.chunks(spark, sf_dir), ALL_QUERY, match_all=True).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.round("bm25", 6).alias("bm25"))


@query(with_(t.SQL_CHUNKS, sql_bm25("kw", [["of", "the"]])) + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, round(bm25, 6) AS bm25 FROM kw")
def keyword_phrase(spark, sf_dir):
    return keyword.bm25(t.chunks(spark, sf_dir), PHRASE_QUERY).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.round("bm25", 6).alias("bm25"))


@query(
    with_(t.SQL_CHUNKS)
    + """SELECT term, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM chunks) GROUP BY term"""
)
def document_frequency(spark, sf_dir):
    return keyword.document_frequency(t.chunks(spark, sf_dir))


@query(
    with_(t.SQL_CHUNKS, *KW[1:], "ok AS (SELECT chunk_id FROM chunks WHERE content_type = 'code')", "f0 AS (SELECT kw0.* FROM kw0 JOIN ok USING (chunk_id))", ranks("f0", "f", "bm25 DESC, chunk_id", "r", TOP))
    + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(r AS BIGINT) AS kw_rank, round(bm25, 6) AS bm25 FROM f"
)
def keyword_filtered(spark, sf_dir):
    hits = s.keyword_hits(library(spark, sf_dir), QUERY, TOP, s.SearchFilter(content_type="code"))
    return hits.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("kw_rank").cast("long").alias("kw_rank"), F.round("bm25", 6).alias("bm25"))


@query(
    with_(t.SQL_CHUNKS, t.SQL_BOOKS, t.SQL_VECTORS, SQL_COSINE, ranks("dist", "d", "distance, chunk_id", "r", TOP))
    + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, coalesce(title, 'Unknown book') AS book_title, CAST(r AS BIGINT) AS sem_rank, round(greatest(0, least(1, 1 - distance)), 4) AS score FROM d JOIN chunks USING (chunk_id) LEFT JOIN books USING (book_id) WHERE 1 - distance >= 0.25"
)
def semantic_search(spark, sf_dir):
    lib = library(spark, sf_dir)
    hits = s.with_chunks(s.semantic_search(lib, query_vector(spark, sf_dir), TOP), lib)
    return hits.select(F.col("chunk_id").cast("long").alias("chunk_id"), "book_title", F.col("sem_rank").cast("long").alias("sem_rank"), F.round("score", 4).alias("score"))


def _hybrid(spark, sf_dir):
    lib = library(spark, sf_dir)
    return s.with_penalties(s.with_chunks(s.hybrid_search(lib, QUERY, query_vector(spark, sf_dir), TOP), lib))


@query(with_(*HYBRID) + f"SELECT {RESULT} FROM result")
def hybrid_search(spark, sf_dir):
    return shown(_hybrid(spark, sf_dir))


@query(with_(*HYBRID) + f"SELECT * FROM (SELECT {RESULT}, section_path AS sp FROM result) WHERE regexp_matches(lower(array_to_string(sp, ' > ')), 'chapter 1(\\W|$)')".replace("SELECT * FROM", "SELECT chunk_id, book_title, source, rank, score FROM"))
def section_filter(spark, sf_dir):
    return shown(s.in_section(_hybrid(spark, sf_dir), "Chapter 1"))


@query(with_(*HYBRID) + f"SELECT chunk_id, book_title, source, rank, score FROM (SELECT {RESULT}, book_id FROM result) WHERE book_id IN (SELECT book_id FROM books WHERE collection = 'en')")
def collection_filter(spark, sf_dir):
    return shown(s.in_collection(_hybrid(spark, sf_dir), library(spark, sf_dir), "en"))


@query()
def diversified_search(spark, sf_dir):
    response = s.search(library(spark, sf_dir), QUERY, query_vector(spark, sf_dir), TOP)
    rows = [(int(r["chunk_id"]), r["book_title"], i, float(r["score"])) for i, r in enumerate(response.results, 1)]
    return spark.createDataFrame(rows, "chunk_id long, book_title string, place int, score double")


@query(
    "WITH lists AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT doc_id, row_number() OVER (ORDER BY doc_id) FROM documents) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM lists WHERE rank <= 50 GROUP BY id"
)
def reciprocal_rank_fusion(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents")
    lists = []
    for order in ((F.desc("n_chars"), F.asc("doc_id")), (F.asc("doc_id"),)):
        best = d.select("doc_id", "n_chars").orderBy(*order).limit(50)
        lists.append(best.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank")))
    return fusion.rrf(lists[0].unionByName(lists[1])).select("id", F.round("rrf", 9).alias("rrf"))


@query(
    with_(t.SQL_CHUNKS)
    + f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, round(CAST(CASE WHEN {SQL_BOILERPLATE} THEN 0.3 ELSE 1.0 END * CASE WHEN length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 100 THEN 0.5 ELSE 1.0 END AS DOUBLE), 6) AS factor FROM chunks"
)
def quality_penalties(spark, sf_dir):
    return t.chunks(spark, sf_dir).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.round(fusion.penalised(F.lit(1.0), F.col("section_path"), F.col("content")), 6).alias("factor"))


# Context

SQL_WINDOWS = [
    *HYBRID,
    """near AS (SELECT r.chunk_id, r.book_id, r.sequence AS s, r.score, c.sequence AS q, c.section_path = r.section_path AS same
      FROM result r JOIN chunks c ON c.book_id = r.book_id AND c.sequence BETWEEN r.sequence - 2 AND r.sequence + 2)""",
    """win AS (SELECT chunk_id, book_id, s AS sequence, score, coalesce(max(q) FILTER (WHERE NOT same AND q < s) + 1, min(q)) AS start_seq, coalesce(min(q) FILTER (WHERE NOT same AND q > s) - 1, max(q)) AS end_seq
      FROM near GROUP BY chunk_id, book_id, s, score)""",
]


@query(with_(*SQL_WINDOWS) + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, book_id, CAST(start_seq AS BIGINT) AS start_seq, CAST(end_seq AS BIGINT) AS end_seq FROM win")
def context_windows(spark, sf_dir):
    w = context.windows(_hybrid(spark, sf_dir), t.chunks(spark, sf_dir), 2)
    return w.select(F.col("chunk_id").cast("long").alias("chunk_id"), "book_id", F.col("start_seq").cast("long").alias("start_seq"), F.col("end_seq").cast("long").alias("end_seq"))


@query(
    with_(
        *SQL_WINDOWS,
        "flag AS (SELECT *, CASE WHEN start_seq > max(end_seq) OVER (PARTITION BY book_id ORDER BY start_seq, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM win)",
        "isl AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY start_seq, sequence ROWS UNBOUNDED PRECEDING) AS island FROM flag)",
    )
    + "SELECT book_id, CAST(min(start_seq) AS BIGINT) AS start_seq, CAST(max(end_seq) AS BIGINT) AS end_seq, CAST(count(DISTINCT chunk_id) AS BIGINT) AS n_matched, round(max(score), 6) AS score FROM isl GROUP BY book_id, island"
)
def merged_windows(spark, sf_dir):
    m = context.merge_windows(context.windows(_hybrid(spark, sf_dir), t.chunks(spark, sf_dir), 2))
    return m.select("book_id", F.col("start_seq").cast("long").alias("start_seq"), F.col("end_seq").cast("long").alias("end_seq"), F.size("matched").cast("long").alias("n_matched"), F.round("score", 6).alias("score"))


@query(
    with_(t.SQL_CHUNKS)
    + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(lag(chunk_id) OVER w AS BIGINT) AS prev_chunk_id, CAST(lead(chunk_id) OVER w AS BIGINT) AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY book_id ORDER BY sequence)"
)
def neighbour_links(spark, sf_dir):
    return context.neighbours(t.chunks(spark, sf_dir)).select(*(F.col(c).cast("long").alias(c) for c in ("chunk_id", "prev_chunk_id", "next_chunk_id")))


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 1 AND turn BETWEEN 0 AND 3")
def read_range(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("sequence"), "role", "text")
    return context.read_range(c, "1", -2, 3).select(F.col("sequence").alias("turn"), "role", "text")


@query(with_(t.SQL_CHUNKS) + "SELECT book_id, section_path[1] AS lang, section_path[2] AS section, CAST(min(sequence) AS BIGINT) AS first FROM chunks GROUP BY book_id, section_path")
def outline(spark, sf_dir):
    return context.outline(t.chunks(spark, sf_dir)).select("book_id", F.col("section_path")[0].alias("lang"), F.col("section_path")[1].alias("section"), F.col("first").cast("long").alias("first"))


@query(
    with_(
        t.SQL_CHUNKS, "o AS (SELECT book_id, section_path AS p, min(sequence) AS first FROM chunks GROUP BY 1, 2)", "l AS (SELECT *, lag(p) OVER (PARTITION BY book_id ORDER BY first) AS q FROM o)",
    )
    + "SELECT book_id, CAST(first AS BIGINT) AS first, CAST(0 AS BIGINT) AS depth, p[1] AS name FROM l WHERE q IS NULL OR q[1] <> p[1] UNION ALL SELECT book_id, CAST(first AS BIGINT), CAST(1 AS BIGINT), p[2] FROM l WHERE q IS NULL OR q <> p"
)
def outline_lines(spark, sf_dir):
    lines = context.outline_lines(context.outline(t.chunks(spark, sf_dir)))
    return lines.select("book_id", F.col("first").cast("long").alias("first"), F.col("depth").cast("long").alias("depth"), "name")


# Catalogue


@query(with_(t.SQL_BOOKS) + "SELECT book_id, title, collection, CAST(row_number() OVER (ORDER BY first DESC) AS BIGINT) AS place FROM books")
def list_books(spark, sf_dir):
    return catalog.listed(t.books(spark, sf_dir)).select("book_id", "title", "collection", F.col("place").cast("long").alias("place"))


@query(with_(t.SQL_BOOKS) + "SELECT book_id, title FROM books WHERE collection = 'en'")
def books_of_collection(spark, sf_dir):
    return t.books(spark, sf_dir).where("collection = 'en'").select("book_id", "title")


@query(
    with_(t.SQL_CHUNKS, t.SQL_BOOKS, t.SQL_VECTORS)
    + "SELECT book_id, count(chunks.chunk_id) AS n_chunks, count(vectors.chunk_id) AS n_vectors FROM books LEFT JOIN chunks USING (book_id) LEFT JOIN vectors ON vectors.chunk_id = chunks.chunk_id GROUP BY book_id"
)
def chunk_and_vector_counts(spark, sf_dir):
    return catalog.counts(t.books(spark, sf_dir), t.chunks(spark, sf_dir), t.vectors(spark, sf_dir))


@query(with_(t.SQL_CHUNKS) + "SELECT section_path[1] AS lang, section_path[2] AS section, count(*) AS n FROM chunks WHERE content_type = 'text' GROUP BY section_path")
def section_counts(spark, sf_dir):
    rows = s.section_counts(library(spark, sf_dir), s.SearchFilter(content_type="text"))
    return rows.select(F.col("section_path")[0].alias("lang"), F.col("section_path")[1].alias("section"), "n")


@query(with_(t.SQL_CHUNKS) + "SELECT DISTINCT unnest(section_path) AS name FROM chunks")
def section_names(spark, sf_dir):
    return s.section_names(library(spark, sf_dir))


@query(with_(t.SQL_CHUNKS) + "SELECT name FROM (SELECT DISTINCT unnest(section_path) AS name FROM chunks) WHERE contains(lower(name), 'chapter 1') ORDER BY name LIMIT 5")
def section_suggestions(spark, sf_dir):
    inside = s.section_names(library(spark, sf_dir)).where(F.lower("name").contains("chapter 1"))
    return inside.orderBy("name").limit(5)


@query(with_(t.SQL_CHUNKS) + f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id FROM chunks WHERE NOT ({SQL_BOILERPLATE}) AND regexp_matches(content, '\\S')")
def embeddable_chunks(spark, sf_dir):
    return t.chunks(spark, sf_dir).where(~tx.boilerplate(F.col("section_path")) & F.col("content").rlike(r"\S")).select(F.col("chunk_id").cast("long").alias("chunk_id"))


@query(with_(t.SQL_CHUNKS) + "SELECT CAST(chunk_id AS BIGINT) AS chunk_id FROM chunks WHERE content_type IN ('code', 'diagram', 'math') AND length(content) <= 200")
def terse_chunks(spark, sf_dir):
    return t.chunks(spark, sf_dir).where(F.col("content_type").isin(*s.ATOMIC) & (F.length("content") <= 200)).select(F.col("chunk_id").cast("long").alias("chunk_id"))


@query(
    with_(t.SQL_CHUNKS, t.SQL_BOOKS, t.SQL_VECTORS)
    + "SELECT count(*) AS n_orphans FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)"
)
def orphan_vectors(spark, sf_dir):
    return t.vectors(spark, sf_dir).join(t.chunks(spark, sf_dir).select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))


@query(with_(t.SQL_BOOKS, t.SQL_CHUNKS) + "SELECT (SELECT count(*) FROM books) AS books, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors")
def backup_counts(spark, sf_dir):
    return catalog.manifest_counts(t.books(spark, sf_dir), t.chunks(spark, sf_dir), t.vectors(spark, sf_dir))


@query(
    with_(t.SQL_BOOKS, t.SQL_CHUNKS)
    + "SELECT count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks WHERE book_id NOT IN (SELECT book_id FROM books WHERE title = 'src1')"
)
def remove_book(spark, sf_dir):
    books = t.books(spark, sf_dir)
    _, chunks = intake.remove_books(books, t.chunks(spark, sf_dir), removed=books.where("title = 'src1'"))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content").cast("long")).alias("chars"))


@query(with_(t.SQL_BOOKS) + "SELECT book_id, CASE WHEN title = 'src2' THEN 'Second source' ELSE title END AS title, CASE WHEN title = 'src2' THEN NULL ELSE collection END AS collection FROM books")
def update_metadata(spark, sf_dir):
    books = t.books(spark, sf_dir)
    one = books.where("title = 'src2'").select("book_id").first()
    return intake.update_metadata(books, one[0] if one else "", title="Second source", collection="").select("book_id", "title", "collection")


@query(
    "SELECT sha256(text) AS content_hash, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first FROM documents GROUP BY text HAVING count(*) > 1"
)
def duplicate_contents(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(
    """WITH f AS (SELECT doc_id, sha256(text) AS h, CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.epub' END AS suffix, doc_id % 11 <> 0 AS found, doc_id % 13 <> 0 AS parsed FROM documents),
    o AS (SELECT h, min(doc_id) AS first FROM f GROUP BY h)
    SELECT doc_id, CASE WHEN NOT found THEN 'not_found' WHEN lower(suffix) NOT IN ('.epub', '.docx', '.pdf') THEN 'unsupported' WHEN NOT parsed THEN 'parse_failed' WHEN first < doc_id THEN 'duplicate' ELSE 'added' END AS status FROM f JOIN o USING (h)"""
)
def intake_status(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 7 == 0, ".txt").when(F.col("doc_id") % 7 == 1, ".PDF").otherwise(".epub")
    files = d.select("doc_id", F.sha2("text", 256).alias("h"), suffix.alias("suffix"), (F.col("doc_id") % 11 != 0).alias("exists"), (F.col("doc_id") % 13 != 0).alias("parsed"))
    first = files.groupBy("h").agg(F.min("doc_id").alias("first"))
    twins = files.join(first, "h").withColumns({"byte_twin": F.when(F.col("first") < F.col("doc_id"), F.col("first")), "text_twin": F.lit(None).cast("long")})
    return twins.select("doc_id", intake.intake_status("reject").alias("status"))


@query()
def similar_titles(spark, sf_dir):
    return intake.similar_titles(t.books(spark, sf_dir), "src1")


@query(
    with_(t.SQL_BOOKS, t.SQL_CHUNKS, "st AS (SELECT book_id, CASE WHEN count(*) % 3 = 0 THEN 'partial' WHEN count(*) % 3 = 1 THEN 'success' ELSE 'skipped' END AS status FROM chunks GROUP BY book_id)")
    + "SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'skipped') AS skipped, bool_and(status = 'success') AS ok FROM st"
)
def reindex_report(spark, sf_dir):
    n = F.col("n") % 3
    rows = t.chunks(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).select(F.when(n == 0, "partial").when(n == 1, "success").otherwise("skipped").alias("status"))
    return catalog.reindex_report(rows, ("success", "partial", "skipped"))


# Vectors


@query("SELECT CAST(vec_id AS BIGINT) AS chunk_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS sq, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS first FROM embeddings")
def l2_normalise(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    return v.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.round(semantic.norm(F.col("embedding")) * semantic.norm(F.col("embedding")), 4).alias("sq"), F.round(semantic.l2_normalise(F.col("embedding"))[0], 4).alias("first"))


@query("SELECT label AS chunk_id, CAST(min(vec_id) AS BIGINT) AS kept FROM embeddings GROUP BY label")
def first_vectors(spark, sf_dir):
    v = t.read(spark, sf_dir, "embeddings").select(F.col("label").alias("chunk_id"), "vec_id", "embedding")
    return semantic.first_copies(v, "vec_id").select("chunk_id", F.col("vec_id").alias("kept"))


# Text functions

SQL_ISBN = "SELECT printf('%09d', (doc_id * 7919 + 12345) % 1000000000) || CAST(doc_id % 10 AS VARCHAR) AS isbn, doc_id FROM documents"


@query(
    f"""WITH i AS ({SQL_ISBN}), v AS (SELECT *, list_sum(list_transform(range(1, 11), lambda k: CAST(substr(isbn, k, 1) AS BIGINT) * (11 - k))) % 11 = 0 AS ok, list_sum(list_transform(range(1, 13), lambda k: CAST(substr('978' || isbn, k, 1) AS BIGINT) * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END)) AS s13 FROM i)
    SELECT doc_id, ok, CASE WHEN ok THEN '978' || substr(isbn, 1, 9) || CAST((10 - s13 % 10) % 10 AS VARCHAR) END AS isbn13 FROM v"""
)
def isbn_checks(spark, sf_dir):
    raw = F.concat(F.lpad(((F.col("doc_id") * 7919 + 12345) % 1000000000).cast("string"), 9, "0"), (F.col("doc_id") % 10).cast("string"))
    d = t.read(spark, sf_dir, "documents").select("doc_id", tx.isbn_clean(F.concat(F.lit("urn:isbn:"), raw)).alias("isbn"))
    return d.select("doc_id", tx.isbn_valid(F.col("isbn")).alias("ok"), tx.isbn_13(F.col("isbn")).alias("isbn13"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) AS BIGINT) AS tokens, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def text_functions(spark, sf_dir):
    x = F.col("text")
    return t.read(spark, sf_dir, "documents").select("doc_id", tx.collapse_space(x).alias("collapsed"), tx.token_count(x).cast("long").alias("tokens"), tx.preview(x).alias("preview"))


@query(
    """SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ', '), ','), lambda x: trim(x)), lambda x: x <> '') AS authors,
    lower(regexp_replace(p_name, '\\W+', '', 'g')) AS key FROM part"""
)
def name_functions(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.split_authors(F.regexp_replace("p_name", " ", ", ")).alias("authors"), tx.plain_name(F.col("p_name")).alias("key"))


@query("SELECT doc_id, source || ', ' || CAST(doc_id % 9 + 1 AS VARCHAR) || 'th Edition' AS title, source AS bare, CAST(1900 + doc_id % 120 AS VARCHAR) AS year FROM documents")
def edition_and_year(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(", "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("th Edition")).alias("title"), (1900 + F.col("doc_id") % 120).cast("string").alias("y"))
    return d.select("doc_id", "title", tx.strip_edition(F.col("title")).alias("bare"), tx.find_year(F.concat(F.lit("printed in "), F.col("y"), F.lit("."))).alias("year"))


@query()
def boundary_truncation(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", tx.truncate_at_boundary(F.col("text"), 200).alias("cut"))


# Page layout on boxes made from the documents

SQL_BOXES = """boxes AS (SELECT doc_id // 10 AS page, CAST(doc_id % 10 AS DOUBLE) AS y, CASE WHEN doc_id % 10 = 0 THEN 'Running head ' || CAST(doc_id // 10 AS VARCHAR) ELSE text END AS text, doc_id FROM documents)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.read(spark, sf_dir, "documents")
    page = F.floor(F.col("doc_id") / 10)
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Running head "), page.cast("string"))).otherwise(F.col("text"))
    return d.select(page.alias("page"), (F.col("doc_id") % 10).cast("double").alias("y"), text.alias("text"), "doc_id")


@query(
    f"""WITH {SQL_BOXES}, k AS (SELECT *, nullif(trim(regexp_replace(lower(text), '[0-9]+', '', 'g')), '') AS key FROM boxes),
    n AS (SELECT *, EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND o.page <> k.page AND o.page BETWEEN k.page - 3 AND k.page + 3) AS furniture FROM k)
    SELECT doc_id FROM n WHERE NOT (furniture AND (y < 1 OR y > 8.9))"""
)
def page_furniture(spark, sf_dir):
    return layout.without_furniture(boxes(spark, sf_dir).withColumn("edge", (F.col("y") < 1) | (F.col("y") > 8.9))).select("doc_id")


@query(
    f"""WITH {SQL_BOXES}, o AS (SELECT page, 3.0 AS y, 'Part ' || CAST(page AS VARCHAR) AS title FROM boxes WHERE doc_id % 20 = 0)
    SELECT doc_id, (SELECT max_by(title, (o.page, o.y)) FROM o WHERE (o.page, o.y) <= (b.page, b.y)) AS section FROM boxes b"""
)
def outline_sections(spark, sf_dir):
    b = boxes(spark, sf_dir)
    marks = b.where("doc_id % 20 = 0").select("page", F.lit(3.0).alias("y"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("title"))
    return layout.sections(b, marks).select("doc_id", F.col("title").alias("section"))


# Files


@query()
def page_blocks(spark, sf_dir):
    return html_blocks.extract(t.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_file"), "html"))


@query()
def chunk_documents(spark, sf_dir):
    blocks = t.spread(t.read(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("block_index", "content"), F.lit("text").alias("content_type"),
        F.array("lang").alias("section_path"), F.lit(None).cast("string").alias("language"), F.lit("").alias("source_file"),
    )
    return chunker.chunk(blocks).select("chunk_id", "book_id", "sequence", "token_count", "content", "sections")
