"""The engine's registered queries over the test tables, and their SQL.

Every query calls the public operators; the SQL states the projection and the operator
anew. Text columns only, so results can be compared by value: arrays are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.functions import hashing, paths, text
from sparkindex.model import Index, file_id
from sparkindex.operators import budget, evaluation, lookups, scan, search, snapshot
from sparkindex.operators.extraction import extracted, refs_of, symbols_of
from sparkindex.plans import indexing, samples
from sparkindex.plans.facade import CodeIndex
from sparkindex.plans.projections import NOW, event_log, star_index, star_relations, table, tasks
from sparkindex.plans.store import Store
from sparkindex.sources.records import read_log, write_log
from sparkindex.sources.tree import read_tree
from sparkindex.streaming import watch as watching

NAME = "red widget Brand#17"
NAMES = ["red widget Brand#17", "small ring Brand#2", "MEDIUM.blue bolt Brand#4", "nothing"]
PREFIX = "Red W_dget%"
WORDS = "red wid"

#: The star schema as files, symbols and references, and their resolution.
STAR = """
WITH n AS (SELECT count(*) AS n FROM supplier),
files AS (
  SELECT s_suppkey AS fid, r_name || '/' || n_name || '/' || s_name || '.py' AS path, 'python' AS language, md5(s_name) AS content_hash,
         coalesce(epoch((SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey)), 0)::DOUBLE AS mtime
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT p_partkey, p_name || ' ' || p_brand AS name, p_type, p_size, p_partkey % n.n AS home FROM part, n),
rows_ AS (
  SELECT home AS fid, p_partkey, name, p_type || '.' || name AS qualified_name,
         CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'method' ELSE 'const' END AS kind,
         (p_partkey % 40 + 1)::INT AS start_line, (p_partkey % 40 + 1 + p_size)::INT AS end_line, NULL::VARCHAR AS signature
  FROM parts
  UNION ALL
  SELECT (home + j) % n.n, p_partkey, name, name, 'import', 1, 1, replace(left(path, length(path) - 3), '/', '.') || '.' || name
  FROM parts JOIN files ON fid = home, n, range(1, 6) r(j)),
symbols AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY start_line, qualified_name, p_partkey) - 1 AS ordinal FROM rows_),
refs AS (SELECT DISTINCT l_suppkey AS fid, name, (l_orderkey % 60 + 1)::INT AS line FROM lineitem JOIN parts ON l_partkey = p_partkey),
defs AS (SELECT * FROM symbols WHERE kind <> 'import'),
own AS (
  SELECT r.fid, r.name, r.line, d.fid AS dfid, d.ordinal AS dordinal,
         row_number() OVER (PARTITION BY r.fid, r.name, r.line ORDER BY (r.line BETWEEN d.start_line AND d.end_line) DESC,
           CASE WHEN r.line BETWEEN d.start_line AND d.end_line THEN -d.start_line ELSE d.start_line END, d.ordinal) AS nth
  FROM refs r JOIN defs d ON r.fid = d.fid AND r.name = d.name),
first_import AS (SELECT fid, name, arg_min(signature, ordinal) AS signature FROM symbols WHERE kind = 'import' GROUP BY 1, 2),
followed AS (
  SELECT i.fid, i.name, d.fid AS dfid, d.ordinal AS dordinal, row_number() OVER (PARTITION BY i.fid, i.name ORDER BY d.start_line, d.ordinal) AS nth
  FROM first_import i JOIN files f ON f.path = replace(left(i.signature, length(i.signature) - length(i.name) - 1), '.', '/') || '.py'
  JOIN defs d ON d.fid = f.fid AND d.name = i.name),
only_one AS (SELECT name, min(fid) AS dfid, min(ordinal) AS dordinal FROM defs GROUP BY 1 HAVING count(*) = 1),
resolved AS (
  SELECT r.fid, r.name, r.line, coalesce(o.dfid, w.dfid, u.dfid) AS dfid, coalesce(o.dordinal, w.dordinal, u.dordinal) AS dordinal,
         CASE WHEN o.dfid IS NOT NULL THEN 'exact' WHEN w.dfid IS NOT NULL THEN 'import' ELSE 'name-only' END AS confidence
  FROM refs r LEFT JOIN own o ON o.fid = r.fid AND o.name = r.name AND o.line = r.line AND o.nth = 1
  LEFT JOIN followed w ON w.fid = r.fid AND w.name = r.name AND w.nth = 1
  LEFT JOIN only_one u ON u.name = r.name),
usages AS (
  SELECT f.path, r.name, r.line, r.confidence, t.path AS resolved_path, d.qualified_name AS resolved_qualified_name, r.dfid, r.dordinal, r.fid
  FROM resolved r JOIN files f ON f.fid = r.fid LEFT JOIN files t ON t.fid = r.dfid LEFT JOIN symbols d ON d.fid = r.dfid AND d.ordinal = r.dordinal)
"""
MAPPED = """,
inbound AS (SELECT dfid AS fid, count(*) AS n FROM resolved WHERE dfid IS NOT NULL AND dfid <> fid GROUP BY 1),
sizes AS (SELECT fid, count(*) AS n FROM symbols GROUP BY 1),
ranked AS (SELECT f.fid, path, language, coalesce(s.n, 0) AS symbol_count, coalesce(i.n, 0) AS incoming_refs FROM files f LEFT JOIN sizes s USING (fid) LEFT JOIN inbound i USING (fid) ORDER BY incoming_refs DESC, path LIMIT 50),
tops AS (SELECT fid, string_agg(qualified_name, '|' ORDER BY nth) AS top FROM (SELECT fid, qualified_name, row_number() OVER (PARTITION BY fid ORDER BY start_line, ordinal) AS nth FROM symbols WHERE kind <> 'import') WHERE nth <= 10 GROUP BY 1)
"""
FIRST_50 = "ORDER BY path, start_line, ordinal LIMIT 50"
FIRST_200 = "ORDER BY path, start_line, ordinal LIMIT 200"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


PUBLIC = ["name", "qualified_name", "kind", "path", "start_line", "end_line", "signature"]
SQL_PUBLIC = "name, qualified_name, kind, path, start_line, end_line, signature"


@query(STAR + MAPPED + "SELECT path, language, symbol_count, incoming_refs, coalesce(top, '') AS top_symbols FROM ranked LEFT JOIN tops USING (fid)")
def repo_map(spark, sf_dir):
    return lookups.repo_map(star_index(spark, sf_dir)).withColumn("top_symbols", F.array_join("top_symbols", "|")).withColumn("incoming_refs", F.col("incoming_refs").cast("long"))


@query(STAR + "SELECT path, name, line, confidence, resolved_path, resolved_qualified_name FROM usages")
def resolve_references(spark, sf_dir):
    return usages(star_index(spark, sf_dir))


def usages(index: Index) -> DataFrame:
    return snapshot.snapshot(index)["refs"]


@query(STAR + "SELECT confidence, resolved_path IS NOT NULL AS found, count(*) AS n FROM usages GROUP BY 1, 2")
def resolution_tiers(spark, sf_dir):
    return star_index(spark, sf_dir).refs.groupBy("confidence", F.col("resolved_symbol_id").isNotNull().alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query(STAR + f"SELECT {SQL_PUBLIC} FROM symbols JOIN files USING (fid) WHERE name = '{NAME}' OR qualified_name = '{NAME}' {FIRST_50}")
def lookup_exact(spark, sf_dir):
    return lookups.lookup_exact(star_index(spark, sf_dir), NAME).select(*PUBLIC)


@query(STAR + f"SELECT {SQL_PUBLIC} FROM symbols JOIN files USING (fid) WHERE lower(name) LIKE lower('{PREFIX}') ESCAPE '\\' {FIRST_200}")
def lookup_prefix(spark, sf_dir):
    return lookups.lookup_like(star_index(spark, sf_dir), PREFIX).select(*PUBLIC)


@query(STAR + f"SELECT {SQL_PUBLIC} FROM defs JOIN files USING (fid) WHERE name = '{NAME}' OR qualified_name = '{NAME}' {FIRST_50}")
def find_definition(spark, sf_dir):
    return lookups.find_definition(star_index(spark, sf_dir), NAME).select(*PUBLIC)


ASKED = "asked AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS query)"


@query(STAR + f", {ASKED}, hits AS (SELECT query, {SQL_PUBLIC}, row_number() OVER (PARTITION BY query ORDER BY path, start_line, ordinal) AS nth FROM asked JOIN defs ON name = query OR qualified_name = query JOIN files USING (fid)) SELECT query, {SQL_PUBLIC} FROM hits WHERE nth <= 50")
def find_definitions(spark, sf_dir):
    return lookups.find_definitions(star_index(spark, sf_dir), spark.createDataFrame([(n,) for n in NAMES], "query string")).select("query", *PUBLIC)


FOUND_REFS = """,
ids AS (SELECT query, fid AS dfid, ordinal AS dordinal, row_number() OVER (PARTITION BY query ORDER BY path, start_line, ordinal) AS nth FROM asked JOIN defs ON name = query OR qualified_name = query JOIN files USING (fid)),
hits AS (
  SELECT query, path, line, name, confidence, resolved_path, resolved_qualified_name FROM usages JOIN ids USING (dfid, dordinal) WHERE nth <= 50
  UNION ALL
  SELECT query, path, line, name, confidence, NULL, NULL FROM usages JOIN asked ON name = split_part(query, '.', -1) WHERE dfid IS NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY resolved_qualified_name IS NULL, path, line, name) AS nth FROM hits)
"""


@query(STAR + f", {ASKED}" + FOUND_REFS + "SELECT query, path, line, name, confidence, resolved_path, resolved_qualified_name FROM numbered WHERE nth <= 200")
def find_all_references(spark, sf_dir):
    return lookups.find_all_references(star_index(spark, sf_dir), spark.createDataFrame([(n,) for n in NAMES], "query string"))


@query(STAR + f", asked AS (SELECT '{NAME}' AS query)" + FOUND_REFS + "SELECT path, line, name, confidence, resolved_path, resolved_qualified_name FROM numbered WHERE nth <= 200")
def find_references(spark, sf_dir):
    return lookups.find_references(star_index(spark, sf_dir), NAME)


@query(STAR + "SELECT path, name, qualified_name, kind, start_line, end_line, signature, NULL::VARCHAR AS parent FROM symbols JOIN files USING (fid)")
def outline(spark, sf_dir):
    return lookups.outline(star_index(spark, sf_dir)).drop("ordinal")


@query(STAR + "SELECT path, name, qualified_name, kind, start_line, end_line, signature, NULL::VARCHAR AS parent FROM symbols JOIN files USING (fid) WHERE path = (SELECT min(path) FROM files)")
def outline_file(spark, sf_dir):
    index = star_index(spark, sf_dir)
    return lookups.outline_file(index, index.files.agg(F.min("path")).first()[0])


@query("SELECT path, language, content_hash, mtime FROM files".join([STAR, " WHERE path LIKE '%000000007.py'"]))
def file_record(spark, sf_dir):
    index = star_index(spark, sf_dir)
    return lookups.file_record(index, index.files.where("path like '%000000007.py'").first().path).select("path", "language", "content_hash", "mtime")


@query(STAR + "SELECT path FROM files")
def indexed_paths(spark, sf_dir):
    return lookups.indexed_paths(star_index(spark, sf_dir))


@query(STAR + "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs")
def index_stats(spark, sf_dir):
    return lookups.stats(star_index(spark, sf_dir))


@query("SELECT 60000::BIGINT AS index_age_ms")
def index_age(spark, sf_dir):
    return lookups.index_age_ms(star_index(spark, sf_dir), NOW)


FTS = f"""
, tokened AS (
  SELECT s.*, path, regexp_extract_all(lower(name), '[\\pL\\pN]+') || regexp_extract_all(lower(qualified_name), '[\\pL\\pN]+') || coalesce(regexp_extract_all(lower(signature), '[\\pL\\pN]+'), []) AS t
  FROM symbols s JOIN files USING (fid)),
counted AS (SELECT *, len(t) AS d, len(list_filter(t, lambda x: starts_with(x, '{WORDS.split()[0]}'))) AS f0, len(list_filter(t, lambda x: starts_with(x, '{WORDS.split()[1]}'))) AS f1 FROM tokened),
totals AS (SELECT count(*) AS n, avg(d) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM counted),
idf AS (SELECT *, ln((n - n0 + 0.5) / (n0 + 0.5)) AS i0, ln((n - n1 + 0.5) / (n1 + 0.5)) AS i1 FROM totals),
matched AS (
  SELECT c.*, -(CASE WHEN i0 > 0 THEN i0 ELSE 1e-6 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / a)) - (CASE WHEN i1 > 0 THEN i1 ELSE 1e-6 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / a)) AS score
  FROM counted c, idf WHERE f0 > 0 AND f1 > 0)
"""


@query(STAR + FTS + f"SELECT {SQL_PUBLIC}, round(score, 6) AS score FROM matched")
def token_search(spark, sf_dir):
    return search.token_matches(star_index(spark, sf_dir), WORDS).select(*PUBLIC, F.round("score", 6).alias("score"))


RANKED = (
    FTS
    + f"""
, pool AS (
  SELECT fid, ordinal, max(tier) AS tier FROM (
    (SELECT fid, ordinal, 3 AS tier FROM symbols JOIN files USING (fid) WHERE name = '{WORDS}' OR qualified_name = '{WORDS}' ORDER BY path, start_line, ordinal LIMIT 200)
    UNION ALL (SELECT fid, ordinal, 2 FROM symbols JOIN files USING (fid) WHERE lower(name) LIKE '{WORDS}%' ORDER BY path, start_line, ordinal LIMIT 200)
    UNION ALL (SELECT fid, ordinal, 1 FROM symbols JOIN files USING (fid) WHERE lower(name) LIKE '%{WORDS}%' ORDER BY path, start_line, ordinal LIMIT 200)
    UNION ALL (SELECT fid, ordinal, 0 FROM matched ORDER BY round(score, 9), path, start_line, ordinal LIMIT 200)) GROUP BY 1, 2),
uses AS (SELECT dfid AS fid, dordinal AS ordinal, ln(1 + count(*)) AS u FROM resolved WHERE dfid IS NOT NULL GROUP BY 1, 2),
recency AS (SELECT fid, (row_number() OVER (ORDER BY mtime, path) - 1) / greatest(count(*) OVER () - 1, 1) AS recency FROM files),
recent AS (SELECT path AS rpath FROM files ORDER BY mtime DESC, path LIMIT 20),
near AS (
  SELECT fid, max(CASE WHEN path = rpath THEN 1.0 WHEN split_part(path, '/', 1) <> split_part(rpath, '/', 1) THEN 0.0 WHEN split_part(path, '/', 2) <> split_part(rpath, '/', 2) THEN 0.5 ELSE 1.0 END) AS locality
  FROM files, recent GROUP BY 1),
featured AS (
  SELECT s.*, f.path, tier, CASE kind WHEN 'function' THEN 1.0 WHEN 'class' THEN 1.0 WHEN 'method' THEN 0.9 WHEN 'const' THEN 0.6 WHEN 'import' THEN 0.3 ELSE 0.5 END AS kind_weight,
         coalesce(u / max(u) OVER (), 0) AS popularity, locality, recency
  FROM pool JOIN symbols s USING (fid, ordinal) JOIN files f USING (fid) LEFT JOIN uses USING (fid, ordinal) JOIN recency USING (fid) JOIN near USING (fid))
"""
)


@query(STAR + RANKED + f"SELECT {SQL_PUBLIC}, tier AS match_tier, round(kind_weight, 6)::DOUBLE AS kind_weight, round(popularity, 6)::DOUBLE AS popularity, round(locality, 6)::DOUBLE AS locality, round(recency, 6)::DOUBLE AS recency FROM featured")
def search_features(spark, sf_dir):
    index = star_index(spark, sf_dir)
    found = search.features(index, search.candidates(index, WORDS))
    return found.select(*PUBLIC, "match_tier", *[F.round(c, 6).alias(c) for c in ("kind_weight", "popularity", "locality", "recency")])


@query(STAR + RANKED + f"SELECT {SQL_PUBLIC}, round(tier + kind_weight + popularity + 0.5 * locality + 0.5 * recency, 5)::DOUBLE AS score FROM featured ORDER BY tier + kind_weight + popularity + 0.5 * locality + 0.5 * recency DESC, path, start_line, ordinal LIMIT 20")
def ranked_search(spark, sf_dir):
    best, _ = search.ranked_search(star_index(spark, sf_dir), WORDS)
    return best.select(*PUBLIC, F.round("score", 5).alias("score"))


@query(STAR + "SELECT path, sum(mtime)::DOUBLE AS mtime, (row_number() OVER (ORDER BY sum(mtime), path) - 1) / greatest(count(*) OVER () - 1, 1) AS recency FROM files GROUP BY path")
def recency_rank(spark, sf_dir):
    index = star_index(spark, sf_dir)
    return index.files.select("path", "mtime").join(search.recency(index.files), "path")


@query(STAR + "SELECT d.name, d.qualified_name, path, count(r.fid) AS uses, round(ln(1 + count(r.fid)), 6) AS popularity FROM defs d JOIN files USING (fid) JOIN resolved r ON r.dfid = d.fid AND r.dordinal = d.ordinal GROUP BY d.name, d.qualified_name, path, d.fid, d.ordinal")
def popularity(spark, sf_dir):
    index = star_index(spark, sf_dir)
    uses = index.refs.where("resolved_symbol_id is not null").groupBy(F.col("resolved_symbol_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("uses"))
    return lookups.symbol_rows(index).join(uses, "symbol_id").select("name", "qualified_name", "path", "uses", F.round(F.log1p("uses"), 6).alias("popularity"))


@query(
    STAR
    + """, lined AS (SELECT path, ordinal, qualified_name || '  ' || kind || '  ' || path || ':' || start_line || coalesce('  ' || signature, '') AS line FROM symbols JOIN files USING (fid)),
    spent AS (SELECT path, ordinal, line, row_number() OVER w AS nth, sum(CASE WHEN line = '' THEN 0 ELSE greatest(1, length(line) // 4) END) OVER w AS spent FROM lined WINDOW w AS (PARTITION BY path ORDER BY ordinal))
    SELECT path, ordinal::INT AS ordinal, line FROM spent WHERE nth = 1 OR spent <= 700"""
)
def budgeted_outlines(spark, sf_dir):
    rows = lookups.symbol_rows(star_index(spark, sf_dir)).select("path", "ordinal", budget.symbol_line().alias("line"))
    return budget.within_budget(rows, by=("path",), order="ordinal")


@query(
    STAR
    + """, f AS (SELECT path, content_hash FROM files), live AS (SELECT path, CASE WHEN path LIKE '%3.py' THEN 'x' ELSE content_hash END AS content_hash FROM f WHERE path NOT LIKE '%5.py' UNION ALL SELECT 'extra.py', 'y')
    SELECT 'files' AS "table", CASE WHEN w THEN 'missing' ELSE 'extra' END AS side, path, content_hash FROM
    ((SELECT true AS w, * FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM live)) UNION ALL (SELECT false, * FROM (SELECT * FROM live EXCEPT ALL SELECT * FROM f)))"""
)
def drift_files(spark, sf_dir):
    expected, live = _two_states(spark, sf_dir)
    rows = snapshot.difference(expected.select("path", "content_hash"), live.select("path", "content_hash"), "files")
    return rows.select("table", "side", F.get_json_object("row", "$.path").alias("path"), F.get_json_object("row", "$.content_hash").alias("content_hash"))


def _two_states(spark, sf_dir):
    files = star_relations(spark, sf_dir)[0].select("path", "content_hash")
    live = files.where("path not like '%5.py'").withColumn("content_hash", F.when(F.col("path").like("%3.py"), "x").otherwise(F.col("content_hash")))
    return files, live.unionByName(spark.createDataFrame([("extra.py", "y")], "path string, content_hash string"))


@query(
    STAR
    + """, f AS (SELECT path, content_hash FROM files), live AS (SELECT path, CASE WHEN path LIKE '%3.py' THEN 'x' ELSE content_hash END AS content_hash FROM f WHERE path NOT LIKE '%5.py' UNION ALL SELECT 'extra.py', 'y' UNION ALL SELECT path, NULL FROM f WHERE path LIKE '%5.py' UNION ALL SELECT 'never.py', NULL)
    SELECT live.path, CASE WHEN live.content_hash IS NULL AND f.path IS NULL THEN 'absent' WHEN live.content_hash IS NULL THEN 'removed' WHEN live.content_hash = f.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM live LEFT JOIN f USING (path)"""
)
def refresh_outcomes(spark, sf_dir):
    files, live = _two_states(spark, sf_dir)
    gone = files.where("path like '%5.py'").select("path").unionByName(spark.createDataFrame([("never.py",)], "path string"))
    states = live.withColumn("state", F.lit("ok")).unionByName(gone.select("path", F.lit(None).cast("string").alias("content_hash"), F.lit("gone").alias("state")))
    return indexing.outcomes(files, states)


@query(STAR + ", live AS (SELECT path FROM files WHERE path NOT LIKE '%5.py') SELECT path FROM files WHERE path NOT IN (SELECT path FROM live)")
def stale_paths(spark, sf_dir):
    files, live = _two_states(spark, sf_dir)
    return snapshot.stale_paths(Index(files, files, files), live)


@query(STAR.replace("FROM lineitem JOIN parts", "FROM (SELECT * FROM lineitem WHERE l_suppkey % 7 <> 0) lineitem JOIN parts").replace("rows_ AS (", "rows_ AS (SELECT * FROM (", 1).replace("symbols AS (SELECT *", ") WHERE fid % 7 <> 0),\nsymbols AS (SELECT *", 1).replace("n, range(1, 6) r(j)),", "n, range(1, 6) r(j)", 1).replace("n_regionkey = r_regionkey),", "n_regionkey = r_regionkey WHERE true),", 1) + "SELECT path, name, line, confidence, resolved_path, resolved_qualified_name FROM usages")
def remove_files(spark, sf_dir):
    """Every seventh file goes; what pointed into it is resolved anew."""
    index = star_index(spark, sf_dir)
    n = F.substring_index(F.substring_index("path", "#", -1), ".", 1).cast("long")
    return usages(indexing.replaced(index, index.files.where(n % 7 == 0).select("path"), None))


# --- texts -------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM documents)
    SELECT doc_id, n::INT AS n, left(trim(line), 160) AS shown FROM l WHERE regexp_matches(line, '(?i)licen[sc]ed? ')"""
)
def grep_documents(spark, sf_dir):
    return scan.grep(table(spark, sf_dir, "documents"), "(?i)licen[sc]ed? ", "doc_id", "text")


@query("SELECT doc_id, length(text) AS chars, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, array_to_string(list_transform(list_zip(string_split(text, chr(10))[2:4], range(2, 5)[1:len(string_split(text, chr(10))[2:4])]), lambda x: x[2]::VARCHAR || ': ' || x[1]), chr(10)) AS shown FROM documents""")
def line_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scan.line_window(F.col("text"), 2, 4).alias("shown"))


@query()
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.blake2b(F.encode("text", "utf-8")).alias("content_hash"))


@query("SELECT page_id, left(sha256(url), 16) AS repository_id FROM pages")
def repository_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.repository_id(F.col("url")).alias("repository_id"))


@query("SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE octet_length(encode(html)) <= 4096")
def size_cap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes")).where("bytes <= 4096")


PATHS = ["a/b.py", "a/b.PYI", "c.jsx", "x/.py", "y/z.d.ts", "y/z.tsx", "dist/a.py", "src/build", "node_modules/x/i.js", "deep/.git/h.py", "venv.py", "a.b/c", "q.mts", "r.cjs", "noext"]


@query(
    "SELECT path, CASE WHEN suffix IN ('.py', '.pyi') THEN 'python' WHEN suffix IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript' WHEN suffix IN ('.ts', '.mts', '.cts') THEN 'typescript' WHEN suffix = '.tsx' THEN 'tsx' END AS language, "
    "list_has_any(string_split(path, '/')[:-2], ['.git', '.hg', '.svn', '__pycache__', '.mypy_cache', '.pytest_cache', '.ruff_cache', '.tox', '.venv', 'venv', 'node_modules', 'dist', 'build']) AS ignored FROM (SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in PATHS)
    + "]) AS path))"
)
def path_rules(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return rows.select("path", paths.language_of(F.col("path")).alias("language"), paths.is_ignored(F.col("path")).alias("ignored"))


# --- evaluation --------------------------------------------------------------------------

LOG = """
WITH log AS (
  SELECT epoch_us(ts) / 1e6 AS ts, 'task' || (user_id % 8) AS task, event_type AS contestant, ((user_id // 8) % 3)::INT AS rep, event_id AS seq, event_id % 4 AS what,
         floor(value)::BIGINT AS value, (props::JSON ->> '$.k')::BIGINT AS k, event_id
  FROM events),
results AS (SELECT task, contestant, rep, arg_max('see src\\f' || (k % 5) || '.py, line ' || k, seq) AS answer, max(seq) % 16 = 15 AS failed FROM log WHERE what = 3 GROUP BY 1, 2, 3),
sums AS (SELECT task, contestant, rep, coalesce(sum(value + k) FILTER (what < 2), 0)::BIGINT AS total_tokens, round(max(ts) - min(ts), 3) AS wall_seconds FROM log GROUP BY 1, 2, 3),
reads AS (SELECT DISTINCT task, contestant, rep, CASE WHEN event_id % 32 <> 2 THEN 'src/f' || (k % 5) || '.py' ELSE '' END AS p FROM log WHERE what = 2 AND event_id % 16 <> 14),
wasted AS (SELECT task, contestant, rep, count(*) FILTER (p = '' OR r.answer IS NULL OR NOT contains(r.answer, p)) AS n FROM reads LEFT JOIN results r USING (task, contestant, rep) GROUP BY 1, 2, 3),
plain AS (SELECT *, replace(answer, '\\', '/') AS a, regexp_extract(answer, '([0-9]+)$', 1)::INT AS num FROM results),
episodes AS (
  SELECT task, contestant, rep, coalesce(NOT failed AND CASE task
      WHEN 'task0' THEN contains(a, 'src/f0.py') WHEN 'task1' THEN contains(a, 'src/f1.py') AND num BETWEEN 1 AND 60 WHEN 'task2' THEN true
      WHEN 'task3' THEN num % 2 = 0 WHEN 'task4' THEN contains(a, 'src/f4') WHEN 'task5' THEN contains(a, 'src/f2.py') AND num BETWEEN 10 AND 99
      WHEN 'task6' THEN contains(a, 'f1.py') OR contains(a, 'f3.py') ELSE false END, false) AS success,
    total_tokens, coalesce(n, 0)::INT AS wasted_reads, wall_seconds
  FROM sums LEFT JOIN plain USING (task, contestant, rep) LEFT JOIN wasted USING (task, contestant, rep))
"""


@query(LOG + "SELECT * FROM episodes")
def episodes(spark, sf_dir):
    return evaluation.rebuild_episodes(event_log(spark, sf_dir), tasks(spark))


@query(
    LOG
    + """SELECT contestant, count(*) AS episodes, round(avg(success::INT), 4) AS success_rate, quantile_cont(total_tokens::DOUBLE, 0.5) AS tokens_median, round(quantile_cont(total_tokens::DOUBLE, 0.25), 3) AS tokens_low,
    round(quantile_cont(total_tokens::DOUBLE, 0.75), 3) AS tokens_high, quantile_cont(wasted_reads::DOUBLE, 0.5) AS wasted_reads_median, quantile_cont(wall_seconds, 0.5) AS wall_median,
    CASE WHEN sum(success::INT) > 0 THEN round(sum(total_tokens) / 1000000 * 3.0 / sum(success::INT), 6) END AS cost_per_solved FROM episodes GROUP BY 1"""
)
def league(spark, sf_dir):
    return evaluation.league(evaluation.rebuild_episodes(event_log(spark, sf_dir), tasks(spark)), 3.0)


BAD_TASKS = [
    ("a", "dev", "q", ("location", "f.py", [1, 2], None, None)),
    ("b", "test", "q", ("regex", None, None, None, "x")),
    ("c", "dev", "q", ("guess", None, None, None, None)),
    ("d", "dev", "q", ("location", None, None, None, None)),
    ("e", "dev", "q", ("location", "f.py", [5, 2], None, None)),
    ("f", "dev", "q", ("contains_all", None, None, [], None)),
    ("g", "dev", "q", ("regex", None, None, None, None)),
    ("h", "holdout", " ", ("regex", None, None, None, "x")),
    ("a", "dev", "q", ("regex", None, None, None, "x")),
]


@query("SELECT * FROM (VALUES ('b', 'unknown split'), ('c', 'unknown check'), ('d', 'file is missing'), ('e', 'lines out of order'), ('f', 'values are missing'), ('g', 'pattern is missing'), ('h', 'question is blank'), ('a', 'id is used twice')) v(id, problem)")
def task_problems(spark, sf_dir):
    return evaluation.task_problems(tasks(spark, BAD_TASKS))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN regexp_matches(text, '[0-9]') ELSE contains(replace(text, '\\', '/'), 'the') AND contains(replace(text, '\\', '/'), 'and') END AS right_ FROM conversations")
def answer_checks(spark, sf_dir):
    empty = F.lit(None).cast("string")
    check = F.struct(F.when(F.col("role") == "user", "regex").otherwise("contains_all").alias("type"), empty.alias("file"), F.lit(None).cast("array<int>").alias("line_between"), F.array(F.lit("the"), F.lit("and")).alias("values"), F.lit("[0-9]").alias("pattern"))
    rows = table(spark, sf_dir, "conversations").withColumn("check", check)
    return rows.select("conv_id", "turn", evaluation.answer_is_right(F.col("check"), F.col("text")).alias("right_"))


# --- source text -------------------------------------------------------------------------


def _values(rows: list[tuple], names: str) -> str:
    def cell(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


def _samples(spark):
    return spark.createDataFrame([(p, lang, bytearray(source.encode())) for p, lang, source in samples.SOURCES], "path string, language string, content binary")


@query(_values(samples.SYMBOLS, "path, name, qualified_name, kind, start_line, end_line, signature, parent"))
def extract_symbols(spark, sf_dir):
    symbols = symbols_of(extracted(_samples(spark)))
    files = _samples(spark).select(file_id(F.col("path")).alias("file_id"), "path")
    parents = symbols.select(F.col("symbol_id").alias("parent_id"), F.col("qualified_name").alias("parent"))
    return symbols.join(parents, "parent_id", "left").join(files, "file_id").select("path", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "parent")


@query(_values(samples.REFERENCES, "path, name, line"))
def extract_references(spark, sf_dir):
    files = _samples(spark).select(file_id(F.col("path")).alias("file_id"), "path")
    return refs_of(extracted(_samples(spark))).join(files, "file_id").select("path", "name", "line")


@query(_values(samples.RESOLVED, "path, name, line, confidence, resolved_path, resolved_qualified_name"))
def resolve_sources(spark, sf_dir):
    rows = _samples(spark).withColumns({"content_hash": F.lit(""), "mtime": F.lit(0.0)})
    return usages(indexing.index_of(rows, NOW))


@query(_values(samples.CANDIDATES, "language, target, importing, candidates"))
def import_candidates(spark, sf_dir):
    rows = spark.createDataFrame([r[:3] for r in samples.CANDIDATES], "language string, target string, importing string")
    found = paths.import_candidates(F.col("target"), F.col("language"), F.col("importing"))
    return rows.select("language", "target", "importing", F.array_join(F.transform(found, lambda c: F.concat(c["path"], F.lit("#"), c["name"])), " ").alias("candidates"))


FOUND = [(p, "symbol", *rest) for p, *rest in samples.SYMBOLS] + [(p, "reference", name, None, None, line, line, None, None) for p, name, line in samples.REFERENCES]


@query(_values(FOUND, "path, what, name, qualified_name, kind, start_line, end_line, signature, parent"))
def extract_udtf(spark, sf_dir):
    """The scanners as a SQL table function."""
    from sparkindex.operators.extraction import register_table_function

    register_table_function(spark)
    _samples(spark).createOrReplaceTempView("sample_sources")
    return spark.sql("SELECT path, t.* FROM sample_sources, LATERAL extract_symbols(content, language) t")


@query(_values([(path, hashlib.blake2b(source.encode(), digest_size=16).hexdigest()) for path, _, source in samples.SOURCES], "path, content_hash"))
def sample_hashes(spark, sf_dir):
    """BLAKE2b of the sample sources, against Python's."""
    return _samples(spark).select("path", hashing.blake2b(F.col("content")).alias("content_hash"))


# --- trees, stores and streams -----------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder: where the session names a shared one, there."""
    named = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    return tempfile.mkdtemp(prefix="sparkindex-", dir=named if named and os.path.isdir(named) else None)


def _tree(folder: str) -> str:
    """The sample sources as files, with others that discovery must pass over."""
    extra = {"node_modules/x/i.js": "function no() {}", "notes.txt": "def no(): pass", "big.py": "x = 1\n" * 400_000, "a/dist/b.py": "y = 1", "build.py": "z = 2\n"}
    for path, text_ in [*((p, source) for p, _, source in samples.SOURCES), *extra.items()]:
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w", encoding="utf-8") as f:
            f.write(text_)
    return folder


PLAIN = [(p, language, "ok") for p, language, _ in samples.SOURCES] + [("build.py", "python", "ok"), ("big.py", "python", "large")]


@query(_values(PLAIN, "path, language, state"))
def discover_tree(spark, sf_dir):
    return read_tree(spark, _tree(_folder(spark))).select("path", "language", "state")


WHOLE = [*samples.RESOLVED]
CHANGED = [r for r in samples.RESOLVED if r[0] != "shop/prices.py"]
#: After shop/prices.py is gone, what led there is open; the new file calls a definition.
AFTER = [(*r[:3], "name-only", None, None) if r[4] == "shop/prices.py" else r for r in CHANGED] + [("new.py", "clear", 2, "name-only", "shop/cart.py", "clear")]


@query(_values(WHOLE, "path, name, line, confidence, resolved_path, resolved_qualified_name"))
def stored_index(spark, sf_dir):
    """A tree is discovered, extracted, resolved, published and read back."""
    folder = _folder(spark)
    store = Store(spark, f"{folder}/store")
    indexing.build(spark, _tree(f"{folder}/tree"), store, NOW)
    return usages(store.read())


def _edit(root: str) -> None:
    os.remove(f"{root}/shop/prices.py")
    with open(f"{root}/new.py", "w", encoding="utf-8") as f:
        f.write("def fresh():\n    clear(1)\n")


@query(_values(AFTER, "path, name, line, confidence, resolved_path, resolved_qualified_name"))
def refreshed_index(spark, sf_dir):
    """Two paths change; only they are read and extracted, all references are resolved."""
    folder = _folder(spark)
    root, store = _tree(f"{folder}/tree"), Store(spark, f"{folder}/store")
    indexing.build(spark, root, store, NOW)
    _edit(root)
    indexing.refresh(spark, root, store, spark.createDataFrame([("shop/prices.py",), ("new.py",), ("never.py",)], "path string"), NOW)
    return usages(store.read())


@query(_values(AFTER, "path, name, line, confidence, resolved_path, resolved_qualified_name"))
def swept_index(spark, sf_dir):
    folder = _folder(spark)
    root, store = _tree(f"{folder}/tree"), Store(spark, f"{folder}/store")
    indexing.build(spark, root, store, NOW)
    _edit(root)
    indexing.sweep(spark, root, store, NOW)
    return usages(store.read())


@query(_values(AFTER, "path, name, line, confidence, resolved_path, resolved_qualified_name"))
def streamed_index(spark, sf_dir):
    """The same changes, told by a stream of events: repeated, late, and on ignored paths."""
    folder = _folder(spark)
    root, store = _tree(f"{folder}/tree"), Store(spark, f"{folder}/store")
    indexing.build(spark, root, store, NOW)
    _edit(root)
    os.makedirs(f"{folder}/events")
    events = [{"path": "shop/prices.py", "dest_path": "new.py", "op": "moved"}, {"path": "new.py", "op": "modified"}, {"path": "new.py", "op": "modified"}, {"path": "node_modules/x/i.js", "op": "modified"}, {"path": "shop", "op": "modified", "is_directory": True}, {"path": "../out.py", "op": "created"}]
    for k, event in enumerate(events):
        with open(f"{folder}/events/{k}.json", "w", encoding="utf-8") as f:
            f.write(json.dumps(event | {"ts": f"2024-01-01T00:00:0{k}"}))
    watching.watch(spark, root, store, watching.read_events(spark, f"{folder}/events"), f"{folder}/checkpoint", once=True).awaitTermination()
    return usages(store.read())


#: shop/prices.py had four symbols, new.py has one; references differ where they now resolve otherwise.
DRIFT = [("files", "extra", "shop/prices.py", 1), ("files", "missing", "new.py", 1), ("symbols", "extra", "shop/prices.py", 4), ("symbols", "missing", "new.py", 1)]
DRIFT += [("refs", side, path, n) for side, rows in (("extra", {*WHOLE} - {*AFTER}), ("missing", {*AFTER} - {*WHOLE})) for path, n in sorted(Counter(r[0] for r in rows).items())]


@query(_values(DRIFT, '"table", side, path, n'))
def check_index(spark, sf_dir):
    """Drift of a store whose files have changed, in all three tables."""
    folder = _folder(spark)
    root, store = _tree(f"{folder}/tree"), Store(spark, f"{folder}/store")
    indexing.build(spark, root, store, NOW)
    _edit(root)
    found = indexing.check(spark, root, store).withColumn("path", F.get_json_object("row", "$.path"))
    return found.groupBy("table", "side", "path").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT path, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 600000000 AS ended, count(*) AS events FROM b GROUP BY path, burst"""
)
def debounced_events(spark, sf_dir):
    """Bursts of a user's events, closed by ten quiet minutes."""
    touched = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return watching.debounced(touched, "10 minutes").select("path", F.unix_micros("start").alias("started"), F.unix_micros("end").alias("ended"), "events")


@query("SELECT CASE WHEN event_id % 4 < 2 THEN 'model' WHEN event_id % 4 = 2 THEN 'tool' ELSE 'result' END AS kind, count(*) AS n, count(DISTINCT event_type) AS contestants FROM events GROUP BY 1")
def log_round_trip(spark, sf_dir):
    """A log written as JSON lines and read back."""
    path = f"{_folder(spark)}/log"
    log = event_log(spark, sf_dir).withColumns({"step": F.lit(0), "arguments": F.struct("path")})
    write_log(log, path)
    return read_log(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contestant").alias("contestants"))


PHRASES = ["add_u", "cart.ad", "add up", "PAGE", "up_add", "cart helper"]
PHRASE_HITS = [("add_u", "add_up"), ("cart.ad", "add"), ("cart.ad", "helper"), ("add up", "add_up"), ("PAGE", "Page"), ("cart helper", "helper")]


@query(_values(PHRASE_HITS, "query, name"))
def phrase_search(spark, sf_dir):
    """Phrases whose tokens must stand consecutively, the last one as a prefix."""
    rows = _samples(spark).where("path in ('shop/cart.py', 'web/app.tsx')").withColumns({"content_hash": F.lit(""), "mtime": F.lit(0.0)})
    index = indexing.index_of(rows, NOW)
    found = None
    for asked in PHRASES:
        hits = search.token_matches(index, asked).select(F.lit(asked).alias("query"), "name")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


TOOLS = [
    ("search_symbols", "total  function  shop/prices.py:5  def total(items)\nadd_up  import  shop/cart.py:2  .prices.total"),
    ("repo_map", "shop/prices.py  (python, 4 symbols, 3 inbound)  Tax, total, fmt\nweb/api.ts  (typescript, 2 symbols, 1 inbound)  load\nbuild.py  (python, 1 symbols, 0 inbound)  z\nshop/cart.py  (python, 11 symbols, 0 inbound)  LIMIT, Cart, clear\nweb/app.tsx  (tsx, 8 symbols, 0 inbound)  Page, Cache"),
    ("find_definition", "total  function  shop/prices.py:5  def total(items)"),
    ("find_references", "shop/cart.py:20  add_up  [import]  -> total (shop/prices.py)\nshop/prices.py:8  total  [exact]  -> total (shop/prices.py)"),
    ("outline_file", "1  Tax  class  class Tax\n2  Tax.rate  const\n5  total  function  def total(items)\n11  fmt  function  def fmt(x)"),
    ("missing", "sparkindex: nothing defines 'nothing'. Try grep or ripgrep instead: the text may exist without being indexed."),
]


@query(_values(TOOLS, "tool, answer"))
def agent_tools(spark, sf_dir):
    """Answers of the lookups as text, without the line that tells the index's age."""
    folder = _folder(spark)
    index = CodeIndex(spark, _tree(f"{folder}/tree"), f"{folder}/store")
    index.build()
    said = [("search_symbols", index.search_symbols("tot")), ("repo_map", index.repo_map()), ("find_definition", index.find_definition("total")), ("find_references", index.find_references("total")), ("outline_file", index.outline_file("shop/prices.py")), ("missing", index.find_definition("nothing"))]
    return spark.createDataFrame([(tool, "\n".join(x for x in text_.split("\n") if not x.startswith("index_age_ms"))) for tool, text_ in said], "tool string, answer string")
