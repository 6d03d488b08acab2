"""Queries that bind the operators to the driver's tables, each with SQL for DuckDB beside it.

The tables hold no source code, so operators meet analogous columns, and parse operators meet
source files that Spark derives from `part`: one module a part, importing another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinworks.functions import tables, text as tx
from skeinworks.operators import budget, index, lessons, listing, masking, parse, resolve, search, telemetry, traverse
from skeinworks.session import shared_folder, spread, stored, table
from skeinworks.sources import files as source_files, transcripts, trees
from skeinworks.streaming import graph, keyed, live
from skeinworks.tools import normalised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- listing and text ---------------------------------------------------------------------


@register("""WITH f AS (SELECT url AS path, page_id AS seq FROM pages WHERE starts_with(url, 'https://') AND contains(url, '/en/'))
SELECT path, seq, (SELECT count(*) FROM f) AS total FROM f ORDER BY seq LIMIT 100""")
def list_paths(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("seq"))
    return listing.list_files(pages, "/https://", "/en/", 100)


@register("""SELECT array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') AS folder, count(*) AS n, arg_min(url, page_id) AS first_path
FROM pages GROUP BY 1""")
def dir_groups(spark, sf):
    return listing.group_by_folder(table(spark, sf, "pages"), "url", 3, "page_id")


@register("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') || '.' || ['ts', 'TSX', 'js', 'jsx', 'mjs', 'py'][p_partkey % 6 + 1] AS path FROM part)
SELECT CASE lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN NULL ELSE 'javascript' END AS language,
  regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AS is_source, count(*) AS n FROM p GROUP BY ALL""")
def ext_dispatch(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, ("ts", "TSX", "js", "jsx", "mjs", "py"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("."), suffix).alias("path"))
    return p.groupBy(tx.language_of("path").alias("language"), tx.is_source("path").alias("is_source")).agg(F.count("*").alias("n"))


@register("SELECT lang, count(*) AS n, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(tx.tokens("text")).alias("tokens"))


@register("""SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), 'The ')), chr(10)) AS text
FROM conversations""")
def line_filter(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.without_lines("text", "The ").alias("text"))


HREF = 'href="([^"]+)"'


def _links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))


@register(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS h FROM pages)
SELECT page_id, CAST(unnest(range(0, len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM l""")
def link_extract(spark, sf):
    return _links(spark, sf)


@register(f"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages)
SELECT href AS file, count(*) AS importers, min(page_id) AS first_importer FROM l GROUP BY 1""")
def reverse_links(spark, sf):
    back = resolve.reverse(_links(spark, sf), "page_id", "href")
    return back.groupBy("file").agg(F.count("*").alias("importers"), F.min("importer").alias("first_importer"))


# --- joins ------------------------------------------------------------------------------


@register("""WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS base FROM part),
s AS (SELECT * FROM (VALUES (0, ' rod'), (1, ' ring'), (2, ' widget'), (3, ' bolt')) t(rank, suffix)),
k AS (SELECT DISTINCT p_name AS path FROM part)
SELECT w.p_partkey, w.base, arg_min(k.path, s.rank) AS resolved FROM w, s JOIN k ON true WHERE k.path = w.base || s.suffix GROUP BY ALL""")
def resolve_candidates(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("base"))
    return resolve.first_candidate(wanted, "base", part, "p_name", (" rod", " ring", " widget", " bolt"))


@register("""WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000),
q AS (SELECT DISTINCT o_orderpriority, 'queue ' || left(o_orderpriority, 1) AS c_name FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, CASE WHEN c.c_name IS NOT NULL THEN 'key' WHEN q.c_name IS NOT NULL THEN 'fallback' END AS via, coalesce(c.c_name, q.c_name) AS c_name
FROM orders o LEFT JOIN c ON c.c_custkey = o.o_custkey LEFT JOIN q USING (o_orderpriority)""")
def two_stage_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    second = orders.where("o_orderpriority <> '5-LOW'").select("o_orderpriority", F.concat(F.lit("queue "), F.substring("o_orderpriority", 1, 1)).alias("c_name")).distinct()
    return resolve.join_or_fallback(orders, first, second, "o_custkey", "o_orderpriority", "c_name")


@register("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def parsed_semi(spark, sf):
    return resolve.parsed_only(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@register("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def frontier_anti(spark, sf):
    return resolve.frontier(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))


@register("""WITH n AS (SELECT 'customer::' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT 'nation::' || n_nationkey FROM nation WHERE n_nationkey < 20)
SELECT 'customer::' || c_custkey AS from_id, 'nation::' || c_nationkey AS to_id,
  'customer::' || c_custkey IN (SELECT id FROM n) AS from_exists, 'nation::' || c_nationkey IN (SELECT id FROM n) AS to_exists FROM customer""")
def dangling_edges(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    nodes = customer.where("c_acctbal > 0").select(_node("customer", "c_custkey").alias("node_id")).union(nation.where("n_nationkey < 20").select(_node("nation", "n_nationkey")))
    return resolve.with_ends(customer.select(_node("customer", "c_custkey").alias("from_id"), _node("nation", "c_nationkey").alias("to_id")), nodes)


@register("SELECT event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def last_writer(spark, sf):
    return resolve.last_writer(table(spark, sf, "events"), "event_type", "value", "event_id")


@register("""WITH c AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN text || 'x' ELSE text END) AS old FROM documents WHERE doc_id % 3 < 2)
SELECT d.doc_id, md5(d.text) AS hash, coalesce(md5(d.text) = c.old, false) AS reused FROM documents d LEFT JOIN c USING (doc_id)""")
def content_cache(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    stale = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    cache = docs.where("doc_id % 3 < 2").select("doc_id", F.md5(stale).alias("hash"))
    return source_files.split_by_cache(docs, cache, "doc_id", "text").select("doc_id", "hash", "reused")


# --- traversal --------------------------------------------------------------------------

_EDGES = """SELECT 'nation::' || n_nationkey AS src, 'region::' || n_regionkey AS dst FROM nation
UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey FROM customer
UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier
UNION ALL SELECT 'orders::' || o_orderkey, 'customer::' || o_custkey FROM orders"""


def _edges(spark, sf):
    parts = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))
    out = None
    for t, key, other, ref in parts:
        e = table(spark, sf, t).select(_node(t, key).alias("src"), _node(other, ref).alias("dst"))
        out = e if out is None else out.unionByName(e)
    return out


def _reach(edges: str, seed: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < {depth})
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> '{seed}' GROUP BY id"""


@register(_reach(_EDGES, "region::0", 4))
def impact_node(spark, sf):
    return traverse.impact(_edges(spark, sf), spark.createDataFrame([("region::0",)], "id string"), 4)


_BOTH = """SELECT DISTINCT 'part::' || l_partkey AS src, 'supplier::' || l_suppkey AS dst FROM lineitem
UNION SELECT DISTINCT 'supplier::' || l_suppkey, 'part::' || l_partkey FROM lineitem"""


@register(_reach(_BOTH, "supplier::0", 2))
def impact_cycle(spark, sf):
    pairs = stored(table(spark, sf, "lineitem").select(_node("part", "l_partkey").alias("src"), _node("supplier", "l_suppkey").alias("dst")).distinct(), "edges")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return traverse.impact(both, spark.createDataFrame([("supplier::0",)], "id string"), 2)


@register(f"""WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT 'region::' || r_regionkey AS seed FROM region UNION ALL SELECT 'nation::' || n_nationkey FROM nation UNION ALL SELECT 'customer::' || c_custkey FROM customer),
r(seed, id, depth) AS (SELECT seed, seed, 0 FROM s UNION SELECT r.seed, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < 3)
SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> seed GROUP BY ALL""")
def impact_of_each(spark, sf):
    """What each region, nation and customer reaches, by one traversal of bits."""
    seeds = None
    for t, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")):
        ids = table(spark, sf, t).select(_node(t, key).alias("id"))
        seeds = ids if seeds is None else seeds.unionByName(ids)
    return traverse.impact_of_each(_edges(spark, sf), seeds, 3)


_COARSE = """SELECT DISTINCT 'segment::' || c_mktsegment AS src, 'nation::' || c_nationkey AS dst FROM customer
UNION SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey FROM nation
UNION SELECT DISTINCT 'priority::' || o_orderpriority, 'segment::' || c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey"""


@register(_reach(_COARSE, "region::1", 6))
def impact_file(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    edges = customer.select(_node("segment", "c_mktsegment").alias("src"), _node("nation", "c_nationkey").alias("dst")).distinct()
    edges = edges.unionByName(nation.select(_node("nation", "n_nationkey").alias("src"), _node("region", "n_regionkey").alias("dst")))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").join(customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    edges = edges.unionByName(orders.select(_node("priority", "o_orderpriority").alias("src"), _node("segment", "c_mktsegment").alias("dst")).distinct())
    return traverse.impact(edges, spark.createDataFrame([("region::1",)], "id string"), 6)


@register("SELECT l_partkey FROM lineitem WHERE l_orderkey = 7")
def direct_deps(spark, sf):
    return traverse.direct_dependencies(table(spark, sf, "lineitem"), 7, "l_orderkey", "l_partkey")


@register("""WITH seeds AS (SELECT 'nation::' || n_nationkey AS file, n_nationkey AS ord, 'symbol:' || n_name AS reason FROM nation WHERE n_nationkey < 3),
e AS (SELECT 'nation::' || n_nationkey AS src, 'region::' || n_regionkey AS dst, 0 AS pos FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, c_custkey FROM customer),
met AS (
  SELECT e.dst AS file, 75 AS score, 'dep-of:' || s.file AS reason, s.ord, 0 AS kind, e.pos FROM seeds s JOIN e ON e.src = s.file
  UNION ALL SELECT e.src, 60, 'imports:' || s.file, s.ord, 1, e.pos FROM seeds s JOIN e ON e.dst = s.file),
fresh AS (SELECT file, arg_min({'score': score, 'reason': reason, 'ord': ord, 'kind': kind, 'pos': pos}, (ord, kind, pos)) AS m FROM met WHERE file NOT IN (SELECT file FROM seeds) GROUP BY file),
ranked AS (SELECT file, m.score AS score, m.reason AS reason, m.ord AS ord, m.kind AS kind, m.pos AS pos, row_number() OVER (ORDER BY m.ord, m.kind, m.pos, file) AS r FROM fresh),
cut AS (SELECT coalesce(min(ord), 1000000) AS last FROM ranked WHERE r + 3 >= 40),
every AS (
  SELECT file, 0 AS depth, 100 AS score, reason, ord, 0 AS kind, 0 AS pos FROM seeds
  UNION ALL SELECT file, 1, score, reason, ord, kind, pos FROM ranked, cut WHERE ord <= last)
SELECT file, CAST(depth AS INTEGER) AS depth, CAST(score AS INTEGER) AS score, reason FROM every ORDER BY score DESC, depth, ord, kind, pos, file LIMIT 40""")
def scope_rank(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    seeds = nation.where("n_nationkey < 3").select(_node("nation", "n_nationkey").alias("file"), F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("symbol:"), "n_name").alias("reason"))
    edges = nation.select(_node("nation", "n_nationkey").alias("src"), _node("region", "n_regionkey").alias("dst"), F.lit(0).cast("long").alias("pos"))
    edges = edges.unionByName(customer.select(_node("customer", "c_custkey").alias("src"), _node("nation", "c_nationkey").alias("dst"), F.col("c_custkey").alias("pos")))
    return traverse.scope(edges, seeds, 1, 40)


@register("""WITH seeds AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey < 4),
n AS (SELECT s_nationkey AS k, arg_min('supplier::' || s_suppkey, s_suppkey) AS via, min(s_suppkey) AS ord FROM seeds GROUP BY 1),
r AS (SELECT n_regionkey AS k, arg_min('nation::' || n.k, n.ord) AS via FROM n JOIN nation ON n_nationkey = n.k GROUP BY 1)
SELECT 'supplier::' || s_suppkey AS file, CAST(0 AS INTEGER) AS depth, CAST(100 AS INTEGER) AS score, 'seed' AS reason FROM seeds
UNION ALL SELECT 'nation::' || k, 1, 75, 'dep-of:' || via FROM n UNION ALL SELECT 'region::' || k, 2, 50, 'dep-of:' || via FROM r""")
def scope_two_steps(spark, sf):
    """A scope of depth two: suppliers, their nations, their regions."""
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    edges = supplier.select(_node("supplier", "s_suppkey").alias("src"), _node("nation", "s_nationkey").alias("dst"), F.lit(0).cast("long").alias("pos"))
    edges = edges.unionByName(nation.select(_node("nation", "n_nationkey").alias("src"), _node("region", "n_regionkey").alias("dst"), F.lit(0).cast("long").alias("pos")))
    seeds = supplier.where("s_suppkey < 4").select(_node("supplier", "s_suppkey").alias("file"), F.col("s_suppkey").cast("long").alias("ord"), F.lit("seed").alias("reason"))
    return traverse.scope(edges, seeds, 2, 40)


@register("""WITH s AS (SELECT p_brand AS file, p_partkey AS ord, 'symbol:small ring(' || p_type || ')' AS reason FROM part WHERE p_name = 'small ring'
UNION ALL SELECT r_name, (1::BIGINT << 40) + (1::BIGINT << 39), 'rpc:NATION_7' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name = 'NATION_7')
SELECT file, min(ord) AS ord, arg_max(reason, ord) AS reason FROM s GROUP BY file""")
def scope_seeds(spark, sf):
    """Seeds by an exact symbol and by a method."""
    symbols, methods, pages = _search_tables(spark, sf)
    return traverse.seed_files(["small ring", "NATION_7"], pages.select("path"), symbols, methods)


@register("""WITH q(k, q) AS (VALUES (0, 'small ring'), (1, 'no such name'), (2, 'ed wid')), n AS (SELECT k, q, p_brand AS file, min(p_partkey) AS seq, arg_max(p_name, p_partkey) AS name FROM part, q WHERE k > 0 AND contains(lower(p_name), q) GROUP BY ALL),
s AS (SELECT 0 AS k, p_brand AS file, p_partkey AS ord, 'symbol:small ring(' || p_type || ')' AS reason FROM part WHERE p_name = 'small ring'
UNION ALL SELECT k, file, (k::BIGINT << 40) + seq, 'fuzzy:' || name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM n) WHERE r <= 5)
SELECT file, min(ord) AS ord, arg_max(reason, ord) AS reason FROM s GROUP BY file""")
def scope_seeds_per_query(spark, sf):
    """Seeds by the older rule: a part of a name counts for each query that found nothing."""
    symbols, methods, pages = _search_tables(spark, sf)
    return traverse.seed_files(["small ring", "no such name", "ed wid"], pages.select("path"), symbols, methods, per_query=True)


@register("""WITH RECURSIVE top AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS ord FROM documents QUALIFY ord < 60),
r AS (SELECT -1::BIGINT AS doc_id, 0::BIGINT AS tokens, -1::BIGINT AS ord, 0::BIGINT AS used, false AS taken
  UNION ALL SELECT t.doc_id, t.tokens, t.ord, r.used + CASE WHEN r.used + t.tokens <= 25000 THEN t.tokens ELSE 0 END, r.used + t.tokens <= 25000 FROM r JOIN top t ON t.ord = r.ord + 1)
SELECT doc_id, tokens, CAST(ord AS INTEGER) AS ord, used, taken FROM r WHERE ord >= 0""")
def scope_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.tokens("text").alias("tokens"), F.length("text").alias("n"))
    top = docs.orderBy(F.desc("n"), "doc_id").limit(60)
    return budget.within_budget(top, [-F.col("n"), F.col("doc_id")], "tokens", 25000, ["doc_id"])


# --- search -----------------------------------------------------------------------------


def _search_tables(spark, sf):
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    symbols = part.select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("seq"))
    methods = nation.select(F.col("n_name").alias("name"), F.col("r_name").alias("file"), F.col("n_nationkey").cast("long").alias("seq"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("seq"))
    return symbols, methods, pages


def _phases_sql(query: str) -> str:
    return f"""SELECT p_brand AS file, CASE WHEN lower(p_name) = '{query}' THEN 100 ELSE 80 END AS score, p_name AS name, 'Symbol match' AS reason, 1 AS phase, p_partkey AS seq FROM part WHERE contains(lower(p_name), '{query}')
UNION ALL SELECT r_name, 90, n_name, 'Method match', 2, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(n_name), '{query}')
UNION ALL SELECT url, 60, NULL, 'Filename match', 3, page_id FROM pages WHERE contains(lower(url), '{query}')"""


def _flat(hits):
    return hits.select("file", "score", F.get("symbols", F.lit(0))["name"].alias("name"), "reason", "phase", "seq")


@register(f"SELECT file, CAST(score AS INTEGER) AS score, name, reason, CAST(phase AS INTEGER) AS phase, CAST(seq AS BIGINT) AS seq FROM ({_phases_sql('on_1')}) ORDER BY phase, seq LIMIT 15")
def symbol_search(spark, sf):
    return _flat(search.search(*_search_tables(spark, sf), "ON_1"))


@register(f"SELECT file, CAST(score AS INTEGER) AS score, name, reason, CAST(phase AS INTEGER) AS phase, CAST(seq AS BIGINT) AS seq FROM ({_phases_sql('small ring')}) ORDER BY score DESC, phase, seq LIMIT 20")
def symbol_search_topk(spark, sf):
    return _flat(search.search_by_score(*_search_tables(spark, sf), "small ring", limit=20))


@register("""WITH h AS (SELECT p_name AS name, p_brand AS file, p_partkey AS seq, CASE WHEN lower(p_name) = 'red' THEN 100 ELSE 80 END AS score, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part WHERE contains(lower(p_name), 'red')),
n AS (SELECT name, first, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT name, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT h.name, h.file, h.seq, CAST(h.score AS INTEGER) AS score FROM h JOIN b USING (name) WHERE before < 15 ORDER BY h.score DESC, h.first, h.seq LIMIT 15""")
def symbol_search_whole_names(spark, sf):
    return search.search_whole_names(_search_tables(spark, sf)[0], "red").select("name", "file", "seq", "score")


@register("""WITH n AS (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1)
SELECT name, n, 'near' AS match FROM n WHERE contains('PROMOTION', name) OR contains(name, 'PROMOTION') ORDER BY name LIMIT 5""")
def fuzzy_lookup(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return search.lookup(names, "PROMOTION")


@register("""WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT p_name AS want FROM part UNION SELECT p_name || ' of ' || p_type FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT 'no ' || p_brand FROM part),
x AS (SELECT want, name, n, 'exact' AS match FROM w JOIN n ON name = want),
m AS (SELECT want, name, n, 'near' AS match, row_number() OVER (PARTITION BY want ORDER BY name) AS r FROM w JOIN n ON contains(name, want) OR contains(want, name) WHERE want NOT IN (SELECT want FROM x))
SELECT * FROM x UNION ALL SELECT want, name, n, match FROM m WHERE r <= 5""")
def fuzzy_lookup_all(spark, sf):
    """Many names at once: whole ones, parts of known names and longer ones that hold them."""
    part = table(spark, sf, "part").select("p_name", "p_type", "p_brand")
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    forms = (F.col("p_name"), F.concat("p_name", F.lit(" of "), "p_type"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.left("p_name", F.lit(2)), F.concat(F.lit("no "), "p_brand"))
    return search.lookup_all(names, part.select(F.explode(F.array(*forms)).alias("want")), "name", "want")


@register("SELECT p_brand AS alias, min(p_name) AS target, 'head' AS match FROM part WHERE p_brand = 'Brand#7' GROUP BY p_brand")
def alias_lookup(spark, sf):
    aliases = table(spark, sf, "part").groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_name").alias("target"))
    return search.resolve_alias(aliases, "Brand#7/ring")


@register("SELECT n.n_nationkey, n.n_name, count(c.c_custkey) AS called_by FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_7' GROUP BY ALL")
def exact_lookup(spark, sf):
    nation = table(spark, sf, "nation").where("n_name = 'NATION_7'")
    calls = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("called_by"))
    return nation.join(calls, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("called_by", F.lit(0)).alias("called_by"))


# --- transcripts and lessons ------------------------------------------------------------


def _turns(spark, sf):
    return masking.turns(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "assistant")


_TURNS_SQL = "SELECT *, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn_id FROM conversations"
_MASKED_SQL = f"""WITH t AS ({_TURNS_SQL}), s AS (SELECT *, max(turn_id) OVER (PARTITION BY conv_id) - turn_id >= 1 AS stale, string_split(text, chr(10)) AS l FROM t)
SELECT conv_id, turn, turn_id, stale, text AS before, CASE WHEN stale AND len(l) > 5 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '[...' || (len(l) - 4) || ' lines of tool output omitted — within observation masking window...]' || chr(10) || l[-1] ELSE text END AS after FROM s"""


@register(f"SELECT conv_id, turn, role, turn_id FROM ({_TURNS_SQL})")
def turn_segments(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", "role", "turn_id")


def _masked(spark, sf):
    marked = masking.outside_window(_turns(spark, sf), "conv_id", 1)
    return marked.withColumn("after", F.when(F.col("stale"), masking.masked_text(F.col("text"))).otherwise(F.col("text")))


@register(f"SELECT conv_id, turn, turn_id, stale, after AS text FROM ({_MASKED_SQL})")
def mask_old_turns(spark, sf):
    return _masked(spark, sf).select("conv_id", "turn", "turn_id", "stale", F.col("after").alias("text"))


@register(f"""WITH m AS (SELECT length(before) AS b, length(after) AS a FROM ({_MASKED_SQL}))
SELECT count(*) FILTER (WHERE a < b) AS masked, CAST(sum(b) AS BIGINT) AS chars_before, CAST(sum(b) - sum(a) AS BIGINT) AS chars_saved, CAST(floor((sum(b) - sum(a)) / 4.0 + 0.5) AS BIGINT) AS tokens_saved, CAST(floor((sum(b) - sum(a)) * 100.0 / sum(b) + 0.5) AS BIGINT) AS reduction_pct FROM m""")
def mask_stats(spark, sf):
    return masking.savings(_masked(spark, sf).select(F.length("text").cast("long").alias("b"), F.length("after").cast("long").alias("a")), "b", "a")


_TERMS = "SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\w{{3,}}')) AS term FROM {table}) GROUP BY ALL"


@register(f"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM ({_TERMS.format(key='doc_id', table='documents')}) GROUP BY term")
def term_freq(spark, sf):
    return lessons.terms(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


_COSINE = f"""WITH a AS ({_TERMS.format(key='doc_id', table='documents')}), b AS ({_TERMS.format(key='item_id', table='benchmark')}),
na AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM b GROUP BY 1),
d AS (SELECT doc_id, item_id, sum(a.tf * b.tf) AS dot FROM a JOIN b USING (term) GROUP BY ALL),
p AS (SELECT doc_id, item_id, dot / (na.n * nb.n) AS cosine FROM d JOIN na USING (doc_id) JOIN nb USING (item_id))"""


@register(f"{_COSINE} SELECT doc_id, item_id, round(cosine, 6) AS cosine FROM p WHERE cosine > 0.5")
def cosine_pairs(spark, sf):
    b = lessons.terms(table(spark, sf, "benchmark"), "item_id", "text")
    return lessons.cosine_pairs_of_texts(table(spark, sf, "documents"), b, "doc_id", "text", "item_id", 0.5).select("doc_id", "item_id", F.round("cosine", 6).alias("cosine"))


@register(f"{_COSINE} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE cosine > 0.6)")
def curate_anti(spark, sf):
    docs = table(spark, sf, "documents")
    return lessons.curate(docs, table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 0.6).select("doc_id", "lang")


#: Families of things to learn that the invented documents hold.
SEEN = (
    lessons.Family("contact", r"([A-Za-z0-9.]+@[A-Za-z0-9.]+)", "Contact {1} found", 0.7),
    lessons.Family("number", r"([0-9]{16})", "Number {1} found", 0.8),
    lessons.Family("phone", r"\(([0-9]{3})\) ([0-9]{3}-[0-9]{4})", "Phone {1}/{2} found", 0.6),
)
_SEEN_SQL = """SELECT doc_id, 0 AS family, unnest(range(0, len(m))) AS pos, 'contact' AS type, 'Contact ' || unnest(m) || ' found' AS lesson, 0.7 AS confidence FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') AS m FROM documents)
UNION ALL SELECT doc_id, 1, unnest(range(0, len(m))), 'number', 'Number ' || unnest(m) || ' found', 0.8 FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{16}') AS m FROM documents)
UNION ALL SELECT doc_id, 2, unnest(range(0, len(m))), 'phone', 'Phone ' || unnest(list_transform(m, lambda x: x[2:4] || '/' || x[7:14])) || ' found', 0.6 FROM (SELECT doc_id, regexp_extract_all(text, '\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') AS m FROM documents)"""


@register(f"SELECT doc_id, CAST(family AS INTEGER) AS family, CAST(pos AS INTEGER) AS pos, type, lesson, CAST(confidence AS DOUBLE) AS confidence FROM ({_SEEN_SQL})")
def lesson_families(spark, sf):
    return lessons.extract(table(spark, sf, "documents"), "doc_id", "text", SEEN)


@register(f"""WITH l AS ({_SEEN_SQL}), f AS (SELECT lower(left(lesson, 60)) AS k, arg_min({{'doc_id': doc_id, 'family': family, 'pos': pos, 'lesson': lesson}}, (doc_id, family, pos)) AS m FROM l GROUP BY 1)
SELECT m.doc_id AS doc_id, CAST(m.family AS INTEGER) AS family, CAST(m.pos AS INTEGER) AS pos, m.lesson AS lesson FROM f ORDER BY m.doc_id DESC, m.family DESC, m.pos DESC LIMIT 120""")
def tail_lessons(spark, sf):
    found = lessons.extract(table(spark, sf, "documents"), "doc_id", "text", SEEN)
    first = lessons.first_seen(found, F.col("lesson"), [F.col("doc_id"), F.col("family"), F.col("pos")])
    return lessons.latest(first, ["doc_id", "family", "pos"]).select("doc_id", "family", "pos", "lesson")


@register("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(left(text, 60))")
def first_seen(spark, sf):
    return lessons.first_seen(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), [F.col("doc_id")]).select("doc_id")


@register("""WITH l AS (SELECT doc_id, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS lesson FROM documents)
SELECT doc_id, CAST(i + 1 AS INTEGER) AS pos, 'lang-' || lang AS type, lesson FROM l WHERE lesson <> ''""")
def playbook_lines(spark, sf):
    """Playbooks whose lessons are all lines of a document."""
    head = F.lit(f"# Notes\n- [skipped] before\n{transcripts.SECTION}\n\n")
    said = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- [lang-"), F.col("lang"), F.lit("] "), x)), "\n")
    books = table(spark, sf, "documents").select("doc_id", F.concat(head, said, F.lit("\n* no lesson\n")).alias("text"))
    return transcripts.playbook_lessons(books)


# The SQL restates the six patterns of operators.lessons for the comparison.
_TOLD = "'It was found in lib/' || replace(p_name, ' ', '_') || '.ts today. ' || 'Meteor.call(''' || p_brand || ''', 1). ' || '@' || replace(p_name, ' ', '/') || ' resolves to packages/' || p_size || chr(10) || 'Note: ' || p_type || ' parts of the kind ' || p_name || ' come first! no results for ''' || p_name || '''. ' || 'package ''' || replace(p_brand, '#', '-') || ''' contains ' || p_name || '. '"


@register(rf"""WITH t AS (SELECT p_partkey, {_TOLD} AS text FROM part),
f(family, type, confidence, pattern) AS (VALUES (0, 'file-location', 0.7, '(?i)(?:found|located|implemented|defined)\s+in\s+([\w/.@-]+\.(?:ts|js|tsx|jsx))'),
  (1, 'meteor-method', 0.85, 'Meteor\.(?:call|methods)\s*\(\s*[''"]([^''"]+)[''"]'), (2, 'alias', 0.9, '(?i)@([\w./-]+)\s*(?:→|->|resolves to|is at)\s*([\w/.@-]+)'),
  (3, 'convention', 0.75, '(?i)(?:I (?:learned|discovered|found) that|The pattern (?:is|for)|Always use|Convention:|Note:)\s+([^.!?\n]{{20,150}}[.!?])'),
  (4, 'avoid', 0.6, '(?i)(?:no results|not found|failed to find)\s+(?:for\s+)?[''"]?([^''".\n]{{5,80}})[''"]?'), (5, 'module', 0.8, '(?i)(?:package|module)\s+[''"]?([\w@/-]+)[''"]?\s+(?:exports|provides|contains)\s+([^.\n]{{10,100}})')),
m AS (SELECT p_partkey, family, type, confidence, regexp_extract(text, pattern, 1) AS a, CASE WHEN family IN (2, 5) THEN regexp_extract(text, pattern, 2) END AS b FROM t, f)
SELECT p_partkey, CAST(family AS INTEGER) AS family, CAST(0 AS INTEGER) AS pos, type, CAST(confidence AS DOUBLE) AS confidence,
CASE family WHEN 0 THEN 'File location: ' || a WHEN 1 THEN 'Meteor method ''' || a || ''' discovered in session' WHEN 2 THEN 'Import alias @' || a || ' resolves to ' || b
  WHEN 3 THEN a WHEN 4 THEN 'Search term ''' || a || ''' yielded no results — use search_symbol instead' ELSE 'Package ' || a || ' provides: ' || b END AS lesson
FROM m WHERE a <> '' AND (family <> 3 OR length(a) >= 21)""")
def agent_lessons(spark, sf):
    """The six families over sessions told from the columns of `part`."""
    part = spread(table(spark, sf, "part"), "p_partkey").withColumn("p_size", F.col("p_size").cast("string"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    said = F.concat(
        F.lit("It was found in lib/"), swap("p_name", " ", "_"), F.lit(".ts today. Meteor.call('"), "p_brand", F.lit("', 1). @"), swap("p_name", " ", "/"), F.lit(" resolves to packages/"), "p_size",
        F.lit("\nNote: "), "p_type", F.lit(" parts of the kind "), "p_name", F.lit(" come first! no results for '"), "p_name", F.lit("'. package '"), swap("p_brand", "#", "-"), F.lit("' contains "), "p_name", F.lit(". "),
    )
    return lessons.extract(part.select("p_partkey", said.alias("text")), "p_partkey", "text")


@register(f"""WITH t AS ({_TURNS_SQL}), s AS (SELECT *, max(turn_id) OVER (PARTITION BY conv_id) - turn_id >= 1 AS stale, string_split(text, chr(10)) AS l FROM t)
SELECT conv_id AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role,
CASE WHEN stale AND len(l) > 5 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '[...' || (len(l) - 4) || ' lines of tool output omitted — within observation masking window...]' || chr(10) || l[-1] ELSE text END AS text FROM s""")
def masked_transcripts(spark, sf):
    """Conversations as JSON payloads of tool results, read back, and masked part by part."""
    said = F.struct(F.lit("text").alias("type"), "text")
    message = F.struct("turn", "role", F.array(F.struct(F.lit("tool_result").alias("type"), F.array(said).alias("content"))).alias("content"))
    raw = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    raw = raw.select("conv_id", F.to_json(F.struct(F.struct("messages").alias("llm_request"))).alias("value"))
    masked = masking.mask(transcripts.message_rows(transcripts.payloads(raw), "conv_id"), keep=1, role="assistant")
    return masked.select("session", "pos", "role", F.get(F.get("parts", F.lit(0))["content"], F.lit(0))["text"].alias("text"))


@register("""SELECT type, lesson, CAST(row_number() OVER (ORDER BY k, seq) - 1 AS BIGINT) AS seq FROM (SELECT 0 AS k, r_regionkey AS seq, 'region' AS type, r_name AS lesson FROM region UNION ALL SELECT 1, n_nationkey, 'nation', n_name FROM nation)""")
def learned_lessons(spark, sf):
    """Old lessons, then new ones."""
    of = lambda name, c: table(spark, sf, name).select(F.lit(name).alias("type"), F.col(f"{c}_name").alias("lesson"), F.col(f"{c}_{name}key").alias("seq"))
    return lessons.learned(of("region", "r"), of("nation", "n"))


# --- telemetry --------------------------------------------------------------------------


def tool_calls(events: DataFrame) -> DataFrame:
    """Events as tool calls: their type as the tool, their value as milliseconds."""
    engine = F.when(F.col("event_type") == "view", "tree-sitter").when(F.col("event_type") == "click", "regex-fallback")
    return events.select(
        (F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("ms"), engine.alias("engine"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("ts").alias("wall_time"),
    )


_CALLS = """SELECT event_id + 1 AS seq, event_type AS tool, CAST(json_extract(props, '$.k') AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, CAST(floor(value * 10) AS BIGINT) AS ms,
CASE event_type WHEN 'view' THEN 'tree-sitter' WHEN 'click' THEN 'regex-fallback' END AS engine, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events"""
_PER_TOOL = f"""SELECT tool, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, CAST(sum(ms) AS BIGINT) AS total_ms,
CAST(floor(sum(ms) / count(*) + 0.5) AS BIGINT) AS avg_ms, count(error) AS errors FROM ({_CALLS}) GROUP BY tool"""


@register(_PER_TOOL)
def tool_stats(spark, sf):
    return telemetry.per_tool(tool_calls(table(spark, sf, "events")))


@register(f"""SELECT CAST(floor(sum(output_tokens) / count(*) + 0.5) AS BIGINT) AS tokens_per_call, printf('%.1f%%', count(*) FILTER (WHERE engine = 'tree-sitter') * 100.0 / count(engine)) AS tree_rate, 'n/a' AS parsed_pct, 'n/a' AS frontier_pct FROM ({_CALLS})""")
def tool_efficiency(spark, sf):
    return telemetry.efficiency(tool_calls(table(spark, sf, "events")))


@register(f"""SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, count(error) AS errors, count(DISTINCT tool) AS tools,
count(*) FILTER (WHERE engine = 'tree-sitter') AS tree_calls, count(*) FILTER (WHERE engine = 'regex-fallback') AS stand_in_calls FROM ({_CALLS})""")
def tool_totals(spark, sf):
    return telemetry.totals(tool_calls(table(spark, sf, "events")))


@register(f"SELECT seq, seq || '. ' || tool || ' (' || ms || 'ms, ~' || output_tokens || 't out' || coalesce(', ' || engine, '') || CASE WHEN error IS NOT NULL THEN ', ERR' ELSE '' END || ')' AS line FROM ({_CALLS})")
def call_sequence(spark, sf):
    return telemetry.call_sequence(tool_calls(table(spark, sf, "events")))


@register(f"""WITH c AS (SELECT tool, calls, tokens_in, tokens_out, avg_ms, errors FROM ({_PER_TOOL}))
SELECT rpad('tool', 26, ' ') || lpad('calls', 10, ' ') || lpad('in', 10, ' ') || lpad('out', 10, ' ') || lpad('avg ms', 10, ' ') || lpad('errors', 10, ' ') || chr(10) ||
string_agg(rpad(tool, 26, ' ') || lpad(CAST(calls AS VARCHAR), 10, ' ') || lpad(CAST(tokens_in AS VARCHAR), 10, ' ') || lpad(CAST(tokens_out AS VARCHAR), 10, ' ') || lpad(CAST(avg_ms AS VARCHAR), 10, ' ') || lpad(CAST(errors AS VARCHAR), 10, ' '), chr(10) ORDER BY tokens_out DESC) AS text FROM c""")
def tool_report_text(spark, sf):
    return telemetry.report_text(tool_calls(table(spark, sf, "events")))


@register("""SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS total_files, (SELECT count(DISTINCT doc_id) FROM labels) AS parsed_files, (SELECT count(DISTINCT p_name) FROM part) AS symbols,
(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edges, (SELECT count(DISTINCT n_name) FROM nation) AS methods,
(SELECT count(DISTINCT doc_id) FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels) AS frontier_files""")
def graph_stats(spark, sf):
    t = lambda name, *cols: table(spark, sf, name).select(*cols)
    path = F.col("doc_id").alias("path")
    return telemetry.graph_stats(t("documents", path), t("labels", path), t("part", F.col("p_name").alias("node_id")), t("lineitem", F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), t("nation", F.col("n_name").alias("name")))


@register("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS files, (SELECT count(DISTINCT p_name) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(DISTINCT n_name) FROM nation) AS methods")
def index_stats(spark, sf):
    t = lambda name, *cols: table(spark, sf, name).select(*cols)
    return telemetry.index_stats(t("documents", F.col("doc_id").alias("path")), t("part", F.col("p_name").alias("name")), t("lineitem", "l_orderkey", "l_partkey"), t("nation", F.col("n_name").alias("name")))


@register("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS closes FROM conversations)
SELECT conv_id, CAST(max(c) AS BIGINT) AS turns FROM (SELECT conv_id, coalesce(sum(closes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM t) GROUP BY 1""")
def user_turns(spark, sf):
    """Turns by the other rule: a user's message closes one."""
    marked = masking.turns(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return marked.groupBy("conv_id").agg(F.max("turn_id").alias("turns"))


@register(_PER_TOOL)
def report_files(spark, sf):
    """The per-tool report, written as JSON and read back."""
    report = telemetry.per_tool(tool_calls(table(spark, sf, "events")))
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    transcripts.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@register("SELECT p_partkey, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '/') ELSE '/srv/repository/' || p_name END AS path FROM part")
def relative_paths(spark, sf):
    """Paths under a root as relative ones; those that only begin like it stay."""
    under = F.when(F.col("p_size") > 25, F.concat(F.lit("/srv/repo/"), F.replace("p_name", F.lit(" "), F.lit("/")))).otherwise(F.concat(F.lit("/srv/repository/"), "p_name"))
    return normalised(table(spark, sf, "part").select("p_partkey", under.alias("path")), "/srv/repo")


@register(_PER_TOOL)
def snapshot_stream(spark, sf):
    """The per-tool report as a stream over the events files, in complete mode."""
    events = live.table_stream(spark, sf, "events")
    return live.run_snapshot(spark, tool_calls(events), "snapshot-stream")


def _ran(rows: DataFrame, label: str) -> DataFrame:
    """All that a stream makes of what is there."""
    base = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    keyed.started(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/out")


@register(f"SELECT conv_id, turn, turn_id, stale, after AS text FROM ({_MASKED_SQL})")
def mask_stream(spark, sf):
    """Masking of old turns as messages arrive: a turn is masked when a later one begins, the
    last one is whole once its conversation has been idle."""
    said = live.table_stream(spark, sf, "conversations")
    said = said.withColumn("at", F.timestamp_seconds(F.col("turn") * 60 + 10**8))
    # One message long after all others moves the watermark past them.
    ticks = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"
    tick = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in said.schema if f.name not in ("turn", "at")), F.lit(0).cast("long").alias("turn"), F.timestamp_seconds(F.lit(10**9)).alias("at"))
    tick.select(said.columns).write.parquet(ticks)
    both = said.unionByName(live.file_stream(spark, ticks, said.schema))
    marked = _ran(keyed.rolling_turns(both, "conv_id", "turn", "at", F.col("role") == "assistant", keep=1), "mask-stream").where("conv_id IS NOT NULL")
    return marked.select("conv_id", "turn", "turn_id", "stale", F.when(F.col("stale"), masking.masked_text(F.col("text"))).otherwise(F.col("text")).alias("text"))


@register("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(left(text, 60))")
def first_seen_stream(spark, sf):
    docs = live.table_stream(spark, sf, "documents").select("doc_id", "text")
    timed = docs.withColumn("at", F.timestamp_seconds(F.lit(10**8)))
    return _ran(keyed.first_seen(timed, F.lower(F.left("text", F.lit(60))), "doc_id", "at"), "first-seen").select("doc_id")


@register("SELECT event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def last_writer_stream(spark, sf):
    """The last value of every type, out of a stream of changes."""
    events = live.table_stream(spark, sf, "events").select("event_type", "value", "event_id", F.col("ts").cast("timestamp").alias("at"))
    changes = _ran(keyed.last_writer(events, F.col("event_type"), "event_id", "at"), "last-writer")
    return resolve.last_writer(changes, "event_type", "value", "event_id")


# --- parsing ------------------------------------------------------------------------------


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """path, content, seq: a TypeScript module for every part. It imports the module of the
    part 25 further on in its folder, if there is one, and calls its function."""
    part = spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    other = (F.col("p_partkey") + 25).cast("string")
    content = F.concat(
        F.lit("import { run"), other, F.lit(" as next } from './m"), other, F.lit("';\nimport shared from '../shared';\n\ninterface Kept"), k, F.lit(" {\n  size: number;\n}\n\nexport async function run"), k,
        F.lit("(size: number): Promise<number> {\n  const text = \""), name, F.lit(" {\"; // a brace in a string\n  return next(size) + helper"), k, F.lit("(size);\n}\n\nfunction helper"), k, F.lit("(n: number) {\n  return shared.load(n);\n}\n"),
    )
    return part.select(F.concat(F.lit("lib/f"), (F.col("p_partkey") % 25).cast("string"), F.lit("/m"), k, F.lit(".ts")).alias("path"), content.alias("content"), F.col("p_partkey").alias("seq"))


@register("""SELECT 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts::' || v.name || p_partkey AS node_id, v.name || p_partkey AS name, v.kind AS kind, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS file,
CAST(v.line AS INTEGER) AS line, v.exported AS exported FROM part, (VALUES ('Kept', 'interface', 4, false), ('run', 'function', 8, true), ('helper', 'function', 13, false)) v(name, kind, line, exported)""")
def code_symbols(spark, sf):
    return parse.symbols(parse.parse(modules(spark, sf))).select("node_id", "name", "kind", "file", "line", "exported")


@register("""WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part)
SELECT a.path AS src, CAST(0 AS INTEGER) AS pos, './m' || (a.k + 25) AS spec, b.path AS dst FROM p a JOIN p b ON b.k = a.k + 25""")
def code_imports(spark, sf):
    sources = modules(spark, sf)
    return resolve.imports(parse.import_specs(sources), sources.select("path"))


def _call_edges(spark, sf):
    sources = modules(spark, sf)
    parsed = stored(parse.scanned(sources), "parsed")
    specs = resolve.imports(parse.import_specs(sources), sources.select("path"))
    names = parse.import_names(sources).join(specs.select(F.col("src").alias("file"), "spec", F.col("dst").alias("target")).hint("merge"), ["file", "spec"])
    return resolve.call_edges(parse.call_sites(sources, parsed), names, parse.symbols(parsed))


_CODE_EDGES = """WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part)
SELECT a.path || '::run' || a.k AS from_id, b.path || '::run' || b.k AS to_id, true AS from_exists, true AS to_exists FROM p a JOIN p b ON b.k = a.k + 25
UNION ALL SELECT path || '::run' || k, path || '::helper' || k, true, true FROM p"""


@register(_CODE_EDGES)
def code_call_edges(spark, sf):
    return _call_edges(spark, sf)


@register(_reach(f"SELECT from_id AS src, to_id AS dst FROM ({_CODE_EDGES})", "lib/f0/m100.ts::helper100", 4))
def code_impact(spark, sf):
    return traverse.impact(stored(_call_edges(spark, sf), "call-edges"), spark.createDataFrame([("lib/f0/m100.ts::helper100",)], "id string"), 4, "from_id", "to_id")


@register("""WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part)
SELECT path, concat_ws(chr(10), 'import { run' || (k + 25) || ' as next } from ''./m' || (k + 25) || ''';', 'import shared from ''../shared'';', '', '// ── Types ' || repeat('─', 33), 'interface Kept' || k || ' {', '  size: number;', '}', '',
'// ── Exports ' || repeat('─', 31), 'export async function run' || k || '(size: number): Promise<number> { ... }', '', '// ── Module-level ' || repeat('─', 26), 'function helper' || k || '(n: number) { ... }') AS skeleton FROM p""")
def code_skeletons(spark, sf):
    sources = modules(spark, sf)
    return parse.skeletons(sources, parse.parse(sources)).select("path", "skeleton")


@register("""WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path, p_size > 25 AS reused FROM part)
SELECT a.path, a.reused, CASE WHEN a.reused THEN 'old' ELSE 'interface Kept' || a.k || ' 4, function run' || a.k || ' 9, function helper' || a.k || ' 12' END AS symbols, CASE WHEN a.reused THEN 'kept' ELSE coalesce(b.path, '') END AS imports
FROM p a LEFT JOIN p b ON b.k = a.k + 25""")
def content_index(spark, sf):
    """All modules, of which a cache holds those of the larger parts."""
    sources = modules(spark, sf)
    row = F.array(F.struct(F.lit("old").alias("name"), F.lit("").alias("kind"), F.lit(0).alias("line")))
    large = sources.join(table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("seq")), "seq", "left_semi")
    cache = large.select("path", F.md5("content").alias("hash"), row.alias("symbols"), F.array().cast("array<string>").alias("methods"), F.array(F.lit("kept")).alias("imports"))
    found = index.content_index(sources, cache)
    shown = F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["kind"], s["name"], s["line"].cast("string"))), ", ")
    return found.select("path", "reused", F.when(F.col("reused"), F.col("symbols")[0]["name"]).otherwise(shown).alias("symbols"), F.array_join("imports", ",").alias("imports"))


@register("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice * 1000) AS BIGINT)) AS shown FROM orders")
def grouped_numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.grouped(F.floor(F.col("o_totalprice") * 1000)).alias("shown"))


def loose_modules(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: sources with a class, a registration and a regular expression whose quote
    and brace would hide what follows."""
    part = spread(table(spark, sf, "part"), "p_partkey")
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    content = F.concat(
        F.lit("const mark = /[\"{]/, size"), k, F.lit(" = 1;\nexport class Depot"), k, F.lit(" extends Base {\n  private rows: string[] = [];\n  async load(at: number): Promise<void> {\n    this.rows.push(`${at} ${ `{` }`);\n  }\n}\njobs.plan('"), name,
        F.lit("', { description: 'Plans "), name, F.lit("', input: { "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(": s.text() } }, async (args) => {\n  await run(args);\n});\n"),
    )
    return part.select(F.concat(F.lit("m"), k, F.lit(".ts")).alias("path"), content.alias("content"))


@register("""WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey || '.ts' AS path, p_name AS name, lower(replace(p_brand, '#', '_')) AS brand FROM part)
SELECT path, 'Module-level' AS section, 'mark' AS name, CAST(1 AS INTEGER) AS line_start, CAST(1 AS INTEGER) AS line_end, 'const mark = /["{]/, size' || k || ' = 1;' AS text FROM p
UNION ALL SELECT path, 'declared', 'size' || k, 1, 1, 'const mark = /["{]/, size' || k || ' = 1;' FROM p
UNION ALL SELECT path, 'Exports', 'Depot' || k, 2, 7, 'export class Depot' || k || ' extends Base {' || chr(10) || '  private rows: string[] = [];' || chr(10) || '  async load(at: number): Promise<void>;' || chr(10) || '}' FROM p
UNION ALL SELECT path, 'Registrations', name, 8, 10, 'jobs.plan(''' || name || ''', /* Plans ' || name || ' */ async ({ ' || brand || ' }) => { ... }); // L8' FROM p""")
def code_statements(spark, sf):
    """Classes, further declarators and registrations, past a regular expression with a quote."""
    return parse.parse(loose_modules(spark, sf)).select("path", "section", "name", "line_start", "line_end", "text")


@register("""WITH p AS (SELECT p_partkey AS k, 'm' || p_partkey || '.ts' AS path, p_name AS name FROM part)
SELECT path, 'Module-level' AS section, 'mark' AS name, CAST(1 AS INTEGER) AS line_start FROM p UNION ALL SELECT path, 'Exports', 'Depot' || k, 2 FROM p""")
def line_statements(spark, sf):
    """The same sources by lines alone: the quote in the regular expression hides no brace of
    another line, and a class lasts until its braces close."""
    rows = parse.parse_lines(loose_modules(spark, sf))
    return rows.where("section IN ('Module-level', 'Exports')").select("path", "section", "name", "line_start")


@register("""SELECT path, v.name || k AS name, v.kind AS kind, v.exported AS exported FROM (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part),
(VALUES ('Kept', 'interface', false), ('run', 'function', true), ('helper', 'function', false)) v(name, kind, exported)""")
def line_symbols(spark, sf):
    """Symbols by patterns over the lines of skeletons."""
    sources = modules(spark, sf)
    shown = parse.skeletons(sources, parse.parse(sources))
    return parse.symbols_of_lines(shown, "path", "skeleton").select("path", "name", "kind", "exported")


@register(f"SELECT * FROM ({_CODE_EDGES}) WHERE from_id NOT LIKE 'lib/f7/%'".replace("true AS from_exists, true AS to_exists FROM p a", "true AS from_exists, b.path NOT LIKE 'lib/f7/%' AS to_exists FROM p a").replace("JOIN p b ON b.k = a.k + 25", "JOIN p b ON b.k = a.k + 25 AND b.path NOT LIKE 'lib/f7/%'"))
def graph_stream(spark, sf):
    """The call graph of all modules as it grows with a stream of three batches: callers come
    before the modules that they import, and one folder is deleted at the end."""
    base = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    sources = modules(spark, sf).withColumn("seq", F.lit(1).cast("long"))
    part = (F.col("path").substr(6, 3).contains("/").cast("int") + F.col("content").contains("7").cast("int")) % 2
    gone = sources.where("path LIKE 'lib/f7/%'").select("path", F.lit(None).cast("string").alias("content"), F.lit(2).cast("long").alias("seq"))
    # What comes between two runs of the stream is a batch, of any number of files.
    for k, rows in enumerate((sources.where(part == 0), sources.where(part == 1), gone)):
        rows.write.mode("append").parquet(f"{base}/files/{k}")
        files = spark.readStream.schema(sources.select("path", "content", "seq").schema).option("recursiveFileLookup", True).parquet(f"{base}/files")
        query = graph.grow(files, f"{base}/state", f"{base}/checkpoint", compact_after=2, buckets=4)
        query.awaitTermination()
    return graph.GraphState(spark, f"{base}/state", 4).edges()


def tricky_modules(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: components with all that hides or imitates code: calls in comments, strings
    and regular expressions, code in templates and markup, text of markup with quotes, nested
    declarations, calls over several lines, patterns, a class without a name; every fifth file
    ends inside of a template."""
    part = spread(table(spark, sf, "part"), "p_partkey")
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    content = F.concat(
        F.lit("// see helper(1) in '"), name, F.lit("'\nimport { load } from './load';\nconst said = \"call("), name, F.lit(") {\", { left"), k, F.lit(", right: [deep"), k, F.lit(", ...rest"), k, F.lit("] } = split(said);\nif (said) /[\"{(]/.test(said);\n"),
        F.lit("export function View"), k, F.lit("({ rows }) {\n  const shown = rows.map((r) => pick(r, `${size(r)} of(x)`));\n  function draw() {\n    /* never(0) */\n    return load\n      .from(shown)\n      .then((x) => new Map(wrap(x)));\n  }\n  return <p title='it(s)'>it`s {draw()} don't(1) <b/></p>;\n}\n"),
        F.lit("export default class extends mixed(Base) {\n  async run<T>(x: T): Promise<void> { await this.go?.(x); }\n}\ninterface Port"), k, F.lit(" { open(a: string): void }\nstart"), k, F.lit("();\n"), F.when(F.col("p_partkey") % 5 == 0, "export function late() { go(`open\n").otherwise(""),
    )
    return part.select(F.concat(F.lit("ui/v"), k, F.when(F.col("p_partkey") % 2 == 0, ".tsx").otherwise(".jsx")).alias("path"), content.alias("content"))


_TRICKY = "SELECT p_partkey AS k, p_partkey % 5 = 0 AS broken, 'ui/v' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.tsx' ELSE '.jsx' END AS file FROM part"


@register(f"""WITH p AS ({_TRICKY}), v(caller, nested, callee, line) AS (VALUES ('said', 'said', 'split', 3), ('<module>', '<module>', '/TEST/.test', 4), ('View', 'shown', 'rows.map', 6), ('View', 'shown', 'pick', 6), ('View', 'shown', 'size', 6),
  ('View', 'draw', 'load' || chr(10) || '      .from', 9), ('View', 'draw', 'load' || chr(10) || '      .from(shown)' || chr(10) || '      .then', 9), ('View', 'draw', 'wrap', 11), ('View', 'View', 'draw', 13), ('<module>', '<module>', 'mixed', 15), ('<module>', '<module>', 'this.go', 16), ('<module>', '<module>', 'start', 19))
SELECT file, CASE caller WHEN 'View' THEN 'View' || k ELSE caller END AS caller, CASE nested WHEN 'View' THEN 'View' || k ELSE nested END AS nested_caller,
  CASE callee WHEN 'start' THEN 'start' || k ELSE replace(callee, 'TEST', '["{{(]') END AS callee_raw, CAST(line AS INTEGER) AS line FROM p, v WHERE NOT broken""")
def code_calls(spark, sf):
    """Calls with their top-level and innermost callers, out of sources that imitate them."""
    rows = parse.scanned(tricky_modules(spark, sf))
    return parse.callers(rows, closed=True).select("file", "caller", "nested_caller", "callee_raw", "line")


@register(f"""WITH p AS ({_TRICKY}), v(name, kind, line, exported, by_lines) AS (VALUES ('said', 'variable', 3, false, true), ('left', 'variable', 3, false, false), ('deep', 'variable', 3, false, false), ('rest', 'variable', 3, false, false), ('View', 'function', 5, true, true), ('Port', 'interface', 18, false, false), ('late', 'function', 20, true, true))
SELECT file, CASE WHEN name IN ('said', 'late') THEN name ELSE name || k END AS name, kind, CAST(line AS INTEGER) AS line, exported FROM p, v WHERE CASE WHEN broken THEN by_lines ELSE name <> 'late' END""")
def code_names(spark, sf):
    """Declared names, those of patterns too; files that no scanner can close have those that
    their lines show."""
    sources = tricky_modules(spark, sf)
    rows = stored(parse.parse(sources), "scanned")
    return parse.symbols(parse.with_lines(sources, rows)).select("file", "name", "kind", "line", "exported")


@register("""WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part)
SELECT path, exported, count(*) AS names, min(line) AS first_line, string_agg(name, ',' ORDER BY line) AS declared, '' AS callee FROM (SELECT path, v.exported, CAST(v.line AS INTEGER) AS line, v.name || k AS name FROM p, (VALUES ('Kept', 4, false), ('run', 8, true), ('helper', 13, false)) v(name, line, exported)) GROUP BY 1, 2
UNION ALL SELECT path, false, 1, CAST(v.line AS INTEGER), v.caller || k, v.callee || CASE WHEN v.callee = 'helper' THEN CAST(k AS VARCHAR) ELSE '' END FROM p, (VALUES ('run', 'next', 10), ('run', 'helper', 10), ('helper', 'shared.load', 14)) v(caller, callee, line)
UNION ALL SELECT path, false, pos, 0, spec, 'import' FROM p, LATERAL (SELECT 0 AS pos, './m' || (k + 25) AS spec UNION ALL SELECT 1, '../shared') i""")
def code_in_sql(spark, sf):
    """Symbols, calls and imports of sources by table functions, in SQL alone."""
    tables.register(spark)
    return spark.sql(
        """SELECT m.path, s.exported, count(*) AS names, min(s.line) AS first_line, array_join(transform(array_sort(collect_list(struct(s.line, s.name))), x -> x.name), ',') AS declared, '' AS callee
        FROM {m} m, LATERAL code_symbols(m.path, m.content) s GROUP BY m.path, s.exported
        UNION ALL SELECT m.path, false, 1, c.line, c.caller, c.callee_raw FROM {m} m, LATERAL code_calls(m.path, m.content) c
        UNION ALL SELECT m.path, false, i.pos, 0, i.spec, 'import' FROM {m} m, LATERAL code_imports(m.path, m.content) i""",
        m=modules(spark, sf),
    )


@register("""SELECT 'lib/f7/m' || p_partkey || '.ts' AS file, v.name || p_partkey AS name, v.kind AS kind, CAST(v.line AS INTEGER) AS line FROM part, (VALUES ('Kept', 'interface', 4), ('run', 'function', 8), ('helper', 'function', 13)) v(name, kind, line) WHERE p_partkey % 25 = 7""")
def tree_symbols(spark, sf):
    """All modules written as files of a tree, and the symbols of one of its folders, to which
    the listing of the data source is pruned."""
    trees.register(spark)
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    files = modules(spark, sf).select("path", "content", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
    files.write.format(trees.NAME).option("path", path).mode("append").save()
    folder = spark.read.format(trees.NAME).option("path", path).load().where("path LIKE 'lib/f7/%'")
    return parse.symbols(parse.parse(folder)).select("file", "name", "kind", "line")


@register(f"""WITH p AS ({_TRICKY}), t AS (SELECT p_partkey AS k, p_name AS name FROM part)
SELECT file, 'const said = "call(' || name || ') {{", {{ left' || k || ', right: [deep' || k || ', ...rest' || k || '] }} = split(said);' AS source, CAST(3 AS INTEGER) AS line_start, CAST(3 AS INTEGER) AS line_end FROM p JOIN t USING (k)""")
def symbol_sources(spark, sf):
    """The source of one symbol of every file: by the scanner, or by lines where a file does not
    close."""
    found = parse.symbol_source(tricky_modules(spark, sf), "said")
    return found.where("error IS NULL").select(F.col("path").alias("file"), "source", "line_start", "line_end")


def method_modules(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: objects of methods with deep bodies, and publications."""
    part = spread(table(spark, sf, "part"), "p_partkey")
    k = F.col("p_partkey").cast("string")
    content = F.concat(
        F.lit("Meteor.methods({\n  async 'plan."), k, F.lit("'(a, b) {\n    if (a) { return { x: [{ y: { z: { q: { r: { s: () => ({ t: 1 }) } } } } }] }; }\n  },\n  sweep"), k, F.lit(": async function () { go({ deep: 1 }); },\n  rest"), k,
        F.lit(": known,\n});\nMeteor.publish('list."), F.col("p_brand"), F.lit("', function () { return all(); });\n"),
    )
    return part.select(F.concat(F.lit("srv/m"), k, F.lit(".js")).alias("path"), content.alias("content"))


@register("""WITH p AS (SELECT p_partkey AS k, 'srv/m' || p_partkey || '.js' AS file, p_brand AS brand FROM part), e(engine) AS (VALUES ('scanner'), ('pattern'))
SELECT engine, file, unnest(['plan.' || k, 'sweep' || k, 'rest' || k, 'publish:list.' || brand]) AS name FROM p, e""")
def method_names(spark, sf):
    """Methods and publications of all files, by the scanner and by patterns."""
    sources = method_modules(spark, sf)
    both = parse.rpc_methods(parse.parse(sources)).withColumn("engine", F.lit("scanner")).unionByName(parse.rpc_methods_by_pattern(sources).withColumn("engine", F.lit("pattern")))
    return both.select("engine", "file", "name")


@register("""WITH p AS (SELECT p_partkey AS k, 'lib/f' || p_partkey % 25 || '/m' || p_partkey || '.ts' AS path FROM part), s(name, pos) AS (VALUES ('Kept', 0), ('run', 1), ('helper', 2))
SELECT path AS file, 'symbol' AS kind, name || k AS name, CAST(pos AS INTEGER) AS pos FROM p, s UNION ALL SELECT a.path, 'import', b.path, 0 FROM p a JOIN p b ON b.k = a.k + 25""")
def cached_index(spark, sf):
    """The index of all modules, saved as a cache, loaded and taken apart again."""
    sources = modules(spark, sf)
    none = source_files.load_cache(spark, f"{shared_folder(spark)}/no-cache-{uuid.uuid4().hex}")
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    source_files.save_cache(index.content_index(sources, none).drop("reused"), path)
    symbols, _, imports = source_files.restored(source_files.load_cache(spark, path))
    return symbols.select("file", F.lit("symbol").alias("kind"), "name", "pos").unionByName(imports.select(F.col("src").alias("file"), F.lit("import").alias("kind"), F.col("dst").alias("name"), "pos"))


_SCRIPT = "string_split(html, chr(10))"


# The SQL restates the pattern of calls by lines and the words that are none.
@register(f"""WITH l AS (SELECT page_id, unnest(range(1, len({_SCRIPT}) + 1)) AS line, unnest({_SCRIPT}) AS t FROM pages),
m AS (SELECT page_id, line, regexp_extract_all(t, '([A-Za-z0-9_$]+(?:\\.[A-Za-z0-9_$]+)*)\\s*\\(', 1) AS c FROM l), x AS (SELECT page_id, line, unnest(range(0, len(c))) AS pos, unnest(c) AS callee FROM m)
SELECT page_id, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, callee FROM x WHERE callee NOT IN ('function', 'if', 'for', 'while', 'switch', 'catch', 'class')""")
def call_sites(spark, sf):
    return parse.calls_of_lines(table(spark, sf, "pages"), "page_id", "html")
