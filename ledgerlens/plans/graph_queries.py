"""Link graphs, packages, routes and manifests over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scalars import is_bare, npm_spec, package_of
from ..operators import graph as G
from ..operators import guards as G2
from ..operators import security as S
from . import views as V


def import_edges(spark, sf_dir):
    links = V.links(spark, sf_dir)
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


def page_edges(spark, sf_dir):
    """Links as edges between the paths of the page and of its target."""
    return V.links(spark, sf_dir).select(V.url_path(F.col("url")).alias("from_path"), F.col("href").alias("to_path"))


def orphan_pages(spark, sf_dir):
    pages = V.read(spark, sf_dir, "pages").select("page_id", V.url_path(F.col("url")).alias("path"))
    return G.orphans(pages, page_edges(spark, sf_dir)).select("page_id", "path")


def graph_roots(spark, sf_dir):
    return G.roots(page_edges(spark, sf_dir))


def external_packages(spark, sf_dir):
    names = V.links(spark, sf_dir).select(package_of(F.regexp_replace("href", "^/", "")).alias("package"))
    return names.groupBy("package").agg(F.count("*").alias("n"))


def page_dirs(spark, sf_dir):
    path = V.url_path(F.col("url"))
    return V.read(spark, sf_dir, "pages").select("page_id", F.concat(V.url_host(F.col("url")), paths.directory(path)).alias("dir"))


def directory_graph_edges(spark, sf_dir):
    """Edges between whole directories, named as in ``module_graph_nodes``; a link stays on its page's host."""
    url = F.col("url")
    whole = lambda path: F.concat(V.url_host(url), paths.directory(path))
    edges = V.links(spark, sf_dir).select(whole(V.url_path(url)).alias("from_dir"), whole(F.col("href")).alias("to_dir"))
    return G.module_edges(edges)


def module_graph_nodes(spark, sf_dir):
    return G.module_nodes(page_dirs(spark, sf_dir))


def nearest_config(spark, sf_dir):
    pages = V.read(spark, sf_dir, "pages").select("page_id", F.concat(V.url_host(F.col("url")), V.url_path(F.col("url"))).alias("path"))
    configs = pages.where("page_id % 7 = 0").select(paths.directory(F.col("path")).alias("config_dir"))
    configs = configs.unionByName(pages.where("page_id % 5 = 0").select(F.substring_index("path", "/", 1).alias("config_dir")))
    return G.nearest_config(pages, configs).select("page_id", "config_dir")


def reachability(spark, sf_dir):
    """Regions from customers of one segment, by way of nations."""
    customer, nation = V.read(spark, sf_dir, "customer"), V.read(spark, sf_dir, "nation")
    up = customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    up = up.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))
    starts = customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.reachable(up, starts)


def route_paths(spark, sf_dir):
    """Pages as files of an ``app`` tree, some with dynamic parts."""
    pages = V.read(spark, sf_dir, "pages")
    leaf = F.when(F.pmod("page_id", F.lit(3)) == 0, "[id]").when(F.pmod("page_id", F.lit(3)) == 1, "(group)").otherwise("[...rest]")
    path = F.concat(F.lit("src/app"), V.url_path(F.col("url")), F.lit("/"), leaf, F.lit("/page.tsx"))
    return pages.select("page_id", S.app_route(path).alias("route"))


def route_coverage(spark, sf_dir):
    """Orders as routes of a customer's repository, under guards whose patterns come from the customer, too."""
    orders, k = V.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("DELETE")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    routes = orders.where(F.pmod(k, F.lit(3)) > 0).select(
        F.col("o_custkey").alias("repo_id"), method.alias("method"), F.concat(F.lit("/api/"), F.lower("o_orderstatus"), F.lit("/v"), F.pmod(k, F.lit(7))).alias("route")
    )
    kind = F.pmod("c_custkey", F.lit(6))
    pattern = (
        F.when(kind == 0, "/api/o/:path*").when(kind == 1, F.concat(F.lit("/api/f/v"), F.pmod("c_nationkey", F.lit(7)))).when(kind == 2, "/:any/f/:id")
        .when(kind == 3, "/admin/:path*").when(kind == 4, "/api/*1")
    )
    patterns = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), pattern.alias("pattern"))
    return G2.covered(routes, patterns).groupBy("method", "covered", "opaque").agg(F.count("*").alias("n"))


def packages_of(spark, sf_dir):
    return V.read(spark, sf_dir, "lineitem").select(
        F.lit("npm").alias("ecosystem"),
        F.concat(F.lit("p"), "l_partkey").alias("name"),
        F.concat(F.col("l_linenumber"), F.lit(".0")).alias("version"),
        F.concat(F.lit("s"), "l_suppkey").alias("source"),
        (F.col("l_returnflag") == "A").alias("direct"),
        (F.col("l_linestatus") == "O").alias("dev_only"),
    )


def package_dedupe(spark, sf_dir):
    return S.dedupe_packages(packages_of(spark, sf_dir))


def advisory_join(spark, sf_dir):
    part = V.read(spark, sf_dir, "part").where("p_size > 45")
    severity = F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit(None), F.lit("critical")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    advisories = part.select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "p_partkey").alias("name"),
        F.explode(F.array(F.lit("1.0"), F.lit("2.0"), F.lit("2.0"))).alias("version"), severity.alias("severity"),
    )
    found = S.vulnerable_packages(S.dedupe_packages(packages_of(spark, sf_dir)), advisories)
    return found.select("name", "version", "direct", "dev_only", "n_advisories", "worst")


def declared_minus_used(spark, sf_dir):
    declared = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    lines = V.read(spark, sf_dir, "lineitem")
    used = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("name"))
    mentioned = lines.where("l_quantity > 49").select(F.col("l_partkey").alias("name"))
    return S.unused(declared, used, mentioned)


def manifest_json(spark, sf_dir):
    events = V.read(spark, sf_dir, "events")
    entries = F.from_json("props", "map<string,bigint>")
    return events.select(F.explode(entries).alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def specifier_packages(spark, sf_dir):
    """Package names of bare specifiers built from part names."""
    word = F.lower(F.regexp_replace("p_name", " ", "-"))
    kind = F.pmod("p_partkey", F.lit(4))
    spec = F.when(kind == 0, F.concat(F.lit("./"), word)).when(kind == 1, F.concat(F.lit("@scope/"), word, F.lit("/sub/x"))).when(
        kind == 2, F.concat(word, F.lit("/lib"))).otherwise(F.concat(F.lit("~/"), word))
    specs = V.read(spark, sf_dir, "part").select(spec.alias("specifier"))
    return specs.where(is_bare(F.col("specifier"))).groupBy(package_of(F.col("specifier")).alias("package")).agg(F.count("*").alias("n"))


def npm_specs(spark, sf_dir):
    spec = F.concat(F.lit("/@x/p"), "p_partkey", F.lit("@"), "p_size", F.lit(".1.0(peer@2)"))
    return V.read(spark, sf_dir, "part").select("p_partkey", npm_spec(spec).alias("s")).select("p_partkey", "s.*")


QUERIES = {f.__name__: f for f in (
    import_edges, orphan_pages, graph_roots, external_packages, directory_graph_edges, module_graph_nodes, nearest_config,
    reachability, route_paths, route_coverage, package_dedupe, advisory_join, declared_minus_used, manifest_json,
    specifier_packages, npm_specs,
)}
LINKS = r"""WITH links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
  known AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) AS path, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages),
  edges AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) AS from_path, href AS to_path FROM links),
  dirs AS (SELECT page_id, host || regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM known) """
PACKAGES = """WITH packages AS (SELECT 'p' || l_partkey AS name, l_linenumber || '.0' AS version, min('s' || l_suppkey) AS source,
  bool_or(l_returnflag = 'A') AS direct, bool_and(l_linestatus = 'O') AS dev_only FROM lineitem GROUP BY 1, 2) """
ORACLES = {
    "import_edges": LINKS + "SELECT page_id, href, count(*) AS n FROM links GROUP BY 1, 2",
    "orphan_pages": LINKS + "SELECT page_id, path FROM known WHERE path NOT IN (SELECT to_path FROM edges WHERE from_path <> to_path)",
    "graph_roots": LINKS + "SELECT DISTINCT from_path AS node FROM edges WHERE from_path NOT IN (SELECT to_path FROM edges WHERE from_path <> to_path)",
    "external_packages": LINKS + "SELECT string_split(ltrim(href, '/'), '/')[1] AS package, count(*) AS n FROM links GROUP BY 1",
    "directory_graph_edges": LINKS + r"""SELECT * FROM (SELECT h || regexp_extract(p, '^(.*)/[^/]*$', 1) AS from_dir, h || regexp_extract(href, '^(.*)/[^/]*$', 1) AS to_dir,
        count(*) AS count FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) AS p, href FROM links)
        GROUP BY 1, 2) WHERE from_dir <> to_dir""",
    "module_graph_nodes": LINKS + "SELECT dir AS path, count(*) AS files FROM dirs GROUP BY dir HAVING count(*) >= 2 ORDER BY files DESC, path LIMIT 12",
    "nearest_config": LINKS + """, f AS (SELECT page_id, host || path AS p FROM known), c AS (
        SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS d FROM f WHERE page_id % 7 = 0 UNION SELECT string_split(p, '/')[1] FROM f WHERE page_id % 5 = 0)
        SELECT page_id, arg_max(d, length(d)) AS config_dir FROM f LEFT JOIN c ON d = '' OR starts_with(p, d || '/') GROUP BY page_id""",
    "reachability": """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), w AS (
        SELECT 'c' || c_custkey AS node, 0 AS distance FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION SELECT dst, distance + 1 FROM w JOIN e ON node = src) SELECT node, min(distance) AS distance FROM w GROUP BY node""",
    "route_paths": r"""SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1), '/') ||
        CASE page_id % 3 WHEN 0 THEN [':id'] WHEN 1 THEN [] ELSE ['*'] END, lambda s: s <> ''), '/') AS route FROM pages""",
    "route_coverage": """SELECT CASE o_orderkey % 3 WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, CASE c_custkey % 6 WHEN 0 THEN o_orderstatus = 'O'
        WHEN 1 THEN o_orderstatus = 'F' AND o_orderkey % 7 = c_nationkey % 7 WHEN 2 THEN o_orderstatus = 'F' WHEN 4 THEN o_orderkey % 7 = 1 ELSE false END AS covered,
        c_custkey % 6 = 5 AS opaque, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0 GROUP BY ALL""",
    "package_dedupe": PACKAGES + "SELECT 'npm' AS ecosystem, * FROM packages",
    "advisory_join": PACKAGES + """SELECT name, version, direct, dev_only, CASE version WHEN '1.0' THEN 1 ELSE 2 END::BIGINT AS n_advisories,
        CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'critical' END AS worst
        FROM packages JOIN part ON name = 'p' || p_partkey WHERE p_size > 45 AND version IN ('1.0', '2.0')""",
    "declared_minus_used": """SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
        AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""",
    "manifest_json": """SELECT k AS key, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.' || k) AS BIGINT)) AS BIGINT) AS total
        FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1""",
    "specifier_packages": """SELECT CASE p_partkey % 4 WHEN 1 THEN '@scope/' ELSE '' END || lower(replace(p_name, ' ', '-')) AS package, count(*) AS n
        FROM part WHERE p_partkey % 4 IN (1, 2) GROUP BY 1""",
    "npm_specs": "SELECT p_partkey, '@x/p' || p_partkey AS name, p_size || '.1.0' AS version FROM part",
}
