"""Queries over the graph operators, by name, and their SQL.

Networks are derived from whole tables; weights are whole cents or currency units, so that sums are exact.

* dense: parts and suppliers, joined by all lines of orders.
* fan: each customer is joined to all its orders, and each order to the customer's next one.
* path: each customer is joined to its first order, and each order to the next.
* twin: each order is joined to its customer and to that customer's account.
* kite: each order is joined to the customer's next one, and every third number also to the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorenet.functions import scoring
from scorenet.graph import ScoredGraph
from scorenet.operators import analysis, paths, topology
from scorenet.operators.components import connected_components
from scorenet.plans import pcst, reduce, solve
from scorenet.storage import written

SHIFT = 1_000_000_000
CUSTOMER, ACCOUNT = 2 * SHIFT, 3 * SHIFT
PART_CENTS, SUPPLIER_CENTS, LEAF_CENTS, INNER_CENTS, CUSTOMER_CENTS, ORDER_UNITS = 91_000, 450_000, 450_000, -5_000_000, 450_000, 250_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir, kind: str = "dense") -> DataFrame:
    """(u, v): the edges of a network as the tables give them, repeats included."""
    if kind == "dense":
        return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + SHIFT).alias("v"))
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("c"), "o_orderdate")
    by_date = Window.partitionBy("c").orderBy("o_orderdate", "u")
    own = o.select("u", (F.col("c") + CUSTOMER).alias("v"))
    if kind == "twin":
        return own.union(o.select("u", F.col("c") + ACCOUNT))
    rows = o.select("u", "c", F.lead("u").over(by_date).alias("v"), F.row_number().over(by_date).alias("k"))
    following = rows.where("v is not null").select("u", "v")
    if kind == "kite":
        return following.union(own.where("u % 3 = 0"))
    return following.union(own if kind == "fan" else rows.where("k = 1").select("u", F.col("c") + CUSTOMER))


def _cents(col: str, less: int):
    return F.round(F.col(col) * 100).cast("long") - less


def _weights(spark, sf_dir, kind: str = "dense") -> DataFrame:
    if kind == "dense":
        p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _cents("p_retailprice", PART_CENTS).alias("score"))
        return p.union(_read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SHIFT).alias("id"), _cents("s_acctbal", SUPPLIER_CENTS).alias("score")))
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", _cents("c_acctbal", CUSTOMER_CENTS).alias("score"))
    out = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.round("o_totalprice").cast("long") - ORDER_UNITS).alias("score"))
    out = out.union(c.select(F.col("c_custkey") + CUSTOMER, "score"))
    return out.union(c.select(F.col("c_custkey") + ACCOUNT, -1000 * (F.col("c_nationkey").cast("long") + 1))) if kind == "twin" else out


def _graph(spark, sf_dir, kind: str = "fan") -> ScoredGraph:
    return ScoredGraph.of_ends(_weights(spark, sf_dir, kind), _lines(spark, sf_dir, kind))


def _long(col: str = "score"):
    return F.col(col).cast("long").alias(col)


ORDER_ROWS = "SELECT o_orderkey AS u, o_custkey AS c, lead(o_orderkey) OVER w AS v, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
RAW = {
    "dense": f"SELECT l_partkey AS u, l_suppkey + {SHIFT} AS v FROM lineitem",
    "fan": f"SELECT u, v FROM ({ORDER_ROWS}) WHERE v IS NOT NULL UNION ALL SELECT o_orderkey, o_custkey + {CUSTOMER} FROM orders",
    "path": f"SELECT u, v FROM ({ORDER_ROWS}) WHERE v IS NOT NULL UNION ALL SELECT u, c + {CUSTOMER} FROM ({ORDER_ROWS}) WHERE k = 1",
    "kite": f"SELECT u, v FROM ({ORDER_ROWS}) WHERE v IS NOT NULL UNION ALL SELECT o_orderkey, o_custkey + {CUSTOMER} FROM orders WHERE o_orderkey % 3 = 0",
    "twin": f"SELECT o_orderkey AS u, o_custkey + {CUSTOMER} AS v FROM orders UNION ALL SELECT o_orderkey, o_custkey + {ACCOUNT} FROM orders",
}
SCORES = {"dense": f"""SELECT p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) - {PART_CENTS} AS score FROM part
      UNION ALL SELECT s_suppkey + {SHIFT}, CAST(round(s_acctbal * 100) AS BIGINT) - {SUPPLIER_CENTS} FROM supplier"""}
SCORES["fan"] = SCORES["path"] = SCORES["kite"] = f"""SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) - {ORDER_UNITS} AS score FROM orders
      UNION ALL SELECT c_custkey + {CUSTOMER}, CAST(round(c_acctbal * 100) AS BIGINT) - {CUSTOMER_CENTS} FROM customer"""
SCORES["twin"] = f"{SCORES['fan']} UNION ALL SELECT c_custkey + {ACCOUNT}, -1000 * (c_nationkey + 1) FROM customer"


def _sql(kind: str, body: str) -> str:
    return f"""
WITH RECURSIVE raw AS ({RAW[kind]}),
e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw),
n AS (SELECT * FROM ({SCORES[kind]}) WHERE id IN (SELECT u FROM e UNION SELECT v FROM e)),
a AS (SELECT u AS id, v AS nbr FROM e UNION ALL SELECT v, u FROM e),
deg AS (SELECT id, count(*) AS degree FROM a GROUP BY id),
d2 AS (SELECT id, min(nbr) AS a, max(nbr) AS b FROM a GROUP BY id HAVING count(*) = 2)
{body}"""


def _cc(edges: str, tail: str) -> str:
    """Components over SQL edges (x, y), both directions."""
    return f""", s AS ({edges}), r(id, x) AS (SELECT x, x FROM s UNION SELECT r.id, s.y FROM r JOIN s ON s.x = r.x),
c AS (SELECT id, min(x) AS comp FROM r GROUP BY id)
{tail}"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ALL_CC = "SELECT id AS x, nbr AS y FROM a"


@query(_sql("dense", "SELECT u, v, count(*) AS n_lines FROM raw GROUP BY u, v"))
def edge_dedupe(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n_lines"))


@query(_sql("dense", "SELECT u, v FROM e WHERE u IN (SELECT p_partkey FROM part WHERE p_size > 25)"))
def edges_dangling_dropped(spark, sf_dir):
    nodes = _weights(spark, sf_dir).join(_read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")), "id", "left_anti")
    return ScoredGraph.of(nodes, _lines(spark, sf_dir)).edges


@query(_sql("dense", "SELECT id, degree FROM deg"))
def degree(spark, sf_dir):
    return topology.degrees(_graph(spark, sf_dir, "dense"))


@query(_sql("dense", "SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree"))
def degree_histogram(spark, sf_dir):
    return topology.degree_histogram(_graph(spark, sf_dir, "dense"))


@query(_sql("dense", "SELECT id, count(*) AS n_nbrs, min(nbr) AS first_nbr, max(nbr) AS last_nbr FROM a GROUP BY id"))
def neighbor_set_size(spark, sf_dir):
    n = topology.neighbours(_graph(spark, sf_dir, "dense"))
    return n.select("id", F.size("nbrs").cast("long").alias("n_nbrs"), F.element_at("nbrs", 1).alias("first_nbr"), F.element_at("nbrs", -1).alias("last_nbr"))


@query(_sql("fan", _cc(ALL_CC, "SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT 2 * count(*) FROM e) AS n_arcs, count(DISTINCT comp) AS n_components FROM c")))
def graph_summary(spark, sf_dir):
    return topology.summary(_graph(spark, sf_dir))


@query(_sql("fan", _cc(ALL_CC, "SELECT id, comp FROM c")))
def connected_component_ids(spark, sf_dir):
    return topology.components(_graph(spark, sf_dir))


@query(_sql("fan", _cc(ALL_CC, "SELECT comp, count(*) AS n_nodes, CAST(sum(score) AS BIGINT) AS score FROM c JOIN n USING (id) GROUP BY comp")))
def component_scores(spark, sf_dir):
    return topology.component_scores(_graph(spark, sf_dir)).select("comp", "n_nodes", _long())


@query(_sql("fan", _cc(ALL_CC, "SELECT comp, CAST(sum(score) AS BIGINT) AS score FROM c JOIN n USING (id) GROUP BY comp ORDER BY 2 DESC, 1 LIMIT 1")))
def best_component(spark, sf_dir):
    return topology.component_scores(_graph(spark, sf_dir)).orderBy(F.desc("score"), "comp").limit(1).select("comp", _long())


@query(_sql("dense", "SELECT u, v FROM e JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE x.score > 0 AND y.score > 0"))
def induced_subgraph(spark, sf_dir):
    g = _graph(spark, sf_dir, "dense")
    return topology.induced(g, g.nodes.where("score > 0")).edges


@query(_sql("dense", "SELECT DISTINCT nbr AS id FROM a JOIN n USING (id) WHERE score > 450000 AND nbr NOT IN (SELECT id FROM n WHERE score > 450000)"))
def boundary(spark, sf_dir):
    g = _graph(spark, sf_dir, "dense")
    return topology.boundary(g, g.nodes.where("score > 450000"))


@query(_sql("dense", "SELECT CAST(sum(score) AS BIGINT) AS score, count(*) AS n_nodes FROM n WHERE score > 0"))
def module_score(spark, sf_dir):
    g = _graph(spark, sf_dir, "dense")
    return analysis.module_score(g, g.nodes.where("score > 0")).select(_long(), "n_nodes")


@query("SELECT event_id, round(-ln(value / 500) + ln(0.05), 9) AS score FROM events")
def score_tau(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", scoring.rounded(scoring.score_tau(F.col("value") / 500, 0.05), 9).alias("score"))


@query("SELECT event_id, round((0.4 - 1) * (ln(value / 500) - ln(pow((0.5 + 0.5 * 0.4 - 0.1 * 0.5) / (0.1 * 0.5), 1 / (0.4 - 1)))), 9) AS score FROM events")
def score_bum(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", scoring.rounded(scoring.score_bum(F.col("value") / 500, 0.5, 0.4, 0.1), 9).alias("score"))


@query(_sql("dense", "SELECT count(*) FILTER (score > 0) AS n_positive, count(*) FILTER (score <= 0) AS n_negative, count(*) FILTER (score > 0) / count(*) AS positive_fraction FROM n"))
def score_sign_stats(spark, sf_dir):
    return scoring.sign_stats(_graph(spark, sf_dir, "dense").nodes)


@query(_sql("dense", "SELECT CAST(greatest(max(score), 0) AS BIGINT) AS lower_bound FROM n"))
def lower_bound(spark, sf_dir):
    return scoring.lower_bound(_graph(spark, sf_dir, "dense").nodes).select(F.col("lower_bound").cast("long").alias("lower_bound"))


@query(_sql("dense", "SELECT id, round((score - (SELECT min(score) FROM n)) / ((SELECT max(score) FROM n) - (SELECT min(score) FROM n)), 9) AS norm FROM n"))
def min_max_scaled(spark, sf_dir):
    return scoring.min_max_scaled(_graph(spark, sf_dir, "dense").nodes).select("id", scoring.rounded(F.col("norm"), 9).alias("norm"))


@query(_sql("dense", """SELECT a.id, CAST(n.score + sum(m.score) AS BIGINT) AS benefit, n.score + sum(m.score) >= max(m.score) AS beneficial
FROM a JOIN n ON n.id = a.id JOIN n m ON m.id = a.nbr WHERE n.score < 0 AND m.score >= 0 GROUP BY a.id, n.score"""))
def neg_hub_benefit(spark, sf_dir):
    return analysis.negative_hub_benefit(_graph(spark, sf_dir, "dense")).select("id", _long("benefit"), "beneficial")


@query(_sql("path", "SELECT id FROM n JOIN deg USING (id) WHERE score < 0 AND degree <= 1"))
def neg_deg01_round(spark, sf_dir):
    return reduce.neg_deg01(_graph(spark, sf_dir, "path"))


@query(_sql("path", "SELECT nbr AS id, CAST(sum(score) AS BIGINT) AS gain, count(*) AS n_leaves FROM a JOIN n USING (id) JOIN deg USING (id) WHERE score >= 0 AND degree = 1 GROUP BY nbr"))
def pos_leaf_sum(spark, sf_dir):
    return reduce.pos_leaves(_graph(spark, sf_dir, "path")).groupBy(F.col("nbr").alias("id")).agg(F.sum("score").cast("long").alias("gain"), F.count(F.lit(1)).alias("n_leaves"))


def _contracted(g: ScoredGraph, edges: DataFrame) -> DataFrame:
    merge = connected_components(edges)
    return g.nodes.join(merge, "id").groupBy(F.col("comp").alias("id")).agg(F.sum("score").cast("long").alias("score"), F.count(F.lit(1)).alias("n_merged"))


MERGED = "SELECT comp AS id, CAST(sum(score) AS BIGINT) AS score, count(*) AS n_merged FROM c JOIN n USING (id) GROUP BY comp"


@query(_sql("fan", _cc("SELECT a.id AS x, nbr AS y FROM a JOIN n p ON p.id = a.id JOIN n q ON q.id = nbr WHERE p.score >= 0 AND q.score >= 0", MERGED)))
def pos_edge_contract(spark, sf_dir):
    g = _graph(spark, sf_dir, "fan")
    return _contracted(g, reduce.pos_edges(g))


@query(_sql("path", _cc("SELECT a.id AS x, nbr AS y FROM a JOIN n p ON p.id = a.id JOIN n q ON q.id = nbr JOIN d2 i ON i.id = a.id JOIN d2 j ON j.id = nbr WHERE p.score <= 0 AND q.score <= 0", MERGED)))
def neg_chain_contract(spark, sf_dir):
    g = _graph(spark, sf_dir, "path")
    return _contracted(g, reduce.neg_chain_edges(g))


@query(_sql("twin", """, k AS (SELECT d2.*, score, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, id) AS k FROM d2 JOIN n USING (id) WHERE score <= 0)
SELECT id FROM k WHERE k > 1 OR (a, b) IN (SELECT (a, b) FROM d2 JOIN n USING (id) WHERE score > 0)"""))
def neg_diamond(spark, sf_dir):
    return reduce.neg_diamond(_graph(spark, sf_dir, "twin"))


@query(_sql("fan", "SELECT id FROM d2 JOIN n USING (id) WHERE score <= 0 AND (a, b) IN (SELECT (u, v) FROM e)"))
def neg_circuit(spark, sf_dir):
    return reduce.neg_circuit(_graph(spark, sf_dir))


@query(_sql("twin", """, l AS (SELECT id, list(nbr ORDER BY nbr) AS nbrs FROM a GROUP BY id HAVING count(*) >= 2),
k AS (SELECT id, row_number() OVER (PARTITION BY nbrs ORDER BY score DESC, id) AS k FROM l JOIN n USING (id) WHERE score <= 0) SELECT id FROM k WHERE k > 1"""))
def mirrored_hubs(spark, sf_dir):
    return reduce.mirrored_hubs(_graph(spark, sf_dir, "twin"), 2)


@query(_sql("fan", """SELECT DISTINCT u.id FROM (SELECT x.id, y.id AS v, count(*) AS c FROM a x JOIN a y ON x.nbr = y.nbr AND x.id <> y.id GROUP BY 1, 2) q
JOIN n u ON u.id = q.id JOIN n w ON w.id = q.v JOIN deg d ON d.id = q.id WHERE c = d.degree AND u.score <= 0 AND w.score > u.score"""))
def dominated_hubs(spark, sf_dir):
    return reduce.dominated_hubs(_graph(spark, sf_dir))


@query(_sql("twin", """, p AS (SELECT a, b, count(*) AS c FROM d2 JOIN n USING (id) WHERE score >= 0 GROUP BY a, b)
SELECT DISTINCT CASE WHEN x.score <= y.score THEN x.id ELSE y.id END AS id FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN deg dx ON dx.id = a JOIN deg dy ON dy.id = b
WHERE x.score <= 0 AND y.score <= 0 AND dx.degree = c AND dy.degree = c"""))
def pos_diamond(spark, sf_dir):
    return reduce.pos_diamond(_graph(spark, sf_dir, "twin"))


@query(f"SELECT u AS id, k AS level FROM ({ORDER_ROWS}) UNION ALL SELECT DISTINCT o_custkey + {CUSTOMER}, 0 FROM orders")
def bfs_levels(spark, sf_dir):
    """Steps from the customers along the paths of their orders."""
    g = _graph(spark, sf_dir, "path")
    return topology.bfs_levels(g.edges, g.nodes.where(F.col("id") >= CUSTOMER).select("id")).select("id", F.col("level").cast("long").alias("level"))


@query(f"""WITH leaf AS (SELECT c_nationkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) - {LEAF_CENTS} AS w FROM customer UNION ALL SELECT s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) - {LEAF_CENTS} FROM supplier),
t AS (SELECT n_nationkey, n_regionkey, {INNER_CENTS} + coalesce(sum(greatest(w, 0)), 0) AS dp FROM nation LEFT JOIN leaf ON k = n_nationkey GROUP BY 1, 2)
SELECT r_regionkey::BIGINT AS region, CAST({INNER_CENTS} + coalesce(sum(greatest(dp, 0)), 0) AS BIGINT) AS dp FROM region LEFT JOIN t ON n_regionkey = r_regionkey GROUP BY 1""")
def tree_dp(spark, sf_dir):
    """Best connected set that holds the root, for each region's tree of nations and their leaves."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    nations, leaves = 10**6, 10**7
    nodes = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(INNER_CENTS).cast("long").alias("score"))
    nodes = nodes.union(n.select(F.col("n_nationkey") + nations, F.col("n_regionkey").cast("long"), F.lit(INNER_CENTS).cast("long")))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey") + leaves, F.col("c_nationkey") + nations, _cents("c_acctbal", LEAF_CENTS))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey") + SHIFT, F.col("s_nationkey") + nations, _cents("s_acctbal", LEAF_CENTS))
    best = analysis.tree_values(nodes.union(c).union(s))
    return best.where("parent is null").select(F.col("id").alias("region"), F.col("value").cast("long").alias("dp"))


def _pcst(spark, sf_dir):
    g = _graph(spark, sf_dir)
    edges = g.edges.select("u", "v", (F.col("u") % 50 * 1000).alias("cost"))
    return g.nodes.select("id", F.greatest("score", F.lit(0)).alias("prize")), edges


@query(_sql("fan", "SELECT CAST(id AS VARCHAR) AS label, greatest(score, 0) AS score FROM n UNION ALL SELECT concat(u, '--', v), -(u % 50 * 1000) FROM e"))
def pcst_transform(spark, sf_dir):
    return pcst.pcst_graph(*_pcst(spark, sf_dir)).nodes.select("label", _long())


@query(_sql("fan", """SELECT CAST((SELECT sum(u % 50 * 1000) FROM e JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE x.score > 0 AND y.score > 0)
+ (SELECT coalesce(sum(greatest(score, 0)), 0) FROM n WHERE score <= 0) AS BIGINT) AS cost"""))
def pcst_cost(spark, sf_dir):
    """Cost of choosing all positive nodes and the edges between them."""
    nodes, edges = _pcst(spark, sf_dir)
    chosen = _graph(spark, sf_dir).nodes.where("score > 0").select("id")
    own = edges.join(chosen.withColumnRenamed("id", "u"), "u", "left_semi").join(chosen.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "cost")
    return pcst.cost(nodes, own, chosen).select(F.col("cost").cast("long").alias("cost"))


@query(_sql("path", """, s(gone, id, x) AS (SELECT g.id, a.id, a.id FROM n g JOIN a ON a.nbr = g.id
UNION SELECT s.gone, s.id, a.nbr FROM s JOIN a ON a.id = s.x WHERE a.nbr <> s.gone),
k AS (SELECT gone, id, min(x) AS comp FROM s GROUP BY gone, id)
SELECT gone AS id, count(DISTINCT comp) AS n_blocks FROM k GROUP BY gone HAVING count(DISTINCT comp) > 1"""))
def articulation_points(spark, sf_dir):
    return topology.articulation_points(_graph(spark, sf_dir, "path"))


@query()
def blocks(spark, sf_dir):
    return topology.blocks(_graph(spark, sf_dir, "dense"))


#: Blocks from what each cut node parts; numbered by the least node but for the one nearest the least of all.
BLOCKS = """, r0(id, low) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT a.nbr, min(r0.low) FROM r0 JOIN a ON a.id = r0.id JOIN recurring.r0 o ON o.id = a.nbr WHERE r0.low < o.low GROUP BY a.nbr),
c AS (SELECT id, low AS comp FROM r0),
s(gone, id, low) USING KEY (gone, id) AS (SELECT g.id, c.id, c.id FROM c g JOIN c ON c.comp = g.comp AND c.id <> g.id
  UNION SELECT s.gone, a.nbr, min(s.low) FROM s JOIN a ON a.id = s.id JOIN recurring.s o ON o.gone = s.gone AND o.id = a.nbr WHERE a.nbr <> s.gone AND s.low < o.low GROUP BY s.gone, a.nbr),
side AS (SELECT s.*, comp FROM s JOIN c USING (id) WHERE gone IN (SELECT gone FROM s GROUP BY gone HAVING count(DISTINCT low) > 1)),
x AS (SELECT u, v, c.comp, coalesce(string_agg(low, ',' ORDER BY gone), '') AS part FROM e JOIN c ON c.id = u LEFT JOIN side ON side.comp = c.comp AND side.id = CASE WHEN u = gone THEN v ELSE u END GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT comp, part, unnest([u, v]) AS id FROM x),
t AS (SELECT comp, part, comp AS top FROM m WHERE id = comp
  UNION SELECT m.comp, m.part, m.id FROM m JOIN m y ON y.comp = m.comp AND y.part = m.part AND y.id <> m.id JOIN side o ON o.gone = m.id AND o.id = y.id JOIN side r ON r.gone = m.id AND r.id = m.comp WHERE r.low <> o.low),
num AS (SELECT m.comp, m.part, dense_rank() OVER (PARTITION BY m.comp ORDER BY min(m.id)) - 1 AS block FROM m JOIN t USING (comp, part) WHERE m.id <> top GROUP BY 1, 2)
SELECT comp, block, u, v FROM x JOIN num USING (comp, part)"""


@query(_sql("kite", BLOCKS))
def blocks_mixed(spark, sf_dir):
    """Rings of orders around their customers, and the bridges that hang on them."""
    return topology.blocks(_graph(spark, sf_dir, "kite"))


@query(_sql("kite", BLOCKS.rpartition("SELECT")[0] + "SELECT id, count(*) AS n_blocks FROM m GROUP BY id HAVING count(*) > 1"))
def articulation_mixed(spark, sf_dir):
    return topology.articulation_points(_graph(spark, sf_dir, "kite"))


@query()
def msf_weight(spark, sf_dir):
    g = _graph(spark, sf_dir, "dense")
    forest = topology.spanning_forest(g.edges.select("u", "v", (F.col("u") * 7 % 101 + F.col("v") % 13).alias("cost")))
    return forest.agg(F.sum("cost").cast("long").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


@query()
def reduce_full(spark, sf_dir):
    return reduce.reduced(_graph(spark, sf_dir)).nodes.select("id", "score")


@query()
def monte_carlo(spark, sf_dir):
    return solve.monte_carlo(_graph(spark, sf_dir), 10, reduce=False).bounds


@query()
def mwcs_exact(spark, sf_dir):
    return solve.solve(_graph(spark, sf_dir), reduce=False).bounds


@query()
def mwcs_rooted(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return solve.solve(g.with_roots(g.nodes.orderBy(F.desc("score"), "id").limit(1)), reduce=False).bounds


@query()
def permutation_pval(spark, sf_dir):
    return solve.permutation_null(_graph(spark, sf_dir), 5)


@query(_sql("fan", _cc(ALL_CC, """, t AS (SELECT comp FROM c JOIN n USING (id) GROUP BY comp ORDER BY sum(score) DESC, comp LIMIT 1)
SELECT 0::BIGINT AS unknown_nodes, 0::BIGINT AS unknown_edges, 0::BIGINT AS missing_roots, count(DISTINCT comp) AS n_components, count(DISTINCT comp) <= 1 AS valid FROM c WHERE comp IN (SELECT comp FROM t)""")))
def check_solution(spark, sf_dir):
    """The check of the best component, taken as a solution."""
    g = _graph(spark, sf_dir)
    best = topology.component_scores(g).orderBy(F.desc("score"), "comp").limit(1).select("comp")
    return solve.check_solution(g, topology.components(g).join(best, "comp", "left_semi").select("id"))


@query(_sql("dense", "SELECT CAST(id AS VARCHAR) AS label, CASE WHEN score > 0 THEN CAST(score AS DOUBLE) END AS score FROM n"))
def module_table(spark, sf_dir):
    """Every node with its score in the module of positive nodes; null outside it."""
    return _graph(spark, sf_dir, "dense").nodes.select("label", F.when(F.col("score") > 0, F.col("score")).alias("score"))


@query(_sql("dense", "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20"))
def top_degree(spark, sf_dir):
    return topology.degrees(_graph(spark, sf_dir, "dense")).orderBy(F.desc("degree"), "id").limit(20)


@query("""WITH p AS (SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (u = v) AS BIGINT) AS n_self_loops, CAST(sum(n - 1) FILTER (u <> v) AS BIGINT) AS n_repeats, count(*) FILTER (u <> v) AS n_edges FROM p""")
def edge_counters(spark, sf_dir):
    """Of the raw pairs of part and supplier numbers, taken as one set of nodes."""
    return analysis.edge_counters(_read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")))


def _flagged(spark, sf_dir, flag):
    return _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id"))


def _set_sql(op: str) -> str:
    return f"SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' {op} SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'"


@query(_set_sql("UNION"))
def node_union(spark, sf_dir):
    """Parts of returned or accepted lines."""
    return analysis.union(_flagged(spark, sf_dir, "R"), _flagged(spark, sf_dir, "A"))


@query(_set_sql("INTERSECT"))
def node_intersection(spark, sf_dir):
    return analysis.intersection(_flagged(spark, sf_dir, "R"), _flagged(spark, sf_dir, "A"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def node_difference(spark, sf_dir):
    """Customers without a pending order."""
    pending = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return analysis.difference(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), pending)


@query(_sql("path", f""", s AS (SELECT c, k, sum(score) OVER (PARTITION BY c ORDER BY k) AS t, row_number() OVER (PARTITION BY c ORDER BY k DESC) AS back FROM ({ORDER_ROWS}) o JOIN n ON n.id = o.u)
SELECT c AS path_id, max(t) FILTER (back = 1) >= max(t) AND max(t) FILTER (back = 1) >= 0 AS ok FROM s GROUP BY c"""))
def paths_ok(spark, sf_dir):
    """Of each customer's orders in their order."""
    o = _read(spark, sf_dir, "orders")
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return analysis.paths_ok(o.select(F.col("o_custkey").alias("path_id"), step.alias("step"), F.col("o_orderkey").alias("id")), _graph(spark, sf_dir, "path"))


PRICE_PAIRS = "SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders"


@query(_sql("fan", f"SELECT a, b, (least(a, b), greatest(a, b)) IN (SELECT (u, v) FROM e) AS adjacent FROM ({PRICE_PAIRS}) WHERE b IS NOT NULL"))
def adjacent_pairs(spark, sf_dir):
    """Whether orders that follow each other in price are joined."""
    by_price = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    pairs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(by_price).alias("b")).where("b is not null")
    return analysis.adjacent_pairs(_graph(spark, sf_dir), pairs)


@query(_sql("fan", f"SELECT min(u) AS comp, 0::BIGINT AS block, bool_and(n.score <= 0) AND any_value(m.score) <= 0 AS negative FROM ({ORDER_ROWS}) o JOIN n ON n.id = o.u JOIN n m ON m.id = o.c + {CUSTOMER} GROUP BY c"))
def block_negativity(spark, sf_dir):
    """A customer's fan of orders is one block."""
    g = _graph(spark, sf_dir)
    return analysis.block_negativity(g, topology.blocks(g))


@query(_sql("fan", "SELECT CAST(sum(greatest(score, 0)) AS BIGINT) AS profit FROM n"))
def node_profit(spark, sf_dir):
    """Of all nodes and edges of a prize-collecting instance, the prizes alone."""
    g = pcst.pcst_graph(*_pcst(spark, sf_dir))
    return pcst.node_profit(g, g.nodes.select("id")).select(_long("profit"))


@query(_sql("dense", "SELECT id, CAST(id AS VARCHAR) AS label, score FROM n"))
def by_weight(spark, sf_dir):
    return analysis.by_weight(_graph(spark, sf_dir, "dense")).select("id", "label", _long())


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), m AS (SELECT p.a, p.b FROM p JOIN p q ON p.a = q.b AND p.b = q.a WHERE p.a <> p.b),
r(id, x) AS (SELECT a, a FROM m UNION SELECT r.id, m.b FROM r JOIN m ON m.a = r.x) SELECT id, min(x) AS class FROM r GROUP BY id""")
def equivalence_classes(spark, sf_dir):
    """Numbers that stand to each other as part and supplier both ways."""
    return analysis.equivalence_classes(_read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


TERMINAL = 300_000  # cents from which a node of the dense network is a terminal


@query(_sql("dense", f""", q AS (SELECT id, greatest(-score, 0) AS cost FROM n),
w(k, id, dist) AS (SELECT 0, id, 0 FROM n WHERE score >= {TERMINAL}
  UNION ALL SELECT DISTINCT k + 1, id, dist FROM (SELECT k, id, min(dist) OVER (PARTITION BY id) AS dist, dist AS d FROM (
    SELECT w.k, w.id, w.dist FROM w UNION ALL SELECT w.k, a.nbr, w.dist + q.cost FROM w JOIN a ON a.id = w.id JOIN q ON q.id = a.nbr)) WHERE d = dist AND k < 12)
SELECT id, CAST(dist AS BIGINT) AS dist FROM w WHERE k = 12"""))
def nearest_terminal(spark, sf_dir):
    """What the cheapest way to each node costs from a node of high score, negative nodes being paid for."""
    g = _graph(spark, sf_dir, "dense")
    return paths.nearest_sources(g, g.nodes.where(F.col("score") >= TERMINAL)).select("id", F.col("dist").cast("long").alias("dist"))


@query(_sql("twin", """, p AS (SELECT d2.id, a, b, score FROM d2 JOIN n USING (id))
SELECT x.id FROM p x WHERE x.score <= 0 AND EXISTS (SELECT 1 FROM p y WHERE y.a = x.a AND y.b = x.b AND y.id <> x.id
  AND (y.score > 0 OR y.score > x.score OR (y.score = x.score AND y.id > x.id)))
UNION SELECT x.id FROM d2 x JOIN n USING (id) WHERE score <= 0 AND (x.a, x.b) IN (SELECT (u, v) FROM e)"""))
def detour_rule(spark, sf_dir):
    """Nodes that a detour makes needless. In the twin network a way from a customer to its account leads
    over one other order, or back and forth over more, which is never cheaper."""
    return reduce.shortest_path(_graph(spark, sf_dir, "twin"))


@query(_sql("path", "SELECT x.id AS cut_id, (dx.degree > 1)::INT + (dy.degree > 1)::INT AS block_degree FROM a x JOIN deg dx ON dx.id = x.id JOIN deg dy ON dy.id = x.nbr WHERE dx.degree > 1"))
def block_cut_tree(spark, sf_dir):
    """Each cut node with the cut nodes in each of its blocks; in a path the blocks are the edges."""
    return topology.block_cut_tree(_graph(spark, sf_dir, "path")).select("cut_id", F.col("block_degree").cast("int").alias("block_degree"))


@query(_sql("path", _cc(ALL_CC, "SELECT (SELECT count(*) FROM e) = count(*) - count(DISTINCT comp) AS is_forest, count(DISTINCT comp) <= 1 AS is_connected, (SELECT max(score) <= 0 FROM n) AS all_negative FROM c")))
def network_kind(spark, sf_dir):
    """Whether the paths are a forest, hang together, and have no positive node."""
    g = _graph(spark, sf_dir, "path")
    kind = [(*topology.kind(g), bool(scoring.all_negative(g.nodes).first()[0]))]
    return spark.createDataFrame(kind, "is_forest boolean, is_connected boolean, all_negative boolean")


@query(_sql("fan", f"""SELECT u, v FROM (SELECT u, v FROM e WHERE v < {CUSTOMER} UNION SELECT a.u, b.u FROM e a JOIN e b ON a.v = b.v AND a.v >= {CUSTOMER} AND a.u % 50 = 7 AND b.u > a.u AND b.u < a.u + 40)
WHERE u IN (SELECT id FROM n WHERE score > -200000) AND v IN (SELECT id FROM n WHERE score > -200000)"""))
def network_edited(spark, sf_dir):
    """Without the customers' edges, with edges between some orders of a customer, without dear nodes."""
    g = _graph(spark, sf_dir)
    own = g.edges.where(F.col("v") >= CUSTOMER)
    first = own.where("u % 50 = 7").select(F.col("u").alias("a"), "v")
    new = first.join(own, "v").where("u > a and u < a + 40").select(F.col("a").alias("u"), F.col("u").alias("v"))
    return g.without_edges(own).with_edges(new).without(g.nodes.where("score <= -200000")).edges


@query(_sql("fan", _cc("SELECT a.id AS x, nbr AS y FROM a JOIN n p ON p.id = a.id JOIN n q ON q.id = nbr WHERE p.score >= 0 AND q.score >= 0", f"""SELECT comp AS id, CAST(sum(score) AS BIGINT) AS score, count(*) AS n_originals,
string_agg(CAST(id AS VARCHAR), '_' ORDER BY id) AS label FROM c JOIN n USING (id) GROUP BY comp HAVING comp < {CUSTOMER}""")))
def merged_labels(spark, sf_dir):
    """What contraction of non-negative neighbours makes: scores, provenance and labels of the merged."""
    g = _graph(spark, sf_dir)
    merge = written(connected_components(reduce.pos_edges(g)), "classes")
    small = g.merged(merge.where("id <> comp").select(F.col("id").alias("old"), F.col("comp").alias("new"))).stored()
    many = small.node_map.groupBy(F.col("pre_id").alias("id")).agg(F.count(F.lit(1)).alias("n_originals")).where("n_originals > 1")
    return small.nodes.select("id", _long()).join(many, "id").join(small.joined_labels(g), "id").select("id", "score", "n_originals", "label")


@query()
def hub_sample(spark, sf_dir):
    return analysis.hub_sample(analysis.negative_hub_benefit(_graph(spark, sf_dir, "dense")).where("beneficial"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score) of the best connected module of the part-supplier network."""
    g = _graph(spark, sf_dir)
    return g.nodes.select("id", "score").join(solve.solve(g, reduce=False).ids, "id", "left_semi")
