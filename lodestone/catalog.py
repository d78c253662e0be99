"""The queries of the library's own operators over the driver's tables, and their SQL.

Roles: a customer is a user, a part or supplier an item, the quantity a rating, an order a basket of suppliers or
brands, a source a city, an embedding a point, an event a record of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import cf, cluster, content, explore, graph, itemsets, similarity, sketch
from .plans.cut import cut
from .sources.files import table
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Orders with their lines."""
    return table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


FACTS = "lineitem JOIN orders ON l_orderkey = o_orderkey"

# exploration


@query("SELECT count(*) AS n_rows, count(*) FILTER (contains(CAST(o_orderdate AS VARCHAR), '1996')) AS n_year, count(DISTINCT o_custkey) AS n_users FROM orders")
def overview(s, d):
    return explore.overview(table(s, d, "orders"), "o_custkey", "o_orderdate", 1996)


@query("SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS VARCHAR) LIKE '1996%'")
def year_prefix(s, d):
    return explore.year_prefix(table(s, d, "orders"), "o_orderdate", 1996).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def top_users(s, d):
    return explore.top_counts(table(s, d, "orders"), "o_custkey", 20)


STOP = ("the", "of", "and", "de", "la", "der")


@query(f"""WITH w AS (SELECT unnest(string_split_regex(regexp_replace(translate(lower(text), ',.!?:;()[]', ''), '[\\s\\x{{A0}}]+', ' ', 'g'), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN {STOP} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25""")
def top_words(s, d):
    stop = s.createDataFrame([(w,) for w in STOP], "word string")
    return explore.top_words(table(s, d, "documents"), X.plain_words(F.col("text")), stop, 25)


@query("""WITH c AS (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS category FROM part WHERE p_name <> ''),
m AS (SELECT category, round(sum(l_quantity) / count(l_quantity), 1) AS avg_stars FROM lineitem JOIN c ON l_partkey = p_partkey GROUP BY 1)
SELECT category, avg_stars FROM m ORDER BY avg_stars DESC, category LIMIT 15""")
def category_avg(s, d):
    part = table(s, d, "part").where("p_name <> ''").withColumnRenamed("p_partkey", "l_partkey")
    return explore.category_average(table(s, d, "lineitem"), part, "l_partkey", X.categories(F.col("p_name"), " "), "l_quantity", 15)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def items_over_threshold(s, d):
    return explore.over_threshold(table(s, d, "orders"), "o_custkey", 12)


@query("""WITH c AS (SELECT ascii(CAST(o_custkey AS VARCHAR)) % 12 AS part, count(*) AS n FROM orders GROUP BY 1)
SELECT r.range::INTEGER AS part, coalesce(n, 0) AS n FROM range(12) r LEFT JOIN c ON c.part = r.range""")
def partition_stats(s, d):
    return explore.partition_counts(table(s, d, "orders"), "o_custkey", 12)


@query(f"SELECT DISTINCT o_custkey, l_suppkey FROM {FACTS} WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)")
def state_filter_pairs(s, d):
    chosen = table(s, d, "supplier").where("s_nationkey = 7").withColumnRenamed("s_suppkey", "l_suppkey")
    return explore.semi_pairs(_facts(s, d), chosen, "l_suppkey", "o_custkey", "l_suppkey")


# itemsets


@query("SELECT l_orderkey AS k, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS items FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 3")
def baskets(s, d):
    return itemsets.baskets(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", 3).select(F.col("l_orderkey").alias("k"), F.array_join("items", ",").alias("items"))


def _brands(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")


def _support(s, d):
    return max(2, table(s, d, "orders").count() * 3 // 2000)


FREQUENT = """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT greatest(2, count(*) * 3 // 2000) AS m FROM orders),
f AS (SELECT i FROM b GROUP BY i HAVING count(*) >= (SELECT m FROM s)),
c AS (SELECT k, i FROM b JOIN f USING (i)),
o AS (SELECT k, 1 AS size, i AS items, i AS last FROM c UNION ALL SELECT o.k, size + 1, items || ',' || c.i, c.i FROM o JOIN c ON o.k = c.k AND o.last < c.i)
SELECT size, items, count(*) AS support FROM o GROUP BY 1, 2 HAVING count(*) >= (SELECT m FROM s)"""


def _joined(df):
    return df.select("size", F.array_join("items", ",").alias("items"), "support")


@query(FREQUENT)
def freq_itemsets(s, d):
    return _joined(itemsets.apriori(_brands(s, d), "l_orderkey", "p_brand", _support(s, d)))


@query(FREQUENT)
def freq_itemsets_son(s, d):
    return _joined(itemsets.son(_brands(s, d), "l_orderkey", "p_brand", _support(s, d)))


@query(FREQUENT)
def freq_itemsets_fp(s, d):
    return _joined(itemsets.fp_growth(_brands(s, d), "l_orderkey", "p_brand", _support(s, d)))


# similarity

JACCARD = f"""WITH r AS (SELECT DISTINCT l_suppkey AS k, o_custkey AS e FROM {FACTS}), n AS (SELECT k, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM r x JOIN r y ON x.e = y.e AND x.k < y.k GROUP BY 1, 2)
SELECT a, b, c / (na.n + nb.n - c) AS sim FROM c JOIN n na ON a = na.k JOIN n nb ON b = nb.k WHERE c / (na.n + nb.n - c) >= 0.05"""


@query(JACCARD)
def jaccard_pairs(s, d):
    return similarity.exact(_facts(s, d), "l_suppkey", "o_custkey", 0.05)


def _params(n):
    return ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate([(1, 0), *similarity.hash_params(n - 1)]))


MODULUS = "(SELECT count(DISTINCT o_custkey) FROM orders)"
SIGNATURE = f"""SELECT l_suppkey AS k, i, min((o_custkey * a + b) % {MODULUS}) AS h FROM {FACTS} CROSS JOIN (VALUES {_params(50)}) p(i, a, b) GROUP BY 1, 2"""


def _modulus(s, d):
    return max(1, table(s, d, "orders").select("o_custkey").distinct().count())


@query(SIGNATURE)
def minhash_signature(s, d):
    return similarity.signatures(_facts(s, d), "l_suppkey", "o_custkey", _modulus(s, d))


@query(f"""WITH g AS ({SIGNATURE}), p AS (SELECT DISTINCT x.k AS a, y.k AS b FROM g x JOIN g y ON x.i = y.i AND x.h = y.h AND x.k < y.k),
j AS ({JACCARD}) SELECT a, b, sim FROM j JOIN p USING (a, b)""")
def lsh_pairs(s, d):
    return similarity.lsh(_facts(s, d), "l_suppkey", "o_custkey", _modulus(s, d), 0.05)


# content

WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '')"
PROFILE = f"""w AS (SELECT source, term, count(*) AS f FROM (SELECT source, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2),
t AS (SELECT term, sum(f) AS t, count(*) AS df FROM w GROUP BY 1), k AS (SELECT term, df FROM t WHERE t.t > (SELECT sum(f) FROM w) * 1e-6),
v AS (SELECT source, term, round(f / max(f) OVER (PARTITION BY source) * log2((SELECT count(DISTINCT source) FROM w) / df), 9) AS x FROM w JOIN k USING (term)),
profile AS (SELECT source, term FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY x DESC, term) <= 200)"""


def _profile(s, d):
    return content.profiles(table(s, d, "documents"), "source", X.letters(F.col("text")))


@query(f"WITH {PROFILE} SELECT source, term FROM profile")
def tfidf_profile(s, d):
    return _profile(s, d)


def _visits(s, d):
    """Users of events and the sources they stand for."""
    return table(s, d, "events").select("user_id", F.concat(F.lit("src"), F.pmod(F.col("event_id"), F.lit(20)).cast("string")).alias("source"))


VISITS = "visits AS (SELECT DISTINCT user_id, 'src' || (event_id % 20) AS source FROM events)"


@query(f"WITH {PROFILE}, {VISITS} SELECT DISTINCT user_id, term FROM visits JOIN profile USING (source)")
def user_profile(s, d):
    return content.user_profiles(_visits(s, d), cut(_profile(s, d)), "user_id", "source")


@query(f"""WITH {PROFILE}, {VISITS}, u AS (SELECT DISTINCT user_id, term FROM visits JOIN profile USING (source)),
nu AS (SELECT user_id, count(*) AS nu FROM u GROUP BY 1), ni AS (SELECT source, count(*) AS ni FROM profile GROUP BY 1),
c AS (SELECT user_id, source, count(*) AS c FROM visits JOIN profile USING (source) JOIN u USING (user_id, term) GROUP BY 1, 2)
SELECT user_id, source, round(c / (sqrt(nu) * sqrt(ni)), 6) AS sim FROM c JOIN nu USING (user_id) JOIN ni USING (source) WHERE c / (sqrt(nu) * sqrt(ni)) >= 0.01""")
def content_score(s, d):
    return content.own_scores(_visits(s, d), cut(_profile(s, d)), "user_id", "source").withColumn("sim", F.round("sim", 6))


# collaborative filtering


def _ratings(s, d):
    return cf.ratings(_facts(s, d), "o_custkey", "l_suppkey", "l_quantity")


RATINGS = f"r AS (SELECT o_custkey AS usr, l_suppkey AS item, avg(l_quantity) AS stars FROM {FACTS} GROUP BY 1, 2)"


def _model_sql(of: str, by: str, least: int, keep: str, jaccard: str = "") -> str:
    size = f", z AS (SELECT {of} AS k, count(*) AS c FROM r GROUP BY 1)" if jaccard else ""
    more = f" JOIN z za ON za.k = a JOIN z zb ON zb.k = b WHERE n / (za.c + zb.c - n) >= {jaccard}" if jaccard else ""
    return f"""g AS (SELECT x.{of} AS a, y.{of} AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * y.stars) AS sxy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy
FROM r x JOIN r y ON x.{by} = y.{by} AND x.{of} < y.{of} GROUP BY 1, 2 HAVING count(*) >= {least}){size},
q AS (SELECT a, b, CASE WHEN sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) ELSE 0 END AS v FROM g{more}),
model AS (SELECT a, b, round(v, 6) AS sim FROM q WHERE {keep.replace("sim", "round(v, 6)")})"""


#: Jaccard similarity of what two users rated, for a place in the user model.
ALIKE = 0.01


@query(f"WITH {RATINGS}, {_model_sql('item', 'usr', 3, 'sim > 0')} SELECT a, b, sim FROM model")
def cf_item_model(s, d):
    return cf.model(_ratings(s, d), "item", "user", 3)


@query(f"WITH {RATINGS}, {_model_sql('usr', 'item', 3, 'sim > 0', str(ALIKE))} SELECT a, b, sim FROM model")
def cf_user_model(s, d):
    return cf.model(_ratings(s, d), "user", "item", 3, jaccard=ALIKE)


@query(f"WITH {RATINGS}, {_model_sql('usr', 'item', 5, 'sim >= 0.5 OR sim <= -0.8')} SELECT a, b, sim FROM model")
def cf_competition_model(s, d):
    return cf.model(_ratings(s, d), "user", "item", 5, keep=cf.strong)


def _test(s, d):
    """The pairs to predict: every customer with every supplier of their orders."""
    return _facts(s, d).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).dropna().distinct()


TEST = f"t AS (SELECT DISTINCT o_custkey AS usr, l_suppkey AS item FROM {FACTS})"
BOTH = "m2 AS (SELECT a, b, sim FROM model UNION ALL SELECT b, a, sim FROM model)"


@query(f"""WITH {RATINGS}, {_model_sql('item', 'usr', 3, 'sim > 0')}, {TEST}, {BOTH},
k AS (SELECT t.usr, t.item, stars, sim FROM t JOIN m2 ON m2.a = t.item JOIN r ON r.usr = t.usr AND r.item = m2.b QUALIFY row_number() OVER (PARTITION BY t.usr, t.item ORDER BY sim DESC, m2.b) <= 5),
p AS (SELECT usr, item, sum(stars * sim) / sum(abs(sim)) AS p FROM k GROUP BY 1, 2), i AS (SELECT item, avg(stars) AS im FROM r GROUP BY 1)
SELECT usr AS user, item, round(coalesce(p, im, (SELECT avg(stars) FROM r)), 3) AS pred FROM t LEFT JOIN p USING (usr, item) LEFT JOIN i USING (item)""")
def cf_item_predict(s, d):
    r = cut(_ratings(s, d))
    return cf.predict_items(cut(_test(s, d)), r, cf.Like("item", "user", 3)).withColumn("pred", F.round("pred", 3))


@query(f"""WITH {RATINGS}, {_model_sql('usr', 'item', 3, 'sim > 0', str(ALIKE))}, {TEST}, {BOTH}, um AS (SELECT usr, avg(stars) AS um FROM r GROUP BY 1),
k AS (SELECT t.usr, t.item, stars - um AS dev, sim FROM t JOIN m2 ON m2.a = t.usr JOIN r ON r.usr = m2.b AND r.item = t.item JOIN um ON um.usr = m2.b QUALIFY row_number() OVER (PARTITION BY t.usr, t.item ORDER BY sim DESC, m2.b) <= 5),
p AS (SELECT usr, item, sum(dev * sim) / sum(abs(sim)) AS d FROM k GROUP BY 1, 2)
SELECT usr AS user, item, round(coalesce(um, (SELECT avg(stars) FROM r)) + coalesce(d, 0), 3) AS pred FROM t LEFT JOIN p USING (usr, item) LEFT JOIN um USING (usr)""")
def cf_user_predict(s, d):
    r = cut(_ratings(s, d))
    return cf.predict_users(cut(_test(s, d)), r, cf.Like("user", "item", 3, jaccard=ALIKE)).withColumn("pred", F.round("pred", 3))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS id, round(avg(l_quantity), 6) AS avg FROM lineitem GROUP BY 1 UNION ALL SELECT 'UNK', round(avg(l_quantity), 6) FROM lineitem")
def item_avg_with_global(s, d):
    return cf.averages(table(s, d, "lineitem"), "l_suppkey", "l_quantity").withColumn("avg", F.round("avg", 6))


def _errors(s, d):
    r = cut(_ratings(s, d))
    mean = r.groupBy("item").agg(F.avg("stars").alias("pred"))
    return cf.errors(r.join(mean, "item").select("user", "item", (F.col("pred") / 10).alias("pred")), r.withColumn("stars", F.col("stars") / 10))


ERRORS = f"{RATINGS}, e AS (SELECT abs(i.m / 10 - stars / 10) AS err FROM r JOIN (SELECT item, avg(stars) AS m FROM r GROUP BY 1) i USING (item))"


@query(f"WITH {ERRORS} SELECT count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse FROM e")
def rmse(s, d):
    return cf.rmse(_errors(s, d)).withColumn("rmse", F.round("rmse", 6))


@query(f"WITH {ERRORS} SELECT b.range AS bucket, count(err) AS n FROM range(6) b LEFT JOIN e ON ceil(round(err, 9)) = b.range GROUP BY 1")
def error_hist(s, d):
    return cf.histogram(_errors(s, d).select(F.round("err", 9).alias("err")))


@query(f"WITH {RATINGS}, {_model_sql('usr', 'item', 5, 'sim >= 0.5 OR sim <= -0.8')}, {TEST}, {BOTH}, um AS (SELECT usr, avg(stars) AS um FROM r GROUP BY 1), k AS (SELECT t.usr, t.item, count(*) AS n, sum(CASE WHEN sim < 0 THEN 51 - stars ELSE stars END * abs(sim)) / sum(abs(sim)) AS p FROM t JOIN m2 ON m2.a = t.usr JOIN r ON r.usr = m2.b AND r.item = t.item GROUP BY 1, 2 HAVING count(*) >= 3) SELECT usr AS user, item, round(coalesce(p, um), 3) AS pred FROM t LEFT JOIN k USING (usr, item) LEFT JOIN um USING (usr)")
def cf_hybrid_predict(s, d):
    """Few like users fall back on the user's mean; quantities go from 1 to 50."""
    r = cut(_ratings(s, d))
    test = cut(_test(s, d))
    mean = test.join(r.groupBy("user").agg(F.avg("stars").alias("pred")), "user").select("user", "item", "pred")
    return cf.hybrid(test, r, cf.Like("user", "item", 5, keep=cf.strong), mean, top=50.0).withColumn("pred", F.round("pred", 3))


@query(f"""WITH {RATINGS}, {_model_sql('item', 'usr', 3, 'sim > 0')}, {TEST}, {BOTH},
k AS (SELECT DISTINCT t.usr, t.item FROM t JOIN m2 ON m2.a = t.item JOIN r ON r.usr = t.usr AND r.item = m2.b)
SELECT (SELECT count(*) FROM k) AS matched, count(*) AS total FROM r""")
def coverage(s, d):
    """Of all rated pairs, how many the item model predicts: those whose user rated something like the item."""
    r = cut(_ratings(s, d))
    return cf.coverage(cf.predictable(_test(s, d), r, cf.Like("item", "user", 3)), r)


@query()
def svd_predict(s, d):
    return cf.factorized(cut(_ratings(s, d)), _test(s, d))


# graphs: all pairs of suppliers that share an order

EDGES = """c AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(DISTINCT x.l_orderkey) AS common FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2),
edges AS (SELECT a, b FROM c WHERE common >= 1), near AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)"""


#: Orders that two suppliers share to have an edge: with 1 no pair that occurs is left out. EDGES has the same bound.
COMMON = 1


def _edges(s, d):
    return cut(graph.edges_at(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", COMMON))


@query(f"WITH {EDGES} SELECT a, b, common FROM c")
def co_graph_pairs(s, d):
    return graph.co_occurrence(table(s, d, "lineitem"), "l_suppkey", "l_orderkey")


@query(f"WITH {EDGES} SELECT a AS id, count(*) AS degree FROM near GROUP BY 1")
def degree(s, d):
    return graph.degrees(_edges(s, d))


def _rounds(n: int) -> str:
    out = ["l0 AS (SELECT DISTINCT a AS id, a AS community FROM near)"]
    for k in range(1, n + 1):
        out.append(f"l{k} AS (SELECT id, community FROM (SELECT near.a AS id, community, count(*) AS n FROM near JOIN l{k - 1} ON l{k - 1}.id = near.b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, community) = 1)")
    return ", ".join(out)


@query(f"WITH {EDGES}, {_rounds(5)} SELECT id, community FROM l5")
def label_propagation(s, d):
    return graph.label_propagation(_edges(s, d))


REACH = "reach AS (SELECT DISTINCT a AS id, a AS r FROM near UNION SELECT reach.id, near.b FROM reach JOIN near ON reach.r = near.a), comp AS (SELECT id, min(r) AS community FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT id, community FROM comp")
def components(s, d):
    return graph.components(_edges(s, d))


@query(f"""WITH {EDGES}, {_rounds(5)}, m AS (SELECT count(*) AS m FROM edges),
i AS (SELECT x.community, count(*) AS e FROM edges JOIN l5 x ON x.id = a JOIN l5 y ON y.id = b WHERE x.community = y.community GROUP BY 1),
g AS (SELECT community, count(*) AS d FROM near JOIN l5 ON id = a GROUP BY 1)
SELECT round(sum(coalesce(e, 0) / m - pow(d / (2 * m), 2)), 6) AS q FROM g LEFT JOIN i USING (community) CROSS JOIN m""")
def modularity(s, d):
    edges = _edges(s, d)
    return graph.modularity(edges, graph.label_propagation(edges)).withColumn("q", F.round("q", 6))


@query()
def betweenness(s, d):
    return graph.betweenness(_edges(s, d))


@query()
def girvan_newman(s, d):
    return graph.girvan_newman(_edges(s, d))


# clusters


def _points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query()
def kmeans(s, d):
    return cluster.kmeans(_points(s, d), 10)[0].select("id", "cluster", F.round("dist", 6).alias("dist"))


@query()
def bfr(s, d):
    p = _points(s, d)
    return cluster.bfr([p.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k) for k in range(4)], 10)[0]


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings)
SELECT label AS cluster, j, count(*) AS n, round(sum(v) / count(*), 5) AS mean, round(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 5) AS variance FROM x GROUP BY 1, 2""")
def cluster_stats(s, d):
    p = _points(s, d)
    got = cluster.statistics(p, p.select("id", F.col("label").alias("cluster")))
    zipped = got.select("cluster", "n", F.posexplode(F.arrays_zip("centroid", "variance")).alias("j", "c"))
    return zipped.select("cluster", F.col("j").cast("long").alias("j"), "n", F.round("c.centroid", 5).alias("mean"), F.round("c.variance", 5).alias("variance"))


@query("""WITH j AS (SELECT label AS u, vec_id % 10 AS v, count(*) AS c FROM embeddings GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM j),
h AS (SELECT (SELECT -sum(c / n * ln(c / n)) FROM (SELECT sum(c) AS c FROM j GROUP BY u), n) AS hu, (SELECT -sum(c / n * ln(c / n)) FROM (SELECT sum(c) AS c FROM j GROUP BY v), n) AS hv, (SELECT -sum(c / n * ln(c / n)) FROM j, n) AS huv)
SELECT round(2 * (hu + hv - huv) / (hu + hv), 6) AS nmi FROM h""")
def nmi(s, d):
    rows = table(s, d, "embeddings").select("label", F.pmod("vec_id", F.lit(10)).alias("v"))
    return cluster.nmi(rows, "label", "v").withColumn("nmi", F.round("nmi", 6))


# sketches


def _bits(column: str) -> str:
    x = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, octet_length(encode({column})) + 1), lambda i: ('0x' || substr(hex(encode({column})), 2 * i - 1, 2))::BIGINT)), lambda acc, c: (acc * 256 + c) % 10000)"
    return "list_value(" + ", ".join(f"({x} * {a} + {b}) % 10000" for a, b in similarity.hash_params(8)) + ")"


@query(f"""WITH k AS (SELECT DISTINCT unnest({_bits("p_name")}) AS p FROM part WHERE p_name <> ''), b AS (SELECT list(p) AS bits FROM k)
SELECT c_name, CASE WHEN c_name <> '' AND list_has_all(bits, {_bits("c_name")}) THEN 1 ELSE 0 END AS verdict FROM customer, b""")
def bloom_probe(s, d):
    return sketch.bloom_probe(table(s, d, "part").withColumnRenamed("p_name", "c_name"), table(s, d, "customer").select("c_name"), "c_name")


def _fm_sql(rows: str, key: str) -> str:
    """(key, truth, estimate) of the distinct values x of `rows`."""
    params = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(similarity.hash_params(sketch.HASHES)))
    means = ", ".join(f"list_sum(p[{k + 1}:{k + sketch.GROUP}]) / {sketch.GROUP}" for k in range(0, sketch.HASHES, sketch.GROUP))
    return f"""x AS (SELECT DISTINCT {key}, x FROM ({rows})),
h AS (SELECT {key}, i, (((x::HUGEINT * a - b) % {sketch.MODULUS} + {sketch.MODULUS}) % {sketch.MODULUS})::BIGINT AS h FROM x, (VALUES {params}) t(i, a, b) WHERE x IS NOT NULL),
r AS (SELECT {key}, i, max(CASE WHEN h = 0 THEN 1 ELSE bit_count((h & -h) - 1) END) AS r FROM h GROUP BY 1, 2),
p AS (SELECT {key}, list_sort(list(pow(2.0, r))) AS p FROM r GROUP BY 1), n AS (SELECT {key}, count(x) AS truth FROM x GROUP BY 1)
SELECT {{0}}, truth, round(list_sort([{means}])[{sketch.HASHES // sketch.GROUP // 2 + 1}])::BIGINT AS estimate FROM p JOIN n USING ({key})"""


@query("WITH " + _fm_sql("SELECT event_type, user_id AS x FROM events", "event_type").format("event_type"))
def fm_estimate(s, d):
    return sketch.distinct_estimate(table(s, d, "events"), ["event_type"], F.col("user_id"))


@query("SELECT event_id, user_id FROM events ORDER BY (event_id * 2654435761 + 7) % 4294967296, event_id LIMIT 100")
def reservoir(s, d):
    return sketch.hash_sample(table(s, d, "events"), "event_id", 100, 7).select("event_id", "user_id")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n FROM c QUALIFY dense_rank() OVER (ORDER BY n DESC) <= 3")
def top3_tags(s, d):
    return sketch.top_ranks(table(s, d, "events"), "user_id")


@query("WITH e AS (SELECT ts, user_id, unnest([0, 2, 4]) * INTERVAL 1 HOUR AS back FROM events), " + _fm_sql("SELECT time_bucket(INTERVAL 2 HOUR, ts) - back AS start, user_id AS x FROM e", "start").format("strftime(start, '%Y-%m-%d %H:%M') AS start"))
def stream_window_distinct(s, d):
    """The table form of the stream; tests hold the stream's closed windows against it."""
    got = windows.distinct_windows(table(s, d, "events"), "ts", F.col("user_id"), "6 hours", "2 hours")
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
