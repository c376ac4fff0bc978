"""Every operator as a query on the test tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siltstone.operators import cluster, graph, itemsets, recommend, relational, similarity, sketch
from siltstone.sources import io
from siltstone.sources.io import betweenness_lines, community_lines, table
from siltstone.storage import new_path, store

STOP = ["the", "and", "of", "de", "la", "der", "die", "und", "in", "is"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- exploration ---


@query("SELECT count(*) AS n FROM orders")
def review_count(s, d):
    return table(s, d, "orders").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE starts_with(CAST(o_orderdate AS VARCHAR), '1997')")
def year_count(s, d):
    return table(s, d, "orders").where(F.col("o_orderdate").cast("string").startswith("1997")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def distinct_users(s, d):
    return table(s, d, "orders").agg(F.count_distinct("o_custkey").alias("n"))


@query('SELECT o_custkey AS "user", count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20')
def top_users(s, d):
    return relational.top_users(table(s, d, "orders"), "o_custkey", 20)


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[;,.:?!\\s()\\[\\]]')) AS word FROM documents WHERE text IS NOT NULL)
WHERE word <> '' AND lower(word) NOT IN ({STOP_SQL}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50""")
def top_words(s, d):
    return relational.top_words(table(s, d, "documents"), "text", STOP, 50)


@query("""SELECT category, round(avg(l_quantity), 6) AS stars FROM lineitem JOIN
(SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS category FROM part WHERE p_name IS NOT NULL) ON l_partkey = p_partkey
GROUP BY 1 ORDER BY avg(l_quantity) DESC, 1 LIMIT 50""")
def category_avg(s, d):
    reviews = table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("stars"))
    items = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("categories"))
    return relational.category_avg(reviews, items, 50, " ").withColumn("stars", F.round("stars", 6))


@query("SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def busy_items(s, d):
    return relational.busy_items(table(s, d, "lineitem"), "l_partkey", 30)


@query()
def partition_layout_default(s, d):
    return relational.partition_layout(table(s, d, "orders"), 8)


@query()
def partition_layout_custom(s, d):
    return relational.partition_layout(table(s, d, "orders"), 8, "o_custkey")


@query("SELECT 8 AS n_partitions, count(*) AS n_items FROM orders")
def partition_layout_total(s, d):
    """Rows and partitions, empty ones included, of an even deal."""
    return relational.partition_totals(table(s, d, "orders"), 8)


@query("""SELECT DISTINCT o_orderkey AS "user", o_custkey AS item FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 3""")
def filtered_pairs(s, d):
    items = table(s, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("string").alias("state"))
    return relational.filtered_pairs(table(s, d, "orders").select(F.col("o_orderkey").alias("user"), F.col("o_custkey").alias("item")), items, "3")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def anti_sample(s, d):
    seen = table(s, d, "orders").where(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("c_custkey"))
    return relational.never_seen(table(s, d, "customer").select("c_custkey"), seen, "c_custkey")


# --- frequent itemsets ---


def visits(s, d):
    return table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


VISITS = "p AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query(f"WITH {VISITS} SELECT user_id AS basket, string_agg(k, ',' ORDER BY k) AS items FROM p WHERE k IS NOT NULL GROUP BY 1")
def baskets_case1(s, d):
    return itemsets.baskets(visits(s, d).select(F.col("user_id").alias("basket"), F.col("k").alias("item"))).select("basket", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query(f"WITH {VISITS} SELECT k AS basket, string_agg(user_id, ',' ORDER BY user_id) AS items FROM p GROUP BY 1 HAVING count(*) > 2")
def baskets_case2(s, d):
    return itemsets.baskets(visits(s, d).select(F.col("k").alias("basket"), F.col("user_id").alias("item")), 2).select("basket", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


def brand_pairs(s, d):
    parts = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return table(s, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), "item")


def support_of(pairs):
    return math.ceil(0.005 * pairs.select("basket").distinct().count())


def itemset_sql(more: str = "") -> str:
    return f"""WITH a AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT ceil(0.005 * count(DISTINCT b)) AS s FROM a), x AS (SELECT * FROM a {more}),
u AS (SELECT i AS itemset, 1 AS size, count(*) AS support FROM x GROUP BY 1
UNION ALL SELECT x.i || ',' || y.i, 2, count(*) FROM x JOIN x y ON x.b = y.b AND x.i < y.i GROUP BY 1
UNION ALL SELECT x.i || ',' || y.i || ',' || z.i, 3, count(*) FROM x JOIN x y ON x.b = y.b AND x.i < y.i JOIN x z ON x.b = z.b AND y.i < z.i GROUP BY 1
UNION ALL SELECT x.i || ',' || y.i || ',' || z.i || ',' || w.i, 4, count(*) FROM x JOIN x y ON x.b = y.b AND x.i < y.i JOIN x z ON x.b = z.b AND y.i < z.i JOIN x w ON x.b = w.b AND z.i < w.i GROUP BY 1)
SELECT itemset, size, support FROM u, t WHERE support >= s"""


def flat(df):
    return df.select(F.concat_ws(",", "itemset").alias("itemset"), "size", "support")


@query(itemset_sql())
def frequent_itemsets(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.frequent_itemsets(pairs, support_of(pairs)))


@query(itemset_sql("WHERE b IN (SELECT b FROM a GROUP BY b HAVING count(*) > 4)"))
def frequent_itemsets_filtered(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.frequent_itemsets(pairs, support_of(pairs), min_size=4))


@query(itemset_sql())
def frequent_fpgrowth(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.fpgrowth_itemsets(pairs, support_of(pairs)))


@query(itemset_sql())
def frequent_son(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.son_itemsets(pairs, support_of(pairs)))


@query(itemset_sql() + " AND size = 1")
def frequent_1(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.frequent_itemsets(pairs, support_of(pairs), max_len=1))


@query(itemset_sql() + " AND size = 2")
def frequent_2(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.frequent_itemsets(pairs, support_of(pairs), max_len=2)).where("size = 2")


@query(itemset_sql() + " AND size = 3")
def frequent_3(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.frequent_itemsets(pairs, support_of(pairs), max_len=3)).where("size = 3")


@query(itemset_sql())
def frequent_vertical(s, d):
    pairs = brand_pairs(s, d)
    return flat(itemsets.vertical_itemsets(pairs, support_of(pairs)))


@query(f"""SELECT 2 AS part, 'Frequent Itemsets:' AS block, size, string_agg('(' || chr(39) || replace(itemset, ',', chr(39) || ', ' || chr(39)) || chr(39) || ')', ',' ORDER BY itemset) AS value FROM ({itemset_sql()}) GROUP BY size""")
def itemset_report(s, d):
    """The report's frequent block; the candidates before it depend on the chunks (son_report has both)."""
    pairs = brand_pairs(s, d)
    found = itemsets.frequent_itemsets(pairs, support_of(pairs))
    return io.itemset_report(found.limit(0), found)


@query()
def son_report(s, d):
    pairs = store(brand_pairs(s, d), "pairs")
    least = support_of(pairs)
    candidates = store(itemsets.son_candidates(store(itemsets.baskets(pairs), "baskets"), least), "candidates")
    return io.itemset_report(candidates.withColumn("size", F.size("itemset")), itemsets.son_itemsets(pairs, least, candidates=candidates))


@query()
def son_candidates(s, d):
    pairs = brand_pairs(s, d)
    return itemsets.son_candidates(itemsets.baskets(pairs), support_of(pairs)).select(F.concat_ws(",", "itemset").alias("itemset"))


# --- similarity ---

#: As in the reference: 550 bands of 2.
HASHES = 1100
SETS = "n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS x FROM (SELECT DISTINCT o_custkey AS c FROM orders)), s AS (SELECT DISTINCT l_partkey AS id, x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN n ON c = o_custkey), m AS (SELECT count(*) AS m FROM n)"
SIGS = f"{SETS}, h AS (SELECT i, 1 + (i * 7919 + 17) % 10007 AS a, (i * 104729 + 31) % 10009 AS b FROM range({HASHES}) r(i)), g AS (SELECT id, i, min((a * x + b) % m) AS h FROM s, h, m GROUP BY 1, 2)"
BANDS = f"{SIGS}, k AS (SELECT id, i // 2 AS band, string_agg(h, '-' ORDER BY i) AS key FROM g GROUP BY 1, 2), c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"


def part_sets(s, d):
    """(id, x), a row per sale, and the number of x."""
    orders = table(s, d, "orders")
    users = store(similarity.numbered(orders.select(F.col("o_custkey").alias("c")), "c"), "users")
    by_order = orders.join(users, F.col("o_custkey") == F.col("c")).select("o_orderkey", "x")
    return table(s, d, "lineitem").join(by_order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("id"), "x"), users.count()


@query(f"WITH {SIGS} SELECT id, i, h FROM g")
def minhash_signatures(s, d):
    sets, m = part_sets(s, d)
    return similarity.signatures(sets, HASHES, m)


@query(f"WITH {BANDS} SELECT id, band, key FROM k")
def lsh_bands(s, d):
    sets, m = part_sets(s, d)
    return similarity.bands(sets, HASHES, m)


@query(f"WITH {BANDS} SELECT a, b FROM c")
def lsh_candidates(s, d):
    sets, m = part_sets(s, d)
    return similarity.band_pairs(sets, HASHES, m)


@query(f"""WITH {BANDS}, z AS (SELECT id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a, b, count(*) AS common FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b AND y.x = x.x GROUP BY 1, 2)
SELECT a, b, round(common / (p.n + q.n - common), 9) AS sim FROM o JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE common / (p.n + q.n - common) >= 0.05""")
def lsh_jaccard(s, d):
    sets, m = part_sets(s, d)
    return similarity.similar_pairs(sets, m, HASHES).withColumn("sim", F.round("sim", 9))


@query(f"""WITH {SETS}, z AS (SELECT id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.x = y.x AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(common / (p.n + q.n - common), 9) AS sim FROM o JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE common / (p.n + q.n - common) >= 0.05""")
def jaccard_pairs_exact(s, d):
    sets, _ = part_sets(s, d)
    return similarity.exact_pairs(sets, 0.05).withColumn("sim", F.round("sim", 9))


# --- recommendation ---

TF = f"""w AS (SELECT source AS id, lower(unnest(regexp_split_to_array(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '))) AS term FROM documents WHERE text IS NOT NULL),
n AS (SELECT id, term, count(*) AS n FROM w WHERE term <> '' AND term NOT IN ({STOP_SQL}) GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY id) AS every FROM n),
tf AS (SELECT id, term, n, n / max(n) OVER (PARTITION BY id) AS tf FROM k WHERE n >= 1e-6 * every)"""
IDF = f"{TF}, f AS (SELECT term, count(*) AS df, log2((SELECT count(DISTINCT id) FROM tf) / count(*)) AS idf FROM tf GROUP BY 1)"
PROFILE = f"{IDF}, b AS (SELECT id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM (SELECT id, term, round(tf * idf, 9) AS score FROM tf JOIN f USING (term))) WHERE rank <= 200)"
USERS = f'{PROFILE}, up AS (SELECT "user", term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, term) AS rank FROM (SELECT lang AS "user", term, count(*) AS n FROM documents JOIN b ON source = id GROUP BY 1, 2)) WHERE rank <= 400)'


def source_tf(s, d):
    return store(recommend.term_frequency(table(s, d, "documents").select(F.col("source").alias("id"), "text"), STOP), "tf")


def lang_reviews(s, d):
    return table(s, d, "documents").select(F.col("lang").alias("user"), F.col("source").alias("id"))


@query(f"WITH {TF} SELECT id, term, n, round(tf, 9) AS tf FROM tf")
def tf(s, d):
    return source_tf(s, d).withColumn("tf", F.round("tf", 9))


@query(f"WITH {IDF} SELECT term, df, round(idf, 9) AS idf FROM f")
def idf(s, d):
    return recommend.inverse_frequency(source_tf(s, d)).withColumn("idf", F.round("idf", 9))


@query(f"WITH {PROFILE} SELECT id, term, round(score, 6) AS score FROM b")
def tfidf_top200(s, d):
    return recommend.profiles(source_tf(s, d)).select("id", "term", F.round("score", 6).alias("score"))


@query(f'WITH {USERS} SELECT "user", term, n FROM up')
def user_profile(s, d):
    return recommend.user_profiles(lang_reviews(s, d), recommend.profiles(source_tf(s, d))).select("user", "term", "n")


@query(f"""WITH {USERS}, q AS (SELECT u."user", b.id, count(*) AS c FROM (SELECT DISTINCT "user" FROM up) v JOIN up u USING ("user") JOIN b ON b.term = u.term GROUP BY 1, 2)
SELECT q."user", q.id, round(c / sqrt((SELECT count(*) FROM up WHERE up."user" = q."user") * (SELECT count(*) FROM b WHERE b.id = q.id)), 9) AS sim FROM q
WHERE c / sqrt((SELECT count(*) FROM up WHERE up."user" = q."user") * (SELECT count(*) FROM b WHERE b.id = q.id)) >= 0.01""")
def content_predict(s, d):
    items = store(recommend.profiles(source_tf(s, d)), "items")
    users = store(recommend.user_profiles(lang_reviews(s, d), items), "users")
    return recommend.content_predict(users, items).withColumn("sim", F.round("sim", 9))


RATINGS = 'r AS (SELECT o_custkey AS "user", l_partkey AS item, arg_max(l_quantity, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)'
PEARSON = """pe AS (SELECT a, b, (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) AS sim FROM
(SELECT p.k AS a, q.k AS b, count(*) AS n, sum(p.stars) AS x, sum(q.stars) AS y, sum(p.stars * q.stars) AS xy, sum(p.stars * p.stars) AS xx, sum(q.stars * q.stars) AS yy
FROM kr p JOIN kr q ON p.o = q.o AND p.k < q.k {join} GROUP BY 1, 2) WHERE n >= 3 AND xy - x * y / n > 1e-9 AND xx - x * x / n > 1e-9 AND yy - y * y / n > 1e-9)"""
ITEMS = f"{RATINGS}, kr AS (SELECT item AS k, \"user\" AS o, stars FROM r), {PEARSON.format(join='')}"
#: User candidates: bands of MinHash over the parts they bought.
USER_HASHES = 24
USER_SETS = RATINGS + ', n AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS x FROM (SELECT DISTINCT item FROM r)), s AS (SELECT "user" AS id, x FROM r JOIN n USING (item) WHERE "user" IN (SELECT "user" FROM r GROUP BY 1 HAVING count(*) >= 3)), m AS (SELECT count(*) AS m FROM n)'
USER_BANDS = f"""{USER_SETS}, h AS (SELECT i, 1 + (i * 7919 + 17) % 10007 AS a, (i * 104729 + 31) % 10009 AS b FROM range({USER_HASHES}) t(i)), g AS (SELECT id, i, min((a * x + b) % m) AS h FROM s, h, m GROUP BY 1, 2),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM g x JOIN g y ON x.i = y.i AND x.h = y.h AND x.id < y.id)"""
USER_MODEL = f"{USER_BANDS}, kr AS (SELECT \"user\" AS k, item AS o, stars FROM r), {PEARSON.format(join='JOIN c ON c.a = p.k AND c.b = q.k')}"


def ratings(s, d):
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    lines = table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    last = F.max_by("l_quantity", F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity"))
    return store(lines.groupBy("user", F.col("l_partkey").alias("item")).agg(last.alias("stars")), "ratings")


def item_model(r):
    return recommend.pearson(r.select(F.col("item").alias("k"), F.col("user").alias("other"), "stars"))


def user_model(r):
    often = r.groupBy("user").agg(F.count("*").alias("c")).where("c >= 3").select("user")
    numbers = store(similarity.numbered(r, "item"), "numbers")
    sets = r.join(often, "user", "left_semi").join(numbers, "item").select(F.col("user").alias("id"), "x")
    near = store(recommend.pearson(r.select(F.col("user").alias("k"), F.col("item").alias("other"), "stars")), "near")
    return similarity.share_band(near, sets, USER_HASHES, numbers.count(), 1)


@query(f"WITH {ITEMS} SELECT a, b, round(sim, 6) AS sim FROM pe")
def pearson_items(s, d):
    return item_model(ratings(s, d)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {USER_MODEL} SELECT a, b, round(sim, 6) AS sim FROM pe")
def pearson_users(s, d):
    return user_model(ratings(s, d)).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {ITEMS} SELECT k, string_agg(o || ':' || CAST(round(round(sim, 9), 6) AS DECIMAL(9, 6)), ',' ORDER BY round(sim, 9) DESC, o) AS neighbours
FROM (SELECT a AS k, b AS o, sim FROM pe UNION ALL SELECT b, a, sim FROM pe) GROUP BY 1""")
def model_symmetrise_full_outer(s, d):
    both = recommend.symmetric_full_outer(store(item_model(ratings(s, d)).withColumn("sim", F.round("sim", 9)), "model"))
    one = lambda x: F.concat_ws(":", x["o"], F.round(-x["s"], 6).cast("decimal(9,6)"))
    return both.select("k", F.array_join(F.transform("neighbours", one), ",").alias("neighbours"))


PREDICT = """nb AS (SELECT a AS k, b AS o, round(sim, 9) AS sim FROM pe UNION ALL SELECT b, a, round(sim, 9) FROM pe), ok AS (SELECT k FROM nb GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT *, row_number() OVER (PARTITION BY qu, qi ORDER BY sim DESC, o) AS rk FROM ({hits}))"""


@query(f"""WITH {ITEMS}, {PREDICT.format(hits='SELECT q."user" AS qu, q.item AS qi, nb.o, nb.sim, r.stars AS v FROM r q JOIN nb ON nb.k = q.item JOIN r ON r.item = nb.o AND r."user" = q."user" WHERE nb.k IN (SELECT k FROM ok)')}
SELECT qu AS "user", qi AS item, round(sum(v * sim) / sum(abs(sim)), 6) AS stars FROM hit WHERE rk <= 3 GROUP BY 1, 2 HAVING count(*) > 1""")
def predict_items(s, d):
    r = ratings(s, d)
    return recommend.predict_items(r, store(item_model(r).withColumn("sim", F.round("sim", 9)), "model"), r).withColumn("stars", F.round("stars", 6))


@query(f"""WITH {USER_MODEL}, av AS (SELECT "user", sum(stars) AS t, count(*) AS c FROM r GROUP BY 1), {PREDICT.format(hits='SELECT q."user" AS qu, q.item AS qi, nb.o, nb.sim, r.stars - (av.t - r.stars) / (av.c - 1) AS v FROM r q JOIN nb ON nb.k = q."user" JOIN r ON r."user" = nb.o AND r.item = q.item JOIN av ON av."user" = nb.o WHERE av.c > 1 AND nb.k IN (SELECT k FROM ok)')}
SELECT qu AS "user", qi AS item, round(any_value(av.t / av.c) + sum(v * sim) / sum(abs(sim)), 6) AS stars FROM hit JOIN av ON av."user" = qu WHERE rk <= 3 GROUP BY 1, 2 HAVING count(*) > 1 AND abs(sum(v * sim)) > 1e-9""")
def predict_users(s, d):
    r = ratings(s, d)
    return recommend.predict_users(r, store(user_model(r).withColumn("sim", F.round("sim", 9)), "model"), r).withColumn("stars", F.round("stars", 6))


# --- graphs ---

THRESHOLD = 36
EDGES = f"{VISITS}, e AS (SELECT x.user_id AS a, y.user_id AS b FROM p x JOIN p y ON x.k = y.k AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= {THRESHOLD}), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"
COMPONENTS = f"{EDGES}, t(node, seen) AS (SELECT DISTINCT a, a FROM g UNION SELECT t.node, g.b FROM t JOIN g ON g.a = t.seen), comp AS (SELECT node, min(seen) AS label FROM t GROUP BY 1)"


def users_by_key(s, d):
    return visits(s, d).select(F.col("user_id").alias("node"), F.col("k").alias("item"))


def edges_of(s, d):
    return store(graph.co_graph(users_by_key(s, d), THRESHOLD), "graph")


def twins_of(s, d):
    """The same graph with users of equal keys as one class."""
    return graph.twins(users_by_key(s, d), THRESHOLD)


@query(f"WITH {EDGES} SELECT a, b FROM e")
def co_graph(s, d):
    return edges_of(s, d)


@query(f"WITH {EDGES} SELECT DISTINCT a AS node FROM g")
def vertices(s, d):
    return twins_of(s, d).members.select("node")


@query(f"WITH {EDGES} SELECT a AS node, count(*) AS degree FROM g GROUP BY 1")
def degrees(s, d):
    t = twins_of(s, d)
    return t.members.join(graph.twin_degrees(t), "c").select("node", "degree")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, label FROM comp")
def components(s, d):
    t = twins_of(s, d)
    return t.members.join(graph.twin_components(t), "c").select("node", "label")


def lpa_sql() -> str:
    steps = ["l0 AS (SELECT DISTINCT a AS node, a AS label FROM g)"]
    for i in range(1, 6):
        steps.append(f"l{i} AS (SELECT a AS node, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS r FROM g JOIN l{i - 1} ON node = b GROUP BY a, label) WHERE r = 1)")
    return f"WITH {EDGES}, {', '.join(steps)}"


@query(f"{lpa_sql()} SELECT node, label FROM l5")
def lpa_5(s, d):
    return graph.twin_label_propagation(twins_of(s, d))


@query(f"{lpa_sql()} SELECT count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM l5 GROUP BY label")
def lpa_communities(s, d):
    return graph.communities(graph.twin_label_propagation(twins_of(s, d))).select(F.col("size").cast("long").alias("size"), F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@query(f"{lpa_sql()} SELECT string_agg(chr(39) || node || chr(39), ', ' ORDER BY node) AS value FROM l5 GROUP BY label")
def community_report(s, d):
    return community_lines(graph.communities(graph.twin_label_propagation(twins_of(s, d))))


PATHS = f"""WITH RECURSIVE {EDGES}, bfs(root, node, lvl) AS (SELECT DISTINCT a, a, 0 FROM g UNION SELECT root, b, lvl + 1 FROM bfs JOIN g ON a = node WHERE lvl < 60),
lv AS (SELECT root, node, min(lvl) AS lvl FROM bfs GROUP BY 1, 2),
dag AS (SELECT x.root, x.node AS u, y.node AS v, x.lvl FROM lv x JOIN g ON g.a = x.node JOIN lv y ON y.root = x.root AND y.node = g.b AND y.lvl = x.lvl + 1),
pth(root, start, node, n) AS (SELECT root, root, root, 1 FROM lv WHERE lvl = 0 UNION ALL SELECT pth.root, pth.start, dag.v, n + 1 FROM pth JOIN dag ON dag.root = pth.root AND dag.u = pth.node)"""
#: An edge's share of the shortest paths between s and t, summed over all pairs.
BETWEENNESS = f"""{PATHS}, sg AS (SELECT root, node, n - 1 AS lvl, count(*) AS k FROM pth GROUP BY 1, 2, 3),
bt AS (SELECT least(g.a, g.b) AS a, greatest(g.a, g.b) AS b, round(sum(x.k * y.k / z.k) / 2, 6) AS betweenness FROM g JOIN sg x ON x.node = g.a JOIN sg y ON y.root = g.b
JOIN sg z ON z.root = x.root AND z.node = y.node AND z.lvl = x.lvl + y.lvl + 1 GROUP BY 1, 2)"""


@query(f"{PATHS} SELECT count(*) AS n_paths FROM pth")
def shortest_path_count(s, d):
    """Shortest paths (empty ones included) between all nodes, as the betweenness counts them."""
    total = graph.twin_path_count(twins_of(s, d))
    return s.createDataFrame([(str(total),)], "n string").select(F.col("n").cast("long" if total < 2**63 else "decimal(38,0)").alias("n_paths"))


@query(f"{BETWEENNESS} SELECT a, b, betweenness FROM bt")
def edge_betweenness(s, d):
    t = twins_of(s, d)
    return graph.expand(t, graph.twin_betweenness(t).withColumn("betweenness", F.round("betweenness", 6)))


@query(f"{BETWEENNESS} SELECT format('(''{{}}'', ''{{}}''), {{}}', a, b, betweenness) AS value FROM bt")
def betweenness_report(s, d):
    return betweenness_lines(edge_betweenness(s, d))


@query(f"{BETWEENNESS} SELECT a, b, betweenness FROM bt")
def edge_betweenness_joins(s, d):
    t = twins_of(s, d)
    return graph.expand(t, graph.twin_betweenness(t, 0).withColumn("betweenness", F.round("betweenness", 6)))


@query(f"{BETWEENNESS} SELECT a, b, betweenness FROM bt ORDER BY betweenness DESC, a, b LIMIT 1")
def top_edge(s, d):
    """The edge that Girvan-Newman removes first."""
    return edge_betweenness(s, d).orderBy(F.desc("betweenness"), "a", "b").limit(1)


@query(f"""WITH RECURSIVE {COMPONENTS}, k AS (SELECT a AS node, count(*) AS d FROM g GROUP BY 1), per AS (SELECT label, sum(d) AS s, sum(d * d) AS ss FROM k JOIN comp USING (node) GROUP BY 1),
i AS (SELECT x.label, count(*) AS e FROM e JOIN comp x ON x.node = a JOIN comp y ON y.node = b AND x.label = y.label GROUP BY 1), m AS (SELECT 2.0 * count(*) AS m2 FROM e)
SELECT round(sum((2 * coalesce(e, 0) - (s * s - ss) / m2) / m2), 9) AS q FROM per LEFT JOIN i USING (label), m""")
def modularity(s, d):
    t = twins_of(s, d)
    return graph.twin_modularity(t, store(graph.twin_components(t), "labels")).select(F.round("q", 9).alias("q"))


@query()
def girvan_newman(s, d):
    """Communities of the whole co-purchase graph: steps follow on each other, so the method is for small graphs."""
    return graph.girvan_newman(edges_of(s, d))


# --- clustering ---

POINTS = "pt AS (SELECT vec_id AS id, label AS c, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), st AS (SELECT c, j, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM pt GROUP BY 1, 2)"


def points(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("c"))


@query(f"""WITH {POINTS}, di AS (SELECT pt.id, st.c, sqrt(sum((x - s / n) * (x - s / n))) AS dist FROM pt JOIN st USING (j) GROUP BY 1, 2)
SELECT id, arg_min(c, dist) AS c, round(min(dist), 6) AS dist FROM di GROUP BY 1""")
def nearest_centroid(s, d):
    p = points(s, d)
    centres = cluster.vectors(cluster.statistics(p)).select("c", F.col("centre").alias("w"))
    return cluster.nearest(p.select("id", "v"), centres).withColumn("dist", F.round("dist", 6))


@query(f"WITH {POINTS} SELECT c, j, n, round(s, 5) AS s, round(ss, 5) AS ss, round(sqrt(greatest(1e-10, ss / n - (s / n) * (s / n))), 6) AS sd FROM st")
def cluster_stats(s, d):
    sd = F.sqrt(F.greatest(F.lit(1e-10), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
    return cluster.statistics(points(s, d)).select("c", "j", "n", F.round("s", 5).alias("s"), F.round("ss", 5).alias("ss"), F.round(sd, 6).alias("sd"))


@query(f"""WITH {POINTS}, di AS (SELECT pt.id, st.c, sqrt(sum((x - s / n) * (x - s / n) / greatest(1e-10, ss / n - (s / n) * (s / n)))) AS dist FROM pt JOIN st USING (j) WHERE n > 1 GROUP BY 1, 2)
SELECT e.vec_id AS id, coalesce(m.c, -1) AS c FROM embeddings e LEFT JOIN (SELECT id, arg_min(c, dist) AS c FROM di WHERE dist < 16 GROUP BY 1) m ON m.id = e.vec_id""")
def mahalanobis_assign(s, d):
    p = points(s, d)
    return cluster.mahalanobis(p.select("id", "v"), cluster.vectors(cluster.statistics(p)), 16.0)


@query()
def maximin_seeds(s, d):
    return s.createDataFrame(list(enumerate(cluster.maximin(points(s, d), 10))), "c int, v array<double>")


@query()
def kmeans(s, d):
    return cluster.kmeans(points(s, d).select("id", "v"), 10).select("id", "c")


def bfr(s, d, sequential: bool = False):
    """A round for each of five files of vectors, in the order of their names."""
    folder = vector_files(s, d)
    b = cluster.Bfr(5, sequential)
    for path in io.parts(s, folder):
        b.round(io.vector_chunks(s, path, 2).select("id", "v"))
    return b


def rounds(s, b):
    return s.createDataFrame(b.report, "round_id int, nof_cluster_discard int, nof_point_discard int, nof_cluster_compression int, nof_point_compression int, nof_point_retained int")


@query()
def bfr_assign(s, d):
    return bfr(s, d).result()


@query()
def bfr_rounds(s, d):
    return rounds(s, bfr(s, d))


@query()
def bfr_sequential(s, d):
    return bfr(s, d, True).result()


@query()
def bfr_sequential_rounds(s, d):
    return rounds(s, bfr(s, d, True))


# --- sketches ---

BLOOM = """tr AS (SELECT DISTINCT c_name AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name <> ''), m AS (SELECT 50 * count(*) AS m FROM tr)"""
TEXT_MOD = "list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)), lambda a, d: (a * 256 + d) % m, CAST(0 AS BIGINT))"
BITS = f"{BLOOM}, tx AS (SELECT k, m, {TEXT_MOD} AS x FROM tr, m), bits AS (SELECT DISTINCT ((i * 7919 + 17) * x + i * 104729 + 31) % m AS pos FROM tx, range(5) r(i))"


def bloom(s, d):
    """Two segments' names are put in; all customers' names are asked for."""
    customers = table(s, d, "customer")
    return customers, *sketch.bloom_build(customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), "c_name")


@query(f"WITH {BITS} SELECT pos FROM bits")
def bloom_build(s, d):
    return bloom(s, d)[1]


@query(f"""WITH {BITS}, pr AS (SELECT DISTINCT c_name AS k FROM customer), px AS (SELECT k, m, {TEXT_MOD} AS x FROM pr, m),
pp AS (SELECT k, ((i * 7919 + 17) * x + i * 104729 + 31) % m AS pos FROM px, range(5) r(i))
SELECT k, CAST(min(CASE WHEN bits.pos IS NULL THEN 0 ELSE 1 END) AS INT) AS hit FROM pp LEFT JOIN bits USING (pos) GROUP BY 1""")
def bloom_probe(s, d):
    customers, bits, m = bloom(s, d)
    return sketch.bloom_probe(customers, "c_name", bits, m)


PROBE = f"""WITH {BITS}, pr AS (SELECT c_custkey, coalesce(c_name, '') AS k FROM customer), px AS (SELECT c_custkey, k, m, {TEXT_MOD} AS x FROM pr, m),
pp AS (SELECT c_custkey, k, ((i * 7919 + 17) * x + i * 104729 + 31) % m AS pos FROM px, range(5) r(i)),
ph AS (SELECT c_custkey AS "order", CAST(min(CASE WHEN bits.pos IS NULL THEN 0 ELSE 1 END) AS INT) AS hit FROM pp LEFT JOIN bits USING (pos) GROUP BY 1)"""


@query(f'{PROBE} SELECT "order", hit FROM ph')
def bloom_probe_rows(s, d):
    customers, bits, m = bloom(s, d)
    return sketch.bloom_probe_rows(customers, "c_custkey", "c_name", bits, m)


@query(f"""{PROBE} SELECT string_agg(hit, ' ' ORDER BY "order") AS value FROM ph""")
def bloom_vector(s, d):
    """All answers in one line, in the order of the rows."""
    return io.bit_vector_line(bloom_probe_rows(s, d), "order", "hit")


#: Windows of a day that begin every eight hours.
SLIDING = "SELECT strftime(to_timestamp(8 * 3600 * (CAST(floor(epoch(ts) / (8 * 3600)) AS BIGINT) - w)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, CAST(user_id AS VARCHAR) AS k FROM events, range(3) o(w)"


def fm_sql(rows: str, named: bool = True) -> str:
    return f"""WITH rows AS ({rows}), n AS (SELECT start, CAST(pow(2, floor(log2(count(*)))) AS BIGINT) AS m FROM rows GROUP BY 1),
ks AS (SELECT DISTINCT start, k FROM rows), sm AS (SELECT start, m, list_sum(list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1)))) AS s, list_sum(list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1)) * (j - 1))) AS w FROM ks JOIN n USING (start)),
h AS (SELECT start, i, CAST((s * i + w) % m AS BIGINT) AS h FROM sm, range(100) r(i)), r AS (SELECT start, i, CASE WHEN h = 0 THEN 1 ELSE bit_count((h & -h) - 1) END AS r FROM h),
e AS (SELECT start, i, pow(2, max(r) - min(r)) AS e FROM r GROUP BY 1, 2), t AS (SELECT start, CAST(ceil((sum(e) - min(e) - max(e)) / (count(*) - 2)) AS BIGINT) AS estimate FROM e GROUP BY 1),
c AS (SELECT start, count(*) AS truth FROM ks GROUP BY 1) SELECT {'CAST(start AS VARCHAR) AS start, ' if named else ''}truth, estimate, round(1 - abs(truth - estimate) / truth, 6) AS accuracy FROM c JOIN t USING (start)"""


def city_rows(s, d):
    return table(s, d, "events").select(F.to_date("ts").cast("string").alias("start"), F.col("user_id").cast("string").alias("k"))


@query(fm_sql("SELECT CAST(ts AS DATE) AS start, CAST(user_id AS VARCHAR) AS k FROM events"))
def fm_window(s, d):
    return sketch.fm_estimate(city_rows(s, d), ["start"], "k").withColumn("accuracy", F.round("accuracy", 6))


@query(fm_sql(SLIDING))
def fm_sliding(s, d):
    rows = table(s, d, "events").select(F.window(F.col("ts").cast("timestamp"), "1 day", "8 hours").alias("w"), F.col("user_id").cast("string").alias("k"))
    return sketch.fm_estimate(rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "k"), ["start"], "k").withColumn("accuracy", F.round("accuracy", 6))


@query(fm_sql("SELECT 1 AS start, CAST(user_id AS VARCHAR) AS k FROM events", False))
def fm_global(s, d):
    return sketch.fm_estimate(city_rows(s, d), [], "k").withColumn("accuracy", F.round("accuracy", 6))


@query()
def approx_distinct(s, d):
    """The built-in sketch, to compare with fm_window."""
    return city_rows(s, d).groupBy("start").agg(F.approx_count_distinct("k", 0.02).alias("estimate"), F.count_distinct("k").alias("truth"))


@query("""WITH s AS (SELECT event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 100), c AS (SELECT event_type AS tag, count(*) AS n FROM s GROUP BY 1)
SELECT tag, n FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 3""")
def reservoir_top_tags(s, d):
    return sketch.top_tags(sketch.reservoir(table(s, d, "events").select("event_id", "event_type"), "event_id"), "event_type")


def city_stream(s, d):
    """The events as a stream of JSON lines (ts, key), closed by a line far ahead, which lets the watermark pass the last window."""
    folder = new_path(s, "feed")
    events = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("city"))
    io.write_json_lines(events, f"{folder}/part=0")
    io.write_json_lines(events.agg((F.max("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit("end").alias("city")), f"{folder}/part=1")
    return s.readStream.schema("ts timestamp, city string, part int").json(folder).select("ts", F.coalesce("city", F.lit("")).alias("key"))


@query(fm_sql(SLIDING))
def stream_fm(s, d):
    """fm_sliding() from a stream that is waited for until its end, every closed window appended to CSV files by batch."""
    from siltstone.streaming.sketches import watch, write_estimates

    out = new_path(s, "estimates")
    shown = io.csv_sink(out)
    sink = lambda df, batch: shown(df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), batch)
    watch(write_estimates(city_stream(s, d), sink, "1 day", "8 hours", "900 days", trigger={"availableNow": True}, checkpointLocation=new_path(s, "cp")))
    return io.csv_pairs(s, f"{out}/*", "start string, truth long, estimate long, accuracy double").withColumn("accuracy", F.round("accuracy", 6))


def tag_stream(s, d):
    """The events as tagged messages in JSON files, numbered by event_id."""
    folder = new_path(s, "messages")
    tags = F.array(F.struct(F.col("event_type").alias("text")))
    rows = table(s, d, "events").select("event_id", F.struct(tags.alias("hashtags")).alias("entities"), F.lit("en").alias("lang"), F.concat(F.lit("about "), "event_type").alias("text"))
    io.write_json_lines(rows, folder)
    return folder


def top_tags_to(s, d, sink, track=None, each=False):
    """Waits until the whole stream has been read: a query stopped before that would return a part."""
    from siltstone.streaming.sketches import watch, write_top_tags

    feed = io.tagged_stream(s, tag_stream(s, d), track=track, languages=["en"], order="event_id")
    watch(write_top_tags(feed, sink, new_path(s, "sample"), "event_id", each=each, trigger={"availableNow": True}, checkpointLocation=new_path(s, "cp")))


@query()
def stream_top_tags(s, d):
    out = new_path(s, "tags")
    top_tags_to(s, d, lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    return s.read.schema("n long, tag string, count long").parquet(f"{out}/*")


@query("SELECT count(*) AS n_blocks FROM events WHERE event_type = 'purchase'")
def stream_tag_log(s, d):
    """A log block after every message that a filter lets through; their number."""
    out = new_path(s, "log")
    top_tags_to(s, d, io.log_sink(out), "purchase", True)
    return s.read.text(f"{out}/*").where("value like 'The number of%'").agg(F.count("*").alias("n_blocks"))


# --- sources and sinks: written below the shared folder and read back ---


@query("SELECT doc_id, text, lang FROM documents")
def source_json_lines(s, d):
    path = new_path(s, "json")
    io.write_json_lines(table(s, d, "documents").select("doc_id", "text", "lang"), path)
    return io.json_lines(s, path, "doc_id long, text string, lang string")


@query("SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS business_id FROM orders")
def source_csv_pairs(s, d):
    path = new_path(s, "csv")
    io.write_csv(table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").cast("string").alias("business_id")), path)
    return io.csv_pairs(s, path)


def vector_files(s, d):
    """The embeddings as five files of lines id,x1,..., whose names tell their order."""
    folder = new_path(s, "vectors")
    lines = F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), ","))
    points(s, d).select(lines.alias("value"), (F.col("id") % 5).alias("chunk")).repartition("chunk").write.partitionBy("chunk").text(folder)
    return folder


@query("SELECT vec_id AS id, 'chunk=' || vec_id % 5 AS chunk, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def source_vectors(s, d):
    rows = io.vector_chunks(s, vector_files(s, d), 2)
    return rows.select("id", "chunk", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(ORACLES["top_words"])
def source_stop_words(s, d):
    """top_words() with the list read from a file."""
    path = new_path(s, "stop")
    io.write_lines(s.createDataFrame([(w,) for w in STOP], "value string"), path)
    return relational.top_words(table(s, d, "documents"), "text", io.stop_words(s, path), 50)


@query(f"""WITH {USERS} SELECT 'user' AS type, "user" AS name, string_agg(term, ',' ORDER BY term) AS profile FROM up GROUP BY 2
UNION ALL SELECT 'business', id, string_agg(term, ',' ORDER BY term) FROM b GROUP BY 2""")
def source_model(s, d):
    """The content model written as tagged JSON lines and read back by kind."""
    items = store(recommend.profiles(source_tf(s, d)), "items")
    users = recommend.user_profiles(lang_reviews(s, d), items)
    lists = lambda df, kind, name: df.groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_list("term")).alias("profile")).withColumn("type", F.lit(kind))
    path = new_path(s, "model")
    io.write_json_lines(lists(users, "user", "user").unionByName(lists(items, "business", "id")), path)
    both = io.model_by_type(s, path, "user").unionByName(io.model_by_type(s, path, "business"))
    return both.select("type", "name", F.array_join("profile", ",").alias("profile"))


@query("""SELECT (SELECT count(*) FROM orders) AS A, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1997) AS B, (SELECT count(DISTINCT o_custkey) FROM orders) AS C""")
def source_answers(s, d):
    """The exploration's numbers as one JSON object."""
    path = new_path(s, "answers") + "/answers.json"
    io.write_answers(s, {"A": review_count(s, d).first()[0], "B": year_count(s, d).first()[0], "C": distinct_users(s, d).first()[0]}, path)
    return io.read_answers(s, path, "A long, B long, C long")


@query(ORACLES["community_report"])
def sink_community_report(s, d):
    path = new_path(s, "report")
    io.write_lines(community_report(s, d), path)
    return s.read.text(path)
