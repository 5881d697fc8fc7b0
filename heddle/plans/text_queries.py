"""Queries over documents, pages, conversations, events and embeddings: packing, chunking, lookups, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier_offers, kept_identifiers
from ..operators import evaluate, graphs, literals, order, ranking, vectors
from ..streaming.windows import hourly
from .trade_graph import table

BUDGET, PACK_K = 8000, 12


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ranked candidates: a source is a question, a language a file, longer texts rank first."""
    docs = _documents(spark, sf_dir).select("source", "doc_id", F.col("lang").alias("path"), F.char_length("text").cast("long").alias("n"))
    return order.placed(docs, ["source"], [F.desc("n"), F.col("doc_id")], "rank")


def evidence_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_source(spark, sf_dir)
    return ranking.evidence_first(rows, _named(rows), ["source"]).select("source", "doc_id", "rank", "position")


def file_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.file_diversity(_by_source(spark, sf_dir), ["source"]).select("source", "doc_id", "rank", "position")


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_source(spark, sf_dir).withColumn("cost", F.floor(F.col("n") / 4))
    return ranking.budget_pack(rows, ["source"], "rank", "cost", PACK_K, BUDGET)


def _named(rows: DataFrame) -> DataFrame:
    """The two languages in which a source has its latest documents."""
    newest = rows.groupBy("source", "path").agg(F.max("doc_id").alias("newest"))
    return ranking.top(newest, ["source"], [F.desc("newest")], 2).select("source", "path", F.col("rank").alias("named_at"))


def first_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_source(spark, sf_dir)
    return evaluate.first_novel(rows, _named(rows), ["source"], "path")


def delivery_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing loses of each source's documents that are labelled good."""
    rows = _by_source(spark, sf_dir).withColumn("cost", F.floor(F.col("n") / 4))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    gold = rows.select("source", "doc_id").join(good, "doc_id").select("source", "doc_id")
    taken = ranking.budget_pack(rows, ["source"], "rank", "cost", PACK_K, BUDGET).select("source", "rank").join(rows.select("source", "rank", "doc_id"), ["source", "rank"])
    return evaluate.delivery_gap(rows.select("source", "doc_id", "rank"), taken, gold, ["source"], "doc_id", PACK_K)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.chunk_lines(_documents(spark, sf_dir), 5, key="doc_id")
    return out.select("doc_id", "start_line", "end_line", F.sha2("text", 256).alias("digest"))


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_appearance(_by_source(spark, sf_dir), ["source"], "path", "rank")


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("lang", "source", ranking.token_cost(F.col("text")).alias("cost"))
    return docs.rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("cost").alias("tokens"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.cosine_top_k(e, e.filter("vec_id % 100 = 0"), 20)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)


def _recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a vector's nearest against all others of its label: gold sets are counted, not listed."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = label.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    asked = label.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label").filter("n_gold > 0")
    near = _neighbours(spark, sf_dir).select("query_id", "vec_id", "rank").join(label.withColumnRenamed("label", "theirs"), "vec_id")
    return evaluate.recall_of_class(near, asked, ["query_id"], "label", "theirs")


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recalls(spark, sf_dir).select("query_id", "k", "recall", "any_hit")


def summarise_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarise(_recalls(spark, sf_dir), [])


def rollup_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rollup_recall(_recalls(spark, sf_dir), "label")


def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the first neighbour of the query's own label."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf_dir).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    first = near.filter("label = own").groupBy("query_id", "own").agg(F.min("rank").alias("first_rank"))
    return evaluate.index_percentiles(first, [], "first_rank")


def ambiguity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand and size: how many parts a name could mean, and what that makes of it."""
    names = table(spark, sf_dir, "part").groupBy("p_name", "p_brand", "p_size").agg(F.countDistinct("p_partkey").alias("candidates"))
    via, confidence = graphs.name_tiers(F.col("candidates"))
    return names.select("p_name", "p_brand", "p_size", "candidates", via.alias("via"), confidence.alias("confidence"))


def unique_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "part").select("p_name", "p_size", "p_partkey")
    return graphs.unique_owner(claims, ["p_name", "p_size"], "p_partkey")


def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguity_tiers(spark, sf_dir).groupBy("via").agg(F.count("*").alias("names"), F.sum("candidates").alias("candidates"))


_URL_PATH = r"^https?://([^/?#]+)([^?#]*)"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", _URL_PATH, 1), r"\.", -1)), ".")
    return pages.select("page_id", "url", host.alias("name"), F.regexp_replace(F.regexp_extract("url", _URL_PATH, 2), "^/", "").alias("path"))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' hosts, read from the right, against the prefixes that at least three pages share."""
    names = _page_paths(spark, sf_dir).select("page_id", "name")
    spread = names.select("page_id", F.explode(graphs.prefixes(F.split("name", r"\.", -1), ".")).alias("p")).select("page_id", "p.prefix")
    bindings = spread.groupBy("prefix").agg(F.countDistinct("page_id").alias("pages")).filter("pages >= 3")
    return graphs.longest_prefix(names, bindings, ["page_id"])


def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in pages against the paths of all pages."""
    links = table(spark, sf_dir, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1)))).alias("mention"))
    urls = _page_paths(spark, sf_dir).select("url").distinct().select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://", "").alias("mention"))
    known = _page_paths(spark, sf_dir).filter("path <> ''").select("path").distinct()
    return graphs.suffix_match(links.unionByName(urls).distinct(), known, [])


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.regexp_extract("url", _URL_PATH, 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))
    return links.groupBy("host", "href").agg(F.count("*").alias("n"))


def interval_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's innermost span: of its user's kinds of event, the shortest-lived that covers it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = events.groupBy("user_id", "event_type").agg(F.min("at").alias("span_start"), F.max("at").alias("span_end"))
    return graphs.innermost(events.select("user_id", "event_id", "at"), spans, ["user_id"], "event_id", "at", "event_type").select("user_id", "event_id", "inside")


def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_offer(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id")


def identifier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in conversations and documents with their heaviest weight, and how many texts offer them."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("text_id"), "text")
    docs = _documents(spark, sf_dir).select(F.concat_ws("-", F.lit("d"), "doc_id").alias("text_id"), "text")
    offers = identifier_offers(turns.unionByName(docs), "text_id", ascii_only=True)
    return offers.groupBy("name").agg(F.max("weight").alias("weight"), F.countDistinct("text_id").alias("texts"))


def stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items that may seed a search: long enough and not on the stop list."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("name"))
    return words.filter(kept_identifiers(F.col("name"))).groupBy("name").agg(F.countDistinct("item_id").alias("items"))


def literal_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts that some documents contain whole, but no more than eight."""
    files = _documents(spark, sf_dir).select(F.col("doc_id").alias("file"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("literal_id"), F.col("text").alias("literal"))
    return literals.selective(literals.contains(files, items))


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts' names as classes: a full name inherits its brand's noun, then its noun, and a noun its last letter."""
    part = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " ", -1), -1)
    cls = part.select("p_name", "p_brand", "p_size", noun.alias("noun"))
    full = F.concat_ws(" ", "p_brand", "p_name")
    middle = F.concat_ws(" ", "p_brand", "noun")
    bases = cls.select(full.alias("cls"), middle.alias("base"), F.lit(0).alias("ord")).union(cls.select(full, F.col("p_name"), F.lit(1))).union(cls.select(middle, F.col("noun"), F.lit(0))).union(cls.select("p_name", "noun", F.lit(0))).distinct()
    member = F.col("p_size").cast("string")
    owns = cls.groupBy(middle.alias("cls"), member.alias("member")).count().union(cls.groupBy(F.col("p_name").alias("cls"), member.alias("member")).count()).union(cls.groupBy(F.col("noun").alias("cls"), member.alias("member")).count())
    owns = owns.filter("count >= 2").select("cls", "member")
    asks = cls.select(full.alias("cls"), member.alias("member")).distinct()
    return bases, owns, asks


def fixpoint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, _, _ = _hierarchy(spark, sf_dir)
    return graphs.closure(bases.select(F.col("cls").alias("node"), F.col("base").alias("parent")).distinct())


def mro_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases, owns, asks = _hierarchy(spark, sf_dir)
    return graphs.first_owner_up(asks, bases, owns)


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events")).select("hour", "event_type", "events", "total")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads by kind: the share of a report that resolves, with k at least 50 as resolved."""
    events = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    report = events.select("event_type", F.lit(True).alias("submitted"), F.coalesce(F.col("p.k") >= 50, F.lit(False)).alias("resolved"))
    return evaluate.resolved_rate(report, ["event_type"])


_SOURCE = "r AS (SELECT source, doc_id, lang AS path, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents)"
_PACKED = f"""c AS (SELECT source, rank, n // 4 AS cost FROM r),
w AS (SELECT source, rank, cost, TRUE AS took, 1 AS picked, cost AS used FROM c WHERE rank = 1
  UNION ALL SELECT c.source, c.rank, c.cost, ok, w.picked + CAST(ok AS INTEGER), w.used + CASE WHEN ok THEN c.cost ELSE 0 END
  FROM w JOIN c ON c.source = w.source AND c.rank = w.rank + 1, LATERAL (SELECT w.picked < {PACK_K} AND w.used < {BUDGET} AND w.used + c.cost <= {BUDGET} AS ok))"""
_NEAR = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, floor(list_dot_product(a.v, b.v) / (a.n * b.n) * 1000000 + 0.500001) / 1000000 AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s QUALIFY rank <= 20)"""
_RECALL = (
    _NEAR
    + """, gold AS (SELECT a.vec_id AS query_id, a.label, b.vec_id FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
recalls AS (SELECT g.query_id, g.label, CAST(k AS INTEGER) AS k, floor(count(n.vec_id) / CAST(count(*) AS DOUBLE) * 1000000 + 0.500001) / 1000000 AS recall, count(n.vec_id) > 0 AS any_hit
  FROM gold g CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) LEFT JOIN near n ON n.query_id = g.query_id AND n.vec_id = g.vec_id AND n.rank <= k GROUP BY ALL)"""
)
_TIERS = """t AS (SELECT p_name, p_brand, p_size, count(DISTINCT p_partkey) AS candidates FROM part GROUP BY ALL),
tiers AS (SELECT *, CASE WHEN candidates = 1 THEN 'unique_name' WHEN candidates <= 3 THEN 'ambiguous' ELSE 'too_ambiguous' END AS via,
  CASE WHEN candidates = 1 THEN CAST(0.5 AS DOUBLE) WHEN candidates <= 3 THEN CAST(0.25 AS DOUBLE) END AS confidence FROM t)"""
_PAGES = r"""pg AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)([^?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)([^?#]*)', 2), '^/', '') AS path FROM pages)"""
_CLASSES = """cl AS (SELECT p_brand || ' ' || p_name AS f, p_brand || ' ' || split_part(p_name, ' ', -1) AS m, p_name AS p, split_part(p_name, ' ', -1) AS n, CAST(p_size AS VARCHAR) AS member FROM part),
bases AS (SELECT f AS cls, m AS base, 0 AS ord FROM cl UNION SELECT f, p, 1 FROM cl UNION SELECT m, n, 0 FROM cl UNION SELECT p, n, 0 FROM cl),
owns AS (SELECT m AS cls, member FROM cl GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT p, member FROM cl GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT n, member FROM cl GROUP BY ALL HAVING count(*) >= 2)"""

QUERIES = {
    f.__name__: f
    for f in (evidence_first, file_diversity, budget_pack, first_novel, delivery_gap, chunk_lines, first_files, token_costs, cosine_topk, recall_at_k, summarise_recall, rollup_recall, index_percentiles, ambiguity_tiers, unique_owner, resolution_counts, longest_prefix, suffix_match, link_graph, interval_locate, best_offer, identifier_weights, stop_filter, literal_selective, fixpoint_closure, mro_first_hit, hourly_windows, event_payloads)
}


def _stop_sql() -> str:
    from ..functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


_NAME = "[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*"
ORACLES = {
    "evidence_first": f"""WITH {_SOURCE}, named AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY max(doc_id) DESC) AS named_at FROM r GROUP BY source, path QUALIFY named_at <= 2),
l AS (SELECT r.*, named_at, named_at IS NOT NULL AND row_number() OVER (PARTITION BY r.source, r.path ORDER BY rank) = 1 AS lead FROM r LEFT JOIN named USING (source, path))
SELECT source, doc_id, rank, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lead THEN 0 ELSE 1 END, CASE WHEN lead THEN named_at END, rank) AS position FROM l""",
    "file_diversity": f"""WITH {_SOURCE}, t AS (SELECT *, row_number() OVER (PARTITION BY source, path ORDER BY rank) AS turn FROM r)
SELECT source, doc_id, rank, row_number() OVER (PARTITION BY source ORDER BY CAST(turn > 1 AS INTEGER), rank) AS position FROM t""",
    "budget_pack": f"""WITH RECURSIVE {_SOURCE}, {_PACKED} SELECT source, rank, cost, picked AS picked_at, used FROM w WHERE took""",
    "first_novel": f"""WITH {_SOURCE}, named AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY max(doc_id) DESC) AS named_at FROM r GROUP BY source, path QUALIFY named_at <= 2)
SELECT source, min(rank) FILTER (named_at IS NULL) AS first_rank FROM r LEFT JOIN named USING (source, path) GROUP BY source""",
    "delivery_gap": f"""WITH RECURSIVE {_SOURCE}, {_PACKED},
gold AS (SELECT source, doc_id, rank FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
g AS (SELECT g.source, floor(count(*) FILTER (g.rank <= {PACK_K}) / CAST(count(*) AS DOUBLE) * 1000000 + 0.500001) / 1000000 AS rr, floor(count(w.rank) / CAST(count(*) AS DOUBLE) * 1000000 + 0.500001) / 1000000 AS dr
  FROM gold g LEFT JOIN (SELECT * FROM w WHERE took) w ON w.source = g.source AND w.rank = g.rank GROUP BY g.source),
n AS (SELECT source, count(*) AS items FROM w WHERE took GROUP BY source)
SELECT count(*) AS groups, floor(avg(dr) * 10000 + 0.500001) / 10000 AS mean_delivered, floor(avg(rr) * 10000 + 0.500001) / 10000 AS mean_ranked, count(*) FILTER (dr < rr) AS losing,
  floor(avg(coalesce(items, 0)) * 10000 + 0.500001) / 10000 AS mean_items FROM g LEFT JOIN n USING (source)""",
    "chunk_lines": r"""WITH t AS (SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> ''),
c AS (SELECT doc_id, i * 5 + 1 AS start_line, least((i + 1) * 5, len(l)) AS end_line, array_to_string(l[i * 5 + 1 : (i + 1) * 5], chr(10)) AS x FROM t, LATERAL (SELECT unnest(range(0, (len(l) - 1) // 5 + 1)) AS i))
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha256(x) AS digest FROM c WHERE regexp_replace(x, '\s', '', 'g') <> ''""",
    "first_files": f"WITH {_SOURCE} SELECT source, path, min(rank) AS first_rank, row_number() OVER (PARTITION BY source ORDER BY min(rank), path) AS position FROM r GROUP BY source, path",
    "token_costs": "SELECT source, lang, count(*) AS docs, sum(length(text) // 4) AS tokens FROM documents GROUP BY ROLLUP (source, lang)",
    "cosine_topk": f"WITH {_NEAR} SELECT * FROM near",
    "recall_at_k": f"WITH {_RECALL} SELECT query_id, k, recall, any_hit FROM recalls",
    "summarise_recall": f"WITH {_RECALL} SELECT k, count(*) AS instances, floor(avg(recall) * 10000 + 0.500001) / 10000 AS mean_recall, floor(avg(CAST(any_hit AS INTEGER)) * 10000 + 0.500001) / 10000 AS any_hit_rate FROM recalls GROUP BY k",
    "rollup_recall": f"WITH {_RECALL} SELECT k, label, count(*) AS instances, floor(avg(recall) * 10000 + 0.500001) / 10000 AS mean_recall FROM recalls GROUP BY GROUPING SETS ((k, label), (k))",
    "index_percentiles": f"""WITH {_NEAR}, f AS (SELECT query_id, min(rank) AS fr FROM near JOIN e a USING (vec_id) JOIN e b ON b.vec_id = query_id AND a.label = b.label GROUP BY query_id),
l AS (SELECT list_sort(list(fr)) AS s, count(*) AS n, count(*) FILTER (fr <= 3) AS within_3, count(*) FILTER (fr <= 5) AS within_5, count(*) FILTER (fr <= 10) AS within_10 FROM f)
SELECT n, s[n // 4 + 1] AS p25, s[n // 2 + 1] AS p50, s[3 * n // 4 + 1] AS p75, within_3, within_5, within_10 FROM l""",
    "ambiguity_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
    "unique_owner": "SELECT p_name, p_size, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS owner, count(DISTINCT p_partkey) AS claims FROM part GROUP BY ALL",
    "resolution_counts": f"WITH {_TIERS} SELECT via, count(*) AS names, sum(candidates) AS candidates FROM tiers GROUP BY via",
    "longest_prefix": f"""WITH {_PAGES}, h AS (SELECT page_id, list_reverse(string_split(host, '.')) AS parts FROM pg),
x AS (SELECT page_id, i AS size, array_to_string(parts[1:i], '.') AS prefix FROM h, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
b AS (SELECT prefix, count(DISTINCT page_id) AS pages FROM x GROUP BY prefix HAVING pages >= 3),
m AS (SELECT page_id, prefix AS bound, size, pages FROM x JOIN b USING (prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC) = 1)
SELECT h.page_id, array_to_string(parts, '.') AS name, bound, CAST(size AS INTEGER) AS size, pages FROM h LEFT JOIN m USING (page_id)""",
    "suffix_match": f"""WITH {_PAGES}, asked AS (SELECT DISTINCT mention FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS mention FROM pg UNION ALL SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') FROM pg)),
a AS (SELECT mention, list_filter(string_split(regexp_replace(mention, '^[./]+|[./]+$', '', 'g'), '/'), lambda s: s <> '') AS p FROM asked),
ax AS (SELECT mention, i AS size, array_to_string(p[len(p) - i + 1 : len(p)], '/') AS suffix FROM a, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
k AS (SELECT DISTINCT path FROM pg WHERE path <> ''),
kx AS (SELECT path, array_to_string(p[len(p) - i + 1 : len(p)], '/') AS suffix FROM (SELECT path, string_split(path, '/') AS p FROM k), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
j AS (SELECT mention, size, path FROM ax JOIN kx USING (suffix)), b AS (SELECT *, max(size) OVER (PARTITION BY mention) AS top FROM j)
SELECT mention, arg_min(path, (length(path), path)) AS path FROM b WHERE size = top GROUP BY mention, size HAVING size > 1 OR count(DISTINCT path) = 1""",
    "link_graph": f"""WITH {_PAGES}, l AS (SELECT host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pg) SELECT host, href, count(*) AS n FROM l GROUP BY ALL""",
    "interval_locate": """WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
SELECT e.user_id, e.event_id, arg_min(s.event_type, (s.b - s.a, s.event_type)) AS inside FROM events e JOIN s ON s.user_id = e.user_id AND e.ts BETWEEN s.a AND s.b GROUP BY ALL""",
    "best_offer": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "identifier_weights": f"""WITH t AS (SELECT 'c-' || conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'd-' || doc_id, text FROM documents),
c AS (SELECT id, unnest(regexp_extract_all(text, '({_NAME})[ \\t\\n\\r\\f\\x0B]*\\(', 1)) AS name FROM t), i AS (SELECT id, unnest(regexp_extract_all(text, '({_NAME})', 1)) AS name FROM t),
w AS (SELECT id, name, CAST(1.5 AS DOUBLE) AS w FROM c UNION ALL SELECT id, split_part(name, '.', -1), CAST(1.3 AS DOUBLE) FROM c WHERE contains(name, '.')
  UNION ALL SELECT id, name, CAST(1.0 AS DOUBLE) FROM i WHERE contains(name, '.') OR NOT (lower(name) = name AND upper(name) <> name) OR contains(name, '_')
  UNION ALL SELECT id, split_part(name, '.', -1), CAST(0.8 AS DOUBLE) FROM i WHERE contains(name, '.'))
SELECT name, max(w) AS weight, count(DISTINCT id) AS texts FROM w WHERE length(name) >= 3 AND lower(name) NOT IN ({_stop_sql()}) GROUP BY name""".replace("\\\\", "\\"),
    "stop_filter": f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS name FROM benchmark)
SELECT name, count(DISTINCT item_id) AS items FROM w WHERE length(name) >= 3 AND lower(name) NOT IN ({_stop_sql()}) GROUP BY name""",
    "literal_selective": "SELECT CAST(item_id AS VARCHAR) AS literal_id, count(DISTINCT doc_id) AS files FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id HAVING files <= 8",
    "fixpoint_closure": f"""WITH RECURSIVE {_CLASSES}, up AS (SELECT DISTINCT cls AS node, base AS above, 1 AS depth FROM bases UNION SELECT up.node, b.base, depth + 1 FROM up JOIN bases b ON up.above = b.cls WHERE depth < 6)
SELECT node, above, min(depth) AS depth FROM up GROUP BY ALL""",
    "mro_first_hit": f"""WITH RECURSIVE {_CLASSES}, asks AS (SELECT DISTINCT f AS cls, member FROM cl),
walk AS (SELECT cls, member, cls AS here, CAST([] AS INTEGER[]) AS way, 0 AS depth FROM asks UNION ALL SELECT w.cls, w.member, b.base, list_append(way, b.ord), depth + 1 FROM walk w JOIN bases b ON w.here = b.cls WHERE depth < 6),
hit AS (SELECT w.* FROM walk w SEMI JOIN owns o ON o.cls = w.here AND o.member = w.member)
SELECT cls, member, here AS owner, depth FROM hit QUALIFY row_number() OVER (PARTITION BY cls, member ORDER BY depth, way) = 1""",
    "hourly_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
    "event_payloads": """WITH r AS (SELECT event_type, coalesce(CAST(json_extract(props, '$.k') AS INTEGER) >= 50, FALSE) AS ok FROM events)
SELECT event_type, count(*) AS submitted, count(*) FILTER (ok) AS resolved, floor(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE) * 10000 + 0.500001) / 10000 AS resolved_rate FROM r GROUP BY event_type""",
}
