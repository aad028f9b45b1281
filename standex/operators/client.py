"""What the client computes: matching canned queries, result cards, history, the star graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text

MATCH_LEAST = 3
# What a card says of a standard that the catalogue lacks, and how a primary one begins.
UNKNOWN_CATEGORY, UNKNOWN_TEXT = "general", "Refer to BIS portal for full details of this standard."
PRIMARY = "✅ Primary standard — "
# The answer where no canned query matches.
FALLBACK = {
    "latency_seconds": 0.87, "normalized_query": "general query", "expanded_query": "BIS standard compliance", "detected_category": "general",
    "candidates_retrieved": 20, "candidates_reranked": 10, "candidates_output": 4,
}
# Its cards: id, title, rationale, confidence, rank, category, primary, related, keywords.
FALLBACK_CARDS = [
    ("IS 269 : 2015", "Ordinary Portland Cement — Specification",
     "IS 269 covers the specification for ordinary portland cement. Matches your query on: cement, 33 grade, portland.",
     0.95, 1, "cement_opc", True, ["IS 8112", "IS 12269", "IS 4032"], ["cement", "33 grade", "portland", "opc"]),
    ("IS 8112 : 2013", "Ordinary Portland Cement, 43 Grade — Specification",
     "Matches your query's context of Portland cement manufacturing, though specifies 43 grade.",
     0.82, 2, "cement_opc", False, ["IS 269", "IS 12269"], ["cement", "portland"]),
    ("IS 12269 : 2013", "Ordinary Portland Cement, 53 Grade — Specification",
     "Related standard for higher grade OPC cement manufacturing.",
     0.75, 3, "cement_opc", False, ["IS 269", "IS 8112"], ["cement", "portland"]),
    ("IS 4032 : 1985", "Method of Chemical Analysis of Hydraulic Cement",
     "Relevant for testing requirements of the manufactured cement product.",
     0.60, 4, "testing_methods", False, ["IS 269"], ["cement"]),
]
# The graph's geometry.
CENTRE, RADIUS, OUTER, TURN = 150.0, 90.0, 60.0, 0.4


def canned(spark: SparkSession) -> DataFrame:
    """(ord, id, query, keywords, expected, retrieved, latency, category)."""
    rows = [(i, *row) for i, row in enumerate(lex.CANNED)]
    schema = "ord int, id string, query string, keywords array<string>, expected array<string>, retrieved array<string>, latency double, category string"
    return spark.createDataFrame(rows, schema)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lex.CATALOGUE, "id string, title string, category string, description string")


def match_score(query: Column, keywords: Column, canned_query: Column) -> Column:
    """Twice the words of each keyword in the query, and one for each longer word of the canned query in it."""
    q = F.lower(query)
    hit = F.filter(keywords, lambda k: F.contains(q, F.lower(k)))
    by_keyword = F.aggregate(hit, F.lit(0), lambda acc, k: acc + F.size(F.split(k, " ")) * 2)
    theirs = F.split(F.lower(canned_query), r"\s+")
    mine = F.split(q, r"\s+")
    return by_keyword + F.size(F.filter(theirs, lambda w: (F.length(w) > 4) & F.array_contains(mine, w)))


def match(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, matched_id, score): the best canned query, the first on ties; null below 3. The canned
    queries are a literal table of fixed size, so they are broadcast."""
    pairs = queries.crossJoin(F.broadcast(known.select("ord", "id", F.col("query").alias("theirs"), "keywords")))
    scored = pairs.withColumn("score", match_score(F.col("query"), F.col("keywords"), F.col("theirs")))
    best = scored.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("qid", F.when(F.col("b.score") >= MATCH_LEAST, F.col("b.id")).alias("matched_id"), F.col("b.score").alias("score"))


def cards(known: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Result cards of the canned queries, with defaults for standards that the catalogue lacks."""
    each = known.select("id", "keywords", "expected", "retrieved", F.posexplode("retrieved").alias("i", "std_id"))
    meta = catalogue.select(F.col("id").alias("std_id"), "title", F.col("category").alias("cat"), "description")
    joined = each.join(meta, "std_id", "left")  # the caller's catalogue: the planner broadcasts it if it is small
    primary = F.array_contains("expected", F.col("std_id"))
    about = F.coalesce("description", F.lit(UNKNOWN_TEXT))
    base = F.when(primary, 0.97 - F.col("i") * 0.04).otherwise(0.75 - F.col("i") * 0.06)
    return joined.select(
        F.col("id").alias("qid"), "std_id", F.coalesce("title", "std_id").alias("title"),
        F.when(primary, F.concat(F.lit(PRIMARY), about)).otherwise(about).alias("rationale"),
        F.greatest(F.round(base, 2), F.lit(0.3)).alias("confidence"), (F.col("i") + 1).alias("rank"),
        F.coalesce("cat", F.lit(UNKNOWN_CATEGORY)).alias("category"), primary.alias("is_primary"),
        F.filter("retrieved", lambda s: s != F.col("std_id")).alias("related_standards"), F.slice("keywords", 1, 4).alias("matched_keywords"),
    )


def fallback_cards(spark: SparkSession) -> DataFrame:
    """The cards shown where no canned query matches."""
    schema = (
        "std_id string, title string, rationale string, confidence double, rank int, category string, is_primary boolean, "
        "related_standards array<string>, matched_keywords array<string>"
    )
    return spark.createDataFrame(FALLBACK_CARDS, schema)


def answer_cards(queries: DataFrame, known: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(qid, card...): each query's cards, of its match or the fallback."""
    found = match(queries, known).select(F.col("qid").alias("asked"), "matched_id")
    of_match = found.join(cards(known, catalogue), F.col("matched_id") == F.col("qid")).drop("qid", "matched_id")
    unmatched = found.where("matched_id is null").select("asked").crossJoin(F.broadcast(fallback_cards(known.sparkSession)))  # four literal rows
    return of_match.unionByName(unmatched).withColumnRenamed("asked", "qid")


def answer_meta(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, ...): the metadata of each query's answer, from its match or the fallback."""
    q = text.strip(F.col("query"))
    facts = known.select(F.col("id").alias("matched_id"), "keywords", "expected", "retrieved", "latency", "category")
    found = queries.join(match(queries, known), "qid").join(facts, "matched_id", "left")
    hit = F.col("matched_id").isNotNull()
    pick = lambda mine, key: F.when(hit, mine).otherwise(F.lit(FALLBACK[key])).alias(key)
    return found.select(
        "qid", pick(F.col("latency"), "latency_seconds"), q.alias("original_query"), text.plain_query(q).alias("normalized_query"),
        pick(F.array_join("keywords", ", "), "expanded_query"), pick(F.col("category"), "detected_category"),
        pick(F.lit(25), "candidates_retrieved"), pick(F.lit(10), "candidates_reranked"), pick(F.size("retrieved"), "candidates_output"),
        F.col("matched_id").alias("matched_dataset_id"), F.when(hit, F.element_at("expected", 1)).alias("primary_standard"),
    )


def history(asked: DataFrame) -> DataFrame:
    """Asked queries (user, ts, seq, query), newest first."""
    order = Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("seq"))
    return asked.withColumn("pos", F.row_number().over(order))


def graph(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (qid, rank, id, title, related_standards): the query in the middle, its
    results around it, two related standards beside each."""
    n = F.count("*").over(Window.partitionBy("qid"))
    placed = results.withColumn("angle", (F.col("rank") - 1) * F.lit(6.283185307179586) / n)
    at = lambda r, a: ((CENTRE + r * F.cos(a)).alias("x"), (CENTRE + r * F.sin(a)).alias("y"))
    query = results.select("qid").distinct().select(
        "qid", F.lit("query").alias("id"), F.lit("Query").alias("label"), F.lit(CENTRE).alias("x"), F.lit(CENTRE).alias("y"),
        F.lit("query").alias("type"), F.lit(30).alias("radius"), F.lit(None).cast("string").alias("title"),
    )
    primary = placed.select("qid", "id", F.col("id").alias("label"), *at(RADIUS, F.col("angle")), F.lit("primary").alias("type"), F.lit(25).alias("radius"), "title")
    near = placed.select("qid", "id", "angle", F.posexplode(F.slice("related_standards", 1, 2)).alias("j", "related"))
    turned = F.col("angle") + F.when(F.col("j") == 0, TURN).otherwise(-TURN)
    name = F.concat("id", F.lit("-"), "related")
    secondary = near.select(
        "qid", name.alias("id"), F.col("related").alias("label"), *at(RADIUS + OUTER, turned), F.lit("secondary").alias("type"),
        F.lit(18).alias("radius"), F.col("related").alias("title"),
    )
    nodes = query.unionByName(primary).unionByName(secondary)
    edges = results.select("qid", F.lit("query").alias("source"), F.col("id").alias("target")).unionByName(
        near.select("qid", F.col("id").alias("source"), name.alias("target"))
    )
    return nodes, edges


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' places; an edge without one of its nodes is dropped."""
    a = nodes.select("qid", F.col("id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select("qid", F.col("id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, ["qid", "source"]).join(b, ["qid", "target"]).select("qid", "source", "target", "x1", "y1", "x2", "y2")


def export(results: DataFrame, generated_on: Column) -> DataFrame:
    """(qid, filename_part, payload): JSON of a query's results, and its file name's part."""
    own = results.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title"))).alias("results"))
    payload = F.to_json(F.struct(generated_on.alias("generated_on"), "query", "results"))
    return own.select("qid", text.safe_file_part(F.col("query")).alias("filename_part"), payload.alias("payload"))
