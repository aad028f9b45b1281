"""Inputs of the registered queries: a scale lane over documents, a domain lane over a derived corpus.

The domain corpus is one SQL expression over `part`, written so that Spark and DuckDB read it alike:
ids, years and texts follow from p_partkey by integer arithmetic over the fixed word lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..operators import enrich, index, ingest


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows."""
    listed = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {listed})"


def pool() -> list[str]:
    """The terms that texts of the domain corpus are made of."""
    groups = [*lex.CATEGORY_KEYWORDS.values(), *lex.TECHNICAL_PROPERTIES.values(), lex.COMPOSITION_TERMS]
    return [t for g in [*groups, *lex.APPLICATION_DOMAINS.values(), lex.TEST_METHOD_INDICATORS] for t in g]


NUMBERS = values("k", "i, num, yr", [(i, n, y) for i, (n, y) in enumerate(lex.KNOWN_YEARS.items())])
TERMS = values("t", "i, term", list(enumerate(pool())))

#: std_seq, id, title, text, from a relation named part.
STANDARDS = """
SELECT p.p_partkey AS std_seq,
  'IS ' || k.num || CASE WHEN p.p_partkey % 5 = 0 THEN ' (Part ' || CAST(p.p_partkey % 3 + 1 AS STRING) || ')' ELSE '' END
    || CASE WHEN p.p_partkey % 4 = 3 THEN '' WHEN p.p_partkey % 7 = 0 THEN ': ' || CAST(CAST(k.yr AS INT) + p.p_partkey % 11 AS STRING)
       ELSE ': ' || k.yr END AS id,
  CASE WHEN p.p_partkey % 13 = 0 THEN '' ELSE 'Specification for ' || a.term END AS title,
  'IS ' || k.num || ' specification for ' || a.term || '. 1. Scope - This standard covers ' || b.term || ' and ' || c.term
    || '. It applies to ' || d.term || ', ' || e.term || ' and ' || f.term || '.'
    || CASE WHEN p.p_partkey % 6 = 0 THEN ' Superseded by IS 269: 2013.' ELSE '' END
    || CASE WHEN p.p_partkey % 4 = 1 THEN ' See IS 383 (Part  2): 1970, IS 455 and IS 269.' ELSE '' END
    || CASE WHEN p.p_partkey % 9 = 0 THEN repeat(' The ' || b.term || ' with ' || c.term || ' in ' || e.term || '.', CAST(8 + p.p_partkey % 40 AS INT)) ELSE '' END
    || CASE WHEN p.p_partkey % 50 = 0 THEN repeat('*', 60) ELSE '' END AS text
FROM part p JOIN k ON k.i = p.p_partkey % {n_k} JOIN t a ON a.i = p.p_partkey % {n_t} JOIN t b ON b.i = (p.p_partkey * 3) % {n_t}
  JOIN t c ON c.i = (p.p_partkey * 7 + 1) % {n_t} JOIN t d ON d.i = (p.p_partkey * 11 + 2) % {n_t}
  JOIN t e ON e.i = (p.p_partkey * 17 + 3) % {n_t} JOIN t f ON f.i = (p.p_partkey * 29 + 5) % {n_t}
""".replace("{n_k}", str(len(lex.KNOWN_YEARS))).replace("{n_t}", str(len(pool())))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """What tells one state of some tables from another: their files' names, lengths and times."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = [sf_dir]
    for name in names:
        path = hadoop.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        found += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return "\n".join(found)


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"WITH {values('v', columns, rows)} SELECT * FROM v")


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(f"WITH {NUMBERS}, {TERMS} {STANDARDS.replace('FROM part p', 'FROM {part} p')}", part=table(spark, sf_dir, "part"))
    return made.repartition("std_seq")  # part is one small file


def domain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunks(standards(spark, sf_dir))


def domain_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(domain_chunks(spark, sf_dir))


def domain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_enriched(spark, sf_dir).withColumn("search_text", index.search_text())


def vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), "embedding")


def scale_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("doc_idx"), F.lit("").alias("id"), F.lit("").alias("title"), "text", F.col("lang").alias("category"),
        F.concat_ws(" ", "text", "lang").alias("search_text"),
    )


def scale_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


#: (qid, query): the canned queries, numbered.
PUBLIC = [(i, row[1]) for i, row in enumerate(lex.CANNED)]
#: (qid, id, query, expected, retrieved, latency): a published run.
RUN = [
    (i, c[0], c[1], "; ".join(c[3]), "; ".join(s[1]), s[2]) for i, (c, s) in enumerate(zip(lex.CANNED, lex.SNAPSHOT, strict=True))
]
RUN_COLUMNS = "qid, id, query, expected, retrieved, latency"


def public_queries(spark: SparkSession) -> DataFrame:
    return literal(spark, "qid, query", PUBLIC).select(F.col("qid").cast("long").alias("qid"), "query")


def run_results(spark: SparkSession) -> DataFrame:
    split = lambda c: F.split(c, "; ")
    rows = literal(spark, RUN_COLUMNS, RUN)
    return rows.select(
        "id", "query", split("expected").alias("expected_standards"), split("retrieved").alias("retrieved_standards"),
        F.col("latency").cast("double").alias("latency_seconds"),
    )
