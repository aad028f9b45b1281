"""Metadata of chunks: references, properties, fields of use, materials, quality. One projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions import lexicons as lex


def technical_properties(x: Column) -> Column:
    """A struct of the terms found by kind, at most 10 each, null where there are none."""

    def some(terms: list[str]) -> Column:
        return text.let(F.lower(x), lambda low: text.let(F.slice(text.found(terms, low), 1, 10), lambda hit: F.when(F.size(hit) > 0, hit)))

    return F.struct(*[some(terms).alias(kind) for kind, terms in lex.TECHNICAL_PROPERTIES.items()])


def application_domains(x: Column, most: int = 3) -> Column:
    """Domains by number of terms found, the first on ties."""

    def of(low: Column) -> Column:
        rows = [
            F.struct((-F.size(text.found(terms, low))).alias("n"), F.lit(i).alias("ord"), F.lit(name).alias("name"))
            for i, (name, terms) in enumerate(lex.APPLICATION_DOMAINS.items())
        ]
        return F.transform(F.slice(F.array_sort(F.filter(F.array(*rows), lambda s: s["n"] < 0)), 1, most), lambda s: s["name"])

    return text.let(F.lower(x), of)


def composition_terms(x: Column, most: int = 12) -> Column:
    return text.let(F.lower(x), lambda low: F.slice(text.found(lex.COMPOSITION_TERMS, low), 1, most))


def is_test_method(x: Column, std_id: Column) -> Column:
    """By number, or by two phrases of test methods."""
    shown = text.let(F.lower(x), lambda low: F.size(text.found(lex.TEST_METHOD_INDICATORS, low)))
    return ids.standard_number(std_id).isin(lex.TEST_METHOD_STANDARDS) | (shown >= 2)


def enrich(chunks: DataFrame) -> DataFrame:
    body, own = F.coalesce("text", F.lit("")), F.coalesce("id", F.lit(""))
    return chunks.withColumns(
        {
            "related_standards": ids.related_standards(body, own),
            "technical_properties": technical_properties(body),
            "application_domains": application_domains(body),
            "composition_terms": composition_terms(body),
            "is_test_method": is_test_method(body, own),
            "superseded_by": ids.superseded_by(body),
            "importance_weight": F.lit(1.0),
        }
    )


def quality_issues(chunks: DataFrame) -> DataFrame:
    """chunks with issues (an array of messages) and is_valid."""
    body = F.coalesce("text", F.lit(""))
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    checks = [
        (F.coalesce("id", F.lit("")) == "", "Missing ID"),
        (F.length(text.strip(body)) < 20, "Text too short or missing"),
        (F.coalesce("category", F.lit("")) == "", "Missing category"),
        (F.coalesce(F.size("keywords"), F.lit(0)) <= 0, "No keywords extracted"),
        ((count("*") > 50) | (count("†") > 20), "Possible text corruption (excessive symbols)"),
    ]
    issues = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]))
    return chunks.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)
