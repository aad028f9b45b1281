"""Why a standard was returned: templates, and a language model behind a seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

FENCE = "```"
# What stands in for a missing reason.
DEFAULT_REASON, BACKFILL = "Relevant to your query.", "Relevant Indian Standard for your query."
SEE_ABOVE, RELATED, RELEVANT = "See above explanation.", "Related BIS standard.", "Relevant Indian Standard matching your query."
# Fixed value: the model, read where a key for it is set.
MODEL = {"model": "meta-llama/llama-3-8b-instruct", "temperature": 0.2, "max_tokens": 1024, "timeout_s": 10}
REPLY = "array<struct<standard:string,reason:string>>"


def template(query: Column, std_id: Column, title: Column, body: Column) -> Column:
    """The rationale's sentence: scope, else title, else a general one; and what matched."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    found = text.scope(body)
    head = (
        F.when(found != "", F.concat(std_id, F.lit(" covers "), found, F.lit(".")))
        .when(F.length(title) > 5, F.concat(std_id, F.lit(" pertains to "), title, F.lit(".")))
        .otherwise(F.concat(std_id, F.lit(" is a relevant Indian Standard.")))
    )
    terms = text.matched_terms(query, body)
    matched = F.when(F.size(terms) > 0, F.array_join(terms, ", ")).otherwise("related specifications")
    return F.concat(head, F.lit(" Matches your query on: "), matched, F.lit("."))


def confidence(rank: Column, score: Column | None = None) -> Column:
    """The clamped score, or one that decays with the rank."""
    decayed = F.round(F.greatest(0.95 - (rank - 1) * 0.1, F.lit(0.3)), 3)
    return decayed if score is None else F.when(score.isNotNull(), F.bround(text.clamp01(score), 3)).otherwise(decayed)


def rationales(ranked: DataFrame, score: Column | None = None) -> DataFrame:
    """(qid, id, rationale, confidence, rank) of (qid, query, rank, id, title, text)."""
    sentence = template(F.col("query"), F.col("id"), F.col("title"), F.col("text"))
    return ranked.select("qid", "id", sentence.alias("rationale"), confidence(F.col("rank"), score).alias("confidence"), "rank")


def fallback_reason(has_doc: Column, title: Column) -> Column:
    """The reason where no model answers."""
    covers = F.concat(F.lit("This standard covers "), title, F.lit("."))
    return F.when(~has_doc, RELATED).when(F.length(F.coalesce(title, F.lit(""))) > 5, covers).otherwise(RELEVANT)


def prompt(query: Column, std_ids: Column, docs: Column) -> Column:
    """The model's input: the query, the standards, and 300 characters of each of five documents
    (an array of id, title, text)."""
    context = F.array_join(
        F.transform(
            F.slice(docs, 1, 5),
            lambda d: F.concat(d["id"], F.lit(": "), F.coalesce(d["title"], F.lit("")), F.lit(" — "), F.substring(d["text"], 1, 300)),
        ),
        "\n\n",
    )
    listed = F.array_join(F.transform(std_ids, lambda s: F.concat(F.lit("- "), s)), "\n")
    head = "Explain in one line each why these standards fit the query. Use only the context. Add and change no standard.\n\n"
    tail = '\n\nAnswer as JSON: [{"standard": "...", "reason": "..."}]'
    return F.concat(F.lit(head + "Query: "), query, F.lit("\n\nStandards:\n"), listed, F.lit("\n\nContext:\n"), context, F.lit(tail))


def explained(queries: DataFrame, rows: DataFrame, docs: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """(qid, id, rationale, confidence, rank) of rows (qid, std_id, doc_idx, pos): one prompt a query with its
    standards in order (at most five), one reply, and a reason for every standard, from the reply or
    the fallbacks of parse_reply."""
    own = rows.join(docs.select("doc_idx", "title", "text"), "doc_idx", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("std_id").alias("id"), "title", "text")))
    grouped = own.groupBy("qid").agg(listed.alias("docs")).join(queries.select("qid", "query"), "qid")
    std_ids, titles = F.transform("docs", lambda d: d["id"]), F.transform("docs", lambda d: d["title"])
    asked = grouped.select("qid", std_ids.alias("std_ids"), titles.alias("titles"), prompt(F.col("query"), std_ids, F.col("docs")).alias("prompt"))
    parsed = answered(asked, model).withColumn("reasons", parse_reply(F.col("reply"), F.col("std_ids"), F.col("titles")))
    each = parsed.select("qid", F.posexplode("std_ids").alias("i", "id"), "reasons")
    mine = F.filter("reasons", lambda r: ids.normalize_id(r["standard"]) == ids.normalize_id(F.col("id")))
    rank = F.col("i") + 1
    return each.select("qid", "id", F.get(mine, F.lit(0))["reason"].alias("rationale"), confidence(rank).alias("confidence"), rank.alias("rank"))


def unfenced(reply: Column) -> Column:
    """The inside of the first fenced block, if there is one."""
    json_block = F.split(F.element_at(F.split(reply, FENCE + "json"), 2), FENCE)[0]
    block = F.split(F.element_at(F.split(reply, FENCE), 2), FENCE)[0]
    inner = F.when(F.contains(reply, F.lit(FENCE + "json")), json_block).when(F.contains(reply, F.lit(FENCE)), block).otherwise(reply)
    return text.strip(inner)


def parse_reply(reply: Column, std_ids: Column, titles: Column) -> Column:
    """An array of (standard, reason): the reply's items for known standards, the rest filled in. A
    reply that isn't JSON becomes the first reason; JSON that isn't a list of objects, or no
    reply at all, gives the fallback."""
    cleaned = unfenced(text.strip(reply))
    parsed = F.when(cleaned.startswith("["), F.from_json(cleaned, REPLY))
    known = F.transform(std_ids, lambda s: ids.normalize_id(s))
    item = lambda s, r: F.struct(s.alias("standard"), r.alias("reason"))
    kept = F.filter(parsed, lambda r: F.array_contains(known, ids.normalize_id(r["standard"])))
    kept = F.transform(kept, lambda r: item(F.coalesce(r["standard"], F.lit("")), F.coalesce(r["reason"], F.lit(DEFAULT_REASON))))
    covered = F.transform(kept, lambda r: ids.normalize_id(r["standard"]))
    missing = F.filter(std_ids, lambda s: ~F.array_contains(covered, ids.normalize_id(s)))
    filled = F.concat(kept, F.transform(missing, lambda s: item(s, F.lit(BACKFILL))))
    raw = F.transform(std_ids, lambda s, i: item(s, F.when(i == 0, F.substring(reply, 1, 200)).otherwise(SEE_ABOVE)))
    title = lambda i: F.get(titles, i)
    plain = F.transform(std_ids, lambda s, i: item(s, fallback_reason(i < F.size(titles), title(i))))
    other = F.try_parse_json(cleaned).isNotNull() & ~cleaned.startswith("[")
    return F.when(reply.isNull() | other, plain).when(parsed.isNull(), raw).otherwise(filled)


def answered(prompts: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """prompts with `reply`. The model is called on the executors, batch by batch; a failing call gives null."""
    if model is None:
        return prompts.withColumn("reply", F.lit(None).cast("string"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> str | None:
            try:
                return model(p)
            except Exception:  # noqa: BLE001 - whatever the model's client raises: the fallback answers
                return None

        for batch in batches:
            yield batch.assign(reply=[one(p) for p in batch["prompt"]])

    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", reply string"
    return prompts.mapInPandas(call, schema)
