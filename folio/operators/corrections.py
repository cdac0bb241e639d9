"""Corrections of block documents, and the request and response tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.functions.library import scoped_model
from folio.session import materialise

# Defaults and limits of agent settings.
DEFAULT_TEMPERATURE, DEFAULT_TOP_P, DEFAULT_EFFORT = 0.2, 1.0, "medium"
MAX_OUTPUT_TOKENS = 128_000


def apply_changes(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after correction.

    The last change of an id wins; a blank text removes the block for good; notes stay as they
    are; unknown ids are added as paragraphs at the end; a page with an unusable id keeps its input
    and gets ``error``.
    """
    page = Window.partitionBy("page_id")
    usable = F.coalesce(F.trim("block_id") != "", F.lit(False))
    blank = F.trim("text") == ""
    per_id = changes.withColumn("_bad", F.max(~usable).over(page)).groupBy("page_id", "block_id").agg(
        F.max("_bad").alias("_bad"),
        F.max_by(F.when(~blank, F.col("text")), F.when(~blank, F.col("ord"))).alias("_new"),
        F.max(blank).alias("_blank"),
        F.min("ord").alias("_first"),
    )
    known = blocks.join(per_id, ["page_id", "block_id"], "full_outer").withColumn(
        "_bad", F.coalesce(F.max("_bad").over(page), F.lit(False)))
    fresh = F.col("ord").isNull()
    open_ = ~F.col("_bad") & (fresh | (F.col("type") != "note"))
    kept = known.filter(~(fresh & F.col("_bad"))).filter(~(open_ & F.coalesce(F.col("_blank"), F.lit(False))))
    order = Window.partitionBy("page_id").orderBy(fresh, F.coalesce("ord", "_first"))
    return kept.select(
        "page_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("ord"),
        "block_id",
        F.coalesce("type", F.lit("p")).alias("type"),
        F.when(open_ & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        F.when(F.col("_bad"), F.lit("invalid id")).alias("error"),
    )


def doc_payload(blocks: DataFrame, language: Column, mode: str = "json") -> DataFrame:
    """Input document of each page: JSON of its blocks, or its text without notes; empty gives an error."""
    page = blocks.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "block_id", "type", "text"))).alias("b"), F.first(language).alias("language_hint")
    )
    if mode == "text":
        kept = F.filter("b", lambda x: (x["type"] != "note") & (F.trim(x["text"]) != ""))
        body = F.array_join(F.transform(kept, lambda x: F.trim(x["text"])), "\n")
        size = F.size(kept)
    else:
        items = F.transform("b", lambda x: F.struct(x["block_id"].alias("id"), x["type"].alias("type"), x["text"].alias("text")))
        body = F.to_json(F.struct("language_hint", items.alias("blocks")))
        size = F.size("b")
    return page.select(
        "page_id",
        F.when(size > 0, body).alias("payload"),
        F.when(size == 0, F.lit("empty")).alias("error"),
    )


def effective_settings(agents: DataFrame, models: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings of every (agent, model): override, per model, defaults, registry, agent, constant.

    Values a model cannot take are NULL.  agents: name, model, temperature, top_p,
    reasoning_effort, defaults and per_model (structs of the same values); models: model and what it
    supports and defaults to; overrides: name with the values of one request.
    """
    joined = agents.join(models, "model", "left").join(overrides, "name", "left")
    own = F.try_element_at(F.col("per_model"), F.col("model"))

    def value(c: str, const) -> Column:
        return F.coalesce(F.col(f"o_{c}"), own[c], F.col("defaults")[c], F.col(f"m_{c}"), F.col(c), F.lit(const))

    tokens = F.coalesce(
        own["max_output_tokens"], F.col("defaults")["max_output_tokens"], F.col("m_max_output_tokens"), F.col("max_output_tokens")
    )
    return joined.select(
        "name",
        "model",
        F.when(F.coalesce("can_temperature", F.lit(True)), T.clamp(value("temperature", DEFAULT_TEMPERATURE), 0.0, 2.0, DEFAULT_TEMPERATURE)).alias("temperature"),
        F.when(F.coalesce("can_top_p", F.lit(True)), T.clamp(value("top_p", DEFAULT_TOP_P), 0.0, 1.0, DEFAULT_TOP_P)).alias("top_p"),
        F.when(F.coalesce("can_reasoning", F.lit(False)), T.reasoning_effort(value("reasoning_effort", DEFAULT_EFFORT))).alias("reasoning_effort"),
        F.when(tokens.isNotNull(), T.clamp(tokens, 1, MAX_OUTPUT_TOKENS, MAX_OUTPUT_TOKENS)).cast("bigint").alias("max_output_tokens"),
    )


def request_models(settings: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``provider`` and ``request_model``, the id a request names the model by.

    ``registry``: model, upstream, provider; ids and providers are compared trimmed and in lower case.  A model without an
    upstream id, or not registered, goes by its own; the maker's prefix is dropped where the provider is the maker.
    """
    norm = lambda c: F.lower(F.trim(c))
    known = registry.select(norm("model").alias("_id"), F.coalesce("upstream", "model").alias("_up"), norm("provider").alias("provider"))
    found = settings.withColumn("_id", norm("model")).join(known, "_id", "left")
    return found.withColumn("request_model", scoped_model(F.coalesce("_up", "model"), F.col("provider"))).drop("_id", "_up")


def requests(payloads: DataFrame, settings: DataFrame, prompts: DataFrame) -> DataFrame:
    """One request row per page and agent, as JSON; pages without payload give none.

    A page whose agent is unknown or unreadable gives a row with ``error`` instead.
    """
    agents = prompts.join(settings, "name").withColumn("_known", F.lit(True))
    model = F.col("request_model" if "request_model" in settings.columns else "model")
    body = F.to_json(F.struct(
        model.alias("model"), F.col("prompt").alias("instructions"), F.col("payload").alias("input"),
        "temperature", "top_p", "reasoning_effort", "max_output_tokens",
    ))
    return payloads.filter("payload IS NOT NULL").join(agents, "agent", "left").select(
        "page_id", "agent", F.when(F.col("_known"), body).alias("request"), F.when(F.col("_known").isNull(), "no_agent").alias("error"))


def results(responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents after reading the responses back.

    A valid ``changes`` answer is applied, a ``blocks`` answer replaces the document, any other
    text becomes one paragraph, and a missing answer keeps the input.
    """
    body = M.strip_fences(M.response_extract(F.col("response"))["text"])
    read = materialise(responses.select("page_id", body.alias("body")).select(
        "page_id", "body",
        F.from_json(F.get_json_object("body", "$.changes"), "array<map<string,string>>").alias("c"),
        F.from_json(F.get_json_object("body", "$.blocks"), "array<struct<id:string,type:string,text:string>>").alias("b"),
        M.validate_changes(F.col("body"))["ok"].alias("ok"),
    ).withColumn(
        "route", F.when(F.col("body") == "", "keep").when(F.col("ok"), "changes").when(F.col("b").isNotNull(), "blocks")
        .when(F.col("c").isNotNull(), "keep").otherwise("text"),
    ))
    change_rows = read.filter("route = 'changes'").select("page_id", F.posexplode("c").alias("ord", "x")).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), F.col("x")["id"].alias("block_id"),
        F.when(F.map_contains_key("x", F.lit("text")), F.coalesce(F.col("x")["text"], F.lit(""))).alias("text"))  # a null text removes the block
    replaced = read.filter("route IN ('blocks', 'text')").select("page_id")
    kept = blocks.select("page_id", "block_id", "ord", "type", "text").join(replaced, "page_id", "left_anti")
    corrected = apply_changes(kept, change_rows).select("page_id", "ord", "block_id", "type", "text")
    whole = read.filter("route = 'blocks'").select("page_id", F.posexplode("b").alias("ord", "x")).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), F.col("x.id").alias("block_id"), "x.type", "x.text")
    plain = read.filter("route = 'text'").select(
        "page_id", F.lit(0).cast("bigint").alias("ord"), F.lit("b1").alias("block_id"), F.lit("p").alias("type"), F.col("body").alias("text"))
    return corrected.unionByName(whole).unionByName(plain)


def page_versions(blocks: DataFrame, profile: str = "server") -> DataFrame:
    """Html of a page from its document blocks."""
    html = M.block_html(F.col("type"), F.col("text"), F.col("block_id"), profile)
    return (
        blocks.withColumn("html", html)
        .filter("html IS NOT NULL")
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "html"))).alias("h"))
        .select("page_id", F.array_join(F.transform("h", lambda x: x.html), "").alias("html"))
    )


def compare_versions(formatter: DataFrame, corrector: DataFrame, reader: DataFrame) -> DataFrame:
    """One row per page with its versions side by side."""
    pick = lambda df, name: df.select("page_id", F.col("html").alias(name))
    return (
        pick(formatter, "formatter").join(pick(corrector, "corrector"), "page_id", "full_outer")
        .join(pick(reader, "reader"), "page_id", "full_outer")
    )
