"""From transcripts to candidate findings: prompts, lenient parsing and the strict gate.

The text generator is the caller's; the jobs around it are joins and expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factledger.constants import CHECKED_TOPICS, STAT_FIELDS
from factledger.functions.numbers import float_text
from factledger.functions.text import contains_any, first_matching, transcript_parts
from factledger.operators.joins import broadcast_if_small
from factledger.operators.ranking import numbered, top_rows

Keywords = Mapping[str, Sequence[str]]


# --- topic routing ------------------------------------------------------------------
def topic_key(topic: Column, keywords: Keywords = CHECKED_TOPICS) -> Column:
    """First topic key, in declared order, contained in a topic text."""
    return first_matching(F.coalesce(topic, F.lit("")), [(k, k) for k in keywords])


def topic_statistics(statistics: DataFrame, keywords: Keywords = CHECKED_TOPICS) -> DataFrame:
    """Statistics per topic key with their index in the topic's list (catalog order ``pos``)."""
    metric = F.lower(F.coalesce("metric", F.lit("")))
    keys = F.array_compact(F.array(*[F.when(contains_any(metric, words), F.lit(k)) for k, words in keywords.items()]))
    routed = statistics.withColumn("topic_key", F.explode(keys))
    return numbered(routed, ["pos"], ["topic_key"], name="stat_index", start=0)


# --- gate ------------------------------------------------------------------------------
def gate_findings(claims: DataFrame, statistics: DataFrame, keywords: Keywords = CHECKED_TOPICS) -> DataFrame:
    """Keep contradicted/consistent verdicts whose index names a statistic of the claim's topic.

    ``claims`` carry topic, outcome and stat_index; a claim whose topic has no
    statistics, or whose index is null or out of range, finds no partner.
    """
    decisive = claims.filter(F.col("outcome").isin("contradicted", "consistent")).withColumn(
        "topic_key", topic_key(F.col("topic"), keywords)
    )
    listed = topic_statistics(statistics, keywords).select(
        "topic_key", "stat_index", F.struct(*STAT_FIELDS).alias("stat")
    )
    found = decisive.withColumn("stat_index", F.col("stat_index").cast("bigint")).join(
        broadcast_if_small(listed), ["topic_key", "stat_index"]
    )
    return found.select(
        *[c for c in claims.columns if c != "stat_index"], "stat", F.lit("candidate").alias("status")
    )


# --- prompts -----------------------------------------------------------------------------
def stat_line(index: Column) -> Column:
    """One numbered line of the statistics list shown to the adjudicator."""
    blank = F.lit("")
    return F.concat(
        index.cast("string"),
        F.lit(": "),
        F.coalesce("metric", F.lit("None")),
        F.lit(" | "),
        F.coalesce("dimension_value", blank),
        F.lit(" = "),
        F.coalesce(float_text(F.col("value")), F.lit("None")),
        F.lit(" "),
        F.coalesce("unit", blank),
        F.lit(" ("),
        F.coalesce("period", blank),
        F.lit(") — מקור: "),
        F.coalesce("source_org", blank),
    )


def stat_lists(statistics: DataFrame, keywords: Keywords = CHECKED_TOPICS, max_lines: int = 1000) -> DataFrame:
    """Numbered statistics text per topic, for prompts.

    A prompt carries at most ``max_lines`` lines, so a long list is cut into
    several consecutive ones; the numbers run on, and every statistic is in
    exactly one list.
    """
    lines = topic_statistics(statistics, keywords).withColumns(
        {"line": stat_line(F.col("stat_index")), "list_no": F.floor(F.col("stat_index") / max_lines)}
    )
    texts = lines.groupBy("topic_key", "list_no").agg(
        F.sort_array(F.collect_list(F.struct("stat_index", "line"))).alias("l")
    )
    return texts.select(
        "topic_key", "list_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("stat_lines")
    )


def extraction_prompts(transcripts: DataFrame, template: str, topics: Sequence[str]) -> DataFrame:
    """Prompts of every transcript; ``template`` holds the marks {topics} and {transcript}.

    A transcript longer than one prompt gives one prompt per part, so the whole
    text is read.
    """
    head = template.replace("{topics}", "\n".join("- " + t for t in topics))
    before, _, after = head.partition("{transcript}")
    parts = transcripts.select("*", F.posexplode(transcript_parts(F.col("segments"))).alias("part_no", "_part"))
    return parts.withColumn("prompt", F.concat(F.lit(before), F.col("_part"), F.lit(after))).drop("_part")


def adjudication_prompts(
    claims: DataFrame, statistics: DataFrame, template: str, keywords: Keywords = CHECKED_TOPICS
) -> DataFrame:
    """Prompt per claim and statistics list of its topic; marks {claim}, {quote} and {stats}."""
    lists = broadcast_if_small(stat_lists(statistics, keywords))
    routed = claims.withColumn("topic_key", topic_key(F.col("topic"), keywords)).join(lists, "topic_key")
    prompt = F.lit(template)
    for mark, value in (("{claim}", "claim"), ("{quote}", "quote"), ("{stats}", "stat_lines")):
        prompt = F.replace(prompt, F.lit(mark), F.coalesce(F.col(value), F.lit("")))
    return routed.withColumn("prompt", prompt).drop("stat_lines")


def generate(prompts: DataFrame, gen: Callable[[str], str | None]) -> DataFrame:
    """Run the caller's generator over ``prompt``; a failed call gives a null answer."""
    columns = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                try:
                    answers.append(gen(prompt))
                except Exception:  # noqa: BLE001 - the row is retried or dropped by the caller
                    answers.append(None)
            yield batch.assign(answer=answers)[[*columns, "answer"]]

    schema = StructType([*prompts.schema.fields, StructField("answer", StringType())])
    return prompts.mapInPandas(run, schema)


#: The first bracketed region of a text.
JSON_REGION = r"(?s)(\[.*\]|\{.*\})"


# --- answers -------------------------------------------------------------------------------
def json_candidates(answer: Column) -> list[Column]:
    """Places JSON may hide in model text: the fenced block, the whole text, the first bracketed region."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    fenced = F.trim(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)```", 1), F.lit("")))
    whole = F.coalesce(fenced, text)
    region = F.nullif(F.regexp_extract(whole, JSON_REGION, 1), F.lit(""))
    return [whole, region]


def parse_json(answer: Column, schema: str) -> Column:
    """First candidate that is valid JSON, read with ``schema``; null when none is."""
    from_candidates = [
        F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)) for c in json_candidates(answer)
    ]
    return F.coalesce(*from_candidates)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.

    They come out of a generator, which the optimizer neither repeats in later
    columns nor moves filters through; a plain column of a costly expression is
    copied into every place that reads it.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select(*df.columns, "_once.*")


def recovered(answers: DataFrame) -> DataFrame:
    """Answers with ``_json``, the valid JSON text hidden in each, and ``_variant``, its parsed value; null when none."""
    rows = once(answers, _whole=json_candidates(F.col("answer"))[0])
    whole, region = F.col("_whole"), F.nullif(F.regexp_extract("_whole", JSON_REGION, 1), F.lit(""))
    rows = once(rows, _first=F.try_parse_json(whole), _region=region)
    known = F.col("_first").isNotNull()
    rows = once(
        rows,
        _variant=F.when(known, F.col("_first")).otherwise(F.try_parse_json("_region")),
        _text=F.when(known, F.col("_whole")).otherwise(F.col("_region")),
    )
    text = F.when(F.col("_variant").isNotNull(), F.col("_text"))
    return rows.withColumn("_json", text).drop("_whole", "_first", "_region", "_text")


CLAIM_LIST = "array<struct<quote:string,topic:string,claim:string,approx_seconds:int>>"
VERDICT = "struct<outcome:string,confidence:double,reason:string>"


def parse_claims(answers: DataFrame) -> DataFrame:
    """Extracted claims, one row each; an object that wraps a list is unwrapped."""
    wrapped = F.from_json(F.col("_json"), "map<string,string>")
    inner = F.get(F.filter(F.map_values(wrapped), lambda v: F.ltrim(v).startswith("[")), 0)
    body = F.when(F.ltrim(F.col("_json")).startswith("["), F.col("_json")).otherwise(inner)
    rows = once(recovered(answers), _list=F.from_json(body, CLAIM_LIST))
    return rows.select(*[c for c in answers.columns if c not in ("answer", "prompt")], F.inline("_list"))


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """Verdict fields; anything that is not an object is unverifiable, and only a JSON integer is an index."""
    text = F.col("_json")
    parsed = F.when(F.ltrim(text).startswith("{"), F.from_json(text, VERDICT))
    found = F.try_variant_get("_variant", "$.stat_index", "variant")
    index = F.when(F.schema_of_variant(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))
    rows = once(recovered(answers), _verdict=parsed, _index=index)
    verdict, index = F.col("_verdict"), F.col("_index")
    return rows.select(
        *[c for c in answers.columns if c not in ("answer", "prompt", "topic_key")],
        F.coalesce(verdict["outcome"], F.lit("unverifiable")).alias("outcome"),
        index.alias("stat_index"),
        verdict["confidence"].alias("confidence"),
        verdict["reason"].alias("reason"),
    )


def one_verdict(verdicts: DataFrame, claim: Sequence[str]) -> DataFrame:
    """One verdict per claim whose statistics went over several lists.

    A decisive verdict comes before an unverifiable one, then the more confident
    one, then the one on the earlier list.
    """
    decisive = F.col("outcome").isin("contradicted", "consistent").cast("int")
    order = [F.desc("_decisive"), F.desc_nulls_last("confidence"), "list_no"]
    return top_rows(verdicts.withColumn("_decisive", decisive), claim, order).drop("_decisive", "list_no")


def parse_segments(text: Column) -> Column:
    """Transcribed segments from model text, malformed rows skipped."""
    body = F.trim(text)
    block = F.regexp_extract(body, r"(?s)^```(?:[ \t\r\n]*[jJ][sS][oO][nN])?(.*?)(?:```|$)", 1)
    body = F.when(body.startswith("```"), block).otherwise(body)
    rows = F.from_json(body, "array<struct<start:string,end:string,text:string>>")
    good = F.filter(
        rows,
        lambda r: r["start"].try_cast("double").isNotNull()
        & r["end"].try_cast("double").isNotNull()
        & r["text"].isNotNull(),
    )
    return F.transform(
        good,
        lambda r: F.struct(
            r["start"].try_cast("double").alias("start"),
            r["end"].try_cast("double").alias("end"),
            F.trim(r["text"]).alias("text"),
        ),
    )


def fact_check(
    transcripts: DataFrame,
    statistics: DataFrame,
    gen: Callable[[str], str | None],
    extract_template: str,
    adjudicate_template: str,
    topics: Sequence[str],
    keywords: Keywords = CHECKED_TOPICS,
) -> tuple[DataFrame, DataFrame]:
    """Candidate findings, and the transcripts whose extraction failed (to retry).

    The generator is not repeatable, so its answers are written to the shared
    folder before they are used twice.
    """
    from factledger.session import cut_lineage

    prompts = extraction_prompts(transcripts, extract_template, topics).drop("segments")
    extracted = cut_lineage(generate(prompts, gen))
    failed = extracted.filter(F.col("answer").isNull()).drop("prompt", "answer")  # names the part to retry
    claims = parse_claims(extracted.filter(F.col("answer").isNotNull()).drop("part_no"))
    judged = cut_lineage(generate(adjudication_prompts(claims, statistics, adjudicate_template, keywords), gen))
    verdicts = one_verdict(parse_verdicts(judged.filter(F.col("answer").isNotNull())), claims.columns)
    return gate_findings(verdicts, statistics, keywords), failed
