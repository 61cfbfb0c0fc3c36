"""Checks of generated answers: parse, match, dedupe, and keep the rejects apart."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import reads_as_recommendation, starts_with_party

THREAT_ANSWER = "array<struct<subject_topic:string,conditions:array<struct<falsifies_condition:string,no_threat_rationale:string,threats:array<struct<description:string,controlled_by:string,evidence_topics:array<string>>>>>>>"
VERDICT_ANSWER = "array<struct<invariant_topic:string,verdict:string,rationale:string>>"


def parse(answers: DataFrame, schema: str) -> DataFrame:
    """answers(batch, body) -> (batch, item_pos, item); an unreadable body gives no row."""
    return answers.select("batch", F.posexplode(F.from_json("body", schema)).alias("item_pos", "item")).filter("item is not null")


def split_rejects(rows: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason)."""
    marked = rows.withColumn("reject", reason)
    return marked.filter("reject is null").drop("reject"), marked.filter("reject is not null")


def first_subject(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Marks the first row of each key and batch."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("batch", key).orderBy(*order)))


def threats(answers: DataFrame, subjects: DataFrame, conditions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threats, rejects).

    subjects(batch, subject); conditions(subject, condition); evidence(subject,
    node): nodes of the subject's function. A subject must be expected and
    comes once; a condition must be on its subject; a condition has threats or
    a rationale, not both and not none; an empty text goes; evidence outside
    the function goes, and without any left the subject is the evidence.
    """
    items = parse(answers, THREAT_ANSWER).select("batch", "item_pos", F.col("item.subject_topic").alias("subject"), F.col("item.conditions").alias("conditions"))
    items = first_subject(items, "subject", ["item_pos"]).join(subjects.select("batch", "subject", F.lit(True).alias("_known")), ["batch", "subject"], "left")
    reason = F.when(~F.col("subject").rlike(r"^N-?\d+$") | F.col("subject").isNull(), "bad subject").when(F.col("_known").isNull(), "unexpected subject").when(F.col("_n") > 1, "repeated subject")
    good, lost = split_rejects(items, reason)
    rows = good.select("batch", "subject", "item_pos", F.posexplode("conditions").alias("cond_pos", "c"))
    rows = rows.select("batch", "subject", "item_pos", "cond_pos", F.col("c.falsifies_condition").alias("condition"), F.col("c.threats").alias("threats"), F.nullif(F.trim("c.no_threat_rationale"), F.lit("")).alias("rationale"))
    rows = rows.join(conditions.select("subject", "condition", F.lit(True).alias("_on")), ["subject", "condition"], "left")
    n = F.coalesce(F.size("threats"), F.lit(0))
    reason = F.when(F.col("_on").isNull(), "condition not on subject").when((n > 0) & F.col("rationale").isNotNull(), "threats and rationale").when((n <= 0) & F.col("rationale").isNull(), "neither threats nor rationale")
    fine, lost2 = split_rejects(rows, reason)
    each = fine.select("batch", "subject", "condition", "item_pos", "cond_pos", F.posexplode("threats").alias("threat_pos", "t")).select("batch", "subject", "condition", "item_pos", "cond_pos", "threat_pos", F.trim("t.description").alias("description"), F.col("t.controlled_by").alias("controlled_by"), F.col("t.evidence_topics").alias("evidence"))
    reason = F.when(F.coalesce("description", F.lit("")) == "", "empty text").when(starts_with_party(F.col("description")), "names a party")
    kept, lost3 = split_rejects(each, reason)
    cited = kept.select("batch", "subject", "condition", "threat_pos", F.explode_outer("evidence").alias("node")).join(evidence, ["subject", "node"], "left_semi").groupBy("batch", "subject", "condition", "threat_pos").agg(F.array_sort(F.collect_set("node")).alias("cited"))
    out = kept.drop("evidence").join(cited, ["batch", "subject", "condition", "threat_pos"], "left").withColumn("evidence", F.coalesce("cited", F.array("subject"))).drop("cited")
    rejects = lost.select("batch", "subject", "reject").unionByName(lost2.select("batch", "subject", "reject")).unionByName(lost3.select("batch", "subject", "reject"))
    return out.select("batch", "subject", "condition", "description", "controlled_by", "evidence"), rejects


def verdicts(answers: DataFrame, invariants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejects): one for each expected invariant, the first wins, an empty rationale goes."""
    rows = parse(answers, VERDICT_ANSWER).select("batch", "item_pos", F.col("item.invariant_topic").alias("invariant"), F.col("item.verdict").alias("verdict"), F.nullif(F.trim("item.rationale"), F.lit("")).alias("rationale"))
    rows = first_subject(rows, "invariant", ["item_pos"]).join(invariants.select("batch", "invariant", F.lit(True).alias("_known")), ["batch", "invariant"], "left")
    reason = F.when(F.col("_known").isNull(), "unexpected").when(F.col("_n") > 1, "repeated").when(~F.coalesce(F.col("verdict").isin("present", "partial", "absent"), F.lit(False)), "bad verdict").when(F.col("rationale").isNull(), "empty rationale")
    good, lost = split_rejects(rows, reason)
    return good.select("batch", "invariant", "verdict", "rationale"), lost.select("batch", "invariant", "reject")


def descriptions(rows: DataFrame, text: str) -> DataFrame:
    """Flags of an invariant's text: names a party, recommends."""
    return rows.withColumn("names_party", starts_with_party(F.col(text))).withColumn("recommends", reads_as_recommendation(F.col(text)))


def merge_cited(groups: DataFrame, cited: DataFrame) -> DataFrame:
    """groups(group, idx, docs, source) and cited(group, idx): the sorted union of cited docs, the first entry's if none is valid, and the highest source."""
    used = groups.join(cited.distinct(), ["group", "idx"], "left_semi").groupBy("group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    first = groups.groupBy("group").agg(F.min_by("docs", "idx").alias("first"), F.max(F.when(F.col("source") == "mechanical", 1).otherwise(0)).alias("_m"))
    return first.join(used, "group", "left").select("group", F.coalesce("docs", "first").alias("docs"), F.when(F.col("_m") == 1, "mechanical").otherwise("bm25").alias("source"))


class Refused(Exception):
    """A completion call that may be tried again (429, 502, 503, 504 or an error body), after `wait` seconds if the service named them."""

    def __init__(self, wait: float | None = None):
        super().__init__("the service is busy")
        self.wait = wait


def annotate(requests: DataFrame, complete: Callable[[str], str], *, retries: int = 5, most_wait: float = 60.0, at_once: int = 10, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests(batch, prompt) -> (batch, body, error) by a completion function.

    At most `at_once` calls run at a time: one for each of so many partitions.
    A Refused or OSError is tried again up to `retries` times after the named
    time or 2**n seconds, `most_wait` at most; then the body is null and the
    error says why. Any other exception fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for prompt in pdf.prompt:
                body, error = None, None
                for n in range(retries + 1):
                    try:
                        body, error = complete(prompt), None
                        break
                    except (Refused, OSError) as x:
                        error = f"{type(x).__name__}: {x}"
                        if n < retries:
                            wait = getattr(x, "wait", None)
                            sleep(min(most_wait, 2.0**n if wait is None else wait))
                out.append(body)
                errors.append(error)
            yield pd.DataFrame({"batch": pdf.batch, "body": out, "error": errors})

    return requests.select("batch", "prompt").coalesce(at_once).mapInPandas(run, f"batch {requests.schema['batch'].dataType.simpleString()}, body string, error string")
