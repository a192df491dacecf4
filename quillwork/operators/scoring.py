"""Batch scoring with a user-supplied classifier, prompts, response parsing.

A classifier factory is called once per task (so a model loads once) and returns a function
``(items, labels) -> [(label, confidence, reasoning), ...]``. A failing batch is retried row by row and a
failing row becomes a row with an empty label and the reason, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..scratch import balance

Scores = list[tuple[str, float, str]]
Factory = Callable[[], Callable[[Sequence, Sequence[str]], Scores]]

RESPONSE_SCHEMA = "label string, confidence string, reasoning string, _bad string"


def keyword_classifier() -> Callable[[Sequence, Sequence[str]], Scores]:
    """Default scorer: the first label named in the text, sure in proportion to how few others are named."""
    def score(items: Sequence, labels: Sequence[str]) -> Scores:
        out = []
        for item in items:
            text = item.decode("utf-8", "replace") if isinstance(item, bytes) else str(item)
            named = [label for label in labels if label.lower() in text.lower()]
            out.append((named[0], 1.0 / len(named), "named in the text") if named else ("", 0.0, "no label named"))
        return out
    return score


def prompt(text: Column, labels: Sequence[str], instructions: str | None = None,
           examples: Sequence[dict] = ()) -> Column:
    """Request text per row: the fixed part is a literal, only the row's text is joined in."""
    lines = [f"Choose exactly one label for the text. Labels: {', '.join(labels)}", ""]
    if instructions and instructions.strip():
        lines += [f"Instructions: {instructions.strip()}", ""]
    if examples:
        lines += ["Examples:"] + [f"- \"{e.get('text', '')}\" is \"{e.get('label', '')}\"" for e in examples] + [""]
    return F.concat(F.lit("\n".join(lines) + "\nText:\n"), F.coalesce(text, F.lit("")),
                    F.lit("\n\nAnswer in JSON with label, confidence and reasoning."))


def parse_response(content: Column, labels: Sequence[str]) -> Column:
    """struct<label, confidence, reasoning>; unknown labels become NULL, confidence is kept within 0..1."""
    text = strip(F.coalesce(content, F.lit("")))
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.startswith(strip(line), F.lit("```")))
    body = F.when(F.startswith(text, F.lit("```")), F.array_join(lines, "\n")).otherwise(text)
    parsed = F.from_json(body, RESPONSE_SCHEMA, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    number = F.when(parsed["confidence"].isNull(), F.lit(0.0)).otherwise(parsed["confidence"].try_cast("double"))
    broken = parsed.isNull() | parsed["_bad"].isNotNull() | number.isNull() | (body == "")
    allowed = F.lower(parsed["label"]).isin([x.lower() for x in labels])
    return F.struct(
        F.when(~broken & allowed, parsed["label"]).alias("label"),
        F.when(broken, 0.0).otherwise(F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0))).alias("confidence"),
        F.when(broken, "Parse error").otherwise(F.coalesce(parsed["reasoning"], F.lit(""))).alias("reasoning"))


def classify(df: DataFrame, item: str, labels: Sequence[str], factory: Factory = keyword_classifier,
             tasks: int | None = None) -> DataFrame:
    """``df`` plus predicted_label, confidence, reasoning.

    ``item`` may hold text or bytes. ``tasks`` spreads slow model calls over more tasks than the scan has.
    """
    labels = list(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for batch in batches:
            items = list(batch[item])
            try:
                found = list(score(items, labels))
                if len(found) != len(items):
                    raise ValueError("wrong number of results")
            except Exception:  # noqa: BLE001
                found = []
                for one in items:
                    try:
                        found.append(score([one], labels)[0])
                    except Exception as e:  # noqa: BLE001
                        found.append(("", 0.0, f"Classification error: {e}"))
            yield batch.assign(predicted_label=[f[0] or "" for f in found],
                               confidence=[float(f[1]) for f in found], reasoning=[str(f[2]) for f in found])

    schema = T.StructType(df.schema.fields + [
        T.StructField("predicted_label", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType())])
    return (df.repartition(tasks) if tasks else balance(df)).mapInPandas(run, schema)


def scoring_report(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total_items"),
                      F.count_if(F.col("predicted_label") != "").alias("labeled"),
                      F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"))


def preview(df: DataFrame, item: str, labels: Sequence[str], order_by: str, n: int = 3,
            factory: Factory = keyword_classifier) -> DataFrame:
    """The first ``n`` (1-10) non-missing items only, cut before any scoring."""
    if not 1 <= n <= 10:
        raise ValueError("n must be 1..10")
    return classify(df.filter(F.col(item).isNotNull()).orderBy(order_by).limit(n), item, labels, factory)
