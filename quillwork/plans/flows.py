"""Compositions: structuring, exploration, and validated step lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import cleaning, profile, quality, schema, vectors
from ..operators.cleaning import CleaningPlan
from ..scratch import materialise

# Step kinds that a list may hold.
STEP_KINDS = ("structuring", "eda", "labeling", "ai_labeling", "quality_eval", "review", "export",
              "image_embeddings", "clustering")


def structuring(df: DataFrame, plan: CleaningPlan = CleaningPlan()) -> dict[str, DataFrame]:
    """Schema report, cleaned table, cleaning report and quality score. Input and result are written once,
    because every report reads them again."""
    source = materialise(df, "input")
    cleaned, report = cleaning.clean(source, plan)
    cleaned = materialise(cleaned, "cleaned")
    return {"schema": schema.schema_report(source), "cleaned": cleaned, "cleaning": report,
            "quality": quality.score(cleaned)}


def exploration(df: DataFrame, with_profile: bool = True, with_embeddings: bool = False, with_clusters: bool = True,
                k: int = 5, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Profile, text vectors and clusters, each on request."""
    out: dict[str, DataFrame] = {}
    if with_profile:
        out["profile"] = profile.profile(df)
    if with_embeddings and embed is not None:
        out["embeddings"] = embed(df)
    if with_clusters:
        clustered, _ = vectors.kmeans(df, k)
        out["clusters"] = vectors.cluster_sizes(clustered)
    return out


@dataclass(frozen=True)
class Step:
    kind: str
    name: str
    config: dict = field(default_factory=dict)


def check_steps(steps: list[dict]) -> list[Step]:
    """Steps from their definitions; raises ``ValueError`` on the first fault."""
    if not steps:
        raise ValueError("a step list needs at least one step")
    out = []
    for i, s in enumerate(steps):
        if s.get("step_type") not in STEP_KINDS:
            raise ValueError(f"step {i}: unknown step_type {s.get('step_type')!r}")
        if not s.get("name") or not isinstance(s.get("config"), dict):
            raise ValueError(f"step {i}: name and config are required")
        out.append(Step(s["step_type"], s["name"], s["config"]))
    return out


def run_steps(df: DataFrame, steps: list[dict], handlers: dict[str, Callable[[DataFrame, dict], DataFrame | None]]
              ) -> tuple[DataFrame, list[tuple[int, str, str, str]]]:
    """Run steps in order, each on the table the one before left; (table, [(position, name, status, message)]).

    A step without a handler, or a labelling step without rules, is skipped; the first failure ends the run.
    """
    report = []
    for i, step in enumerate(check_steps(steps)):
        handler = handlers.get(step.kind)
        if handler is None or (step.kind == "labeling" and not step.config.get("rules")):
            report.append((i, step.name, "skipped", "not configured"))
            continue
        try:
            result = handler(df, step.config)
            df = df if result is None else result
            report.append((i, step.name, "completed", ""))
        except Exception as e:  # noqa: BLE001
            report.append((i, step.name, "failed", str(e)))
            break
    return df, report
