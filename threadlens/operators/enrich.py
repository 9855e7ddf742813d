"""Transcripts within a budget, prompt templates, and the classify and summarise flows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import run_prompts
from ..functions.scalars import candidate_branches, summary, utc_text, verdict
from . import store


def within_budget(chunks: DataFrame, mode: str = "tail", budget: int | None = None) -> DataFrame:
    """A session's chunks from its head or tail while their tokens fit; the first that does not fit ends it."""
    if mode == "full" or not budget or budget <= 0:
        return chunks
    order = F.asc("start_seq") if mode == "head" else F.desc("start_seq")
    return chunks.withColumn("_sum", F.sum("approx_tokens").over(Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")


def transcripts(chunks: DataFrame, sessions: DataFrame, mode: str = "tail", budget: int | None = None) -> DataFrame:
    """(session_id, transcript) for every session."""
    parts = within_budget(chunks, mode, budget).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_seq", "text"))).alias("p"))
    whole = parts.select("session_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("transcript"))
    return sessions.select(F.col("id").alias("session_id")).join(whole, "session_id", "left").withColumn("transcript", F.coalesce("transcript", F.lit("(no transcript)")))


_VARIABLE = re.compile(r"\{\{\s*(\w+)\s*(?:\|\s*truncate\((\d+)\))?\s*\}\}")


def variables() -> dict[str, Column]:
    """The twelve values a template may name, from a session joined with its transcript."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {
        "session_id": F.col("id"), "cwd": text("cwd"), "git_branch": text("git_branch"), "derived_branches": F.coalesce(F.array_join("derived_branches", ", "), F.lit("")),
        "candidate_branches": F.array_join(candidate_branches(F.col("git_branch"), F.col("derived_branches")), ", "), "started_at": utc_text("started_at"), "ended_at": utc_text("ended_at"),
        "message_count": text("message_count"), "turn_count": text("turn_count"), "first_user_message": text("first_user_text"), "last_user_message": text("last_user_text"), "transcript": text("transcript"),
    }


def render(template: str) -> Column:
    """A template compiled into one concatenation; unknown names stay as they are."""
    known, parts, last = variables(), [], 0
    for m in _VARIABLE.finditer(template):
        value = known.get(m[1], F.lit("{{" + m[1] + "}}"))
        if m[2]:
            n = int(m[2])
            value = F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("…"))).otherwise(value)
        parts += [F.lit(template[last : m.start()]), value]
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))


@dataclass(frozen=True)
class Recipe:
    id: str
    prompt: str
    name: str = ""
    mode: str = "transcript"
    model: str = ""
    allowed_tools: tuple[str, ...] = ()
    status_map: dict[str, str] = field(default_factory=dict)
    transcript_max_tokens: int | None = None
    transcript_mode: str = "tail"


def parse_recipe(text: str) -> Recipe:
    """A recipe from YAML: id and prompt are required, unknown keys are ignored."""
    import yaml

    data = yaml.safe_load(text)
    if not isinstance(data, dict) or not data.get("id") or not data.get("prompt"):
        raise ValueError("a recipe needs an id and a prompt")
    known = {k: v for k, v in data.items() if k in Recipe.__dataclass_fields__ and v is not None}
    return Recipe(**known | {"allowed_tools": tuple(known.get("allowed_tools", ()))})


def load_recipes(folder: str) -> tuple[list[Recipe], dict[str, str]]:
    """(recipes, problems by file): bad files are reported and skipped."""
    found, bad = [], {}
    for f in sorted(Path(folder).glob("*.yaml")) if Path(folder).is_dir() else []:
        try:
            found.append(parse_recipe(f.read_text()))
        except Exception as e:  # any unreadable file is a report, not an end
            bad[f.name] = str(e)
    return found, bad


def find_recipe(folder: str, recipe_id: str) -> Recipe:
    return parse_recipe((Path(folder) / f"{recipe_id}.yaml").read_text())


BUILT_IN = {
    "resolved": """id: resolved
name: Is the work finished?
prompt: |
  Session {{ session_id }} in {{ cwd }} on {{ git_branch }}, {{ turn_count }} turns.
  {{ transcript }}
  Is the work in it finished? Answer with JSON: {"status": "resolved" or "open", "evidence": "one sentence"}
status_map: {resolved: completed}
transcript_max_tokens: 4000
transcript_mode: tail
""",
    "merged": """id: merged
name: Is the branch merged?
mode: agent
allowed_tools: [Bash]
prompt: |
  Look in {{ cwd }} whether one of these branches is merged: {{ candidate_branches }}.
  Answer with JSON: {"status": "merged" or "unmerged", "evidence": "one sentence"}
status_map: {merged: completed}
""",
}


def write_built_in(folder: str) -> list[str]:
    """Write the packaged recipes that are missing."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    new = [k for k in BUILT_IN if not (Path(folder) / f"{k}.yaml").exists()]
    for k in new:
        (Path(folder) / f"{k}.yaml").write_text(BUILT_IN[k])
    return new


def recipes_table(spark, recipes: list[Recipe]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name, r.mode, r.model) for r in recipes], "recipe_id string, name string, mode string, model string")


def classify(sessions: DataFrame, chunks: DataFrame, recipe: Recipe, runner: Callable | None, now: Column | None = None) -> DataFrame:
    """Rows of the classifications table; with runner None (a dry run) the rendered prompts."""
    text = transcripts(chunks, sessions, recipe.transcript_mode, recipe.transcript_max_tokens).withColumnRenamed("session_id", "id")
    prompts = sessions.join(text, "id").select(F.col("id").alias("session_id"), render(recipe.prompt).alias("prompt"))
    if runner is None:
        return prompts
    answers = run_prompts(prompts, "prompt", "answer", runner)
    status, evidence = verdict(F.col("answer"))
    when = now if now is not None else F.current_timestamp()
    return answers.where("answer is not null").select("session_id", F.lit(recipe.id).alias("recipe_id"), when.alias("ts"), status.alias("status"), evidence.alias("evidence"), F.lit(recipe.model).alias("model"), F.col("answer").alias("raw_json"))


SUMMARY_PROMPT = """Summarise session {{ session_id }} ({{ turn_count }} turns in {{ cwd }}).
{{ transcript }}
Answer with JSON: {"title": "...", "short": "one sentence", "long": "a paragraph"}
"""


def summarise(sessions: DataFrame, chunks: DataFrame, runner: Callable, model: str = "", budget: int = 8000, now: Column | None = None) -> DataFrame:
    """The sessions table with new summaries; answers that cannot be read change nothing."""
    text = transcripts(chunks, sessions, "tail", budget).withColumnRenamed("session_id", "id")
    prompts = sessions.join(text, "id").select(F.col("id").alias("session_id"), render(SUMMARY_PROMPT).alias("prompt"))
    answers = run_prompts(prompts, "prompt", "answer", runner).select("session_id", summary(F.col("answer")).alias("summary"))
    return store.set_summaries(sessions, answers, model, now)


def synthesis_prompt(rows: DataFrame, start: str, end: str, limit: int | None = 80) -> DataFrame:
    """One row: the activity report's prompt, a line a session in order of activity, of the report's first `limit` sessions or of all; null if there are none."""
    at = F.coalesce("last_active_at", "started_at")
    rows = rows if limit is None else rows.orderBy(at, "id").limit(limit)
    line = F.concat(F.lit("- ["), F.coalesce(F.date_format(at, "MM-dd HH:mm"), F.lit("?")), F.lit("] "), F.coalesce("cwd", "project_path"), F.lit(" ("), F.coalesce("git_branch", F.lit("-")),
        F.lit(", "), F.col("turn_count").cast("string"), F.lit("t): "), F.coalesce("summary_title", F.lit("(no title)")), F.when(F.coalesce("summary_short", F.lit("")) != "", F.concat(F.lit("\n    "), "summary_short")).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct(at.alias("at"), "id", line.alias("line"))))
    head, tail = f"Activity from {start} to {end}.\n\nSummaries of the sessions:\n\n", "\n\nWrite two to four flowing paragraphs grouped by theme: main lines of work, decisions, what landed and what is open."
    prompt = F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(tail))
    return rows.agg(F.when(F.count(F.lit(1)) > 0, prompt).alias("prompt"))
