"""Column expressions: text, tokens, durations, titles, paths, remotes, verdict parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a transcript wraps a slash command, and the parts that go.
COMMAND_NAME = r"(?U)<command-name>\s*(/[\w\-:]+)\s*</command-name>"
COMMAND_BLOCK = r"(?s)<command-[^>]*>.*?</command-[^>]*>"


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, F.lit(False))


def approx_tokens(c: Column) -> Column:
    """A token for each four characters, rounded up; 0 for null and empty."""
    n = F.coalesce(F.length(c), F.lit(0))
    return ((n + 3 - F.pmod(n + 3, F.lit(4))) / 4).cast("int")


def truncate(c: Column, n: int, ellipsis: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def utc_text(c: str) -> Column:
    """A moment as text in UTC, whatever the session's time zone; "" without one."""
    there = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))
    return F.coalesce(F.date_format(there, "yyyy-MM-dd HH:mm:ss'Z'"), F.lit(""))


def slash_command(text: Column) -> Column:
    """A wrapped slash command becomes "/name rest"; other text stays."""

    def read(t: Column) -> Column:  # bound by a lambda, so that the text and its name are worked out once
        name = F.regexp_extract(t, COMMAND_NAME, 1)
        rest = F.regexp_replace(F.regexp_replace(t, COMMAND_BLOCK, ""), r"(?U)^\s+|\s+$", "")
        with_rest = lambda n: F.when(n == "", t).otherwise(F.concat_ws(" ", n, F.nullif(rest, F.lit(""))))
        return F.get(F.transform(F.array(name), with_rest), 0)

    return F.get(F.transform(F.array(text), lambda t: F.when(t.isNotNull(), read(t))), 0)


def block_text(blocks: Column, sep: str, kind: str = "text") -> Column:
    """The non-blank texts of the blocks of a kind, joined; null if there is none."""
    found = F.filter(blocks, lambda b: (b["type"] == kind) & not_blank(b["text"]))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda b: b["text"]), sep))


def duration_label(start: Column, end: Column) -> Column:
    """Compact span: minutes, hours, days to a fortnight, then weeks; "" under a minute or with an end missing."""
    s = (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("long")
    whole = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(s.isNull() | (s < 60), "")
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h")))
        .when(s < 14 * 86400, F.concat(whole(86400), F.lit("d")))
        .otherwise(F.concat(whole(7 * 86400), F.lit("w")))
    )


def project_key(cwd: Column, project_path: Column) -> Column:
    """The last two parts of the working directory, else the project path."""
    parts = F.split(F.regexp_replace(cwd, "/+$", ""), "/")
    return F.when(F.coalesce(cwd != "", F.lit(False)) & (F.size(parts) >= 2), F.array_join(F.slice(parts, -2, 2), "/")).otherwise(project_path)


def display_title(title: Column, short: Column, first_text: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(short, F.lit("")), truncate(F.translate(first_text, "\n", " "), 90, "…"), F.lit("(no prompt)"))


def stats_blurb(turns: Column, duration: Column, cost: Column) -> Column:
    text = F.concat(turns.cast("string"), F.lit("t"), F.when(duration != "", F.concat(F.lit(" · "), duration)).otherwise(""))
    dollars = F.when(cost >= 10, F.format_string("%.0f", cost)).otherwise(F.format_string("%.2f", cost))
    return F.concat(text, F.when(cost > 0.005, F.concat(F.lit(" · $"), dollars)).otherwise(""))


def status_icon(status: Column) -> Column:
    return F.when(status == "completed", "✓").when(status == "archived", "·").otherwise(" ")


def short_cwd(cwd: Column) -> Column:
    return F.when(cwd.isNull(), "").when(F.length(cwd) <= 36, cwd).otherwise(F.concat(F.lit("…"), F.right(cwd, F.lit(35))))


def normal_remote(url: Column) -> Column:
    """Remotes of one repository, however written, become equal: host and path, without scheme, user and ending."""
    place = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z]+://)?(?:git@)?(.*?)/*(?:\.git)?$", 1)
    return F.translate(place, ":", "/")


def project_dir(cwd: Column) -> Column:
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def is_session_id(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def resume_command(cwd: Column, session: Column, program: str) -> Column:
    """cd into the folder and resume, both shell-quoted."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.concat(F.when(cwd.isNotNull(), F.concat(F.lit("cd "), quote(cwd), F.lit(" && "))).otherwise(""), F.lit(f"{program} "), quote(session))


def candidate_branches(recorded: Column, derived: Column) -> Column:
    """Recorded and derived branches, distinct and in order; the default ones only if nothing else remains."""
    every = F.array_distinct(F.filter(F.concat(F.array(recorded), F.coalesce(derived, F.array().cast("array<string>"))), lambda b: F.coalesce(b != "", F.lit(False))))
    real = F.filter(every, lambda b: ~F.lower(b).isin("head", "main", "master"))
    return F.when(F.size(real) > 0, real).otherwise(every)


def first_object(text: Column) -> Column:
    """The first balanced JSON object in a text, aware of strings and escapes; null without one."""
    tail = F.substring(text, F.instr(text, "{"), F.length(text))
    end = _object_end(tail)
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.substring(tail, F.lit(1), end))


#: A whole string, a brace, or a stretch without either; possessive, so that long texts need no stack.
_JSON_PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^"{}]++'


def _object_end(text: Column) -> Column:
    """Length of the balanced object that the text begins with, 0 if it is never closed: a fold over strings, braces and the stretches between."""

    def merge(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        i = s["i"] + F.length(piece)
        new = F.struct(depth.alias("depth"), i.alias("i"), F.when(depth == 0, i).otherwise(F.lit(0)).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(new)

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(_JSON_PIECES), F.lit(0)), zero, merge, lambda s: s["end"])


def verdict(text: Column) -> tuple[Column, Column]:
    """(status, evidence) of a model's answer; without a readable object the trimmed text is the evidence."""
    obj = F.try_parse_json(first_object(text))
    trimmed = F.when(not_blank(text), F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    return F.when(obj.isNotNull(), json_string(obj, "$.status")), F.when(obj.isNotNull(), json_string(obj, "$.evidence")).otherwise(trimmed)


def summary(text: Column) -> Column:
    """struct(title, short, long) if all three are there and not blank, trimmed; else null."""
    obj = F.try_parse_json(first_object(text))
    get = {k: F.trim(json_string(obj, f"$.{k}")) for k in ("title", "short", "long")}
    ok = not_blank(get["title"]) & not_blank(get["short"]) & not_blank(get["long"])
    return F.when(ok, F.struct(*[v.alias(k) for k, v in get.items()]))


def json_string(v: Column, path: str) -> Column:
    """A string member of a variant; null if missing or of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def json_long(v: Column, path: str) -> Column:
    """An integer member of a variant, else 0."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.when(kind == "BIGINT", F.try_variant_get(v, path, "long")), F.lit(0))
