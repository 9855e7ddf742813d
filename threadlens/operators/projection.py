"""Events to turns, turns to chunks, and what a session is.

Windows and aggregates are keyed by session, so a session's events are shuffled once; text is touched only where needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import approx_tokens, block_text, not_blank, slash_command
from ..schemas import PROVIDER_B
from ..sources.transcripts import file_stem

TARGET_TOKENS, OVERLAP = 1200, 1
TURN_JOIN, BLOCK_JOIN = "\n\n---\n\n", "\n\n"
_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def user_text(blocks: Column) -> Column:
    """A user event's prompt; null if it only feeds tool results back."""
    return slash_command(block_text(blocks, "\n"))


def render_turn(user: Column, assistant: Column) -> Column:
    return F.when(not_blank(assistant), F.concat(F.lit("USER: "), F.coalesce(user, F.lit("")), F.lit("\n\nASSISTANT: "), assistant)).otherwise(F.concat(F.lit("USER: "), F.coalesce(user, F.lit(""))))


def _turn_columns(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("anchor")
    return df.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).select(
        "session_id", "seq", "user_text", "assistant_text", "user_ts", "assistant_ts", approx_tokens(render_turn(F.col("user_text"), F.col("assistant_text"))).alias("approx_tokens"))


def turns_a(events: DataFrame) -> DataFrame:
    """Format A: a turn for each real prompt; prose after a tool-result event is dropped until the next prompt."""
    order = Window.partitionBy("session_id").orderBy("seq")
    is_user, is_assistant = F.col("type") == "user", F.col("type") == "assistant"
    anchored = events.where(is_user | is_assistant).withColumn("anchor", F.last(F.when(is_user, F.col("seq")), ignorenulls=True).over(order.rowsBetween(*_BEFORE))).where("anchor is not null")
    prose = F.when(is_assistant, block_text(F.col("blocks"), BLOCK_JOIN))
    parts = F.array_sort(F.collect_list(F.when(prose.isNotNull(), F.struct("seq", prose.alias("text")))))
    turns = anchored.groupBy("session_id", "anchor").agg(
        F.max(F.when(is_user, user_text(F.col("blocks")))).alias("user_text"),
        F.max(F.when(is_user, F.col("ts"))).alias("user_ts"),
        F.min_by("ts", F.when(is_assistant & F.col("ts").isNotNull(), F.col("seq"))).alias("assistant_ts"),
        F.array_join(F.transform(parts, lambda p: p["text"]), BLOCK_JOIN).alias("assistant_text"),
    )
    return _turn_columns(turns.where("user_text is not null"))


def turns_b(events: DataFrame) -> DataFrame:
    """Format B: a turn for each assistant message, the first after a prompt carrying it; an unanswered prompt is a turn too."""
    order = Window.partitionBy("session_id").orderBy("seq")
    is_user, is_assistant = F.col("type") == "user", F.col("type") == "assistant"
    prose = F.when(is_assistant, block_text(F.col("blocks"), BLOCK_JOIN))
    rows = events.where(is_user | is_assistant).withColumn("prose", prose).where(is_user | F.col("prose").isNotNull())
    rows = rows.withColumn("before", F.lag("type").over(order)).withColumn("after", F.lead("type").over(order))
    asked = F.coalesce(user_text(F.col("blocks")), F.lit(""))
    last_prompt = F.last(F.when(is_user, F.struct(asked.alias("text"), "ts")), ignorenulls=True).over(order.rowsBetween(*_BEFORE))
    rows = rows.withColumn("prompt", last_prompt)
    first_reply = is_assistant & (F.col("before") == "user")
    unanswered = is_user & ~F.coalesce(F.col("after") == "assistant", F.lit(False))
    turns = rows.where(is_assistant | unanswered).select(
        "session_id", F.col("seq").alias("anchor"),
        F.when(first_reply | unanswered, F.col("prompt.text")).otherwise("").alias("user_text"), F.coalesce("prose", F.lit("")).alias("assistant_text"),
        F.when(first_reply | unanswered, F.col("prompt.ts")).alias("user_ts"), F.when(is_assistant, F.col("ts")).alias("assistant_ts"))
    return _turn_columns(turns)


def chunk_windows(tokens: Column, target: int = TARGET_TOKENS, overlap: int = OVERLAP) -> Column:
    """Turn windows (first, last) packed greedily to the target: one pass over an array of token counts.

    A window restarts one turn back if that turn and the next fit together and the old window held more than one.
    """
    if overlap not in (0, 1):
        raise ValueError("the fold keeps one turn of overlap; use chunk_windows_any for more")

    def step(s: Column, x: Column) -> Column:
        fits = (s["k"] == s["start"]) | (s["tokens"] + x <= target)
        back = F.lit(overlap == 1) & (s["k"] - s["start"] > 1) & (s["prev"] + x <= target)
        window = F.struct(s["start"].alias("first"), (s["k"] - 1).alias("last"))
        return F.struct(
            F.when(fits, s["start"]).when(back, s["k"] - 1).otherwise(s["k"]).alias("start"),
            (s["k"] + 1).alias("k"),
            F.when(fits, s["tokens"] + x).when(back, s["prev"] + x).otherwise(x).alias("tokens"),
            x.alias("prev"),
            F.when(fits, s["out"]).otherwise(F.concat(s["out"], F.array(window))).alias("out"),
        )

    zero = F.struct(*[F.lit(0).alias(c) for c in ("start", "k", "tokens", "prev")], F.array().cast("array<struct<first:int,last:int>>").alias("out"))
    done = lambda s: F.when(s["k"] > s["start"], F.concat(s["out"], F.array(F.struct(s["start"].alias("first"), (s["k"] - 1).alias("last"))))).otherwise(s["out"])
    return F.aggregate(tokens, zero, step, done)


def chunk_windows_any(tokens: list[int], target: int = TARGET_TOKENS, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """The same windows by two pointers, for any overlap."""
    first = 0
    while first < len(tokens):
        last, total = first, tokens[first]
        while last + 1 < len(tokens) and total + tokens[last + 1] <= target:
            last += 1
            total += tokens[last]
        yield first, last
        if last + 1 >= len(tokens):
            return
        restart, room = last + 1, target - tokens[last + 1]
        for back in range(1, overlap + 1):
            if last + 1 - back <= first or sum(tokens[last + 1 - back : last + 1]) > room:
                break
            restart = last + 1 - back
        first = restart


def chunks(turns: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of consecutive turns with text, times and tokens."""
    turn = F.struct("seq", "approx_tokens", "user_ts", "assistant_ts", render_turn(F.col("user_text"), F.col("assistant_text")).alias("text"))
    packed = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    if overlap in (0, 1):
        packed = packed.withColumn("w", chunk_windows(F.transform("t", lambda x: x["approx_tokens"]), target, overlap))
    else:

        @F.pandas_udf("array<struct<first:int,last:int>>")
        def windows(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda t: [{"first": a, "last": b} for a, b in chunk_windows_any(list(t), target, overlap)])

        packed = packed.withColumn("w", windows(F.transform("t", lambda x: x["approx_tokens"])))
    one = packed.select("session_id", "t", F.explode("w").alias("w")).select("session_id", F.slice("t", F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1).alias("t"))
    head, tail = F.element_at("t", 1), F.element_at("t", -1)
    return one.select(
        F.xxhash64("session_id", head["seq"], tail["seq"]).alias("id"), "session_id", head["seq"].alias("start_seq"), tail["seq"].alias("end_seq"),
        head["user_ts"].alias("start_ts"), F.coalesce(tail["assistant_ts"], tail["user_ts"]).alias("end_ts"),
        F.array_join(F.transform("t", lambda x: x["text"]), TURN_JOIN).alias("text"),
        F.aggregate("t", F.lit(0), lambda s, x: s + x["approx_tokens"]).alias("approx_tokens"))


def first_of(value: str, order: str = "seq") -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def last_of(value: str, order: str = "seq") -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def session_keys(events: DataFrame) -> DataFrame:
    """session_id for every event: the file's first own id, else the file's stem (a rollout's first UUID in it)."""
    stem = file_stem(F.col("path"))
    uuid = F.regexp_extract(stem, "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", 0)
    own = F.first("event_session", ignorenulls=True).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return events.withColumn("session_id", F.coalesce(own, F.when((F.col("provider") == PROVIDER_B) & (uuid != ""), uuid), stem))


def session_meta(events: DataFrame) -> DataFrame:
    """One row a session: first known folder and branch, first and last time in file order, message count, label."""
    label = F.when(F.col("provider") == PROVIDER_B, F.coalesce(F.nullif(F.element_at(F.split(F.col("cwd"), "/"), -1), F.lit("")), F.lit(PROVIDER_B))).otherwise(F.element_at(F.split("path", "/"), -2))
    return (
        events.groupBy("session_id")
        .agg(
            F.max("path").alias("source_path"), F.max("provider").alias("provider"), F.max("account").alias("account"),
            first_of("cwd").alias("cwd"), first_of("git_branch").alias("git_branch"), first_of("ts").alias("started_at"), last_of("ts").alias("ended_at"),
            F.count_if(F.col("type").isin("user", "assistant")).cast("int").alias("message_count"),
        )
        .withColumn("path", F.col("source_path")).withColumn("project_path", label).drop("path")
    )


def last_active(turns: DataFrame) -> DataFrame:
    """Per session the turn count, first and last prompt (500 characters), and when it was last answered or asked."""
    answered = not_blank(F.col("assistant_text")) & F.col("assistant_ts").isNotNull()
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).cast("int").alias("turn_count"),
        F.substring(F.min_by("user_text", "seq"), 1, 500).alias("first_user_text"), F.substring(F.max_by("user_text", "seq"), 1, 500).alias("last_user_text"),
        F.coalesce(F.max_by("assistant_ts", F.when(answered, F.col("seq"))), F.max_by("user_ts", "seq")).alias("last_turn_at"))


#: Names that are no branches.
RESERVED = ("head", "main", "master", "origin", "fetch_head", "orig_head", ".", "..", "list", "prune", "remove", "add")


def _name(word: Column) -> Column:
    """The branch that a word of a command begins with; "" if it begins with none."""
    return F.coalesce(F.regexp_extract(word, "^(?!-)([A-Za-z0-9._/-]*[A-Za-z0-9_])", 1), F.lit(""))


def _named_at(words: Column, i: Column) -> Column:
    """(rank, name) of the branches that a command at word i names; ranks order the ways of naming one."""
    word = lambda k: F.get(words, i + k)
    runs = lambda *names: reduce(and_, [word(k) == n if k else word(0).rlike(rf"(^|\W){n}$") for k, n in enumerate(names)])
    case = lambda test, rank, name: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rank).alias("rank"), name.alias("name")))
    # What follows "git worktree add": options, a folder, a branch; or "-b branch" before the command ends.
    rest = F.slice(words, i + 4, F.size(words))
    options = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, w: F.struct((s["n"] + F.when(s["on"] & w.startswith("-"), 1).otherwise(0)).alias("n"), (s["on"] & w.startswith("-")).alias("on")), lambda s: s["n"])
    # Where the words run out, an option counts as the folder.
    tried = F.transform(F.sequence(options, F.lit(0)), lambda o: _name(F.get(rest, o + 1)))
    added = F.coalesce(F.get(F.filter(tried, lambda n: n != ""), 0), F.lit(""))
    new = F.array_position(rest, "-b").cast("int")
    same = ~F.exists(F.slice(rest, 1, F.greatest(new - 1, F.lit(0))), lambda w: w.rlike("[|;&]"))
    upstream = word(2).isin("-u", "--set-upstream") & (word(3) == "origin")
    found = [
        case(runs("git", "worktree", "add"), 0, added), case(runs("git", "worktree", "add") & (new > 0) & same, 1, _name(F.get(rest, new))),
        case(runs("git", "checkout", "-b"), 2, _name(word(3))), case(runs("git", "switch", "-c"), 3, _name(word(3))), case(runs("git", "switch"), 4, _name(word(2))),
        case(runs("git", "checkout"), 5, _name(word(2))), case(runs("git", "push") & upstream, 6, _name(word(4))), case(runs("gh", "pr", "checkout"), 7, F.regexp_extract(word(3), r"^(\S*\w)", 1)),
    ]
    return F.transform(F.filter(F.array(*found), lambda f: f.isNotNull()), lambda f: F.struct(f["rank"], i.alias("at"), f["name"]))


def branches_in(command: Column) -> Column:
    """Branches that a shell command names, by the way of naming and then by place: its words are read, as a shell would."""

    def read(words: Column) -> Column:  # bound by a lambda, so that the command is split once
        found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _named_at(words, i))))
        names = F.transform(found, lambda f: f["name"])
        hash_, folder, file = r"^[0-9a-f]{7,40}$", r"^(\.{0,2}/|(?i:origin)/)", r"\.[a-zA-Z]{1,4}$"
        return F.filter(names, lambda b: (b != "") & ~F.lower(b).isin(*RESERVED) & ~b.rlike(f"{hash_}|{folder}|{file}"))

    return F.get(F.transform(F.array(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+")), read), 0)


def derived_branches(events: DataFrame, tool: str = "Bash") -> DataFrame:
    """Branches that a session's shell commands name, distinct, in order."""
    parts = F.filter(F.try_variant_get("raw", "$.message.content", "array<variant>"), lambda b: (F.try_variant_get(b, "$.type", "string") == "tool_use") & (F.try_variant_get(b, "$.name", "string") == tool))
    commands = F.filter(F.transform(parts, lambda b: F.try_variant_get(b, "$.input.command", "string")), lambda c: c.isNotNull())
    rows = events.where("type = 'assistant'").select("session_id", "seq", F.flatten(F.transform(commands, branches_in)).alias("names")).where(F.size("names") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "names")))
    return rows.groupBy("session_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda r: r["names"]))).alias("derived_branches"))


def excluded(events: DataFrame, turns: DataFrame, openers: tuple[str, ...] = (), commands: tuple[str, ...] = (), loop: tuple[str, str] | None = None, originators: tuple[str, ...] = (), markers: tuple[str, ...] = (), scan: int = 6) -> DataFrame:
    """(session_id, internal, automated): sessions to leave out of the index.

    internal: the first prompt starts with an opener. automated, format A: started through an SDK, or one of the opening
    turns starts with a command, or both words of `loop` are met there; format B: a sub-agent, a listed originator, or a
    marker in the first prompt. Which openers, commands and originators count is the caller's configuration.
    """
    launched = F.coalesce("entrypoint", "prompt_source").isNotNull() & (F.col("type") == "user")
    started = events.groupBy("session_id").agg(
        F.max("provider").alias("provider"),
        F.min_by(F.struct("entrypoint", "prompt_source"), F.when(launched, F.col("seq"))).alias("launch"),
        F.min_by(F.struct("entrypoint", "subagent"), F.when(F.col("type") == "session_meta", F.col("seq"))).alias("meta"))
    text = F.lower(F.coalesce("user_text", F.lit("")))
    head = F.ltrim(text)
    early = F.col("seq") < scan
    any_of = lambda tests: reduce(or_, tests, F.lit(False))
    seen = turns.groupBy("session_id").agg(
        F.max((F.col("seq") == 0) & any_of([F.coalesce(F.col("user_text").startswith(o), F.lit(False)) for o in openers])).alias("internal"),
        F.max(early & any_of([head.startswith(c.lower()) for c in commands])).alias("commanded"),
        F.max(early & (head.startswith(loop[0].lower()) if loop else F.lit(False))).alias("looped"),
        F.max(early & (text.contains(loop[1].lower()) if loop else F.lit(False))).alias("referred"),
        F.max((F.col("seq") == 0) & any_of([text.contains(m.lower()) for m in markers])).alias("marked"))
    is_b = F.col("provider") == PROVIDER_B
    sdk = F.lower("launch.entrypoint").startswith("sdk") | (F.lower("launch.prompt_source") == "sdk")
    other = F.col("meta.subagent") | F.lower("meta.entrypoint").isin(*[o.lower() for o in originators] or [""])
    yes = lambda c: F.coalesce(c, F.lit(False))
    automated = F.when(is_b, yes(other) | F.col("marked")).otherwise(yes(sdk) | F.col("commanded") | (F.col("looped") & F.col("referred")))
    return started.join(seen, "session_id").select("session_id", (F.col("internal") & ~is_b).alias("internal"), automated.alias("automated"))


def cursor_outcome(excluded_: Column, turn_count: Column) -> Column:
    """-2 for a session left out, -1 without turns, else its last turn's number."""
    return F.when(excluded_, -2).when(F.coalesce(turn_count, F.lit(0)) == 0, -1).otherwise(turn_count - 1).cast("int")
