"""Course plans, prompts, and courses as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ERRORS

#: Modules by difficulty; any other has six. Fixed values.
MODULES = {"beginner": 4, "intermediate": 6, "advanced": 8}
OTHER_MODULES, DESCRIPTION_CHARS, PROMPT_TITLES = 6, 500, 8


def module_count(difficulty: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MODULES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, difficulty), F.lit(OTHER_MODULES))


def persona_prompt(topic: Column, description: Column) -> Column:
    return F.concat(F.lit("You know a great deal about "), topic, F.lit(". In short: "), F.coalesce(description, F.lit("")), F.lit(" Say what is certain, and what is not."))


def title_prompt(sources: DataFrame, most: int = PROMPT_TITLES) -> DataFrame:
    """(slug, n_titles, bullets) of each expert's first sources, in order."""
    few = sources.where(F.col("rank") <= most).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t"))
    return few.select("slug", F.size("t").alias("n_titles"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("* "), x["title"])), "\n").alias("bullets"))


def plan(experts: DataFrame, requests: DataFrame) -> DataFrame:
    """(slug, difficulty, focus) requests on experts (topic, description, counts): the number of modules and the prompt."""
    met = requests.join(experts, "slug")
    focus = F.when(F.coalesce(F.length("focus"), F.lit(0)) > 0, F.concat(F.lit("\nFocus on: "), F.col("focus"))).otherwise("")
    n = module_count(F.col("difficulty"))
    prompt = F.concat(
        F.lit("Plan a "), F.col("difficulty"), F.lit(" course about "), F.col("topic"), F.lit("."), focus, F.lit("\nModules: "), n.cast("string"),
        F.lit("\nConcepts known: "), F.col("node_count").cast("string"), F.lit(", relations known: "), F.col("relation_count").cast("string"),
        F.lit("\nSummary: "), F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CHARS),
    )
    return met.select("slug", "topic", "difficulty", "focus", n.alias("n_modules"), prompt.alias("prompt"))


def modules(plans: DataFrame) -> DataFrame:
    """A row for each module of each plan."""
    return plans.select("slug", "topic", "difficulty", F.explode(F.sequence(F.lit(1), F.col("n_modules"))).alias("module_no")).withColumn("module_title", F.concat(F.lit("Part "), F.col("module_no").cast("string"), F.lit(" of "), F.col("topic")))


def rendered(plans: DataFrame) -> DataFrame:
    """A plan as a Markdown course, as the offline writer gives it: deterministic, in the form that ``parsed`` reads."""
    part = lambda i: F.concat(F.lit("## Part "), i.cast("string"), F.lit(" of "), F.col("topic"), F.lit("\nSummary: what part "), i.cast("string"), F.lit(" is about\nConcepts: "), F.col("difficulty"), F.lit(", "), F.col("topic"), F.lit("\n\nText of the part."))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_modules")), part), "\n\n")
    return plans.withColumn("markdown", F.concat(F.lit("# "), F.col("topic"), F.lit("\n\nWhat is coming.\n\n"), body, F.lit("\n\n# Conclusion\n\nThat was it.")))


def deltas(courses: DataFrame, split, markdown: str = "markdown") -> DataFrame:
    """(slug, difficulty, k, delta): a course's pieces from 0; joined, they are its Markdown. ``split`` makes an array of a text column."""
    return courses.select("slug", "difficulty", F.posexplode(split(F.col(markdown))).alias("k", "delta"))


def plain_text(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of pieces (keys, k, delta, error): joined in order as plain text, without frames; a piece with an error
    is the last, and what went wrong stands for it. A course has a few dozen pieces."""
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "delta", "error"))).alias("l"), F.min(F.when(F.col("error").isNotNull(), F.col("k"))).alias("stop"))
    sent = F.transform(F.filter("l", lambda x: F.col("stop").isNull() | (x["k"] <= F.col("stop"))), lambda x: F.when(x["error"].isNotNull(), F.concat(F.lit(ERRORS["course"]), x["error"])).otherwise(x["delta"]))
    return listed.select(*keys, F.array_join(sent, "").alias("text"))


def parsed(courses: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Markdown as a course: title, introduction, modules (title, summary, key_concepts, content, citations), conclusion."""
    whole = F.split(F.col(markdown), "\n\n# Conclusion\n\n", 2)
    parts = F.split(whole[0], "\n\n## ")
    head = parts[0]

    def line(part: Column, name: str) -> Column:
        return F.regexp_extract(part, rf"(?m)^{name}: (.*)$", 1)

    def module(part: Column) -> Column:
        return F.struct(
            F.element_at(F.split(part, "\n"), 1).alias("title"),
            line(part, "Summary").alias("summary"),
            F.filter(F.split(line(part, "Concepts"), ", "), lambda c: c != "").alias("key_concepts"),
            F.array_join(F.slice(F.split(part, "\n\n"), 2, 1_000_000), "\n\n").alias("content"),
            F.regexp_extract_all(part, F.lit(r"\[(https?://[^\]]+)\]"), F.lit(1)).alias("citations"),
        )

    course = F.struct(
        F.regexp_extract(head, r"^# ([^\n]*)", 1).alias("title"),
        F.regexp_replace(head, r"^# [^\n]*\n*", "").alias("introduction"),
        F.transform(F.slice(parts, 2, 1_000_000), module).alias("modules"),
        F.coalesce(F.get(whole, F.lit(1)), F.lit("")).alias("conclusion"),
    )
    return courses.withColumn("course", course)
