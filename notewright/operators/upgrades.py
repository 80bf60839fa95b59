"""Versions, change logs and upgrade plans, rule reviews and indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, let, strip

CLASSES = ("additive", "transform", "regenerate")


def version(c: Column) -> Column:
    """ARRAY<INT> of a dotted version of three numbers, which compares by value; null for anything else."""
    return F.when(strip(c).rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(strip(c), r"\."), lambda x: x.cast("int")))


def change_entries(logs: DataFrame, text: str = "text") -> DataFrame:
    """(seq, version, cls, steps, description, issue) of tagged bullets under ``## [x.y.z]`` headings, in order.

    Comments are dropped first; a bullet reaches over its wrapped lines up to
    the next bullet, heading or blank line; one without a final tag doesn't
    count.
    """
    body = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    sections = F.regexp_extract_all(body, F.lit(r"(?sm)^##\s*\[\d+\.\d+\.\d+\][^\n]*\n.*?(?=^##\s*\[|\z)"), 0)
    rows = logs.select(F.posexplode(sections).alias("s", "section")).select("s", version(F.regexp_extract("section", r"^##\s*\[(\d+\.\d+\.\d+)\]", 1)).alias("version"), F.posexplode(F.regexp_extract_all(F.regexp_replace("section", r"^[^\n]*\n", ""), F.lit(r"(?sm)^-\s+(.*?)(?=^[-#]|^[ \t]*$|\z)"), 1)).alias("b", "bullet"))
    tag = F.regexp_extract("bullet", r"\[([^\]]+)\]\s*$", 1)
    plain = F.regexp_replace(F.regexp_replace("bullet", r"\[([^\]]+)\]\s*$", ""), r"\(#(\d+)\)", "")
    steps = F.filter(F.transform(F.split(F.regexp_extract(tag, r"steps\s+([0-9.,\s]+)", 1), ","), strip), lambda x: x != "")
    got = rows.filter(tag != "").select((F.col("s") * 10_000 + F.col("b")).alias("seq"), "version", F.lower(strip(F.substring_index(tag, ";", 1))).alias("cls"), steps.alias("steps"), strip(F.regexp_replace(plain, r"\s+", " ")).alias("description"), blank_to_null(F.regexp_extract("bullet", r"\(#(\d+)\)", 1)).alias("issue"))
    return got


def delta(entries: DataFrame, after: Column, to: Column) -> DataFrame:
    """Entries of versions after the first up to the second, with the part of the plan they belong to."""
    group = F.when(F.col("cls").isin(*CLASSES), F.col("cls")).otherwise("skipped")
    return entries.filter((F.col("version") > after) & (F.col("version") <= to)).withColumn("plan", group)


def plan_upgrades(manifests: DataFrame, entries: DataFrame, current: str) -> DataFrame:
    """(skill, seq, version, cls, plan, issue) of every change each skill (skill, generator_version) still needs."""
    m = manifests.select("skill", version(F.col("generator_version")).alias("from_v"))
    e = F.broadcast(entries)  # the bullets of one change log
    got = m.join(e, (e["version"] > m["from_v"]) & (e["version"] <= F.lit([int(x) for x in current.split(".")])))
    return got.select("skill", "seq", "version", "cls", F.when(F.col("cls").isin(*CLASSES), F.col("cls")).otherwise("skipped").alias("plan"), "issue")


def source_ok(manifests: DataFrame, archived: DataFrame) -> DataFrame:
    """(skill, ok): whether the archived source has the manifest's hash; both must be known."""
    got = manifests.select("skill", "source_sha256").join(archived.select("skill", F.col("sha256").alias("_h")), "skill", "left")
    return got.select("skill", F.coalesce((F.col("source_sha256") != "") & (F.col("source_sha256") == F.col("_h")), F.lit(False)).alias("ok"))


def apply_transforms(files: DataFrame, plan: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(files after every registered mechanical change the plan asks for, entries that remain).

    Transform entries run before additive ones; regenerate entries and those
    without a registered function remain.
    """
    asked = plan.filter(F.col("plan").isin("transform", "additive") & F.col("issue").isin(*registry)).select("issue", (F.col("plan") == "additive").alias("late")).distinct().orderBy("late", "issue").collect()  # as many as the registry has
    for r in asked:
        files = registry[r["issue"]](files)
    remains = plan.filter((F.col("plan") == "regenerate") | (F.col("plan").isin("transform", "additive") & ~F.coalesce(F.col("issue").isin(*registry), F.lit(False))))
    return files, remains


def bumped(manifests: DataFrame, plan: DataFrame, remains: DataFrame, current: str) -> DataFrame:
    """(skill, generator_version, bumped): manifests at the current version where the plan had entries and none remain, else as they were."""
    asked, left = (x.select("skill").distinct().withColumn(n, F.lit(True)) for x, n in ((plan.filter("plan <> 'skipped'"), "_asked"), (remains, "_left")))
    got = manifests.join(asked, "skill", "left").join(left, "skill", "left").withColumn("bumped", F.col("_asked").isNotNull() & F.col("_left").isNull())
    return got.select("skill", F.when(F.col("bumped"), F.lit(current)).otherwise(F.col("generator_version")).alias("generator_version"), "bumped")


def with_offset(manifests: DataFrame, offsets: DataFrame) -> DataFrame:
    """Manifests (skill, page_offset, ...) with the offset a transform used (skill, offset) recorded; one already recorded stays."""
    got = manifests.join(offsets.select("skill", "offset"), "skill", "left")
    return got.withColumn("page_offset", F.coalesce("page_offset", "offset")).drop("offset")


def personalized(files: DataFrame, skills: DataFrame) -> DataFrame:
    """Files (skill, rel, text) with the wider hint, of skills (skill, rules) that have a rule to review by; the others stay."""
    got = files.join(skills.select("skill", "rules"), "skill", "left")
    return got.select("skill", "rel", F.when(F.coalesce(F.col("rules"), F.lit(0)) >= 1, widen_hint(F.col("text"))).otherwise(F.col("text")).alias("text"))


def unknown_rules(citations: DataFrame, rules: DataFrame) -> DataFrame:
    """Citations (path, rule) of rules whose name no rule (name) has, compared without case and outer blanks."""
    key = lambda c: F.lower(strip(F.col(c)))
    return citations.withColumn("_k", key("rule")).join(rules.select(key("name").alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def term_counts(texts: DataFrame, terms: list[str], id_col: str, text: str) -> DataFrame:
    """(id, term, n): lines of each text that hold each term, without regard to case; terms without a line are left out."""
    line = F.lower(F.col("line"))
    rows = texts.select(F.col(id_col).alias("id"), F.explode(F.split(text, "\n")).alias("line"))
    hit = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(t.lower())), F.lit(t)) for t in terms]))
    return rows.select("id", F.explode(hit).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def inject_section(text: Column, section: str, heading: str, before: str) -> Column:
    """``section`` put before the heading ``before``, else at the end; texts that hold ``heading`` stay."""
    at = F.instr(text, before)
    with_it = F.concat(F.left(text, at - 1), F.lit(f"{section}\n---\n\n"), F.substr(text, at))
    return F.when(F.contains(text, F.lit(heading)), text).when(at > 0, with_it).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n---\n\n{section}")))


def widen_hint(text: Column) -> Column:
    """The first ``argument-hint: [...]`` line gets a cue for a stack, if it names none."""
    hint = F.regexp_extract(text, r"(?m)^argument-hint:[ \t]*\[(.*?)\][ \t]*$", 1)
    line = F.regexp_extract(text, r"(?m)^argument-hint:[ \t]*\[.*?\][ \t]*$", 0)
    new = F.concat(F.regexp_replace(line, r"\][ \t]*$", ""), F.lit(', or "<topic> in <stack>"]'))
    at = F.instr(text, line)
    wide = F.concat(F.left(text, at - 1), new, F.substr(text, at + F.length(line)))
    return F.when((line == "") | F.contains(F.lower(hint), F.lit("stack")), text).otherwise(wide)


def review(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, line_no, rule, verdict): lines that match a rule's pattern in files of its scope.

    Rules are given by hand; they are compiled into one expression over the
    lines instead of a join of all lines with all rules. A hit is a violation
    if the rule's severity is ``violation`` and its confidence ``high``, else
    a suggestion. ``scope`` and ``exclude`` are regular expressions on paths.
    """
    path, line = F.col("path"), F.col("line")

    def hit(r: dict) -> Column:
        cond = path.rlike(r.get("scope", "")) & line.rlike(r["pattern"])
        if r.get("exclude"):
            cond &= ~path.rlike(r["exclude"])
        verdict = "violation" if (r["severity"], r["confidence"]) == ("violation", "high") else "suggestion"
        return F.when(cond, F.struct(F.lit(r["id"]).alias("rule"), F.lit(verdict).alias("verdict")))

    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    got = rows.select("path", (F.col("i") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*[hit(r) for r in rules]))).alias("h"))
    return got.select("path", "line_no", "h.*")


def index_terms(rows: DataFrame, term: str, place: str) -> DataFrame:
    """(term, places): distinct places of each term, sorted; counted apart first, so a frequent term costs one row a place."""
    return rows.select(F.col(term).alias("term"), F.col(place).alias("place")).distinct().groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("place")), ", ").alias("places"))


def figure_chapter(caption: Column, page: Column, ranges: Column) -> Column:
    """Chapter of a figure: the number before the dot of its label, else the last chapter (ARRAY<STRUCT<chapter, first_page>>, sorted) that begins up to its page."""
    label = F.regexp_extract(caption, r"(?i)\b(?:figure|fig\.?)\s+(\d+)[.-]\d+", 1)
    by_page = let(F.filter(ranges, lambda r: r["first_page"] <= page), lambda rs: F.try_element_at(rs, F.lit(-1)))
    return F.coalesce(blank_to_null(label).cast("int"), by_page["chapter"])
