"""Files that hold a vault together: source notes, maps of sources, listings, root index, log and manifest.

All are tables (bundle, rel, text), like the notes of ``bundle.rendered``.
Sources are (vault, slug, title, authors, extraction_method, source_sha256,
source_filename, raw_rel, page_offset); merged notes come from ``notes.merged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bundle import PAGE, VERSION_KEY, heading_of, index_name, paged, section_indexes, section_of, yaml_scalar
from .notes import SECTIONS

#: Version of the file format, and the order of sections.
FORMAT_VERSION, ORDER = "0.1", tuple(SECTIONS.values())


def _place(section: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ORDER]), section)


def _authors() -> Column:
    return F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")


def _as_file(df: DataFrame, rel: Column, text: Column) -> DataFrame:
    return df.select(F.col("vault").alias("bundle"), rel.alias("rel"), text.alias("text"))


def source_listings(sources: DataFrame, page: int = PAGE) -> DataFrame:
    """The listings of a vault's source notes and of its maps."""
    refs = F.concat(F.lit("- ["), F.coalesce("title", "slug"), F.lit("](/references/"), "slug", F.lit(".md) — "), _authors())
    maps = F.concat(F.lit("- ["), F.coalesce("title", "slug"), F.lit("](/moc/"), "slug", F.lit(".md) — its notes by section"))
    out = None
    for folder, title, line in (("references", "References", refs), ("moc", "Maps of content", maps)):
        per = paged(sources, ["vault"], ["slug"], line, page)
        files = _as_file(per, F.concat(F.lit(f"{folder}/"), index_name(F.col("page"))), F.concat(F.lit(f"# {title}\n\n"), "lines", F.lit("\n")))
        out = files if out is None else out.unionByName(files)
    return out


def source_notes(sources: DataFrame, timestamp: str) -> DataFrame:
    """One note per source: where its text came from."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = F.coalesce("title", "slug")
    text = F.concat(
        F.lit("---\ntype: Source\ntitle: "), yaml_scalar(title), F.lit("\ndescription: "), yaml_scalar(_authors()), F.lit(f"\ntags: [source]\ntimestamp: {timestamp}\nextraction_method: "), some("extraction_method"),
        F.lit("\nsource_sha256: "), some("source_sha256"), F.lit("\nraw: /"), some("raw_rel"), F.lit("\n---\n\n# "), title, F.lit("\n\nBy "), _authors(), F.lit("; read with "), some("extraction_method"),
        F.lit(".\n\nIts notes are listed in its [map](/moc/"), "slug", F.lit(".md).\n"),
    )
    return _as_file(sources, F.concat(F.lit("references/"), "slug", F.lit(".md")), text)


def notes_by_source(merged: DataFrame) -> DataFrame:
    """Distinct (vault, source, section, slug, title): merged notes with at least one citation from the source."""
    cited = merged.select("vault", "slug", "title", section_of(F.col("type")).alias("section"), F.explode(F.array_distinct(F.transform("citations", lambda c: c["source"]))).alias("source"))
    return cited.filter("source is not null").select("vault", "source", "section", "slug", "title")


def source_maps(merged: DataFrame, sources: DataFrame, timestamp: str, page: int = PAGE) -> DataFrame:
    """One map per source: the notes that cite it, by section; more than ``page`` of a section go on in further files."""
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("](/"), "section", F.lit("/"), "slug", F.lit(".md)"))
    own = paged(notes_by_source(merged), ["vault", "source", "section"], ["slug"], line, page)
    body = F.concat(F.lit("\n\n## "), heading_of(F.col("section")), F.lit("\n"), "lines")
    per = own.select("vault", "source", "page", F.struct(_place(F.col("section")).alias("o"), body.alias("b")).alias("x")).groupBy("vault", F.col("source").alias("slug"), "page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    got = sources.select("vault", "slug", "title").join(per, ["vault", "slug"], "left")
    title, nth = F.coalesce("title", "slug"), F.coalesce("page", F.lit(1))
    text = F.concat(
        F.lit("---\ntype: MOC\ntitle: "), yaml_scalar(F.concat(title, F.lit(" — map of content"))), F.lit("\ndescription: "), yaml_scalar(F.concat(F.lit("Notes that cite "), title)), F.lit(f"\ntags: [moc]\ntimestamp: {timestamp}\nsource: /references/"), "slug",
        F.lit(".md\n---\n\n# "), title, F.lit(" — map of content"), F.coalesce(F.array_join(F.transform("x", lambda e: e["b"]), ""), F.lit("")), F.lit("\n"),
    )
    rel = F.concat(F.lit("moc/"), "slug", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    return _as_file(got, rel, text)


def section_totals(merged: DataFrame, vaults: DataFrame) -> DataFrame:
    """(vault, section, notes) of every vault and section, also empty ones."""
    every = vaults.select("vault").distinct().select("vault", F.explode(F.array(*[F.lit(s) for s in ORDER])).alias("section"))
    n = merged.groupBy("vault", section_of(F.col("type")).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["vault", "section"], "left").select("vault", "section", F.coalesce("n", F.lit(0)).alias("notes"))


def _per_vault(merged: DataFrame, sources: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per vault with sources: counts by section, number of sources and the only one's title, merged notes, drops (vault, citations, notes)."""
    books = sources.groupBy("vault").agg(F.count(F.lit(1)).alias("n_sources"), F.min(F.coalesce("title", "slug")).alias("one_title"))
    counts = section_totals(merged, books).withColumn("x", F.struct(_place(F.col("section")).alias("o"), "section", "notes")).groupBy("vault").agg(F.array_sort(F.collect_list("x")).alias("counts"), F.sum("notes").alias("n_notes"))
    twice = merged.groupBy("vault").agg(F.count_if("merged").alias("n_merged"))
    lost = dropped.select("vault", F.col("citations").alias("lost_citations"), F.col("notes").alias("lost_notes"))
    return books.join(counts, "vault").join(twice, "vault", "left").join(lost, "vault", "left").na.fill(0, ["n_merged", "lost_citations", "lost_notes"])


def roots_and_logs(merged: DataFrame, sources: DataFrame, dropped: DataFrame, timestamp: str) -> DataFrame:
    """The root index and the log of every vault with sources."""
    per = _per_vault(merged, sources, dropped)
    label = F.when(F.col("n_sources") == 1, F.col("one_title")).otherwise(F.concat(F.col("n_sources").cast("string"), F.lit(" sources")))
    lines = F.transform(F.filter("counts", lambda c: c["notes"] > 0), lambda c: F.concat(F.lit("- ["), heading_of(c["section"]), F.lit("](/"), c["section"], F.lit("/index.md)")))
    hubs = F.array(F.lit("- [References](/references/index.md)"), F.lit("- [Maps of content](/moc/index.md)"))
    root = F.concat(F.lit(f'---\n{VERSION_KEY}: "{FORMAT_VERSION}"\n---\n\n# Notes from '), label, F.lit("\n\n## Sections\n"), F.array_join(F.concat(lines, hubs), "\n"), F.lit("\n"))
    drops = F.when((F.col("lost_citations") > 0) | (F.col("lost_notes") > 0), F.format_string("; left out %d citations not found in their source and %d notes without any", "lost_citations", "lost_notes")).otherwise(F.lit(""))
    log = F.concat(F.lit(f"# Log\n\n## {timestamp[:10]}\n"), F.format_string("- Built %d notes, %d of them from several places, from %s", "n_notes", "n_merged", label), drops, F.lit("\n"))
    return _as_file(per, F.lit("index.md"), root).unionByName(_as_file(per, F.lit("log.md"), log))


def manifests(merged: DataFrame, sources: DataFrame, dropped: DataFrame, timestamp: str, generator: str) -> DataFrame:
    """(vault, generator_version, updated, note_counts, dropped): one row of provenance per vault; its sources are rows of :func:`source_manifest`."""
    per = _per_vault(merged, sources, dropped)
    return per.select("vault", F.lit(generator).alias("generator_version"), F.lit(timestamp[:10]).alias("updated"), F.map_from_entries(F.transform("counts", lambda c: F.struct(c["section"], c["notes"]))).alias("note_counts"),
                      F.struct(F.col("lost_citations").alias("citations"), F.col("lost_notes").alias("notes")).alias("dropped"))


def source_manifest(sources: DataFrame, timestamp: str) -> DataFrame:
    """(vault, slug, source_filename, extraction_method, source_sha256, page_offset, ingested) of every source."""
    return sources.select("vault", "slug", "source_filename", "extraction_method", "source_sha256", "page_offset", F.lit(timestamp[:10]).alias("ingested"))


def dropped_by_vault(notes: DataFrame, grounded: DataFrame) -> DataFrame:
    """(vault, citations, notes): citations not found in their source, and notes left without any."""
    per = notes.select("vault", "ord").join(grounded.groupBy("ord").agg(F.count("at").alias("kept"), F.count(F.lit(1)).alias("all")), "ord", "left")
    return per.groupBy("vault").agg(F.coalesce(F.sum(F.col("all") - F.col("kept")), F.lit(0)).alias("citations"), F.count_if(F.coalesce("kept", F.lit(0)) == 0).alias("notes"))


def assembled(note_files: DataFrame, merged: DataFrame, sources: DataFrame, dropped: DataFrame, timestamp: str, page: int = PAGE) -> DataFrame:
    """All files of all vaults. The same input gives the same files, so writing them again changes nothing."""
    out = note_files
    for files in (section_indexes(merged, page), source_listings(sources, page), source_notes(sources, timestamp), source_maps(merged, sources, timestamp, page), roots_and_logs(merged, sources, dropped, timestamp)):
        out = out.unionByName(files)
    return out
