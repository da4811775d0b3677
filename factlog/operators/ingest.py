"""Corpus ingest: file filters, modules, snapshot differences, byte budgets, outcome reports."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.constants import LANGUAGES, MAX_FILE_BYTES, PRUNED_DIRECTORIES


def glob_regex(pattern: str) -> str:
    """A glob whose * and ? stop at a slash, as a regular expression of the whole text."""
    return "^" + fnmatch.translate(pattern).replace("(?s:", "(?:").replace(".*", "[^/]*").replace("(?>[^/]*?", "(?:[^/]*?").removesuffix(r"\Z").removesuffix(r"\z") + "$"


def _any_part(pattern: str):
    return lambda part: part.rlike(pattern)


def drop_reason(path="path", size="size", deny: list[str] = (), ignore: list[str] = ()) -> Column:
    """Why a file is not read, or null: a pruned directory, a deny glob (path or basename), an ignore rule, its size.

    An ignore rule that ends with / holds for directories only; one that begins with / or has a slash inside is anchored at the root; others match the path,
    the basename or any part of it.
    """
    p = F.col(path)
    parts, base = F.split(p, "/"), F.element_at(F.split(p, "/"), -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.when(F.exists(dirs, lambda d: d.isin(PRUNED_DIRECTORIES)), "pruned")
    for g in deny:
        out = out.when(p.rlike(glob_regex(g)) | base.rlike(glob_regex(g)), "denied")
    for rule in ignore:
        r = rule.strip().rstrip("/").lstrip("/")
        exact, any_part = glob_regex(r), _any_part(glob_regex(r))
        if rule.endswith("/"):
            hit = F.exists(dirs, any_part)
        elif rule.startswith("/") or "/" in rule:
            hit = p.rlike(exact)
        else:
            hit = p.rlike(exact) | F.exists(parts, any_part)
        out = out.when(hit, "ignored")
    return out.when(F.col(size) > MAX_FILE_BYTES, "too_large")


def extension(path="path") -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1))


def language(path="path") -> Column:
    """By the extension; null if unknown."""
    pairs = [F.lit(x) for name, _, exts in LANGUAGES for e in exts for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def module_key(lang: Column, path="path") -> Column:
    """`language:strategy:directory`, `…:directory/stem` or `…:path`, by the language's strategy; null if unknown."""
    p = F.col(path)
    folder = F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    strategy = F.try_element_at(F.create_map(*[F.lit(x) for name, s, _ in LANGUAGES for x in (name, s)]), lang)
    part = F.when(strategy.isin("per-package", "per-module"), folder).when(strategy == "per-pair", F.concat(folder, F.lit("/"), stem)).otherwise(p)
    return F.concat(lang, F.lit(":"), strategy, F.lit(":"), part)


def modules(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Every file with its module; of a module with several files over `limit` bytes each file is one of its own."""
    df = files.withColumn("lang", language()).where("lang IS NOT NULL").withColumn("module", module_key(F.col("lang")))
    if limit is None:
        return df.drop("lang")
    w = Window.partitionBy("module")
    large = (F.sum("size").over(w) > limit) & (F.count("*").over(w) > 1)
    return df.withColumn("module", F.when(large, F.concat("lang", F.lit(":per-file:"), "path")).otherwise(F.col("module"))).drop("lang")


def module_table(grouped: DataFrame) -> DataFrame:
    """`(module, files)` with the paths in order."""
    return grouped.groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("files"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """I4: `(path, status)` between two snapshots `(path, hash)`: added, changed or deleted. A rename is a deletion and an addition."""
    df = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    return df.select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "changed").alias("status")).where("status IS NOT NULL")


def module_delta(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """I4: `(module, action)`: modules that hold a change are done again; those of which nothing is left are retracted."""
    touched = changed.join(old.select("path", "module").union(new.select("path", "module")).distinct(), "path").select("module").distinct()
    alive = new.select("module").distinct().withColumn("alive", F.lit(True))
    return touched.join(alive, "module", "left").select("module", F.when(F.col("alive"), "redo").otherwise("retract").alias("action"))


def todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """I5."""
    return wanted.select("module").distinct().join(done.select("module"), "module", "left_anti")


def completed(done: DataFrame, more: DataFrame) -> DataFrame:
    """The completed modules of every project, once each."""
    return done.select("project", "module").union(more.select("project", "module")).distinct()


def allocate(files: DataFrame, budget: int, least: int = 256) -> DataFrame:
    """The bytes of each file that fit: all of them, or a share in proportion to its size, at least `least`, at most its own."""
    total = F.sum("size").over(Window.partitionBy("module"))
    share = F.greatest(F.floor(F.col("size") / total * budget), F.lit(least))
    return files.withColumn("bytes", F.when(total <= budget, F.col("size")).otherwise(F.least(share, F.col("size"))).cast("long"))


def module_bodies(allocated: DataFrame) -> DataFrame:
    """`(module, body)`: a header, and each file's part under its name, marked where it is cut; by path. A character that the cut splits becomes U+FFFD."""
    part = F.make_valid_utf8(F.substring(F.encode("content", "UTF-8"), F.lit(1), F.col("bytes").cast("int")).cast("string"))
    tail = F.when(F.col("bytes") < F.col("size"), F.concat(F.lit("\n... [truncated "), (F.col("size") - F.col("bytes")).cast("string"), F.lit(" bytes]\n"))).otherwise("")
    block = F.concat(F.lit("=== FILE: "), "path", F.lit(" ===\n"), part, tail, F.lit("\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", block.alias("block")))), lambda x: x["block"]), "")
    df = allocated.groupBy("module").agg(body.alias("body"))
    return df.select("module", F.concat(F.lit("module: "), "module", F.lit("\nlanguage: "), F.substring_index("module", ":", 1), F.lit("\n\n"), "body").alias("body"))


def module_requests(bodies: DataFrame, project: str) -> DataFrame:
    """I8: module bodies as observe requests."""
    facets = F.create_map(F.lit("domain"), F.lit("code"), F.lit("project"), F.lit(project), F.lit("module"), F.col("module"), F.lit("source"), F.lit("ingest"))
    return bodies.select("module", "body", F.lit("Observation").alias("kind"), facets.alias("facets"))


def retractions(entries: DataFrame, gone: DataFrame, project: str) -> DataFrame:
    """Live entries `(e, module, project, retracted)` of the modules that are gone, as retraction requests."""
    return entries.where((F.col("project") == project) & ~F.col("retracted")).join(gone.select("module").distinct(), "module", "left_semi").select("e", F.lit("module gone").alias("reason"), F.lit("ingest").alias("actor"))


def outcomes(results: DataFrame) -> DataFrame:
    """How many modules were written, skipped or failed, by reason."""
    return results.groupBy("status", "reason").agg(F.count("*").alias("modules"))
