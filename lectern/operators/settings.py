"""Settings of documents: layers, bounds, definitions, cache profiles. All are column expressions or windows over narrow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import materialize

# Bounds and defaults of the settings (minimum, maximum, default).
BOUNDS = {
    "keyword_min_words": (20, None, 20),
    "summary_min_words": (1, None, 35),
    "summary_word_ratio": (0.02, 0.80, 0.15),
    "max_keywords": (1, None, 5),
    "parallel_jobs": (1, 8, 2),
    "request_retries": (0, 5, 3),
    "timeout_seconds": (10.0, 600.0, 300.0),
}
DEFAULT_BACKGROUND = "#263238"
# What the two default kinds looked like before (colour, opacity), and look like now.
FORMER = {"keywords": ("#f5c15f", 0.6), "summary": ("#fff8eb", 0.6)}
STYLES = {"keywords": ("#7a4a12", 1.0), "summary": ("#263238", 1.0)}
DEFAULT_PROMPT = "Summarise the text."
DEFAULT_NAME = "representation"


#: Rows of a table of settings that may become part of a plan.
MOST_FIXED = 1000


def fixed_rows(table: DataFrame) -> list:
    """The rows of a table of settings; more than MOST_FIXED are an error, so nothing that grows is collected or broadcast."""
    rows = table.limit(MOST_FIXED + 1).collect()
    if len(rows) > MOST_FIXED:
        raise ValueError(f"a table of settings has more than {MOST_FIXED} rows")
    return rows


def layered(documents: DataFrame, settings: DataFrame) -> DataFrame:
    """document_id, path, value of every document: leaves of all layers merged, the highest layer wins.

    settings: document_id (null: all documents, MOST_FIXED rows at most), layer, path (dotted), value. A leaf hides what lower layers have above or below its
    path: of each path the highest layer counts, and the paths above and below are met by joins on them.
    """
    common, kinds = settings.where("document_id IS NULL").select("layer", "path", "value"), {f.name: f.dataType for f in settings.schema}
    fixed = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in ("layer", "path", "value")]) for r in fixed_rows(common)]
    every = settings.where("document_id IS NOT NULL").join(documents.select("document_id").distinct().hint("merge"), "document_id", "left_semi").select("document_id", "layer", "path", "value")
    if fixed:
        every = every.unionByName(documents.select("document_id", F.explode(F.array(*fixed)).alias("s")).select("document_id", "s.*"))
    best = materialize(every.groupBy("document_id", "path").agg(F.max("layer").alias("layer"), F.max_by("value", "layer").alias("value")), "leaves")
    parts = F.split("path", r"\.")
    above = best.select("document_id", "path", "layer", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ".")))).alias("above"))
    below = above.groupBy("document_id", F.col("above").alias("path")).agg(F.max("layer").alias("__below"))
    over = above.join(best.select("document_id", F.col("path").alias("above"), F.col("layer").alias("__over")).hint("merge"), ["document_id", "above"])
    hidden = over.where(F.col("__over") > F.col("layer")).select("document_id", "path").distinct()
    left = best.join(below.hint("merge"), ["document_id", "path"], "left").where(F.coalesce(F.col("__below") <= F.col("layer"), F.lit(True)))
    return left.join(hidden.hint("merge"), ["document_id", "path"], "left_anti").select("document_id", "path", "value")


def bounded(name: str, value: Column) -> Column:
    """A setting (a string or number) as a number within its bounds, the default where it is none."""
    low, high, default = BOUNDS[name]
    text = value.cast("string")
    number = F.coalesce(tx.to_int(text), F.lit(default)) if isinstance(low, int) else F.coalesce(tx.to_double(text), F.lit(float(default)))
    number = F.greatest(number, F.lit(low))
    return number if high is None else F.least(number, F.lit(high))


def definitions(owners: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Definitions of each owner with defaults filled in, the first of each name (in lower case) kept; an owner without any has the two
    default ones.

    rows: key, pos, name, prompt, background, opacity (a string), enabled.
    """
    blank = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    number = F.least(F.greatest(F.coalesce(tx.to_double(F.col("opacity")), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    tidy = rows.select(
        key,
        "pos",
        F.coalesce(F.nullif(tx.collapse(F.col("name")), F.lit("")), F.lit(DEFAULT_NAME)).alias("name"),
        blank(F.col("prompt"), DEFAULT_PROMPT).alias("prompt"),
        blank(F.col("background"), DEFAULT_BACKGROUND).alias("background"),
        number.alias("opacity"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )
    first = tidy.groupBy(key, F.lower("name").alias("__name")).agg(F.min_by(F.struct("pos", "name", "prompt", "background", "opacity", "enabled"), "pos").alias("d"))
    found = first.select(key, "d.*")
    default = lambda pos, name: F.struct(F.lit(pos).cast(rows.schema["pos"].dataType).alias("pos"), F.lit(name).alias("name"), F.lit(DEFAULT_PROMPT).alias("prompt"), F.lit(DEFAULT_BACKGROUND).alias("background"), F.lit(1.0).alias("opacity"), F.lit(True).alias("enabled"))
    without = owners.select(key).distinct().join(rows.select(key).distinct().hint("merge"), key, "left_anti")
    return found.unionByName(without.select(key, F.explode(F.array(default(0, "keywords"), default(1, "summary"))).alias("d")).select(key, "d.*"))


def profile(version: Column, provider: Column, llm: Column, model: Column) -> Column:
    """The cache profile of a document: how it was parsed and grouped."""
    own = llm & (provider == "tagged")
    return F.concat_ws("|", version, F.concat(F.lit("provider="), provider), F.concat(F.lit("semantic="), F.when(own, "llm").otherwise("heuristic")), F.concat(F.lit("semantic_model="), F.when(own, model).otherwise("none")))


def _parts(value: Column) -> Column:
    """version and the key=value parts of a profile; null for a blank one."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda p: p != "")
    named = F.filter(F.slice(parts, 2, 100), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(named, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    get = lambda key: F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]
    return F.when(F.size(parts) > 0, F.struct(F.element_at(parts, 1).alias("version"), *[get(k).alias(k) for k in ("provider", "semantic", "semantic_model", "model")]))


def profile_matches(stored: Column, current: Column) -> Column:
    """Equal, or the same version, provider and grouping, and with model grouping the same model (older profiles call it `model`)."""
    a, b = _parts(stored), _parts(current)
    alike = a["version"].eqNullSafe(b["version"]) & a["provider"].eqNullSafe(b["provider"]) & a["semantic"].eqNullSafe(b["semantic"])
    model = F.coalesce(F.nullif(a["semantic_model"], F.lit("")), a["model"])
    known = a.isNotNull() & b.isNotNull()
    return stored.eqNullSafe(current) | (known & F.coalesce(alike & ((b["semantic"] != "llm") | model.eqNullSafe(b["semantic_model"])), F.lit(False)))


def enabled_default(own: Column, name: Column, default_name: str) -> Column:
    """A definition's switch, on by default for one name only."""
    return F.coalesce(own, F.lower(F.trim(name)) == default_name)


def enabled_by(name: Column, kind: Column, shown: Column) -> Column:
    """Whether a condition's list of kinds shows a representation, by its name or its kind; without a list nothing is shown."""
    return F.coalesce(F.array_contains(shown, name), F.lit(False)) | F.coalesce(F.array_contains(shown, kind), F.lit(False))


def reader_shows(kind: Column, flags: Column) -> Column:
    """Whether a reader shows a kind: all but those that its map of kinds to flags sets to false."""
    return F.coalesce(F.try_element_at(flags, kind), F.lit(True))


def migrated(rows: DataFrame) -> DataFrame:
    """Saved settings (id, name, is_default, color, opacity) in which a former default colour or opacity of the two default kinds gives way to the present
    one; other values stay, and a missing opacity of a default setting is 1. The kind is the id, or else the name, in lower case."""
    kind = F.lower(F.coalesce(F.nullif("id", F.lit("")), F.nullif("name", F.lit("")), F.lit("")))
    color, opacity = F.col("color"), F.col("opacity")
    for own, (old_color, old_opacity) in FORMER.items():
        color = F.when((kind == own) & (F.lower("color") == old_color), STYLES[own][0]).otherwise(color)
        opacity = F.when((kind == own) & (F.col("opacity") == old_opacity), F.lit(STYLES[own][1])).otherwise(opacity)
    filled = F.when(kind.isin(*FORMER) | F.coalesce("is_default", F.lit(False)), F.coalesce(opacity, F.lit(1.0))).otherwise(opacity)
    return rows.withColumn("color", color).withColumn("opacity", filled)


def style(kind: Column, color: Column, opacity: Column, reader: list) -> Column:
    """struct(color, opacity) of a shown representation: the reader's setting of its kind, else its own, else the defaults; the opacity between 0 and 1.

    reader: the rows (name, id, color, opacity) of a reader's settings in order, a bounded list; a kind may be a setting's name or id, and the later setting
    counts.
    """
    known = {}
    for r in reader:
        known |= {key: r for key in (r["name"], r["id"]) if key}
    own = lambda field, kind_: F.try_element_at(F.create_map(*[x for k, r in known.items() for x in (F.lit(k), F.lit(r[field]).cast(kind_))]), kind) if known else F.lit(None).cast(kind_)
    seen = F.least(F.greatest(F.coalesce(own("opacity", "double"), opacity, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return F.struct(F.coalesce(own("color", "string"), color, F.lit(DEFAULT_BACKGROUND)).alias("color"), seen.alias("opacity"))
