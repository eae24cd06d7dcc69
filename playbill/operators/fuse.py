"""Fusing the copies of one film, and enriching films from a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx
from playbill.operators.components import connected_components
from playbill.operators.grouping import first_filled, first_list, first_value
from playbill.operators.similarity import alias_table, canonical_title, similarity_self_join
from playbill.schema import blank
from playbill.session import materialise

FILL_TEXT = ("poster", "source_poster", "director", "duration", "original_title")
ENRICHED_TEXT = ("poster", "description", "director", "duration", "original_title", "wikidata_id")


def _is_shouted(title: Column) -> Column:
    """All cased letters are upper case and there is at least one."""
    return (title == F.upper(title)) & (title != F.lower(title))


def master_title(title: Column, seq: Column) -> Column:
    """Aggregate: the first title that is not all upper case, else the first one."""
    shown = F.when(~blank(title), title)
    return F.coalesce(F.min_by(shown, F.when(shown.isNotNull(), F.struct(_is_shouted(title).cast("int"), seq))), F.lit(""))


def fuse(films: DataFrame, root: str = "root", seq: str = "arrival_seq", shown_title: str = "title") -> DataFrame:
    """One row per group: the first filled value of each field in arrival order, the fullest
    description; key, status and external id of the first member."""
    order = F.col(seq)
    fields = [first_filled(F.col(c), order).alias(c) for c in FILL_TEXT]
    first = [F.min_by(c, seq).alias(c) for c in ("source_slug", "title_normalized", "status", "wikidata_id")]
    return films.groupBy(F.col(root).alias(seq)).agg(
        master_title(F.col(shown_title), order).alias("title"),
        *fields,
        first_list(F.col("genres"), order).alias("genres"),
        first_value(F.col("year"), order).alias("year"),
        tx.fullest(F.col("description"), order).alias("description"),
        *first,
        F.count("*").alias("members"),
    )


def relabel(rows: DataFrame, labels: DataFrame, seq: str = "arrival_seq") -> DataFrame:
    """Give each row its component root; rows outside any component are their own root."""
    known = labels.select(F.col("node").alias(seq), "root")
    return rows.join(known, seq, "left").withColumn("root", F.coalesce("root", seq))


def rekey_showings(showings: DataFrame, labels: DataFrame) -> DataFrame:
    """Move flat showings to the root of their film; they are never gathered per film."""
    moved = relabel(showings, labels)
    return moved.withColumn("arrival_seq", F.col("root")).drop("root")


def fuse_by_title(
    films: DataFrame, aliases: list[tuple[str, str]] | None = None, min_containment_length: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Entity resolution by title: (fused films, labels of arrival numbers)."""
    known = alias_table(films.sparkSession, tx.TITLE_ALIASES if aliases is None else aliases)
    edges = similarity_self_join(films, "title_normalized", "arrival_seq", known, min_containment_length)
    labels = connected_components(edges)
    named = canonical_title(films, known)
    grouped = relabel(named, labels)
    # Aliases rename only fused films; a film on its own keeps the title of its source.
    fused = fuse(grouped, shown_title="canonical_title")
    own = films.select("arrival_seq", F.col("title").alias("own_title"))
    fused = fused.join(own, "arrival_seq").withColumn("title", F.when(F.col("members") == 1, F.col("own_title")).otherwise(F.col("title")))
    return fused.drop("own_title", "members"), labels


def external_id_labels(films: DataFrame) -> DataFrame:
    """Films sharing an external id, labelled with the first arrival."""
    known = films.filter(~blank(F.col("wikidata_id")))
    roots = materialise(known.groupBy("wikidata_id").agg(F.min("arrival_seq").alias("root")))
    return known.join(roots, "wikidata_id").select(F.col("arrival_seq").alias("node"), "root")


def fuse_by_external_id(films: DataFrame, aliases: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fuse films an enrichment gave the same id; the rest pass unchanged. Idempotent."""
    labels = external_id_labels(films)
    known = alias_table(films.sparkSession, tx.TITLE_ALIASES if aliases is None else aliases)
    named = canonical_title(relabel(films, labels), known)
    fused = fuse(named, shown_title="canonical_title")
    own = films.select("arrival_seq", F.col("title").alias("own_title"))
    fused = fused.join(own, "arrival_seq").withColumn("title", F.when(F.col("members") == 1, F.col("own_title")).otherwise(F.col("title")))
    return fused.drop("own_title", "members"), labels


# ---- enrichment -----------------------------------------------------------------------


def lookup_key(title: Column) -> Column:
    """Key under which a lookup is remembered."""
    return F.lower(tx.normalize_title(title))


def _complete(films: DataFrame) -> Column:
    done = F.lit(True)
    for name in ("poster", "description", "director", "duration"):
        done = done & ~blank(F.col(name))
    return done


def enrich(films: DataFrame, dimension: DataFrame) -> DataFrame:
    """Fill the empty fields of incomplete films from a reference table.

    ``dimension`` has one row per ``lookup_key`` with ``found`` and the fields; the title is looked
    up first, then the normalised title. Films that lack nothing are left alone.
    """
    fields = [*ENRICHED_TEXT, "year"]
    hits = dimension.filter("found").select("lookup_key", F.struct(*fields).alias("hit"))
    keyed = films.withColumns({"_k1": lookup_key(F.col("title")), "_k2": lookup_key(F.col("title_normalized"))})
    for key, name in (("_k1", "_h1"), ("_k2", "_h2")):
        keyed = keyed.join(hits.select(F.col("lookup_key").alias(key), F.col("hit").alias(name)), key, "left")
    hit = F.when(~_complete(films), F.coalesce("_h1", "_h2"))
    filled = {c: F.when(blank(F.col(c)), F.coalesce(hit[c], F.col(c))).otherwise(F.col(c)) for c in ENRICHED_TEXT}
    filled["year"] = F.coalesce("year", hit["year"])
    return keyed.withColumns(filled).select(*films.columns)


def enrichment_worklist(films: DataFrame, dimension: DataFrame) -> DataFrame:
    """Titles never looked up, once each: misses are remembered in the dimension too."""
    wanted = films.filter(~_complete(films)).select(F.explode(F.array("title", "title_normalized")).alias("title"))
    keyed = wanted.select(lookup_key(F.col("title")).alias("lookup_key"), "title").filter("lookup_key <> ''")
    once = keyed.groupBy("lookup_key").agg(F.min("title").alias("title"))
    return once.join(dimension.select("lookup_key"), "lookup_key", "left_anti")
