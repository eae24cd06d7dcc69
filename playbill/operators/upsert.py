"""Upsert of films identified by two signals: the natural key and an external id.

A film record resolves to the row its natural key matches, else to the owner of its external id,
else it is inserted. Records apply in arrival order and see what earlier ones inserted, adopted or
wrote, so rows that share a key or an id depend on each other. The work is split accordingly:

1. keys that share an external id are linked; a component is the unit of dependence;
2. components in which no record can change an identity (every record already has its exact row,
   the steady state) and components that are copies of one new film are resolved with joins;
3. the rest streams through a fold in arrival order that carries four small columns per record.
   Components are spread by shuffle and sorted on disk. One task reads a component; its stored and new
   rows stay in memory, its records do not.

Metadata never takes part in the fold: "last known value wins" and "fullest synopsis" are
aggregates over the resolved records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.functions import text as tx
from playbill.operators.components import connected_components
from playbill.operators.ranking import assign_ids
from playbill.schema import filled
from playbill.session import materialise

METADATA = ("original_title", "runtime_minutes", "genres", "director", "poster_url")
#: Arrival numbers counted together where records of one key are put in order.
BLOCK = 65536
FOLD_OUTPUT = (
    "kind string, seq bigint, target_id bigint, target_seq bigint, title_normalized string, year int, wikidata_id string"
)


class _Component:
    """Identity state of one component while its records stream past."""

    def __init__(self) -> None:
        self.of_year: dict[tuple[str, int | None], dict[int, dict]] = {}
        self.of_key: dict[str, tuple[int, dict]] = {}
        self.by_external: dict[str, dict[int, dict]] = {}
        self.changed: list[dict] = []

    def add(self, row: dict) -> None:
        """Rows of a key by year, and how many there are next to the first: homonyms need not be searched."""
        self.of_year.setdefault((row["key"], row["year"]), {})[id(row)] = row
        count, first = self.of_key.get(row["key"], (0, row))
        self.of_key[row["key"]] = (count + 1, first)
        if row["external"] is not None:
            self.by_external.setdefault(row["external"], {})[id(row)] = row

    def natural(self, key: str, year: int | None) -> dict | None:
        exact = self.of_year.get((key, year))
        if exact:
            return next(iter(exact.values()))
        if year is None:
            count, first = self.of_key.get(key, (0, None))
            return first if count == 1 else None
        open_rows = self.of_year.get((key, None), {})
        return next(iter(open_rows.values())) if len(open_rows) == 1 else None

    def resolve(self, seq: int, key: str, year: int | None, external: str | None) -> dict:
        mine = self.natural(key, year)
        owners = self.by_external.get(external) if external is not None else None
        owner = next(iter(owners.values())) if owners else None
        if mine is None and owner is not None:
            return owner
        if mine is None:
            mine = {"id": None, "seq": seq, "key": key, "year": year, "external": external, "touched": True}
            self.add(mine)
            self.changed.append(mine)
        elif owner is None or owner is mine:
            self._complete(mine, year, external)
        return mine

    def _complete(self, row: dict, year: int | None, external: str | None) -> None:
        before = (row["external"], row["year"])
        if external is not None and row["external"] != external:
            if row["external"] is not None:
                del self.by_external[row["external"]][id(row)]
            self.by_external.setdefault(external, {})[id(row)] = row
            row["external"] = external
        if row["year"] is None and year is not None:
            del self.of_year[row["key"], None][id(row)]
            row["year"] = year
            self.of_year.setdefault((row["key"], year), {})[id(row)] = row
        if before != (row["external"], row["year"]) and not row["touched"]:
            row["touched"] = True
            self.changed.append(row)


def _fold_identities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component, stored before incoming, then by id or arrival."""
    names = ["kind", "seq", "target_id", "target_seq", "title_normalized", "year", "wikidata_id"]
    name, state = None, _Component()

    def closing() -> list[tuple]:
        return [("row", None, r["id"], r["seq"], r["key"], r["year"], r["external"]) for r in state.changed]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"seq": "Int64", "target_id": "Int64", "target_seq": "Int64", "year": "Int64"})

    for batch in batches:
        out: list[tuple] = []
        columns = (batch[c] for c in ("component", "stored", "position", "title_normalized", "year", "wikidata_id"))
        for component, stored, position, key, year, external in zip(*columns):
            if component != name:
                out.extend(closing())
                name, state = component, _Component()
            year = None if pd.isna(year) else int(year)
            external = None if pd.isna(external) else external
            if stored:
                row = {"id": int(position), "seq": None, "key": key, "year": year, "external": external, "touched": False}
                state.add(row)
                continue
            row = state.resolve(int(position), key, year, external)
            out.append(("record", int(position), row["id"], row["seq"], row["key"], row["year"], None))
        if out:
            yield frame(out)
    if state.changed:
        yield frame(closing())


def _linked_keys(rows: DataFrame) -> DataFrame:
    """Edges between keys that share an external id, from the lowest key to the others."""
    pairs = rows.filter("wikidata_id is not null").select("wikidata_id", "title_normalized").distinct()
    lowest = pairs.groupBy("wikidata_id").agg(F.min("title_normalized").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return lowest.join(pairs, "wikidata_id").select("a", F.col("title_normalized").alias("b")).filter("a <> b")


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("title_normalized"), "root")
    return rows.join(known, "title_normalized", "left").withColumn("component", F.coalesce("root", "title_normalized")).drop("root")


def _kept(records: DataFrame, stored: DataFrame) -> DataFrame:
    """(wikidata_id, kept, first_at): external ids, whether a row that has one can lose it, and the record that brings it.

    A row loses its id only to a record of its own key with another one. ``first_at`` is null if a stored row has the id.
    """
    bearing = records.filter("wikidata_id is not null")
    rivals = bearing.groupBy("title_normalized").agg(F.min("wikidata_id").alias("lowest"), F.max("wikidata_id").alias("highest"))
    holders = bearing.select("wikidata_id", "title_normalized").unionByName(stored.filter("wikidata_id is not null").select("wikidata_id", "title_normalized"))
    alone = F.col("lowest").isNull() | ((F.col("lowest") == F.col("wikidata_id")) & (F.col("highest") == F.col("wikidata_id")))
    kept = holders.distinct().join(rivals, "title_normalized", "left").groupBy("wikidata_id").agg(F.bool_and(alone).alias("kept"))
    first = bearing.groupBy("wikidata_id").agg(F.when(F.max("owner_id").isNull(), F.min("seq")).alias("first_at"))
    return first.join(kept, "wikidata_id")


def _since(records: DataFrame, by: list[str], known: Column) -> DataFrame:
    """Records with ``settled`` and what they follow, given that nothing within a group of ``by`` takes its natural match away.

    From the first record on that certainly leaves a match (one without an external id, or the first with it), or from the start if a
    stored row matches (``known``), every record of the group that cannot move an external id goes where that one went.
    """
    leads = materialise(records.groupBy(*by).agg(F.min(F.when(F.col("leads"), F.col("seq"))).alias("lead")))
    later = F.coalesce(F.col("seq") > F.col("lead"), F.lit(False))
    marked = records.join(leads, by).withColumn("settled", F.col("harmless") & (known | later))
    return marked.withColumns({"target_id": F.when(known, F.col("exact_id")), "follows": F.when(~known, F.col("lead"))}).drop("lead")


def _with_segment(undated: DataFrame, acting: DataFrame) -> DataFrame:
    """Undated records with ``segment``, the number of acting records of their key before them.

    Counted by blocks of arrival numbers first, so no task orders all records of a key.
    """
    block = F.floor(F.col("seq") / BLOCK).alias("block")
    rows = undated.select("*", block, F.lit(0).alias("acts")).unionByName(acting.select("title_normalized", "seq", block, F.lit(1).alias("acts")), allowMissingColumns=True)
    rows = materialise(rows)
    earlier = Window.partitionBy("title_normalized").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("title_normalized", "block").agg(F.sum("acts").alias("n"))
    blocks = materialise(blocks.select("title_normalized", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    within = Window.partitionBy("title_normalized", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("here", F.sum("acts").over(within)).filter("acts = 0").join(blocks, ["title_normalized", "block"])
    return counted.withColumn("segment", F.col("before") + F.col("here")).drop("block", "acts", "before", "here")


def settle(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records with ``settled``, and for those ``target_id`` or the earlier record whose target they share (``follows``).

    A settled record changes no identity, and its target is certain without reading the records in sequence. Once a dated key has
    a match, it has that match for good. An undated key keeps its match until a dated record of the same title acts, so it
    is settled within each segment between those. ``records`` has ``exact_id`` and ``owner_id``, the stored matches.
    """
    externals = materialise(_kept(records, stored))
    known = records.join(externals, "wikidata_id", "left")
    harmless = F.col("wikidata_id").isNull() | (F.col("kept") & (F.col("first_at").isNull() | (F.col("seq") > F.col("first_at"))))
    known = known.withColumns({"harmless": harmless, "leads": F.col("wikidata_id").isNull() | F.col("seq").eqNullSafe(F.col("first_at"))})
    known = materialise(known.drop("kept", "first_at", "owner_id"))
    matched = F.col("exact_id").isNotNull()
    dated = materialise(_since(known.filter("year is not null"), ["title_normalized", "year"], matched))
    placed = _with_segment(known.filter("year is null"), dated.filter("not settled").select("title_normalized", "seq"))
    undated = _since(placed, ["title_normalized", "segment"], matched & (F.col("segment") == 0))
    return dated.unionByName(undated.drop("segment")).drop("harmless", "leads", "exact_id")


def _fold(stored: DataFrame, records: DataFrame) -> DataFrame:
    """The rule in sequence, for records that are not settled and the stored rows that they can reach, by groups of these alone."""
    identity = ["title_normalized", "year", "wikidata_id"]
    keys = records.select("title_normalized").distinct().withColumn("by_key", F.lit(True))
    ids = records.select("wikidata_id").filter("wikidata_id is not null").distinct().withColumn("by_id", F.lit(True))
    reached = materialise(stored.join(keys, "title_normalized", "left").join(ids, "wikidata_id", "left").filter("by_key or by_id").select("id", *identity))
    links = _linked_keys(reached.select(*identity).unionByName(records.select(*identity)))
    if links.isEmpty():
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        labels = connected_components(links)
    rows = reached.select(F.lit(True).alias("stored"), F.col("id").alias("position"), *identity).unionByName(
        records.select(F.lit(False).alias("stored"), F.col("seq").alias("position"), *identity)
    )
    ordered = _with_component(rows, labels).repartition("component").sortWithinPartitions("component", F.col("stored").desc(), "position")
    return ordered.select("component", "stored", "position", *identity).mapInPandas(_fold_identities, FOLD_OUTPUT)


def resolve_identities(state: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rows): where every incoming record goes, and the identity rows that change.

    ``records`` is (seq, target_id, target_seq, title_normalized, year): an existing row, or the
    record that inserted it, and the natural key right after the record. ``rows`` is (target_id,
    target_seq, title_normalized, year, wikidata_id).
    """
    identity = ["title_normalized", "year", "wikidata_id"]
    known = state.select("id", *identity)
    records = incoming.select("seq", *identity)
    links = _linked_keys(known.select(*identity).unionByName(records.select(*identity)))
    if links.isEmpty():
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        labels = connected_components(links)

    # Summaries are written as tables: next to a plain shuffle AQE can split a hot key.
    exact = materialise(known.groupBy("title_normalized", "year").agg(F.min("id").alias("exact_id")))
    owners = materialise(known.filter("wikidata_id is not null").groupBy("wikidata_id").agg(F.min("id").alias("owner_id")))
    joined = records.alias("r").join(
        exact.alias("e"),
        (F.col("r.title_normalized") == F.col("e.title_normalized")) & F.col("r.year").eqNullSafe(F.col("e.year")),
        "left",
    ).select("r.*", "exact_id").join(owners, "wikidata_id", "left")
    # Exact row known, and the external id absent or already owned by some row: nothing changes.
    quiet = F.col("exact_id").isNotNull() & (F.col("wikidata_id").isNull() | F.col("owner_id").isNotNull())
    marked = materialise(_with_component(joined.withColumn("quiet", quiet), labels))

    signature = F.xxhash64(F.coalesce(F.col("year"), F.lit(-1)), F.col("title_normalized"), F.coalesce("wikidata_id", F.lit("")))
    summary = marked.groupBy("component").agg(
        F.bool_and("quiet").alias("all_quiet"),
        (F.min(signature) == F.max(signature)).alias("one_form"),
        F.min("seq").alias("first_seq"),
    )
    placed = _with_component(known, labels)
    stored = placed.select("component").distinct().withColumn("is_stored", F.lit(True))
    summary = summary.join(stored, "component", "left")
    route = F.when(F.col("all_quiet"), "quiet").when(F.col("one_form") & F.col("is_stored").isNull(), "new").otherwise("fold")
    summary = materialise(summary.select("component", "first_seq", route.alias("route")))

    routed = marked.join(summary, "component")
    none = F.lit(None).cast("bigint")
    still = routed.filter("route = 'quiet'").select("seq", F.col("exact_id").alias("target_id"), none.alias("target_seq"), "title_normalized", "year")
    copies = routed.filter("route = 'new'")
    fresh = copies.select("seq", none.alias("target_id"), F.col("first_seq").alias("target_seq"), "title_normalized", "year")
    fresh_rows = copies.filter("seq = first_seq").select(none.alias("target_id"), F.col("seq").alias("target_seq"), *identity)

    folding = summary.filter("route = 'fold'").select("component")
    mixed = marked.join(folding, "component", "left_semi").select("seq", *identity, "exact_id", "owner_id")
    kept_rows = placed.join(folding, "component", "left_semi").select("id", *identity)
    judged = materialise(settle(mixed, kept_rows))
    rest = judged.filter("not settled").select("seq", *identity)
    folded = materialise(_fold(kept_rows, rest))
    columns = ["seq", "target_id", "target_seq", "title_normalized", "year"]
    stays = judged.filter("settled and target_id is not null").select("seq", "target_id", none.alias("target_seq"), "title_normalized", "year")
    led = folded.filter("kind = 'record'").select(F.col("seq").alias("follows"), *columns[1:])
    followers = judged.filter("settled and target_id is null").select("seq", "follows").join(led, "follows").select(*columns)
    settled = stays.unionByName(followers)
    all_records = still.unionByName(fresh).unionByName(settled).unionByName(folded.filter("kind = 'record'").select(*columns))
    all_rows = fresh_rows.unionByName(folded.filter("kind = 'row'").select("target_id", "target_seq", *identity))
    return all_records, all_rows


def upsert_films(state: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(films, records): the new version of the table, and (seq, id, title_normalized, year) per
    incoming record, with the natural key its film had right after it.

    ``incoming`` needs ``seq``, ``title`` and the metadata columns; the key is computed here.
    """
    keyed = incoming.withColumn("title_normalized", tx.store_key(F.col("title")))
    keyed = materialise(keyed.withColumn("wikidata_id", filled(F.col("wikidata_id"))))
    records, rows = resolve_identities(state, keyed)

    last = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))
    inserted = rows.filter("target_id is null").select(F.col("target_seq").alias("seq"))
    numbered = assign_ids(inserted, "seq", last.scalar())
    numbered = materialise(numbered.select(F.col("seq").alias("target_seq"), F.col("id").alias("new_id")))

    def with_id(df: DataFrame) -> DataFrame:
        return df.join(numbered, "target_seq", "left").withColumn("id", F.coalesce("target_id", "new_id"))

    resolved = materialise(with_id(records).select("seq", "id", "title_normalized", "year"))
    identities = with_id(rows).select("id", "new_id", "target_seq", "title_normalized", "year", "wikidata_id")

    updates = resolved.select("seq", "id").join(keyed.select("seq", "synopsis", *METADATA), "seq")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"n_{c}") for c in METADATA]
    folded = updates.groupBy("id").agg(*newest, tx.fullest(F.col("synopsis"), F.col("seq")).alias("n_synopsis"))

    titles = keyed.select(F.col("seq").alias("target_seq"), "title")
    born = identities.filter("new_id is not null").join(titles, "target_seq")
    nothing = {c: F.lit(None).cast(state.schema[c].dataType) for c in (*METADATA, "synopsis", "removed_at")}
    born = born.withColumns({**nothing, "created_at": now.cast("timestamp")}).select(*state.columns)
    moved = identities.filter("new_id is null").select("id", F.col("year").alias("i_year"), F.col("wikidata_id").alias("i_wikidata_id"))

    merged = state.unionByName(born).join(moved, "id", "left").join(folded, "id", "left")
    values = {c: F.coalesce(f"n_{c}", c) for c in METADATA}
    values["synopsis"] = tx.pick_fuller(F.col("synopsis"), F.col("n_synopsis"))
    values["year"] = F.coalesce("i_year", "year")
    values["wikidata_id"] = F.coalesce("i_wikidata_id", "wikidata_id")
    return merged.withColumns(values).select(*state.columns), resolved
