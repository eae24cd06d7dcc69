"""Similarity joins on title keys, exact and without comparing all pairs.

All joins run on *distinct* keys, so a title that fills a third of the table is one row. Candidates
come from equi-joins whose key length adapts to the title, and the verification is part of the
join condition, so a false candidate is never written out:

* containment: a needle of length n is looked up by its rarest window of length 2**k <= n (at
  least half the needle, far rarer than a fixed short n-gram) among the windows of that length of
  every key;
* edit distance: the earlier key is cut into (budget + 1) segments, one of which must survive in
  the other key close to its place (Li, Deng, Wang, Feng, "Pass-Join", VLDB 2011). Segments of short keys have one or
  two letters and would select nothing, so keys of fewer than ``SHORT`` characters meet in their deletion neighbourhoods
  instead: two keys within t edits have a string in common after up to t deletions in each (Bocek, Hunt, Stiller, "Fast
  Similarity Search in Large Dictionaries", 2007). Of longer keys whose segments have fewer than ``SELECTS`` letters, which
  titles of one language share by the thousand, blocks meet blocks in vectors (``near_keys``).

All are complete: nothing is capped or dropped. What a key is looked up by depends on that key alone, so an index of
it can be kept and only new keys need be probed (``playbill.plans.key_index``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx
from playbill.operators.near_keys import near_in_blocks
from playbill.session import materialise

#: Keys below this length, and of no more edits than these, are found by their deletion neighbourhoods.
SHORT, DELETIONS = 12, 2
#: Letters of a segment that few other keys have in its place.
SELECTS = 6


def _windows(key: Column, width: Column) -> Column:
    """Distinct substrings of a given width, hashed with the width."""
    starts = F.sequence(F.lit(1), F.length(key) - width + 1)
    return F.array_distinct(F.transform(starts, lambda p: F.xxhash64(width, F.substr(key, p, width))))


def _widths(key: Column) -> Column:
    """Powers of two not longer than a (non-empty) key."""
    top = F.length(F.bin(F.length(key))) - 1
    return F.transform(F.sequence(F.lit(0), top), lambda k: F.pow(F.lit(2), k).cast("int"))


def containment_pairs(keys: DataFrame, min_length: int = 1) -> DataFrame:
    """(needle, hay): distinct non-empty keys contained in another, longer key."""
    # Only widths that some key is looked up by; there are no more of them than bits in the longest length.
    needles = keys.filter(F.length("key") >= min_length).select(F.element_at(_widths(F.col("key")), -1).alias("width"))
    windows = window_rows(keys, min_length, [r["width"] for r in needles.distinct().collect()])
    return contained(needle_rows(keys, windows, min_length), windows)


def window_rows(keys: DataFrame, min_length: int = 1, widths: list[int] | None = None) -> DataFrame:
    """(hay, gram): what a key can be found by as the longer one, by windows of some widths only if they are given."""
    # Windows narrower than those of the shortest needle are never probed.
    lowest = 1 << max(min_length.bit_length() - 1, 0)
    wide = F.filter(_widths(F.col("key")), lambda w: w >= lowest if widths is None else w.isin(widths))
    windows = keys.select("key", F.explode(wide).alias("width"))
    return windows.select(F.col("key").alias("hay"), F.explode(_windows(F.col("key"), F.col("width"))).alias("gram"))


def needle_rows(keys: DataFrame, windows: DataFrame, min_length: int = 1) -> DataFrame:
    """(needle, gram): what a key looks longer ones up by, its rarest window among ``windows``."""
    key = F.col("key")
    probes = keys.filter(F.length(key) >= min_length).select(key, F.explode(_windows(key, F.element_at(_widths(key), -1))).alias("gram"))
    frequency = windows.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = probes.join(frequency, "gram").groupBy("key").agg(F.min(F.struct("df", "gram"))["gram"].alias("gram"))
    return rarest.select(key.alias("needle"), "gram")


def contained(needles: DataFrame, windows: DataFrame) -> DataFrame:
    """(needle, hay) of needles that are inside a longer key."""
    inside = (F.length("hay") > F.length("needle")) & F.contains(F.col("hay"), F.col("needle"))
    # One probe window per needle, distinct windows per key: a pair can only appear twice if two
    # widths collide in the hash.
    return needles.join(windows, "gram").filter(inside).select("needle", "hay").distinct()


def _segments(length: Column, budget: Column) -> Column:
    """Even cut of a key into budget + 1 parts: structs (i, start, size), longer parts last.

    A key too short to be cut is one empty part at the start, shared by all keys of its length;
    there are only as many of those as words of that length.
    """
    count = budget + 1
    base = F.floor(length / count).cast("int")
    short = count - F.pmod(length, count)
    cut = F.transform(
        F.sequence(F.lit(0), budget),
        lambda i: F.struct(
            i.alias("i"),
            (1 + i * base + F.greatest(F.lit(0), i - short)).cast("int").alias("start"),
            (base + (i >= short).cast("int")).cast("int").alias("size"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("start"), F.lit(0).alias("size")))
    return F.when(length > budget, cut).otherwise(whole)


def _slot(key: Column, length: Column, segment: Column, start: Column) -> Column:
    return F.xxhash64(length, segment["i"], F.substr(key, start, segment["size"]))


def _is_short(length: Column, budget) -> Column:
    return (length < SHORT) & (budget(length) <= DELETIONS)


def is_dense(length: Column, budget) -> Column:
    """Whether segments of keys of a length are too short to select."""
    return ~_is_short(length, budget) & (length < SELECTS * (budget(length) + 1))


def _deletions(key: Column) -> Column:
    """Hashes of a key and of all that is left of it after up to ``DELETIONS`` deletions."""
    fewer = lambda text: F.transform(F.filter(F.sequence(F.lit(0), F.length(text)), lambda p: p > 0), lambda p: F.concat(F.substr(text, F.lit(1), p - 1), F.substr(text, p + 1)))
    levels = [F.array(key)]
    for _ in range(DELETIONS):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], fewer))))
    return F.array_distinct(F.transform(F.flatten(F.array(*levels)), lambda text: F.xxhash64(F.lit(-1), text)))


def first_rows(keys: DataFrame, budget=tx.typo_budget) -> DataFrame:
    """(a, t, slot): where a key waits as the first of a pair, with the edits that it tolerates; none for lengths that are dense."""
    base = keys.select(F.col("key").alias("a"), F.length("key").alias("n")).withColumn("t", budget(F.col("n")))
    slots = F.transform(_segments(F.col("n"), F.col("t")), lambda s: _slot(F.col("a"), F.col("n"), s, s["start"]))
    short = _is_short(F.col("n"), budget)
    long_rows = base.filter(~short & ~is_dense(F.col("n"), budget)).select("a", "t", F.explode(slots).alias("slot"))
    return long_rows.unionByName(base.filter(short).select("a", "t", F.explode(_deletions(F.col("a"))).alias("slot")))


def second_rows(keys: DataFrame, lengths: DataFrame, budget=tx.typo_budget) -> DataFrame:
    """(b, slot): where a key looks for the first of a pair; ``lengths`` (n) are those that a first key may have.

    There are no more of them than characters in the longest key.
    """
    base = keys.select(F.col("key").alias("b"), F.length("key").alias("m"))
    # Each key visits the segments of every length that can reach it.
    m = F.col("m")
    longest = lengths.agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    pairs = base.select("m").distinct().withColumn("longest", longest).select("m", F.explode(F.sequence(F.lit(0), "longest")).alias("n"))
    slotted = ~_is_short(F.col("n"), budget) & ~is_dense(F.col("n"), budget)
    pairs = pairs.withColumn("t", budget(F.col("n"))).filter((F.abs(m - F.col("n")) <= F.col("t")) & slotted)
    pairs = pairs.join(lengths, "n", "left_semi")
    visits = base.join(pairs, "m").select("b", m, "n", "t", F.explode(_segments(F.col("n"), F.col("t"))).alias("s"))
    # Multi-match-aware range of the places where segment i can have moved.
    gap, i, start, size = m - F.col("n"), F.col("s.i"), F.col("s.start"), F.col("s.size")
    low = F.greatest(start - i, start + gap - (F.col("t") - i), F.lit(1))
    high = F.least(start + i, start + gap + (F.col("t") - i), m - size + 1)
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    slots = F.array_distinct(F.transform(places, lambda p: _slot(F.col("b"), F.col("n"), F.col("s"), p)))
    moved = visits.select("b", F.explode(slots).alias("slot"))
    return moved.unionByName(base.filter(m < SHORT + DELETIONS).select("b", F.explode(_deletions(F.col("b"))).alias("slot")))


def within(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b) of different keys that meet in a slot and are as near as ``a`` tolerates."""
    near = (F.col("a") != F.col("b")) & tx.within_distance(F.col("a"), F.col("b"), F.col("t"))
    return first.join(second, "slot").filter(near).select("a", "b").distinct()


def near_pairs(keys: DataFrame, budget=tx.typo_budget) -> DataFrame:
    """(a, b): ordered pairs of distinct keys with distance(a, b) <= budget(length of a).

    ``budget`` maps the length of the *first* key of a pair to its tolerated edits.
    """
    lengths = keys.select(F.length("key").alias("n")).distinct()
    met = within(first_rows(keys, budget), second_rows(keys, lengths, budget))
    return met.unionByName(near_in_blocks(keys, None, budget, is_dense))


def alias_table(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    """Curated aliases by key: (key, canonical, canonical_key); the first entry of a key wins."""
    rows = spark.createDataFrame(
        [(position, form, canonical) for position, (variant, canonical) in enumerate(pairs) for form in (variant, canonical)],
        "position int, form string, canonical string",
    )
    keyed = rows.withColumns({"key": tx.title_key(F.col("form")), "canonical_key": tx.title_key(F.col("canonical"))})
    return keyed.groupBy("key").agg(F.min(F.struct("position", "canonical", "canonical_key")).alias("s")).select("key", "s.canonical", "s.canonical_key")


def canonical_title(rows: DataFrame, aliases: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``canonical_title``: the curated form of a known alias, else the title itself."""
    keyed = rows.withColumn("_key", tx.title_key(F.col(title)))
    known = aliases.select(F.col("key").alias("_key"), "canonical")
    joined = keyed.join(known, "_key", "left")
    return joined.withColumn("canonical_title", F.coalesce("canonical", title)).drop("_key", "canonical")


def similarity_self_join(
    rows: DataFrame, title: str, seq: str, aliases: DataFrame | None = None, min_containment_length: int = 1
) -> DataFrame:
    """Edges (a, b) between arrival numbers of titles that name the same film.

    Same key, one key inside the other, few enough typos, or any of these after curated aliases;
    numbered sequels stay apart. A key stands for all its rows through its first arrival, so the
    edges span every set of matching rows without listing each pair. Empty keys match nothing.
    """
    keyed = rows.select(F.col(seq).alias("seq"), tx.title_key(F.col(title)).alias("key")).filter("key <> ''")
    keyed = materialise(keyed)
    spans = keyed.groupBy("key").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    if aliases is None:
        spans = spans.withColumn("canonical_key", F.col("key"))
    else:
        spans = spans.join(aliases.select("key", "canonical_key"), "key", "left")
        spans = spans.withColumn("canonical_key", F.coalesce("canonical_key", "key"))
    spans = materialise(spans)

    copies = keyed.join(spans.select("key", F.col("first").alias("a")), "key").filter("seq <> a")
    edges = copies.select("a", F.col("seq").alias("b"))

    # A key takes part as it is written and, with the arrivals of all its spellings, as the
    # canonical form of an alias. Both forms are compared in one pass.
    nothing = F.lit(None).cast("bigint")
    raw = spans.select("key", F.col("first").alias("raw_first"), F.col("last").alias("raw_last"), nothing.alias("can_first"), nothing.alias("can_last"))
    canonical = spans.select(F.col("canonical_key").alias("key"), nothing.alias("raw_first"), nothing.alias("raw_last"), F.col("first").alias("can_first"), F.col("last").alias("can_last"))
    nodes = raw.unionByName(canonical).groupBy("key").agg(
        F.min("raw_first").alias("raw_first"), F.max("raw_last").alias("raw_last"),
        F.min("can_first").alias("can_first"), F.max("can_last").alias("can_last"),
    )
    nodes = materialise(nodes)
    respelled = spans.filter("key <> canonical_key").select(F.col("canonical_key").alias("key"), F.col("first").alias("a"))
    same = respelled.join(nodes.select("key", "raw_first", "can_first"), "key")
    same = same.select("a", F.explode(F.array("raw_first", "can_first")).alias("b")).filter("b is not null and a <> b")

    inside = containment_pairs(nodes.select("key"), min_containment_length)
    inside = _with_nodes(inside.select(F.col("needle").alias("a"), F.col("hay").alias("b")), nodes)
    inside = inside.filter("(a_raw_first + b_raw_first is not null) or (a_can_first + b_can_first is not null)")
    # The earlier title sets the budget: some arrival of a must precede some arrival of b.
    near = _with_nodes(near_pairs(nodes.select("key")), nodes)
    near = near.filter("coalesce(a_raw_first < b_raw_last, false) or coalesce(a_can_first < b_can_last, false)")
    fuzzy = inside.unionByName(near).filter(~tx.is_numbered_sequel(F.col("a"), F.col("b")))
    fuzzy = fuzzy.selectExpr("coalesce(a_raw_first, a_can_first) as a", "coalesce(b_raw_first, b_can_first) as b")
    return edges.unionByName(same).unionByName(fuzzy).distinct()


def _with_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(side if c == "key" else f"{side}_{c}") for c in nodes.columns]), side)
    return pairs


def candidate_pairs(films: DataFrame, grouped: DataFrame | None = None, max_distance: int = 2) -> DataFrame:
    """Films with nearly equal keys that no rule has grouped: (first_id, second_id, reason).

    One representative, the lowest id, stands for each key. Reasons: a distance of 1 to
    ``max_distance``, or one key being the other plus whole words. ``grouped`` is (id, group).
    """
    reps = materialise(films.groupBy("key").agg(F.min("id").alias("id")))
    near = near_pairs(reps, budget=lambda length: F.lit(max_distance)).filter("a < b")
    # Exploding the word prefixes of a key turns "starts with" into an equi-join.
    words = F.split("key", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    longer = reps.filter(F.size(words) > 1).select(F.col("key").alias("longer"), F.explode(prefixes).alias("key"))
    suffixed = longer.join(reps.select("key"), "key").select(
        F.least("key", "longer").alias("a"), F.greatest("key", "longer").alias("b")
    )
    pairs = near.unionByName(suffixed).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id")), side)
    if grouped is not None:
        for side in ("a", "b"):
            mark = grouped.select(F.col("id").alias(f"{side}_id"), F.col("group").alias(f"{side}_group"))
            pairs = pairs.join(mark, f"{side}_id", "left")
        pairs = pairs.filter(~F.coalesce(F.col("a_group") == F.col("b_group"), F.lit(False)))
    distance = F.levenshtein("a", "b")
    reason = F.when(distance <= max_distance, F.concat(F.lit("distance "), distance.cast("string"))).otherwise("word suffix")
    return pairs.select(
        F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"), F.col("a").alias("first_key"),
        F.col("b").alias("second_key"), reason.alias("reason"),
    )
