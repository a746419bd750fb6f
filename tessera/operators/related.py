"""Weighted neighbours of items, for any set of sources at once.

Pairs of items that share an entity grow with the square of its fan-out, so only *light* entities are expanded into pairs. For the *heavy* ones of a
source (its ``MOST_HEAVY`` largest; further ones are expanded too) two facts are used. An item that shares no expanded entity with the source scores
exactly the weight of the heavy entities that both have; and of the items that have the same set of them only the best by popularity can
be among the first ``limit``. So items enter the lists of subsets of their heavy entities, a list keeps ``limit + 1`` items (one
may be the source itself), and a source looks up the lists of its own subsets. Subsets grow one entity at a time, and only those on more than
``light`` items grow: the list of a smaller one is whole, so whoever shares more than it is in it.

An item carries all its entities to where it is met, so a pair is scored in full there, and a source takes only the first ``limit`` of each entity or
list along. Rows before the final ranking are so bounded by the number of sources, whatever the fan-outs; a hot creator, for whom no cap holds,
is one list. No pairs are held in a hash table or sorted: a task holds the members of one light entity or list, ``light`` at most, and its share of the rows before the ranking.

What is scored lower than ``limit`` others of the source are known to be (its *floor*) goes no further: first by the sizes of its entities, then by what it met by light ones.
A list whose subset grows tells nothing to a source whose floor is above the weight of the subset: who shares more is met by a larger one. Light entities and lists are met in rounds of up to ``ROUND`` rows,
whose shuffle is freed before the next one begins, so that disk does not hold all of them at once.

Where the sources' pairs are few, which the sizes of their entities tell, all that is not needed: they are expanded at once, with the same result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import discard, free, stored
from ..schema import Catalog
from .filters import active
from .scoring import popularity

#: Up to so many sources, or entities of sources, are broadcast to the scan of links.
FEW = 200_000
#: Up to so many sources or entities are pushed down to scans.
PUSHED = 200
#: Entities on more items are broadcast to their links, of which one task would else hold all.
CROWD = 100_000
WEIGHTS = {"authors": 10, "characters": 5, "origins": 5, "tags": 1}
#: Sources that share up to so many entities with other items, counted pair by pair beforehand, are expanded without bounds and lists.
PAIRS = 4_000_000
#: Rows of items by entity or list that are dealt, and lie on disk for it, at once.
ROUND = 20_000_000
#: Entities on more items are heavy.
LIGHT = 100
#: An item enters n lists for n heavy entities, one for each pair of them, and one for each larger subset without a smaller whole list; an item with
#: more heavy entities than so many is no member of lists but met by each entity.
MOST_HEAVY = 10


def fanout_cap(catalog: Catalog) -> DataFrame:
    """One row: a twentieth of the active items, at least 100."""
    return active(catalog.items).agg(F.greatest(F.lit(100), F.expr("count(*) div 20")).alias("cap"))


def _local(rows: DataFrame) -> DataFrame:
    """Up to ``PUSHED`` rows as a local table, so that plans that use them several times need not find them again; more stay as they are."""
    first = rows.limit(PUSHED + 1).collect()
    return rows.sparkSession.createDataFrame(first, rows.schema) if len(first) <= PUSHED else rows


def _of(links: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """The links that have one of ``keys`` (item_id; or kind, entity_id), and whether they were chosen without a shuffle, as for up to ``FEW`` keys;
    the first few reach the scan as equalities."""
    first = keys.limit(PUSHED + 1).collect()
    if len(first) > PUSHED:
        few = keys.limit(FEW + 1).count() <= FEW
        return links.join(F.broadcast(keys) if few else keys, keys.columns, "left_semi"), few
    *fixed, last = keys.columns
    groups = defaultdict(list)
    for r in first:
        groups[r[:-1]].append(r[-1])
    fits = (reduce(and_, (F.col(c) == v for c, v in zip(fixed, values)), F.col(last).isin(ids)) for values, ids in groups.items())
    return links.where(reduce(or_, fits, F.lit(False))), True


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _code() -> Column:
    """A kind and an entity as one number, whose last two bits are the kind (ids have 53 bits at most)."""
    return F.coalesce(*(F.when(F.col("kind") == k, F.col("entity_id") * len(WEIGHTS) + n) for n, k in enumerate(WEIGHTS)))


def _weight(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in WEIGHTS.values())), (F.pmod(code, F.lit(len(WEIGHTS))) + 1).cast("int"))


def _weights(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0), lambda total, c: total + _weight(c))


def usable_links(catalog: Catalog, sources: DataFrame | None) -> DataFrame:
    """(item_id, code, n) of active items: entities on more active items (``n``) than the cap are left out but for creators, so are those on one item,
    and with ``sources`` those of no source."""
    keys, links, asked, few = ["kind", "entity_id"], catalog.links, None, False
    if sources is not None:
        asked = _of(links, sources.select("item_id"))[0].select(*keys).distinct()
        chosen, few = _of(links, asked)
        if few:
            links = chosen
    links = links.join(active(catalog.items).select("item_id"), "item_id", "left_semi").where(F.col("kind").isin(*WEIGHTS))
    if not few:
        links = stored(links)
    sizes = links.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    fits = (F.col("kind") == "authors") | (F.col("n") <= F.col("cap"))
    sizes = sizes.join(F.broadcast(fanout_cap(catalog)), how="cross").select(*keys, "n", fits.alias("usable"))  # ``cap`` is one row
    if few:
        sized = links.join(F.broadcast(sizes.where("usable")), keys)
    else:
        # dealt by entity, links of a crowded one would all be one task's, and be sorted there even if the cap leaves it out
        if asked is not None:
            sizes = sizes.join(asked.withColumn("asked", F.lit(True)), keys, "left").select(*keys, "n", (F.col("usable") & F.col("asked").isNotNull()).alias("usable"))
        sizes = stored(sizes)
        crowded, rest = sizes.where(F.col("n") > CROWD), sizes.where(F.col("usable") & (F.col("n") <= CROWD)).drop("usable")
        sized = links.join(F.broadcast(crowded.where("usable").drop("usable")), keys)
        sized = sized.unionByName(links.join(F.broadcast(crowded.select(*keys)), keys, "left_anti").join(rest, keys))
    return sized.select("item_id", _code().alias("code"), "n")


def profiles(links: DataFrame, items: DataFrame, sources: DataFrame | None, light: int, limit: int) -> DataFrame:
    """(item_id, popularity, asks, floor, codes, light, heavy): an item's entities, those on up to ``light`` items and the others, the largest first; ``limit``
    other items at least score ``floor``."""
    codes = lambda fits: F.transform(F.filter("sized", fits), lambda x: x["code"])
    rows = links.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "code")), asc=False).alias("sized")).join(items, "item_id")
    if sources is None:
        rows = rows.withColumn("asks", F.lit(True))
    else:
        rows = rows.join(sources.select("item_id", F.lit(True).alias("asks")), "item_id", "left").fillna(False, ["asks"])
    floor = F.coalesce(F.array_max(F.transform(F.filter("sized", lambda x: x["n"] > limit), lambda x: _weight(x["code"]))), F.lit(0)).cast("long")
    return rows.select(
        "item_id", "popularity", "asks", floor.alias("floor"), codes(lambda x: F.lit(True)).alias("codes"), codes(lambda x: x["n"] <= light).alias("light"), codes(lambda x: x["n"] > light).alias("heavy"),
    )


def _score(own: Column | str, other: Column | str) -> Column:
    return _weights(F.array_intersect(own, other)).cast("long")


def _firsts(source: Column, own: Column, floor: Column, members: Column, limit: int) -> Column:
    """The first ``limit`` of members (popularity, item_id, codes) for a source with entities ``own``, as (score, popularity, item_id); none below ``floor``."""
    others = F.filter(members, lambda m: m["item_id"] != source)
    scored = F.transform(others, lambda m: F.struct(_score(own, m["codes"]).alias("score"), m["popularity"].alias("popularity"), m["item_id"].alias("item_id")))
    return F.slice(F.sort_array(F.filter(scored, lambda x: x["score"] >= floor), asc=False), 1, limit)


def _among(members: Column, asking: Column, limit: int) -> Column:
    """(source_id, firsts) of each of ``asking``, all of them members, that finds any."""
    each = F.transform(asking, lambda s: F.struct(s["item_id"].alias("source_id"), _firsts(s["item_id"], s["codes"], s["floor"], members, limit).alias("firsts")))
    return F.filter(each, lambda x: F.size(x["firsts"]) > 0)


def _in_rounds(rows: DataFrame, count: int, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on up to ``count`` rows, on those of some keys at a time if there are more than ``ROUND``; stored."""
    n, parts = max(1, -(-count // ROUND)), []
    for k in range(n):
        parts.append(stored(work(rows if n < 2 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))))
        free(rows.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def _rows(found: DataFrame) -> DataFrame:
    """A row for each of ``firsts``."""
    return found.select("source_id", F.explode("firsts").alias("x")).select("source_id", "x.item_id", "x.popularity", "x.score")


def _met(profile: DataFrame, limit: int) -> DataFrame:
    """What sources meet by their light entities."""
    def work(rows: DataFrame) -> DataFrame:
        groups = rows.repartition("code").groupBy("code").agg(F.collect_list(F.struct("popularity", "item_id", "codes", "asks", "floor")).alias("members"))
        return _rows(groups.select(F.explode(_among(F.col("members"), F.filter("members", lambda m: m["asks"]), limit)).alias("x")).select("x.*"))

    rows = profile.select("asks", "floor", "popularity", "item_id", "codes", F.explode("light").alias("code"))
    return _in_rounds(rows, rows.count(), "code", work)


def _grown(rows: DataFrame) -> DataFrame:
    """Each subset with one more of the (sorted) ``kept`` behind its last."""
    more = F.filter("kept", lambda c: c > F.element_at("subset", -1))
    return rows.withColumn("subset", F.explode(F.transform(more, lambda c: F.concat("subset", F.array(c)))))


def _asking(profile: DataFrame, most: int) -> DataFrame:
    """(source_id, own, floor, rich, kept, subset) of sources: each of their first ``most`` heavy entities by itself."""
    kept = F.sort_array(F.slice("heavy", 1, most)).alias("kept")
    rows = profile.where(F.col("asks")).select(F.col("item_id").alias("source_id"), F.col("codes").alias("own"), "floor", (F.size("heavy") > most).alias("rich"), kept)
    return rows.withColumn("subset", F.explode(F.transform("kept", lambda c: F.array(c))))


def _asked(asked: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """What sources meet by lists (subset, members)."""
    both = asked.select("source_id", "own", "floor", "subset").join(lists, "subset")
    return _rows(both.select("source_id", _firsts(F.col("source_id"), F.col("own"), F.col("floor"), F.col("members"), limit).alias("firsts")))


def _tells() -> Column:
    """Whether a subset that grows can tell something to a source."""
    return _weights(F.col("subset")) >= F.col("floor")


def _listed(profile: DataFrame, sources: DataFrame | None, limit: int, light: int, most: int, crowded: bool) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """What sources meet by the lists of subsets of two and more of their heavy entities; tables to discard when that is read; the lists of one entity."""
    asked, found, spent, alone = _asking(profile, most), [], [], None
    owned = profile.where(F.size("heavy") <= most).select("item_id", "popularity", "codes", "asks", "floor", F.sort_array("heavy").alias("kept"))
    owned = owned.withColumn("subset", F.explode(F.transform("kept", lambda c: F.array(c))))
    best = F.row_number().over(Window.partitionBy("subset").orderBy(F.desc("popularity"), F.desc("item_id")))
    members = F.sort_array(F.collect_list(F.struct("popularity", "item_id", "codes", "asks", "floor")), asc=False).alias("members")

    for size in range(1, most + 1):
        n = owned.count()
        if sources is not None and size > 1:  # links are those of the sources' entities, so lists of one entity are asked for
            owned = owned.join(_few(asked.select("subset").distinct()), "subset", "left_semi")
        kept = limit + 1 if size == 1 else max(light, limit) + 1

        def work(rows: DataFrame, kept: int = kept, size: int = size) -> DataFrame:
            tops = rows.withColumn("_rank", best).where(F.col("_rank") <= kept)
            lists = tops.groupBy("subset").agg(members)
            # whoever enters lists is in the list itself, so one that has no other tells something only to sources that enter none
            lists = lists if crowded else lists.where(F.size("members") > 1)
            if size == 1:
                return lists.select("subset", "members")
            # a whole list is met at once by those in it, and kept for those that enter none; of others the first are kept (under another name,
            # as lambdas would take an alias ``members`` of the same select for the column)
            grows = F.size("members") > light
            asking = F.filter("members", lambda m: m["asks"])
            return lists.select(
                "subset", grows.alias("grows"), F.when(grows, F.slice("members", 1, limit + 1)).when(F.lit(crowded), F.col("members")).alias("kept"),
                F.when(~grows, _among(F.col("members"), asking, limit)).alias("each"),
            )

        lists = _in_rounds(owned, n, "subset", work)
        if size == 1:
            grow = alone = lists
        else:
            spent.append(lists)
            found.append(_rows(lists.select(F.explode("each").alias("x")).select("x.*")))
            if crowded:
                found.append(_asked(asked.where("rich"), lists.where("not grows").select("subset", F.col("kept").alias("members")), limit))
            grow = lists.where("grows").select("subset", F.col("kept").alias("members"))
        if grow.isEmpty():
            break
        if size > 1:
            asked, owned = (stored(rows.join(_few(grow.select("subset")), "subset", "left_semi")) for rows in (asked, owned))
            spent += [asked, owned]
            free(profile.sparkSession)
            found.append(_asked(asked.where(_tells()), grow, limit))
        asked, owned = _grown(asked), _grown(owned)
    return found, spent, alone


def _raised(profile: DataFrame, met: DataFrame, limit: int) -> DataFrame:
    """Profiles with floors by what sources have met."""
    last = met.where(F.col("rank") == limit).select(F.col("source_id").alias("item_id"), F.col("score").alias("last"))
    return profile.join(last, "item_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("last", F.lit(0).cast("long")))).drop("last")


def candidates(links: DataFrame, items: DataFrame, sources: DataFrame | None, limit: int, light: int = LIGHT, most: int = MOST_HEAVY) -> tuple[DataFrame, DataFrame]:
    """(source_id, item_id, popularity, score) with the first ``limit`` of every source, some of them several times, and the profiles of the items."""
    profile = stored(profiles(links, items, sources, light, limit))
    rank = lambda rows: _in_rounds(rows, rows.count(), "source_id", lambda part: _ranked(part.repartition("source_id"), limit, "popularity"))
    each = _met(profile, limit)
    met = rank(each)
    discard(each)
    first, profile = profile, stored(_raised(profile, met, limit).drop("light"))
    discard(first)
    rich = profile.where(F.size("heavy") > most)
    crowded = not rich.isEmpty()
    listed, spent, alone = _listed(profile, sources, limit, light, most, crowded)
    if listed:
        first, met = met, rank(reduce(DataFrame.unionByName, listed, met.drop("rank")))
        for rows in (first, *spent):
            discard(rows)
    found = [met.drop("rank"), _asked(_asking(_raised(profile, met, limit), most).where(_tells()), alone, limit)]
    if crowded:
        asking = profile.where(F.col("asks")).select(F.col("item_id").alias("source_id"), F.col("codes").alias("own"), "heavy")
        met_by = lambda source, other: source.join(other.select("item_id", "popularity", "codes", F.explode("heavy").alias("code")), "code").where("item_id <> source_id")
        kept, opened = (asking.select("source_id", "own", F.explode(F.slice("heavy", *part)).alias("code")) for part in ((1, most), (most + 1, 1 << 30)))
        found += [x.select("source_id", "item_id", "popularity", _score("own", "codes").alias("score")) for x in (met_by(kept, rich), met_by(opened, profile))]
    return reduce(DataFrame.unionByName, found), profile


def _ranked(scored: DataFrame, limit: int, *more: str) -> DataFrame:
    """(source_id, rank, item_id, score) and ``more`` of (source_id, item_id, popularity, score); rows may be repeated."""
    order = Window.partitionBy("source_id").orderBy(F.col("score").desc(), F.col("popularity").desc(), F.col("item_id").desc())
    ranked = scored.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= limit)
    return ranked.dropDuplicates(["source_id", "rank"]).select("source_id", "rank", "item_id", "score", *more)


def related_items(catalog: Catalog, sources: DataFrame | None = None, limit: int = 12, light: int = LIGHT, most: int = MOST_HEAVY, pairs: int = PAIRS) -> DataFrame:
    """(source_id, rank, item_id, score): items that share a creator (10), characters, origins (5 each) and tags (1); by score, popularity and id.

    Entities but creators on more active items than the cap are ignored. With ``sources`` only the links of their entities are read on.
    """
    items = active(catalog.items).select("item_id", popularity().alias("popularity"))
    if sources is not None:
        sources = _local(sources.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_semi"))
    links = stored(usable_links(catalog, sources))
    free(links.sparkSession)
    if sources is not None:
        wanted = links.join(sources, "item_id", "left_semi")
        if (wanted.agg(F.sum("n")).first()[0] or 0) <= pairs:
            met = wanted.select(F.col("item_id").alias("source_id"), "code").join(links.select("item_id", "code"), "code").where("item_id <> source_id")
            return _ranked(met.groupBy("source_id", "item_id").agg(F.sum(_weight(F.col("code"))).alias("score")).join(items, "item_id"), limit)
    found, _ = candidates(links, items, sources, limit, light, most)
    return _ranked(found.repartition("source_id"), limit)  # dealt once, before ranks are cut, so that no task sorts what it is about to deal
