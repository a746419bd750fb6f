"""Random catalogues, and plain Python models of what the operators find in them."""

import datetime as dt
import random
import re
import unicodedata

from tessera.schema import FACET_MODES, KINDS, SORT_MODES, Catalog, SearchRequest

ITEM = "item_id long, title string, creator_id long, creator_display_name string, published_at timestamp_ntz, view_count long, favorite_count long, status string"
WORDS = "harbour lantern Orchid velvet copper ember driftwood Willow 夏の海 灯台守 café ÜBER a1 b2x xy %".split()
NOW = dt.datetime(2031, 9, 1)
WEIGHTS = {"authors": 10, "characters": 5, "origins": 5, "tags": 1}


def build(spark, items, entities, links):
    """items: (id, title, creator, published, views, favorites, status); entities: (kind, id, name); links: (item, kind, id)."""
    names = {i: n for k, i, n in entities if k == "authors"}
    rows = [(i, t, c, names.get(c), dt.datetime.fromisoformat(p) if p else None, v, f, s) for i, t, c, p, v, f, s in items]
    links = [*links, *((r[0], "authors", r[2]) for r in rows if r[2] is not None)]
    return Catalog(
        spark.createDataFrame(rows, ITEM),
        spark.createDataFrame(entities, "kind string, entity_id long, name string"),
        spark.createDataFrame(links, "item_id long, kind string, entity_id long"),
    )


class World:
    """A random catalogue as a ``Catalog`` and as plain rows."""

    def __init__(self, spark, seed: int, n: int = 70):
        rnd = self.rnd = random.Random(seed)
        phrase = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
        self.names = {(kind, 1000 * a + k): f"{phrase(1)} {kind[:2]}{k}" for a, kind in enumerate(KINDS) for k in range(7)}
        self.items, self.links = {}, set()
        for i in rnd.sample(range(1, 5000), n):
            creator = rnd.choice([None, *(e for k, e in self.names if k == "authors")])
            published = rnd.choice([None, NOW - dt.timedelta(days=rnd.randrange(40), minutes=rnd.randrange(3))])
            count = lambda: rnd.choice([None, rnd.randrange(6), rnd.randrange(3000)])
            self.items[i] = {"title": phrase(rnd.randint(1, 4)), "creator": creator, "published": published, "views": count(), "favorites": count(), "status": rnd.choice(("active",) * 5 + ("missing",))}
            self.links |= {(i, kind, e) for kind, e in self.names if kind != "authors" and rnd.random() < 0.2}
            self.links |= {(i, "authors", creator)} if creator is not None else set()
        rows = [(i, x["title"], x["creator"], x["published"] and str(x["published"]), x["views"], x["favorites"], x["status"]) for i, x in self.items.items()]
        self.catalog = build(spark, rows, [(k, i, n) for (k, i), n in self.names.items()], [x for x in self.links if x[1] != "authors"])

    def active(self):
        return [i for i, x in self.items.items() if x["status"] == "active"]

    def of(self, item, kind):
        return {e for i, k, e in self.links if (i, k) == (item, kind)}

    def popularity(self, item):
        return (self.items[item]["views"] or 0) + 50 * (self.items[item]["favorites"] or 0)

    def hot(self, item, now=NOW):
        hours = (now - (self.items[item]["published"] or dt.datetime(1970, 1, 1))).total_seconds() / 3600
        return self.popularity(item) / (max(hours, 0.0) + 6)

    # ---- search
    def has(self, item, token):
        texts = [self.items[item]["title"], " ".join(self.names[k, e] for k in KINDS for e in self.of(item, k))]
        if len(token) >= 3:
            return any(token.lower() in t.lower() for t in texts)
        if all(unicodedata.name(c).startswith(("CJK", "HIRAGANA", "KATAKANA")) for c in token):
            return any(token in t for t in texts)
        flat = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        head = re.findall(r"[^\W_]+", flat(token))
        return bool(head) and any(w.startswith(head[0]) for t in texts for w in re.findall(r"[^\W_]+", flat(t)))

    def fits(self, item, r: SearchRequest):
        x = self.items[item]
        for (kind, mode), ids in r.facets.items():
            met = self.of(item, kind) & set(ids)
            if ids and (bool(met) if mode == "not" else not met if mode == "any" else met != set(ids)):
                return False
        for side, day in enumerate(r.days):
            if day and (x["published"] is None or (x["published"].date() < dt.date.fromisoformat(day) if side == 0 else x["published"].date() > dt.date.fromisoformat(day))):
                return False
        for column, (low, high) in r.counts.items():
            n = x[{"view_count": "views", "favorite_count": "favorites"}[column]] or 0
            if (low is not None and n < low) or (high is not None and n > high):
                return False
        tokens = r.text.split()
        return not tokens or (any if r.match == "any" else all)(self.has(item, t) for t in tokens)

    def found(self, r: SearchRequest):
        """Ids in the order of the request."""
        name, way = r.order.rsplit("_", 1)

        def key(i):
            x = self.items[i]
            value = {"published": x["published"], "views": x["views"], "favorites": x["favorites"], "popularity": self.popularity(i), "hot": self.hot(i)}[name]
            second = x["published"] if name in ("views", "favorites") else None
            return (value is not None, value or (dt.datetime.min if name == "published" else 0), second is not None, second or dt.datetime.min, i)

        return sorted((i for i in self.active() if self.fits(i, r)), key=key, reverse=way == "desc")

    def request(self):
        rnd = self.rnd
        pick = lambda kind, most: rnd.sample([e for k, e in self.names if k == kind], rnd.randint(1, most))
        facets = {(kind, mode): pick(kind, 1 if mode == "not" else 2 if mode == "all" else 3) for kind, modes in FACET_MODES.items() for mode in modes if rnd.random() < 0.12}
        tokens = rnd.sample([*(w.lower()[: rnd.choice((1, 2, 4, 9))] for w in WORDS), "a", "夏", "灯台", "#", "ta3", "zzz"], rnd.choice((0, 0, 1, 1, 2, 3)))
        day = lambda: rnd.choice(["", "", "", str((NOW - dt.timedelta(days=rnd.randrange(40))).date())])
        bound = lambda: rnd.choice([None, None, rnd.randrange(2000)])
        counts = {c: (bound(), bound()) for c in ("view_count", "favorite_count") if rnd.random() < 0.3}
        return SearchRequest(" ".join(tokens), rnd.choice(("all", "any")), facets, (day(), day()), counts, rnd.choice(SORT_MODES))
