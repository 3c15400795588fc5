"""Free-entered place values mapped to the closest entry of a reference list.

Token-level repair: each distinct token of all values is joined to the reference vocabulary by edit
distance (insertions, deletions, substitutions, swaps of neighbours): tokens and vocabulary meet in a join on
strings with characters left out, then the distance is computed. Soft TF-IDF over the repaired tokens then ranks complete
entries; region and country, in full or as a code, tell entries of one name apart. Values that name no entry so far are
ranked once more with neighbouring tokens joined and repaired as one.

A value matches nothing (-1) when it names no entry well enough, names only a region or country, or
names several entries that nothing in it tells apart. Null and blank values are left out.

The reference list may have any size: it is ranked in blocks of at most ``BLOCK`` entries, and the blocks' best entries are
merged. The list of codes (regions and countries) lives in each worker: one above ``MOST_CODES`` rows is refused.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_safe_join, skew_safe_left
from ..session import cut

BLOCK = 20_000
MOST_CODES = 20_000
FILTER = 1 << 22  # bits that tell which strings the vocabulary can give
#: Fixed value: letters that Unicode does not decompose.
PLAIN = str.maketrans({"ł": "l", "Ł": "l", "ı": "i", "İ": "i", "ø": "o", "Ø": "o", "ß": "ss", "đ": "d", "Đ": "d", "æ": "ae", "œ": "oe"})
#: Fixed value: words around a place that say nothing about which place it is.
NOISE = frozenset("the city of downtown near in i live from at de la le".split())
STRETCHED = re.compile(r"(.)\1{2,}|(..)\2")
ACCEPT = 0.70  # least share of an entry's weight that the value's tokens must cover


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(PLAIN)) if not unicodedata.combining(c)).lower()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[-1], most + 1)


def deletions(token: str, depth: int) -> set[str]:
    """The token with up to ``depth`` characters left out."""
    return {token} | {"".join(c for i, c in enumerate(token) if i not in out) for d in range(1, depth + 1) for out in map(set, combinations(range(len(token)), d))}


def allowed(length: int) -> int:
    """Edits allowed in a token of that length: a name is mistyped in one or two places."""
    return 0 if length < 3 else 1 if length < 6 else 2


def value_tokens(value: str) -> list[str]:
    return [t for t in words(value) if t not in NOISE] or words(value)


def joined(text: str | None) -> str:
    return "".join(words(text or ""))


def spellings(city: str | None, alternatives: str | None) -> list[tuple[str, ...]]:
    """The token sequences that name an entry, each also as one word."""
    spelled = [city or "", *(alternatives or "").split("|")]
    return sorted({tuple(w) for x in spelled if (w := words(x))} | {(joined(x),) for x in spelled if joined(x)}) if words(city or "") else []


def unstretched(token: str) -> str:
    """Without letters held, or a pair of letters struck twice."""
    return STRETCHED.sub(lambda m: m[1] or m[2], token)


Ranked = list[tuple[float, float, int]]  # (share of the name covered, what the value says about region and country, place)


def shortened(ranked: Ranked) -> Ranked:
    """What can still decide: of each share near the best, two entries of the most fitting surroundings."""
    top = max((s for s, _, _ in ranked), default=0.0)
    levels: dict[int, Ranked] = defaultdict(list)
    for r in sorted(ranked, key=lambda r: (-r[1], r[2])):
        kept = levels[round(r[0] * 1e9)]
        if r[0] >= max(top - 0.08, ACCEPT) - 1e-9 and len(kept) < 2 and (not kept or kept[0][1] - r[1] < 1e-9):
            kept.append(r)
    return [r for kept in levels.values() for r in kept]


def decide(ranked: Ranked) -> tuple[int, bool]:
    """The place meant or -1, and whether some entry's name fits."""
    top = max((s for s, _, _ in ranked), default=0.0)
    if top < ACCEPT:
        return -1, False
    # a name that also fits a region only speaks for a city when the city's own name is at least as close
    near = [r for r in ranked if r[0] >= top - 1e-9]
    close = [r for r in ranked if r[0] >= top - 0.08 and r[1] >= 1]
    if len(near) > 1 or (near[0][1] == 0 and close):
        pool = near if any(r[1] for r in near) else (close or near)
        most = max(r[1] for r in pool)
        near = [r for r in pool if r[1] >= most - 1e-9]
        if len(near) > 1:
            top = max(r[0] for r in near)
            near = [r for r in near if r[0] >= top - 1e-9]
    return (near[0][2] if len(near) == 1 else -1), True


class Gazetteer:
    """A block of the reference list, and the ranking of its entries; ``count`` holds in how many of ``total`` entries of the whole list each token stands."""

    def __init__(self, entries: Iterable[tuple[int, str, str | None, str | None, str | None]], codes: Iterable[tuple[str, str, str]], count: dict[str, int] | None = None, total: int = 0) -> None:
        self.place: list[int] = []
        self.names: list[list[tuple[str, ...]]] = []
        self.region: list[str] = []
        self.country: list[str] = []
        for place_id, city, region, country, alternatives in entries:
            names = spellings(city, alternatives)
            if not names:
                continue
            self.place.append(place_id)
            self.names.append(names)
            self.region.append(joined(region))
            self.country.append(joined(country))
        self.geo: dict[str, set[tuple[str, str]]] = defaultdict(set)  # vocabulary token: (kind, joined name)
        self.parts: dict[tuple[str, str], tuple[str, ...]] = {}
        self.codes: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for name, code, country in codes:
            self.codes[fold(code)].add((joined(name), joined(country)))
            self._add_geo("region", name)
            self._add_geo("country", country)
        mine = Counter(t for names in self.names for t in {t for n in names for t in n})
        count = mine if count is None else {t: count[t] for t in mine}
        self.known = {*mine, *self.geo}
        total = total + 1 if total else len(self.names) + 1
        self.idf = {t: math.log(total / n) + 0.2 for t, n in count.items()}
        self.core: dict[str, set[int]] = defaultdict(set)  # entries by the tokens that carry their name, not by Saint and the like
        for e, spelled in enumerate(self.names):
            for n in spelled:
                most = max(self.idf[t] for t in n)
                for t in n:
                    if self.idf[t] >= 0.6 * most:
                        self.core[t].add(e)
        self.leading = {n[0] for spelled in self.names for n in spelled if len(n) > 1 and len(n[0]) > 2}  # Saint, Port and the like

    def _add_geo(self, kind: str, name: str | None) -> None:
        parts = tuple(words(name or ""))
        key = (kind, "".join(parts))
        if parts and key not in self.parts:
            self.parts[key] = parts
            for t in {*parts, key[1]}:
                self.geo[t].add(key)

    def repair(self, token: str) -> dict[str, float]:
        """Vocabulary tokens within the allowed edits, with their similarity; a known token is only itself. The plain way, for one block."""
        if token in self.known:
            return {token: 1.0}
        if len(token) <= 2:  # St, Mt, S: the first letter, or the first and the last
            return {t: 0.95 for t in self.leading if abbreviates(token, t)}
        found = {t: s for t in self.known if (s := similarity(token, t)) > 0}
        if not found and (plain := unstretched(token)) != token:
            found = {t: 0.98 * s for t, s in self.repair(plain).items()}
        return found

    def match(self, value: str) -> int:
        """The entry meant by ``value``, or -1. The plain way, for one block."""
        tokens = value_tokens(value)
        pairs = [a + b for a, b in zip(tokens, tokens[1:])]
        options = {t: self.repair(t) for t in tokens}
        found, named = decide(self.rank(tokens, options | {p: {p: 1.0} for p in pairs if p in self.known}))
        return decide(self.rank(tokens, options | {p: self.repair(p) for p in pairs}))[0] if found < 0 and not named else found

    def rank(self, base: list[str], repairs: dict[str, dict[str, float]], idf: dict[str, float] | None = None) -> Ranked:
        """The entries that the tokens of a value may mean; ``repairs`` holds what tokens, and neighbours taken as one word, may stand for."""
        idf = self.idf if idf is None else idf
        tokens, options = list(base), [repairs.get(t, {}) for t in base]
        # two neighbours may be one word torn apart, one word two joined ones: joined names are vocabulary too
        for a, b in zip(base, base[1:]):
            if fits := repairs.get(a + b):
                tokens.append(a + b)
                options.append(fits)
        best: dict[str, float] = {}
        for o in options:
            for t, s in o.items():
                if s > best.get(t, 0):
                    best[t] = s
        geo: dict[tuple[str, str], float] = {}
        for t in best:
            for key in self.geo.get(t, ()):
                s = max(best.get(key[1], 0), min(best.get(p, 0) for p in self.parts[key]))
                if s > 0:
                    geo[key] = s
        codes = [c for t in tokens[1:] if t in self.codes for c in self.codes[t]]
        ranked = []
        for e in {e for t in best for e in self.core.get(t, ())}:
            name_score, around = 0.0, {("region", self.region[e]), ("country", self.country[e])}
            for name in self.names[e]:
                whole = sum(self.idf[t] for t in name)
                covered = sum(self.idf[t] * best.get(t, 0) for t in name)
                # what the value says beyond this name: known tokens that neither the name nor the entry's region and country explain
                extra = sum(
                    0.15 * max(idf[t] * s for t, s in o.items() if t in idf)
                    for o in options
                    if o.keys().isdisjoint(name) and any(t in idf for t in o) and not any(k in around for t in o for k in self.geo.get(t, ()))
                )
                name_score = max(name_score, (covered - min(extra, 0.25 * whole)) / whole)
            where = 0.0
            region, country = geo.get(("region", self.region[e]), 0), geo.get(("country", self.country[e]), 0)
            if region:
                where += 1 + region
            elif any(c == (self.region[e], self.country[e]) for c in codes):
                where += 1.9
            if country:
                where += 0.5 + 0.5 * country
            ranked.append((name_score, where, self.place[e]))
        return ranked


def abbreviates(short: str, token: str) -> bool:
    return token[0] == short[0] and (len(short) == 1 or token[-1] == short[1])


def similarity(token: str, known: str) -> float:
    """Similarity of a token to a vocabulary token, 0 beyond the allowed edits."""
    limit = allowed(max(len(known), len(token)))
    d = edits(token, known, limit)
    return 1 - d / max(len(known), len(token)) if d <= limit else 0.0


def _mapped(df: DataFrame, schema: str, run) -> DataFrame:
    """``run`` over the rows of each batch (tuples), its rows as a table."""
    names, types = zip(*[f.split(" ", 1) for f in schema.split("; ")])
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<struct<s:double,w:double,p:bigint>>": pa.list_(pa.struct([("s", pa.float64()), ("w", pa.float64()), ("p", pa.int64())]))}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*[c.to_pylist() for c in batch.columns]) for out in run(*row)]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(columns, types)], names=list(names))

    return df.mapInArrow(scan, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def repairs(tokens: DataFrame, vocabulary: DataFrame, leading: DataFrame) -> DataFrame:
    """``token, t, sim`` of distinct ``tokens`` (token): the vocabulary tokens that each may stand for.

    A known token is only itself. ``vocabulary`` (t) and ``leading`` (t), the first tokens of names of several words, are tables of any size; a filter of
    ``FILTER`` bits keeps strings that no vocabulary token gives out of the join.
    """
    spark = tokens.sparkSession
    exact = tokens.join(vocabulary.select(F.col("t").alias("token")), "token").select("token", F.col("token").alias("t"), F.lit(1.0).alias("sim"))
    unknown = tokens.join(vocabulary.select(F.col("t").alias("token")), "token", "left_anti")
    unknown = cut(unknown.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token"))  # short rows, but each is much work
    given = cut(_mapped(vocabulary.select("t"), "t string; v string", lambda t: [(t, v) for v in deletions(t, allowed(len(t)))]))
    bits = np.zeros(FILTER, dtype=bool)
    bits[given.select(F.pmod(F.crc32(F.col("v").cast("binary")), F.lit(FILTER)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def shorter(token: str) -> list[tuple[str, str, str, bool]]:
        held = shared.value
        out = []
        for plain in dict.fromkeys((token, unstretched(token))) if len(token) > 2 else ():
            for v in deletions(plain, allowed(len(plain) + 1)):
                b = zlib.crc32(v.encode("utf-8", "surrogatepass")) % FILTER
                if held[b >> 3] >> (7 - (b & 7)) & 1:
                    out.append((token, plain, v, plain != token))
        return out

    met = _mapped(unknown, "token string; plain string; v string; stretched boolean", shorter).join(given, "v").select("token", "plain", "t", "stretched").distinct()

    def measured(token: str, plain: str, t: str, stretched: bool) -> list[tuple[str, str, float, bool, bool]]:
        s = similarity(plain, t)
        return [(token, t, 0.98 * s if stretched else s, stretched, plain == t)] if s > 0 else []

    near = _mapped(met, "token string; t string; sim double; stretched boolean; same boolean", measured)
    best = near.groupBy("token").agg(F.min("stretched").alias("s"), F.max(F.col("stretched") & F.col("same")).alias("k"))
    near = near.join(best, "token").where("stretched = s AND (NOT s OR NOT k OR same)").select("token", "t", "sim")  # held letters count only where nothing else fits, and give a known token alone
    short = unknown.where(F.length("token") <= 2).join(leading, F.substring("token", 1, 1) == F.substring("t", 1, 1)).where("length(token) = 1 OR substring(token, 2, 1) = substring(t, -1, 1)").select("token", "t", F.lit(0.95).alias("sim"))
    return exact.unionByName(near).unionByName(short)


def match_values(values: DataFrame, key: str, value: str, entries: DataFrame, codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, place_id`` for each row of ``values`` (key, value); each distinct value is matched once.

    ``entries``: place_id, city, region, country, alt_names; ``codes``: name, abbreviation, country.
    """
    spark = values.sparkSession
    known = codes.select("name", "abbreviation", "country").where("abbreviation IS NOT NULL AND name IS NOT NULL").limit(MOST_CODES + 1).collect()
    if len(known) > MOST_CODES:
        raise ValueError(f"the list of codes has more than {MOST_CODES} entries")
    code_rows = [tuple(r) for r in known]
    geo = sorted(Gazetteer([], code_rows).geo)
    listed = cut(entries.select(F.col("place_id").cast("bigint").alias("place_id"), "city", "region", "country", "alt_names").where("city IS NOT NULL"))
    each = _mapped(listed, "place_id bigint; t string; first boolean", lambda i, city, region, country, alt: [(i, t, any(len(n) > 1 and n[0] == t and len(t) > 2 for n in names)) for names in [spellings(city, alt)] for t in {t for n in names for t in n}])
    counted = cut(each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first")))
    vocabulary = cut(counted.select("t", "n").unionByName(spark.createDataFrame([(t,) for t in geo], "t string").select("t", F.lit(None).cast("bigint").alias("n"))).groupBy("t").agg(F.max("n").alias("n")))
    leading = counted.where("first").select("t")
    total = each.select("place_id").distinct().count()
    blocks = max(1, math.ceil(listed.count() / block))
    part = F.pmod(F.xxhash64("place_id"), F.lit(2 * blocks if blocks > 1 else 1))

    asked = values.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{value}`").alias("__value")).where(F.col("__value").rlike(r"(?U)\S"))
    distinct = cut(asked.select(F.col("__value").alias("value")).distinct())

    def ranking(rows: DataFrame, every: bool) -> DataFrame:
        """``value, place_id, named`` of the values (value, token, pair) by their tokens; neighbours taken as one are repaired only with ``every``."""
        tokens = rows.groupBy("token").agg(F.min("pair").alias("pair"))
        if not every:
            tokens = tokens.where("NOT pair").select("token").unionByName(tokens.where("pair").join(vocabulary.select(F.col("t").alias("token")), "token").select("token"))
        options = repairs(tokens.select("token"), vocabulary, leading).join(vocabulary, "t")
        options = cut(options.groupBy("token").agg(F.collect_list(F.struct("t", "sim", "n")).alias("o")))  # bounded by the vocabulary around one token
        met = skew_safe_join(rows, options, "token")
        if not every:
            met = met.where("NOT pair OR (size(o) = 1 AND o[0].t = token)")
        grouped = met.groupBy("value").agg(F.collect_set(F.struct("token", "o")).alias("o"))
        grouped = cut(grouped) if blocks > 1 else grouped
        found = None
        for k in range(2 * blocks if blocks > 1 else 1):
            rows_k = listed.where(part == k)
            of_block = _mapped(rows_k, "t string", lambda i, city, region, country, alt: [(t,) for n in spellings(city, alt) for t in n]).distinct().join(counted, "t").select("t", "n").toArrow()
            shared = spark.sparkContext.broadcast(([tuple(r) for r in rows_k.collect()], dict(zip(of_block.column("t").to_pylist(), of_block.column("n").to_pylist()))))
            held: list[Gazetteer] = []

            def rank(v: str, o: list, shared=shared, held=held) -> list:
                if not held:
                    held.append(Gazetteer(shared.value[0], code_rows, shared.value[1], total))
                repaired = {x["token"]: {y["t"]: y["sim"] for y in x["o"]} for x in o}
                idf = {y["t"]: math.log((total + 1) / y["n"]) + 0.2 for x in o for y in x["o"] if y["n"]}
                best = shortened(held[0].rank(value_tokens(v), repaired, idf))
                return [(v, *decide(best))] if blocks == 1 else [(v, [{"s": s, "w": w, "p": p} for s, w, p in best])]

            if blocks == 1:
                return _mapped(grouped, "value string; place_id bigint; named boolean", rank)
            here = cut(_mapped(grouped, "value string; best array<struct<s:double,w:double,p:bigint>>", rank))
            found = here if found is None else found.unionByName(here)
        merged = found.groupBy("value").agg(F.flatten(F.collect_list("best")).alias("best"))  # a few entries of each block
        return _mapped(merged, "value string; place_id bigint; named boolean", lambda v, best: [(v, *decide([(r["s"], r["w"], r["p"]) for r in best]))])

    def parts(v: str) -> list[tuple[str, str, bool]]:
        tokens = value_tokens(v)
        return list({(v, t, False) for t in tokens} | {(v, a + b, True) for a, b in zip(tokens, tokens[1:])})

    rows = cut(_mapped(distinct, "value string; token string; pair boolean", parts))
    first = cut(ranking(rows, False))
    done = first.where("place_id >= 0 OR named")
    second = ranking(rows.join(done.select("value"), "value", "left_anti"), True)
    matched = done.select("value", "place_id").unionByName(second.select("value", "place_id")).withColumnRenamed("value", "__value")
    return skew_safe_left(asked, cut(matched), "__value").select(F.col("__key").alias(key), F.coalesce("place_id", F.lit(-1)).alias("place_id"))
