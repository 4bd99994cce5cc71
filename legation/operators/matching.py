"""Suggested matches for names without a counterpart (Q5).

Two names within d edits have first p characters (padded where a name is
shorter) that share a text of p - d characters, and so have their last p. Names
are therefore joined on the texts that d deletions leave of such a window, and
the edit distance decides. Random names share such a text seldom, however many
there are; hot windows are found by counting the pairs beforehand, and another
end or a longer window is taken while pairs outnumber keys.

Where the short windows are hot, rare grams are counted as well. Every name is
cut into grams of ``q`` characters, repeated grams numbered. An edit changes at
most q of them, so two names within d edits that have more than q d grams share
one among the q d + 1 rarest of each. Names are joined on their rarest grams
and on lengths at most d apart. Two names too short for that share a text that
d deletions leave of both. A pair is compared at its least common key alone.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.session import shared_dir

# Padding around a name, so that its ends have grams of their own.
_HEAD, _TAIL = "\x01", "\x02"
WINDOW = 5  # characters of the first window per edit
KEY_SHARE = 16  # one window key in so many is counted when windows are compared


def _padded(name: Column, q: int) -> Column:
    """The name with ends of its own: it has its length + q - 1 grams."""
    return F.concat(F.lit(_HEAD * (q - 1)), name, F.lit(_TAIL * (q - 1)))


def _without(texts: Column) -> Column:
    """The texts, and each of them less one character."""

    def less_one(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(s) + 1)
        return F.transform(places, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))

    return F.array_distinct(F.flatten(F.transform(texts, less_one)))


def _keys(names: DataFrame, d: int, q: int) -> DataFrame:
    """``names`` (name, left, right) with its length ``n`` and join keys ``keys``."""
    base = ["name", "left", "right"]
    starts = F.sequence(F.lit(1), F.char_length("name") + (q - 1))
    cut = names.select(*base, _padded(F.col("name"), q).alias("text"), F.explode(starts).alias("i"))
    grams = cut.select(*base, F.substr("text", F.col("i"), F.lit(q)).alias("gram"))
    counted = grams.groupBy(*base, "gram").agg(F.count(F.lit(1)).alias("c"))
    # Grams are of one length, so gram and number cannot be confused.
    tokens = counted.select(*base, F.explode(F.sequence(F.lit(1), "c")).alias("k"), "gram").select(
        *base, F.concat(F.lit("g"), "gram", F.col("k").cast("string")).alias("token")
    )
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    short = F.char_length("name") + (q - 1) <= q * d
    rest = F.array("name")
    for _ in range(d):
        rest = _without(rest)
    left_over = names.where(short).select(*base, F.lit(0).cast("long").alias("f"), F.explode(rest).alias("rest"))
    left_over = left_over.select(*base, "f", F.concat(F.lit("d"), "rest").alias("token"))
    ranked = tokens.join(often, "token").select(*base, "f", "token").unionByName(left_over)
    keys = F.sort_array(F.collect_list(F.struct("f", "token")))["token"]
    keyed = ranked.groupBy(*base).agg(keys.alias("keys"))
    n = F.char_length("name").alias("n")
    return keyed.select(*base, n, F.when(short, F.col("keys")).otherwise(F.slice("keys", 1, q * d + 1)).alias("keys"))


def _window(name: Column, p: int, tail: bool) -> Column:
    """The first ``p`` characters of the name, or its last ones read backwards, padded."""
    return F.rpad(F.reverse(name) if tail else name, p, _TAIL)


def _window_keys(names: DataFrame, d: int, p: int, tail: bool) -> DataFrame:
    """``names`` once per ``key``: the hash of the window (``whole``) and of each text that d deletions leave of it."""
    # Places of the deletions, with an end after the last; no places at all are the window itself.
    places = [[]] + [[*some, p + 1] for some in combinations(range(1, p + 1), d)]
    literal = F.array(*[F.array(*[F.lit(x) for x in some]).cast("array<int>") for some in places])
    at = names.withColumn("w", _window(F.col("name"), p, tail)).withColumn("at", F.explode(literal))
    x = [F.lit(0), *[F.col("at")[i] for i in range(d + 1)]]
    rest = F.concat(*[F.substr("w", x[i] + 1, x[i + 1] - x[i] - 1) for i in range(d + 1)])
    # In a run of one character any deletion leaves the same, so the last places of the run do.
    last = F.lit(True)
    for i in range(1, d + 1):
        last &= (x[i + 1] == x[i] + 1) | (F.substr("w", x[i], F.lit(1)) != F.substr("w", x[i] + 1, F.lit(1)))
    whole = F.size("at") == 0
    key = F.xxhash64(F.when(whole, F.col("w")).otherwise(rest)).alias("key")
    return at.where(whole | last).select(*names.columns, whole.alias("whole"), key)


def _window_pairs(names: DataFrame, d: int, p: int, tail: bool) -> int:
    """About how many pairs meet at the window keys; those of equal windows are counted exactly."""
    keys = _window_keys(names, d, p, tail).where(F.col("whole") | (F.pmod("key", F.lit(KEY_SHARE)) == 0))
    met = keys.groupBy("whole", "key").agg(F.count_if("left").alias("l"), F.count_if("right").alias("r"))
    pairs = F.col("l").cast("double") * F.col("r") * F.when(F.col("whole"), 1).otherwise(KEY_SHARE)
    return int(met.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("n")).first()["n"])


def _by_windows(names: DataFrame, d: int, p: int, tail: bool) -> DataFrame:
    """Pairs ``a, b, e`` of names within ``d`` edits by the keys of their windows."""
    keys = _window_keys(names, d, p, tail)
    a = keys.where("left").select(F.col("name").alias("a"), "key")
    b = keys.where("right").select(F.col("name").alias("b"), F.col("key").alias("b_key"))
    window = _window(F.col("a"), p, tail)
    # Equal windows share every key and are compared at that of the window.
    once = (window != _window(F.col("b"), p, tail)) | (F.col("key") == F.xxhash64(window))
    close = F.abs(F.char_length("a") - F.char_length("b")) <= d
    near = (F.col("key") == F.col("b_key")) & close & once & (F.levenshtein("a", "b", d) >= 0)
    # Spark's estimate of a side leaves out the keys per name, so no side is broadcast.
    return a.join(b.hint("merge"), near).select("a", "b").distinct().withColumn("e", F.levenshtein("a", "b", d))


def _gram_sides(keyed: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """The names to match and the reference, once per key and length that may meet."""
    a = keyed.where("left").select(F.col("name").alias("a"), F.col("n").alias("n"), F.col("keys").alias("a_keys"), F.explode("keys").alias("key"))
    b = keyed.where("right").select(F.col("name").alias("b"), F.col("n").alias("b_n"), F.col("keys").alias("b_keys"), F.explode("keys").alias("key"))
    return a, b.withColumn("n", F.explode(F.sequence(F.col("b_n") - d, F.col("b_n") + d)))


def _gram_pairs(keyed: DataFrame, d: int) -> int:
    """How many pairs meet at the gram keys."""
    a, b = [side.groupBy("key", "n").agg(F.count(F.lit(1)).cast("double").alias(c)) for side, c in zip(_gram_sides(keyed, d), "lr")]
    return int(a.join(b.hint("merge"), ["key", "n"]).agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0.0)).alias("n")).first()["n"])


def _by_grams(keyed: DataFrame, d: int) -> DataFrame:
    """Pairs ``a, b, e`` of names within ``d`` edits by their rarest grams."""
    a, b = _gram_sides(keyed, d)
    # The edit distance within a bound is cheaper than the keys' intersection and rules out nearly all pairs.
    near = a.join(b.hint("merge"), ["key", "n"]).withColumn("e", F.levenshtein("a", "b", d)).where("e >= 0")
    return near.where(F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")).select("a", "b", "e")


def _near(names: DataFrame, d: int, q: int) -> DataFrame:
    """Pairs ``a, b, e`` of names within ``d`` edits, by the keys that cost least.

    A way costs its keys and the pairs that meet at them. Ways are tried from
    few keys to many, until the pairs of one are no more than its keys.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.char_length("name")), F.lit(0)).alias("longest")).first()
    p, keyed, best, least = WINDOW * max(d, 1), None, None, float("inf")
    while True:
        keys = seen["n"] * (comb(p, d) + 1)
        for tail in (False, True):
            pairs = _window_pairs(names, d, p, tail)
            if keys + pairs < least:
                best, least = (p, tail), keys + pairs
            if pairs <= keys:
                break
        if least <= 2 * keys or p >= seen["longest"]:
            break
        if keyed is None:
            keyed = _keys(names, d, q).repartition(parts, "name").checkpoint(eager=True)
            keys, pairs = seen["n"] * (q * d + 1), _gram_pairs(keyed, d)
            if keys + pairs < least:
                best, least = None, keys + pairs
        p = p * 3 // 2 + 1
        if least <= seen["n"] * (comb(p, d) + 1):
            break
    return _by_grams(keyed, d) if best is None else _by_windows(names, d, *best)


def suggested_matches(
    unmatched: DataFrame,
    reference: DataFrame,
    name: str,
    reference_name: str,
    max_distance: int = 2,
    q: int = 3,
    nearest: bool = False,
    suggestion: str = "suggestion",
    distance: str = "distance",
) -> DataFrame:
    """Q5: reference names within ``max_distance`` edits of each unmatched name.

    One row per pair of different texts (insertions, deletions and
    replacements of characters; a name that is in the reference is at distance
    0 from itself). Repeated names count once, nulls match nothing, the empty
    name is a name. With ``nearest`` each name keeps its nearest suggestion,
    the first in code point order among equals. Names without a suggestion
    have no row. Letters are compared as they are: apply ``normalise_keys``
    first to compare otherwise. Larger ``q`` makes grams rarer and needs more
    of them; the result is the same. All names are joined; counts taken
    beforehand only choose the keys.
    """
    if max_distance < 0 or q < 2:
        raise ValueError("max_distance is 0 or more and q 2 or more")
    d = max_distance
    shared_dir(unmatched.sparkSession, "matches")  # makes sure a checkpoint folder is set
    left = unmatched.select(F.col(name).alias("name"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = reference.select(F.col(reference_name).alias("name"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    names = left.unionByName(right).where(F.col("name").isNotNull())
    names = names.groupBy("name").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    # Few bytes make many keys and pairs, so partitions must not be merged by their size.
    parts = int(unmatched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.repartition(parts, "name").checkpoint(eager=True)  # each is read more than once
    near = _near(names, d, q)
    if nearest:
        best = near.groupBy("a").agg(F.min(F.struct("e", "b")).alias("best"))
        near = best.select("a", "best.b", "best.e")
    return near.select(F.col("a").alias(name), F.col("b").alias(suggestion), F.col("e").alias(distance))
