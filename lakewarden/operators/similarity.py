"""Near sets: a join of token sets by Jaccard similarity, without a product of all pairs.

Tokens are put in one order for all sets, rarest first.  Two sets of similarity t share a
token among the first n - ceil(t n) + 1 of each, so only these are joined, and a pair is
looked at only where its sizes and the places of the token still allow t.  Where the smaller
set has from 2 to SMALL tokens and t is a half or more, two tokens at least are common, and
both stand among the first n - ceil(t n) + 2; such sets are joined by pairs of tokens, which
far fewer share than share a token.  A key that
stands in very many of these prefixes is cut into blocks by set, and each pair of blocks
is a key of its own, as is, for single tokens, each size of the smaller set.  A pair comes out at its first common tokens only, so nothing has to
be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.session import stored

BLOCK = 4096
SMALL = 12  # larger sets have too many pairs of tokens
BY_PAIRS = 50  # percent; below it small sets may be near by one token


def _ceil(over: Column, under: int) -> Column:
    return F.call_function("div", over + F.lit(under - 1), F.lit(under))


def by_rarity(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """set_id, size and tokens, those that fewest sets have first; sets without tokens are left out.

    Tokens come out as numbers, one each.  ``rare`` is how many of a set's tokens at most
    ``block`` sets have.
    """
    tokens = sets.select("set_id", F.explode("tokens").alias("token"))
    counts = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "id", F.monotonically_increasing_id()), "tokens")
    order = F.array_sort(F.collect_list(F.struct("n", "id")))
    ordered = tokens.join(counts, "token").groupBy("set_id").agg(
        order.alias("ordered"), F.count_if(F.col("n") <= block).cast("int").alias("rare"))
    return ordered.select("set_id", F.size("ordered").alias("size"), F.col("ordered.id").alias("tokens"), "rare")


def _least_common(smaller: Column, larger: Column, percent: int) -> Column:
    """How many tokens sets of these sizes have in common if they are near."""
    return _ceil((smaller + larger) * percent, 100 + percent)


def _paired(size: Column, percent: int) -> Column:
    """Whether the smaller set of a pair, of this size, is joined by pairs of tokens."""
    return size.between(2, SMALL) if percent >= BY_PAIRS else F.lit(False)


def postings(ordered: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """One row per set and key of its prefix, with the key's ``own`` block of ``blocks``.

    A key is the token at ``place``, from 0, or with that at ``last`` a pair of them; where both
    are the same it is a single one.  ``token`` is its hash.
    """
    size, place, last = F.col("size"), F.col("place"), F.col("last")
    least = _ceil(size * percent, 100)
    pairs = (size > 1) & (least <= SMALL) if percent >= BY_PAIRS else F.lit(False)
    singles = (least < 2) | (size > SMALL) if percent >= BY_PAIRS else F.lit(True)
    end = F.when(pairs, F.least(size - least + 1, size - 1)).otherwise(size - least).cast("int")
    rows = ordered.select("*", F.explode(F.sequence(F.lit(0), end)).alias("place"))
    rows = rows.select("*", F.explode(F.sequence(place, F.when(pairs, end).otherwise(place))).alias("last"))
    rows = rows.filter((last > place) | (singles & (place <= size - least)))
    one, two = F.get("tokens", place), F.get("tokens", last)
    rows = rows.withColumn("token", F.when(last > place, F.xxhash64(one, two)).otherwise(F.xxhash64(one)))
    # No more sets have a key than have its rarest token.
    maybe = rows.filter(place >= F.col("rare")) if "rare" in ordered.columns else rows
    many = stored(maybe.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(
        "token", _ceil(F.col("n"), block).alias("blocks")), "frequent")
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    return rows.join(many, "token", "left").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("set_id"), F.col("blocks")))


def keyed(rows: DataFrame, percent: int, smaller: bool) -> DataFrame:
    """The postings as the smaller or the larger set of a pair, once for each pair of blocks and size of the smaller.

    The smaller of two sets shares tokens within an even shorter prefix.  Pairs of tokens
    are few enough as they are: their ``least`` is 0 for every size.
    """
    size, single = F.col("size"), F.col("place") == F.col("last")
    if smaller:
        spare = size - _least_common(size, size, percent)
        paired = _paired(size, percent)
        rows = rows.filter(F.when(single, ~paired & (F.col("place") <= spare)).otherwise(paired & (F.col("last") <= spare + 1)))
        rows = rows.withColumn("least", F.when(single, size).otherwise(0))
    else:
        every = F.sequence(_ceil(size * percent, 100).cast("int"), size)
        rows = rows.withColumn("least", F.explode(F.when(single, every).otherwise(F.array(F.lit(0)))))
        rows = rows.filter(~_paired(F.col("least"), percent))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    own, theirs = ("low", "high") if smaller else ("high", "low")
    mark = "a" if smaller else "b"
    return rows.select("*", other).select(
        "token", "least", F.col("own").alias(own), F.col("other").alias(theirs),
        *[F.col(c).alias(f"{mark}_{c}") for c in ("set_id", "size", "tokens", "place", "last")])


def near_pairs(sets: DataFrame, percent: int = 60, block: int = BLOCK) -> DataFrame:
    """Pairs of different sets of similarity ``percent`` or more, each once: a, b, common.

    ``sets`` has a unique ``set_id`` and ``tokens``, an array without nulls or repeats.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    # The join works much and reads little, so its input is dealt out whatever its size in bytes.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(stored(by_rarity(sets, block).repartition(parts, "set_id"), "rarity"), percent, block)
    a, b = keyed(rows, percent, True), keyed(rows, percent, False)
    n, m, i, j = (F.col(c) for c in ("a_size", "b_size", "a_last", "b_last"))
    needed = _least_common(n, m, percent)
    once = (n < m) | ((n == m) & (F.col("a_set_id") < F.col("b_set_id")))
    same = F.lit(True)  # not only the hash
    for at in ("place", "last"):
        same = same & (F.get("a_tokens", F.col(f"a_{at}")) == F.get("b_tokens", F.col(f"b_{at}")))
    before = F.when(F.col("a_place") == i, 0).otherwise(1)
    first = F.size(F.array_intersect(F.slice("a_tokens", F.lit(1), i), F.slice("b_tokens", F.lit(1), j))) == before
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    near = once & (before + F.least(n - i, m - j) >= needed) & same & first & (common >= needed)
    return a.join(b, ["token", "least", "low", "high"]).filter(near).select(
        F.least("a_set_id", "b_set_id").alias("a"), F.greatest("a_set_id", "b_set_id").alias("b"), common.alias("common"))


def near_classes(rows: DataFrame, key: str, tokens: str, verified: str, percent: int = 60,
                 block: int = BLOCK) -> DataFrame:
    """Each row with its class of equal token sets and what is near that class.

    Returns the key, ``representative`` (least key of its class), ``class_size``,
    ``near_classes`` (other classes of similarity ``percent`` or more) and ``near_verified``
    (verified rows in them and in its own class, without itself).  Null tokens and
    repeats count as absent; rows without any token are a class near to none.  Pairs of
    classes are joined and added up, never pairs of rows.
    """
    listed = F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.col(tokens)))), F.array().cast("array<string>"))
    marked = rows.select(F.col(key).alias("key"), listed.alias("tokens"), F.coalesce(verified, F.lit(False)).alias("ok"))
    marked = marked.withColumn("class", F.sha2(F.to_json("tokens"), 256))
    classes = stored(marked.groupBy("class").agg(
        F.min("key").alias("set_id"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("class_size"),
        F.count_if("ok").alias("verified_n")), "classes")
    pairs = stored(near_pairs(classes.select("set_id", "tokens"), percent, block).select("a", "b"), "near")
    both = pairs.unionAll(pairs.select("b", "a"))
    counted = both.join(classes.select(F.col("set_id").alias("b"), "verified_n"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("near_classes"), F.sum("verified_n").alias("near_n"))
    zero = F.lit(0).cast("bigint")
    about = stored(classes.join(counted, F.col("set_id") == F.col("a"), "left").select(
        "class", F.col("set_id").alias("representative"), "class_size",
        F.coalesce("near_classes", zero).alias("near_classes"),
        (F.col("verified_n") + F.coalesce("near_n", zero)).alias("around")), "about")
    return marked.select("key", "class", "ok").join(about, "class").select(
        F.col("key").alias(key), "representative", "class_size", "near_classes",
        (F.col("around") - F.col("ok").cast("bigint")).alias("near_verified"))
