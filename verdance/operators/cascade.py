"""Priority cascades: rules as ranks, settled for each target by one minimum, which tasks take before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands before and after a place's name, in order of preference.
LEGAL_FORMS = (("", ""), ("", " city"), ("city of ", ""), ("", " town"))
CENSUS_FORMS = (("", " city"), ("city of ", ""), ("", ""), ("", " town"), ("town of ", ""))
EXACT = (("", ""),)


def folded(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def first_known(targets: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """``targets`` with ``rule``, the place of the first source that knows ``key``, and that source's columns.

    All sources have the same columns; of several rows of one key in a source
    the least wins.  Targets that no source knows have a null rule.  A null key
    is known to none."""
    rest = [c for c in sources[0].columns if c != key]
    ranked = [s.select(key, F.struct(F.lit(k + 1).alias("rule"), *rest).alias("m")) for k, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    least = every.groupBy(key).agg(F.min("m").alias("m"))
    return targets.join(least.select(key, "m.*"), key, "left")


def least_ranks(pairs: DataFrame, by: str, *ranks: str) -> DataFrame:
    """(by, ranks): the least ``ranks`` of each target, compared in this order, nulls last.

    A task holds a row for each target and different values of all ranks but the
    last, in a hash table of plain values; a minimum of structs alone would sort all pairs of the task first."""
    fine = pairs.groupBy(by, *ranks[:-1]).agg(F.min(ranks[-1]).alias(ranks[-1]))
    order = [c for r in ranks for c in (F.col(r).isNull().alias(f"no_{r}"), F.col(r))]
    return fine.groupBy(by).agg(F.min(F.struct(*order)).alias("best")).select(by, *[F.col(f"best.{r}").alias(r) for r in ranks])


def kept_at_best(pairs: DataFrame, by: str, *ranks: str) -> DataFrame:
    """All pairs of a target at its least ``ranks``, compared in this order; pairs with a null rank go.

    The least ranks are one row a target and go to all tasks; the pairs stay where they are."""
    ranked = pairs
    for r in ranks:
        ranked = ranked.where(F.col(r).isNotNull())
    return ranked.join(F.broadcast(least_ranks(ranked, by, *ranks)), [by, *ranks], "left_semi")


def containing_names(targets: DataFrame, places: DataFrame, target: str, name: str, place: str) -> DataFrame:
    """Pairs of a target and a place whose name contains the target's, both folded.

    A name is cut into its different pieces of the lengths that targets have, in
    its own row, so that the join is on equal pieces and nothing else moves: the
    pieces of a place are neither gathered nor joined with it again, and few targets are
    broadcast.  Null and blank targets match nothing."""
    wanted = targets.withColumn("_piece", folded(target)).where(F.length("_piece") > 0)
    lengths = wanted.agg(F.sort_array(F.collect_set(F.length("_piece"))).alias("_lengths"))  # one row of at most a name's length
    named = places.withColumn("_name", folded(name)).crossJoin(F.broadcast(lengths))
    size = F.length("_name")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(F.col("_name"), at, n))
    cut = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda n: n <= size), pieces)))
    return named.select("*", F.explode(cut).alias("_piece")).drop("_name", "_lengths").join(wanted, "_piece").drop("_piece")


def form_rank(target: str, name: str, forms: tuple[tuple[str, str], ...], loose: bool) -> Column:
    """Place in ``forms`` of the first that makes the name of the target's; ``loose``: any other name comes after these, else it is null."""
    same = [F.when(folded(name) == F.concat(F.lit(a), folded(target), F.lit(b)), F.lit(k + 1)) for k, (a, b) in enumerate(forms)]
    return F.coalesce(*same, F.lit(len(forms) + 1)) if loose else F.coalesce(*same)


def union_places(targets: DataFrame, places: DataFrame, target: str) -> DataFrame:
    """``places`` with target and rule, a row for each target's place: all of the first form that any has, those that are legally cities if some are.

    ``places`` has place, name and legal, and what else is wanted of them."""
    pairs = containing_names(targets.select(target), places, target, "name", "place")
    city = F.when(F.lower("legal").contains("city"), 0).otherwise(1)
    pairs = pairs.withColumn("rule", form_rank(target, "name", LEGAL_FORMS, loose=True)).withColumn("other", city)
    return kept_at_best(pairs, target, "rule", "other").drop("other")


def place_unions(targets: DataFrame, places: DataFrame, target: str) -> DataFrame:
    """(target, rule, n_places, rings): the places of ``union_places`` as one region.

    ``places`` has rings too.  The union is the rings of all,
    which do not overlap, as boundaries of one layer do not; one target's fit in a task."""
    kept = union_places(targets, places, target)
    return kept.groupBy(target).agg(F.min("rule").alias("rule"), F.count("*").alias("n_places"), F.flatten(F.collect_list("rings")).alias("rings"))


def largest_place(targets: DataFrame, places: DataFrame, target: str) -> DataFrame:
    """(target, rule, place): the largest place of the first census form that any has; of equal ones the first."""
    pairs = containing_names(targets.select(target), places, target, "name", "place").withColumn("rule", form_rank(target, "name", CENSUS_FORMS, loose=False))
    ranked = pairs.where("rule IS NOT NULL").withColumn("a", -F.col("area"))
    return least_ranks(ranked, target, "rule", "a", "place").select(target, "rule", "place")


def subdivision(targets: DataFrame, places: DataFrame, target: str, prefix: str) -> DataFrame:
    """(target, rule, place): exact names before names that contain it; of several the first whose code has ``prefix``, else the largest."""
    pairs = containing_names(targets.select(target), places, target, "name", "place").withColumn("rule", form_rank(target, "name", EXACT, loose=True))
    coded = F.coalesce(F.col("code").startswith(prefix), F.lit(False))
    ranked = pairs.withColumn("c", F.when(coded, 0).otherwise(1)).withColumn("a", F.when(coded, 0.0).otherwise(-F.col("area")))
    return least_ranks(ranked, target, "rule", "c", "a", "place").select(target, "rule", "place")


def _stem() -> Column:
    return F.replace(F.col("filename"), F.lit(".tif"), F.lit(""))


def parsed_names(files: DataFrame, cities: tuple[str, ...], corrections: dict[tuple[str, str], str]) -> DataFrame:
    """``files`` with city, tile_id, x_offset and y_offset of their names; null where a name has none.

    The first of ``cities`` that the name contains counts; offsets are numbers
    with a hyphen, else a patch number and 0; ids in ``corrections`` are mended."""
    name, stem = F.lower("filename"), _stem()
    city = F.coalesce(*[F.when(name.contains(c), F.lit(c)) for c in cities])
    part = lambda p, k: F.nullif(F.regexp_extract(stem, f"(?:^|_){p}(?:_|$)", k), F.lit(""))
    x, y, patch, tile = part("([0-9]+)-([0-9]+)", 1), part("([0-9]+)-([0-9]+)", 2), part("patch_([0-9]+)", 1), part("([0-9]{3}_[0-9]{3})", 1)
    out = files.withColumn("city", city).withColumn("tile_id", tile)
    out = out.withColumn("x_offset", F.coalesce(x, patch).try_cast("bigint")).withColumn("y_offset", F.coalesce(y, F.when(patch.isNotNull(), F.lit("0"))).try_cast("bigint"))
    mended = F.coalesce(*[F.when((F.col("city") == c) & (F.col("tile_id") == a), F.lit(b)) for (c, a), b in corrections.items()], F.col("tile_id"))
    return out.withColumn("tile_id", mended)


def tile_metadata(files: DataFrame, headers: DataFrame, sources: DataFrame, cities: tuple[str, ...], corrections: dict[tuple[str, str], str]) -> DataFrame:
    """Bounds of each prediction in ``files`` (filename), as tile_metadata holds them, and the ``rule`` they come from.

    1, the file's own header; 2 and 3, the panchromatic and the NDVI image of
    the same base name; 4, offsets into the source image of the city's tile.
    ``headers`` (filename, placed, x0, y0, x1, y1, width, height) has all images
    of the folder, ``sources`` (city, tile_id, left, top, dx, dy) the affine maps.  Bounds are put
    in order.  Names without offsets or tile id have the id ``unknown`` and offsets 0 and no
    fourth rule.  Files of no known city, or that no rule places, have a null rule."""
    named = parsed_names(files.select("filename").distinct(), cities, corrections)
    whole = F.col("x_offset").isNotNull() & F.col("tile_id").isNotNull()
    named = named.withColumn("whole", whole)
    sized = headers.groupBy("filename").agg(F.first("width").alias("own_width"), F.first("height").alias("own_height"))
    named = named.join(sized, "filename", "left").where("city IS NOT NULL")
    box = headers.where("placed").select("filename", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("width").alias("w"), F.col("height").alias("h"))
    base = _stem()
    for part in ("pred_pan_", "pred_ndvi_"):
        base = F.replace(base, F.lit(part), F.lit(""))
    beside = lambda kind: named.select(F.col("filename").alias("of"), F.concat(F.lit(f"{kind}_"), base, F.lit(".tif")).alias("filename")).join(box, "filename").drop("filename").withColumnRenamed("of", "filename")
    x, y = F.col("left") + F.col("x_offset") * F.col("dx"), F.col("top") + F.col("y_offset") * F.col("dy")
    placed = named.where("whole AND own_width IS NOT NULL").join(sources, ["city", "tile_id"])
    affine = placed.select("filename", x.alias("x0"), (y + F.col("own_height") * F.col("dy")).alias("y0"), (x + F.col("own_width") * F.col("dx")).alias("x1"), y.alias("y1"), F.col("own_width").alias("w"), F.col("own_height").alias("h"))
    found = first_known(named, "filename", [box, beside("pan"), beside("ndvi"), affine])
    left, right, bottom, top = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    own = lambda c, of, d: F.when(F.col("whole"), F.col(c)).otherwise(F.coalesce(F.col(of), F.lit(d)))
    known = found.select(
        "filename", "city", F.when(F.col("whole"), F.col("tile_id")).otherwise("unknown").alias("tile_id"), *[F.when(F.col("whole"), F.col(c)).otherwise(0).alias(c) for c in ("x_offset", "y_offset")], "rule",
        left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"), ((left + right) / 2).alias("center_lon"), ((bottom + top) / 2).alias("center_lat"),
        own("w", "own_width", 256).alias("width"), own("h", "own_height", 256).alias("height"),
    )
    return files.select("filename").distinct().join(known.where("rule IS NOT NULL"), "filename", "left")
