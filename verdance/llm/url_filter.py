"""URL filter: host and path rules, then a character language-model ratio.

Rules decide the addresses they fit.  The others are judged by two smoothed
variable-order Markov models over characters, one counted on the addresses the
rules accept and one on those they reject.  A model's probability of a
character after its context interpolates all orders up to ``order``
(Witten-Bell weights), so a context never seen falls back to shorter ones.  An
address's score is the difference of the two log-likelihoods, divided by its
length.  The models are counted on three quarters of the rules' own addresses
(by a hash of the address); the cut is the score that loses least on the rest.

Everything is DataFrame code: contexts are exploded, counted with partial
aggregation, and joined.  Probabilities are worked out once for each distinct
window of ``order + 1`` characters, not for each place it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import tables

#: (action, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

ORDER = 4
_EDGE = "\x02"
_ALPHABET = 256.0


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    return (
        pages.withColumn("_u", url)
        .withColumn("_r", rest)
        .withColumn("_h", F.regexp_extract("_r", r"^([^/?#]*)", 1))
        .withColumn("host", tables.ascii_lower(F.col("_h")))
        .withColumn(
            "path",
            F.regexp_extract(F.expr("substring(_r, length(_h) + 1)"), r"(?s)^([^?#]*)", 1),
        )
        .drop("_u", "_r", "_h")
    )


def fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    inside = (F.col("host") == host) | F.col("host").endswith("." + host)
    return inside & F.col("path").startswith(path)


def _windows(urls: DataFrame, order: int) -> DataFrame:
    """(k, label, n, window) for each place: ``order`` characters of context and one more.

    The address is cut into characters once and windows are put together out of
    these, so the work is linear in its length; places carry its digest ``k``."""
    padded = F.concat(F.lit(_EDGE * order), F.col("url"), F.lit(_EDGE))
    at = F.sequence(F.lit(0), F.char_length("url"))
    window = lambda i: F.concat(*[F.get(F.col("_p"), i + j) for j in range(order + 1)])
    cut = urls.select(F.md5("url").alias("k"), "label", "n", F.split(padded, "").alias("_p"), at.alias("_at"))
    return cut.select("k", "label", "n", F.explode(F.transform("_at", window)).alias("w"))


#: A window found in one of this many places or more is frequent; there are at most as many of them.
_FREQUENT = 1024


def _summed(places: DataFrame, ratio: DataFrame) -> DataFrame:
    """(k, score): mean of the windows' ratios.

    Windows that very many places share (such as ``http:``) would be hot keys.
    Those that hold one place in ``_FREQUENT`` or more are at most that many
    rows of ``order + 1`` characters, and are broadcast; all others are joined
    by a shuffle, where none is hot."""
    total = ratio.agg(F.sum("places")).first()[0] or 0
    frequent = F.col("places") * _FREQUENT >= total
    often = ratio.where(frequent).select("w", F.col("d").alias("_d"))
    marked = places.select("k", "w").join(F.broadcast(often), "w", "left")
    rare = marked.where("_d IS NULL").select("k", "w").join(ratio.where(~frequent).select("w", "d"), "w")
    each = marked.where("_d IS NOT NULL").select("k", F.col("_d").alias("d")).unionByName(rare.select("k", "d"))
    return each.groupBy("k").agg((F.sum("d") / F.count("*")).alias("score"))


def language_model_scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) for each distinct url, from the labels on ``urls``.

    ``urls`` has distinct ``url``, ``label`` (allow, block, or null where the
    models do not learn from it) and ``n``, how many rows have that address.  Score is the length-normalised
    log-likelihood difference, positive where the accepted model fits better."""
    places = _windows(urls.select("url", "label", "n"), order)
    counted = (
        places.where("label IS NOT NULL")
        .groupBy("w")
        .agg(
            F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).cast("double").alias("a"),
            F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).cast("double").alias("b"),
        )
    )
    counted = tables.written(counted, "url-grams")
    scored = places.groupBy("w").agg(F.count("*").alias("places"))
    none = {"a": 0.0, "b": 0.0, "ca": 0.0, "cb": 0.0, "ta": 0.0, "tb": 0.0}
    pa: Column = F.lit(1.0 / _ALPHABET)
    pb: Column = F.lit(1.0 / _ALPHABET)
    scored = scored.withColumn("pa", pa).withColumn("pb", pb)
    for k in range(order + 1):
        gram = counted.select(F.substring("w", order + 1 - k, k + 1).alias("g"), "a", "b")
        gram = gram.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = gram.groupBy(F.substring("g", 1, k).alias("c")).agg(
            F.sum("a").alias("ca"),
            F.sum("b").alias("cb"),
            F.count_if(F.col("a") > 0).cast("double").alias("ta"),
            F.count_if(F.col("b") > 0).cast("double").alias("tb"),
        )
        scored = (
            scored.withColumn("g", F.substring("w", order + 1 - k, k + 1))
            .withColumn("c", F.substring("w", order + 1 - k, k))
            .join(gram, "g", "left")
            .join(context, "c", "left")
            .fillna(none)
        )

        def step(p: str, n: str, total: str, kinds: str) -> Column:
            whole = F.col(total) + F.col(kinds)
            return F.when(whole == 0, F.col(p)).otherwise((F.col(n) + F.col(kinds) * F.col(p)) / whole)

        scored = scored.select(
            "w", "places", step("pa", "a", "ca", "ta").alias("pa"), step("pb", "b", "cb", "tb").alias("pb")
        )
    ratio = tables.written(scored.select("w", "places", (F.log("pa") - F.log("pb")).alias("d")), "url-ratios")
    return urls.select("url", F.md5("url").alias("k")).join(_summed(places, ratio), "k").select("url", "score")


def calibrated_cut(scores: DataFrame, bins: int = 4096) -> float:
    """The score at which accepted and rejected addresses are told apart best.

    ``scores`` has score, label and n; what has no label or score is left out.
    Scores fall into ``bins`` of equal width from the least to the largest, so
    what reaches the driver has that many rows at most.  Each label weighs the
    same; of equally good cuts the one in the middle of the widest gap is taken.
    Without addresses of both labels it is minus infinity."""
    known = scores.where("label IS NOT NULL AND score IS NOT NULL")
    lo, hi, a_total, b_total = known.agg(
        F.min("score"), F.max("score"), F.sum(F.when(F.col("label") == "allow", F.col("n"))), F.sum(F.when(F.col("label") == "block", F.col("n")))
    ).first()
    if not a_total or not b_total:
        return float("-inf")
    width = max((hi - lo) / bins, 1e-12)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("score") - lo) / width))
    rows = known.groupBy(bin_.alias("bin")).agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b"),
    )
    rows = sorted(rows.collect(), key=lambda r: r["bin"])
    # A cut below all, then one above each bin that holds any.
    lost, ends = [1.0], [(lo - width, lo)]
    kept_b, lost_a = 1.0, 0.0
    for k, r in enumerate(rows):
        lost_a += r["a"] / a_total
        kept_b -= r["b"] / b_total
        after = lo + rows[k + 1]["bin"] * width if k + 1 < len(rows) else hi + width
        lost.append(lost_a + kept_b)
        ends.append((lo + (r["bin"] + 1) * width, after))
    best = min(lost)
    gaps = [e for x, e in zip(lost, ends) if x <= best + 1e-12]
    low, high = max(gaps, key=lambda e: e[1] - e[0])
    return (low + high) / 2


def url_filter(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    order: int = ORDER,
    url_col: str = "url",
) -> DataFrame:
    """``pages`` plus host, path, rule, verdict (allow or block) and lm_score.

    The longest rule that fits decides (by characters of host and path; of
    equal ones the first given).  Where none fits, ``lm_score`` at or above the
    calibrated cut allows.  A null url, or one without ``://``, has empty host
    and path and no rule; the models judge its text (null: empty) as it is.
    With no accepted or no rejected address to learn from, all that no rule
    fits is allowed, and ``lm_score`` is null.  Where the quarter that the cut
    is found on lacks a label, models and cut take all addresses of the rules.  Repeated addresses are judged once and weigh by
    their number.  ``lm_score`` is null where a rule decides.  Extra columns
    pass through; columns named like the new ones are replaced."""
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict", "lm_score"]
    keep = [c for c in pages.columns if c.lower() not in made]
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked):
        rule = F.when(fits(r), F.lit(r[1] + r[2])).otherwise(rule)
        action = F.when(fits(r), F.lit(r[0])).otherwise(action)
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{url_col}`").alias("url"))
    named = with_host_and_path(base).withColumn("rule", rule).withColumn("_action", action)
    named = named.withColumn("_url", tables.ascii_lower(F.coalesce(F.col("url"), F.lit("")))).drop("url")
    urls = named.groupBy(F.col("_url").alias("url")).agg(
        F.max("_action").alias("label"), F.count("*").alias("n")
    )
    urls = tables.written(urls, "urls")
    apart = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(4)) == 0
    labels = [F.count_if((F.col("label") == x) & part) for part in (apart, ~apart) for x in ("allow", "block")]
    counts = urls.agg(*labels).first()
    if not (counts[0] + counts[2] and counts[1] + counts[3]):
        scores, lm = urls.select("url", F.lit(None).cast("double").alias("score")), F.lit(True)
    else:
        split = all(counts)
        learnt = urls.withColumn("label", F.when(~apart, F.col("label"))) if split else urls
        scores = tables.written(language_model_scores(learnt, order), "url-scores")
        known = urls.join(scores, "url")
        lm = F.col("score") >= calibrated_cut(known.where(apart) if split else known)
    out = named.join(scores.select(F.col("url").alias("_url"), "score"), "_url", "left")
    verdict = F.coalesce(F.col("_action"), F.when(lm, "allow").otherwise("block"))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        "host",
        "path",
        "rule",
        verdict.alias("verdict"),
        F.when(F.col("_action").isNull(), F.col("score")).alias("lm_score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "lm_score")
