"""Quality rules: counts of a text, base rules, and robust multivariate outliers.

The counts become a vector of transformed statistics. For every language and source its centre and
covariance are estimated by minimum covariance determinant: concentration steps move to the 75 % of
the rows that are closest to the present estimate, until the last step; rows far from their group
by Mahalanobis distance are rejected. Everything is DataFrame functions; statistics are whole
numbers, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.llm.shared import Scratch
from wirelark.operators.bounded import small_side

BLANKS = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

LEAST_ROWS = 100                   # of a group with an estimate of its own; smaller sources are pooled by language
CORE = 0.75                        # share of a group's rows that an estimate rests on
STEPS = 4
#: The core's covariance times this is that of the whole, for normal vectors of five: 0.75 / P(chi2_7 < chi2_5's 0.75 quantile).
CONSISTENCY = 1.41
CUT = 32.0                         # squared distance beyond which a row is rejected; just above chi2_5's 0.99999 quantile of 30.9
SCALE = 1000                       # statistics are kept as whole thousandths
#: Least standard deviation of each statistic, in thousandths; groups without spread would reject any other value.
FLOORS = [300, 60, 60, 400, 120]
_FAR = 1_000_000                   # hundredths of squared distance that are told apart


def _repeat_words(words: str, n: str) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are told apart by a 64-bit hash of which the lowest bits give way to the place: with 2**k
    places 64 - k bits remain, a chance of about 1e-9 of one false match in a text of 10,000 words.
    """
    bits = "cast(ceil(log2(n_words + 1)) as int)"
    packed = (f"sort_array(transform(sequence(0, n_words - 3), i -> shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), {bits})"
              " | cast(i as bigint)))")
    return F.when(F.col(n) >= 3, F.expr(packed))


def _starts(packed: str) -> Column:
    """Places of the repeated windows, rising, from the sorted array."""
    same = f"shiftright(x, bits) = shiftright(get({packed}, j - 1), bits) or shiftright(x, bits) = shiftright(get({packed}, j + 1), bits)"
    return F.expr(f"sort_array(transform(filter({packed}, (x, j) -> coalesce({same}, false)), x -> x & (shiftleft(1L, bits) - 1L)))")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts to every row (`text` itself is dropped); null has no words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    step = docs.drop(*COUNTS).withColumns({
        "_words": F.array_remove(F.split(whole, BLANKS), ""), "_lines": lines,
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")}).drop(text)
    step = step.withColumns({
        "n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    step = step.withColumn("_packed", _repeat_words("_words", "n_words")).drop("_words")
    step = step.withColumn("bits", F.expr("cast(ceil(log2(n_words + 1)) as int)")).withColumn("_starts", _starts("_packed")).drop("_packed")
    gaps = F.expr("aggregate(transform(_starts, (x, j) -> if(j = 0, 3L, least(3L, x - _starts[j - 1]))), 0L, (a, x) -> a + x)")
    return (step.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))
            .withColumn("n_words", F.col("n_words").cast("long")).drop("_starts", "bits"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> list[Column]:
    """The vector, in whole thousandths: logs of the words and of their mean length, roots of the
    shares of symbols and of repeated words, log of the repeated lines."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = [F.log1p("n_words"), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
              F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / words)]
    return [F.round(x * SCALE).cast("long") for x in vector]


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. with the Cholesky factor l00.., by forward substitution."""
    solved: list[Column] = []
    for i in range(p):
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * solved[k]
        solved.append(left / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for s in solved[1:]:
        total = total + s * s
    return total


def _factor(moments: DataFrame, key: list[str], p: int) -> DataFrame:
    """Centre and Cholesky factor of each group from its sums; variances get the floors added."""
    out = moments.select(*key, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(p)],
                         *[F.col(f"s{i}{j}") for i in range(p) for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            cell = (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            if i == j:
                cell = F.greatest(cell, F.lit(0.0)) + float(FLOORS[i] ** 2)
            for k in range(j):
                cell = cell - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cell, F.lit(1.0))) if i == j else cell / F.col(f"l{j}{j}"))
    return out.select(*key, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def estimates(rows: DataFrame, key: list[str], p: int = 5) -> DataFrame:
    """Centre (m0..) and factor (l00..) of each group's core, for rows with `key` and x0..x(p-1).

    Starts from medians and median deviations; each step takes the rows whose distance is no more
    than the group's CORE quantile, ties included, and estimates again.
    """
    scratch = Scratch(rows.sparkSession, "quality-estimates")
    xs = [f"x{i}" for i in range(p)]
    middle = rows.groupBy(*key).agg(*[F.expr(f"percentile({x}, 0.5)").alias(f"m{i}") for i, x in enumerate(xs)])
    middle = scratch.table("medians", middle)
    spread = rows.join(small_side(middle, 20_000), key).groupBy(*key).agg(
        *[F.expr(f"percentile(cast(round(abs({x} - m{i})) as bigint), 0.5)").alias(f"d{i}") for i, x in enumerate(xs)])
    now = middle.join(spread, key)
    for i in range(p):
        for j in range(i):
            now = now.withColumn(f"l{i}{j}", F.lit(0.0))
        now = now.withColumn(f"l{i}{i}", F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + float(FLOORS[i] ** 2)))
    now = scratch.table("step-0", now.drop(*[f"d{i}" for i in range(p)]))
    for step in range(1, STEPS + 1):
        far = F.least(F.round(_distance(p) * 100), F.lit(_FAR)).cast("long")
        placed = rows.join(small_side(now, 20_000), key).withColumn("far", far)
        edge = scratch.table(f"edge-{step}", placed.groupBy(*key).agg(F.expr(f"percentile(far, {CORE})").alias("edge")))
        core = placed.select(*key, *xs, "far").join(small_side(edge, 20_000), key).where("far <= edge")
        moments = core.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
                                         *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)])
        now = scratch.table(f"step-{step}", _factor(moments, key, p))
    return now


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, distance (null without an estimate) and kept, for every row.

    Rows that fail the base rules are rejected and take no part in the estimates. Sources with fewer
    than LEAST_ROWS others are pooled by language; a pool that is still smaller rejects no more rows.
    Null languages and sources are groups of their own.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    key = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))
    found = counts(docs.select(F.col(doc_id).alias("doc_id"), key.alias("_key"), F.col(text).alias("text")))
    table = scratch.table("counts", found.withColumn("base_failed", base_failed()).withColumns({f"x{i}": x for i, x in enumerate(statistics())}))
    passed = table.where(~F.col("base_failed"))
    own = F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col("_key.lang")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("_key.source")), F.lit("-")))
    pool = F.concat(F.lit("pool/"), F.coalesce(F.concat(F.lit("="), F.col("_key.lang")), F.lit("-")))
    sizes = passed.groupBy(own.alias("own")).agg(F.count("*").alias("n"))
    groups = scratch.table("groups", sizes)
    # a source that no row passed has no size; its rows need none
    placed = table.withColumn("own", own).join(small_side(groups, 20_000), "own", "left").withColumn(
        "grp", F.when(F.col("n") >= LEAST_ROWS, F.col("own")).otherwise(pool)).drop("own", "n", "_key")
    inside = placed.where(~F.col("base_failed"))
    large = inside.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("grp")
    large = scratch.table("large", large)
    model = estimates(inside.join(small_side(large, 20_000), "grp", "left_semi").select("grp", *[f"x{i}" for i in range(5)]), ["grp"])
    judged = placed.join(small_side(model, 20_000), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(5)))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", kept.alias("kept"))
