"""Quality rules by robust multivariate outliers, with DataFrame operations only.

Each document is a vector of transformed statistics. For each language and source, the minimum covariance determinant
gives a location and a scatter that outliers can't move. It is found as in the deterministic algorithm of Hubert,
Rousseeuw and Verdonck (2012): from several starts (medians and absolute deviations; the covariance of hyperbolic tangents;
of spatial signs; mean and covariance), concentration steps take mean and covariance of the SUPPORT share of the rows
that lie nearest. After FIRST_ROUNDS steps the start of least determinant goes on, until no group's determinant falls any
more. The scatter is made consistent with that of a normal distribution, and a document is rejected if its Mahalanobis
distance is beyond the chi-square quantile of all but OUTLIERS, or if it fails the base rules.

All sums are of whole numbers, so the result does not depend on the order of rows. Medians and nearness limits come
from histograms of fixed width, so a source with a third of all rows is pre-aggregated like any other; parameters are
joined back to salted keys. Groups of fewer than MIN_ROWS documents are pooled into one; if that is as small, the
method rejects none of it. Variances are never taken as less than FLOOR squared, so that a statistic that is 0 in all
ordinary documents (symbols, say) rejects what is far from 0, not what differs at all.

Null text is a text without words; null languages and sources are groups of their own. Repeated rows give repeated
rows; ties, at a median or a limit, are on one side of it all; an empty table gives none. Only the named columns are
read. A text's windows of three words are one sorted array of 12 bytes each, so a single text takes about three times
its size while it is read; it is never cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import fresh, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SUPPORT, FIRST_ROUNDS, MIN_ROWS = 0.75, 2, 50
#: A determinant that falls by less than this share has settled. As variances have floors, every group settles.
SETTLED = 1e-3
#: Statistics are whole numbers of thousandths.
UNIT = 1000
#: The share of a normal distribution that lies beyond the cutoff.
OUTLIERS = 1e-4
FEATURES = ("x_word", "x_symbol", "x_line", "x_repeat")
#: Least standard deviation of each, in thousandths.
FLOOR = {"x_word": 60.0, "x_symbol": 60.0, "x_line": 80.0, "x_repeat": 80.0}
#: Width of histogram bins: of statistics, in thousandths, and of distances.
BIN, DISTANCE_BIN = 5, 0.01
SALTS = 16
#: Groups whose parameters (of 150 bytes or so) are sent to all tasks; beyond it they are joined to salted keys.
MOST_SENT = 10_000
STAR = "\x00pooled"


def chi_square_below(x: float, dimensions: int) -> float:
    """The chi-square distribution function, of an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dimensions // 2))


def chi_square_quantile(share: float, dimensions: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, dimensions) < share else (low, middle)
    return low


#: What makes the covariance of the nearest SUPPORT of a normal distribution that of all of it, and the cutoff.
CONSISTENT = SUPPORT / chi_square_below(chi_square_quantile(SUPPORT, len(FEATURES)), len(FEATURES) + 2)
CUTOFF = math.sqrt(chi_square_quantile(1 - OUTLIERS, len(FEATURES)))
GROUP = ("glang", "gsource")
#: Starts, by number: medians and deviations, tangents, signs, mean and covariance.
STARTS = range(4)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+"))


def count_of(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def body(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, body).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more: the hashes of all windows are sorted with their places, so that equal ones are neighbours."""

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 4,
            F.sort_array(F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def covered(places: Column) -> Column:
        # each place adds itself and the two words after it that the next place does not cover
        nearby = lambda k: F.coalesce(F.get(places, k + 1) - F.get(places, k), F.lit(3))
        return F.aggregate(F.transform(places, lambda _, k: F.least(nearby(k), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(let(words, windows), repeated), lambda r: let(F.array_sort(F.transform(r, lambda x: x["i"])), covered))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base statistics of every document, and the transformed ones."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(text_col, F.lit("")).alias("text"))
    counted = rows.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("\x00null")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("source"),
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    unit = lambda x: F.round(x * UNIT).cast("long")
    return counted.withColumns(
        {
            "x_word": unit(F.log(F.greatest(per("word_chars", "n_words"), F.lit(0.5)))),
            "x_symbol": unit(F.sqrt(per("n_symbols", "word_chars"))),
            "x_line": unit(per("n_dup_lines", "n_lines")),
            "x_repeat": unit(per("n_repeat_words", "n_words")),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def own_groups(stats: DataFrame) -> DataFrame:
    """Languages and sources, and whether they have rows enough for a group of their own."""
    return written(stats.groupBy(F.col("lang").alias("glang"), F.col("source").alias("gsource")).agg((F.count(F.lit(1)) >= MIN_ROWS).alias("own")), "quality-sizes")


def grouped(stats: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds the group (glang, gsource) that a document is measured in; sizes are own_groups()."""
    rows = stats.withColumns({"glang": F.col("lang"), "gsource": F.col("source")})
    joined = group_join(rows, own_groups(stats) if sizes is None else sizes)
    return joined.withColumns({"glang": F.when(F.col("own"), F.col("lang")).otherwise(STAR), "gsource": F.when(F.col("own"), F.col("source")).otherwise(STAR)}).drop("own")


def group_join(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the one row of their group, which is sent to all tasks if there are few groups, else joined to salted keys."""
    if groups.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(groups), [*GROUP])
    return salted_join(rows, groups)


def salted_join(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Rows with their group's columns. A group's rows are dealt to SALTS keys, and its one row of parameters to each."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = ["doc_id"] if "doc_id" in rows.columns else []
    return rows.withColumn("salt", F.pmod(F.xxhash64(*own, *FEATURES), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def collapsed(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each different vector of a group once, with its number of rows: copies are measured once in all rounds."""
    vectors = stats.groupBy("lang", "source", *FEATURES).agg(F.count(F.lit(1)).alias("weight"))
    return grouped(vectors, sizes).groupBy(*GROUP, *FEATURES).agg(F.sum("weight").alias("weight"))


def weighted(rows: DataFrame) -> DataFrame:
    return rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1).cast("long"))


def quantiles(rows: DataFrame, values: dict[str, Column], share: float, bin_width: float, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """By group, the upper edge of the histogram bin in which the share of its rows is reached, for each value: a row for each group."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(v / bin_width).alias("bin")) for k, v in enumerate(values.values())]))
    bins = weighted(rows).select(*keys, "weight", each.alias("x")).groupBy(*keys, F.col("x.k").alias("k"), F.col("x.bin").alias("bin")).agg(F.sum("weight").alias("n"))
    by_value = bins.groupBy(*keys, "k").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n_all"))

    def reached(b: Column, total: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= F.ceil(total * share), x["bin"])).alias("at"))
        return F.aggregate(b, zero, step)["at"]

    edges = by_value.select(*keys, "k", ((reached(F.col("bins"), F.col("n_all")) + 1) * bin_width).alias("edge"))
    return edges.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("edge"))).alias(name) for k, name in enumerate(values)])


D = range(len(FEATURES))
#: Columns of a location m* and of the lower triangle l* of its scatter's Cholesky factor.
PARAMETERS = (*[f"m{i}" for i in D], *[f"l{i}{j}" for i in D for j in range(i + 1)])


def factored(params: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """Adds l* and the logarithm of the determinant. Of each variance, what it lacks to the floor is added, which leaves the matrix definite."""
    cov = {(i, j): F.greatest(c, F.lit(FLOOR[FEATURES[i]] ** 2)) if i == j else c for (i, j), c in cov.items()}
    for i in D:
        for j in range(i + 1):
            total = cov[i, j]
            for k in range(j):
                total = total - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(total, F.lit(1.0))) if i == j else total / F.col(f"l{j}{j}"))
    logs = [2 * F.log(F.col(f"l{i}{i}")) for i in D]
    return params.withColumn("logdet", logs[0] + logs[1] + logs[2] + logs[3])


def distance() -> Column:
    """Mahalanobis distance of a row from its group's m*, l*: the norm of L^-1 (x - m)."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        total = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            total = total - F.col(f"l{i}{k}") * z[k]
        z.append(total / F.col(f"l{i}{i}"))
    square = z[0] * z[0]
    for v in z[1:]:
        square = square + v * v
    return F.sqrt(square)


def moments(rows: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Number, mean* and cov** of whole numbers by group."""
    sums = weighted(rows).groupBy(*keys).agg(
        F.sum("weight").alias("n"),
        *[F.sum(F.col("weight") * F.col(x)).alias(f"s{i}") for i, x in enumerate(values)],
        *[F.sum(F.col("weight") * F.col(values[i]) * F.col(values[j])).alias(f"p{i}{j}") for i in D for j in range(i + 1)],
    )
    sums = sums.withColumns({f"mean{i}": F.col(f"s{i}") / F.col("n") for i in D})
    return sums.withColumns({f"cov{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"mean{i}") * F.col(f"mean{j}") for i in D for j in range(i + 1)})


def starts(rows: DataFrame) -> DataFrame:
    """A location and a scatter by group and start `s`."""
    medians = quantiles(rows, {f"med{i}": F.col(x) for i, x in enumerate(FEATURES)}, 0.5, BIN)
    far = quantiles(salted_join(rows, medians), {f"far{i}": F.abs(F.col(x) - F.col(f"med{i}")) for i, x in enumerate(FEATURES)}, 0.5, BIN)
    middle = medians.join(far, [*GROUP]).select(*GROUP, *[f"med{i}" for i in D], *[F.greatest(1.4826 * F.col(f"far{i}"), F.lit(FLOOR[x])).alias(f"scale{i}") for i, x in enumerate(FEATURES)])
    middle = written(middle, "quality-middle")

    z = [(F.col(x) - F.col(f"med{i}")) / F.col(f"scale{i}") for i, x in enumerate(FEATURES)]
    norm = F.greatest(F.sqrt(z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3]), F.lit(1e-9))
    whole = lambda s, values: F.struct(F.lit(s).alias("s"), *[F.round(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    each = F.explode(F.array(whole(1, [UNIT * F.tanh(v) for v in z]), whole(2, [UNIT * v / norm for v in z]), whole(3, [F.col(x).cast("double") for x in FEATURES])))
    found = moments(salted_join(weighted(rows), middle).select(*GROUP, "weight", each.alias("e")).select(*GROUP, "weight", "e.*"), (*GROUP, "s"), ("v0", "v1", "v2", "v3")).join(middle, [*GROUP])
    own = F.col("s") == 3
    scale = [F.when(own, F.lit(1.0)).otherwise(F.col(f"scale{i}") / UNIT) for i in D]
    found = found.withColumns({f"m{i}": F.when(own, F.col(f"mean{i}")).otherwise(F.col(f"med{i}")) for i in D})
    found = factored(found, {(i, j): F.col(f"cov{i}{j}") * scale[i] * scale[j] for i in D for j in range(i + 1)})
    plain = middle.withColumns({"s": F.lit(0)} | {f"m{i}": F.col(f"med{i}").cast("double") for i in D})
    plain = factored(plain, {(i, j): F.col(f"scale{i}") * F.col(f"scale{i}") if i == j else F.lit(0.0) for i in D for j in range(i + 1)})
    columns = [*GROUP, "s", *PARAMETERS, "logdet"]
    return plain.select(columns).union(found.select(columns))


def concentrated(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """One concentration step of each group and start `s`: mean and covariance of the nearest rows. rows have no `s`; each is measured once for each of its group's starts."""
    keys = (*GROUP, "s")
    near = salted_join(weighted(rows), parameters).withColumn("distance", distance()).select(*keys, "weight", *FEATURES, "distance")
    limits = quantiles(near, {"limit": F.col("distance")}, SUPPORT, DISTANCE_BIN, keys)
    sums = moments(salted_join(near, limits, keys).where(F.col("distance") <= F.col("limit")), keys, FEATURES)
    sums = sums.withColumns({f"m{i}": F.col(f"mean{i}") for i in D})
    return factored(sums, {(i, j): CONSISTENT * F.col(f"cov{i}{j}") for i in D for j in range(i + 1)}).select(*keys, *PARAMETERS, "logdet")


def least_determinant(parameters: DataFrame) -> DataFrame:
    """Of each group's starts the one of least determinant, the first of equals."""
    best = F.min_by(F.struct("s", *PARAMETERS, "logdet"), F.struct(F.round("logdet", 6), "s"))
    return parameters.groupBy(*GROUP).agg(best.alias("best")).select(*GROUP, "best.*")


def fitted(rows: DataFrame) -> DataFrame:
    """Location and scatter of each group, by the minimum covariance determinant."""
    parameters = written(starts(rows), "quality-starts")
    for k in range(FIRST_ROUNDS):
        parameters = written(concentrated(rows, parameters), f"quality-first{k}")
    parameters = written(least_determinant(parameters), "quality-least")
    settled = None
    while True:
        # a step whose determinant has not fallen, as limits are bins, is not taken, and its group is left out from then on
        new = concentrated(rows, parameters)
        both = new.join(parameters.select(*GROUP, *[F.col(c).alias(f"old_{c}") for c in (*PARAMETERS, "logdet")]), [*GROUP])
        falls = F.col("logdet") < F.col("old_logdet") + math.log(1 - SETTLED)
        taken = written(both.select(*GROUP, "s", *[F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in (*PARAMETERS, "logdet")], falls.alias("fell")), "quality-round")
        still = taken.where(~F.col("fell")).drop("fell")
        settled = still if settled is None else settled.union(still)
        parameters = taken.where("fell").drop("fell")
        if parameters.isEmpty():
            return written(settled.drop("s", "logdet"), "quality-fitted")


def verdicts(stats: DataFrame) -> DataFrame:
    """Adds each row's distance and verdict; stats are a table of statistics()."""
    sizes = own_groups(stats)
    vectors = written(collapsed(stats, sizes), "quality-vectors")
    few = vectors.where(F.col("glang") == STAR).agg(F.coalesce(F.sum("weight"), F.lit(0)) < MIN_ROWS).collect()[0][0]
    scored = group_join(grouped(stats, sizes), fitted(vectors)).withColumn("distance", distance())
    outlier = (F.col("distance") > CUTOFF) & ~((F.col("glang") == STAR) & F.lit(few))
    return scored.withColumn("kept", ~F.col("base_failed") & ~outlier)


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every document's statistics, its distance from its group, and whether it is kept."""
    scored = verdicts(written(statistics(df, id_col, text_col, lang_col, source_col), "quality-stats"))
    return scored.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that are kept, as they are, each by its own verdict. A row travels as one column beside its statistics, so its own columns may have any names, and no text is shuffled to find its verdict."""
    row = fresh(df, "row")
    whole = df.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    stats = written(statistics(whole, row, text_col, lang_col, source_col), "quality-rows")
    return verdicts(stats).where("kept").select("doc_id.*")
