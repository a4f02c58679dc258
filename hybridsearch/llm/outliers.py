"""Quality rules and robust multivariate outliers, by DataFrame functions only.

Fixed rules reject short and repetitive texts.  The others' statistics, transformed by logarithms, are compared with a
minimum-covariance-determinant (MCD) estimate of their language and source.

The MCD is the mean and covariance of those ``SUPPORT`` of a group's rows whose covariance has the smallest determinant.  It is
sought from several starts: medians and median deviations; the covariance of the rows' directions from the median; and the
moments of ``DEALT`` disjoint sets of the rows.  From each, concentration steps take the mean and covariance of the rows that lie
nearest by Mahalanobis distance to the estimate before, which does not raise the determinant.  After ``FIRST_STEPS`` a group goes on
with the start of the smallest determinant only, until no group's determinant falls by more than a share of ``SETTLED``.
Covariances are multiplied by the factor that makes them consistent for Gaussian rows, and regularised by a small diagonal.

A group's own estimate is mixed with its language's, and a language's with the corpus's, by weights ``n / (n + PRIOR)`` and the rest, so
that a small group is judged mostly by its language, and no count switches the rule.  A row is rejected where its squared
distance is beyond the chi-square quantile that a Gaussian row passes once in ``1 / LEVEL`` rows; the level is so low that at
10^11 rows none of them is rejected by chance.

Medians and the nearest rows are found by counts over narrow bins of bounded number, so no group is ever
gathered or sorted; rows tied with the border's bin are all taken.

Cases: a null text is an empty one; a text of any length counts whole; a null language or source is a group of its own; each row gives
one row, whatever its ``doc_id``; without any row that passes the rules (or an empty table) nothing is estimated, and ``distance`` is
null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SUPPORT = 0.75
#: Disjoint sets of rows that are starts; steps of all starts; the fall of a determinant that counts as none.
DEALT, FIRST_STEPS, SETTLED = 2, 2, 0.001
#: Steps that no group needs, since each lets a determinant fall; a guard against a defect, not a limit on results.
GUARD_STEPS = 200
#: Rows that a group's parent counts for.
PRIOR = 200
#: The chance that a Gaussian row is rejected.
LEVEL = 1e-12
DIMS = 5
#: Added to all variances (a regularised determinant): statistics that hardly vary do not reject for trifles, nor does a row in
#: which two of them agree bring the determinant to nothing.
FLOOR = 0.04
#: Bins: of a statistic (per unit), and of a squared distance (per unit of its logarithm).
FINE, NARROW = 64, 32
#: Estimates are sent to every task up to so many groups, and joined otherwise.
BROADCAST_GROUPS = 20_000
_SPACE = r"[\x20\x09-\x0D]+"
_INDEX_BITS = 24


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    get, size = F.get, F.size
    low = (1 << _INDEX_BITS) - 1
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"),
        F.filter(F.split(text, _SPACE), lambda w: w != "").alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("words")
    windows = F.sequence(F.lit(0), size(words) - 3)
    window_key = lambda i: F.xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))
    rows = rows.select(
        "doc_id", "lang", "source", "words",
        size(words).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACE, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (size(lines) - size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        # hash in the high bits, position in the low ones
        F.when(size(words) > 2, F.sort_array(F.transform(windows, lambda i: window_key(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint") % (low + 1))))).alias("packed"),
    )
    packed = F.col("packed")
    same = lambda x, y: F.shiftright(x, _INDEX_BITS) == F.shiftright(y, _INDEX_BITS)
    alike = F.filter(packed, lambda x, k: F.coalesce(same(x, get(packed, F.greatest(k - 1, F.lit(0)))) & (k > 0), F.lit(False)) | F.coalesce(same(x, get(packed, k + 1)), F.lit(False)))
    candidates = F.when(size(words) - 2 > low, windows).otherwise(F.transform(alike, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    rows = rows.withColumn("candidates", F.when(size(words) > 2, candidates))
    spelled = F.array_sort(F.transform("candidates", lambda i: F.struct(get(words, i).alias("a"), get(words, i + 1).alias("b"), get(words, i + 2).alias("c"), i.alias("i"))))
    rows = rows.withColumn("spelled", F.when(size("candidates") > 0, spelled)).drop("words", "packed", "candidates")
    full = F.col("spelled")
    equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    repeated = F.sort_array(
        F.transform(
            F.filter(full, lambda x, k: (F.coalesce(equal(x, get(full, F.greatest(k - 1, F.lit(0)))), F.lit(False)) & (k > 0)) | F.coalesce(equal(x, get(full, k + 1)), F.lit(False))),
            lambda x: x["i"],
        )
    )
    rows = rows.withColumn("at", repeated).drop("spelled")
    # each repeated window adds the words up to the next one, three at most
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(get(F.col("at"), k + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("at")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def chi_square_above(x: float, dims: int) -> float:
    """The chance that a chi-square variable of an odd number of dimensions is larger than ``x``."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(math.sqrt(x / 2))
    for k in range(1, dims, 2):
        total += term
        term *= x / (k + 2)
    return total


def chi_square_quantile(above: float, dims: int) -> float:
    """The value that a chi-square variable exceeds with chance ``above``."""
    low, high = 0.0, 10_000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_above(middle, dims) > above else (low, middle)
    return high


#: Squared distance beyond which a row is an outlier.
CUTOFF = chi_square_quantile(LEVEL, DIMS)
#: Of the covariance of a Gaussian's nearest SUPPORT rows.
CONSISTENCY = SUPPORT / (1 - chi_square_above(chi_square_quantile(1 - SUPPORT, DIMS), DIMS + 2))
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_XS = [f"x{i}" for i in range(DIMS)]
_MEANS = [f"m{i}" for i in range(DIMS)]
_COVS = [f"c_{i}_{j}" for i, j in _PAIRS]
_FACTORS = [f"l_{i}_{j}" for i, j in _PAIRS]


def _features() -> list[Column]:
    """Logarithms of length, word length, symbol, repeated-line and repeated-word shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log((F.col("word_chars") + 1) / n), F.log(F.col("n_symbols") / n + 0.05), F.log(F.col("n_dup_lines") / n + 0.02), F.log(F.col("n_repeat_words") / n + 0.1)]


def _keys() -> list[Column]:
    """A row's groups, the most specific first."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [F.concat_ws("\x1f", F.lit("2"), part("lang"), part("source")), F.concat_ws("\x1f", F.lit("1"), part("lang")), F.lit("0")]


def _joined(rows: DataFrame, estimates: DataFrame, by: list[str], few: bool) -> DataFrame:
    """``few``: there are so few groups that a row a group and start can go to every task."""
    return rows.join(F.broadcast(estimates) if few else estimates, by)


def _solved() -> list[Column]:
    """Forward substitution of ``x - m`` with the factor's columns ``l_i_j``."""
    z: list[Column] = []
    for i in range(DIMS):
        rest = reduce(lambda s, j: s - F.col(f"l_{i}_{j}") * z[j], range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return z


def _distance() -> Column:
    """Squared Mahalanobis distance."""
    return reduce(add, [v * v for v in _solved()])


def _factored(cov: DataFrame) -> DataFrame:
    """Cholesky factors and ``log_det`` of the columns ``c_i_j``, which stay."""
    out = cov
    for i, j in _PAIRS:
        rest = reduce(lambda s, k: s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR / 10))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.withColumn("log_det", 2 * reduce(add, [F.log(F.col(f"l_{i}_{i}")) for i in range(DIMS)]))


def _quantile(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """``by, cut``: the first of ``bin`` at which a share of a group's rows is reached."""
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    of_all = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("up_to", up_to).withColumn("of_all", of_all).where(F.col("up_to") >= share * F.col("of_all")).groupBy(*by).agg(F.min("bin").alias("cut"))


def _medians(rows: DataFrame, few: bool) -> DataFrame:
    """``key, m0.., s0..``: medians and scaled median deviations of every group."""
    long = rows.select("key", F.posexplode(F.array(*_XS)).alias("dim", "x"))
    middle = _quantile(long.withColumn("bin", F.floor(F.col("x") * FINE)), ["key", "dim"], 0.5).select("key", "dim", ((F.col("cut") + 0.5) / FINE).alias("m"))
    wide = middle.groupBy("key").agg(*[F.max(F.when(F.col("dim") == i, F.col("m"))).alias(f"m{i}") for i in range(DIMS)])
    wide = materialize(wide, "medians")
    off = _joined(rows, wide, ["key"], few).select("key", F.posexplode(F.array(*[F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(DIMS)])).alias("dim", "x"))
    spread = _quantile(off.withColumn("bin", F.floor(F.col("x") * FINE)), ["key", "dim"], 0.5).select("key", "dim", (1.4826 * (F.col("cut") + 0.5) / FINE).alias("s"))
    return wide.join(spread.groupBy("key").agg(*[F.max(F.when(F.col("dim") == i, F.col("s"))).alias(f"s{i}") for i in range(DIMS)]), "key")


def _moments() -> list[Column]:
    return [F.avg(x).alias(m) for x, m in zip(_XS, _MEANS, strict=True)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c_{i}_{j}") for i, j in _PAIRS]


def _floored(moments: DataFrame, factor: float) -> DataFrame:
    """Covariances times ``factor``, with FLOOR added to variances."""
    return moments.withColumns({f"c_{i}_{j}": factor * F.col(f"c_{i}_{j}") + FLOOR if i == j else factor * F.col(f"c_{i}_{j}") for i, j in _PAIRS})


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """``key, start`` and an estimate for every group and start."""
    medians = materialize(_medians(rows, few), "median-deviations")
    diagonal = medians.withColumns({f"c_{i}_{j}": F.col(f"s{i}") * F.col(f"s{i}") + FLOOR if i == j else F.lit(0.0) for i, j in _PAIRS})
    first = diagonal.select("key", F.lit(0).alias("start"), *_MEANS, *_COVS)
    # directions: rows scaled to the length one about the median; their covariance, brought to the median deviations' scale
    scale = [F.greatest(F.col(f"s{i}"), F.lit(FLOOR**0.5)) for i in range(DIMS)]
    off = [(F.col(f"x{i}") - F.col(f"m{i}")) / scale[i] for i in range(DIMS)]
    length = F.sqrt(reduce(add, [v * v for v in off]))
    signs = _joined(rows, medians, ["key"], few).select("key", length.alias("length"), *[v.alias(f"o{i}") for i, v in enumerate(off)]).where("length > 0")
    spread = signs.groupBy("key").agg(*[F.avg(F.col(f"o{i}") * F.col(f"o{j}") / F.col("length") ** 2).alias(f"u_{i}_{j}") for i, j in _PAIRS])
    second = medians.join(spread, "key").withColumns({f"c_{i}_{j}": DIMS * F.col(f"u_{i}_{j}") * scale[i] * scale[j] for i, j in _PAIRS})
    second = _floored(second.select("key", F.lit(1).alias("start"), *_MEANS, *_COVS), 1.0)
    dealt = rows.withColumn("start", (2 + F.pmod(F.xxhash64(*_XS), F.lit(DEALT))).cast("int"))
    third = _floored(dealt.groupBy("key", "start").agg(*_moments()), 1.0)
    return first.unionByName(second).unionByName(third)


def _concentrated(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """The next estimate of each (key, start)."""
    own = ["key", "start"]
    near = _joined(rows, now.select(*own, *_MEANS, *_FACTORS), ["key"], few).select(*own, *_XS, F.floor(F.log(_distance() + 1e-6) * NARROW).alias("bin"))
    inside = _joined(near, _quantile(near, own, SUPPORT), own, few).where("bin <= cut")
    return _factored(_floored(inside.groupBy(*own).agg(*_moments()), CONSISTENCY))


def estimates(rows: DataFrame) -> DataFrame:
    """``key, n`` and mean, covariance, factor and ``log_det`` of every group of ``rows(key, x0..)``."""
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "group-sizes")
    few = sizes.count() <= BROADCAST_GROUPS
    now = materialize(_factored(_starts(rows, few)), "starts")
    for _ in range(FIRST_STEPS):
        now = materialize(_concentrated(rows, now, few), "estimates")
    values = ["start", *_MEANS, *_COVS, *_FACTORS, "log_det"]
    best = F.min_by(F.struct(*values), F.struct("log_det", "start"))
    now = materialize(now.groupBy("key").agg(best.alias("e")).select("key", "e.*"), "best-starts")
    for _ in range(GUARD_STEPS):
        new = _concentrated(rows, now, few).select("key", F.struct(*values).alias("new"))
        both = now.select("key", F.struct(*values).alias("old")).join(new, "key")
        # a step whose ties at the border raise the determinant is not taken
        fell = F.col("new.log_det") < F.col("old.log_det") - SETTLED
        now = materialize(both.select("key", F.when(fell, F.col("new")).otherwise(F.col("old")).alias("e"), fell.alias("fell")).select("key", "e.*", "fell"), "estimates")
        if now.where("fell").isEmpty():
            break
        now = now.drop("fell")
    else:
        raise RuntimeError("estimates did not settle")
    return now.drop("fell", "start").join(sizes, "key")


def _mixed(own: DataFrame, parent: DataFrame) -> DataFrame:
    """``own`` estimates mixed with their parents': the moments of a mixture by weights ``n / (n + PRIOR)`` and the rest."""
    up = parent.select(F.col("key").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in [*_MEANS, *_COVS]])
    w = F.col("n") / (F.col("n") + PRIOR)
    rows = own.join(up, "parent")
    apart = lambda i: F.col(f"m{i}") - F.col(f"p_m{i}")
    covs = [(w * F.col(f"c_{i}_{j}") + (1 - w) * F.col(f"p_c_{i}_{j}") + w * (1 - w) * apart(i) * apart(j)).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    means = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"p_m{i}")).alias(f"m{i}") for i in range(DIMS)]
    return _factored(rows.select("key", *means, *covs))


def models(rows: DataFrame) -> DataFrame:
    """``key`` and the estimate by which rows of each language and source are judged; ``rows(keys, x0..)``."""
    lineage = rows.groupBy("keys").agg(F.count("*").alias("rows"))
    found = materialize(estimates(rows.select(F.explode("keys").alias("key"), *_XS)), "mcd-estimates")
    level = lambda k: found.join(lineage.select(F.get("keys", F.lit(k)).alias("key"), F.get("keys", F.lit(k + 1)).alias("parent")).distinct(), "key")
    languages = materialize(_mixed(level(1), found), "language-models")
    return materialize(_mixed(level(0), languages).select("key", *_MEANS, *_FACTORS), "source-models")


def rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``distance`` (null where a rule failed) and ``kept``."""
    stats = materialize(text_statistics(docs), "text-statistics")
    points = stats.withColumns(dict(zip(_XS, _features(), strict=True))).withColumn("keys", F.array(*_keys()))
    passed = points.where(~F.col("base_failed")).select("keys", *_XS)
    found = models(passed)
    judged = _joined(points.where(~F.col("base_failed")).withColumn("key", F.get("keys", F.lit(0))), found, ["key"], found.count() <= BROADCAST_GROUPS)
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = judged.select(*own, _distance().alias("distance")).withColumn("kept", F.col("distance") <= CUTOFF)
    failed = points.where("base_failed").select(*own, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)
