"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

URLs that the rules accept or reject train one variable-order Markov model each, but for a held-out part
(``HELD``) on which the cut is calibrated. A whole URL, with scheme, query and fragment, is mapped onto
``SYMBOLS`` (letters, a digit class, a few marks, one symbol for all else), and the models count every
gram of one to ``ORDER`` symbols. A character's probability is the interpolation of all orders whose
context was seen (Dirichlet smoothing: each order falls back on the next shorter with ``WEIGHT``).
A URL's figure is the mean difference of the two log-likelihoods per character; the cut is calibrated
on the held-out labelled URLs so that the share of wrong accepts and wrong rejects is least.

As the symbols are few, the table of grams has at most len(SYMBOLS)**ORDER rows for the longest order
(38**4, about two million) whatever the number of URLs; so it is broadcast, and URLs never shuffle by gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rules as (host, path, verdict); the host fits with all its subdomains, the path by prefix.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
WEIGHT = 4.0
#: Figures are cut into bins of 1 / BINS within +-LIMIT for the calibration.
BINS, LIMIT = 100, 8

#: First digits of the MD5 of the URLs that are held out of the training and calibrate the cut: three in sixteen.
HELD = ("0", "1", "2")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, 0 for digits, marks, * for all else, ^ for the start.
SYMBOLS = _LOWER + "0" + "./-_?=&%:" + "*" + "^"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: tuple, what: str) -> Column:
    """The longest rule that fits, as its text or its verdict."""
    found = F.lit(None).cast("string")
    for own_host, own_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.lit(own_host + own_path if what == "rule" else verdict)).otherwise(found)
    return found


def _symbols(url: Column) -> Column:
    """The whole URL on ``SYMBOLS``, behind ORDER - 1 start symbols; null is empty."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"[^a-z0./\-_?=&%:]", "*")
    return F.concat(F.lit("^" * (ORDER - 1)), text)


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``symbols``: the gram of ORDER symbols that ends there; null if there is none."""
    last = F.length("symbols") - ORDER + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    return rows.select(*keep, "symbols", F.explode_outer(places).alias("i")).select(*keep, F.expr(f"substring(symbols, i, {ORDER})").alias("gram"))


def model(labelled: DataFrame) -> DataFrame:
    """Of rows (symbols, good): one row per known gram of one to ORDER symbols, with the probabilities
    ``pa`` and ``pr`` of its last symbol after the others among accepted and rejected URLs.
    """
    counts = _grams(labelled, "good").where("gram is not null").groupBy("gram").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("r"))
    # Every order reads the grams once more, so they are written; the table is bounded like the model itself.
    counts = cut(counts)
    levels = shorter = None
    for n in range(1, ORDER + 1):
        own = counts.groupBy(F.expr(f"right(gram, {n})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("context", F.expr(f"left(gram, {n - 1})"))
        context = own.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        own = own.join(F.broadcast(context), "context")
        if shorter is None:
            own = own.withColumns({"la": F.lit(1.0 / len(SYMBOLS)), "lr": F.lit(1.0 / len(SYMBOLS))})
        else:
            own = own.join(F.broadcast(shorter.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr"))), F.expr(f"right(gram, {n - 1})") == F.col("tail"))
        level = own.select("gram", *(((F.col(c) + WEIGHT * F.col(f"l{c}")) / (F.col(f"c{c}") + WEIGHT)).alias(f"p{c}") for c in "ar"))
        shorter = level
        levels = level if levels is None else levels.unionByName(level)
    return cut(levels)


def _figures(rows: DataFrame, labelled: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``bin``: the mean log ratio over a row's characters, in steps of 1 / BINS."""
    ratio = model(labelled).select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))
    joined = _grams(rows, *keep)
    # Variable order: the longest known gram gives the ratio of a character.
    for n in range(ORDER, 0, -1):
        own = F.broadcast(ratio.where(F.length("gram") == n).select(F.col("gram").alias(f"g{n}"), F.col("ratio").alias(f"r{n}")))
        joined = joined.join(own, F.expr(f"right(gram, {n})") == F.col(f"g{n}"), "left")
    figure = F.coalesce(*[F.col(f"r{n}") for n in range(ORDER, 0, -1)], F.lit(0.0))
    mean = F.sum(figure) / F.greatest(F.count("gram"), F.lit(1))
    clipped = F.least(F.greatest(F.floor(F.round(mean, 6) * BINS), F.lit(-LIMIT * BINS)), F.lit(LIMIT * BINS))
    return joined.groupBy(*keep).agg(clipped.cast("int").alias("bin"))


def _cut(figures: DataFrame) -> DataFrame:
    """One row: the cut with the least sum of the shares of wrong accepts and wrong rejects, the one nearest to zero of several.

    A cut lies in the middle between two bins that occur, as labelled URLs stand further apart than new ones.
    """
    bins = figures.where("held and verdict is not null").groupBy("bin").agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("r"))
    # At most 2 * LIMIT * BINS + 1 rows from here on.
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wrong = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(every), F.lit(1)) + 1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.greatest(F.sum("r").over(every), F.lit(1))
    middle = F.floor((F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin")) + F.col("bin") + 1) / 2).cast("int")
    best = bins.select(middle.alias("cut"), F.round(wrong, 9).alias("wrong")).agg(F.min(F.struct("wrong", F.abs("cut").alias("far"), "cut")).alias("m"))
    return best.select(F.coalesce("m.cut", F.lit(0)).alias("cut"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, figure.

    A row whose url is null or has no ``://`` has an empty host and path; its figure is that of its characters,
    0 without any, which the cut judges like any other. If no rule fits any row, every figure is 0 and so is the cut.
    Ids may be null or repeat, each row is judged by itself; an empty table gives no rows; other columns are not read.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), _symbols(F.col("url")).alias("symbols"), F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(*HELD).alias("held"))
    rows = rows.withColumns({name: _rule(F.col("host"), F.col("path"), rules, name) for name in ("rule", "verdict")})
    labelled = rows.where("verdict is not null and not held").select("symbols", (F.col("verdict") == "allow").alias("good"))
    # The cut and the verdicts read the figures, a row per URL, which are written once.
    figures = cut(_figures(rows.withColumn("row", F.monotonically_increasing_id()), labelled, "row", "page_id", "host", "path", "rule", "verdict", "held"))
    judged = F.when(F.col("bin") >= F.col("cut"), F.lit("allow")).otherwise(F.lit("block"))
    return figures.join(F.broadcast(_cut(figures))).select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), (F.col("bin") / BINS).alias("figure"))
