"""URL filters: rules on host and path, and logistic regression for what no rule decides.

The model sees character n-grams of the host and of the path, hashed into DIMENSIONS
counts each of its own, and is trained by Spark ML on the small labelled table
``LABELLED`` (or one handed in).  Rules win over the model; of the rules that fit, the
longest wins.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import ascii_lower, of_row, table, wrapped

DIMENSIONS = 1 << 13
NGRAMS = (3, 4, 5)
#: Labelled rows that training reads at most; a larger table is refused, not cut.
MAX_LABELLED = 20_000

#: Rules of the query, (rule, verdict); the host ends at the first slash.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Hand-labelled hosts, made up for training: the first are fine, the others are to be blocked.
_FINE = (
    "citylibrary", "rosegarden", "harbournews", "compilerdocs", "stateuniversity", "soup-recipes", "natural-museum", "cyclists-forum",
    "weather-today", "chemjournal", "mountain-trips", "oldtown-bakery", "roman-history", "primary-school", "orchestra", "stargazers",
    "river-maps", "theatre-hall", "childrens-hospital", "second-hand-books", "research-archive", "tulips", "northern-lights", "sheepdog",
    "the-other-paper", "threshold", "thistle", "trader-journal", "nation-today", "station-list", "translations", "thornhill", "inthering",
    "parliament", "carpenter", "knitting-circle", "railway-times", "seabird-watch", "open-source-tools", "grammar-notes", "chess-club",
    "local-council", "wind-power", "farmers-market", "adventure-books", "winter-sports", "trackfield-club", "freedom-press", "spanish-lessons", "betty-cooks",
)
_BAD = (
    "grand-casino", "casino-royal777", "lucky-casino-bonus", "win-jackpot-now", "win-big-slots", "poker-win", "sport-bets", "bets-online", "free-spins", "free-money-bets",
    "diet-pills", "pills-discount", "cheap-meds", "cheap-viagra", "cheap-replica", "adult-clips", "adult-cams", "xxx-adult", "x-rated-video", "porn-tube",
    "ads-banner", "adserver-ads", "click-track", "track-pixel-ads", "popup-ads", "link-farm", "seo-farm-links", "mail-spam", "spam-offers", "spam-lists",
    "payday-loans", "hot-singles", "crack-keygen", "free-prize-claim", "fast-cash-win",
)
_PATHS = ("/en/{}", "/fr/{}.html", "/de/page/{}", "/es/{}/", "/en/{}?page=2", "/a/b{}#top", "/{}", "")
#: Labelled URLs: 1 is to be blocked.
LABELLED = tuple(
    (f"http{'s' if k % 3 else ''}://{('', 'www.', 'm.', 'blog.')[k % 4]}{host}.{('test', 'example', 'invalid')[k % 3]}{_PATHS[k * 5 % 8].format(k * 37 % 1000)}", label)
    for label, hosts in ((0, _FINE), (1, _BAD))
    for k, host in enumerate(hosts)
)


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls.

    A rule's host fits itself and its subdomains; its path, from the first slash on,
    fits paths that start with it.  Of equally long rules the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # later ones win, so equally long rules come in reverse
    for name, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        of, _, under = name.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{under}")
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(part: Column, mark: str) -> Column:
    """n-grams of ``^part$``, each marked with the part it is from."""
    text = F.concat(F.lit("^"), part, F.lit("$"))
    found = [
        F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), _gram(text, mark, n))).otherwise(F.array().cast("array<string>"))
        for n in NGRAMS
    ]
    return F.concat(*found)


def _gram(text: Column, mark: str, n: int):
    return lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n)))


def features(parts: DataFrame) -> DataFrame:
    """``parts``, which has host and path, plus the hashed counts ``features``."""
    rows = parts.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(ascii_lower(F.col("path")), "p")))
    return HashingTF(numFeatures=DIMENSIONS, inputCol="grams", outputCol="features", binary=True).transform(rows).drop("grams")


def train(spark: SparkSession, labelled: DataFrame | None = None) -> LogisticRegressionModel:
    """The model of a labelled table (url, label 0 or 1), of MAX_LABELLED rows at most."""
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    elif labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs; hand in a sample")
    rows = features(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))).coalesce(1)
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.02, maxIter=30).fit(rows)


def filter_urls(rows: DataFrame, model: LogisticRegressionModel, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """``rows`` plus host, path, rule, verdict and score (the model's chance of "block").

    Null URLs and those without ``://`` have an empty host and path; no rule fits them
    and the model judges the empty strings.  Rows are independent, equal ones get equal
    verdicts; columns of ``rows`` with the new names are replaced, all others may have any
    names.  An empty table gives an empty one.
    """
    from pyspark.ml.functions import vector_to_array

    plain = rows.drop("host", "path", "rule", "verdict", "score")
    of = of_row(url)
    judged = model.transform(features(wrapped(plain).select("row", host_of(of).alias("host"), path_of(of).alias("path"))))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    score = vector_to_array("probability")[1]
    return judged.select(
        *[of_row(c).alias(c) for c in plain.columns],
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), train(spark)).drop("url")
