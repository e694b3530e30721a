"""URL filters: rules on host and path first, then logistic regression on hashed character n-grams.

The classifier learns from a small labelled table of URLs, of MAX_LABELLED rows at most. Host and
path are cut into n-grams of their own, hashed into FEATURES places; every URL is then judged by
built-in functions and the fitted model, row by row, without a shuffle.

Defined results: a URL that is null or has no "://" has an empty host and path, no rule, and the
classifier's verdict on nothing. Of equally long rules that fit that of the longer host counts, of those the
last one; URLs of any length are cut into n-grams whole. Repeated rows are judged alike. An empty table gives none. Input
columns named like a result's are replaced.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
FEATURES = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED, MAX_RULES = 10_000, 1_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Hosts and paths of the labelled URLs that the default classifier learns from, made up from
# kinds of sites that web corpora usually leave out (gambling, pornography, advertising and tracking, link
# spam, pills, piracy, fraud, loans) and of ordinary ones, in the four languages of the documents.
BLOCKED_HOSTS = (
    "royal-poker-lounge", "onlinecasino777", "grandjackpotcasino", "casinos-en-ligne", "roulette-royale", "sportsbetting-tips",
    "apuestas-deportivas-ya", "bestbetsoftheday", "daily-bets", "bets.odds-online", "sportwetten-gratis", "freebetsbonus",
    "lottery-winner-prize", "bingo-jackpots", "xxx-videos-tube", "adultcamshow", "hot-sex-dates", "pornstream", "escort-girls-city",
    "nude-webcams", "adult-dating-club", "erotik-kontakte", "ads.popunder-network", "adserver.clickbank-media",
    "track.pixel-analytics", "adclick-tracker", "banner-ads-exchange", "click-tracking.affiliate-network", "adtracking-metrics",
    "pop-ads-redirect", "spamlinks-directory", "linkfarm-backlinks", "seo-link-farm", "article-spinner-spam",
    "doorway-keywords-farm", "guestbook-spammer", "cheap-viagra-online", "buy-cialis-pills", "discount-pharmacy-meds",
    "weight-loss-pills-now", "pillen-ohne-rezept", "pastillas-baratas", "male-enhancement-pill", "cracked-software-keygen",
    "free-warez-torrents", "serial-keys-crack", "watch-movies-free-hd", "free-iphone-winner", "your-pc-is-infected",
    "account-verify-login", "paypa1-confirm", "payday-loans-instant", "easy-money-from-home", "credit-sofort-ohne-schufa",
    "binary-options-profit", "replica-watches-outlet", "cheap-handbags-sale", "poker-online", "pokerroom", "las-vegas-slots",
    "slot-machine-games", "slots-free-spins", "casino-vip", "casino-bonus", "win-at-casino", "online-betting", "live-odds", "bets-today",
    "wettbonus", "casino-gratuit", "casino-apuestas", "sex-cams-live", "camgirl-shows", "free-porno", "porno-filme", "porn-hd-movies",
    "xxx-girls", "sexkontakte", "adult-movies", "adult-friends", "ad-server", "ads-network", "click-ads", "track-clicks",
    "tracking-pixel", "ads-redirect", "spam-blogs", "farm-of-links", "link-exchange-spam", "viagra-shop", "pills-pharmacy",
    "online-pharmacy", "cheap-meds", "pharmacie-sans-ordonnance", "keygen-download", "crack-serials", "torrent-movies", "payday-loan-fast",
    "instant-loan-now", "kredit-ohne-schufa", "prestamos-rapidos",
)
ALLOWED_HOSTS = (
    "docs.python-guide", "university", "library", "news.daily-post", "gardening", "weather", "museum", "recipes", "mountains",
    "history", "physics-notes", "health", "city-council", "opensource", "choir", "chess-club", "railway", "poems", "bakery",
    "forum.woodwork", "law-journal", "school", "stadtwerke", "zeitung", "wanderverein", "feuerwehr", "kochbuch", "uni-bibliothek",
    "handwerk", "mairie", "journal-local", "cuisine", "lycee", "randonnee", "theatre", "ayuntamiento", "periodico", "biblioteca",
    "cocina", "universidad", "senderismo", "hospital", "astronomy", "encyclopedia", "translate", "orchestra", "farmers-market",
    "cycling", "photography", "engineering", "knitting", "parliament", "geology", "novel-reviews", "kindergarten", "ocean-science",
    "violin", "beekeeping", "architecture", "kernel-mailing-list", "statistics", "football-club", "travel-diary", "bird-watching",
    "carpentry", "linguistics", "museo", "gallery", "trains", "notary", "river-valley", "record-office", "music-academy", "sternwarte",
    "gemeinde", "kunstverein", "landesmuseum", "lesesaal", "ecole", "prefecture", "patrimoine", "bibliotheque", "escuela",
    "municipio", "ciencia", "archivo", "thesis-repository", "court-rulings", "seed-bank", "lighthouse", "harbour-news",
    "village-hall", "quarterly-review", "meteorology", "hiking", "old-maps", "cathedral", "wildlife", "sailing", "pottery",
)
# Paths of either kind of site, and those that tell.
PATHS = (
    "", "/", "/en/17", "/de/40123/", "/fr/1204.html", "/es/88?page=2&ref=x", "/en/9981#top", "/page/3?utm_source=feed", "/index.html", "/de/termine", "/fr/2021/05",
    "/es/inicio", "/en/about", "/id=1",
)
BLOCKED_PATHS = ("/casino/bonus", "/porn/videos/3", "/buy/pills", "/click?ad=7", "/free-bets/claim", "/crack/keygen.zip", "/xxx/live", "/loan/apply-now")
ALLOWED_PATHS = ("/library/catalogue/12", "/news/politics/8", "/recipes/bread", "/docs/tutorial/1", "/research/papers/5", "/kultur/theater", "/histoire/ville", "/cocina/recetas")


def host_and_path(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _grams(text: Column, mark: str) -> Column:
    """n-grams of the text between two marks; none of a length that it doesn't have."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(whole) - n + 1)
        grams = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
        return F.when(F.length(whole) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(of, GRAMS)))


def _featured(urls: DataFrame) -> DataFrame:
    """urls with _host, _path and _features of column _url."""
    host, path = host_and_path(F.col("_url"))
    parts = urls.withColumn("_host", host).withColumn("_path", path)
    parts = parts.withColumn("_grams", F.concat(_grams(F.col("_host"), "h"), _grams(F.col("_path"), "p")))
    hashed = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    return hashed.transform(parts).drop("_grams")


def default_labels(spark: SparkSession) -> DataFrame:
    """Each host with two of the paths of either kind, and those paths that tell on hosts that don't."""
    rows = []
    for verdict, hosts, telling in ((BLOCK, BLOCKED_HOSTS, BLOCKED_PATHS), (ALLOW, ALLOWED_HOSTS, ALLOWED_PATHS)):
        for i, host in enumerate(hosts):
            rows += [(f"https://{('', 'www.')[k]}{host}.example{PATHS[(i + k * 5) % len(PATHS)]}", verdict) for k in (0, 1)]
        rows += [(f"https://site{i}.example{path}", verdict) for i, path in enumerate(telling)]
    return spark.createDataFrame(rows, "url string, verdict string")


def train(labelled: DataFrame, regularisation: float = 0.002) -> LogisticRegressionModel:
    """From columns url and verdict (allow or block). A larger table than MAX_LABELLED is refused."""
    rows = labelled.limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    table = labelled.sparkSession.createDataFrame(
        [(r["url"], float(r["verdict"] == BLOCK)) for r in rows], "_url string, label double"
    ).coalesce(1)
    learner = LogisticRegression(featuresCol="_features", regParam=regularisation, maxIter=50, standardization=False)
    return learner.fit(_featured(table))


def _fitting(rules: list[tuple[str, str, str]], value: int) -> Column:
    """The value-th part of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        host = (F.col("_host") == rule[1]) | F.endswith(F.col("_host"), F.lit("." + rule[1]))
        text = rule[0] if value == 0 else rule[1] + rule[2]
        found = F.when(host & F.startswith(F.col("_path"), F.lit(rule[2])), F.lit(text)).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel, url: str = "url", block_at: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (the classifier's chance of block). rules:
    (verdict, host, path prefix) each, MAX_RULES at most."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    apart = pages.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("_given"), F.col(f"`{url}`").alias("_url"))
    scored = model.setProbabilityCol("_chance").setRawPredictionCol("_raw").setPredictionCol("_class").transform(_featured(apart))
    score = vector_to_array("_chance")[1]
    learned = F.when(F.col("score") >= block_at, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.withColumn("score", score).select(
        *(F.col(f"_given.`{c}`") for c in given),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        _fitting(rules, 1).alias("rule"),
        F.coalesce(_fitting(rules, 0), learned).alias("verdict"),
        "score",
    )
