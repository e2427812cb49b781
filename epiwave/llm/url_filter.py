"""URL filter: host rules, and logistic regression on hashed character n-grams of host and path for all other URLs.

Everything is an expression of the JVM. The model is trained from a small table of labelled URLs; its coefficients have
a fixed size.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The labelled URLs, written for this table: hosts and paths of pages to leave out.
BLOCKED = """
http://ads.example.net/click?id=1
https://ads-track.example.com/banner/728x90
http://m.ads-track.example.net/en/14868
https://track.example.net/pixel.gif
https://tracker.example.com/collect/event
http://adserver.example.net/serve/slot
https://casino.example.com/slots/bonus
http://best-casino-bonus.example.net/win
https://online-casino.example.net/jackpot/free-spins
http://poker-win.example.com/bet/now
https://cheap-pills.example.net/buy-now
http://pharma-discount.example.com/order/pills
https://xxx-video.example.net/adult/clip
http://adult-cam.example.com/live/xxx
https://warez.example.net/crack/keygen
http://torrent-free.example.com/download/crack
https://click-bait.example.net/redirect?to=shop
http://redirect.example.com/out/click
https://popunder.example.net/landing/offer
http://win-prize.example.com/claim/gift-card
https://free-money.example.net/offer/claim
http://loan-now.example.com/payday/apply
https://seo-links.example.net/buy/backlinks
http://spam-mail.example.com/unsubscribe
https://shop.example.net/cart/checkout
http://shop.example.com/login?next=cart
https://example.net/wp-login.php
http://example.com/user/signup
https://affiliate.example.net/track/campaign
http://banner.example.com/ads/serve
https://doubleclicks.example.net/adclick
http://promo-deals.example.com/coupon/discount
"""

#: And of pages to keep.
ALLOWED = """
http://example.net/en/825
https://m.example.net/en/25
https://blog.example.com/en/7198
http://blog.example.net/2019/05/notes-on-gardening
https://www.example.net/es/26123
http://www.example.com/en/39547.html
https://docs.example.net/guide/install
http://docs.example.com/reference/functions
https://wiki.example.net/article/history-of-glass
http://wiki.example.com/page/mountain-rivers
https://news.example.net/world/2020/election-results
http://news.example.com/science/new-telescope
https://library.example.net/books/chapter-3
http://library.example.com/catalogue/poems
https://university.example.net/courses/algebra
http://school.example.com/lessons/biology
https://museum.example.net/collection/paintings
http://museum.example.com/exhibits/roman-coins
https://forum.example.net/thread/repairing-bicycles
http://forum.example.com/topic/bread-baking
https://journal.example.net/volume-12/paper-7
http://journal.example.com/issue/4/review
https://example.net/about
http://example.com/en/index.html
https://m.example.com/en/474.html
http://m.example.net/fr/43603
https://recipes.example.net/soup/lentil
http://travel.example.com/italy/florence
https://health.example.net/advice/sleep
http://weather.example.com/forecast/coast
https://example.net/de/24133/
http://example.com/es/17231
"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def behind_scheme(url: Column) -> Column:
    """What stands behind the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(behind_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(urls: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Columns __id, __url (null: empty), __host, __path; all others stay outside."""
    found = urls.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"))
    return found.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits.

    Rules are a short list of the caller's, so each is one branch. Of rules of one length the first in the list wins.
    """
    host, path = F.col("__host"), F.col("__path")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of ``^text$``, each behind the mark of its field."""
    letters = F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda x: x != ""), F.array(F.lit("$")))

    def of_size(n):
        last = F.size(letters) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit(mark), *(F.get(letters, i + k) for k in range(n)))))

    return F.flatten(F.array(*(F.coalesce(of_size(n), F.array().cast("array<string>")) for n in sizes)))


def featured(found: DataFrame, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    tokens = found.withColumn("__grams", F.concat(grams(F.col("__host"), "h:", sizes), grams(F.col("__path"), "p:", sizes)))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="__grams", outputCol="__features").transform(tokens).drop("__grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, blocked (1.0 or 0.0)."""
    rows = [(u, 1.0) for u in BLOCKED.split()] + [(u, 0.0) for u in ALLOWED.split()]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {b}D)" for u, b in rows) + " AS t(url, blocked)")


def train_url_model(labelled: DataFrame, sizes=(3, 4), buckets=1 << 13, penalty=0.01) -> LogisticRegressionModel:
    """Fits the regression. Only the labelled table is read; rows without a label are left out."""
    found = labelled.select(F.col("url").alias("__url"), F.col("blocked").cast("double").alias("__label")).filter("__label IS NOT NULL")
    found = found.withColumn("__url", F.coalesce("__url", F.lit("")))
    found = found.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    model = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__prob", regParam=penalty, maxIter=100)
    return model.fit(featured(found.coalesce(1), sizes, buckets))


def judge_urls(urls: DataFrame, model: LogisticRegressionModel, rules=RULES, sizes=(3, 4), buckets=1 << 13, threshold=0.5, id_col="page_id", url_col="url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block: the rule's, else the model's) and the model's score, row by row.

    Null URLs and those without :// have an empty host and path, no rule and the model's verdict on nothing. Repeated
    rows stay, an empty table gives an empty result, columns other than id and URL aren't read.
    """
    rule, verdict = rule_of(rules)
    scored = model.transform(featured(parsed(urls, id_col, url_col), sizes, buckets))
    score = vector_to_array(F.col("__prob"))[1]
    judged = F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow"))
    return scored.select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
        rule.alias("rule"), judged.alias("verdict"), F.round(score, 6).alias("score"),
    )
