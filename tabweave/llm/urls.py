"""Operator 9: URL verdicts by rules, and otherwise by logistic regression on hashed character n-grams of host and path.

Everything is a projection over the pages: no shuffle, no Python on the executors.
"""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS, FEATURES = (3, 4, 5), 1 << 15

#: Share of unwanted hosts that is assumed of hosts at large: the classes weigh so, and a host of n-grams that were never seen goes by it.
SHARE = 0.2
#: From these words, chosen by what they mean, the labelled table is made.
UNWANTED = {
    "gambling": ["casino", "poker", "slots", "roulette", "blackjack", "jackpot", "lottery", "gambling", "betting", "bets", "bingo", "wager"],
    "adult": ["porn", "xxx", "sex", "sexcam", "nude", "escort", "camgirl", "erotic", "hookup", "fetish", "adult", "milf"],
    "drugs": ["viagra", "cialis", "pills", "steroids", "opioid", "xanax", "tramadol", "pharmacy"],
    "loans": ["payday", "loans", "forex", "cashadvance", "quickcash", "debtfree"],
    "coins": ["crypto", "airdrop", "doubler", "ponzi", "scam", "giveaway", "bitcoin", "hyip"],
    "malware": ["malware", "phishing", "keylogger", "trojan", "exploit", "hack", "hacker", "botnet"],
    "piracy": ["torrent", "warez", "crack", "keygen", "nulled", "camrip", "pirate", "serialkey"],
    "fakes": ["replica", "fake", "knockoff", "counterfeit"],
    "spam": ["spam", "ads", "adserver", "tracker", "popunder", "backlinks", "clickbait", "followers"],
    "lures": ["cheap", "bonus", "winbig", "clickhere", "hotdeal"],
}
WANTED = {
    "learning": ["library", "school", "university", "history", "physics", "mathematics", "chemistry", "economics", "science", "archive", "dictionary", "encyclopedia", "lecture", "grammar"],
    "culture": ["museum", "theatre", "gallery", "music", "orchestra", "cinema", "novels", "poetry", "festival", "photography", "cathedral", "opera"],
    "life": ["garden", "recipes", "bakery", "cycling", "football", "chess", "pottery", "travel", "kitchen", "camping", "knitting", "fishing"],
    "places": ["city", "river", "harbour", "railway", "hospital", "government", "parliament", "court", "embassy", "village", "council", "airport"],
    "nature": ["weather", "astronomy", "geology", "botany", "forest", "ocean", "birds", "climate", "mountain", "insects"],
    "callings": ["dentist", "plumber", "carpenter", "lawyer", "architect", "tailor", "surveyor", "nurse", "farmer", "pilot"],
    "food": ["cheese", "coffee", "noodles", "pasta", "salad", "honey", "wine", "apples", "chocolate", "soup"],
    "sport": ["tennis", "hockey", "rowing", "skating", "archery", "marathon", "judo", "surfing", "volleyball", "badminton"],
    "household": ["lamps", "carpets", "curtains", "plumbing", "paint", "ladder", "mattress", "sofa", "candles", "cups"],
    "services": ["bank", "post", "taxi", "tickets", "hotel", "campus", "clinic", "dental", "vets", "laundry"],
    "technology": ["robotics", "database", "telescope", "microscope", "satellite", "circuits", "sensors", "printers", "linux", "maps"],
    "arts": ["violin", "ballet", "sculpture", "ceramics", "jazz", "choir", "drawing", "comics", "puppets", "folklore"],
    "work": ["software", "engineering", "hardware", "compiler", "insurance", "builders", "furniture", "printing", "tools", "journal"],
}
PARTNERS = ["free", "best", "online", "my", "the", "top", "world", "club", "site", "hub", "24", "open", "daily", "new", "local", "land"]
SYLLABLES = ["ba", "ko", "mi", "re", "tu", "lan", "ver", "sol", "pe", "ga", "dor", "nim"]
ENDINGS = ["com", "org", "net", "io", "info", "biz", "co.uk", "de", "example.com", "example.org", "example.net"]
SUBDOMAINS = ["", "www.", "m.", "", "blog.", "shop."]
PATHS = ["", "/", "/index.html", "/about", "/en/12", "/de/345", "/fr/page.html", "/es/67/", "/news/2021/05/title", "/products/12", "/blog/post-7"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label, word): the labelled table, made from the lists by rule; 1 is unwanted, word is what the url was made from.

    A host is a word alone or joined to one of PARTNERS, which go with either class alike; invented names of three syllables are
    wanted, and so is a plain host with a plain path. Every third unwanted word also stands in the path of such a host.
    """
    rows = []

    def add(host: str, path: str, label: int, word: str) -> None:
        i = len(rows)
        rows.append((f"https://{SUBDOMAINS[i % 6]}{host}.{ENDINGS[i % 11]}{path}", float(label), word))

    for label, families in ((1, UNWANTED), (0, WANTED)):
        for k, word in enumerate(w for words in families.values() for w in words):
            a, b, c, d = (PARTNERS[(k + j) % len(PARTNERS)] for j in (0, 3, 7, 12))
            for j, host in enumerate((word, f"{word}-{a}", f"{b}-{word}", f"{word}{c}", f"{d}{word}")):
                add(host, PATHS[(k + j) % len(PATHS)], label, word)
            if k % 3 == 0:
                add(SYLLABLES[k % 12] + SYLLABLES[(k * 5 + 1) % 12] + SYLLABLES[(k * 7 + 2) % 12], f"/{a}-{word}/", label, word)
    for i, x in enumerate(SYLLABLES):
        for j, y in enumerate(SYLLABLES):
            z = SYLLABLES[(i + 5 * j) % 12]
            add(f"{x}{y}{z}", PATHS[(i + j) % len(PATHS)], 0, f"{x}{y}{z}")
    return spark.createDataFrame(rows, "url string, label double, word string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? # the host, A-Z lower-cased, and up to ? # the path; both empty for null or where there is none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host (between ^ and $) and of the path, kept apart by a letter in front."""

    def of(text: Column, letter: str, n: int) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        grams = F.transform(begins, lambda i: F.concat(F.lit(letter), F.substr(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))

    host = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*(of(host, "h", n) for n in GRAMS), *(of(path, "p", n) for n in GRAMS))


def train(labelled: DataFrame) -> PipelineModel:
    """Logistic regression on a small table (url, label 0 or 1), with an L2 penalty; unwanted rows weigh SHARE of all."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, SHARE / n.get(1, 1)).otherwise((1 - SHARE) / n.get(0, 1)) * sum(n.values())
    rows = labelled.select("label", weight.alias("weight"), _grams(*host_and_path(F.col("url"))).alias("grams"))
    steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True), LogisticRegression(maxIter=50, regParam=0.001, weightCol="weight")]
    return Pipeline(stages=steps).fit(rows.coalesce(1))


def _rule(host: Column, path: Column, rules, value) -> Column:
    """Of the longest rule that fits, else null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(value(v, h, p))) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def judge(pages: DataFrame, model: PipelineModel, url: str = "url", id_col: str = "page_id", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_unwanted) for every row. A null or malformed url has an empty host and path and is judged by the intercept.

    Rows that repeat are judged each, an empty table gives no row, and other columns are not looked at; a long url is judged by all its n-grams.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = model.transform(rows.withColumn("grams", _grams(F.col("host"), F.col("path"))))
    p = vector_to_array("probability")[1]
    named = _rule(F.col("host"), F.col("path"), rules, lambda v, h, p: h + p)
    said = _rule(F.col("host"), F.col("path"), rules, lambda v, h, p: v)
    return rows.select("page_id", "host", "path", named.alias("rule"), F.coalesce(said, F.when(p >= threshold, "block").otherwise("allow")).alias("verdict"), p.alias("p_unwanted"))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), train(labelled_urls(spark)))
