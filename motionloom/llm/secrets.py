"""Operator 7: secrets in texts, with a random forest that removes false positives.

Candidates are taken broadly: private keys, web tokens, passwords in URLs, whatever is
assigned to a name like password or token, tokens with a known prefix, and any token that
is long or mixes letters and digits. A random forest judges each by its length, the
transitions between its characters, how much of it dictionary words cover, the path it
stands in and the words around it. The forest is trained from labelled findings; those
that labelled_findings() makes serve until a table of one's own is given. Nothing leaves
the JVM: candidates, features, training and scoring are DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_key

#: Characters of context on either side.
CONTEXT = 60
THRESHOLD = 0.5
TREES, DEPTH, FINDINGS = 30, 7, 6000

# Words that tell secrets from other tokens.
SECRET_WORDS = "api[_-]?key|apikey|token|secret|passwd|password|pwd|credential|bearer|private[_-]?key|access[_-]?key|auth"
HARMLESS_WORDS = "sha1|sha256|md5|checksum|digest|commit|revision|hash|etag|uuid|guid|version|isbn|order|invoice|card|number|session|build|image|file"
HARMLESS_PATHS = "test|fixture|example|sample|mock|doc|vendor|lock"
PREFIXES = "gh[opsur]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|sk-|xox[abeprs]-|AKIA|ASIA|AIza|npm_|hf_"
DICTIONARY = [
    "access", "account", "admin", "backup", "change", "client", "config", "data", "database", "default", "demo",
    "dummy", "example", "file", "fixture", "hello", "here", "home", "image", "index", "insert", "local", "main", "name",
    "number", "page", "password", "path", "placeholder", "public", "release", "replace", "sample", "secret", "server",
    "service", "session", "staging", "system", "table", "temp", "test", "this", "token", "user", "value", "version", "your",
]

# Candidates; of patterns that match at one place the first counts.
_NAME = f"(?i:{SECRET_WORDS})s?[0-9]{{0,3}}(?:[_-][A-Za-z0-9_-]{{0,20}})?"
_SIGN = "[\"']?\\s{0,3}[:=]{1,2}>?\\s{0,3}"
_UNNAMED = f"(?![A-Za-z0-9_-]*{_NAME}=)"
_START = "(?<![\\p{L}0-9+/_=-])" + _UNNAMED
CANDIDATES = {
    "private key": "-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----(?:[A-Za-z0-9+/=\\s:,.\\\\-]*?-----END [A-Z ]*PRIVATE KEY[A-Z ]*-----)?",
    "web token": "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}(?:\\.[A-Za-z0-9_-]+)+",
    "in a url": "(?<=:)(?<=://[^\\s/@:]{0,64}:)[^\\s/@]+(?=@)",
    "assigned, in quotes": f"(?<=[\"'])(?<={_NAME}{_SIGN}[\"'])(?![a-z]+://)(?:(?<=\")[^\"\\n]+(?=\")|(?<=')[^'\\n]+(?='))",
    "assigned": f"(?<=[:=>\\s])(?<=[:=]>?\\s{{0,3}})(?<={_NAME}{_SIGN})(?![a-z]+://|(?i:bearer|basic) )[^\\s\"',;]*[^\\s\"',;:.()\\[\\]{{}}]",
    "bearer": "(?<= )(?<=(?i:bearer|basic) )[A-Za-z0-9+/_=.~-]*[A-Za-z0-9+/_=~-]",
    "prefix": f"(?<![A-Za-z0-9+/_=-])(?:{PREFIXES})[A-Za-z0-9_-]+",
    "long": f"{_START}[A-Za-z0-9+/_=-]{{16,}}(?!\\p{{L}})|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]){_UNNAMED}[A-Za-z0-9+/_=-]{{16,}}",
    "mixed": f"{_START}(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{8,}}(?!\\p{{L}})",
}
TOKEN = "|".join(f"(?:{p})" for p in CANDIDATES.values())

FEATURES = ["marks", "marker", "url_password", "length", "transitions", "distinct", "digits", "uppers", "hex", "separators", "dictionary", "path", "harmless_path", "secret_near", "harmless_near", "assigned", "quoted"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(findings: DataFrame) -> DataFrame:
    """findings (token, before, after, path) with a column for each of FEATURES."""
    token, before, after = F.col("token"), F.lower("before"), F.lower("after")
    size = F.length(token).cast("double")
    flag = lambda c: c.cast("double")
    near = F.concat_ws(" ", before, after)
    changes = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    left = F.length(F.regexp_replace(F.lower(token), "|".join(DICTIONARY), "")).cast("double")
    return findings.withColumns({
        "marks": _count(token, "[^\\p{L}0-9+/_=-]") / size,
        "marker": flag(token.rlike(f"^(?:-----BEGIN |eyJ[A-Za-z0-9_-]{{5,}}[.]|(?:{PREFIXES})[A-Za-z0-9_-]{{8,}})")),
        "url_password": flag(before.rlike("://[^\\s/@:]*:$") & after.startswith("@")),
        "length": size,
        "transitions": _count(token, changes) / size,
        "distinct": F.size(F.array_distinct(F.split(token, ""))).cast("double") / size,
        "digits": _count(token, "[0-9]") / size,
        "uppers": _count(token, "[A-Z]") / size,
        "hex": flag(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "separators": _count(token, "[-_/=+]") / size,
        "dictionary": 1 - left / size,
        "path": flag(before.rlike("(?:://|/)\\S*$") | (_count(token, "/") >= 3)),
        "harmless_path": flag(F.lower(F.coalesce("path", F.lit(""))).rlike(HARMLESS_PATHS)),
        "secret_near": flag(before.rlike(f"(?:{SECRET_WORDS})\\W*$") | near.rlike(f"\\b(?:{SECRET_WORDS})\\b")),
        "harmless_near": flag(near.rlike(f"\\b(?:{HARMLESS_WORDS})\\b")),
        "assigned": flag(before.rlike("[:=]\\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$")),
    })


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n findings (token, before, after, path, label), made by rule from numbers; half are secrets (label 1)."""
    rows = spark.range(n).withColumn("s", F.sha2(F.col("id").cast("string"), 512))
    pick = lambda salt, *choices: F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(choices))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.substring("s", 1, 96))), "[^A-Za-z0-9+/=]", "")
    kind = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(10))
    upto = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    plain_b64 = F.regexp_replace(b64, "[+/=]", "")
    letters = lambda alphabet: F.translate("s", "0123456789abcdef", alphabet)
    stem = pick("pw", "Pl4yer", "rocket", "S3cur3", "dragon", "Winter", "qwerty", "letmein", "monkey", "Pa55", "zebra")
    password = F.concat(stem, pick("m1", "!", "&", "$", "#", "", "", "", "", "_", "%"), F.substring(F.translate("s", "abcdef", "907162"), F.lit(1), upto("pl", 1, 5)), pick("m2", "", "", "", "!", "?", "*"))
    body = F.concat(F.lit("\n"), plain_b64, F.lit("\n"))
    key_kind = pick("kk", "RSA ", "EC ", "OPENSSH ", "")
    pem = F.concat(F.lit("-----BEGIN "), key_kind, F.lit("PRIVATE KEY-----"), pick("pe", "", "full"))
    pem = F.when(pem.endswith("full"), F.concat(F.regexp_replace(pem, "full$", ""), body, F.lit("-----END "), key_kind, F.lit("PRIVATE KEY-----"))).otherwise(pem)
    jwt = F.concat(F.lit("eyJ"), F.substring(plain_b64, 1, 20), F.lit(".eyJ"), F.substring(plain_b64, 20, 24), F.lit("."), F.substring(plain_b64, 8, 30))
    marker = F.pmod(F.xxhash64("id", F.lit("marker")), F.lit(3))
    secret = (
        F.when(kind == 0, F.substring("s", 1, 40)).when(kind == 1, F.substring("s", 1, 32))
        .when(kind == 2, F.substring(b64, 1, 40)).when(kind == 3, F.concat(pick("p", "ghp_", "sk_live_", "xoxb-", "AKIA"), F.substring(F.regexp_replace(b64, "[+/=]", "x"), 1, 32)))
        .when(kind == 4, F.upper(F.substring("s", 5, 40))).when(kind == 5, password)
        .when(kind == 6, F.substring(plain_b64, F.lit(1), upto("sl", 6, 15))).when(kind == 7, F.substring(letters("ghijKLMNopqrSTUv"), F.lit(1), upto("ll", 12, 40)))
        .when(kind == 8, F.when(marker == 0, password).otherwise(F.substring(plain_b64, F.lit(1), upto("sl", 6, 24))))
        .otherwise(F.when(marker == 0, pem).when(marker == 1, jwt).otherwise(F.concat(pick("p2", "ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "AKIA", "AIza", "npm_"), F.substring(plain_b64, 1, 36))))
    )
    name = pick("n", "token", "api_key", "secret", "password", "auth token", "access_key", "client_secret", "Bearer", "API_KEY")
    sign = pick("q", ' = "', "=", ": ", ' = "', ": '", ' = "')
    words = F.concat_ws("_", pick("w1", *DICTIONARY[::3]), pick("w2", *DICTIONARY[1::3]), pick("w3", *DICTIONARY[2::3]), pick("w4", "1", "2", "2024", "v2", "01"))
    prose = F.substring(letters("aeiorstnlaeiomde"), F.lit(1), upto("wl", 16, 24))
    false_token = (
        F.when(kind == 0, F.concat(words, F.lit("_"), F.col("id").cast("string"))).when(kind == 1, F.translate(F.substring("s", 1, 16), "abcdef", "123456"))
        .when(kind == 2, F.substring("s", 1, 40)).when(kind == 3, F.concat_ws("-", F.substring("s", 1, 8), F.substring("s", 9, 4), F.substring("s", 13, 4), F.substring("s", 17, 4), F.substring("s", 21, 12)))
        .when(kind == 4, F.concat_ws("/", F.lit("usr"), pick("w1", *DICTIONARY[::3]), pick("w2", *DICTIONARY[1::3]), F.substring("s", 1, 4)))
        .when(kind == 5, pick("ph", "your_password_here", "changeme", "<password>", "None", "null", "true", "false", "${PASSWORD}", "xxxxxxxx", "********", "REDACTED", "placeholder", "example", "your-token", "is", "the", "for", "and", "of"))
        .when(kind == 6, F.when(marker == 0, F.upper(prose)).otherwise(prose)).when(kind == 7, F.substring("s", F.lit(1), upto("hl", 8, 12)))
        .when(kind == 8, F.concat_ws("-", pick("w1", *DICTIONARY[::3]), pick("w2", *DICTIONARY[1::3]), pick("w3", *DICTIONARY[2::3]), F.substring(letters("aeiorstnlaeiomde"), 1, 6)))
        .otherwise(F.concat(pick("w1", *DICTIONARY[::3]), F.initcap(pick("w2", *DICTIONARY[1::3])), F.initcap(pick("w3", *DICTIONARY[2::3]))))
    )
    plain = pick("c", "commit ", "sha256 checksum: ", "order number ", "see file ", "the ", "of that ", "uuid=", "version ", "card ", "was there, ", "md5 ", "http://host/path/")
    placeholder = F.concat(name, sign)
    address = pick("u", "postgres://app:", "https://bob:", "redis://:", "amqp://user:", "mysql://root:")
    marked = F.when(F.pmod(F.xxhash64("id", F.lit("marked")), F.lit(3)) < 2, plain).otherwise(placeholder)
    true_before = F.when(kind == 8, address).when(kind.isin(3, 9), marked).otherwise(placeholder)
    false_before = F.when((kind == 5) | (kind == 0) & (F.pmod("id", F.lit(3)) == 0), placeholder).otherwise(plain)
    positive = F.pmod(F.col("id"), F.lit(2)) == 0
    return rows.select(
        F.when(positive, secret).otherwise(false_token).alias("token"),
        F.concat(pick("l", "set the ", "in that ", "", "x = 1; ", "de la "), F.when(positive, true_before).otherwise(false_before)).alias("before"),
        F.when(positive & (kind == 8), pick("h", "@db.local/app", "@host:5432/x", "@example.org")).otherwise(pick("a", '" and', " the", "", "\n", '"')).alias("after"),
        F.when(positive, pick("f", "src/app.py", "", "config.yml", "notes")).otherwise(pick("f", "tests/fixture.py", "", "docs/example.md", "package.lock", "src/main.py")).alias("path"),
        positive.cast("double").alias("label"),
    )


def _assembled(findings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep").transform(features(findings))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> RandomForestClassificationModel:
    """The forest of labelled findings (token, before, after, path, label 0 or 1)."""
    ready = _assembled(labelled.filter("token is not null and label is not null").fillna("", ["before", "after", "path"]))
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(ready.select("vector", F.col("label").cast("double").alias("label")))


def candidates(docs: DataFrame, path_column: str | None = None) -> DataFrame:
    """(doc_id, tk, ordinal, start, token, before, after, path) of docs (doc_id, text)."""
    path = F.col(f"`{path_column}`").cast("string") if path_column else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    rows = rows.filter("text is not null").withColumns({"tk": text_key(F.col("text")), "parts": F.split("text", TOKEN), "tokens": F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))})
    each = F.transform(F.col("tokens"), lambda t, i: F.struct(t.alias("token"), F.length(F.get("parts", i)).alias("gap"), F.right(F.get("parts", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after")))
    found = rows.filter(F.size("tokens") > 0).select("doc_id", "tk", "path", F.posexplode(each).alias("ordinal", "c")).distinct()
    until = Window.partitionBy("doc_id", "tk").orderBy("ordinal")
    start = F.sum("c.gap").over(until) + F.coalesce(F.sum(F.length("c.token")).over(until.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.select("doc_id", "tk", "ordinal", start.cast("long").alias("start"), F.col("c.token").alias("token"), F.col("c.before").alias("before"), F.col("c.after").alias("after"), "path")


def findings(docs: DataFrame, model: RandomForestClassificationModel, path_column: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, token, score, is_secret for every candidate in docs (doc_id, text).

    start counts characters from 0. path_column names a column with the text's path, if
    there is one. Null and empty texts have no candidates. Rows that repeat a doc_id are
    told apart by their text, rows alike in both give their findings once, a null doc_id
    stays null. An empty table gives an empty result; other columns are ignored.
    """
    scored = model.transform(_assembled(candidates(docs, path_column)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", F.length("token").alias("length"), "token", score.alias("score"), (score >= threshold).alias("is_secret"))
