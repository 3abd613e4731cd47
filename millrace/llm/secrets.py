"""Secret scans: candidate strings judged by a random forest, with DataFrame functions only.

A candidate is a run of at least LEAST characters of [A-Za-z0-9_+/=.-], or the value assigned
to a name that holds a keyword, if it has SHORTEST characters at least: all between quotes,
or else up to white space, a quote or the next parameter, without closing punctuation. A
name with a bare = and no space before its value is part of the candidate, as in other runs.
Its features are its length, its character transitions and distinct characters, the share of
it covered by dictionary words, whether it looks like a path, and the words before it (WINDOW
characters; those after it are given too). The forest is trained in numpy on
labelled findings, real secrets and false positives (checksums, paths, identifiers,
placeholders), and compiled to a column expression, so scanning stays inside the JVM.

labelled_findings() makes the default training table from rules, as no real labelled
findings can be had here; train() takes any table (text, label) whose texts hold a candidate.

Nulls, ties, empty input: a null text has no findings; repeated candidates are findings of
their own, with their positions; an empty table gives an empty result. Whole texts are read
and candidates of any length are kept whole.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST = 16
WINDOW = 48
SHORTEST = 4
TREES, DEPTH, LEAF = 25, 5, 8
THRESHOLD = 0.5

#: Words that make up identifiers, paths and prose rather than secrets (fixed values).
DICTIONARY = (
    "about access account admin after again agent alpha answer archive array article asset author background base beta block body branch browser build button "
    "cache call category center change char check class client close cloud code collect color column command commit common component config connect container "
    "content context control copy core count create current custom data database date debug default delete demo deploy detail device digest directory document domain "
    "download driver email empty enable engine entry error event example expect export extension false family feature field file filter first folder font "
    "form format frame from function gateway general global graph group handle hash head header hello height home host html http image import index info init "
    "input insert install instance int interface internal item javascript job json kernel key label language layout left length level library license line link list load local "
    "location lock log long main manager map master match memory menu message meta method model module monitor mount name network node none note null number object "
    "open option order origin output package page parameter parent parse part patch path pattern phone plugin point policy pool port position post prefix "
    "process product profile project property protocol provider proxy public query queue random range read record region register release remote remove render replace report "
    "request require reset resource response result return right role root route row rule run sample scale schema script search section select send sequence server service session set "
    "setting share size sort source space span spec stack stage start state static status step stop storage store stream string style sub submit support switch system tab table tag "
    "target task template test text theme thread time title token tool top total track transfer tree true type unit update upload url user util value variable version video view "
    "virtual web width window word work write xxxx your zone"
).split()
KEYWORDS = "token|secret|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|auth|credential|passw(?:or)?d|passwd|pwd|bearer|client[_ -]?secret"
RUN = "A-Za-z0-9_+/=.-"
#: Group 1: the name, sign and opening quote. Loops over alternatives are possessive, so that values of any length need no stack.
ASSIGNED = rf"(?<![{RUN}])([{RUN}]*?(?i:{KEYWORDS})[A-Za-z0-9_.-]{{0,64}}+[\"'`]?[ \t]{{0,8}}(?::=|=>|[:=])[ \t]{{0,8}}[\"'`]?)"
VALUE = (
    rf"(?:(?<=\")[^\"\r\n]{{{SHORTEST},}}+(?=\")|(?<=')[^'\r\n]{{{SHORTEST},}}+(?=')|(?<=`)[^`\r\n]{{{SHORTEST},}}+(?=`)"
    rf"|(?![:=>])(?:[^\s\"'`&;,]|[&;,](?!\w{{1,64}}[:=])){{{SHORTEST},}}+)"
)
CANDIDATE = rf"{ASSIGNED}{VALUE}|[{RUN}]{{{LEAST},}}+"
INNOCENT = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|revision|etag|integrity|uuid|guid|version|build|example|sample|dummy|placeholder|fixture|image|href|src"

FEATURES = ("length", "digits", "uppers", "symbols", "transitions", "distinct", "dictionary", "path", "keyword", "assigned", "quoted", "innocent", "hexadecimal", "vowels")


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, candidate, before, after): every candidate of every text, with its neighbourhood."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("names", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)))
    rows = rows.withColumn("gaps", F.split("text", CANDIDATE, -1)).withColumn("row", F.monotonically_increasing_id())
    # The text around a match, put together from as many matches and gaps as WINDOW characters can hold.
    most = -(-WINDOW // (SHORTEST + 4))
    ahead = f"array_join(transform(sequence(greatest(i - {most}, 0), i - 1), j -> right(gaps[j], {WINDOW}) || right(found[j], {WINDOW})), '')"
    behind = f"array_join(transform(sequence(i + 1, least(i + {most}, size(found))), j -> left(gaps[j], {WINDOW}) || left(coalesce(get(found, j), ''), {WINDOW})), '')"
    before = f"right(if(i = 0, '', {ahead}) || right(gaps[i], {WINDOW}), {WINDOW})"
    one = f"struct(i, x as match, names[i] as name, {before} as before, left({behind}, {WINDOW}) as after, length(gaps[i]) as gap, length(x) as hit)"
    rows = rows.select("doc_id", "row", F.inline(F.expr(f"transform(found, (x, i) -> {one})")))
    # Only candidates are shuffled; a window holds those of one text.
    so_far = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("doc_id", "row").orderBy("i"))
    rows = rows.withColumn("start", so_far - F.col("hit"))
    # What of a match is the name, and what is closing punctuation of a value without quotes.
    rows = rows.withColumn("name", F.when(F.col("name").rlike(rf"^[{RUN}]*$"), F.lit("")).otherwise(F.col("name")))
    rows = rows.withColumn("value", F.expr("substring(match, length(name) + 1)"))
    bare = F.col("match").rlike(rf"^[{RUN}]+$") | F.col("name").rlike("[\"'`]$")
    rows = rows.withColumn("candidate", F.when(bare, F.col("value")).otherwise(F.expr("trim(TRAILING ',;)]}>' FROM value)")))
    rows = rows.withColumn("before", F.expr(f"lower(right(before || name, {WINDOW}))")).withColumn("after", F.expr(f"lower(left(substring(value, length(candidate) + 1) || after, {WINDOW}))"))
    rows = rows.withColumn("start", (F.col("start") + F.length("name")).cast("long"))
    return rows.where(F.length("candidate") >= SHORTEST).select("doc_id", "start", "candidate", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    c, before = F.col("candidate"), F.col("before")
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    near = F.concat_ws(" ", before, F.lower(c))
    bare = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    return found.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "symbols": share("[^A-Za-z0-9]"),
            "transitions": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "dictionary": 1.0 - F.length(bare) / n,
            "path": share("[/.]"),
            "keyword": near.rlike(rf"(?i)({KEYWORDS})").cast("double"),
            "assigned": (before.rlike("[:=>]+\\s*[\"'`]?$") | c.rlike("^[A-Za-z_]+=")).cast("double"),
            "quoted": before.rlike("[\"'`]$").cast("double"),
            "innocent": near.rlike(rf"(?i)\b({INNOCENT})").cast("double"),
            "hexadecimal": c.rlike("^[0-9a-f]+$").cast("double"),
            "vowels": share("[aeiouAEIOU]"),
        }
    )


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        return F.when(F.col(FEATURES[self.feature]) <= self.cut, self.low.column()).otherwise(self.high.column())


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> Node:
    """One tree: at each node the best Gini split of a random subset of the features."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * LEAF or node.value in (0.0, 1.0):
        return node
    best = node.value * (1 - node.value) * len(y) - 1e-9
    for k in rng.choice(x.shape[1], 5, replace=False):
        order = np.argsort(x[:, k], kind="stable")
        values, ones = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1], ones[-1] - ones[:-1]
        loss = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        loss[(values[1:] == values[:-1]) | (n < LEAF) | (len(y) - n < LEAF)] = np.inf
        i = int(loss.argmin())
        if loss[i] < best:
            best, node.feature, node.cut = float(loss[i]), int(k), float((values[i] + values[i + 1]) / 2)
    if node.feature >= 0:
        below = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[below], y[below], rng, depth - 1), grow(x[~below], y[~below], rng, depth - 1)
    return node


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int]]:
    """(text, 1 for a secret): n texts with one candidate each, made from rules."""
    r = random.Random(seed)
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    names = ("token", "secret", "api_key", "apikey", "API_KEY", "access_key", "auth_token", "client_secret", "password", "passwd", "private_key", "SECRET_TOKEN", "aws_secret_access_key", "GITHUB_ACCESS_TOKEN", "stripe_secret_key", "database_password")
    places = (' = "{}"', ": {}", "={}", ": '{}'", ' := "{}"', '": "{}"')
    prose = ("the", "value", "was", "found", "in", "und", "der", "les", "que", "and", "set", "of", "here", "see", "for")
    words = lambda: " ".join(r.choice(prose) for _ in range(r.randint(0, 6)))
    ident = lambda: "".join(w.capitalize() for w in r.sample(DICTIONARY, r.randint(3, 5)))
    secret = (lambda: pick(hexes, r.choice((20, 32, 40, 64))), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(b64, r.randint(24, 64)) + "==", lambda: r.choice(("pk_live_", "key-", "gh_", "xo-")) + pick(alnum, 28))
    # Passwords: short, punctuated, or of letters of one case alone.
    leet = lambda: r.choice(DICTIONARY).capitalize().translate(str.maketrans(r.choice(("oe", "ai", "si")), r.choice(("03", "41", "51")))) + str(r.randint(1, 9999))
    password = (
        leet,
        lambda: leet() + r.choice("!@#$%&*") + pick(alnum, r.randint(0, 6)),
        lambda: pick(alnum + "!@#$%^*", r.randint(8, 20)) + r.choice("0123456789") + r.choice("!@#$"),
        lambda: pick(alnum, r.randint(8, 14)) + r.choice("0123456789"),
        lambda: r.choice("!@#$").join(pick(alnum, r.randint(2, 6)) for _ in range(4)),
        lambda: pick(string.ascii_lowercase, r.randint(16, 40)),
        lambda: pick(string.ascii_uppercase, r.randint(16, 40)),
    )
    other = ("required", "string", "None", "true", "false", "null", "optional", "Bearer", "changed", "missing", "nothing", "Miller", "everyone", "os.environ", "get_token()", "self.token", "$TOKEN", "${DB_PASSWORD}", "<password>", "********", "request.user.name", "process.env.API_KEY", "settings.SECRET", "[redacted]", "the usual one")
    plain = (
        lambda: r.choice(("commit ", "sha256: ", "md5 ", "checksum=", "revision ", 'integrity="sha512-', "etag: ")) + pick(hexes, r.choice((32, 40, 64))),
        lambda: "/".join(r.sample(DICTIONARY, 4)) + "/" + r.choice(DICTIONARY) + str(r.randint(1, 99)) + ".html",
        lambda: ident() + str(r.randint(0, 99)),
        lambda: "_".join(r.sample(DICTIONARY, 4)) + f"_v{r.randint(1, 9)}",
        lambda: r.choice(names) + r.choice(places).format(r.choice(("your-api-key-here-123", "xxxxxxxxxxxxxxxxxxxx0", "example_token_value_1", "REPLACE_WITH_TOKEN_1", "test-secret-value-0000"))),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + "/" + str(r.randint(0, 9)) * 8,
        lambda: r.choice(names) + " " + "/".join(r.sample(DICTIONARY, 3)) + "/" + ident() + "1.py",
        lambda: pick("-=_", r.randint(16, 40)) + str(r.randint(0, 9)),
        lambda: f"{pick(hexes, 8)}-{pick(hexes, 4)}-4{pick(hexes, 3)}-a{pick(hexes, 3)}-{pick(hexes, 12)}",
        lambda: pick(hexes, r.choice((32, 40, 64))),
        lambda: r.choice(("id ", "ref ", "user ")) + pick("0123456789", r.randint(16, 24)),
        lambda: r.choice(names) + r.choice(places).format(r.choice((*other, r.choice(DICTIONARY) + "ing", ident(), "_".join(r.sample(DICTIONARY, 2)) + "()"))),
        lambda: r.choice((r.choice(DICTIONARY) + "_" + r.choice(names) + "_identifier", ident() + r.choice(("Token", "Secret", "Credential")) + "Provider", "aws_secret_access_key", "GITHUB_ACCESS_TOKEN")),
        lambda: "".join(r.choice(("en", "ti", "on", "th", "er", "es", "ung", "ment", "schaft", "keit")) for _ in range(r.randint(8, 12))),
        lambda: r.choice("-=_.") * r.randint(16, 60),
        lambda: "_".join(r.sample(DICTIONARY, 4)),
        lambda: "".join(r.choice(("en", "ti", "on", "th", "er", "es", "ung", "ment")) for _ in range(10)) + ".A",
    )
    out = []
    for i in range(n):
        found = r.choice(names) + r.choice(places).format(r.choice(r.choice((secret, password)))()) if i % 2 else r.choice(plain)()
        out.append((f"{words()} {found} {words()}", i % 2))
    return out


def train(findings: DataFrame, seed: int = 5) -> Column:
    """A forest from (text, label), as a column expression over FEATURES."""
    keyed = findings.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("label").cast("double").alias("label")).cache()
    rows = with_features(candidates(keyed)).join(keyed.select("doc_id", "label"), "doc_id").select(*FEATURES, "label", "doc_id", "start").orderBy("doc_id", "start").collect()
    keyed.unpersist()
    if not rows:
        return F.lit(0.0)
    x, y = np.array([r[:-3] for r in rows], float), np.array([r["label"] for r in rows])
    rng = np.random.Generator(np.random.PCG64(seed))
    trees = []
    for _ in range(TREES):
        drawn = rng.integers(0, len(y), len(y))
        trees.append(grow(x[drawn], y[drawn], rng).column())
    total = trees[0]
    for t in trees[1:]:
        total = total + t
    return F.round(total / F.lit(float(TREES)), 6)


def default_forest(spark: SparkSession) -> Column:
    return train(spark.createDataFrame(labelled_findings(), "text string, label int").coalesce(1))


def scan(docs: DataFrame, forest: Column, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row a candidate: doc_id, start (code points before it), length, secret, score, is_secret."""
    found = with_features(candidates(docs, text, key)).withColumn("score", forest)
    return found.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("candidate").alias("secret"), "score", (F.col("score") >= threshold).alias("is_secret"))
