"""Secret scan: candidate strings, and a random forest that removes false positives. DataFrame operations only.

Candidates are runs of token characters of LEAST length or more, with the padding that may follow. A `=` before
them is not theirs, nor is one after them with a token character behind it, so that of `name=value` the value is
judged, beside its name, which may be a candidate itself. What is assigned to a name that ends like one of ASSIGNED is a
candidate from SHORT characters on, whatever punctuation it holds.
The forest looks at each candidate's length, its transitions between kinds of characters, the share
of letters that dictionary words cover, its likeness to a path or name, repetition, and the words
beside it. It is trained from labelled findings: a table (before, candidate, after, label) that
the caller gives, or `labelled_findings`, made by rule from hashes, so that no real secret is in the code.
The dictionary is a list of words that the caller may give.
The forest has TREES trees of DEPTH levels, from ROWS findings at most.

Cases: null and empty texts have no findings. Each occurrence is a finding, in repeated rows as
well; the start is a position in code points from 0. Very long texts are searched whole. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, CONTEXT, RUN = 16, 32, 256
TREES, DEPTH, ROWS, SEED = 24, 6, 20_000, 11
THRESHOLD = 0.5

SHORT = 8
ASSIGNED = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_?KEY|api-key|[Pp]wd|PWD)"
#: A value between quotes, and one up to white space, right behind a name and its sign.
VALUE = rf"(?<=[\"'=:>\s])(?<=[=:>][\"'\s]{{0,2}})(?:(?<={ASSIGNED}[\"']?\s?(?:=>|:=|=|:)\s?[\"'])[^\s\"'`<>]{{{SHORT},256}}(?=[\"'])|(?<={ASSIGNED}\s?(?:=>|:=|=|:)\s?)(?:[^\s\"'`<>,;(){{}}\[\]&]|&(?!\w+=)){{{SHORT},256}}(?=[\s,;)\]&]|$))"
LONG = rf"(?<![A-Za-z0-9_+/.\-])[A-Za-z0-9_+/.\-]{{{LEAST},}}(?:={{1,2}}(?!=*[A-Za-z0-9_+/.\-]))?"
#: The pattern of texts where such a name has a sign behind it; in others there is nothing but LONG to find. The parts
#: of names are looked for first, as plain strings.
PARTS = "assword ASSWORD asswd ASSWD ecret ECRET oken OKEN pi_key pi_Key pikey piKey PI_KEY PIKEY api-key pwd Pwd PWD".split()
NAMED, EITHER = rf"{ASSIGNED}[\"']?\s?[=:]", f"(?:{VALUE}|{LONG})"
#: Words that stand beside secrets, and beside strings that only look like them.
NEAR_SECRET = r"(?i)(?:secret(?:[_-]?key)?|token|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?:orization)?|bearer|client[_-]?secret)[\"']?\s*(?::=|=>|=|:)?\s*[\"']?$"
NEAR_OTHER = r"(?i)(?:commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|revision|isbn|order|phone|ref|https?://\S*|www\.\S*|@)[\"']?\s*[:=#]?\s*[\"']?$"
PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29\.|eyJ|SG\.|npm_|dop_v1_)"
PLACEHOLDER = r"(?i)example|sample|dummy|your|xxxx|test|placeholder|changeme|redacted|0000|1234567|abcdef"
#: Frequent letter groups of dictionary words in the languages at hand, words of identifiers, and words of four letters or more.
WORDS = (
    "the and ing ion ent for tion ter ment ers ate con com pro per ver able ight ough ould ich ein sch und der die den cht ung que les des est aux eur oir ado los las cion mente esta ndo "
    "user name file path data type list item page view test node main index image static assets content value config module class about after again also always another back because been before being best between "
    "both build call case change check client code color come copy count create current date default delete description does each error even event every example find first format from function good great group "
    "have help here home host html http image import info input into issue just key know large last left level library life like line link local long look make many media message method model more most much must never "
    "next number object only open order other output over part people place plugin point public query read release report request result right same script search section service session should show side size some source "
    "start state still string style such support system table take text than that their them then there these they thing this time title update upload used using version very want week well were what when where which while width will with word work world year your "
    "avec dans pour tout plus cette comme nicht auch eine sich werden haben aber para como todo esto pero"
).split()

FEATURES = ("length", "digits", "uppers", "lowers", "others", "transitions", "dictionary", "segments", "path_like", "hexadecimal", "numeric", "distinct", "placeholder", "prefix", "near_secret", "near_other", "quoted", "assigned")


def findings_of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, before, candidate, after) for every candidate; before and after are the text beside it.

    The text is split at candidates, so piece i ends where candidate i begins.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).withColumn("named", functools.reduce(Column.__or__, [F.contains("text", F.lit(p)) for p in PARTS]) & F.col("text").rlike(NAMED))
    rows = rows.where(F.col("named") | F.col("text").rlike(LONG))
    found = lambda pattern: F.struct(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("all"), F.split("text", pattern, -1).alias("gaps"))
    cut = rows.select("doc_id", F.when(F.col("named"), found(EITHER)).otherwise(found(LONG)).alias("cut")).select("doc_id", "cut.*")
    # Each text's arrays are made once: a generator stands between their making and their use.
    once = lambda df, **columns: df.select("doc_id", F.inline(F.array(F.struct(*(F.col(c) for c in df.columns if c != "doc_id"), *(v.alias(k) for k, v in columns.items())))))
    sides = F.transform("gaps", lambda g: F.struct(F.substring(g, -CONTEXT, CONTEXT).alias("tail"), F.substring(g, 1, CONTEXT // 2).alias("head")))
    steps = F.zip_with("gaps", "all", lambda g, c: F.struct(F.length(g).cast("long").alias("gap"), F.coalesce(F.length(c), F.lit(0)).cast("long").alias("own")))
    short = once(cut, sides=sides, steps=steps).drop("gaps")
    # Positions are prefix sums in two levels, over runs of RUN candidates and inside them.
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.gap + x.own)
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("all") / RUN).cast("int")), lambda r: total(F.slice("steps", r * RUN + 1, RUN)))
    begun = F.transform("runs", lambda _, r: F.aggregate(F.slice("runs", 1, r), F.lit(0).cast("long"), lambda a, x: a + x))
    placed = once(once(short, runs=runs), begun=begun)

    # A window reaches over candidates: of SHORT characters each, four fill the one before and two the one after.
    def finding(c: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        start = F.get("begun", run) + total(F.slice("steps", run * RUN + 1, i - run * RUN)) + F.get("steps", i).gap
        ahead = lambda k: F.when(i >= k, F.concat(F.get("sides", i - k).tail, F.get("all", i - k))).otherwise("")
        before = F.substring(F.concat(*(ahead(k) for k in (4, 3, 2, 1)), F.get("sides", i).tail), -CONTEXT, CONTEXT)
        behind = lambda k: (F.coalesce(F.get("sides", i + k).head, F.lit("")), F.coalesce(F.get("all", i + k), F.lit("")))
        after = F.substring(F.concat(*behind(1), *behind(2)), 1, CONTEXT // 2)
        return F.struct(start.alias("start"), before.alias("before"), c.alias("candidate"), after.alias("after"))

    return placed.select("doc_id", F.inline(F.transform("all", finding)))


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(findings: DataFrame, words: Sequence[str] = WORDS) -> DataFrame:
    """findings with a column for each of FEATURES."""
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0001"), "[A-Z]", "\u0002"), "[a-z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    letters = F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    covered = F.regexp_replace(letters, "|".join(sorted(words, key=lambda w: (-len(w), w))), "")
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns = {
        "length": F.log1p(F.length(c)),
        "digits": _share(c, "[^0-9]"),
        "uppers": _share(c, "[^A-Z]"),
        "lowers": _share(c, "[^a-z]"),
        "others": _share(c, "[A-Za-z0-9]"),
        "transitions": (F.length(runs) - 1) / F.length(c),
        "dictionary": F.when(F.length(letters) > 0, 1 - F.length(covered) / F.length(letters)).otherwise(0.0),
        "segments": F.size(F.split(c, r"[/._\-]")).cast("double"),
        "path_like": yes(c.rlike(r"^[./]*(?:[A-Za-z][A-Za-z0-9_\-]*[./])+[A-Za-z0-9_\-]*$")),
        "hexadecimal": yes(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "numeric": yes(c.rlike(r"^[0-9.\-+/]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(40)),
        "placeholder": yes(c.rlike(PLACEHOLDER)),
        "prefix": yes(c.rlike(PREFIX)),
        "near_secret": yes(F.col("before").rlike(NEAR_SECRET)),
        "near_other": yes(F.col("before").rlike(NEAR_OTHER)),
        "quoted": yes(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "assigned": yes(F.col("before").rlike("(?:=|:|=>)\\s*[\"'`]?$")),
    }
    return findings.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(before, candidate, after, label), made by rule: hashes in the forms of secrets, and what is taken for them."""
    n = spark.range(rows).withColumn("h", F.sha1(F.col("id").cast("string"))).withColumn("g", F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))).withColumn("kind", F.col("id") % 26)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("id") / 26 % len(xs)).cast("int") + 1)
    key = pick('token = "', 'api_key: "', "secret='", 'password = "', "Authorization: Bearer ", "ACCESS_KEY=", 'client_secret = "', "TOKEN = \"")
    names = "AWS_SECRET_ACCESS_KEY GITHUB_ACCESS_TOKEN STRIPE_SECRET_KEY DATABASE_PASSWORD spring.datasource.password SLACK_BOT_TOKEN_MAIN google_client_secret".split()
    long_key = pick(*(n + sign for sign in ("=", ' = "', '="', ": ", " = ") for n in names), "https://a.example.com/q?api_key=", "//www.example.com/login?token=")
    other_key = pick("GIT_COMMIT_CHECKSUM=", 'BUILD_REVISION_SHA256 = "', "package_lock_checksum: ", "IMAGE_CONTENT_DIGEST=", 'release.artifact.md5 = "')
    plain = pick("and then ", "see ", "was found in the ", "of ", "", ", der ", " les ")
    word = F.concat_ws("", *[F.element_at(F.array(*map(F.lit, WORDS)), (F.conv(F.substring("h", 1 + 2 * i, 2), 16, 10).cast("int") % len(WORDS)) + 1) for i in range(6)])
    digits = F.regexp_replace("h", "[a-f]", "7")
    made = F.when(F.col("kind") < 4, F.struct(key.alias("b"), F.col("h").alias("c"), F.lit(1.0).alias("l")))
    cases = {
        4: (key, F.upper("h"), 1), 5: (key, F.substring("g", 1, 40), 1), 6: (plain, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring("g", 1, 16), "+/=", "QXZ"))), 1),
        7: (plain, F.concat(F.lit("ghp_"), F.translate(F.substring("g", 1, 36), "+/=", "aB3")), 1), 8: (key, F.translate(F.substring("g", 3, 24), "+/=", "kR5"), 1), 9: (plain, F.concat(F.lit("sk_live_"), F.translate(F.substring("g", 3, 24), "+/=", "kR5")), 1),
        10: (plain, word, 0), 11: (pick("commit ", "sha1: ", "md5=", "checksum: ", "digest "), F.col("h"), 0), 12: (pick("https://", "http://www.", "see "), F.concat(F.substring(word, 1, 9), F.lit(".example.com/"), F.substring(word, 3, 12), F.lit("/"), F.substring("h", 1, 3)), 0),
        13: (plain, F.substring(digits, 1, 16), 0), 14: (plain, F.concat(F.substring(word, 1, 8), F.lit("."), F.substring(digits, 1, 2)), 0), 15: (key, pick("your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "example-token-00000000", "changeme1234567890", "INSERT_YOUR_TOKEN_HERE1"), 0),
        16: (pick("@", " ", "de."), F.concat(F.lit("mail"), F.substring(digits, 1, 1), F.lit(".example.com")), 0), 17: (pick("uuid: ", "id ", ""), F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), 0),
        18: (plain, F.concat(F.initcap(F.substring(word, 1, 10)), F.initcap(F.substring(word, 3, 10)), F.substring(digits, 1, 2)), 0), 19: (plain, F.concat(pick("/usr/lib/", "./src/", "/var/", "lib/"), F.substring(word, 1, 6), F.lit("/"), F.substring(word, 4, 4), pick("_", "-", "/"), F.substring(word, 2, 8), F.when(F.col("id") % 3 == 0, F.substring(digits, 1, 1)).otherwise(""), F.lit("/"), F.substring(word, 5, 6), pick(".py", ".js", ".html", "")), 0),
    }
    cases |= {
        20: (long_key, F.when(F.col("id") / 26 % 2 < 1, F.col("h")).otherwise(F.substring("g", 1, 40)), 1), 21: (long_key, F.translate(F.substring("g", 3, 24), "+/=", "kR5"), 1),
        22: (pick("", "export ", "set ", ", ", "- "), F.concat(pick(*names, "GIT_COMMIT_CHECKSUM", "BUILD_REVISION_SHA256", "package_lock_checksum", "APPLICATION_CONFIG_PATH"), pick("", "=")), 0), 23: (other_key, F.col("h"), 0),
    }
    mark = pick("!", "#", "@", "$", "%", "&", "*", "?")
    cases |= {
        24: (pick('password = "', "passwd: ", "DB_PASSWORD=", "secret='", "smtp_password="), F.concat(F.initcap(F.substring(word, 1, 4)), mark, F.substring("g", 1, 4), F.substring(digits, 1, 2)), 1),
        25: (pick("password: ", "token = ", 'password="', "secret=", "api_key: "), pick("required", "optional.", "undefined", "${DB_PASSWORD}", "process.env.TOKEN", "********", "changeme", "<password>", "forgotten?", "os.environ", "function", "your-password"), 0),
    }
    for k, (b, c, label) in cases.items():
        made = made.when(F.col("kind") == k, F.struct(b.alias("b"), c.alias("c"), F.lit(float(label)).alias("l")))
    quoted = F.when(F.col("m.b").rlike("[\"']$"), F.substring("m.b", -1, 1)).when(F.col("kind") == 22, pick("=7f3a", ' = "', '"Qm9', ": ")).otherwise(pick(" ", ".", ",", ""))
    return n.select("id", "kind", made.alias("m")).select(F.col("m.b").alias("before"), F.col("m.c").alias("candidate"), quoted.alias("after"), F.col("m.l").alias("label"))


def train(labelled: DataFrame, rows: int = ROWS, words: Sequence[str] = WORDS) -> PipelineModel:
    """A forest from labelled findings (at most `rows`, by a hash of their content, so that it comes out the same again)."""
    some = features(labelled, words).orderBy(F.xxhash64("before", "candidate", "after")).limit(rows).select(*FEATURES, "label").coalesce(1)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="f")
    forest = RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)
    return PipelineModel([assembler, forest.fit(assembler.transform(some))])


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, words: Sequence[str] = WORDS) -> DataFrame:
    """Findings that the forest keeps: doc_id, start, candidate, score."""
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), words=words)
    scored = model.transform(features(findings_of(docs), words)).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select("doc_id", "start", "candidate", F.round("score", 6).alias("score"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per finding: doc_id, start, n_chars, sha256 of the secret (never itself), score."""
    return scan(docs).select("doc_id", "start", F.length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate"), 256).alias("sha256"), "score")
