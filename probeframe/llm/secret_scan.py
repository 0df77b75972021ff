"""Secret scan with a random forest against false positives (operator 9); DataFrame and Spark ML functions only.

Candidates are long tokens of key characters, and whatever is assigned to the
name of a secret.  A forest over the candidate's length, character transitions,
dictionary coverage, path and neighbouring words tells secrets from the rest; it
learns from labelled findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.llm._shared import materialize

#: A candidate: 16 key characters or more, with a digit among them ...
CANDIDATE = r"[A-Za-z0-9_+/=.-]{16,}"
#: ... or what is assigned to the name of a secret, of any length and characters.
NAMES = ["token", "secret", "password", "passwd", "pwd", "passphrase", "passcode", "apikey", "api_key", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "credential"]
NAME = rf"(?:{'|'.join(NAMES)})s?[0-9]{{0,3}}(?:[_-][A-Za-z0-9_-]{{0,40}}+)?[\"']?"
SIGN = r"(?:=>|:=|={1,3}|:)"
#: Labelled findings that the forest learns from, at most; trees and their depth.
FINDINGS, TREES, DEPTH = 6000, 30, 8
#: Words that stand by a secret, and short common word parts for dictionary coverage.
NEIGHBOURS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access"]
PARTS = [
    "the", "and", "ing", "ion", "ent", "her", "for", "tha", "nth", "int", "ere", "tio", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth",
    "hes", "ver", "his", "oft", "ith", "fth", "sth", "oth", "res", "ont", "der", "die", "und", "sch", "ich", "ein", "den", "ung", "cht", "gen",
    "que", "les", "des", "ment", "eau", "elle", "los", "las", "ado", "con", "per", "user", "file", "name", "data", "test", "list", "type", "code", "page",
    "http", "www", "com", "org", "net", "src", "lib", "bin", "usr", "home", "doc", "img", "html", "json", "mail", "date", "time", "version", "example", "index",
]
FEATURES = ["length", "digits", "uppers", "transitions", "hex", "coverage", "vowels", "special", "pathlike", "before", "after", "assigned", "named"]


def assigned_tail(word: Column, first: Column, second: Column) -> Column:
    """What of ``word`` is assigned to the name of a secret, within it (``token=x``) or by the words before (``token: x``, ``token = x``); else null."""
    inside = rf"(?is){NAME}{SIGN}([^=].*)$"
    behind = first.rlike(rf"(?i){NAME}{SIGN}$") | (first.rlike(f"^{SIGN}$") & second.rlike(f"(?i){NAME}$"))
    return F.when(word.rlike(inside), F.regexp_extract(word, inside, 1)).when(behind & ~word.rlike(f"^{SIGN}$"), word)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, nth, finding, previous, following``: every candidate of every text, with the words around it.

    A value that is assigned to the name of a secret (:data:`NAMES`) is one
    candidate: up to its closing quote, or, unquoted, to a quote, ``&``, ``;`` or
    ``,``, without closing brackets and points; it ends with its word in any case.
    In the rest, runs of :data:`CANDIDATE` with a digit are candidates.

    Texts without a candidate are passed over before they are split into words.
    Null and empty texts have none; a candidate that repeats is found each time;
    a word may hold several.
    """
    may = F.col("text").rlike(CANDIDATE) | F.col("text").rlike(rf"(?i){NAME}\s*+{SIGN}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(may)
    words = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"))
    # only the places of words that can hold a candidate are unfolded, with their neighbours
    near = lambda i, d: F.coalesce(F.try_element_at("words", F.when(i + d > 0, i + d).otherwise(-(1 << 30))), F.lit(""))
    holds = lambda w: w.rlike(CANDIDATE) & w.rlike("[0-9]")
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: holds(near(i, 0)) | assigned_tail(near(i, 0), near(i, -1), near(i, -2)).isNotNull())
    places = words.filter(F.size("words") > 0).select(
        "doc_id", "mark",
        F.explode(F.transform(at, lambda i: F.struct(i.alias("place"), near(i, 0).alias("word"), near(i, -2).alias("second"), near(i, -1).alias("first"), near(i, 1).alias("next")))).alias("p"),
    ).select("doc_id", "mark", "p.*")
    # the assigned value, what stands before and after it in its word
    parted = places.withColumn("tail", assigned_tail(F.col("word"), F.col("first"), F.col("second")))
    quoted = F.col("tail").rlike("^[\"'`]")
    value = F.when(quoted, F.regexp_extract("tail", "(?s)^([\"'`])((?!\\1).+?)(?:\\1|$)", 2)).otherwise(F.rtrim(F.regexp_extract("tail", "^([^\"'`&;,]+)", 1), F.lit(".)]}>")))
    parted = parted.withColumn("value", F.coalesce(value, F.lit("")))
    parted = parted.withColumn("lead", F.when(F.col("value") != "", F.expr("left(word, length(word) - length(tail))")).otherwise(F.col("word")))
    parted = parted.withColumn("lead", F.when((F.col("value") != "") & quoted, F.concat("lead", F.expr("left(tail, 1)"))).otherwise(F.col("lead")))
    rest = F.expr("substr(word, length(lead) + length(value) + 1)")
    runs = lambda c: F.transform(
        F.filter(F.regexp_extract_all(c, F.lit(f"({CANDIDATE})"), F.lit(1)), lambda r: r.rlike("[0-9]")),
        lambda r: F.struct(r.alias("finding"), F.call_function("substring_index", F.col("word"), r, F.lit(1)).alias("before")),
    )
    own = F.filter(F.array(F.struct(F.col("value").alias("finding"), F.col("lead").alias("before"))), lambda v: v["finding"] != "")
    found = parted.select("*", F.posexplode(F.concat(runs(F.col("lead")), own, runs(rest))).alias("inner", "f"))
    return found.select(
        "doc_id", "mark", (F.shiftleft(F.col("place").cast("long"), 31) + F.col("inner")).alias("nth"), F.col("f.finding").alias("finding"),
        F.concat_ws(" ", "second", "first", "f.before").alias("previous"), F.col("next").alias("following"),
    )


def with_features(found: DataFrame) -> DataFrame:
    """The findings with the forest's inputs; all are shares of the length but for ``length`` and the flags."""
    t, n = F.col("finding"), F.length("finding").cast("double")
    share = lambda c: c.cast("double") / n
    # places where the kind of character changes: letter to digit, lower to upper case ...
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "_+/=.-", "......")
    transitions = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "A+", "A"), "0+", "0"))
    rest = F.length(F.regexp_replace(F.lower(t), "|".join(sorted(PARTS, key=lambda p: (-len(p), p))), ""))
    beside = "|".join(NEIGHBOURS)
    return found.select(
        "*", n.alias("length"), share(F.regexp_count(t, F.lit("[0-9]"))).alias("digits"), share(F.regexp_count(t, F.lit("[A-Z]"))).alias("uppers"),
        share(transitions).alias("transitions"), share(F.regexp_count(t, F.lit("[0-9a-fA-F]"))).alias("hex"), (1 - share(rest)).alias("coverage"),
        share(F.regexp_count(t, F.lit("[aeiouAEIOU]"))).alias("vowels"),
        share(F.regexp_count(t, F.lit("[^A-Za-z0-9_+/=.-]"))).alias("special"),
        (t.rlike(r"/.*/|^/|[.](?:html?|py|js|json|txt|md|csv|png|jpg|com|org|net)\b") | F.col("previous").rlike(r"(?:https?:|www[.])\S*$|\\$|@$")).cast("double").alias("pathlike"),
        F.lower("previous").rlike(f"(?:{beside})").cast("double").alias("before"), F.lower("following").rlike(f"(?:{beside})").cast("double").alias("after"),
        F.col("previous").rlike("[=:]\\s*[\"']?$|(?i)bearer\\s*$").cast("double").alias("assigned"),
        F.col("previous").rlike(rf"(?i){NAME}\s*+{SIGN}\s*[\"'`]?$").cast("double").alias("named"),
    )


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``finding, previous, following, label``: made findings, the same at every call.

    Half are secrets (hexadecimal and base-64 strings, prefixed keys) as code and
    prose write them, with and without an assignment, and short or digitless
    passwords assigned to a secret's name; half are not: identifiers, paths,
    addresses, versions, dates, numbers, checksums that are named as such,
    run-together words, and words, placeholders, calls and counts that stand after
    a secret's name.  Put findings labelled by hand in their place where there
    are any.
    """
    i = F.col("id")
    draw = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m))
    hexes = F.sha2(F.concat(F.lit("h"), i.cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(hexes)), "=+$", "")
    word = lambda k: F.element_at(F.array(*[F.lit(p) for p in PARTS]), (draw(k, len(PARTS)) + 1).cast("int"))
    pick = lambda k, values: F.element_at(F.array(*values), (draw(k, len(values)) + 1).cast("int"))
    lit = F.lit
    # a secret's name with its sign, and what else may stand there
    name = pick(30, [lit(w) for w in NAMES])
    named = pick(31, [F.concat(name, lit(" =")), F.concat(name, lit(' = "')), F.concat(word(21), lit("_"), name, lit("=")), F.concat(name, lit(":")), F.concat(lit('"'), name, lit('": "')), F.concat(F.upper(name), lit("="))])
    syllable = lambda k: pick(k, [lit(p) for p in ["ba", "ne", "ro", "ti", "lu", "mas", "ken", "dor", "a", "vi", "sto", "pe"]])
    spoken = F.substring(F.concat(*[syllable(k) for k in range(32, 38)]), 1, (draw(38, 10) + 3).cast("int"))
    mark = pick(39, [lit(c) for c in "!@#$%*?&"])
    letters = F.translate(hexes, "0123456789", "ghjkmnqrvz")
    password = pick(
        40,
        [
            F.concat(F.initcap(spoken), draw(41, 1000).cast("string"), mark), F.concat(spoken, draw(41, 100).cast("string"), word(42), mark), F.concat(F.translate(F.concat(word(42), spoken), "aeio", "4310"), mark, mark),
            F.substring(b64, 1, (draw(43, 12) + 8).cast("int")), F.substring(letters, 1, (draw(43, 20) + 16).cast("int")), F.concat(F.substring(b64, 1, 5), mark, F.substring(b64, 11, (draw(43, 8) + 2).cast("int"))),
        ],
    )
    # fixed values: what code and forms write in the place of a secret
    instead = ["None", "null", "true", "false", "required", "string", "undefined", "your_password_here", "<password>", "<your-token>", "${PASSWORD}", "{{secret}}", "********", "xxxxxxxx", "...", "os.environ[", "get_token()", "process.env.API_TOKEN", "self.password", "config.secret", "input()", "n/a", "optional"]
    no_password = pick(44, [spoken, F.initcap(spoken), spoken, F.concat(word(45), word(46)), F.concat_ws("", word(45), word(46), word(47), spoken), draw(48, 5000).cast("string"), pick(49, [lit(w) for w in instead]), F.concat_ws("_", word(45), word(46))])
    secret = pick(1, [F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), hexes, F.substring(b64, 1, 40), F.concat(lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), F.concat(lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), F.concat(lit("sk-"), F.substring(F.regexp_replace(b64, "[+/]", "Z"), 1, 40))])
    key = pick(2, [lit(w) for w in NEIGHBOURS])
    written = pick(3, [F.concat(word(21), lit(" "), key, lit(' = "')), F.concat(key, lit(":")), F.concat(word(22), lit(" "), F.upper(key), lit("=")), F.concat(key, lit(" is")), F.concat(lit("Authorization: Bearer"))])
    plain = pick(
        4,
        [
            F.concat_ws("", word(5), word(6), word(7), word(8), word(9), draw(10, 100).cast("string")),
            F.concat_ws("/", lit("/usr"), word(5), word(6), word(7), F.concat(word(8), draw(10, 10).cast("string"), lit(".html"))),
            F.concat(draw(10, 99).cast("string"), lit("mail"), draw(11, 9).cast("string"), lit(".example.com")),
            F.concat_ws("-", lit("2021"), F.lpad(draw(5, 12).cast("string"), 2, "0"), F.lpad(draw(6, 28).cast("string"), 2, "0"), lit("10.30.00")),
            F.concat(draw(5, 10**9).cast("string"), draw(6, 10**9).cast("string")),
            F.concat_ws("_", word(5), word(6), word(7), word(8), draw(10, 10).cast("string")),
            F.concat_ws(".", lit("v1"), draw(5, 30).cast("string"), draw(6, 100).cast("string"), lit("build"), draw(7, 10**6).cast("string")),
            F.substring(hexes, 1, 40),
        ],
    )
    said = F.when(draw(4, 8) == 7, pick(12, [lit("commit"), lit("sha256:"), lit("checksum"), lit("git rev"), lit("digest =")])).otherwise(pick(13, [word(14), F.concat(word(14), lit(" "), word(15)), lit("see"), lit("https://www."), lit("id ="), lit("")]))
    is_secret, after_name = F.pmod(i, lit(2)) == 0, draw(50, 5) < 2
    rows = spark.range(n).select(
        F.when(after_name, F.when(is_secret, password).otherwise(no_password)).when(is_secret, secret).otherwise(plain).alias("finding"),
        F.when(after_name, named).when(is_secret, written).otherwise(said).alias("previous"),
        word(16).alias("following"), is_secret.cast("double").alias("label"), after_name.alias("after_name"),
    )
    return rows.filter(F.col("after_name") | (F.length("finding") >= 16)).drop("after_name")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> PipelineModel:
    """A forest over ``labelled(finding, previous, following, label)``, a bounded table."""
    rows = materialize(with_features(labelled), "labelled")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="inputs"), RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def scan(docs: DataFrame, model: PipelineModel, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, nth, finding, previous, following, score, is_secret`` of every candidate; findings under ``least`` are the false positives.

    Null, empty and candidate-free texts give no rows, nor does an empty table;
    texts of any length are searched whole; repeated rows and candidates give a
    row each time, told apart within a text by ``nth`` (the word's place and the
    candidate's in the word); other columns are not read.
    """
    scored = model.transform(with_features(candidates(docs, doc_id, text)))
    score: Column = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "nth", "finding", "previous", "following", score.alias("score"), (score >= least).alias("is_secret"))
