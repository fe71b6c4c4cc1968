"""Secret scans: candidate strings of texts, and a random forest that removes false positives.

Method: candidates are runs of key characters of at least MIN_LENGTH with a digit, runs behind a
known key prefix, whatever of SHORTEST or more characters is assigned to a name with a key word (with
or without a digit or sign), and passwords inside connection strings. Each is
described by its length, its character transitions (between letters, digits, cases and signs, and
between vowels and consonants), its dictionary coverage (share of letters in words that several
documents of the corpus hold), the path it was found under and the words next to it. A random
forest trained on labelled findings scores it; from THRESHOLD on it is a secret.

Labelled findings are an argument. The default ones are made by a rule from public key formats and
from the look-alikes that scanners usually report (commit hashes, checksums, identifiers, card and
telephone numbers, addresses, file names, placeholders): LABELLED rows, a fixed bound.

All of it is DataFrame expressions and JVM model code. Candidates are few and narrow; corpus word
counts are summed on the map side before they meet the candidates' letter runs in an equi join.

Cases: null, empty and candidate-free texts have no finding; a candidate met several times in a
text is a finding each time; repeated rows are reported as often as they occur; a null path is an
empty one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import packed_rows
from holdfast.session import stage

MIN_LENGTH = 12
CORE = rf"[A-Za-z0-9][A-Za-z0-9+/_=~.\-]{{{MIN_LENGTH - 2},}}[A-Za-z0-9=]"
SHORTEST = 8
SPACES = r"[\x20\x09-\x0D]+"
THRESHOLD = 0.5
LABELLED = 9000
TREES, DEPTH, SEED = 30, 7, 17
DICTIONARY_DOCS = 3  # documents that make a word a dictionary word
REDACTED = "[SECRET]"

# Words that stand before secrets, and before what only looks like one.
KEY_WORDS = ("token|secret|passw|passphrase|pwd|api.?key|apikey|auth|bearer|credential|private|"
             "access.?key|client.?key|signing.?key|webhook")
DECOY_WORDS = ("commit|sha.?1|sha.?256|md5|checksum|digest|hash|uuid|guid|etag|revision|version|"
               "isbn|order|invoice|card|phone|tel|fax|call|build|image|url|href|http")
PLACEHOLDERS = r"(?i)x{4,}|\*{3,}|0{6,}|1234567|abcdef|changeme|example|sample|dummy|your|placeholder|insert"
PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ"
PASS_WORDS = "passw|passphrase|pwd"
PATH_DECOYS = "(?i)test|example|sample|fixture|mock|demo|docs?/"
COMMON_WORDS = ("the and for with from that this page file image index home user users name data "
                "chapter section article release build version report summary example sample "
                "default public static assets content download archive letter number street "
                "change here key your test value html json mail server host local").split()

# A name with a key word and what assigns to it; the value that ends a piece of text; a key by its
# prefix; the password of a connection string.
NAMED = rf"(?:{KEY_WORDS})[\w.\-]*[\"'\]]?\s*(?::=|=>|=|:)\s*(?:(?:bearer|basic)\s+)?"
ASSIGNED = rf"(?i){NAMED}[\"'`]?([^\s\"'`,;<>]{{{SHORTEST},}})[\"'`]?[,;.)]*$"
PREFIXED = rf"(?<![A-Za-z0-9])((?:{PREFIX})[A-Za-z0-9_\-]{{{SHORTEST},}})"
CONNECTION = r"(?i)[a-z][a-z0-9+.\-]*://[^\s:/@]+:([^\s:/@]{4,})@"

FEATURES = ("length", "digits", "uppers", "lowers", "signs", "switches", "vowel_turns", "distinct",
            "hexadecimal", "all_digits", "dots", "coverage", "prefix", "placeholder", "key_word",
            "decoy_word", "assigned", "quoted", "path_decoy", "path_depth", "named", "pass_word",
            "code", "login", "parts")


# --------------------------------------------------------------------------- candidates
def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path_col: str = "source") -> DataFrame:
    """doc_id, path, word_index, finding, before, word, behind: one row per candidate."""
    path = docs[path_col].cast("string") if path_col in docs.columns else F.lit("")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       F.coalesce(path, F.lit("")).alias("path"))
    long_run = rf"[A-Za-z0-9+/_=~.\-]{{{MIN_LENGTH},}}"
    digit, text = "[0-9]", F.col("text")
    kinds = {"runs": text.rlike(digit) & text.rlike(long_run),
             "names": text.rlike(f"(?i){NAMED}"), "prefixes": text.rlike(PREFIXED),
             "logins": text.contains("://") & text.rlike(CONNECTION)}
    split = rows.select("doc_id", "path", "text", *[v.alias(k) for k, v in kinds.items()]).where(
        F.col("runs") | F.col("names") | F.col("prefixes") | F.col("logins")).withColumn(
        "words", F.split("text", SPACES))
    none = F.array().cast("array<string>")

    def findings(i: Column) -> Column:
        """What a word holds, each kind looked for only in texts that hold it somewhere."""
        word = F.get("words", i)
        lead = F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1), word)
        every = lambda x, p: F.regexp_extract_all(x, F.lit(p), 1)
        run = F.when(F.col("runs") & (F.length(word) >= MIN_LENGTH) & word.rlike(digit),
                     F.filter(every(word, f"({CORE})"), lambda x: x.rlike(digit)))
        return F.array_distinct(F.concat(F.coalesce(run, none), *[
            F.coalesce(F.when(F.col(kind) & (F.length(word) >= least), every(x, p)), none)
            for kind, least, x, p in (("names", SHORTEST, lead, ASSIGNED),
                                      ("prefixes", MIN_LENGTH, word, PREFIXED),
                                      ("logins", MIN_LENGTH, word, CONNECTION))]))

    def beside(i: Column) -> Column:
        near = F.concat_ws(" ", F.get("words", i - 3), F.get("words", i - 2),
                           F.get("words", i - 1))
        return F.struct(i.cast("long").alias("word_index"), near.alias("before"),
                        F.get("words", i).alias("word"),
                        F.coalesce(F.get("words", i + 1), F.lit("")).alias("behind"),
                        findings(i).alias("findings"))

    long_enough = F.filter(F.sequence(F.lit(0), F.size("words") - 1),
                           lambda i: F.length(F.get("words", i)) >= SHORTEST)
    places = F.filter(F.transform(long_enough, beside), lambda x: F.size(x["findings"]) > 0)
    return split.select("doc_id", "path", F.explode(places).alias("x")).select(
        "doc_id", "path", "x.word_index", "x.before", "x.word", "x.behind",
        F.explode("x.findings").alias("finding"))


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """Findings with a label (1 secret, 0 not), made by a rule from the row number."""
    at = F.col("id")
    text = at.cast("string")
    sha, md = F.sha1(text), F.md5(text)
    wide = F.translate(F.base64(F.unhex(F.sha2(text, 256))), "\n", "")
    digits = F.lpad(F.abs(F.xxhash64(text)).cast("string"), 19, "7")
    stem = F.element_at(F.array(*[F.lit(w) for w in COMMON_WORDS]),
                        (at % len(COMMON_WORDS) + 1).cast("int"))

    def one_of(*words: str, salt: int = 0) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]),
                            (F.pmod(F.hash(text, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    name = one_of("token", "secret", "password", "api_key", "auth_token", "access_key",
                  "client_secret", "private_key")
    pass_name = one_of("password", "PASSWORD", "db_password", "passwd", "pwd", "passphrase",
                       "smtp_pwd", salt=1)
    plain = one_of(*COMMON_WORDS[20:40], salt=2)
    other = one_of(*COMMON_WORDS[30:], salt=3)
    letters = F.translate(wide, "0123456789+/=", "QWxzKvbnmJhgf")
    odd = F.concat(F.substring(wide, 3, 4), one_of("!", "&", "#", "$", "@", "%", salt=4),
                   F.substring(digits, 1, 2), F.substring(letters, 9, 3))
    spoken = F.concat(plain, F.substring(digits, 3, 1), F.substring(letters, 5, 1),
                      one_of("!", "?", "#", "*", salt=5))
    phrase = F.concat(plain, F.initcap(other), F.initcap(stem))
    title = F.initcap(F.concat(stem, other))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    long_hex = F.substring(F.sha2(text, 256), 1, 56)
    made = [  # (label, words before, word, finding)
        (1, F.concat(name, F.lit(" =")), quoted(long_hex), long_hex),
        (1, F.concat(F.upper(name), F.lit(" =")), quoted(F.upper(md)), F.upper(md)),
        (1, F.concat(name, F.lit(" =")), quoted(F.substring(letters, 1, 20)),
         F.substring(letters, 1, 20)),
        (1, stem, F.concat(pass_name, F.lit("="), quoted(odd)), odd),
        (1, F.concat(pass_name, F.lit(" =")), quoted(spoken), spoken),
        (1, F.concat(pass_name, F.lit(":")), phrase, phrase),
        (1, stem, *[F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 2, 16)))] * 2),
        (1, F.concat(name, F.lit(" =")), quoted(F.concat(F.lit("ghp_"), F.substring(
            letters, 1, 34))), F.concat(F.lit("ghp_"), F.substring(letters, 1, 34))),
        (1, F.lit("url"), F.concat(F.lit("postgres://"), stem, F.lit(":"), odd, F.lit("@db/"),
                                   stem), odd),
        (0, F.concat(one_of("author", "authority", "secretary", "private", "tokenizer", salt=6),
                     F.lit(":")), title, title),
        (0, F.concat(pass_name, F.lit(":")), *[one_of(
            "required", "optional", "forgotten", "incorrect", "protected", "necessary",
            salt=7)] * 2),
        (0, F.concat(name, F.lit(" =")), *[F.concat(F.lit("get"), F.initcap(stem), F.lit("("),
                                                    other, F.lit(")"))] * 2),
        (0, F.concat(name, F.lit(" =")), *[F.concat(F.lit("os.environ["), F.upper(name),
                                                    F.lit("]"))] * 2),
        (0, F.concat(name, F.lit(" =")), quoted(F.concat(F.lit("${"), F.upper(name), F.lit("}"))),
         F.concat(F.lit("${"), F.upper(name), F.lit("}"))),
        (0, F.concat(pass_name, F.lit(" =")), quoted(F.concat(F.lit("<"), pass_name, F.lit(">"))),
         F.concat(F.lit("<"), pass_name, F.lit(">"))),
        (1, F.concat(stem, F.lit(" "), name, F.lit(":")), md, md),
        (1, stem, F.concat(name, F.lit("="), quoted(wide)), wide),
        (1, F.concat(name, F.lit(" :=")), F.substring(wide, 1, 20), F.substring(wide, 1, 20)),
        (1, stem, *[F.concat(F.lit("AKIA"), F.upper(F.substring(md, 1, 16)))] * 2),
        (1, F.lit("Authorization: Bearer"), *[F.concat(F.lit("ghp_"), F.substring(sha, 1, 36))] * 2),
        (1, F.concat(name, F.lit(" =")), quoted(F.substring(sha, 1, 24)), F.substring(sha, 1, 24)),
        (0, F.concat(stem, F.lit(" commit")), sha, sha),
        (0, F.lit("sha256 checksum:"), F.sha2(text, 256), F.sha2(text, 256)),
        (0, stem, *[F.concat_ws("-", F.substring(md, 1, 8), F.substring(md, 9, 4),
                                F.substring(md, 13, 4), F.substring(md, 17, 4),
                                F.substring(md, 21, 12))] * 2),
        (0, stem, *[F.substring(digits, 1, 16)] * 2),
        (0, F.concat(stem, F.lit(" phone")), *[F.concat_ws("-", F.substring(digits, 1, 3),
                                                          F.substring(digits, 4, 3),
                                                          F.substring(digits, 7, 4))] * 2),
        (0, stem, *[F.concat_ws(".", *[(F.pmod(F.hash(text, F.lit(k)), F.lit(156)) + 100)
                                       .cast("string") for k in range(4)])] * 2),
        (0, F.lit("see"), F.concat(F.lit("https://"), stem, F.substring(digits, 1, 3),
                                   F.lit(".example.org/"), stem),
         F.concat(stem, F.substring(digits, 1, 3), F.lit(".example.org/"), stem)),
        (0, stem, *[F.concat(stem, F.lit("_"), F.reverse(stem), F.substring(digits, 1, 2),
                             F.lit(".html"))] * 2),
        (0, F.concat(name, F.lit(" =")), quoted(F.concat(F.lit("your_"), name, F.lit("_here1"))),
         F.concat(F.lit("your_"), name, F.lit("_here1"))),
        (0, F.concat(name, F.lit(" =")), quoted(F.concat(F.lit("xxxxxxxxxxxx"), F.substring(
            digits, 1, 4))), F.concat(F.lit("xxxxxxxxxxxx"), F.substring(digits, 1, 4))),
        (0, stem, *[F.concat(stem, stem, stem, F.substring(digits, 1, 3))] * 2),
        (0, stem, *[F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-01-02T03.04.05"))] * 2)]
    kinds = [F.struct(F.lit(float(label)).alias("label"), before.alias("before"),
                      word.alias("word"), finding.alias("finding"))
             for label, before, word, finding in made]
    row = F.element_at(F.array(*kinds), (at % len(kinds) + 1).cast("int"))
    path = F.when(at % 11 == 0, "tests/fixtures/sample.py").otherwise(
        F.concat(F.lit("src"), (at % 20).cast("string")))
    return spark.range(0, n, 1, 2).select(
        row.alias("x"), path.alias("path"), stem.alias("behind")).select("x.*", "path", "behind")


# ----------------------------------------------------------------------------- features
def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY_DOCS) -> DataFrame:
    """Words of 3 to 12 ASCII letters that at least `least` documents hold, over whole texts."""
    words = F.array_distinct(F.filter(F.split(F.lower(docs[text_col].cast("string")), "[^a-z]+"),
                                      lambda w: F.length(w).between(3, 12)))
    return docs.select(F.explode(words).alias("part")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("part")


def _parts(finding: Column) -> Column:
    """Letter runs of a finding in lower case, cut where a capital starts."""
    return F.filter(F.split(F.lower(F.regexp_replace(finding, "([a-z])([A-Z])", "$1 $2")),
                            "[^a-z]+"), lambda p: F.length(p) >= 3)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add the FEATURES to candidates. words: part, the dictionary."""
    spark = found.sparkSession
    own = spark.createDataFrame([(w,) for w in COMMON_WORDS if len(w) >= 3], "part string")
    parts = found.select(F.explode(_parts(F.col("finding"))).alias("part"), "finding")
    known = parts.join(words.unionByName(own).distinct(), "part", "left_semi").distinct()
    covered = known.groupBy("finding").agg(F.collect_set("part").alias("known"))
    x, size = F.col("finding"), F.length("finding")
    count = lambda pattern: F.regexp_count(x, F.lit(pattern)) / size
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    held = F.filter(_parts(x), lambda p: F.array_contains(F.coalesce(
        "known", F.array().cast("array<string>")), p))
    letters = F.aggregate(held, F.lit(0), lambda a, p: a + F.length(p))
    # what stands before the finding, in its own word and in the words before
    lead = F.concat(F.col("before"), F.lit(" "), F.expr("substring_index(word, finding, 1)"))
    made = {
        "length": size.cast("double"), "digits": count("[0-9]"), "uppers": count("[A-Z]"),
        "lowers": count("[a-z]"), "signs": count("[^A-Za-z0-9]"),
        "switches": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_turns": count("(?i)[aeiou](?=[bcdfghj-np-tv-z])|[bcdfghj-np-tv-z](?=[aeiou])"),
        "distinct": F.size(F.array_distinct(F.split(x, ""))) / size,
        "hexadecimal": flag(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "all_digits": flag(x.rlike(r"^[0-9.\-]+$")), "dots": count(r"\."),
        "coverage": letters / size, "prefix": flag(x.rlike(f"^(?:{PREFIX})")),
        "placeholder": flag(x.rlike(PLACEHOLDERS)),
        "key_word": flag(lead.rlike(f"(?i)(?:{KEY_WORDS})")),
        "decoy_word": flag(lead.rlike(f"(?i)(?:{DECOY_WORDS})")),
        "assigned": flag(lead.rlike(r"(?:=|:)\s*[\"']?$")),
        "quoted": flag(lead.rlike("[\"']$")),
        "path_decoy": flag(F.col("path").rlike(PATH_DECOYS)),
        "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
        "named": flag(lead.rlike(rf"(?i){NAMED}[\"'`]?$")),
        "pass_word": flag(lead.rlike(f"(?i)(?:{PASS_WORDS})")),
        "code": flag(x.rlike(r"[(){}\[\]<>]")),
        "login": flag(lead.rlike(r"://[^\s:/@]+:$")), "parts": F.size(_parts(x))}
    joined = found.join(covered, "finding", "left")
    return joined.withColumns({c: v.cast("double") for c, v in made.items()}).drop("known")


# -------------------------------------------------------------------------------- model
def fit_forest(findings: DataFrame) -> PipelineModel:
    """A forest on findings with FEATURES and a label."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    featureSubsetStrategy="sqrt", labelCol="label",
                                    featuresCol="features")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
                            forest]).fit(findings)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, word_index, finding, score, is_secret: one row per candidate.

    findings: labelled ones with path, before, word, behind, finding and label (1.0 or 0.0).
    """
    spark = docs.sparkSession
    found = stage(candidates(docs, id_col, text_col, path_col), "candidates")
    teachers = labelled_findings(spark) if findings is None else findings
    asked = found.select("finding").unionByName(teachers.select("finding")).distinct()
    parts = asked.select(F.explode(_parts(F.col("finding"))).alias("part")).distinct()
    words = stage(dictionary(docs, text_col).join(parts, "part", "left_semi"), "dictionary")
    learned = stage(described(teachers, words).select(*FEATURES, "label").coalesce(2)
                    .sortWithinPartitions("label", *FEATURES), "labelled")
    model = fit_forest(learned)
    judged = model.transform(described(found, words)).withColumn(
        "score", vector_to_array("probability")[1])
    return judged.select("doc_id", "word_index", "finding", "score",
                         (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD,
           id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All rows and columns, with every secret in the text replaced by REDACTED."""
    secrets = scan(docs, findings, threshold, id_col, text_col, path_col).where("is_secret")
    by_doc = secrets.groupBy(F.col("doc_id").alias("doc")).agg(
        F.collect_set("finding").alias("found"))
    longest_first = F.array_sort("found", lambda a, b: F.length(b) - F.length(a))
    text = F.aggregate(longest_first, F.col("row")[text_col], lambda t, s: F.replace(
        t, s, F.lit(REDACTED)))
    joined = packed_rows(docs, id_col).join(by_doc, F.col("key").eqNullSafe(F.col("doc")), "left")
    return joined.select(F.when(F.col("found").isNull(), F.col("row")).otherwise(
        F.col("row").withField(text_col, text)).alias("row")).select("row.*")
