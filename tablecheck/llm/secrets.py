"""Secret scan: patterns find candidates, a random forest removes the false positives.

Only DataFrame and SQL functions and Spark's own forest are used.

1. A screen (one regular expression over the whole text) keeps the texts that hold
   any candidate; only those are cut into words.
2. Candidates are private-key blocks (without an END line: the lines of key characters
   that follow), long runs of key characters with a digit, passwords in URLs, and
   values assigned to a name like ``token`` or ``password``.
3. Features: length, character transitions (runs of lower case, upper case and digits
   per character, shares of digits and upper case, distinct characters), dictionary
   coverage (share of the candidate's trigrams that are letters found in at least
   ``DICTIONARY_WORDS`` words of a public vocabulary file, the same for every corpus; a
   table of 26^3 bytes), path marks, and the two words before.
4. A random forest trained on labelled findings gives each candidate its score.

The labelled findings are a bounded table (``LABELLED`` rows, a parameter): values of
the usual kinds from hash functions, and words, set in contexts whose label is known,
such as an assignment to a token name (a secret), a commit, a checksum, an id, a path,
a card number or a placeholder (no secret).

Every run and every assigned value of a word is a candidate of its own, with the text
of the word before it as its context; ``word`` then is its part of the word.

Defined cases: null and empty texts have no findings; equal candidates at several
places are separate findings; a finding is masked in its own word or block only; rows that repeat an id are scanned one by one; an empty
table gives an empty result; other columns are kept by :func:`redact_secrets`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import text_rows, written

# The characters of keys, and the names that secrets and harmless digests are given.
KEY = r"[A-Za-z0-9+/_-]"
SECRET_NAME = r"(?i)(?:token|secret|passw|pwd|api_?-?key|access_?-?key|private_?-?key|credential|auth|bearer)"
# A word with such a name that ends with "=" or ":", or has one of them as the next word; then a word of 8 characters.
# Tried at word starts only, so that a long word with many names is read once.
NAMED = (rf"(?<!\S)(?=\S*?{SECRET_NAME})\S*+(?:(?<=[=:][\x85\u2028\u2029]{{0,1}})|\s+[=:])\s+\S{{8}}")
# A whole name of a secret just before its value.
NAME_ENDS = (r"(?i)(?:^|[^a-z])(?:token|secret|passphrase|password|passwd|pwd|api_?-?key|access_?-?key|private_?-?key"
             r"|credential)(?:[_-][a-z0-9]+)?[\"'\])]*\s*[=:]\s*[\"']?$")
HARMLESS_NAME = r"(?i)(commit|sha\d*\b|md5|digest|checksum|hash|uuid|guid|\bid\b|revision|etag|version|example|sample|isbn|card|phone)"
PLACEHOLDER = r"(?i)(example|xxxx|0000000|1234567|changeme|your|dummy|placeholder|redacted|<|\$\{)"
# A block's body holds few dashes (header lines) and none five in a row, so that a scan never passes another block.
BLOCK = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]*+-(?!----)){0,16}+[^-]*+-----END [A-Z ]*PRIVATE KEY-----"
         r"|\s*+(?:[A-Za-z0-9+/=\r\n]*[\r\n])?(?:[A-Za-z0-9+/=]{16,}+)?)")
# A password of at least 8 characters between the user and the host of a URL.
URL_PASSWORD = r"://[^\s/:@]*+:([^\s/@]{8,}+)@"
LONG_RUN = rf"(?<!{KEY})(?=[A-Za-z+/_-]*+[0-9])({KEY}{{16,}}={{0,2}})"
ASSIGNED = SECRET_NAME + r"[\w.\])\"'-]*+\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,})"
# Where the next of several assignments in a word begins.
CUT = r"[,;&](?=[\w.\])\"'-]*+[=:])"
# Holds for every text with a candidate: one part for each rule of found_in.
SCREEN = f"-----BEGIN|{LONG_RUN}|{ASSIGNED}|{NAMED}|{URL_PASSWORD}"
WHITE_SPACE = r"[\x20\x09-\x0D]+"
MASK = "[SECRET]"

FEATURES = ("length", "runs", "digits", "uppers", "distinct", "hex", "block", "coverage", "path", "secret_name",
            "assigned", "harmless_name", "placeholder", "quoted", "named", "url")
DICTIONARY_WORDS = 3
LABELLED = 6_000
THRESHOLD = 0.5


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, word_no, kind, value, word, lead, before, before2 of all candidates in (doc_id, text)."""
    return found_in(rows.filter(F.col("text").rlike(SCREEN)))


def _split(text: Column) -> tuple[Column, Column]:
    """The words of a text, a private-key block being one, and what stands after each."""
    blocks = F.regexp_extract_all(text, F.lit(f"({BLOCK})"), F.lit(1))
    gaps = F.split(text, BLOCK)

    def of_gaps(one: Callable[[Column], Column], between: Callable[[Column], Column]) -> Column:
        return F.flatten(F.zip_with(gaps, blocks, lambda g, b: F.when(b.isNull(), one(g)).otherwise(
            F.concat(one(g), F.array(between(b))))))

    return (of_gaps(lambda g: F.split(g, WHITE_SPACE), lambda b: b),
            of_gaps(lambda g: F.concat(F.regexp_extract_all(g, F.lit(f"({WHITE_SPACE})"), F.lit(1)), F.array(F.lit(""))),
                    lambda _: F.lit("")))


def found_in(rows: DataFrame) -> DataFrame:
    """:func:`candidates` of texts that are all cut into words."""
    block = lambda w: w.rlike(f"^{BLOCK}$")
    words = _split(F.col("text"))[0]
    ago = lambda i, k: F.coalesce(F.get("words", i - k), F.lit(""))
    found = (rows.withColumn("words", words)
             .select("doc_id", F.explode(F.filter(
                 F.transform("words", lambda w, i: F.struct(
                     i.alias("word_no"), w.alias("word"), ago(i, 1).alias("before"), ago(i, 2).alias("before2"))),
                 lambda x: (F.length(x["word"]) >= 8) & (
                     x["word"].rlike(f"{LONG_RUN}|{URL_PASSWORD}|^-----BEGIN .") | x["word"].rlike(ASSIGNED)
                     | _told(x["before"], x["before2"])))).alias("x"))
             .select("doc_id", "x.word_no", "x.word", "x.before", "x.before2"))
    blank = F.lit("")
    blocks = found.filter(block(F.col("word"))).select(
        "doc_id", "word_no", F.lit("block").alias("kind"), F.col("word").alias("value"), "word",
        blank.alias("lead"), blank.alias("before"), blank.alias("before2"))
    words = (found.filter(~block(F.col("word"))).withColumn("told", _told(F.col("before"), F.col("before2"))).withColumn("x", F.explode(_matches()))
             .select("doc_id", "word_no", "x.kind", "x.value", "x.word", "x.lead",
                     F.when(F.col("x.own"), "").otherwise(F.col("before")).alias("before"),
                     F.when(F.col("x.own"), "").otherwise(F.col("before2")).alias("before2")))
    return blocks.unionByName(words).filter(F.length("value") >= 8)


def _told(before: Column, before2: Column) -> Column:
    """Whether the words before hold the name of a secret."""
    return (before.isin("=", ":") & before2.rlike(SECRET_NAME)) | before.rlike(SECRET_NAME + r"\S*[=:]$")


def _match(kind: str, value: Column, lead: Column, tail: Column, own: Column) -> Column:
    """A candidate: the text of its word before it (``lead``) and after it, and whether ``lead`` has its own name."""
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.concat(lead, value, tail).alias("word"),
                    lead.alias("lead"), own.alias("own"))


def _matches() -> Column:
    """All candidates of a word, as an array in order of rule and place.

    A word is cut before each further ``,name=``, ``;name:`` and ``&name=``.  In every part all
    long runs and all assigned values count, each with the text since the last one.  Between
    two runs without a letter (dotted tokens) the context is that of the run before.
    Values that go on beyond a cut, a whole word after a name, and passwords in URLs count besides.
    """
    at = lambda array, k: F.element_at(array, k + 1)
    letter = lambda g: g.rlike("[A-Za-z]")

    def runs(part: Column, k: Column) -> Column:
        gaps = F.split(part, LONG_RUN)

        def run(value: Column, i: Column) -> Column:
            start = F.greatest(F.lit(2), i - 2)
            near = F.filter(F.slice(gaps, start, i + 2 - start), letter)
            own = F.size(near) > 0
            lead = F.when(own, F.element_at(near, F.size(near))).when(i == 0, at(gaps, i)).otherwise(
                F.right(F.element_at(gaps, 1), F.lit(128)))
            return _match("key", value, lead, at(gaps, i + 1), own | (k > 0))

        return F.transform(F.regexp_extract_all(part, F.lit(LONG_RUN), F.lit(1)), run)

    def assigned(part: Column, k: Column) -> Column:
        gaps = F.split(part, ASSIGNED)

        def one(whole: Column, i: Column) -> Column:
            value = F.regexp_extract(whole, ASSIGNED, 1)
            lead = F.concat(at(gaps, i), F.left(whole, F.length(whole) - F.length(value)))
            return _match("assigned", value, lead, at(gaps, i + 1), (i > 0) | (k > 0))

        return F.transform(F.regexp_extract_all(part, F.lit(ASSIGNED), F.lit(0)), one)

    word, stripped = F.col("word"), F.regexp_extract("word", r"^[\"'(\[]*(.*?)[\"'),;.!?|\]]*$", 1)
    not_a_run = lambda x: ~x["value"].rlike(f"^{LONG_RUN}$")
    parts = F.split(word, CUT)
    def in_url(whole: Column) -> Column:
        value = F.regexp_extract(whole, URL_PASSWORD, 1)
        return _match("url", value, F.left(whole, F.length(whole) - F.length(value) - 1), F.lit("@"), F.lit(True))

    urls = F.transform(F.regexp_extract_all(word, F.lit(URL_PASSWORD), F.lit(0)), in_url)
    of_url = F.transform(urls, lambda x: x["value"])
    told = F.filter(F.array(_match("assigned", stripped, F.regexp_extract("word", r"^[\"'(\[]*", 0), F.lit(""),
                                   F.lit(False))), lambda x: F.col("told") & not_a_run(x))
    return F.concat(
        urls,
        F.filter(F.flatten(F.transform(parts, runs)), lambda x: ~F.array_contains(of_url, x["value"])),
        F.filter(F.flatten(F.transform(parts, assigned)), not_a_run),
        F.filter(assigned(word, F.lit(0)), lambda x: x["value"].rlike(CUT)),
        told)


def trigram_marks(vocabulary: str | None = None) -> bytes:
    """One byte per letter trigram: 1 if ``DICTIONARY_WORDS`` words of the vocabulary hold it.

    ``vocabulary`` is the path of a public byte-level BPE file (default: the 50k one); the
    table has 26^3 bytes.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.json"))
    # only the words are kept of the file: parsed whole it would take several times its size on the driver
    with open(vocabulary, encoding="utf-8") as file:
        words = {w.lower() for w in re.findall(r'"Ġ*([A-Za-z]{3,})"\s*:\s*\d', file.read())}
    held = Counter(gram for w in words for gram in {w[i:i + 3] for i in range(len(w) - 2)})
    marks = bytearray(26 ** 3)
    for gram, n in held.items():
        a, b, c = (ord(x) - ord("a") for x in gram)
        marks[(a * 26 + b) * 26 + c] = n >= DICTIONARY_WORDS
    return bytes(marks)


def _marked(gram: Column, marks: bytes) -> Column:
    """Whether a trigram of letters is marked."""
    code = F.lit(1)
    for place, weight in ((1, 676), (2, 26), (3, 1)):
        code = code + (F.ascii(gram.substr(place, 1)) - ord("a")) * weight
    return F.substring(F.lit(bytearray(marks)), code, F.lit(1)) == F.lit(bytearray(b"\x01"))


def with_features(found: DataFrame, marks: bytes) -> DataFrame:
    """Add the columns of ``FEATURES``; ``marks`` is :func:`trigram_marks`."""
    value, length = F.col("value"), F.length("value")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / length
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    around = F.concat_ws(" ", "before2", "before", "lead")
    flag = lambda c: c.cast("double")
    known = found.withColumn("lowered", F.lower("value")).withColumn("grams", F.when(
        F.col("kind") != "block", F.transform(F.sequence(F.lit(1), F.greatest(length - 2, F.lit(1))),
                                              lambda i: F.col("lowered").substr(i, F.lit(3)))).otherwise(F.array()))
    letters = F.filter("grams", lambda g: g.rlike("^[a-z]{3}$"))
    return known.select(
        *found.columns,
        length.cast("double").alias("length"),
        (F.length(runs) / length).alias("runs"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("uppers"),
        (F.size(F.array_distinct(F.split(value, ""))) / length).alias("distinct"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        flag(F.col("kind") == "block").alias("block"),
        (F.size(F.filter(letters, lambda g: _marked(g, marks))) / F.greatest(F.size("grams"), F.lit(1))).alias("coverage"),
        flag(F.col("word").rlike(r"://|\\|/[^/]*/|\.[A-Za-z]{1,4}\b")).alias("path"),
        flag(around.rlike(SECRET_NAME)).alias("secret_name"),
        flag(around.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(around.rlike(HARMLESS_NAME)).alias("harmless_name"),
        flag(value.rlike(PLACEHOLDER)).alias("placeholder"),
        flag(F.col("word").rlike("[\"']")).alias("quoted"),
        flag(around.rlike(NAME_ENDS)).alias("named"),
        flag(F.col("kind") == "url").alias("url"))


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """A bounded table of findings with known labels, the same on every run."""
    n = F.col("id")
    digest = F.sha2(F.concat(F.lit("finding"), n.cast("string")), 256)
    other = F.sha2(F.concat(F.lit("second"), n.cast("string")), 256)
    pick = lambda *choices: F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64(n), F.lit(len(choices))) + 1).cast("int"))
    key64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    letters = F.translate(F.substring(digest, 1, 24), "0123456789abcdef", "etaoinshrdlucmfw")
    blank = F.lit("")
    noun = lambda: pick("correct", "summer", "window", "orange", "station", "battery", "winter", "garden", "monkey", "shadow")
    verb = pick("horse", "dragon", "silver", "travel", "bridge", "castle", "forest", "secret", "master")
    cases = [  # (kind, value, text before the value in its word, word before, word before that, label)
        ("key", F.substring(digest, 1, 40), '"', F.lit("="), pick("token", "TOKEN", "secret", "api_key", "auth_token"), 1),
        ("key", F.upper(F.substring(digest, 1, 40)), '"', F.lit("="), pick("TOKEN", "token", "SECRET"), 1),
        ("key", F.substring(digest, 1, 32), "", pick("token:", "api_key:", "secret:", "Bearer"), pick("the", "Authorization:", "use"), 1),
        ("key", key64, '"', pick("=", ":"), pick("secret_key", "access_key", "password", "credential"), 1),
        ("key", F.concat(pick("ghp_", "sk_live_", "xoxb-", "glpat-"), F.substring(key64, 1, 36)), "", pick("is", "use", "="), pick("key", "token", "it"), 1),
        ("key", F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))), "", pick("=", "is", ":"), pick("aws_access_key_id", "key", "access_key"), 1),
        ("assigned", F.concat(F.substring(letters, 1, 5), F.substring(digest, 1, 6), F.lit("!")), "", F.lit("="), pick("password", "passwd", "pwd"), 1),
        ("block", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), key64, F.lit("\n-----END RSA PRIVATE KEY-----")), "", blank, blank, 1),
        ("assigned", F.concat(noun(), verb, pick("battery", "staple", "cloud", "river", "stone", "paper", "light")), "", pick("client_secret:", "password:", "passphrase=", "db_password:", "secret:"), pick("the", "", "set"), 1),
        ("assigned", F.concat(noun(), F.lit("-"), verb, F.lit("-"), noun()), '"', pick("=", ":"), pick("password", "client_secret", "pwd"), 1),
        ("url", F.concat(F.initcap(verb), F.substring(digest, 1, 5)), "://admin:", blank, blank, 1),
        ("url", key64, "://user:", blank, blank, 1),
        ("url", pick("password", "<password>", "changeme", "${PASSWORD}", "xxxxxxxx", "your-password"), "://user:", blank, blank, 0),
        ("assigned", pick("required", "optional", "anything", "something", "whatever", "disabled", "forgotten"), "", pick("password:", "token:", "secret:"), pick("the", "", "a"), 0),
        ("key", F.substring(digest, 1, 40), "", pick("commit", "revision", "sha1", "hash"), pick("at", "in", "the", "git"), 0),
        ("key", digest, "", pick("sha256:", "checksum", "digest", "etag:"), pick("file", "the", "its"), 0),
        ("key", F.substring(digest, 1, 32), "", pick("md5", "uuid", "id", "guid"), pick("=", "the", "row"), 0),
        ("key", F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(other, 1, 12)), "", pick("id", "uuid", "session", "see"), pick("the", "row", "="), 0),
        ("key", F.concat(F.lit("/usr/lib/"), letters, F.lit("/"), F.substring(digest, 1, 8)), "", pick("in", "at", "file", "="), pick("found", "path", "see"), 0),
        ("key", F.concat(F.lit("//www/"), letters, F.lit("/page"), F.substring(digest, 1, 3)), "http:", pick("at", "see", "visit"), pick("more", "read", "and"), 0),
        ("key", F.translate(F.substring(digest, 1, 16), "abcdef", "274816"), "", pick("the", "and", "call", "card"), pick("on", "of", "number", "is"), 0),
        ("key", F.concat(letters, F.substring(F.translate(digest, "abcdef", "123456"), 1, 2)), "", pick("the", "and", "of"), pick("on", "is", "in"), 0),
        ("key", pick("EXAMPLEKEY1234567890", "xxxxxxxxxxxxxxxxxxxx1", "YOUR-API-KEY-00000000", "0000000000000000000000000000000000000000"), '"', F.lit("="), pick("token", "api_key", "secret"), 0),
        ("assigned", pick("changeme", "required", "<password>", "${PASSWORD}", "placeholder", "your-password"), "", pick("=", ":"), pick("password", "token", "secret"), 0),
        ("assigned", letters, "", F.lit(":"), pick("tokens", "secretary", "author"), 0),
    ]
    base = spark.range(max(1, rows // len(cases)), numPartitions=1)
    out = None
    for kind, value, lead, before, before2, label in cases:
        part = base.select(
            F.lit(kind).alias("kind"), value.alias("value"),
            F.concat(F.lit(lead), value, F.lit({'"': '"', "://": "@"}.get(lead[:3], ""))).alias("word"), F.lit(lead).alias("lead"),
            before.alias("before"), before2.alias("before2"), F.lit(float(label)).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def train_forest(labelled: DataFrame, marks: bytes, trees: int = 24, depth: int = 7) -> PipelineModel:
    """A forest fitted on the labelled findings (bounded), as assembler and classifier.

    It is saved to the scratch folder and read back: a fitted model keeps its training
    summary, and with it the session, which a task cannot carry.
    """
    from pyspark.ml import Pipeline

    # written before and after the features: every job of the fit would carry the plan of what it reads, and the
    # features of each branch of a union
    known = written(labelled.coalesce(1), "labelled-findings").coalesce(1)
    table = written(with_features(known, marks), "labelled-features").coalesce(1)
    fitted = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="onethird")]).fit(table)
    path = scratch_path(labelled.sparkSession, "secret-forest")
    fitted.save(path)
    return PipelineModel.load(path)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """doc_id, word_no, kind, value, score, is_secret of every candidate.

    ``word_no`` counts the words of the text, a private-key block being one.
    """
    rows = text_rows(df, id_col, text_col)
    marks = trigram_marks(vocabulary)
    found = written(with_features(candidates(rows), marks), "secret-candidates")
    forest = train_forest(labelled_findings(df.sparkSession), marks)
    score = vector_to_array("probability")[1]
    return (forest.transform(found)
            .select("doc_id", "word_no", "kind", "value", score.alias("score"))
            .withColumn("is_secret", (F.col("score") >= THRESHOLD).cast("int")))


def _masked(text: Column, values: Column) -> Column:
    """Longest values first, so that a value inside a longer one does no harm."""
    ordered = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, text, lambda t, v: F.replace(t, v, F.lit(MASK)))


def _masked_words(text: Column, found: Column) -> Column:
    """``text`` with the values of ``found`` (word_no, vals; ascending) masked, each in its own word.

    The text is put together from the stretches between the words with findings.
    """
    words, after = _split(text)

    def put_together(tokens: Column, here: Column) -> Column:
        plain = lambda first, n: F.array_join(
            F.transform(F.slice(tokens, first, n), lambda t: F.concat(t["word"], t["after"])), "")

        def up_to(f: Column, i: Column) -> Column:
            start = F.coalesce(F.get(here, i - 1)["word_no"], F.lit(-1)) + 1
            token = F.get(tokens, f["word_no"])
            return F.concat(plain(start + 1, f["word_no"] - start), _masked(token["word"], f["vals"]), token["after"])

        last = F.coalesce(F.get(here, F.size(here) - 1)["word_no"], F.lit(-1)) + 1
        return F.concat(F.array_join(F.transform(here, up_to), ""), plain(last + 1, F.size(tokens)))

    tokens = F.zip_with(words, after, lambda w, a: F.struct(w.alias("word"), a.alias("after")))
    within = lambda t: F.filter(found, lambda f: f["word_no"] < F.size(t))
    # arrays of one element, so that each part is made once and not for every use
    bound = F.transform(F.array(tokens), lambda t: F.struct(t.alias("tokens"), within(t).alias("here")))
    return F.get(F.transform(bound, lambda x: put_together(x["tokens"], x["here"])), F.lit(0))


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str | None = None) -> DataFrame:
    """``df`` with every accepted finding replaced by ``MASK`` in its word or block.

    Only texts that pass the screen are joined with their findings; all others go
    through untouched.  Columns of any name are kept.
    """
    no_id = F.lit(-1 << 62)
    found = (scan_secrets(df, id_col, text_col, vocabulary).filter("is_secret = 1")
             .groupBy(F.coalesce("doc_id", no_id).alias("key"), "word_no").agg(F.collect_set("value").alias("vals"))
             .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("word_no", "vals"))).alias("found")))
    screened = F.coalesce(F.col(text_col).rlike(SCREEN), F.lit(False))
    hit = (df.filter(screened)
           .select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), no_id).alias("key"))
           .join(found, "key", "left"))
    text = F.when(F.col("found").isNotNull(), _masked_words(F.col("row")[text_col], F.col("found"))).otherwise(
        F.col("row")[text_col])
    done = hit.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))
    return df.filter(~screened).unionByName(done)
