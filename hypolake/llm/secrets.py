"""Secret scans with a random forest against false positives.

Patterns cut a text into plain and candidate pieces: values within a line, and
private keys as blocks of lines from BEGIN to END. A random forest (Spark ML, in the
JVM) trained from labelled findings judges each candidate by its length, the changes
between character classes, how far dictionary words cover it, its path and the
words around it. Only Spark functions are used, and a scan shuffles nothing. Values
judged secret are replaced by their places among the pieces, in one pass.

Labelled findings are a table (path, line, value, label). ``labelled_findings``
makes one by rule for use where no reviewed findings are at hand.

Defined cases: null or empty texts have no findings; a null path counts as
empty; repeated rows give their findings each; an empty table gives an empty
result; lines are scanned whole whatever their length; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that announce a secret, forms of known tokens, and words that make up values that are none.
NAMES = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|credentials?|private[_-]?key|client[_-]?secret"
FORMS = (r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{30,}", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"\bsk-[A-Za-z0-9_-]{20,}", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bAIza[0-9A-Za-z_-]{35}")
WORDS = "access account admin api auth change client code config data default demo dummy empty example fake file generated hello here home index insert invalid key local login main message mock module name null number object package pass password path placeholder private project public replace sample secret service source string system temp test todo token undefined update user username value version world xxx your".split()
BENIGN = r"(?i)\b(commit|sha-?\d*|md5|hash|checksum|digest|uuid|guid|etag|revision|version|example|sample|dummy|fake|mock|placeholder|test)\b"
TEST_PATH = r"(?i)(test|spec|example|sample|mock|fixture|docs?/|readme)"

#: A private key with its body; the possessive groups do not recurse, however long a text is.
KEY_BLOCK = r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*+(?<=PRIVATE KEY)-----"
#: A named value, a known form, or a long run of letters and digits that holds both: anywhere in a run if both come early, else from the run's start, so that a run is looked through once. None of them goes over the end of a line.
RUN = "[A-Za-z0-9+/_=-]"
GAP = r"[ \t\x0B\f\r]{0,4}"
CANDIDATE = rf"(?i:\b(?:{NAMES})\b[\"']?{GAP}(?::=|=>|[:=]){GAP}[\"']?[^\s\"'<>,;]{{8,}})|{'|'.join(FORMS)}|\b(?=[A-Za-z+/_=-]{{0,40}}[0-9])(?=[0-9+/_=-]{{0,40}}[A-Za-z]){RUN}{{24,}}|(?<!{RUN})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){RUN}{{24,}}"
#: What every candidate has: a sign of assignment, twenty characters of a run, or the start of a form that is shorter.
HINT = rf"[:=]|(?<!{RUN}){RUN}{{20}}|xox[abprs]-|eyJ|-----BEGIN "
#: Pieces whose sizes are summed at once.
BLOCK = 128
FEATURES = ("length", "runs", "digits", "capitals", "symbols", "variety", "hexadecimal", "covered", "named", "known_form", "benign_words", "test_path", "quoted")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def may_hold(text: Column) -> Column:
    """Whether a text has a candidate; a cheap test that every candidate passes goes first."""
    return F.coalesce(text.rlike(HINT) & text.rlike(CANDIDATE), F.lit(False))


def segments(text: Column) -> Column:
    """The text cut into plain and candidate pieces by turns, plain ones (which may be empty) first and last; joined, they are the text. Private keys are cut out first."""
    turns = lambda t, pattern, inner: F.flatten(F.transform(F.arrays_zip(F.split(t, pattern).alias("plain"), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("hit")), lambda z: F.concat(inner(z["plain"]), F.when(z["hit"].isNull(), F.array().cast("array<string>")).otherwise(F.array(z["hit"])))))
    return turns(text, KEY_BLOCK, lambda outside: turns(outside, CANDIDATE, lambda x: F.array(x)))


def _places(pieces: Column) -> Column:
    """A struct (nth, line_no, start, match, before, after) for every candidate piece. Lines and columns are summed by blocks of pieces, so that texts with very many candidates stay cheap."""
    origin = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("tail"))
    moved = lambda at, by: F.struct((at["lines"] + by["lines"]).alias("lines"), F.when(by["lines"] > 0, by["tail"]).otherwise(at["tail"] + by["tail"]).alias("tail"))
    step = lambda s: F.struct((F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).alias("lines"), F.length(F.substring_index(s, "\n", -1)).alias("tail"))
    block = lambda k: F.floor(k / BLOCK).cast("int")
    spread = lambda sizes: F.transform(F.sequence(F.lit(0), block(F.size(sizes) - 1)), lambda j: F.aggregate(F.slice(sizes, j * BLOCK + 1, F.lit(BLOCK)), origin, moved))
    before_block = lambda sums: F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, F.lit(1), j), origin, moved))

    def each(sizes: Column, heads: Column) -> Column:
        def place(nth: Column) -> Column:
            k = 2 * nth + 1
            at = F.aggregate(F.slice(sizes, block(k) * BLOCK + 1, k % BLOCK), F.get(heads, block(k)), moved)
            return _let(at, lambda a: F.struct(nth.alias("nth"), (a["lines"] + 1).alias("line_no"), (a["tail"] + 1).alias("start"), F.get(pieces, k).alias("match"), F.right(F.substring_index(F.get(pieces, k - 1), "\n", -1), F.lit(80)).alias("before"), F.left(F.substring_index(F.get(pieces, k + 1), "\n", 1), F.lit(80)).alias("after")))

        count = F.floor(F.size(pieces) / 2).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), place))

    return _let(F.transform(pieces, step), lambda sizes: _let(_let(spread(sizes), before_block), lambda heads: each(sizes, heads)))


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """id, path, nth (from 0 in its text), line_no (from 1), start (code points in the line, from 1), match, before and after for every candidate."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    some = df.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("t")).where(may_hold(F.col("t")))
    return some.select("id", "path", F.inline(_let(segments(F.col("t")), _places)))


def value_of(match: Column) -> Column:
    """The value in a match: what follows the name and the sign of assignment."""
    return F.regexp_replace(match, rf"^(?i:(?:{NAMES})[\"']?\s*(?::=|=>|[:=])\s*)?[\"']?", "")


def with_features(found: DataFrame) -> DataFrame:
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda keep: F.length(F.regexp_replace(v, keep, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    bare = F.regexp_replace(F.lower(v), f"({'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))})", "")
    around = F.concat_ws(" ", F.col("before"), F.col("after"))
    columns = {
        "length": F.least(n, F.lit(200)),
        "runs": F.length(F.regexp_replace(classes, r"(.)\1*", "x")) / n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "symbols": share("[A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split(F.left(v, F.lit(200)), ""))) / F.least(n, F.lit(200)),
        "hexadecimal": v.rlike("^[0-9A-Fa-f]+$"),
        "covered": 1 - F.length(bare) / n,
        "named": F.col("match").rlike(rf"^(?i:{NAMES})\b"),
        "known_form": F.col("match").rlike("|".join(FORMS)),
        "benign_words": around.rlike(BENIGN),
        "test_path": F.col("path").rlike(TEST_PATH),
        "quoted": F.left(F.col("after"), F.lit(1)).isin('"', "'"),
    }
    return found.withColumns({f"f_{k}": c.cast("double") for k, c in columns.items()})


def labelled_findings(spark: SparkSession, n: int = 4000, start: int = 0) -> DataFrame:
    """n labelled lines from number start on (path, line, label), made by rule from digests of their numbers: random values in the forms of keys and tokens, named or (known forms) bare, against placeholders, digests and identifiers in their usual surroundings."""
    i = F.col("id").cast("string")
    hexes, more = F.sha2(F.concat(F.lit("a"), i), 256), F.sha2(F.concat(F.lit("b"), i), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "x")
    pick = lambda words, salt: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int"))
    name = pick(["token", "secret", "password", "api_key", "access_key", "client_secret", "auth", "TOKEN", "API_KEY"], 1)
    sign = pick([' = "', '="', ": ", "=", " := '"], 2)
    close = F.when(sign.contains('"'), '"').when(sign.contains("'"), "'").otherwise("")
    prose = pick(["", "see the of and ", "// ", "export ", "the value ", "  "], 3)
    code_path = pick(["src/app.py", "config/settings.yaml", "deploy/prod.env", "src12", "lib/client.js", ""], 4)
    test_path = pick(["tests/test_app.py", "docs/guide.md", "examples/demo.py", "src12", "README.md", ""], 5)
    # a third of the secrets are known forms, most of them bare
    draw = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(12))
    secret = F.when(draw < 4, pick(["aws", "gh", "xox", "sk", "jwt", "google", "pem"], 20)).otherwise(pick(["hex40", "hex32", "b64", "aws", "gh", "short", "HEX40"], 6))
    bare = draw < 3
    more64 = F.regexp_replace(F.base64(F.unhex(more)), "[+/=]", "x")
    kinds = pick(["", "RSA ", "EC ", "OPENSSH "], 14)
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + F.pmod(F.xxhash64("id", F.lit(15)), F.lit(24)).cast("int")), lambda k: F.left(F.base64(F.unhex(F.concat(F.sha2(F.concat(i, F.lit("c"), k.cast("string")), 256), F.sha2(F.concat(i, F.lit("d"), k.cast("string")), 256)))), F.lit(64))), "\n")
    value = (
        F.when(secret == "hex40", F.left(hexes, F.lit(40)))
        .when(secret == "HEX40", F.upper(F.left(hexes, F.lit(40))))
        .when(secret == "hex32", F.left(hexes, F.lit(32)))
        .when(secret == "b64", b64)
        .when(secret == "aws", F.concat(F.lit("AKIA"), F.upper(F.left(hexes, F.lit(16)))))
        .when(secret == "gh", F.concat(pick(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], 16), F.left(b64, F.lit(36))))
        .when(secret == "xox", F.concat(pick(["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], 17), F.translate(F.left(more, F.lit(12)), "abcdef", "012345"), F.lit("-"), F.left(b64, F.lit(24))))
        .when(secret == "sk", F.concat(pick(["sk-", "sk-live_", "sk-proj-"], 18), F.left(b64, F.lit(32))))
        .when(secret == "jwt", F.concat(F.lit("eyJ"), F.left(b64, F.lit(33)), F.lit(".eyJ"), F.left(more64, F.lit(40)), F.lit("."), b64))
        .when(secret == "google", F.concat(F.lit("AIza"), F.left(b64, F.lit(35))))
        .when(secret == "pem", F.concat(F.lit("-----BEGIN "), kinds, F.lit("PRIVATE KEY-----\n"), body, F.lit("\n-----END "), kinds, F.lit("PRIVATE KEY-----")))
        .otherwise(F.left(b64, F.lit(14)))
    )
    tail = pick(["of the", "# keep", "", "and", "of the", "# keep", "and the", "of this version"], 7)
    ahead = pick(["", "- ", "https://api.site.net/v1/items?k=", "Bearer ", "2024-03-01 12:00:07 INFO sent ", "['", "see the of and ", "x-header: "], 19)
    good = F.when(bare, F.concat(ahead, value, F.when(ahead.endswith("'"), "'").otherwise(""), F.lit(" "), tail)).otherwise(F.concat(prose, name, sign, value, close, F.lit(" "), tail))
    holder = pick(["your-api-key-here", "changeme123", "xxxxxxxxxxxx", "example_token_value", "placeholder_password", "dummy-secret-key", "test_token_1234", "insert_your_token_here", "default_password", "process.env.TOKEN"], 8)
    uuid = F.concat_ws("-", F.left(hexes, F.lit(8)), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    kind = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5))
    bad = (
        F.when(kind == 0, F.concat(prose, name, sign, holder, close))
        .when(kind == 1, F.concat(pick(["commit ", "sha1 ", "revision ", "checksum: ", "digest "], 10), F.left(more, F.lit(40))))
        .when(kind == 2, F.concat(pick(["id ", "uuid: ", "request "], 11), uuid))
        .when(kind == 3, F.concat(F.lit("module "), pick(["very_long_function_name_v2_update", "some-package-name-with-version-12", "project_config_default_user_data_1"], 12), F.lit(" end")))
        .otherwise(F.concat(F.lit("sha256-"), F.base64(F.unhex(more)), F.lit(" hash")))
    )
    label = F.pmod(F.col("id"), F.lit(2))
    return spark.range(start, start + n).select(F.when(label == 1, code_path).otherwise(F.when(kind == 0, test_path).otherwise(code_path)).alias("path"), F.when(label == 1, good).otherwise(bad).alias("line"), label.cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 40, depth: int = 7, seed: int = 1) -> PipelineModel:
    """Random forest of labelled findings (path, line, label); lines in which no pattern finds a candidate are left out."""
    numbered = findings.withColumn("_label", F.col("label").cast("double")).withColumn("id", F.struct("_label", F.monotonically_increasing_id().alias("row")))
    known = candidates(numbered, "id", "line", "path").withColumn("value", value_of(F.col("match")))
    rows = with_features(known).withColumn("label", F.col("id")["_label"])
    assembler = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def judge(found: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Candidates with value, probability and is_secret."""
    judged = model.transform(with_features(found.withColumn("value", value_of(F.col("match"))))).withColumn("probability", F.get(vector_to_array("probability"), 1))
    return judged.withColumn("is_secret", F.col("probability") >= threshold)


def scan(df: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Findings: id, line_no, start and size of the value in its line, value's digest, probability and is_secret; the value itself stays in column value."""
    judged = judge(candidates(df, id_col, text_col, path_col), model, threshold)
    offset = F.length("match") - F.length("value")
    return judged.select(F.col("id").alias(id_col), "line_no", (F.col("start") + offset).cast("int").alias("start"), F.length("value").alias("size"), "value", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def redacted(df: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", stand_in: str = "[SECRET]") -> DataFrame:
    """df with every value judged secret replaced where it stands, in one pass over the pieces of its text. Only documents with a candidate are shuffled; equal texts of one id and path share their verdicts."""
    has = may_hold(F.col(text_col))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    some = df.where(has).withColumn("__key", F.struct(F.col(id_col).alias("id"), path.alias("path"), F.xxhash64(text_col).alias("text")))
    judged = judge(candidates(some, "__key", text_col, path_col), model, 0.5)
    # how much of the match stays before the value, or -1 where all of it does
    skip = F.when(F.col("is_secret"), F.length("match") - F.length("value")).otherwise(-1)
    verdicts = judged.groupBy(F.col("id").alias("__of")).agg(F.array_sort(F.collect_set(F.struct("nth", skip.alias("skip")))).alias("__verdicts"))
    verdicts = verdicts.where(F.exists("__verdicts", lambda v: v["skip"] >= 0))
    piece = lambda s, i: F.when(i % 2 == 0, s).otherwise(_let(F.get("__verdicts", F.floor(i / 2).cast("int"))["skip"], lambda n: F.when(n >= 0, F.concat(F.left(s, n), F.lit(stand_in))).otherwise(s)))
    clean = F.array_join(F.transform(segments(F.col(text_col)), piece), "")
    joined = some.join(verdicts, F.col("__key").eqNullSafe(F.col("__of")), "left")
    return df.where(~has).unionByName(joined.withColumn(text_col, F.when(F.col("__verdicts").isNotNull(), clean).otherwise(F.col(text_col))).drop("__key", "__of", "__verdicts"))
