"""Secret scans with a random forest against false positives, with DataFrame functions only.

Candidates are private key blocks, web tokens of three parts, what is assigned
to a word such as "password", and other runs of token characters with letters
and digits. A random forest judges each by its length, the transitions between
kinds of characters, how much of it dictionary words cover, its path, and the
words before and after it. The forest is trained from labelled findings;
``labelled_findings`` makes a fixed set of them by rule. It is then turned into
array lookups, so that scoring, finding and masking are expressions over each
text: no join, no shuffle, no Python.

Null and empty texts have no findings; a null path counts as empty. Offsets are in
characters. Repeated rows have the same findings each; ``mask`` keeps further columns,
and takes time in proportion to a text's length. Candidates don't overlap: at one place
the first of the kinds above counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest characters of a run and of an assigned value, and characters around a candidate that are looked at.
LEAST_CHARS, LEAST_ASSIGNED, NEAR_CHARS = 12, 8, 40
_VALUE = "[A-Za-z0-9!#$%&*+./:=?@^_~-]"
_ASSIGNS = r"(?<=(?:token|secret|passwo?r?d|pwd|api[_-]?key|credential|private[_-]?key|access[_-]?key)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?|bearer )"
CANDIDATE = "|".join(
    (
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/= \r\n]{16,}(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
        r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}",
        # The word is looked for only where a value of some length can start.
        rf"(?<=[=: \t\"'])(?={_VALUE}{{{LEAST_ASSIGNED}}})(?i:{_ASSIGNS}){_VALUE}{{{LEAST_ASSIGNED - 1},}}[A-Za-z0-9!#$%&*+/=@^_~-]",
        rf"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{LEAST_CHARS},}}(?:={{1,2}}(?![A-Za-z0-9+/_-]))?",
    )
)
TREES, DEPTH, SEED = 24, 6, 9
FINDINGS = 6000
THRESHOLD = 0.5
MASK = "<secret>"

# Words that identifiers and placeholders are made of.
DICTIONARY = (
    "account address admin alpha application array attempt backup beta build button cache candidate change changeme class client cloud column command config "
    "connection container content count create data date default delete demo device document dummy email enable error event example fake file filter first "
    "format function get group handler header here host image index input insert item key label last layout left length level line link list local lock log "
    "main manager message method model module name network node null number object order output page param parse password path placeholder pool port process "
    "project query queue read record release remove report request resource response result right role row sample schema script search secret select server "
    "service session set size source start state status stop storage string style submit system table target task template test text time title token total "
    "track type update upload url user value version view width window worker write xxxx your"
).split()
# Words near secrets, words near other digests, folders of made-up data, issuers' prefixes.
NEAR_SECRET = r"(?i)(token|secret|passw|api[_-]?key|auth|bearer|credential|private|access[_-]?key)"
NEAR_DIGEST = r"(?i)(commit|sha\d*\b|md5|checksum|digest|uuid|guid|etag|version|hash|revision|build|request)"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|docs?|samples?|mocks?)([/_.-]|$)"
NEAR_SAMPLE = r"(?i)(example|sample|dummy|fake|placeholder|not real|your own|test value|for tests)"
ISSUED = r"^(-----BEGIN|eyJ|AKIA|ASIA|ghp_|gho_|sk_live_|xox[abp]-|AIza|glpat-)"


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """What the forest sees of a candidate."""
    size = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    kinds = F.translate(candidate, "BCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz123456789+/=", "A" * 25 + "a" * 25 + "0" * 9 + "---")
    share = lambda pattern: (size - F.length(F.regexp_replace(candidate, pattern, ""))) / size
    letters = F.regexp_replace(F.lower(candidate), "[^a-z]", "")
    sounds = F.translate(letters, "eiouybcdfghjklmnpqrstvwxz", "a" * 5 + "b" * 20)
    covered = F.length(F.regexp_replace(F.lower(candidate), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return [
        size,
        F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / size,
        share("[0-9]"),
        share("[A-Z]"),
        share("[_-]"),
        F.size(F.array_distinct(F.split(candidate, ""))) / size,
        F.length(F.regexp_replace(candidate, r"(.)\1+", "$1")) / size,
        candidate.rlike("^[0-9a-fA-F]+$").cast("double"),
        candidate.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$").cast("double"),
        (size - covered) / size,
        path.rlike(TEST_PATH).cast("double"),
        before.rlike(NEAR_SECRET).cast("double"),
        before.rlike(NEAR_DIGEST).cast("double"),
        before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        candidate.rlike(ISSUED).cast("double"),
        share("[!#$%&*.:?@^~]"),
        share("[a-z]"),
        F.length(F.regexp_replace(sounds, r"(.)\1+", "$1")) / F.greatest(F.length(letters), F.lit(1)).cast("double"),
        after.rlike(NEAR_DIGEST).cast("double"),
        before.rlike(NEAR_SAMPLE).cast("double"),
        after.rlike(NEAR_SAMPLE).cast("double"),
        after.rlike(r"^[\"']").cast("double"),
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """candidate, before, after, path and label (1: a secret) of ``n`` findings made by rule."""
    rows = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("kind"))
    pick = lambda salt, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    mixed = F.regexp_replace(F.base64(F.unhex("hex")), "=", "")
    size = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20)).cast("int")
    cut = lambda text, least: text.substr(F.lit(1), F.lit(least) + size)
    secret_words = pick(2, "token = ", "token: ", "api_key = ", "apikey=", "client_secret: ", "password = ", "Authorization: Bearer ", "aws_secret_access_key = ", "auth_token=", "private_key: ")
    digest_words = pick(3, "commit ", "sha256: ", "checksum = ", "md5: ", "revision ", "etag: ", "build ", "digest: ", "sha1=", "request id ")
    quote = pick(4, "", '"', "'", '"')
    plain = pick(5, "see ", "in the ", "as of ", "", "and then ", "file ", "branch ")
    word = lambda salt: pick(salt, *DICTIONARY)
    number = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(9000)) + 10
    kind, k = F.col("kind"), F.lit
    dash = pick(7, "_", "-", "_")
    identifier = F.concat(word(8), dash, word(9), dash, word(10), dash, number.cast("string"))
    placeholder = F.concat(pick(11, "your_api_key_here_", "changeme", "xxxxxxxxxxxx", "example_token_", "REPLACE_WITH_TOKEN_", "test_secret_", "000000000000000a", "dummy-password-"), number.cast("string"))
    uuid = F.concat_ws("-", F.substring("hex", 1, 8), F.substring("hex", 9, 4), F.substring("hex", 13, 4), F.substring("hex", 17, 4), F.substring("hex", 21, 12))
    syllable = lambda salt: pick(salt, "ba", "re", "ti", "on", "lu", "mer", "sal", "de", "vo", "gan", "pi", "ter", "ing", "ca", "no", "wi", "the", "ly")
    prose = F.concat(syllable(20), syllable(21), syllable(22), syllable(23), pick(24, "", "ed", "ness", "ly", "ation"))
    # Passwords: a word or letters of no word, with other signs and digits or without.
    letters = F.translate(F.substring("hex", 40, 14), "0123456789", "qwzxkvjhgp")
    password = F.when(F.pmod(F.xxhash64("id", F.lit(25)), F.lit(3)) == 0, letters).otherwise(
        F.concat(F.initcap(syllable(26)), pick(27, "0", "4", "3!", "7", "$"), F.substring(letters, 1, 4), pick(28, "&", "!", "#9", "_", "@", "%x"), number.cast("string"))
    )
    web_token = F.concat(k("eyJ"), F.substring(mixed, 1, 17), k("."), k("eyJ"), F.substring(mixed, 5, 24), k("."), F.regexp_replace(mixed, "[+/]", "_"))
    key_block = F.concat(k("-----BEGIN "), pick(29, "", "RSA ", "EC "), k("PRIVATE KEY-----\n"), mixed, k("\n"), mixed, k("\n-----END PRIVATE KEY-----"))
    candidate = (
        F.when(kind.isin(0, 1, 10), F.col("hex").substr(F.lit(1), pick(12, 32, 40, 40, 64)))
        .when(kind == 2, cut(mixed, 20))
        .when(kind == 3, F.concat(k("AKIA"), F.upper(F.substring("hex", 1, 16))))
        .when(kind == 4, F.concat(pick(13, "ghp_", "sk_live_", "xoxb-", "glpat-"), F.regexp_replace(F.substring(mixed, 1, 36), "[+/]", "x")))
        .when(kind == 5, F.col("hex").substr(F.lit(1), pick(14, 32, 40, 40, 64)))
        .when(kind == 6, uuid)
        .when(kind.isin(7, 11), placeholder)
        .when(kind == 8, identifier)
        .when(kind.isin(12, 18), password)
        .when(kind.isin(13, 19), prose)
        .when(kind == 14, web_token)
        .when(kind == 15, key_block)
        .when(kind.isin(16, 17), F.when(F.pmod(F.xxhash64("id", F.lit(30)), F.lit(2)) == 0, F.col("hex").substr(F.lit(1), pick(31, 32, 40, 64))).otherwise(cut(mixed, 14)))
        .otherwise(cut(mixed, 12))
    )
    sample_words = pick(32, "example: ", "a fake token = ", "dummy password = ", "sample api_key: ", "not real: ")
    words = F.when(kind.isin(5, 6), digest_words).when(kind.isin(8, 16), plain).when((kind == 17) & (number % 2 == 0), sample_words).when(kind.isin(14, 15) & (number % 2 == 0), plain).otherwise(secret_words)
    bare = kind.isin(8, 13, 15, 16, 19)
    before = F.concat(pick(15, "", "set ", "the config has ", "export ", "line "), words, F.when(bare, "").otherwise(quote))
    closing = F.when(bare, "").otherwise(quote)
    tail = (
        F.when(kind == 16, pick(33, " is the checksum", " (sha256)", " as its digest", " was the commit", " is this build's version"))
        .when((kind == 17) & (number % 2 == 1), pick(34, " # example", " (placeholder)", " is a fake one", " # sample", " for tests"))
        .otherwise(pick(35, "", " and more", "\n", ", then", " in the file", "; next"))
    )
    after = F.concat(closing, tail)
    path = F.when(kind == 10, pick(16, "tests/fixtures/a.json", "docs/example.md", "src/test/data.txt", "samples/config.yml")).otherwise(pick(17, "src/main.py", "config/app.yml", "src0", "src12", "deploy.sh", "web"))
    return rows.select(candidate.alias("candidate"), F.right(before, F.lit(NEAR_CHARS)).alias("before"), F.left(after, F.lit(NEAR_CHARS)).alias("after"), path.alias("path"), kind.isin(0, 1, 2, 3, 4, 9, 12, 14, 15, 18).cast("double").alias("label"))


def _flatten(node, depth: int, at: int, tests: list, leaves: list) -> None:
    """A tree as a full binary tree of ``DEPTH`` levels: a leaf further up goes on to the left."""
    inner = hasattr(node, "leftChild") and node.getClass().getSimpleName() == "InternalNode"
    if depth == DEPTH:
        stats = list(node.impurityStats().stats())
        leaves[at - (2**DEPTH - 1)] = stats[1] / sum(stats)
        return
    if inner:
        tests[at] = (node.split().featureIndex(), node.split().threshold())
        left, right = node.leftChild(), node.rightChild()
    else:
        left = right = node
    _flatten(left, depth + 1, 2 * at + 1, tests, leaves)
    _flatten(right, depth + 1, 2 * at + 2, tests, leaves)


def fit_forest(findings: DataFrame):
    """pyspark.ml's forest for labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5)
    return forest.fit(feature_table(findings).coalesce(1))


def feature_table(findings: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    seen = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    return findings.select(array_to_vector(F.array(*[f.cast("double") for f in seen])).alias("features"), "label")


def trees_of(forest) -> list[tuple[list[int], list[float], list[float]]]:
    """A forest's trees: features and thresholds of the tests, and leaves."""
    out = []
    for tree in forest.trees:
        tests: list = [(0, float("inf"))] * (2**DEPTH - 1)
        leaves = [0.0] * 2**DEPTH
        _flatten(tree._java_obj.rootNode(), 0, 0, tests, leaves)
        out.append(([t[0] for t in tests], [min(t[1], 1e300) for t in tests], leaves))
    return out


def train(findings: DataFrame) -> list[tuple[list[int], list[float], list[float]]]:
    """The trees of a forest fitted to labelled findings."""
    return trees_of(fit_forest(findings))


def score(seen: Column, trees: list[tuple[list[int], list[float], list[float]]]) -> Column:
    """The forest's mean probability for an array of features."""

    def walk(tree) -> Column:
        which, most, leaves = (F.lit(x) for x in tree)
        step = lambda n, _: 2 * n + F.when(F.get(seen, F.get(which, n)) <= F.get(most, n), 1).otherwise(2)
        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step, lambda n: F.get(leaves, n - (2**DEPTH - 1)))

    total = walk(trees[0])
    for tree in trees[1:]:
        total = total + walk(tree)
    return total / len(trees)


#: Numbers that are summed up one after another.
_RUN = 256


def _running(sizes: Column) -> Column:
    """The sum of all numbers before each of ``sizes``. Appending to an array copies
    it, so sums are made within runs and over the runs' totals."""

    def sums(values: Column, first: Column) -> Column:
        add = lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["sums"], a["at"]).alias("sums"))
        return F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("sums")), add, lambda a: a["sums"])

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda i: F.slice(v, i * _RUN + 1, F.lit(_RUN)))
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), sums(totals, F.lit(0)).alias("first")), lambda z: sums(z["run"], z["first"])))

    return _named(sizes, whole)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: a lambda's body would do so for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _findings(text: Column, path: Column, judge: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The pieces of a text between candidates, and the candidates as structs. Time
    is in proportion to the text: what stands around a candidate is put together
    from the pieces beside it, not cut out of the text."""
    gaps = F.split(text, CANDIDATE, -1)
    both = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # Candidates of 8 characters at least: so many pieces on a side are enough.
    reach = NEAR_CHARS // LEAST_ASSIGNED + 1

    def every(x: Column) -> Column:
        sizes = F.transform(F.arrays_zip(x["gaps"], x["found"]), lambda z: F.length(z["gaps"]) + F.coalesce(F.length(z["found"]), F.lit(0)))

        def finding(z: Column, i: Column) -> Column:
            candidate = z["found"]
            near = F.lit(NEAR_CHARS)
            left = [c for k in range(reach, 0, -1) for c in (F.right(F.get(x["gaps"], i - k), near), F.right(F.get(x["found"], i - k), near))]
            right = [c for k in range(1, reach + 1) for c in (F.left(F.get(x["gaps"], i + k), near), F.left(F.get(x["found"], i + k), near))]
            around = F.struct(F.right(F.concat_ws("", *left, F.right(z["gaps"], near)), near).alias("before"), F.left(F.concat_ws("", *right), near).alias("after"))
            start = z["start"] + F.length(z["gaps"])
            seen = _named(around, lambda a: F.array(*[f.cast("double") for f in features(candidate, a["before"], a["after"], path)]))
            kind = F.when(candidate.rlike(ISSUED), "issued").when(candidate.rlike("^[0-9a-fA-F]+$"), "hex").when(candidate.rlike("^[A-Za-z0-9+/_-]+={0,2}$"), "token").otherwise("value")
            return F.struct(start.alias("start"), (start + F.length(candidate)).alias("end"), kind.alias("kind"), candidate.alias("candidate"), _named(seen, judge).alias("score"))

        zipped = F.arrays_zip(x["gaps"].alias("gaps"), x["found"].alias("found"), _running(sizes).alias("start"))
        return F.transform(F.slice(zipped, F.lit(1), F.size(x["found"])), finding)

    return gaps, _named(both, every)


def scan(docs: DataFrame, trees: list | None = None, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with streamwin_gaps and streamwin_findings: [(start, end, kind, candidate, score, is_secret)], null without candidates."""
    trees = trees or train(labelled_findings(docs.sparkSession))
    text = F.col(f"`{text_col}`")
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    gaps, found = _findings(text, path, lambda seen: score(seen, trees))
    has = text.rlike(CANDIDATE)
    out = docs.withColumns({"streamwin_gaps": F.when(has, gaps), "streamwin_findings": F.when(has, found)})
    judged = F.transform("streamwin_findings", lambda f: f.withField("is_secret", f["score"] >= threshold))
    return out.withColumn("streamwin_findings", judged)


def findings(docs: DataFrame, trees: list | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: doc_id, place (from 0), start, end, kind, sha256 of the candidate, score and is_secret."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (F.col(f"`{path_col}`") if path_col else F.lit("")).alias("path"))
    found = scan(rows.where(F.col("text").rlike(CANDIDATE)), trees, "text", "path", threshold).select("doc_id", F.posexplode("streamwin_findings").alias("place", "f"))
    return found.select("doc_id", "place", "f.start", "f.end", "f.kind", F.sha2("f.candidate", 256).alias("sha256"), "f.score", "f.is_secret")


def mask(docs: DataFrame, trees: list | None = None, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``MASK``; other texts stay as they are."""
    found = scan(docs, trees, text_col, path_col, threshold)
    pieces = F.transform("streamwin_findings", lambda f: F.when(f["is_secret"], F.lit(MASK)).otherwise(f["candidate"]))
    masked = F.array_join(F.flatten(F.transform(F.arrays_zip(F.col("streamwin_gaps").alias("g"), F.array_append(pieces, F.lit("")).alias("p")), lambda z: F.array(z["g"], z["p"]))), "")
    dirty = F.exists("streamwin_findings", lambda f: f["is_secret"])
    return found.withColumn(text_col, F.when(F.coalesce(dirty, F.lit(False)), masked).otherwise(F.col(f"`{text_col}`"))).drop("streamwin_gaps", "streamwin_findings")
